"""Best-fit packing with certified repacking.

Items are dealt to partitions of a bounded size and each partition is packed best-fit decreasing.
Dual-feasible functions give a lower bound for each partition's number of bins.  A partition that
meets its bound is certified and final.  Partitions with a gap give up the documents of every bin that is
not full; those are dealt anew among fewer partitions and packed again, as long as that saves bins.

Null text packs as the empty text.  An empty table gives no rows.  Repeated rows are packed each.
"""

from __future__ import annotations

import itertools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import cut_lineage, groups_for
from strandlight.llm.wordcodec import codec

CAPACITY = 2048
PER_PARTITION = 50_000  # items packed by one task; bounds its memory

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, deal long"


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY) -> DataFrame:
    """One row for each piece of each document.  A document over ``capacity`` is cut into pieces of
    that length, of which the first holds the remainder.  ``deal`` is a number to deal rows by."""

    def pieces(batches):
        words, end, row = codec(tokenizer), end_id.to_bytes(4, "little"), 0
        for batch in batches:
            out = [[] for _ in range(6)]
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = words.encode(text or "") + end
                n, start, k = len(ids) // 4, 0, 0
                while start < n:
                    length = (n - 1) % capacity + 1 if k == 0 else capacity
                    crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
                    for column, value in zip(out, (doc_id, k, start, length, crc, (zlib.crc32(b"%d %d %d" % (crc, row, k)) << 20) + row)):
                        column.append(value)
                    start, k, row = start + length, k + 1, row + 1
            types = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types)], names=["doc_id", "piece", "start", "length", "ids_crc32", "deal"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(pieces, PIECES)


def lower_bound(lengths: np.ndarray, capacity: int = CAPACITY, families: int = 24) -> int:
    """Bins that any packing needs at least: the best of three families of dual-feasible functions."""
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1)[: capacity + 1].astype(np.int64)
    size = np.arange(capacity + 1, dtype=np.int64)
    best = -(-int((count * size).sum()) // capacity)
    above = count[::-1].cumsum()[::-1]  # items of this length or more
    weight = (count * size).cumsum()
    for e in range(1, capacity // 2 + 1):
        # longer than capacity - e counts as a whole bin, shorter than e as nothing
        whole = int(above[capacity - e + 1]) if capacity - e + 1 <= capacity else 0
        middle = int(weight[capacity - e] - weight[e - 1])
        best = max(best, whole + -(-middle // capacity))
    for k in range(1, families + 1):
        # lengths rounded to multiples of 1/k, those at a multiple of 1/(k + 1) kept
        scaled = size * (k + 1)
        exact = scaled % capacity == 0
        value = np.where(exact, size * k, (scaled // capacity) * capacity)
        best = max(best, -(-int((count * value).sum()) // (capacity * k)))
    for e in range(1, capacity // 2 + 1, max(1, capacity // 256)):
        # by how many items of length e fit beside
        room = capacity // e
        value = np.where(2 * size > capacity, 2 * (room - (capacity - size) // e), np.where(2 * size == capacity, room, 2 * (size // e)))
        value[:e] = 0
        best = max(best, -(-int((count * value).sum()) // (2 * room)))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int = CAPACITY) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bin of each item, offset in it, load of each bin).  Open bins are kept by room left, and a
    bit set of the rooms in use gives the tightest fit in a few operations."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    used, room_of = 0, []
    for i, length in zip(order.tolist(), lengths[order].tolist()):
        fits = used >> length
        if fits:
            room = length + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                used ^= 1 << room
        else:
            b, room = len(room_of), capacity
            room_of.append(capacity)
        bins[i], offsets[i] = b, capacity - room
        room -= length
        room_of[b] = room
        if room:
            by_room[room].append(b)
            used |= 1 << room
    return bins, offsets, capacity - np.array(room_of, np.int64)


def pack(items: DataFrame, capacity: int = CAPACITY, per_partition: int = PER_PARTITION, report: list | None = None) -> DataFrame:
    """``items`` (with ``length`` from 1 to capacity and ``deal``, any number) and for each
    ``sequence_id``, ``offset``, ``certified`` (its partition met its lower bound).

    Partitions exchange as long as that saves a bin.  ``report``, if given, gets a (bins, lower bound) of each round's partitions, summed.
    """
    names = items.columns
    schema = items.schema.simpleString()[len("struct<") : -1]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    schema += ", part int, bin long, offset long, slack long, bins long, bound long"

    def packed(group: pa.Table) -> pa.Table:
        lengths = group.column("length").to_numpy()
        bins, offsets, loads = best_fit_decreasing(lengths, capacity)
        n = len(lengths)
        added = {"bin": bins, "offset": offsets, "slack": (capacity - loads)[bins], "bins": np.full(n, len(loads)), "bound": np.full(n, lower_bound(lengths, capacity))}
        for name, values in added.items():
            group = group.append_column(name, pa.array(values, pa.int64()))
        return group

    def deal(df: DataFrame, n: int, turn: int) -> DataFrame:
        parts = groups_for(n, per_partition)
        dealt = df.select(*names, F.pmod(F.xxhash64("deal", F.lit(turn)), F.lit(parts)).cast("int").alias("part"))
        return cut_lineage(dealt.groupBy("part").applyInArrow(packed, schema).withColumn("turn", F.lit(turn)))

    def totals(df: DataFrame):
        one = df.groupBy("part").agg(F.max("bins").alias("bins"), F.max("bound").alias("bound"))
        return one.agg(F.coalesce(F.sum("bins"), F.lit(0)), F.coalesce(F.sum("bound"), F.lit(0))).first()

    current = deal(items, items.count(), 0)
    final = None
    if report is not None:
        report.append(tuple(totals(current)))
    for turn in itertools.count(1):
        gap = F.col("bins") > F.col("bound")
        pool = current.where(gap & (F.col("slack") > 0))
        n, before = pool.agg(F.count(F.lit(1)), F.count_distinct("part", "bin")).first()
        if n == 0 or before < 2:
            break
        again = deal(pool, n, turn)
        after, least = totals(again)
        if report is not None:
            report.append((after, least))
        if after >= before:
            break
        kept = current.where(~(gap & (F.col("slack") > 0)))
        final = kept if final is None else final.unionByName(kept)
        current = again
    final = current if final is None else final.unionByName(current)
    sequence = F.col("turn").cast("long") * F.lit(1 << 54) + F.col("part").cast("long") * F.lit(1 << 20) + F.col("bin")
    return final.select(*names, sequence.alias("sequence_id"), "offset", (F.col("bins") <= F.col("bound")).alias("certified"))


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, report: list | None = None) -> DataFrame:
    pieces = cut_lineage(token_pieces(docs, tokenizer, end_id, capacity))
    return pack(pieces, capacity, report=report).drop("deal")
