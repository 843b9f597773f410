"""Content-addressed store of token ids.

Layout under one folder, all Parquet:

* ``sections/kind=0``: each unique chunk once: key (sha-256 of its ids, 32 bits each), n, ids (little-endian, 16 bits each where all fit, else 32);
* ``recipes``: for each document, ascending by doc_id: the keys of its chunks in order, start, n_tokens, ids_crc32 and the Merkle root over the keys;
* ``manifest``: for each recipes part the Merkle root over its documents' roots.

Chunks end where a rolling hash of the last WINDOW ids has MASK bits zero, so equal passages give
equal chunks wherever they stand.  Null text is the empty text; a document of only the end id is one
chunk.  Repeated doc_ids, and repeated rows, are kept as separate documents; of equal ids the smaller
CRC and then count comes first, and null ids come before all.  A very long text is one document of many chunks.  An
empty table gives a store without rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from strandlight.llm.common import cut_lineage, groups_for, shared_folder
from strandlight.llm.wordcodec import codec

WINDOW = 16
MASK = 0xFF  # a cut each 256 ids on average
LEAST, MOST = 64, 2048
REMEMBERED = 250_000  # chunk keys that a task remembers, so as not to send a chunk again
DOCUMENTS_PER_PART = 20_000  # of a recipes part, which one task numbers and one group's Merkle tree covers
SENT_BYTES = 8 << 20  # of chunks and keys that a task hands over at once

_MULTIPLIERS = None


def boundaries(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of an id stream."""
    global _MULTIPLIERS
    n = len(ids)
    if n <= LEAST:
        return [n]
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    total = np.cumsum(mixed, dtype=np.uint64)  # wraps; differences are sums of a window
    rolled = total.copy()
    rolled[WINDOW:] -= total[:-WINDOW]
    rolled *= np.uint64(0xBF58476D1CE4E5B9)
    cuts = np.flatnonzero((rolled >> np.uint64(40)) & np.uint64(MASK) == 0) + 1
    ends, last = [], 0
    for c in cuts.tolist():
        while c - last > MOST:
            last += MOST
            ends.append(last)
        if c - last >= LEAST and c < n:
            ends.append(c)
            last = c
    while n - last > MOST:
        last += MOST
        ends.append(last)
    ends.append(n)
    return ends


def merkle_root(leaves: list[bytes]) -> bytes:
    """Pairs are hashed level by level; an odd last one moves up."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves] or [hashlib.sha256(b"").digest()]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


ROWS = "bucket long, kind int, key binary, doc_id long, n int, crc long, keys binary, ids binary"


def packed(ids: np.ndarray) -> bytes:
    """``ids`` (32 bits) as they are stored: in 16 bits each if all fit."""
    return (ids if int(ids.max(initial=0)) >> 16 else ids.astype("<u2")).tobytes()


def unpacked(data: bytes, n: int) -> bytes:
    """The ``n`` stored ids in 32 bits each."""
    return data if n and len(data) // n == 4 else np.frombuffer(data, "<u2").astype("<u4").tobytes()


def _sections(docs: DataFrame, tokenizer: str, end_id: int) -> DataFrame:
    """Recipe rows (kind 1) and chunk rows (kind 0, at most one for each chunk and task while remembered)."""

    def batch_of(kind, bucket, key, doc_id, n, crc, keys, ids):
        rows = len(n)
        columns = (bucket, [kind] * rows, key or pa.nulls(rows), doc_id or pa.nulls(rows), n, crc or pa.nulls(rows), keys or pa.nulls(rows), ids or pa.nulls(rows))
        types = (pa.int64(), pa.int32(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([c.cast(t) if isinstance(c, pa.NullArray) else pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in ROWS.split(", ")])

    def sections(batches):
        words, end, sent, row = codec(tokenizer), end_id.to_bytes(4, "little"), set(), 0
        sha, number = hashlib.sha256, int.from_bytes
        for batch in batches:
            chunks, recipes, held = ([], [], [], []), ([], [], [], [], []), 0
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                wide = words.encode(text.as_py() or "") + end
                ids = np.frombuffer(wide, "<u4")
                keys, start = [], 0
                for stop in boundaries(ids):
                    key = sha(wide[4 * start : 4 * stop]).digest()
                    keys.append(key)
                    if key not in sent:
                        if len(sent) >= REMEMBERED:
                            sent.clear()
                        sent.add(key)
                        part = packed(ids[start:stop])
                        held += len(part)
                        chunks[0].append(number(key[:8], "little", signed=True))
                        chunks[1].append(key)
                        chunks[2].append(stop - start)
                        chunks[3].append(part)
                    start = stop
                crc, row = zlib.crc32(wide), row + 1
                recipes[0].append(number(sha(b"%d %d" % (crc, row)).digest()[:8], "little", signed=True))
                recipes[1].append(doc_id.as_py())
                recipes[2].append(len(ids))
                recipes[3].append(crc)
                recipes[4].append(b"".join(keys))
                held += 32 * len(keys)
                if held > SENT_BYTES:
                    yield batch_of(0, chunks[0], chunks[1], None, chunks[2], None, None, chunks[3])
                    yield batch_of(1, recipes[0], None, *recipes[1:], None)
                    chunks, recipes, held = ([], [], [], []), ([], [], [], [], []), 0
            yield batch_of(0, chunks[0], chunks[1], None, chunks[2], None, None, chunks[3])
            yield batch_of(1, recipes[0], None, *recipes[1:], None)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(sections, ROWS)


def _unique(rows: DataFrame) -> DataFrame:
    """Recipe rows, and of the chunk rows one for each key.  Rows are dealt by bucket, which a key decides."""
    place = F.row_number().over(Window.partitionBy("bucket", "key").orderBy("kind"))
    return rows.withColumn("_place", place).where("kind = 1 or _place = 1").drop("_place")


def _stored(spark: SparkSession, folder: str, kind: int) -> DataFrame:
    """The rows of one kind; none in an empty store, which has no folder for them."""
    return spark.read.schema(ROWS).parquet(f"{folder}/sections").where(F.col("kind") == kind)


def write_store(docs: DataFrame, folder: str, tokenizer: str, end_id: int) -> None:
    """Encode ``docs`` and write the store.  One shuffle carries the chunks to where they are stored."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    sent = _sections(docs, tokenizer, end_id).repartition(parts, F.col("bucket"))
    _unique(sent).write.partitionBy("kind").option("compression", "zstd").parquet(f"{folder}/sections")
    _write_recipes(spark, _stored(spark, folder, 1).select("doc_id", "n", "crc", "keys"), folder)


def _write_recipes(spark: SparkSession, recipes: DataFrame, folder: str) -> None:
    """Recipes ascending by doc_id (nulls first), with each document's start; then the manifest."""
    order = ("doc_id", "crc", "n")
    parts = groups_for(recipes.count(), DOCUMENTS_PER_PART)
    # kept once in order, so that counts and starts are taken from the same partitions
    ordered = cut_lineage(recipes.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn("part", F.spark_partition_id()))
    starts, total = {}, 0
    for r in ordered.groupBy("part").agg(F.sum("n").alias("n")).orderBy("part").collect():  # a row for each partition
        starts[r.part], total = total, total + r.n
    schema = "doc_id long, start long, n_tokens long, ids_crc32 long, keys binary, root binary, part int"
    names = [x.split()[0] for x in schema.split(", ")]

    def number(batches):
        at = None
        for batch in batches:
            if len(batch):
                n = batch.column(1).to_numpy().astype(np.int64)
                at = starts[batch.column(4)[0].as_py()] if at is None else at
                ends = at + np.cumsum(n)
                roots = [merkle_root(_leaves(k)) for k in batch.column(3).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ends - n), pa.array(n), batch.column(2), batch.column(3), pa.array(roots, pa.binary()), batch.column(4)], names=names)
                at = int(ends[-1])

    ordered.mapInArrow(number, schema).write.option("compression", "zstd").parquet(f"{folder}/recipes")

    def shard(group: pa.Table) -> pa.Table:
        group = group.sort_by("start")
        return pa.table({"part": group.column("part")[:1], "documents": pa.array([len(group)], pa.int64()), "root": pa.array([merkle_root(group.column("root").to_pylist())], pa.binary())})

    spark.read.schema(schema).parquet(f"{folder}/recipes").select("part", "start", "root").groupBy("part").applyInArrow(shard, "part int, documents long, root binary").write.parquet(f"{folder}/manifest")


def _leaves(keys: bytes) -> list[bytes]:
    return [keys[i : i + 32] for i in range(0, len(keys), 32)]


_SHIFTS: dict[int, np.ndarray] = {}


def _shift(n_bytes: int) -> np.ndarray:
    """The linear map that n zero bytes apply to a CRC: its value on each single bit."""
    if n_bytes not in _SHIFTS:
        zeros = b"\0" * n_bytes
        base = zlib.crc32(zeros)
        _SHIFTS[n_bytes] = np.array([zlib.crc32(zeros, 1 << k) ^ base for k in range(32)], np.uint32)
    return _SHIFTS[n_bytes]


def crc32_append(before: np.ndarray, after: np.ndarray, shifts: np.ndarray) -> np.ndarray:
    """CRC-32 of two byte strings in a row from those of each; ``shifts`` move a CRC past the second ones."""
    out = after.copy()
    for k in range(32):
        out ^= np.where(before >> np.uint32(k) & np.uint32(1), shifts[:, k], np.uint32(0))
    return out


def joined_crcs(rows: np.ndarray, n: np.ndarray, crcs: np.ndarray, total: int) -> np.ndarray:
    """Each of ``total`` documents' CRC-32 from those of its chunks of ``n`` ids, which stand in order by ``rows``, the documents' numbers.

    The k-th chunks of all documents are appended together.
    """
    sizes, which = np.unique(n, return_inverse=True)
    shifts = np.stack([_shift(4 * int(x)) for x in sizes]) if len(sizes) else np.zeros((0, 32), np.uint32)
    begins = np.searchsorted(rows, np.arange(total))
    counts = np.searchsorted(rows, np.arange(total), side="right") - begins
    out = np.zeros(total, np.uint32)
    out[counts > 0] = crcs[begins[counts > 0]]
    for k in range(1, int(counts.max(initial=0))):
        more = np.flatnonzero(counts > k)
        at = begins[more] + k
        out[more] = crc32_append(out[more], crcs[at], shifts[which[at]])
    return out


def read_store(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, verified) from the files alone.

    Every stored chunk is read, its key checked against its ids, and its count and CRC taken.  A document's
    count and CRC follow from its chunks in the order of its recipe; ``verified`` says that those and the
    Merkle root over the chunks' keys agree with the recipe, and its part of the recipes with the manifest.  A chunk
    that is missing or damaged leaves the documents that use it unverified, and a part that has lost
    or changed a document all of its documents; each document that a part has lost is an unverified row of nulls.
    """

    def read(batches):
        for batch in batches:
            good, crcs = [], []
            for key, n, ids in zip(*(c.to_pylist() for c in batch.columns)):
                wide = unpacked(ids, n)
                good.append(len(wide) == 4 * n and hashlib.sha256(wide).digest() == key)
                crcs.append(zlib.crc32(wide))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["key", "n", "crc"]).filter(pa.array(good, pa.bool_()))

    objects = _stored(spark, folder, 0).select("key", "n", "ids").mapInArrow(read, "key binary, n int, crc long")
    recipes = spark.read.parquet(f"{folder}/recipes")
    uses = recipes.select("start", F.expr("explode(transform(sequence(0, length(keys) div 32 - 1), i -> struct(i as pos, substring(keys, i * 32 + 1, 32) as key)))").alias("u")).select("start", "u.pos", "u.key")
    joined = uses.join(objects, "key", "left").groupBy("start").agg(F.collect_list(F.struct("pos", "n", "crc")).alias("parts"))

    def combine(batches):
        for batch in batches:
            parts = batch.column(1)
            flat, rows = parts.flatten(), np.repeat(np.arange(len(batch)), parts.value_lengths().to_numpy())
            pos, n, crcs = (flat.field(k) for k in range(3))
            lost = np.unique(rows[n.is_null().to_numpy(zero_copy_only=False)])
            n, crcs = n.fill_null(0).to_numpy().astype(np.int64), crcs.fill_null(0).to_numpy().astype(np.uint32)
            order = np.lexsort((pos.to_numpy(), rows))
            total = np.bincount(rows, n, len(batch)).astype(np.int64)
            whole = joined_crcs(rows[order], n[order], crcs[order], len(batch)).astype(np.int64)
            bad = np.isin(np.arange(len(batch)), lost)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(total, mask=bad), pa.array(whole, mask=bad)], names=["start", "read_n", "read_crc"])

    found = joined.mapInArrow(combine, "start long, read_n long, read_crc long")
    out = recipes.select("doc_id", "start", "n_tokens", "ids_crc32").join(found, "start", "left").join(_rooted(spark, folder), "start", "full")
    good = F.coalesce((F.col("read_n") == F.col("n_tokens")) & (F.col("read_crc") == F.col("ids_crc32")) & F.col("rooted"), F.lit(False))
    return out.select("doc_id", "start", F.col("read_n").alias("n_tokens"), F.col("read_crc").alias("ids_crc32"), good.alias("verified"))


def _rooted(spark: SparkSession, folder: str) -> DataFrame:
    """(start, rooted) of each document: whether its keys give its root and its part's roots give the manifest's; a null start for each document that a part lacks.

    Chunks are looked up by key and a key is the hash of the chunk's ids, so the keys of a recipe whose chunks are all read are the chunks' own.
    """

    def roots(batches):
        for batch in batches:
            own = [merkle_root(_leaves(k)) for k in batch.column(2).to_pylist()]
            same = [a == b for a, b in zip(own, batch.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(own, pa.binary()), pa.array(same, pa.bool_())], names=["part", "start", "root", "same"])

    def against(group: pa.Table, shard: pa.Table) -> pa.Table:
        group = group.sort_by("start")
        documents = shard.column("documents")[0].as_py() if len(shard) == 1 else None
        whole = documents == len(group) and shard.column("root")[0].as_py() == merkle_root(group.column("root").to_pylist())
        lost = max(0, (documents or 0) - len(group))
        start = group.column("start").to_pylist() + [None] * lost
        rooted = [whole and same for same in group.column("same").to_pylist()] + [False] * lost
        return pa.table({"start": pa.array(start, pa.int64()), "rooted": pa.array(rooted, pa.bool_())})

    recipes = spark.read.parquet(f"{folder}/recipes").select("part", "start", "keys", "root").mapInArrow(roots, "part int, start long, root binary, same boolean")
    manifest = spark.read.schema("part int, documents long, root binary").parquet(f"{folder}/manifest")
    return recipes.groupBy("part").cogroup(manifest.groupBy("part")).applyInArrow(against, "start long, rooted boolean")


def read_documents(spark: SparkSession, folder: str) -> DataFrame:
    """(doc_id, start, ids array<int>): whole documents put together from their chunks."""
    recipes = spark.read.parquet(f"{folder}/recipes")
    objects = _stored(spark, folder, 0).select("key", F.col("n").alias("size"), F.col("ids").alias("part"))
    uses = recipes.select("doc_id", "start", F.expr("explode(transform(sequence(0, length(keys) div 32 - 1), i -> struct(i as pos, substring(keys, i * 32 + 1, 32) as key)))").alias("u")).select("doc_id", "start", "u.pos", "u.key")
    parts = uses.join(objects, "key").groupBy("doc_id", "start").agg(F.array_sort(F.collect_list(F.struct("pos", "size", "part"))).alias("p"))

    def join(batches):
        for batch in batches:
            ids = [np.frombuffer(b"".join(unpacked(x["part"], x["size"]) for x in p), "<i4").tolist() for p in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int32()))], names=["doc_id", "start", "ids"])

    return parts.mapInArrow(join, "doc_id long, start long, ids array<int>")


def store_documents(docs: DataFrame, tokenizer: str, end_id: int, folder: str | None = None) -> DataFrame:
    """Write ``docs`` to a store (by default a new one in the shared folder) and read it back."""
    folder = folder or f"{shared_folder(docs.sparkSession)}/tokenstore-{uuid.uuid4().hex}"
    write_store(docs, folder, tokenizer, end_id)
    return read_store(docs.sparkSession, folder)
