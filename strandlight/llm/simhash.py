"""SimHash near-duplicates by the generalised pigeonhole principle.

Fingerprints are 64-bit majorities over the XXH64 hashes of word shingles.  Two that differ in at most r
bits must, for any split of the bits into parts with thresholds t_i where sum(t_i + 1) = r + 1, differ in at most
t_i bits in some part (a threshold of -1 leaves a part out).  Bits that correlate are grouped; the
thresholds are chosen by dynamic programming over candidate counts estimated on a bounded sample of
fingerprints; every fingerprint is then probed, and every candidate pair is verified.

A bucket with more than HOT fingerprints is not paired.  Its fingerprints are linked exactly in linear
work instead: two fingerprints are within two bits of each other if and only if some value lies within one bit of
both, so each is sent to the 65 values within one bit, and all that meet at a value are linked.

That linear way is exact for a radius of two bits and no other; a larger radius raises an error where a bucket is full.

Null text counts as empty.  Texts without words have fingerprint 0 and link like any other.  Rows with equal
fingerprints are linked, whatever their number.  A null doc_id never becomes a group's name
unless it is alone in it.  Very long texts are read whole.  An empty table gives no rows.  Columns other than doc_id and text are
not read, and those of ``keep_first`` stay as they are whatever their names.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import connected_components, cut_lineage

RADIUS = 2
SHINGLE = 3
SEED = 42
SAMPLE = 4000  # fingerprints that the plan is estimated on
HOT = 64
BITS = 64

_SPREAD = None


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """For each run of ``hashes`` up to ``ends``: the bits that more than half of the run have set; an empty run gives 0."""
    global _SPREAD
    if _SPREAD is None:  # byte -> its bits, one in each byte of a word
        _SPREAD = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").reshape(256, 8).copy().view(np.uint64).ravel()
    out = np.zeros(len(ends), np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    start = 0
    for d, end in enumerate(ends.tolist()):
        n = end - start
        if n:
            counts = np.zeros(64, np.int64)
            spread = _SPREAD[hashes[start:end].view(np.uint8).reshape(n, 8)]
            for at in range(0, n, 255):  # a byte counts up to 255
                counts += spread[at : at + 255].sum(axis=0, dtype=np.uint64).view(np.uint8).astype(np.int64)
            out[d] = weights[counts * 2 > n].sum(dtype=np.uint64)
        start = end
    return out


def shingle_hashes(text: str) -> np.ndarray:
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(words, words[1:], words[2:]))
    return np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), np.uint64, max(1, len(words) - SHINGLE + 1))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, fp), one row for each row of ``docs``."""

    def fingerprint(batches):
        for batch in batches:
            fps = []
            for text in batch.column(1):
                hashes = shingle_hashes(text.as_py() or "")
                fps.append(majority(hashes, np.array([len(hashes)]))[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.array(fps, np.uint64).view(np.int64))], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(fingerprint, "doc_id long, fp long")


def correlated_parts(bits: np.ndarray, parts: int) -> list[list[int]]:
    """Bit positions in ``parts`` groups of near-equal size; each group grows by the bit that correlates most with it."""
    centred = bits - bits.mean(axis=0)
    deviation = centred.std(axis=0) + 1e-9
    correlation = np.abs(centred.T @ centred / len(bits) / np.outer(deviation, deviation))
    free, out = set(range(BITS)), []
    for k in range(parts):
        size = BITS // parts + (k < BITS % parts)
        own = [min(free, key=lambda b: (abs(bits[:, b].mean() - 0.5), b))]
        free.discard(own[0])
        while len(own) < size:
            nxt = max(free, key=lambda b: (correlation[b, own].sum(), -b))
            own.append(nxt)
            free.discard(nxt)
        out.append(sorted(own))
    return out


def allocate(costs: list[list[float]], budget: int) -> tuple[float, list[int]]:
    """Thresholds of least total cost with sum(t + 1) = budget; ``costs[i][t + 1]`` is that of threshold t in part i."""
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for own in costs:
        step: dict[int, tuple[float, list[int]]] = {}
        for spent, (cost, chosen) in best.items():
            for give in range(min(len(own) - 1, budget - spent) + 1):
                new = cost + own[give]
                if spent + give not in step or new < step[spent + give][0]:
                    step[spent + give] = new, [*chosen, give - 1]
        best = step
    return best[budget]


def plan(sample: np.ndarray, n: int, radius: int = RADIUS) -> list[tuple[list[int], int]]:
    """(bits, threshold) of each part in use, for ``n`` fingerprints like the sample."""
    if len(sample) < 2:
        sample = np.arange(16, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    bits = ((sample[:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1)).astype(np.float32)
    # distances of all pairs of (some of) the sample, part by part
    some = bits[:1500]
    pairs = n * (n - 1) / 2
    best = None
    for parts in range(1, radius + 3):
        groups = correlated_parts(bits, parts)
        costs = []
        for group in groups:
            own = some[:, group]
            # fingerprints in full buckets take the linear way, so they count by number and not in pairs
            _, bucket, count = np.unique(np.packbits(own.astype(np.uint8), axis=1), axis=0, return_inverse=True, return_counts=True)
            full = (count >= 3) & (count * n / len(own) > HOT)
            hot = float(full[bucket.ravel()].mean())
            own = own[~full[bucket.ravel()]]
            ones = own.sum(axis=1)
            distance = ones[:, None] + ones[None, :] - 2 * (own @ own.T)
            distance = distance[np.triu_indices(len(own), 1)]
            row, ball = [0.0], 0
            for t in range(radius + 1):
                ball += 1 if t == 0 else (len(group) if t == 1 else len(group) * (len(group) - 1) // 2)
                # at least what independent bits would give, since a sample shows no rare meeting
                share = max(float((distance <= t).mean()) * (1 - hot) ** 2 if len(distance) else 0.0, ball / 2.0 ** len(group))
                row.append(pairs * share + n * (1 + ball) + n * hot * (BITS + 1))
            costs.append(row)
        cost, chosen = allocate(costs, radius + 1)
        if best is None or cost < best[0]:
            best = cost, [(g, t) for g, t in zip(groups, chosen) if t >= 0]
    return best[1]


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _keyed(part: int, own: Column):
    return lambda flip: F.struct(F.lit(part).alias("part"), own.bitwiseXOR(flip).alias("key"))


def _keys(fp: Column, parts: list[tuple[list[int], int]], probe: bool) -> Column:
    """Array of (part, key).  A probe visits all keys within a part's threshold of its own."""
    out = []
    for k, (bits, t) in enumerate(parts):
        mask = _signed(sum(1 << b for b in bits))
        own = fp.bitwiseAND(F.lit(mask))
        flips = [0]
        if probe and t >= 1:
            flips += [1 << b for b in bits]
        if probe and t >= 2:
            flips += [(1 << a) | (1 << b) for i, a in enumerate(bits) for b in bits[i + 1 :]]
        flipped = F.array(*[F.lit(_signed(x)) for x in flips])
        out.append(F.transform(flipped, _keyed(k, own)))
    return F.concat(*out) if len(out) > 1 else out[0]


def links(distinct: DataFrame, parts: list[tuple[list[int], int]], radius: int = RADIUS, hot: int = HOT) -> DataFrame:
    """Edges (a, b) between fingerprints ``distinct(fp)`` that connect exactly those within ``radius`` bits (2 at most)."""
    index = distinct.select("fp", F.explode(_keys(F.col("fp"), parts, False)).alias("k")).select("fp", "k.part", "k.key")
    wide = any(t > 0 for _, t in parts)
    probe = distinct.select("fp", F.explode(_keys(F.col("fp"), parts, True)).alias("k")).select("fp", "k.part", "k.key") if wide else index
    size = distinct.count()
    full = cut_lineage(index.groupBy("part", "key").agg(F.count(F.lit(1)).alias("c")).where(F.col("c") > hot).select("part", "key"), size * len(parts) // hot)
    many = size > hot and full.limit(1).count() > 0
    cold_index, cold_probe = index, probe
    if many:
        cold_index, cold_probe = index.join(full, ["part", "key"], "left_anti"), probe.join(full, ["part", "key"], "left_anti")
    a, b = cold_index.alias("a"), cold_probe.alias("b")
    pairs = a.join(b, (F.col("a.part") == F.col("b.part")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.fp") < F.col("b.fp")))
    pairs = pairs.where(F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= radius).select(F.col("a.fp").alias("a"), F.col("b.fp").alias("b"))
    if not many:
        return pairs
    if radius > 2:
        raise ValueError("the exact way for full buckets covers two bits")
    members = probe.join(full, ["part", "key"], "left_semi").select("fp").distinct()
    around = members.select("fp", F.explode(F.transform(F.array(*[F.lit(_signed(x)) for x in [0, *(1 << b for b in range(BITS))]]), lambda x: F.col("fp").bitwiseXOR(x))).alias("value"))
    meeting = around.groupBy("value").agg(F.min("fp").alias("low"), F.count(F.lit(1)).alias("c")).where("c > 1").select("value", "low")
    stars = around.join(meeting, "value").where("fp != low").select(F.col("low").alias("a"), F.col("fp").alias("b"))
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fp, component_id) for every row of ``docs``."""
    return _grouped(docs, radius).select("doc_id", "fp", "component_id")


def _grouped(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``near_duplicates`` with ``root``: groups that share their smallest doc_id share a component_id, but no root."""
    found = cut_lineage(fingerprints(docs))
    distinct = cut_lineage(found.groupBy("fp").agg(F.min("doc_id").alias("first")), found.count())
    n = distinct.count()
    sample = distinct.select("fp").orderBy(F.xxhash64("fp")).limit(SAMPLE).toPandas()["fp"].to_numpy(dtype=np.int64).view(np.uint64)
    parts = plan(sample, n, radius)
    components = connected_components(links(distinct.select("fp"), parts, radius))
    named = distinct.join(components, distinct.fp == components.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    names = named.join(lowest, "root").select("fp", "root", "component_id")
    return found.join(names, "fp").select("doc_id", "fp", "root", "component_id")


def _fingerprinted(docs: DataFrame, column: str) -> DataFrame:
    """``docs`` with each row's fingerprint."""
    from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf

    def fingerprint(batches):
        for texts in batches:
            hashes = [shingle_hashes(text.as_py() or "") for text in texts]
            yield pa.array(np.array([majority(h, np.array([len(h)]))[0] for h in hashes], np.uint64).view(np.int64))

    return docs.withColumn(column, arrow_udf(fingerprint, "long", ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string")))


def keep_first(docs: DataFrame, repeats: bool = False) -> DataFrame:
    """One document of each group: the one of the smallest doc_id.  Rows with a null doc_id stay; of repeated rows with that id one stays.

    With ``repeats``, rows that repeat a doc_id count as documents of their own: one row of each group stays, whatever ids groups share.
    What goes is found on ids alone; texts move only as far as Spark's joins with those ids need.
    """
    groups = cut_lineage(_grouped(docs).where("doc_id is not null"))
    first = F.col("doc_id") == F.col("component_id")
    ids = groups.groupBy(F.col("doc_id").alias("__simhash_id")).agg(F.count(F.lit(1)).alias("n"), (F.bool_or(first) if repeats else F.bool_and(first)).alias("stays"))
    ids = cut_lineage(ids.where("n > 1 or not stays"), groups.count())
    gone, repeated = ids.where("not stays").select("__simhash_id"), ids.where("n > 1").select("__simhash_id")
    own = docs["doc_id"].cast("long") == F.col("__simhash_id")
    kept = docs.join(gone, own, "left_anti")
    if not repeated.limit(1).count():
        return kept
    single, several = kept.join(repeated, own, "left_anti"), kept.join(repeated, own, "left_semi")
    if not repeats:
        return single.unionByName(several.dropDuplicates(["doc_id"]))
    chosen = groups.where(first).groupBy("root").agg(F.min(F.struct("doc_id", "fp")).alias("s")).select(F.col("s.doc_id").alias("__simhash_id"), F.col("s.fp").alias("__simhash_value"))
    chosen = chosen.join(repeated, "__simhash_id", "left_semi")
    several = _fingerprinted(several, "__simhash_fp").join(chosen, own & (F.col("__simhash_fp") == F.col("__simhash_value")), "left_semi")
    return single.unionByName(several.withColumn("__simhash_key", F.col("doc_id").cast("long")).dropDuplicates(["__simhash_key", "__simhash_fp"]).select(*docs.columns))
