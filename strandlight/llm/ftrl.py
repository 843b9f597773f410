"""Logistic regression over hashed word n-grams, trained by follow-the-regularised-leader (proximal).

Each coordinate has its own learning rate, and L1 leaves most weights at zero, so that a model is a
few thousand (index, weight) pairs: small enough to broadcast whatever the corpus.
"""

from __future__ import annotations

import re
from array import array
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import slices

BITS = 20
SAMPLE_ROWS = 20_000  # labelled rows that a model is fitted on at most
SAMPLE_FEATURES = 40_000_000  # features of those rows, each counted once a row; with it the trainer's memory is bounded
MEMO_BYTES = 32 << 20  # of the words that a worker remembers the hashes of
EPOCHS = 3

_INNER = re.compile(r"[^\W_]")


@dataclass(frozen=True)
class View:
    """How words become features: ``grams`` are (first word's distance, ..., 0) of each n-gram, over the
    normalised words; ``shape_grams`` likewise over their shapes (case, digits, outer punctuation)."""

    grams: tuple = ((0,), (1, 0))
    shape_grams: tuple = ()
    repeats: bool = False
    presence: bool = True


def _bare(word: str) -> tuple[int, int]:
    """Where the word begins and ends without outer punctuation; (0, 0) if nothing else is in it."""
    first = _INNER.search(word)
    return (first.start(), len(word) - _INNER.search(word[::-1]).start()) if first else (0, 0)


def core_of(word: str) -> str:
    a, b = _bare(word)
    return word[a:b].lower() or word


def shape_of(word: str) -> str:
    """Outer punctuation as it stands, a run of letters as its case class, digits as 0."""
    a, b = _bare(word)
    bare = word[a:b]
    if not bare:
        return word
    if bare.isdigit():
        kind = "0"
    elif any(c.isdigit() for c in bare):
        kind = "x0"
    elif bare.islower():
        kind = "x"
    elif bare.isupper():
        kind = "X" if len(bare) > 1 else "Y"
    else:
        kind = "Xx" if bare[1:].islower() else "xX"
    return word[:a] + kind + word[b:]


class Featurizer:
    """Hashed features of texts; a memo bounded by its bytes keeps words' hashes."""

    def __init__(self, view: View, bits: int = BITS, max_bytes: int = MEMO_BYTES):
        self.view, self.bits, self.max_bytes, self.held = view, bits, max_bytes, 0
        self.core: dict[str, int] = {}
        self.shape: dict[str, int] = {}

    def _learn(self, words: set[str]) -> None:
        """Put words into the memo; it is emptied first if it is full."""
        if self.held > self.max_bytes:
            self.core.clear()
            self.shape.clear()
            self.held = 0
        shapes = bool(self.view.shape_grams)
        for w in words.difference(self.core):
            self.core[w] = xxhash.xxh64_intdigest(core_of(w), 1)
            if shapes:
                self.shape[w] = xxhash.xxh64_intdigest(shape_of(w), 2)
            self.held += len(w) + 200 + 120 * shapes

    def __call__(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, feature) of each occurrence, and each document's number of words."""
        core, shape, sizes = array("Q"), array("Q"), np.zeros(len(texts), np.int64)
        both = self.view.shape_grams
        for d, text in enumerate(texts):
            words = text.split()
            sizes[d] = len(words)
            own = set(words)
            if own.difference(self.core):
                self._learn(own)
            core.extend(map(self.core.__getitem__, words))
            if both:
                shape.extend(map(self.shape.__getitem__, words))
        docs = np.repeat(np.arange(len(texts)), sizes)
        core = np.frombuffer(core, np.uint64)
        shape = np.frombuffer(shape, np.uint64)
        out_d, out_f = [], []
        for salt, (stream, grams) in enumerate(((core, self.view.grams), (shape, self.view.shape_grams))):
            for k, offsets in enumerate(grams):
                reach = offsets[0]
                n = len(stream) - reach
                if n <= 0:
                    continue
                mixed = np.full(n, np.uint64(0x9E3779B97F4A7C15 * (1 + k + 16 * salt) & (2**64 - 1)))
                for o in offsets:
                    mixed = (mixed ^ stream[reach - o : reach - o + n]) * np.uint64(0xBF58476D1CE4E5B9)
                    mixed ^= mixed >> np.uint64(31)
                same = docs[reach:] == docs[:n]
                out_d.append(docs[reach:][same])
                out_f.append((mixed[same] >> np.uint64(64 - self.bits)).astype(np.int64))
        if self.view.repeats and len(core) > 1:
            again = (core[1:] == core[:-1]) & (docs[1:] == docs[:-1])
            out_d.append(docs[1:][again])
            out_f.append(np.full(int(again.sum()), 7, np.int64))
        if not out_d:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), sizes
        return np.concatenate(out_d), np.concatenate(out_f), sizes


Row = tuple[np.ndarray, np.ndarray | None]  # features, and their values unless all are 1


@dataclass
class Model:
    """Sparse weights, bias and view.  Without a row of each label the score is ``constant``."""

    index: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = 0.0
    view: View = View()
    bits: int = BITS
    constant: float | None = None

    def dense(self) -> np.ndarray:
        held = getattr(self, "_dense", None)
        if held is None:
            held = self._dense = np.zeros(1 << self.bits)
            held[self.index] = self.weight
        return held

    def score(self, texts: list[str], features: Featurizer) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        docs, found, sizes = features(texts)
        w = self.dense()[found]
        used = w != 0
        docs, found, w = docs[used], found[used], w[used]
        if self.view.presence:
            _, first = np.unique(docs << self.bits | found, return_index=True)
            total = np.bincount(docs[first], w[first], len(texts))
        else:
            total = np.bincount(docs, w, len(texts)) / np.maximum(sizes, 1)
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))

    def score_rows(self, rows: list[Row]) -> np.ndarray:
        dense = self.dense()
        total = np.array([dense[idx].sum() if x is None else dense[idx] @ x for idx, x in rows])
        return 1 / (1 + np.exp(-np.clip(total + self.bias, -35, 35)))


def rows_of(texts: list[str], features: Featurizer) -> list[Row]:
    """Each text's features, ascending, each once; with their share of the words unless only presence counts."""
    bits = features.bits
    docs, found, sizes = features(texts)
    keys, count = np.unique(docs << bits | found, return_counts=True)
    ends = np.searchsorted(keys >> bits, np.arange(len(texts) + 1))
    low = (keys & ((1 << bits) - 1)).astype(np.int32)
    runs = [slice(a, b) for a, b in zip(ends, ends[1:])]
    return [(low[r], None if features.view.presence else (count[r] / max(1, n)).astype(np.float32)) for r, n in zip(runs, sizes.tolist())]


def train(rows: list[Row], labels: np.ndarray, view: View, alpha: float, l1: float, l2: float, beta: float = 1.0, bits: int = BITS, epochs: int = EPOCHS, constant: float = 0.5, least_documents: int = 3) -> Model:
    """FTRL-proximal over the rows in the order given, ``epochs`` times.  Features of fewer than
    ``least_documents`` training rows are left out: they cannot be told from chance."""
    if len(set(labels.tolist())) < 2:
        return Model(view=view, bits=bits, constant=constant if not len(labels) else float(labels[0]))
    seen = np.zeros(1 << bits, np.int32)
    for idx, _ in rows:
        seen[idx] += 1
    known = seen >= least_documents
    rows = [(idx[k], None if x is None else x[k]) for idx, x in rows for k in (known[idx],)]
    z, n = np.zeros(1 << bits), np.zeros(1 << bits)
    zb = nb = 0.0
    for _ in range(epochs):
        for (idx, x), y in zip(rows, labels.tolist()):
            zi, ni = z[idx], n[idx]
            root = np.sqrt(ni)
            w = np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((beta + root) / alpha + l2))
            wb = -zb / ((beta + nb**0.5) / alpha)
            total = wb + (w.sum() if x is None else w @ x)
            p = 1 / (1 + np.exp(-min(35, max(-35, total))))
            g = (p - y) * (1.0 if x is None else x)
            new = ni + g * g
            z[idx] = zi + g - (np.sqrt(new) - root) / alpha * w
            n[idx] = new
            gb = p - y
            zb += gb - ((nb + gb * gb) ** 0.5 - nb**0.5) / alpha * wb
            nb += gb * gb
    keep = np.flatnonzero(np.abs(z) > l1)
    weight = (np.sign(z[keep]) * l1 - z[keep]) / ((beta + np.sqrt(n[keep])) / alpha + l2)
    return Model(keep, weight, float(-zb / ((beta + nb**0.5) / alpha)), view, bits)


def calibrated(model: Model, rows: list[Row], labels: np.ndarray) -> Model:
    """The model with its log-odds mapped to ``a * odds + b``, fitted by Newton's method on rows that it was not trained on."""
    if model.constant is not None or len(set(labels.tolist())) < 2:
        return model
    p = np.clip(model.score_rows(rows), 1e-15, 1 - 1e-15)
    x = np.stack([np.log(p / (1 - p)), np.ones(len(p))], 1)
    theta, prior, ridge = np.array([1.0, 0.0]), np.array([1.0, 0.0]), np.diag([1.0, 0.1])
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(x @ theta, -35, 35)))
        gradient = x.T @ (q - labels) + ridge @ (theta - prior)
        step = np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + ridge, gradient)
        theta = theta - np.clip(step, -1, 1)
        theta[0] = max(theta[0], 0.1)
    return Model(model.index, model.weight * theta[0], float(model.bias * theta[0] + theta[1]), model.view, model.bits)


def remainder(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5.  0 is the held-out fold."""
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5))


def fit(docs: DataFrame, labels: DataFrame, label: str, view: View, sample_rows: int = SAMPLE_ROWS, calibrate: bool = False, sample_features: int = SAMPLE_FEATURES, **settings) -> Model:
    """Fit on at most ``sample_rows`` labelled documents outside the held-out fold, those of the smallest id hashes.

    Labels that are null are ignored, of repeated ones the larger counts.  All executors turn texts into
    features; one task trains on those, whose memory ``sample_rows`` and ``sample_features`` bound: rows
    after the one that reaches the latter are left out.  The sample's ids are broadcast.  With ``calibrate``, each fifth row
    of the sample is kept from training and the scores are calibrated on those.
    """
    bits = settings.get("bits", BITS)
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & (remainder(F.col("doc_id")) != 0))
    known = known.groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max(F.col(label).cast("int")).alias("_y"))
    sample = known.orderBy(F.xxhash64("_id"), "_id").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("_text"))
    texts = texts.join(F.broadcast(sample), "_id").select("_id", "_y", F.xxhash64("_text").alias("_key"), "_text")
    names = ["turn", "key", "y", "features", "parts"]

    def featurise(batches):
        features = Featurizer(view, bits)
        for batch in batches:
            at = 0
            for own in slices(batch.column(3)):
                found = rows_of(own, features)
                part = batch.slice(at, len(own))
                at += len(own)
                # the unsigned order of the hashes, as signed numbers
                turns = [xxhash.xxh64_intdigest(str(i)) - (1 << 63) for i in part.column(0).to_pylist()]
                columns = [pa.array(turns, pa.int64()), part.column(2), part.column(1), pa.array([r[0].tobytes() for r in found], pa.binary()), pa.array([None if r[1] is None else r[1].tobytes() for r in found], pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, names=names)

    def learn(batches):
        rows, y, held = [], [], 0
        for batch in batches:
            for label_of, idx, parts in zip(*(batch.column(c) for c in (2, 3, 4))):
                if held < sample_features and len(rows) < sample_rows:
                    rows.append((np.frombuffer(idx.as_py(), np.int32), None if parts.as_py() is None else np.frombuffer(parts.as_py(), np.float32)))
                    y.append(label_of.as_py())
                    held += len(rows[-1][0])
        y = np.array(y, np.int64)
        kept = np.arange(len(rows)) % 5 == 0 if calibrate else np.zeros(len(rows), bool)
        rest, rest_y = [r for r, k in zip(rows, kept) if k], y[kept]
        m = train([r for r, k in zip(rows, kept) if not k], y[~kept], view, **settings)
        if calibrate:
            m = calibrated(m, rest, rest_y)
        index = np.append(m.index, -1 if m.constant is None else -2)
        weight = np.append(m.weight, m.bias if m.constant is None else m.constant)
        yield pa.RecordBatch.from_arrays([pa.array(index, pa.int64()), pa.array(weight, pa.float64())], names=["index", "weight"])

    rows = texts.mapInArrow(featurise, "turn long, key long, y int, features binary, parts binary")
    got = rows.repartition(1).sortWithinPartitions("turn", "key", "y").mapInArrow(learn, "index long, weight double").toPandas()
    if not len(got):  # not a labelled row, and so not a task
        return Model(view=view, bits=bits, constant=settings.get("constant", 0.5))
    last = got[got["index"] < 0].iloc[0]
    got = got[got["index"] >= 0]
    return Model(got["index"].to_numpy(), got["weight"].to_numpy(), float(last["weight"]), view, bits, float(last["weight"]) if last["index"] == -2 else None)


def scored(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with the model's score of the whole text in one more column; null text scores as the empty text."""
    from pyspark.sql.pandas.functions import ArrowUDFType, arrow_udf

    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches):
        m = held.value
        features = Featurizer(m.view, m.bits)
        for texts in batches:
            out = [m.score(own, features) for own in slices(texts)]
            yield pa.array(np.concatenate(out) if out else np.zeros(0), pa.float64())

    return docs.withColumn(column, arrow_udf(score, "double", ArrowUDFType.SCALAR_ITER)(F.col("text").cast("string")))
