"""Media columns: WAV payloads and spectral-peak fingerprints.

Bytes are stored as 8-bit mono samples by the wave module, written to the shared folder, and read back from there.  A short-time
Fourier transform gives the strongest peaks of each frame.  Each peak is an anchor: with the first FAN peaks in
its target zone (1 to REACH frames later, at most BAND bins up or down; the nearest in time first, then in frequency) it makes pairs, an array
of (time code of the anchor, hash of both bins and the frames between).  Equal payloads give equal fingerprints.

Null text is the empty text; its payload is one block of 64 bytes 0, which is below the middle of the samples, and so has
peaks of the window's edge alone.  Repeated rows and ids are media of their own.  Very long texts are one WAV each (up to the 4 GB of the format, which is more than
a Spark string holds).  Equally strong peaks: the lower bin first.  An empty table gives no rows.  Columns other than doc_id and text are not read.
"""

from __future__ import annotations

import hashlib
import io
import uuid
import wave
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.common import SLICE_BYTES, shared_folder

RATE = 8000
FRAME, HOP = 512, 256
PEAKS = 3  # of a frame
FAN, REACH, BAND = 5, 8, 64  # pairs of an anchor; its target zone in frames and bins
BLOCK = 64

FINGERPRINT = "array<struct<t:int,hash:int>>"


def to_wav(payload: bytes) -> bytes:
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(1)
        w.setframerate(RATE)
        w.writeframes(payload)
    return out.getvalue()


def from_wav(media: bytes) -> bytes:
    with wave.open(io.BytesIO(media), "rb") as r:
        return r.readframes(r.getnframes())


def peaks(payloads: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(payload, frame, frequency bin) of the strongest local maxima of each frame, by payload, frame and bin."""
    frames = np.array([-(-len(p) // HOP) for p in payloads])
    lengths = (frames - 1) * HOP + FRAME
    begins = np.cumsum(lengths) - lengths
    signal = np.full(int(lengths.sum()), 128, np.uint8)
    for at, p in zip(begins.tolist(), payloads):
        signal[at : at + len(p)] = np.frombuffer(p, np.uint8)
    own = np.repeat(np.arange(len(payloads)), frames)
    number = np.arange(len(own)) - np.repeat(np.cumsum(frames) - frames, frames)
    starts = begins[own] + number * HOP
    window = np.hanning(FRAME).astype(np.float32)
    out = []
    for at in range(0, len(own), 512):
        part = (signal[starts[at : at + 512, None] + np.arange(FRAME)].astype(np.float32) - 128) * window
        power = np.abs(np.fft.rfft(part, axis=1)).astype(np.float32)
        top = (power[:, 1:-1] > power[:, :-2]) & (power[:, 1:-1] >= power[:, 2:])
        # whole numbers, so that rounding of the last bits decides nothing
        score = np.where(top, np.floor(power[:, 1:-1]), -1).astype(np.int64)
        best = np.argpartition(-(score * FRAME - np.arange(score.shape[1])), PEAKS - 1, axis=1)[:, :PEAKS]
        best.sort(axis=1)
        rows = np.repeat(np.arange(len(part)), PEAKS)
        good = score[rows, best.ravel()] > 0
        out.append((own[at + rows[good]], number[at + rows[good]], best.ravel()[good] + 1))
    return tuple(np.concatenate(c) for c in zip(*out))


def fingerprints(payloads: list[bytes]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(time codes, hashes) of each payload, by time code and hash: hash = anchor's bin << 18 | target's bin << 8 | frames between."""
    if not payloads:
        return []
    own, t, f = peaks(payloads)
    # one time line with a gap of more than REACH between payloads, so that no zone reaches the next payload
    line = np.cumsum([-(-len(p) // HOP) + REACH + 1 for p in payloads])
    when = t + np.concatenate([[0], line[:-1]])[own]
    anchors, targets = [], []
    for step in range(1, PEAKS * (REACH + 1)):
        gap = when[step:] - when[:-step]
        zone = np.flatnonzero((gap >= 1) & (gap <= REACH) & (np.abs(f[step:] - f[:-step]) <= BAND))
        anchors.append(zone)
        targets.append(zone + step)
    anchor, target = np.concatenate(anchors), np.concatenate(targets)
    order = np.lexsort((f[target], np.abs(f[target] - f[anchor]), when[target], anchor))
    anchor, target = anchor[order], target[order]
    first = np.searchsorted(anchor, anchor)  # where the anchor's pairs begin
    near = np.arange(len(anchor)) - first < FAN
    anchor, target = anchor[near], target[near]
    value = (f[anchor] << 18) | (f[target] << 8) | (when[target] - when[anchor])
    order = np.lexsort((value, t[anchor], own[anchor]))
    anchor, value = anchor[order], value[order]
    ends = np.searchsorted(own[anchor], np.arange(len(payloads) + 1))
    code = t[anchor].astype("<i4")
    value = value.astype("<i4")
    return [(code[a:b], value[a:b]) for a, b in zip(ends, ends[1:])]


def fingerprint(payload: bytes) -> tuple[np.ndarray, np.ndarray]:
    return fingerprints([payload])[0]


def _runs(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """The batch in parts of bounded bytes, however long the values, with the column's values; null is empty."""
    values, at, held = [], 0, 0
    for k, x in enumerate(batch.column(column)):
        values.append(x.as_py() or b"")
        held += len(values[-1])
        if held >= SLICE_BYTES or k + 1 == len(batch):
            yield batch.slice(at, len(values)), values
            values, at, held = [], k + 1, 0


def text_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text's UTF-8, padded with bytes 0 to a positive multiple of 64, as WAV."""

    def store(batches):
        for batch in batches:
            for part, raw in _runs(batch, 1):
                media = [to_wav(x.ljust(max(BLOCK, -(-len(x) // BLOCK) * BLOCK), b"\0")) for x in raw]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in raw], pa.int64()), pa.array(media, pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").cast("binary").alias("text")).mapInArrow(store, "doc_id long, n_bytes long, media binary")


def store_media(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """``text_media`` written to ``folder`` (by default a new one in the shared folder) and read from there."""
    spark = docs.sparkSession
    folder = folder or f"{shared_folder(spark)}/media-{uuid.uuid4().hex}"
    text_media(docs).write.option("compression", "zstd").option("parquet.block.size", 16 << 20).parquet(folder)
    return spark.read.schema("doc_id long, n_bytes long, media binary").parquet(folder)


def _pairs_array(found: list[tuple[np.ndarray, np.ndarray]]) -> pa.Array:
    ends = np.cumsum([0] + [len(c) for c, _ in found])
    flat = [np.concatenate([x[k] for x in found]) if found else np.zeros(0) for k in (0, 1)]
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(x, pa.int32()) for x in flat], names=["t", "hash"]))


def media_fingerprints(media: DataFrame) -> DataFrame:
    """(doc_id, fingerprint) of WAV columns."""

    def read(batches):
        for batch in batches:
            for part, stored in _runs(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), _pairs_array(fingerprints([from_wav(m) for m in stored]))], names=["doc_id", "fingerprint"])

    return media.select("doc_id", "media").mapInArrow(read, f"doc_id long, fingerprint {FINGERPRINT}")


def media_digests(media: DataFrame) -> DataFrame:
    """What op10 returns, all from the stored bytes as the wave module reads them; ``feature`` is the digest of ``fingerprint``."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", "fingerprint"]
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string())

    def digest(batches):
        for batch in batches:
            for part, stored in _runs(batch, 2):
                payloads = [from_wav(m) for m in stored]
                found = fingerprints(payloads)
                rows = [(len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-BLOCK:]), len(m), hashlib.sha256(m).hexdigest(), hashlib.sha256(c.tobytes() + h.tobytes()).hexdigest()) for p, m, (c, h) in zip(payloads, stored, found)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), *(pa.array(c, k) for c, k in zip(zip(*rows), kinds)), _pairs_array(found)], names=names)

    return media.select("doc_id", "n_bytes", "media").mapInArrow(digest, f"doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, fingerprint {FINGERPRINT}")
