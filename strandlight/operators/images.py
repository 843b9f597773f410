"""Metrics, hashes and histograms of frames that come as pixel arrays.

A frame is a row (file_id, time_s, height, width, pixels): 8-bit RGB, row by row.  A file's frames are read in order as a stream that
remembers one frame, so no file has to fit in memory.  A frame whose pixels are null or not of its size has null metrics, and is
passed over by the differences.  Of frames at one time any order may be taken.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

HASH_SIDE, BINS = 8, 8

#: Weights of red, green and blue in luminance, in 15 bits.
LUMINANCE, SHIFT = (9798, 19235, 3735), 15


def gray(frame: np.ndarray) -> np.ndarray:
    """Luminance of an RGB frame, in whole levels."""
    return ((frame.astype(np.int64) @ np.array(LUMINANCE) + (1 << SHIFT - 1)) >> SHIFT).astype(np.int64)


def center(frame: np.ndarray, fraction: float) -> np.ndarray:
    """The middle ``fraction`` of height and width."""
    if fraction >= 1:
        return frame
    kept = [max(1, round(n * fraction)) for n in frame.shape[:2]]
    top, left = ((n - k) // 2 for n, k in zip(frame.shape, kept))
    return frame[top : top + kept[0], left : left + kept[1]]


def sharpness(levels: np.ndarray) -> float:
    """Variance of each pixel's four neighbours less four times itself; beyond an edge the picture is mirrored without the edge."""
    around = np.pad(levels, 1, mode="reflect" if min(levels.shape) > 1 else "edge")
    return float((around[:-2, 1:-1] + around[2:, 1:-1] + around[1:-1, :-2] + around[1:-1, 2:] - 4 * levels).var())


def colorfulness(frame: np.ndarray) -> float:
    red, green, blue = np.moveaxis(frame.astype(float), 2, 0)
    pair = np.stack([red - green, (red + green) / 2 - blue]).reshape(2, -1)
    return float((np.sqrt(pair.var(axis=1).sum()) + 0.3 * np.sqrt((pair.mean(axis=1) ** 2).sum())) / 255)


def hsv(frame: np.ndarray) -> np.ndarray:
    """Hue in 180 steps, saturation and value in 255, in whole numbers rounded by 12-bit reciprocals."""
    rgb = frame.astype(np.int64)
    red, green, blue = np.moveaxis(rgb, 2, 0)
    value, spread = rgb.max(axis=2), np.ptp(rgb, axis=2)
    level = np.arange(1, 256)
    by_value = np.concatenate([[0], np.rint((255 << 12) / level)]).astype(np.int64)
    by_spread = np.concatenate([[0], np.rint((180 << 12) / (6.0 * level))]).astype(np.int64)
    turned = np.where(value == red, green - blue, np.where(value == green, blue - red + 2 * spread, red - green + 4 * spread))
    hue = (turned * by_spread[spread] + (1 << 11)) >> 12
    return np.stack([np.where(hue < 0, hue + 180, hue), (spread * by_value[value] + (1 << 11)) >> 12, value], axis=2)


def _pooled(levels: np.ndarray, side: int) -> np.ndarray:
    """Means of ``side`` x ``side`` fields whose sizes differ by one at most, larger ones first."""
    return np.array([[field.mean() if field.size else np.nan for field in np.array_split(band, side, axis=1)] for band in np.array_split(levels, side, axis=0)])


def perceptual_hash(frame: np.ndarray) -> int:
    """64 bits, the first highest: which fields of 8 x 8 are brighter than their mean; as a signed number."""
    small = _pooled(frame.astype(float).mean(axis=2), HASH_SIDE)
    bits = int("".join("1" if x else "0" for x in (small > small.mean()).ravel()), 2)
    return bits - (1 << 64) if bits >> 63 else bits


def histogram(frame: np.ndarray, bins: int = BINS) -> np.ndarray:
    """Shares of the pixels in ``bins`` steps of each colour, red's step counting most."""
    steps = np.clip(frame.astype(np.int64) * bins // 256, 0, bins - 1).reshape(-1, 3)
    return np.bincount(steps @ np.array([bins * bins, bins, 1]), minlength=bins**3) / max(1, len(steps))


SCHEMA = "sharpness double, exposure_clipped double, colorfulness double, _change double, content double, hash long, histogram array<double>"


def frame_metrics(frames: DataFrame, crop: float = 1.0, bins: int = BINS) -> DataFrame:
    """(file_id, time_s, sharpness, exposure_clipped, colorfulness, motion, content, hash, histogram) of each frame.

    Motion is the mean change of luminance since the frame before, from 0 to 1, and the first frame's that of the second; content the mean change of hue,
    saturation and value, 0 for the first.  ``crop`` is the middle part that sharpness looks at.
    """
    own = frames.select("file_id", "time_s", F.col("height").cast("int").alias("height"), F.col("width").cast("int").alias("width"), "pixels")
    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema.fields[:2])
    names = ["file_id", "time_s", *(x.split()[0] for x in SCHEMA.split(", "))]
    types = (pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.float64(), pa.int64(), pa.list_(pa.float64()))

    def measure(batches):
        last, before = None, None
        for batch in batches:
            rows = []
            for file_id, height, width, pixels in zip(*(batch.column(c) for c in ("file_id", "height", "width", "pixels"))):
                height, width, pixels = height.as_py(), width.as_py(), pixels.as_py()
                if file_id.as_py() != last:
                    last, before = file_id.as_py(), None
                if not height or not width or pixels is None or len(pixels) != 3 * height * width:
                    rows.append((None,) * len(types))
                    continue
                frame = np.frombuffer(pixels, np.uint8).reshape(height, width, 3)
                levels, tones = gray(frame), hsv(frame)
                same = before is not None and before[0].shape == levels.shape
                change = float(np.abs(levels - before[0]).mean() / 255) if same else None
                content = float(np.abs(tones - before[1]).mean() / 255) if same else 0.0
                clipped = float(((levels == 0) | (levels == 255)).mean())
                rows.append((sharpness(gray(center(frame, crop))), clipped, colorfulness(frame), change, content, perceptual_hash(frame), histogram(frame, bins).tolist()))
                before = levels, tones
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column("file_id"), batch.column("time_s"), *(pa.array(c, t) for c, t in zip(zip(*rows), types))], names=names)

    found = own.repartition("file_id").sortWithinPartitions("file_id", "time_s").mapInArrow(measure, f"{kinds}, {SCHEMA}")
    order = Window.partitionBy("file_id").orderBy("time_s")
    motion = F.when(F.col("sharpness").isNotNull(), F.coalesce("_change", F.first("_change", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)), F.lit(0.0)))
    return found.withColumn("motion", motion).select("file_id", "time_s", "sharpness", "exposure_clipped", "colorfulness", "motion", "content", "hash", "histogram")
