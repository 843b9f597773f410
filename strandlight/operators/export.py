"""Export planning: rates, frames, bounds, file names, fingerprints.  Encoding itself is outside Spark."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.functions.scalar import even, fit_inside, short_digest, slow_motion_ratio


MOST_RATES = 10_000  # distinct rates that are compared with each other


def dominant_rate(clips: DataFrame, rate: str = "fps", fallback: float = 25.0) -> DataFrame:
    """(rate, clips): the distinct rate that most clips are whole multiples of (within a hundredth), the lowest of equals; the fallback where no rate is known.

    Clips are reduced to counts of distinct rates, of which MOST_RATES at most are compared; more are refused.
    """
    spark = clips.sparkSession
    counts = clips.select(F.round(rate, 3).cast("double").alias("r")).where("r > 0").groupBy("r").agg(F.count(F.lit(1)).alias("n"))
    found = sorted(tuple(x) for x in counts.limit(MOST_RATES + 1).collect())
    if len(found) > MOST_RATES:
        raise ValueError(f"over {MOST_RATES} distinct rates")
    rates, n = np.array([x[0] for x in found]), np.array([x[1] for x in found])
    best = (fallback, 0)
    for target in rates.tolist():
        ratio = rates / target
        reached = int(n[(np.rint(ratio) >= 1) & (np.abs(ratio - np.rint(ratio)) <= 0.01)].sum())
        if reached > best[1]:
            best = (target, reached)
    return spark.createDataFrame([best], "rate double, clips long")


def common_frame(clips: DataFrame, most_w: int, most_h: int, width: str = "width", height: str = "height") -> DataFrame:
    """(frame_w, frame_h): the least fitted height, and the widest clip's width at that height, held to the limit."""
    _, h = fit_inside(F.col(width), F.col(height), most_w, most_h)
    sizes = clips.where((F.col(width) > 0) & (F.col(height) > 0)).groupBy(width, height).count()
    low = sizes.agg(F.min(h).alias("frame_h"))
    wide = sizes.join(F.broadcast(low)).agg(F.max("frame_h").alias("frame_h"), F.max(F.least(F.bround(F.col(width) * F.col("frame_h") / F.col(height)), F.lit(float(most_w)))).alias("w"))
    return wide.select(even(F.col("w")).alias("frame_w"), "frame_h")


def plan_bounds(clips: DataFrame) -> DataFrame:
    """plan_start_s, plan_end_s: beat bounds, else hand bounds, else the duration around the centre moved into the file."""
    half = F.col("duration_s") / 2
    length = F.least(F.col("duration_s"), F.col("file_s"))
    start = F.least(F.greatest(F.col("center_s") - half, F.lit(0.0)), F.greatest(F.col("file_s") - length, F.lit(0.0)))
    user = (F.col("user_end_s") > F.col("user_start_s"))
    return clips.withColumns({
        "plan_start_s": F.coalesce("final_start_s", F.when(user, F.col("user_start_s")), start),
        "plan_end_s": F.coalesce("final_end_s", F.when(user, F.col("user_end_s")), start + length),
    })


def target_rate(override: Column, configured: Column, recorded: Column, dominant: Column) -> Column:
    return F.coalesce(override, configured, recorded, dominant)


def geometry(clips: DataFrame, strategy: str, most_w: int, most_h: int) -> DataFrame:
    """out_w, out_h, crop (null: none) and pad (null: none) of each clip for its vertical strategy."""
    w, h = F.col("display_w"), F.col("display_h")
    fit_w, fit_h = fit_inside(w, h, most_w, most_h)
    vertical = h > w
    if strategy == "center_crop":
        ratio = F.lit(most_w / most_h)
        crop_h = even(w / ratio)
        cropped = vertical & (crop_h < h)
        crop = F.when(cropped, F.format_string("crop=%d:%d", w.cast("long"), crop_h))
        crop_w2, crop_h2 = fit_inside(w, crop_h, most_w, most_h)
        return clips.withColumns({"out_w": F.when(cropped, crop_w2).otherwise(fit_w), "out_h": F.when(cropped, crop_h2).otherwise(fit_h), "crop": crop, "pad": F.lit(None).cast("string")})
    if strategy == "blur_pad":
        pad = F.when(vertical, F.format_string("pad=%d:%d", F.lit(most_w).cast("long"), F.lit(most_h).cast("long")))
        return clips.withColumns({"out_w": F.when(vertical, F.lit(most_w).cast("long")).otherwise(fit_w), "out_h": F.when(vertical, F.lit(most_h).cast("long")).otherwise(fit_h), "crop": F.lit(None).cast("string"), "pad": pad})
    return clips.withColumns({"out_w": fit_w, "out_h": fit_h, "crop": F.lit(None).cast("string"), "pad": F.lit(None).cast("string")})


def with_slow_motion(clips: DataFrame, enabled: Column) -> DataFrame:
    ratio = slow_motion_ratio(enabled, F.col("fps"), F.col("target_fps"))
    return clips.withColumn("ratio", ratio).withColumn("out_s", (F.col("plan_end_s") - F.col("plan_start_s")) * F.col("ratio"))


def command(clips: DataFrame, quality: int = 18) -> DataFrame:
    """The encoder's argument list of each planned clip, the same for the same plan."""
    filters = F.concat_ws(",", F.when(F.col("ratio") > 1, F.format_string("setpts=%d*PTS", "ratio")), "crop", F.format_string("scale=%d:%d", "out_w", "out_h"), "pad", F.format_string("fps=%s", F.col("target_fps").cast("string")))
    text = F.array(F.lit("-ss"), F.format_string("%.6f", "plan_start_s"), F.lit("-t"), F.format_string("%.6f", F.col("plan_end_s") - F.col("plan_start_s")), F.lit("-i"), F.col("path"), F.lit("-vf"), filters, F.lit("-crf"), F.lit(str(quality)), F.lit("-an"))
    return clips.withColumn("command", text)


def fingerprinted(clips: DataFrame, columns: list[str]) -> DataFrame:
    """``digest``: 16 hex digits over the named columns, in the order of their names."""
    return clips.withColumn("digest", short_digest(F.struct(*[F.col(c) for c in sorted(columns)])))


def uniform(parts: DataFrame, columns: list[str]) -> DataFrame:
    """(order, column): the first part, and its first column, that differs from the first part."""
    first = parts.agg(F.min_by(F.struct(*columns), "order").alias("f"))
    marked = parts.join(F.broadcast(first)).select("order", F.filter(F.array(*[F.when(~F.col(c).eqNullSafe(F.col(f"f.{c}")), c) for c in columns]), lambda c: c.isNotNull()).alias("d"))
    bad = marked.where(F.size("d") > 0).agg(F.min_by(F.struct("order", F.col("d")[0].alias("column")), "order").alias("b"))
    return bad.where("b is not null").select("b.order", "b.column")


def audio_filter(total_s: Column, fade_s: float) -> Column:
    """Padding, then a fade that ends with the edit."""
    return F.format_string("apad,afade=t=out:st=%.3f:d=%.3f", F.greatest(total_s - fade_s, F.lit(0.0)), F.lit(fade_s))


def identity(path: Column, size: Column, mtime: Column) -> Column:
    """A file by its path, size and whole second of its last change; empty without a path."""
    return F.when(path.isNull(), F.lit("")).otherwise(F.concat_ws(":", path, F.coalesce(size.cast("string"), F.lit("-")), F.coalesce(mtime.cast("long").cast("string"), F.lit("-"))))


def part_digests(clips: DataFrame, height: int, preset: str, quality: int) -> DataFrame:
    """``part_digest``: 16 hex digits over what one part of a montage is made from, so that a change renders that part alone."""
    what = [F.col("id"), *[F.format_string(f, c) for f, c in (("%.4f", "plan_start_s"), ("%.4f", "duration_s"), ("%.4f", "out_s"), ("%.3f", "target_fps"))], F.col("ratio").cast("string"), F.lit(f"{height}|{preset}|{quality}"), identity(F.col("path"), F.col("size"), F.col("mtime"))]
    return clips.withColumn("part_digest", F.substring(F.sha2(F.concat_ws("|", *what), 256), 1, 16))


def chained_digests(clips: DataFrame, by: str, settings: str, digest: str = "part_digest") -> DataFrame:
    """(by, edit_digest): 16 hex digits over the settings and the digests of an edit's clips in order, for montages and for the whole render.
    What is gathered for an edit is a short text for each of its clips."""
    parts = clips.groupBy(by).agg(F.sort_array(F.collect_list(F.struct("order", "id", digest))).alias("p"))
    listed = F.array_join(F.transform("p", lambda x: F.concat_ws(":", x["id"].cast("string"), x["order"].cast("string"), F.coalesce(x[digest], F.lit("-")))), "|")
    return parts.select(by, F.substring(F.sha2(F.concat(F.lit(settings + "|"), listed), 256), 1, 16).alias("edit_digest"))
