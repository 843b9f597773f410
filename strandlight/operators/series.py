"""Time-series operators over frames, samples and beats."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType


def motion_series(frames: DataFrame, value: str, by: str = "file_id", order: str = "time_s", name: str = "motion") -> DataFrame:
    """Absolute change from the frame before; the first borrows the second's; a lone frame has 0."""
    w = Window.partitionBy(by).orderBy(order)
    change = F.abs(F.col(value) - F.lag(value).over(w))
    borrowed = F.abs(F.lead(value).over(w) - F.col(value))
    return frames.withColumn(name, F.coalesce(change, borrowed, F.lit(0.0)))


def stability(frames: DataFrame, value: str, width: int = 5, by: str = "file_id", order: str = "time_s") -> DataFrame:
    """1 less the clipped coefficient of variation in a centred window; 1 for short series or a mean of 0."""
    half = width // 2
    w = Window.partitionBy(by).orderBy(order).rowsBetween(-half, half)
    n = F.count(F.lit(1)).over(Window.partitionBy(by))
    mean, spread = F.avg(value).over(w), F.stddev_pop(value).over(w)
    calm = 1 - F.least(F.greatest(F.try_divide(spread, mean), F.lit(0.0)), F.lit(1.0))
    return frames.withColumn("stability", F.when((n < width) | (mean <= 0) | F.lit(width < 2), F.lit(1.0)).otherwise(calm))


def altitude_cuts(samples: DataFrame, threshold: float, by: str = "file_id", order: str = "time_s", height: str = "height_m", grid: float = 2.0) -> DataFrame:
    """(by, cut_s) where a flight crosses ``threshold``, on a grid of ``grid`` steps a second, halves to even; each cut once.
    Cuts at the first or last sample of the file are no cuts."""
    w = Window.partitionBy(by).orderBy(order)
    below = F.col(height) < threshold
    crossing = samples.where(F.col(height).isNotNull()).select(by, order, below.alias("below"), F.lag(below).over(w).alias("was"), F.min(order).over(Window.partitionBy(by)).alias("first"), F.max(order).over(Window.partitionBy(by)).alias("last"))
    cut = F.round(F.rint(F.col(order) * grid) / grid, 6)
    return crossing.where("was is not null and below != was").withColumn("cut_s", cut).where("first < cut_s and cut_s < last").select(by, "cut_s").distinct()


def shot_cuts(frames: DataFrame, threshold: float, least_s: float, by: str = "file_id", order: str = "time_s", score: str = "content", end: str | None = None) -> DataFrame:
    """(by, start_s, end_s) of shots: cuts where the score reaches ``threshold``, at least ``least_s`` after the last cut taken and
    before the end.  A cut depends on the last one taken, so the files' candidates are read in order as a stream that remembers one cut."""
    files = frames.groupBy(by).agg(F.min(order).cast("double").alias("begin"), F.max(order if end is None else end).cast("double").alias("stop"))
    candidates = frames.where(F.col(score) >= threshold).select(by, F.col(order).cast("double").alias("at")).join(files, by)
    schema = StructType([frames.schema[by], StructField("at", DoubleType())])

    def take(batches):
        file, last = None, None
        for batch in batches:
            keep = []
            for key, at, begin, stop in zip(*(c.to_pylist() for c in batch.columns)):
                if last is None or key != file:
                    file, last = key, begin
                keep.append(at - last >= least_s and stop - at >= least_s)
                last = at if keep[-1] else last
            yield batch.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    cuts = candidates.repartition(by).sortWithinPartitions(by, "at").mapInArrow(take, schema)
    edges = cuts.unionByName(files.select(by, F.explode(F.array("begin", "stop")).alias("at")))
    spans = edges.select(by, F.col("at").alias("start_s"), F.lead("at").over(Window.partitionBy(by).orderBy("at")).alias("end_s"))
    return spans.where("end_s is not null")


def visits(rows: DataFrame, gap_s: float, by: list[str], at: str, ident: str, name: str = "visit") -> DataFrame:
    """Sessions numbered from 0: a gap of strictly more than ``gap_s`` starts one; rows without a time join the first."""
    w = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), ident)
    new = F.when(F.col(at) - F.lag(at).over(w) > gap_s, 1).otherwise(0)
    return rows.withColumn("_new", new).withColumn(name, F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("_new")


def running_start(clips: DataFrame, order: list[str], duration: str = "duration_s", by: list[str] | None = None) -> DataFrame:
    """When each clip begins in its edit: the durations before it."""
    w = Window.partitionBy(*(by or [])).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    return clips.withColumn("clip_start_s", F.coalesce(F.sum(duration).over(w), F.lit(0.0)))


def montage_index(parts: DataFrame, by: list[str], ident: str = "id") -> DataFrame:
    """(by, order, id, start_s, end_s, duration_s) of an edit's parts one after another, to four places."""
    placed = running_start(parts, ["order", ident], by=by)
    end = F.col("clip_start_s") + F.col("duration_s")
    return placed.select(*by, "order", ident, F.round("clip_start_s", 4).alias("start_s"), F.round(end, 4).alias("end_s"), F.round("duration_s", 4).alias("duration_s"))


def energy_curve(clips: DataFrame, motion: str, order: str, by: str, smoothing: int = 3) -> DataFrame:
    """Smoothed place rank of motion along the edit.

    A uniform kernel with zeros beyond the ends; then each end value is replaced by the mean of the
    two smoothed values there.  The two ends are written in turn, so for two clips the second sees the first.
    """
    part = Window.partitionBy(by)
    n = F.count(F.lit(1)).over(part)
    rank = F.when(n == 1, F.lit(0.5)).otherwise((F.row_number().over(part.orderBy(motion, order)) - 1) / (n - 1))
    base = clips.withColumn("_r", rank).withColumn("_n", n)
    o = part.orderBy(order)
    width = F.least(F.col("_n"), F.lit(smoothing))
    three = F.coalesce(F.lag("_r").over(o), F.lit(0.0)) + F.col("_r") + F.coalesce(F.lead("_r").over(o), F.lit(0.0))
    two = F.coalesce(F.lag("_r").over(o), F.lit(0.0)) + F.col("_r")
    base = base.withColumn("_s", F.when(width == 3, three / 3).when(width == 2, two / 2).otherwise(F.col("_r")))
    base = base.withColumn("_i", F.row_number().over(o))
    first = (F.col("_s") + F.lead("_s").over(o)) / 2
    last = F.when(F.col("_n") == 2, (F.col("_s") + (F.lag("_s").over(o) + F.col("_s")) / 2) / 2).otherwise((F.col("_s") + F.lag("_s").over(o)) / 2)
    curve = F.when(F.col("_n") == 1, F.col("_s")).when(F.col("_i") == 1, first).when(F.col("_i") == F.col("_n"), last).otherwise(F.col("_s"))
    return base.withColumn("energy", F.least(F.greatest(curve, F.lit(0.0)), F.lit(1.0))).drop("_r", "_n", "_s", "_i")


def peak_third(curve: DataFrame, by: str, order: str, value: str = "energy") -> DataFrame:
    """(by, peak_third): which third of the edit has the highest mean, the first of equals; thirds differ by one at most, longer ones first."""
    third = F.ntile(3).over(Window.partitionBy(by).orderBy(order)) - 1
    means = curve.withColumn("third", third).groupBy(by, "third").agg(F.avg(value).alias("mean"))
    return means.groupBy(by).agg(F.min_by("third", F.struct((-F.round("mean", 9)).alias("m"), "third")).alias("peak_third"))


def shape_thirds(curve: DataFrame, by: str, order: str, value: str = "energy") -> DataFrame:
    """(by, third, mean) with equal first thirds and the rest in the last."""
    part = Window.partitionBy(by)
    size = F.greatest(F.floor(F.count(F.lit(1)).over(part) / 3), F.lit(1))
    third = F.least(F.floor((F.row_number().over(part.orderBy(order)) - 1) / size), F.lit(2)).cast("int")
    return curve.withColumn("third", third).groupBy(by, "third").agg(F.avg(value).alias("mean"))


def envelope(samples: DataFrame, points: int, by: str, order: str, value: str) -> DataFrame:
    """(by, slice, low, high) of ``points`` equal slices; what is left over at the end is dropped."""
    part = Window.partitionBy(by)
    per = F.floor(F.count(F.lit(1)).over(part) / points)
    place = F.row_number().over(part.orderBy(*([order] if isinstance(order, str) else order))) - 1
    cut = samples.select(by, value, per.alias("per"), place.alias("place")).where("per > 0")
    cut = cut.withColumn("slice", F.floor(F.col("place") / F.col("per"))).where(F.col("slice") < points)
    return cut.groupBy(by, "slice").agg(F.min(value).alias("low"), F.max(value).alias("high"))


def bpm_of_beats(beats: DataFrame, by: str, at: str, fallback: float = 0.0) -> DataFrame:
    """(by, bpm): mean of the gaps within half of their median, as beats a minute to one place."""
    gaps = beats.select(by, (F.col(at) - F.lag(at).over(Window.partitionBy(by).orderBy(at))).alias("gap")).where("gap > 0")
    middle = gaps.groupBy(by).agg(F.expr("percentile(gap, 0.5)").alias("median"))
    kept = gaps.join(middle, by).where(F.abs(F.col("gap") - F.col("median")) <= 0.5 * F.col("median"))
    rates = kept.groupBy(by).agg(F.round(60 / F.avg("gap"), 1).alias("bpm"))
    return beats.select(by).distinct().join(rates, by, "left").select(by, F.coalesce("bpm", F.lit(fallback)).alias("bpm"))


def resample(series: Column, length: Column) -> Column:
    """An array stretched to ``length`` points by linear interpolation between its ends."""
    n = F.size(series)

    def point(i: Column) -> Column:
        at = F.when(length > 1, i * (n - 1) / (length - 1)).otherwise(F.lit(0.0))
        low = F.floor(at).cast("int")
        here = F.element_at(series, low + 1)
        after = F.element_at(series, F.least(low + 2, n))
        return here + (after - here) * (at - low)

    return F.when((n > 0) & (length > 0), F.transform(F.sequence(F.lit(0), length - 1), point))
