"""Scores of segments and frames, and the best window of a segment."""

from __future__ import annotations

import math
from collections import deque
from functools import reduce

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandlight.functions.ranks import WINDOW_ROWS, average_rank, low_rank, with_ranks

LOWER_IS_BETTER = ("exposure_clipped",)
BUCKET_S, MOST_BUCKETS = 60.0, 2  # of interval joins: the least bucket in seconds; longer spans have buckets of half their length or more


def _weighted(parts: list[tuple[Column, Column, float]]) -> Column:
    """Weighted mean of (use, value, weight); 0.5 where nothing is used."""
    total = reduce(lambda a, b: a + b, [F.when(use, F.lit(w)).otherwise(0.0) for use, _, w in parts], F.lit(0.0))
    score = reduce(lambda a, b: a + b, [F.when(use, value * w).otherwise(0.0) for use, value, w in parts], F.lit(0.0))
    return F.when(total > 0, score / F.when(total > 0, total)).otherwise(F.lit(0.5))


def composite_score(segments: DataFrame, weights: dict[str, float], by: str = "source_class", name: str = "score", lower=LOWER_IS_BETTER, window_rows: int = WINDOW_ROWS) -> DataFrame:
    """Weighted mean of each metric's average rank within the class.

    A metric with a null in a class is left out for the whole class.  Metrics of weight 0 are not ranked.
    """
    used = {m: w for m, w in weights.items() if w > 0}
    out = with_ranks(segments, list(used), by, average_rank, window_rows=window_rows)
    # which metrics a class has for all of its rows: a row for each class
    whole = segments.groupBy(F.col(by).alias("_class")).agg(*[(F.count(m) == F.count(F.lit(1))).alias(f"_all_{m}") for m in used]) if used else None
    if whole is not None:
        out = out.join(whole, F.col(by).eqNullSafe(F.col("_class")))
    parts = [(F.col(f"_all_{m}"), 1 - F.col(f"_rank_{m}") if m in lower else F.col(f"_rank_{m}"), w) for m, w in used.items()]
    return out.withColumn(name, _weighted(parts)).select(*[c for c in segments.columns if c != name], name)


def frame_scores(frames: DataFrame, weights: dict[str, float], by: str = "source_class", lower=LOWER_IS_BETTER) -> DataFrame:
    """Score of each frame from its metrics' low ranks among all frames of the class."""
    used = {m: w for m, w in weights.items() if w > 0 and m != "aesthetic"}
    out = with_ranks(frames, list(used), by, low_rank)
    parts = [(F.col(m).isNotNull(), 1 - F.col(f"_rank_{m}") if m in lower else F.col(f"_rank_{m}"), w) for m, w in used.items()]
    return out.withColumn("frame_score", _weighted(parts)).select(*[c for c in frames.columns if c != "frame_score"], "frame_score")


def minimum(by: str = "file_id", at: str = "time_s", value: str = "motion") -> Column:
    """Whether an interior frame is lower than one neighbour and not higher than the other; never null."""
    w = Window.partitionBy(by).orderBy(at)
    before, after, here = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
    return F.coalesce(((here < before) & (here <= after)) | ((here <= before) & (here < after)), F.lit(False)) & before.isNotNull() & after.isNotNull()


def motion_minima(frames: DataFrame, by: str = "file_id", at: str = "time_s", value: str = "motion") -> DataFrame:
    """Interior frames lower than one neighbour and not higher than the other."""
    return frames.withColumn("_min", minimum(by, at, value)).where("_min").drop("_min")


def inside(segments: DataFrame, frames: DataFrame, values: list[str] | None = None, seconds: float = BUCKET_S) -> DataFrame:
    """(seg_id, file_id, start_s, end_s, time_s, values...) of the frames with start <= time < end, by time buckets and so as an equi-join on file and bucket.

    Buckets have ``seconds``; of a longer span half its length or more, so that no span is spread over more than a few.
    """
    bucket = lambda c: F.floor(c / seconds)
    last = F.greatest("start_s", "end_s")
    wide = F.greatest(F.ceil((last - F.col("start_s")) / seconds / MOST_BUCKETS), F.lit(1))
    sized = segments.select("seg_id", "file_id", "start_s", "end_s").withColumn("_w", F.pow(F.lit(2), F.ceil(F.log2(wide.cast("double")))).cast("long"))
    spread = sized.select("*", F.explode(F.sequence(F.floor(bucket(F.col("start_s")) / F.col("_w")), F.floor(bucket(last) / F.col("_w")))).alias("_b"))
    # frames are dealt once for each size that a file's spans have, within the time that spans of that size cover
    widths = sized.groupBy("file_id", "_w").agg(F.min("start_s").alias("_from"), F.max("end_s").alias("_to"))
    rows = frames.select("file_id", "time_s", *(values or [])).join(widths, "file_id").where("time_s >= _from and time_s < _to").drop("_from", "_to").withColumn("_b", F.floor(bucket(F.col("time_s")) / F.col("_w")))
    return spread.join(rows, ["file_id", "_w", "_b"]).where((F.col("time_s") >= F.col("start_s")) & (F.col("time_s") < F.col("end_s"))).select("seg_id", "file_id", "start_s", "end_s", "time_s", *(values or []))


UNIT = 1074  # of sums: doubles are whole numbers of 2 ** -1074


class Sums:
    """Means of windows from a file's rows in order: a window's sum is the difference of two running sums, which are exact (whole
    numbers), so that no value outside it and no order of addition changes it.  Rounded once as a sum and once as a mean."""

    def __init__(self, target: float):
        self.target = target
        self.start(None)

    def start(self, file) -> None:
        self.file, self.total, self.n, self.odd, self.open = file, 0, 0, [], deque()

    def ask(self, c: float) -> None:
        self.open.append((c + self.target, self.total, self.n, len(self.odd)))

    def add(self, v: float | None) -> None:
        if v is None:
            return
        self.n += 1
        if not math.isfinite(v):
            self.odd.append(v)
        else:
            top, bottom = v.as_integer_ratio()
            self.total += top << UNIT + 1 - bottom.bit_length()

    def ended(self, t: float = math.inf) -> list[float | None]:
        """Means of the windows that end by ``t``, in the order in which they were asked for."""
        found = []
        while self.open and not t < self.open[0][0]:
            _, total, n, odd = self.open.popleft()
            try:
                s = sum(self.odd[odd:]) if len(self.odd) > odd else (self.total - total) / (1 << UNIT)
            except OverflowError:
                s = math.copysign(math.inf, self.total - total)
            found.append(s / (self.n - n) if self.n > n else None)
        return found


def _candidate_means(segments: DataFrame, frames: DataFrame, target: float, values: list[str] | None = None) -> DataFrame:
    """(seg_id, start_s, end_s, file_id, c, values..., mean): windows that begin at a frame, whose values they have, or end flush with the
    span (values are null; a frame at that time has its own window).

    Means come from one sort of a file's frames and windows, so no frame is read again for each window that holds it.
    """
    more = values or []
    own = ["seg_id", "file_id", "start_s", "end_s"]
    starts = inside(segments, frames, more).where(F.col("time_s") + target <= F.col("end_s")).select(*own, F.col("time_s").cast("double").alias("c"), *more)
    flush = segments.where(F.col("end_s") - F.col("start_s") > target).select(*own, (F.col("end_s") - target).cast("double").alias("c"))
    asked = starts.unionByName(flush, allowMissingColumns=True).where("file_id is not null and c is not null")
    scored = frames.where("file_id is not null and time_s is not null").select("file_id", F.col("time_s").cast("double").alias("c"), F.col("frame_score").cast("double").alias("_v"))
    line = asked.withColumn("_frame", F.lit(False)).unionByName(scored.withColumn("_frame", F.lit(True)), allowMissingColumns=True)
    schema = StructType([*asked.schema, StructField("mean", DoubleType())])

    def take(batches):
        sums, waiting, means = Sums(target), deque(), []
        for batch in batches:
            waiting.append(batch.filter(pc.invert(batch["_frame"])).select(asked_names))
            for file, t, frame, v in zip(*(batch[name].to_pylist() for name in ("file_id", "c", "_frame", "_v"))):
                if file != sums.file:
                    means += sums.ended()
                    sums.start(file)
                if frame:
                    means += sums.ended(t)
                    sums.add(v)
                else:
                    sums.ask(t)
            while waiting and len(waiting[0]) <= len(means):
                yield with_means(waiting.popleft(), means)
        means += sums.ended()
        while waiting:
            yield with_means(waiting.popleft(), means)

    def with_means(batch, means):
        out = batch.append_column("mean", pa.array(means[: len(batch)], pa.float64()))
        del means[: len(batch)]
        return out

    asked_names = asked.columns
    return line.repartition("file_id").sortWithinPartitions("file_id", "c", "_frame").mapInArrow(take, schema)


def best_first() -> Column:
    """The order of windows: by their mean, the best first (one that is no number counts as the greatest), the earliest of equals."""
    return F.struct((~F.coalesce(F.isnan("mean"), F.lit(False))).alias("r"), (-F.coalesce("mean", F.lit(float("-inf")))).alias("m"), F.col("c"))


def best_windows(segments: DataFrame, frames: DataFrame, target: float) -> DataFrame:
    """(seg_id, centre_s, duration_s) of the window of ``target`` seconds with the best mean score.

    An empty span gives its start and 0; a span no longer than the target gives its middle and length; a span without frames
    its middle and the target.  Of equal means the earliest wins.
    """
    span = F.col("end_s") - F.col("start_s")
    means = _candidate_means(segments, frames, target)
    best = means.groupBy("seg_id").agg(F.min_by("c", best_first()).alias("c"))
    framed = inside(segments, frames).select("seg_id").distinct().withColumn("_framed", F.lit(True))
    joined = segments.join(best, "seg_id", "left").join(framed, "seg_id", "left")
    middle = (F.col("start_s") + F.col("end_s")) / 2
    centre = F.when(span <= 0, F.col("start_s")).when((span <= target) | F.col("_framed").isNull(), middle).otherwise(F.col("c") + target / 2)
    duration = F.when(span <= 0, F.lit(0.0)).when(span <= target, span).otherwise(F.lit(float(target)))
    return joined.select("seg_id", centre.alias("centre_s"), duration.alias("duration_s"))


def snapped_windows(segments: DataFrame, frames: DataFrame, target: float, reach_s: float, max_loss: float) -> DataFrame:
    """(seg_id, start_s) of the best window moved to a motion minimum within reach that loses at most ``max_loss`` of the score."""
    lows = frames.withColumn("_low", F.when(minimum(), F.col("motion")))
    means = _candidate_means(segments, lows, target, ["_low"])
    # a window lies within its span: where the best one has a mean, the span has a frame
    best = F.min_by(F.struct("c", "mean"), best_first()).over(Window.partitionBy("seg_id"))
    placed = means.withColumn("_best", best).where("_best.mean is not null").withColumns({"c0": F.col("_best.c"), "mean0": F.col("_best.mean")})
    away = F.abs(F.col("c") - F.col("c0"))
    ok = F.col("_low").isNotNull() & (F.col("mean0") > 0) & (away > 1e-9) & (away <= reach_s) & (F.col("c") >= F.col("start_s")) & (F.col("c") + target <= F.col("end_s")) & (F.try_divide(F.col("mean0") - F.col("mean"), F.col("mean0")) <= max_loss)
    chosen = placed.groupBy("seg_id").agg(F.min("c0").alias("c0"), F.min_by("c", F.when(ok, F.struct("_low", away.alias("d"), "c"))).alias("snapped"))
    return chosen.select("seg_id", F.coalesce("snapped", "c0").alias("start_s"), F.col("snapped").isNotNull().alias("moved"))
