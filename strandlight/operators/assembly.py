"""Segments put together from spans, and the rows that selection and players read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.config import Config
from strandlight.functions import ranks
from strandlight.operators import rules, scoring, telemetry
from strandlight.session import kept

METRICS = ("sharpness", "exposure_clipped", "motion", "stability", "colorfulness")


def split_spans(shots: DataFrame, cuts: DataFrame) -> DataFrame:
    """(file_id, seg_id, start_s, end_s, split_reason): shots parted at cuts strictly inside them; ids count the parts of a file."""
    inside = shots.join(cuts, "file_id", "left").where(F.col("cut_s").isNull() | ((F.col("cut_s") > F.col("start_s")) & (F.col("cut_s") < F.col("end_s"))))
    at = inside.groupBy("file_id", "start_s", "end_s").agg(F.sort_array(F.collect_set("cut_s")).alias("c"))
    every = shots.select("file_id", "start_s", "end_s").join(at, ["file_id", "start_s", "end_s"], "left")
    edges = F.concat(F.array("start_s"), F.coalesce("c", F.array().cast("array<double>")), F.array("end_s"))
    parts = every.withColumn("e", edges).select("file_id", F.explode(F.transform(F.sequence(F.lit(1), F.size("e") - 1), lambda i: F.struct(F.element_at("e", i).alias("s"), F.element_at("e", i + 1).alias("t"), (F.size("e") > 2).alias("p")))).alias("x"))
    place = F.row_number().over(Window.partitionBy("file_id").orderBy("x.s")) - 1
    return parts.select("file_id", F.concat_ws(":", F.col("file_id"), place.cast("string")).alias("seg_id"), F.col("x.s").alias("start_s"), F.col("x.t").alias("end_s"), F.when(F.col("x.p"), "altitude").alias("split_reason"))


def segments(shots: DataFrame, cuts: DataFrame, frames: DataFrame, heights: DataFrame | None, files: DataFrame, config: Config, nearest: bool = True) -> DataFrame:
    """Shots to scored segments: split, trim by class, metrics over the trimmed span (else the raw one), rules, score.

    ``files`` has file_id, source_class, duration_s; ``heights`` file_id, time_s, height_m or, where frames have their own
    height_m, is None, so that both are looked up at once.  A segment that a trim leaves nothing of keeps its start as both bounds, and so
    is too short.  One without a frame has the metrics of the frame nearest its start or, if not ``nearest``, of 0.

    What is found in the spans is kept, as ranks read the segments more than once.
    """
    a = config.analysis
    own = split_spans(shots, cuts).join(files, "file_id", "left").withColumn("source_class", F.coalesce("source_class", F.lit("generic")))
    start, end = rules.trimmed(F.col("start_s"), F.col("end_s"), F.col("duration_s"), rules.class_value(a.head_s, F.col("source_class")), rules.class_value(a.tail_s, F.col("source_class")))
    own = own.withColumns({"trimmed_start_s": F.coalesce(start, "start_s"), "trimmed_end_s": F.coalesce(end, "start_s")})
    empty = F.col("trimmed_end_s") <= F.col("trimmed_start_s")
    window = own.select("seg_id", "file_id", F.when(empty, F.col("start_s")).otherwise(F.col("trimmed_start_s")).alias("start_s"), F.when(empty, F.col("end_s")).otherwise(F.col("trimmed_end_s")).alias("end_s"))
    flown = {"heights": F.count("height_m"), "max_height_m": F.max("height_m"), "min_height_m": F.min("height_m")}
    if heights is None:
        means = telemetry.span_means(window, frames, list(METRICS), nearest=nearest, also=flown, carried=["height_m"])
    else:
        found = scoring.inside(window, heights, ["height_m"]).groupBy("seg_id").agg(*[c.alias(name) for name, c in flown.items()])
        means = telemetry.span_means(window, frames, list(METRICS), nearest=nearest).join(found, "seg_id", "left")
    joined = own.join(kept(means), "seg_id").withColumn("heights", F.coalesce("heights", F.lit(0)))
    reason = rules.rejection_reason(config.rules, F.col("trimmed_end_s") - F.col("trimmed_start_s"), F.col("heights"), F.col("max_height_m"), F.col("exposure_clipped"), F.col("motion"), F.col("stability"))
    judged = joined.withColumn("reason", reason).withColumn("outcome", F.when(F.col("reason").isNull(), "candidate").otherwise("rejected"))
    weights = {m: getattr(config.weights, m) for m in METRICS}
    return scoring.composite_score(judged, weights)


def motion_slices(segments: DataFrame, frames: DataFrame, target: float) -> DataFrame:
    """(seg_id, motion): the motion values in time order within half the target of the centre, end excluded; empty without any.

    Centres and frames meet in time buckets of the target's length.
    """
    bucket = lambda c: F.floor(c / target)
    low, high = F.col("center_s") - target / 2, F.col("center_s") + target / 2
    spread = segments.select("seg_id", "file_id", low.alias("_low"), high.alias("_high"), F.explode(F.sequence(bucket(low), bucket(high))).alias("_b"))
    rows = frames.select("file_id", "time_s", "motion", bucket(F.col("time_s")).alias("_b"))
    near = spread.join(rows, ["file_id", "_b"]).where((F.col("time_s") >= F.col("_low")) & (F.col("time_s") < F.col("_high")))
    listed = near.groupBy("seg_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("time_s", "motion"))), lambda x: x["motion"]).alias("motion"))
    return segments.select("seg_id").join(listed, "seg_id", "left").select("seg_id", F.coalesce("motion", F.array().cast("array<double>")).alias("motion"))


def features(candidates: DataFrame, files: DataFrame, pictures: DataFrame, vectors: DataFrame, slices: DataFrame) -> DataFrame:
    """One row a candidate with all that similarity compares; what is missing is null.  Places come from the file's own tag."""
    own = candidates.join(files.select("file_id", "source_class", F.col("gps.lat").alias("lat"), F.col("gps.lon").alias("lon"), "creation_time"), "file_id", "left")
    at = F.unix_micros("creation_time") / 1_000_000 + F.coalesce("center_s", F.lit(0.0))
    own = own.withColumn("time_s", at).join(pictures, "seg_id", "left").join(vectors, "seg_id", "left").join(slices, "seg_id", "left")
    return own.withColumn("source_class", F.coalesce("source_class", F.lit("generic")))


def part_at(parts: DataFrame, times: DataFrame) -> DataFrame:
    """(at, order) of the montage part that plays at each time; between parts and past the end, the last part.  Parts have order, start_s, end_s
    and do not overlap.

    Both are dealt by time ranges that parts are looked up in, so a time meets the parts of its range alone.
    """
    spans = parts.select("order", "start_s", "end_s")
    measure = spans.agg(F.max("order").alias("last"), F.avg(F.col("end_s") - F.col("start_s")).alias("mean")).first()
    width = max(float(measure["mean"] or 1.0), 1e-6)
    spread = spans.select("*", F.explode(F.sequence(F.floor(F.col("start_s") / width), F.floor(F.col("end_s") / width))).alias("_b"))
    hit = times.withColumn("_b", F.floor(F.col("at") / width)).join(spread, "_b").where((F.col("at") >= F.col("start_s")) & (F.col("at") < F.col("end_s")))
    found = hit.groupBy("at").agg(F.min("order").alias("order"))
    return times.join(found, "at", "left").select("at", F.coalesce("order", F.lit(measure["last"])).alias("order"))


def card_order(segments: DataFrame) -> DataFrame:
    """``place`` of each card: selected ones first in edit order, then by the file's place and the start."""
    chosen = F.col("outcome") == "selected"
    return ranks.numbered(segments, [chosen.desc(), F.when(chosen, F.col("order")).asc_nulls_last(), F.col("file_place"), F.col("start_s"), F.col("seg_id")], "place", start=1)


def first_existing(wanted: DataFrame, listing: DataFrame) -> DataFrame:
    """(project, path): the first of each project's wanted paths (place, path) that a listing has."""
    return wanted.join(listing.select("path").distinct(), "path").groupBy("project").agg(F.min_by("path", "place").alias("path"))


def summary_html(counts: DataFrame, title: str) -> str:
    """A page with the header counts, which are a few rows whatever the project."""
    from html import escape

    body = "".join(f"<tr><td>{escape(r.grain)}</td><td>{escape(r.key or '-')}</td><td>{r.n}</td><td>{r.seconds or 0:.1f}</td></tr>" for r in counts.orderBy("grain", "key").collect())
    return f"<!doctype html><title>{escape(title)}</title><table>{body}</table>"


def share_cap(same: Column, limit: Column, share: float) -> Column:
    """Whether one more clip of a tag would pass its share of the edit."""
    return same / limit >= share
