"""Report aggregates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.functions.ranks import numbered, value_ranks


def header_counts(segments: DataFrame) -> DataFrame:
    """(grain, key, n, seconds) by outcome, by reason and in all, in one pass over the segments."""
    cut = segments.select("outcome", "reason", "seconds")
    cube = cut.groupingSets([["outcome"], ["reason"], []], "outcome", "reason").agg(F.grouping_id().alias("g"), F.count(F.lit(1)).alias("n"), F.sum("seconds").alias("seconds"))
    grain = F.when(F.col("g") == 1, "outcome").when(F.col("g") == 2, "reason").otherwise("all")
    return cube.select(grain.alias("grain"), F.coalesce("outcome", "reason").alias("key"), "n", "seconds")


def metric_percentiles(segments: DataFrame, metric: str, by: str, points=(0.05, 0.10, 0.25, 0.50, 0.75, 0.95)) -> DataFrame:
    """(by, p5, ...) by class and pooled as ``all``; interpolated.

    Values are counted, and their places among the sorted rows say which are the two about each point: no task holds a class.
    """
    counted = segments.where(F.col(metric).isNotNull()).select(F.explode(F.array(F.struct(F.col(by).alias("k"), F.lit(0).alias("g")), F.struct(F.lit(None).cast(segments.schema[by].dataType).alias("k"), F.lit(1).alias("g")))).alias("x"), F.col(metric).cast("double").alias("v"))
    ranks = value_ranks(counted.select("x.g", "x.k", "v"), ["g", "k"], "v")
    holds = lambda at: F.max(F.when((F.col("below") <= at) & (at < F.col("below") + F.col("tied")), F.col("v")))
    cuts = {p: (F.col("n") - 1) * p for p in points}
    own = ranks.groupBy("g", "k", "n").agg(*[holds(F.floor(at)).alias(f"low{k}") for k, at in enumerate(cuts.values())], *[holds(F.ceil(at)).alias(f"high{k}") for k, at in enumerate(cuts.values())])
    between = [(F.col(f"low{k}") + (F.col(f"high{k}") - F.col(f"low{k}")) * (at - F.floor(at))).alias(f"p{round(100 * p)}") for k, (p, at) in enumerate(cuts.items())]
    return own.select(F.when(F.col("g") == 1, "all").otherwise(F.col("k")).alias(by), *between)


def mix(rows: DataFrame, by: list[str], kind: str) -> DataFrame:
    """(by, kind, n, share) with shares to three places."""
    counts = rows.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.round(F.col("n") / F.sum("n").over(Window.partitionBy(*by)), 3))


def most_common(rows: DataFrame, by: list[str], kind: str, order: str) -> DataFrame:
    """(by, kind, n, share): the most common value, of equals the one met first in ``order``."""
    counts = rows.groupBy(*by, kind).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    best = counts.groupBy(*by).agg(F.min_by(F.struct(kind, "n"), F.struct((-F.col("n")).alias("m"), "_first")).alias("b"), F.sum("n").alias("_all"))
    return best.select(*by, f"b.{kind}", "b.n", F.round(F.col("b.n") / F.col("_all"), 3).alias("share"))


def place_summary(segments: DataFrame) -> DataFrame:
    """(place_id, segments, visits, selected)."""
    return segments.where("place_id is not null").groupBy("place_id").agg(F.count(F.lit(1)).alias("segments"), F.count_distinct("visit_id").alias("visits"), F.count_if("is_selected").alias("selected"))


def place_centroids(segments: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(place_id, lat, lon, segments) and, from an earlier run, name and region."""
    own = segments.where("place_id is not null").groupBy("place_id").agg(F.avg("lat").alias("lat"), F.avg("lon").alias("lon"), F.count(F.lit(1)).alias("segments"))
    return own if names is None else own.join(names.select("place_id", "name", "region"), "place_id", "left")


def time_band(at: Column) -> Column:
    """morning 5-9, daytime 9-17, evening 17-21, night; half-open, in the session's zone."""
    h = F.hour(at)
    return F.when((h >= 5) & (h < 9), "morning").when((h >= 9) & (h < 17), "daytime").when((h >= 17) & (h < 21), "evening").otherwise("night")


def duration_summary(clips: DataFrame, by: list[str], base: Column, target: float | None) -> DataFrame:
    """Total, shortfall against a target (0 without one), clips longer and shorter than their class base, heroes."""
    total = F.sum("duration_s")
    return clips.groupBy(*by).agg(
        total.alias("total_s"),
        (F.lit(target) - total if target is not None else F.lit(0.0)).alias("shortfall_s"),
        F.count_if(F.col("duration_s") >= base).alias("long"),
        F.count_if(F.col("duration_s") < base).alias("short"),
        F.count_if("hero").alias("heroes"),
    )


def beat_distribution(clips: DataFrame) -> DataFrame:
    """(beats, n, shift): clips of each beat multiple, and their mean absolute change of length."""
    return clips.groupBy("beats").agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(F.abs(F.col("beat_duration_s") - F.col("duration_s"))), 4).alias("shift"))


def stale(existing: DataFrame, expected: DataFrame, name: str = "name") -> DataFrame:
    """Files of a folder that nothing expects; names that begin with a dot are left alone."""
    return existing.where(~F.startswith(name, F.lit("."))).join(expected.select(name).distinct(), name, "left_anti")


def pending(planned: DataFrame, done: DataFrame) -> DataFrame:
    """Planned outputs (path, digest) that are not there with the same digest."""
    return planned.join(done.select("path", "digest"), ["path", "digest"], "left_anti")


def usage(outcomes: DataFrame) -> DataFrame:
    """Requests, cost, failures and cache hits of description calls."""
    return outcomes.agg(F.count_if(~F.col("cached")).alias("requests"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"), F.count_if("failed").alias("failures"), F.count_if("cached").alias("cache_hits"))


def run_stats(files: DataFrame) -> DataFrame:
    return files.agg(F.count_if(F.col("error").isNull()).alias("files_analyzed"), F.count_if("from_cache").alias("files_from_cache"), F.count_if(F.col("error").isNotNull()).alias("files_failed"))


def describe_scope(segments: DataFrame, scope: str) -> DataFrame:
    """What a description run covers, with ``place`` from 1: the selected ones in edit order, or those and the candidates by id."""
    own = segments.where(F.col("outcome") == "selected") if scope == "selected" else segments.where(F.col("outcome").isin("candidate", "selected"))
    order = [F.coalesce("order", F.lit(0)), F.col("id")] if scope == "selected" else [F.col("id")]
    return numbered(own, order, "place", start=1)


def capture_order(segments: DataFrame) -> DataFrame:
    """The rejected ones in order of capture, those without a time first, with ``place`` from 1."""
    return numbered(segments.where(F.col("outcome") == "rejected"), [F.coalesce("time_s", F.lit(0.0)), F.col("id")], "place", start=1)


def first_of(rows: DataFrame, by: list[str], value: str, order: list, most: int, name: str) -> DataFrame:
    """(by, name): the first ``most`` values that are not blank, in order.  No more than those are gathered for a group."""
    known = rows.where(F.coalesce(F.col(value), F.lit("")) != "")
    kept = known.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where(F.col("_n") <= most)
    return kept.groupBy(*by).agg(F.transform(F.sort_array(F.collect_list(F.struct("_n", F.col(value).alias("v")))), lambda x: x["v"]).alias(name))


def signal_lists(selected: DataFrame, places: DataFrame, by: list[str], captions: int = 5, names: int = 3) -> DataFrame:
    """(by, captions, place_names, regions): the first captions in edit order, the names of the places with the most segments (first of
    equals by place_id), and the regions, sorted."""
    regions = places.where(F.coalesce(F.col("region"), F.lit("")) != "").groupBy(*by).agg(F.array_sort(F.collect_set("region")).alias("regions"))
    out = selected.select(*by).union(places.select(*by)).distinct()
    for part in (first_of(selected, by, "caption", ["order", "id"], captions, "captions"), first_of(places, by, "name", [F.col("segments").desc(), "place_id"], names, "place_names"), regions):
        out = out.join(part, by, "left")
    empty = F.array().cast("array<string>")
    return out.select(*by, *[F.coalesce(c, empty).alias(c) for c in ("captions", "place_names", "regions")])


def face_counts(frames: DataFrame, detections: DataFrame, least_score: float, height_share: float) -> DataFrame:
    """(file_id, frame, faces): how many of a frame's detections are sure enough and high enough."""
    good = detections.join(frames, ["file_id", "frame"]).where((F.col("score") >= least_score) & (F.col("box_height") >= height_share * F.col("frame_height")))
    counts = good.groupBy("file_id", "frame").agg(F.count(F.lit(1)).alias("faces"))
    return frames.select("file_id", "frame").join(counts, ["file_id", "frame"], "left").select("file_id", "frame", F.coalesce("faces", F.lit(0)).alias("faces"))


def synced_against(track: Column, bpm: Column, synced_track: Column, synced_bpm: Column) -> Column:
    """Whether clips' bounds come from this track at this tempo."""
    return F.coalesce((track == synced_track) & (F.abs(bpm - synced_bpm) < 0.05), F.lit(False))


def held_by_names(held: DataFrame, cards: DataFrame) -> DataFrame:
    """(id, held_by_label): the clips that hold a visit (held_by, ids in order) by their cards' order labels, else by their ids."""
    labels = cards.select(F.col("id").alias("_holder"), F.nullif("order_label", F.lit("")).alias("_label"))
    single = held.select("id", F.posexplode("held_by").alias("_n", "_holder")).join(labels, "_holder", "left")
    listed = single.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("_n", F.coalesce("_label", F.col("_holder").cast("string")).alias("v")))).alias("l"))
    return listed.select("id", F.array_join(F.transform("l", lambda x: x["v"]), ", ").alias("held_by_label"))
