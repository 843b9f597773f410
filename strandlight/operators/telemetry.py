"""Subtitle telemetry: cues from text lines, their fields, summaries, samples within spans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from strandlight.functions.ranks import value_ranks
from strandlight.operators.scoring import BUCKET_S, inside

#: fixed values: the keys of a cue and the columns they fill
FIELDS = {"H": "height_m", "H.S": "speed_h_ms", "V.S": "speed_v_ms", "SS": "shutter", "EV": "ev", "ISO": "iso"}
TIMING = r"^\s*(\d+:\d{2}:\d{2}[,.]\d{1,3})\s*-->\s*(\d+:\d{2}:\d{2}[,.]\d{1,3})"
NUMBER = r"([-+]?\d+(?:\.\d+)?)"
POSITION = rf"GPS\s*\(\s*{NUMBER}\s*,\s*{NUMBER}\s*,\s*{NUMBER}"


def cues(lines: DataFrame) -> DataFrame:
    """(file_id, cue, time_s, text) from ``lines`` (file_id, n, line): a timing line opens a cue; a bare number right
    before one is its index and no text."""
    from strandlight.functions.scalar import timecode_seconds

    w = Window.partitionBy("file_id").orderBy("n")
    timing = F.col("line").rlike(TIMING)
    marked = lines.select("file_id", "n", "line", timing.alias("t"), F.lead(timing).over(w).alias("next"))
    index = F.col("line").rlike(r"^\s*\d+\s*$") & F.coalesce("next", F.lit(False))
    opened = marked.select("file_id", "n", F.btrim("line").alias("line"), "t", index.alias("index"), F.sum(F.col("t").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("cue"))
    texts = opened.where("cue > 0").groupBy("file_id", "cue").agg(
        F.max(F.when(F.col("t"), timecode_seconds(F.col("line")))).alias("time_s"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.when(~F.col("t") & ~F.col("index") & (F.col("line") != ""), F.struct("n", "line")))), lambda x: x["line"]), " ").alias("text"),
    )
    return texts


def bare(text: Column) -> Column:
    """Text without markup."""
    return F.regexp_replace(text, r"<[^>]*>|\{[^}]*\}", " ")


def is_telemetry(text: Column) -> Column:
    """At least two of the marks ISO, GPS ( and H in a cue."""
    t = bare(text)
    marks = [F.contains(t, F.lit("ISO")), F.contains(t, F.lit("GPS (")), F.contains(t, F.lit("H "))]
    return sum((m.cast("int") for m in marks[1:]), marks[0].cast("int")) >= 2


def samples(cue_rows: DataFrame) -> DataFrame:
    """``cue_rows`` with lat, lon, gps_alt_m and the known fields; a cue without any is dropped.  Of a key's repeated values the last counts."""
    t = bare(F.col("text"))
    rest = F.regexp_replace(t, POSITION + r"[^)]*\)?", " ")
    out = {"lon": F.nullif(F.regexp_extract(t, POSITION, 1), F.lit("")).cast("double"), "lat": F.nullif(F.regexp_extract(t, POSITION, 2), F.lit("")).cast("double"), "gps_alt_m": F.nullif(F.regexp_extract(t, POSITION, 3), F.lit("")).cast("double")}
    for key, name in FIELDS.items():
        pattern = rf"(?:^|[\s,\[]){key.replace('.', chr(92) + '.')}\s*:?\s*(?:1/)?{NUMBER}"
        value = F.try_element_at(F.regexp_extract_all(rest, F.lit(pattern), F.lit(1)), F.lit(-1)).cast("double")
        out[name] = value.cast("int") if name == "iso" else value
    known = F.coalesce(*[F.col(c).cast("double") for c in out]).isNotNull()
    return cue_rows.withColumns(out).where(known)


def summary(rows: DataFrame) -> DataFrame:
    """One row a file: counts, lowest and highest height, mean speed, first fix."""
    return rows.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("sample_count"),
        F.min("height_m").alias("min_height_m"),
        F.max("height_m").alias("max_height_m"),
        F.avg("speed_h_ms").alias("mean_speed_ms"),
        F.min_by(F.struct("lat", "lon"), F.when(F.col("lat").isNotNull() & F.col("lon").isNotNull(), F.col("time_s"))).alias("first_gps"),
    )


def first_source(files: DataFrame | None, *sources: DataFrame) -> DataFrame:
    """Samples of each file from its first source, with ``source_no``.

    Without ``files`` that is the first with a sample.  ``files`` (file_id, source_no) says which sources were
    detected: the first detected one wins even if it turns out to be empty, and the file then has no samples.
    """
    every = reduce(DataFrame.unionByName, (s.withColumn("source_no", F.lit(k)) for k, s in enumerate(sources)))
    first = (every if files is None else files).groupBy("file_id").agg(F.min("source_no").alias("source_no"))
    return every.join(first, ["file_id", "source_no"]).select(*every.columns)


def span_means(spans: DataFrame, frames: DataFrame, metrics: list[str], at: str = "time_s", seconds: float = BUCKET_S, nearest: bool = True, also: dict[str, Column] | None = None, carried: list[str] | None = None) -> DataFrame:
    """(seg_id, frames, means...) over the samples with start <= t < end.  A span without one takes the
    file's sample nearest its start (the earlier of two equally near), and counts 1; a file without any gives 0 and means of 0, as does any empty span if not ``nearest``.

    An interval join: spans are looked up in time buckets of ``seconds`` or, for longer spans, of their own size, so that it is an equi-join
    on file and bucket and no span has more than a few buckets.  Nearest samples come from the last before and the first after in one order
    of the file's samples and empty spans.  ``also`` are more aggregates of the samples inside, by name, over metrics and the
    columns ``carried`` along; they are null without a sample inside.
    """
    more = also or {}
    hit = inside(spans, frames.withColumn("time_s", F.col(at)), [*metrics, *(carried or [])], seconds)
    means = hit.groupBy("seg_id").agg(F.count(F.lit(1)).alias("frames"), *[F.avg(m).alias(m) for m in metrics], *[c.alias(name) for name, c in more.items()])
    found = means
    if nearest:
        empty = spans.join(means.select("seg_id"), "seg_id", "left_anti").select("seg_id", "file_id", F.col("start_s").alias("_t"))
        close = nearest_rows(empty, frames.select("file_id", F.col(at).alias("_t"), F.struct(*metrics).alias("_row")))
        lone = close.where("_row is not null").select("seg_id", F.lit(1).cast("long").alias("frames"), *[F.col(f"_row.{m}").cast("double").alias(m) for m in metrics])
        found = means.unionByName(lone, allowMissingColumns=True)
    return spans.select("seg_id").join(found, "seg_id", "left").select("seg_id", F.coalesce("frames", F.lit(0)).alias("frames"), *[F.coalesce(m, F.lit(0.0)).alias(m) for m in metrics], *more)


def around(targets: DataFrame, rows: DataFrame, ident: str = "seg_id", tie: str | None = None) -> DataFrame:
    """(ident, file_id, _t, before, after) of each target (ident, file_id, _t): the last of the file's rows (file_id, _t, _row) up
    to its time and the first from it on, each as (at, row); of rows at one time the one with the smallest ``tie`` (or value).

    Rows are first one for each time; then one sort of a file's rows and targets carries both.
    """
    one = rows.groupBy("file_id", "_t").agg((F.min("_row") if tie is None else F.min_by("_row", tie)).alias("_row"))
    line = one.select("file_id", "_t", F.struct(F.col("_t").alias("at"), F.col("_row").alias("row")).alias("_here"), F.lit(None).cast(targets.schema[ident].dataType).alias(ident), F.lit(False).alias("_asks"))
    asked = targets.select("file_id", "_t", F.lit(None).cast(line.schema["_here"].dataType).alias("_here"), ident, F.lit(True).alias("_asks"))
    order = Window.partitionBy("file_id").orderBy("_t", "_asks")
    before = F.last("_here", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    # the same sort: a row at the target's own time stands before it
    after = F.coalesce(F.when(F.col("_before.at") == F.col("_t"), F.col("_before")), F.first("_here", ignorenulls=True).over(order.rowsBetween(0, Window.unboundedFollowing)))
    placed = line.unionByName(asked).withColumn("_before", before).withColumn("_after", after)
    return placed.where("_asks").select(ident, "file_id", "_t", F.col("_before").alias("before"), F.col("_after").alias("after"))


def nearest_rows(targets: DataFrame, rows: DataFrame, ident: str = "seg_id", tie: str | None = None) -> DataFrame:
    """(ident, _row) of each target: the file's row nearest in time, the earlier of two equally near; null where the file has none."""
    both = around(targets, rows, ident, tie)
    earlier = F.col("after").isNull() | (F.col("_t") - F.col("before.at") <= F.col("after.at") - F.col("_t"))
    return both.select(ident, F.when(earlier, F.col("before.row")).otherwise(F.col("after.row")).alias("_row"))


def lower_percentile(rows: DataFrame, by: str, value: str, share: float, name: str = "p") -> DataFrame:
    """(by, name): the sorted value at floor((n - 1) * share) within a group, from counts of its values; 0 for a group without any."""
    ranks = value_ranks(rows.where(F.col(value).isNotNull()), [by], value)
    place = F.floor((F.col("n") - 1) * share)
    found = ranks.where((F.col("below") <= place) & (place < F.col("below") + F.col("tied"))).select(by, F.col(value).alias(name))
    return rows.select(by).distinct().join(found, by, "left").select(by, F.coalesce(F.col(name), F.lit(0.0)).alias(name))


def shot_of(spans: DataFrame, shots: DataFrame, at: str = "time_s") -> DataFrame:
    """(seg_id, shot_idx): the shot that holds a time (the first, should shots overlap), else the file's last; null without shots.

    In one order of a file's shots and times, the last shot that began by then either holds the time or, where shots do not
    overlap, none does.
    """
    begun = shots.select("file_id", F.col("start_s").alias("_t"), F.lit(0).alias("_ask"), F.struct("end_s", "shot_idx").alias("_shot"), F.lit(None).cast(dict(spans.dtypes)["seg_id"]).alias("seg_id"))
    asked = spans.select("file_id", F.col(at).alias("_t"), F.lit(1).alias("_ask"), F.lit(None).cast(dict(begun.dtypes)["_shot"]).alias("_shot"), "seg_id")
    order = Window.partitionBy("file_id").orderBy("_t", "_ask")
    open_shot = F.last("_shot", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    last = shots.groupBy("file_id").agg(F.max("shot_idx").alias("_last"))
    placed = begun.unionByName(asked).withColumn("_open", open_shot).where("_ask = 1")
    own = F.when(F.col("_t") < F.col("_open.end_s"), F.col("_open.shot_idx"))
    return placed.join(last, "file_id", "left").select("seg_id", F.coalesce(own, "_last").alias("shot_idx"))


def clamped_index(ident: Column, n: Column) -> Column:
    """The number behind an id's last colon, held to [0, n - 1]; 0 if there is none, -1 without items."""
    number = F.coalesce(F.nullif(F.regexp_extract(ident, r":(\d{1,9})$", 1), F.lit("")).cast("int"), F.lit(0))
    return F.when(n <= 0, F.lit(-1)).otherwise(F.least(F.greatest(number, F.lit(0)), n.cast("int") - 1))


def representative_frames(shots: DataFrame, frames: DataFrame) -> DataFrame:
    """(file_id, shot_idx, frame_idx): the frame nearest a shot's middle, the earlier of two equally near, the first of one time."""
    middle = (F.col("start_s") + F.col("end_s")) / 2
    wanted = shots.select(F.struct("file_id", "shot_idx").alias("_shot"), "file_id", middle.alias("_t"))
    near = nearest_rows(wanted, frames.select("file_id", F.col("time_s").alias("_t"), F.struct("frame_idx").alias("_row")), "_shot")
    return near.where("_row is not null").select("_shot.file_id", "_shot.shot_idx", "_row.frame_idx")
