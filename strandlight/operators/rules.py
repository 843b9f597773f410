"""Row rules: rejection, policy, classification, trims, grid filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from strandlight.config import CLASSES, Rules
from strandlight.functions.scalar import glob_pattern

#: Fixed values, in the order in which they are tried: recording kinds that decide alone, marks in make, model or
#: encoder texts, makers of cameras, keys of container tags that only phones write, and beginnings of file names.
TELEMETRY_CLASSES = {"dji_embedded_srt": "drone", "dji_sidecar_srt": "drone", "gopro_gpmf": "actioncam"}
ACTIONCAM_MARKERS = ("osmoaction", "gopro", "insta360", "hero")
CAMERA_MAKERS = ("fujifilm", "sony", "canon", "nikon", "panasonic", "olympus", "leica")
PHONE_KEYS = ("com.android.manufacturer", "com.apple.quicktime.make")
NAME_PREFIXES = {"GX": "actioncam", "GH": "actioncam", "GOPR": "actioncam", "DJI_": "drone", "IMG_": "phone", "VID_": "phone", "PXL_": "phone", "DSC": "reflex"}

MOST_OVERRIDES = 10_000  # rules of the override table, which becomes one expression


def class_value(table: dict, source_class: Column) -> Column:
    """The table's value for a class; an unknown class counts as generic."""
    pairs = F.create_map(*[x for c in CLASSES for x in (F.lit(c), F.lit(table[c]))])
    return F.coalesce(F.try_element_at(pairs, source_class), F.lit(table["generic"]))


def rejection_reason(rules: Rules, length: Column, heights: Column, max_height: Column, clipped: Column, motion: Column, stability: Column) -> Column:
    """The first rule that a segment breaks, else null.  A metric that is null breaks none."""
    return (
        F.when(length < rules.min_segment_s, "too_short")
        .when((heights > 0) & (max_height < rules.min_height_m), "low_altitude")
        .when(clipped > rules.max_clipped, "clipped")
        .when(motion < rules.min_motion, "no_motion")
        .when((stability < rules.min_stability) & (motion >= rules.shaky_min_motion), "shaky")
    )


def exclude_vertical(segments: DataFrame, strategy: str, vertical: Column) -> DataFrame:
    """Under the strategy ``exclude``, vertical candidates get the reason ``vertical``; they stay candidates."""
    hit = F.lit(strategy == "exclude") & (F.col("outcome") == "candidate") & F.coalesce(vertical, F.lit(False))
    return segments.withColumn("reason", F.when(hit, "vertical").otherwise(F.col("reason")))


def phone_keys(format_tags: Column) -> Column:
    """Whether a map of container tags has a key, in any case, that only phones write."""
    return F.coalesce(F.exists(F.map_keys(format_tags), lambda k: F.lower(k).isin(*PHONE_KEYS)), F.lit(False))


def class_signals(fps_threshold: float) -> list[tuple[str, Column]]:
    """(signal, class it gives or null) in order of strength, over the columns of a probed file."""

    def text(name: str) -> Column:
        return F.lower(F.coalesce(F.col(name), F.lit("")))

    def any_of(words: tuple[str, ...], where: Column) -> Column:
        return reduce(Column.__or__, (F.contains(where, F.lit(w)) for w in words))

    def given(kind: str, condition: Column) -> Column:
        return F.when(condition, F.lit(kind))

    name = F.upper(F.element_at(F.split("path", "/"), -1))
    table = F.create_map(*[F.lit(x) for pair in TELEMETRY_CLASSES.items() for x in pair])
    return [
        ("telemetry", F.try_element_at(table, F.coalesce("telemetry", F.lit("none")))),
        ("make_tag", given("actioncam", any_of(ACTIONCAM_MARKERS, F.concat_ws(" ", text("make"), text("model"), text("encoder"))))),
        ("manufacturer_tag", given("phone", F.col("phone_keys"))),
        ("make_tag", given("reflex", any_of(CAMERA_MAKERS, text("make")))),
        ("aspect", given("phone", F.col("is_vertical"))),
        ("fps", given("actioncam", F.col("fps") >= fps_threshold)),
        ("filename", F.coalesce(*[given(kind, F.startswith(name, F.lit(start))) for start, kind in NAME_PREFIXES.items()])),
        ("default", F.lit("generic")),
    ]


def classify(overrides: DataFrame | None, files: DataFrame, fps_threshold: float = 100.0) -> DataFrame:
    """``files`` with source_class, class_signal and class_overridden: the first signal that speaks.

    ``files`` has path, telemetry, make, model, encoder, phone_keys, is_vertical and fps.  ``overrides`` (rule_no, pattern as a regular expression,
    class) is a table of MOST_OVERRIDES rules at most, more are refused; the last rule that matches wins.
    """
    signals = class_signals(fps_threshold)
    guess = F.coalesce(*[F.when(kind.isNotNull(), F.struct(kind.alias("kind"), F.lit(signal).alias("signal"))) for signal, kind in signals])
    by_hand = F.lit(None).cast("string")
    if overrides is not None:
        rows = overrides.orderBy("rule_no").limit(MOST_OVERRIDES + 1).collect()
        if len(rows) > MOST_OVERRIDES:
            raise ValueError(f"more than {MOST_OVERRIDES} override rules")
        matching = [F.when(F.col("path").rlike(r["pattern"]), F.lit(r["class"])) for r in reversed(rows)]
        by_hand = F.coalesce(*matching) if matching else by_hand
    out = files.withColumns({"_guess": guess, "_hand": by_hand})
    own = F.col("_hand").isNotNull()
    return out.select(*files.columns, F.coalesce("_hand", "_guess.kind").alias("source_class"), F.when(own, "override").otherwise(F.col("_guess.signal")).alias("class_signal"), own.alias("class_overridden"))


def override_rules(spark, rules: list[tuple[str, str]]) -> DataFrame:
    """(rule_no, pattern, class) of ordered (glob, class) pairs."""
    return spark.createDataFrame([(i, glob_pattern(g), c) for i, (g, c) in enumerate(rules)], "rule_no int, pattern string, class string")


def trimmed(start: Column, end: Column, total: Column, head: Column, tail: Column) -> tuple[Column, Column]:
    """A span held to [min(head, total), max(low, total - tail)]; nulls where nothing is left."""
    low = F.least(head, total)
    high = F.greatest(low, total - tail)
    s, e = F.greatest(start, low), F.least(end, high)
    return F.when(e > s, s), F.when(e > s, e)


def grid_filter(segments: DataFrame, outcomes=None, classes=None, tag=None, place=None, reasons=None, score=(0.0, 1.0), hide_rejected=True) -> DataFrame:
    """Rows that pass every filter set.  A score range other than 0 to 1 passes unscored rows too."""
    keep = F.lit(True)
    if outcomes:
        keep &= F.col("outcome").isin(*outcomes)
    elif hide_rejected:
        keep &= F.col("outcome") != "rejected"
    if classes:
        keep &= F.col("source_class").isin(*classes)
    if tag is not None:
        keep &= F.exists("tags", lambda t: t["label"] == tag)
    if place is not None:
        keep &= F.col("place_id") == place
    if reasons:
        keep &= F.col("reason").isin(*reasons)
    if tuple(score) != (0.0, 1.0):
        keep &= F.col("score").isNull() | F.col("score").between(*score)
    return segments.where(F.coalesce(keep, F.lit(False)))


def effective_bounds(segments: DataFrame) -> DataFrame:
    """effective_start_s, effective_end_s, effective_center_s: hand bounds, else trims, else the raw span."""
    user = F.col("user_start_s").isNotNull() & F.col("user_end_s").isNotNull() & (F.col("user_end_s") > F.col("user_start_s"))
    start = F.when(user, F.col("user_start_s")).otherwise(F.coalesce("trimmed_start_s", "start_s"))
    end = F.when(user, F.col("user_end_s")).otherwise(F.coalesce("trimmed_end_s", "end_s"))
    center = F.when(user | F.col("best_center_s").isNull(), (start + end) / 2).otherwise(F.col("best_center_s"))
    return segments.withColumns({"effective_start_s": start, "effective_end_s": end, "effective_center_s": center})


def reset(segments: DataFrame) -> DataFrame:
    """Before a new selection: selected rows are candidates again, rejections stay, all that a selection wrote is cleared."""
    cleared = {c: F.lit(None).cast(t) for c, t in segments.dtypes if c in ("order", "cluster_id", "place_id", "visit_id", "lost_to", "similarity_to_selected", "held_by")}
    policy = F.when(F.col("reason").isin("vertical", "place_cap"), F.lit(None)).otherwise(F.col("reason"))
    return segments.withColumns(cleared | {"outcome": F.when(F.col("outcome") == "selected", "candidate").otherwise(F.col("outcome")), "reason": policy})


def decided(segments: DataFrame, decisions: DataFrame) -> DataFrame:
    """Hand decisions joined on: a rejection rejects, a keep makes a candidate, ``clear`` removes an earlier decision."""
    own = decisions.select("seg_id", F.nullif("decision", F.lit("clear")).alias("user_decision"), "user_start_s", "user_end_s")
    joined = segments.drop("user_decision", "user_start_s", "user_end_s").join(own, "seg_id", "left")
    outcome = F.when(F.col("user_decision") == "reject", "rejected").when(F.col("user_decision") == "keep", "candidate").otherwise(F.col("outcome"))
    return joined.withColumn("outcome", outcome)
