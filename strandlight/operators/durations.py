"""Durations of selected clips, their alternation, and quantisation to a beat grid."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from strandlight.config import Durations
from strandlight.functions.scalar import clip, snap, snap_down, snap_up
from strandlight.operators.rules import class_value


MOST_ROWS = 1000  # genre rows, whose tempos are written out


def heroes(clips: DataFrame, share: float, by: list[str], score: str = "score", ident: str = "id") -> DataFrame:
    """``hero`` for the best ``floor(share * n)`` clips of each project."""
    part = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(part)
    place = F.row_number().over(part.orderBy(F.coalesce(score, F.lit(0.0)).desc(), ident))
    return clips.withColumn("hero", place <= F.floor(n * share))


def assign(clips: DataFrame, config: Durations, span: str = "span_s", by: list[str] | None = None, fallback: float = 3.0) -> DataFrame:
    """``clips`` with hero, duration_s and duration_reason, before alternation.

    base of the class (0: the fallback) x the score's factor, x the hero factor, held to [min, max] and then to
    the span.
    """
    own = heroes(clips, config.hero_share, by or [])
    base = class_value(config.base_s, F.col("source_class"))
    base = F.when(base > 0, base).otherwise(F.lit(fallback))
    factor = F.lit(config.score_low) + (config.score_high - config.score_low) * clip(F.coalesce("score", F.lit(0.5)), 0.0, 1.0)
    raw = base * factor * F.when(F.col("hero"), config.hero_factor).otherwise(1.0)
    held = F.least(F.greatest(raw, F.lit(config.min_s)), F.lit(config.max_s))
    final = F.least(held, F.col(span))
    reason = F.when(final < held, "clamped").when(held != raw, "clamped").when(F.col("hero"), "hero").otherwise("base")
    return own.withColumns({"duration_s": final, "duration_reason": reason})


def alternate(clips: DataFrame, config: Durations, by: str, order: str = "order", span: str = "span_s") -> DataFrame:
    """(by, order, duration_s) after one pass over each project's triples: three long ones shorten the middle, three
    short ones lengthen it.  A hero in the middle of long ones passes the change on to the third, unless that is one too.

    Every change is seen by the next triple, so projects are read in order as a stream that remembers two clips: linear
    in the clips, and no project has to fit in memory.
    """
    item = [F.col("duration_s").cast("double").alias("d"), class_value(config.base_s, F.col("source_class")).cast("double").alias("b"), F.coalesce("hero", F.lit(False)).alias("h"), F.col(span).cast("double").alias("s")]
    own = clips.select(by, order, *item).repartition(by).sortWithinPartitions(by, order)
    schema = StructType([clips.schema[by], clips.schema[order], StructField("duration_s", DoubleType())])

    def held(d: float, s: float) -> float:
        return min(min(max(d, config.min_s), config.max_s), s)

    def stream(batches):
        last, one, two = None, None, None  # the project, and its last two clips as [order, d, b, h, s]
        for batch in batches:
            out: tuple[list, list, list] = ([], [], [])

            def done(clip):
                for column, value in zip(out, (last, clip[0], clip[1])):
                    column.append(value)

            for project, *clip in zip(*(c.to_pylist() for c in batch.columns)):
                if project != last:
                    for x in (one, two):
                        if x:
                            done(x)
                    last, one, two = project, None, None
                if two is None:
                    one, two = (one, clip) if one else (clip, None)
                    continue
                if one[1] >= one[2] and two[1] >= two[2] and clip[1] >= clip[2]:
                    if not two[3]:
                        two[1] = held(two[1] * config.shorter, two[4])
                    elif not clip[3]:
                        clip[1] = held(clip[1] * config.shorter, clip[4])
                elif one[1] < one[2] and two[1] < two[2] and clip[1] < clip[2]:
                    two[1] = held(two[1] * config.longer, two[4])
                done(one)
                one, two = two, clip
            yield pa.RecordBatch.from_arrays([pa.array(out[0], batch.schema.field(0).type), pa.array(out[1], batch.schema.field(1).type), pa.array(out[2], pa.float64())], names=[by, order, "duration_s"])
            kinds = batch.schema
        rest = [x for x in (one, two) if x]
        if rest:
            yield pa.RecordBatch.from_arrays([pa.array([last] * len(rest), kinds.field(0).type), pa.array([x[0] for x in rest], kinds.field(1).type), pa.array([x[1] for x in rest], pa.float64())], names=[by, order, "duration_s"])

    return own.mapInArrow(stream, schema)


def scale_to_total(clips: DataFrame, total: float, by: list[str], low: float, high: float, span: str = "span_s") -> DataFrame:
    """Durations multiplied to reach a total, each held to [low, high] and its span."""
    now = F.sum("duration_s").over(Window.partitionBy(*by))
    return clips.withColumn("duration_s", F.least(clip(F.col("duration_s") * F.try_divide(F.lit(total), now), low, high), F.col(span)))


def quantise(clips: DataFrame, bpm: float, multiples: tuple, fps: float, span: str = "span_s") -> DataFrame:
    """Clips with beats, beat_duration_s and beat_reason.

    The nearest multiple of a beat, a hero taking the longer of equals and others the shorter; then down to the largest that
    fits the span.  Where none fits, the whole span without beats.  The multiples are written out, so all stays in generated code.
    """
    beat = 60.0 / bpm
    up = sorted({int(m) for m in multiples})
    ratio = F.coalesce(F.col("ratio"), F.lit(1.0))
    gaps = {m: F.abs(F.lit(m * beat) - F.col("duration_s")) for m in up}
    least = F.least(*gaps.values()) if len(up) > 1 else gaps[up[0]]
    first = lambda ms, fits: F.coalesce(*[F.when(fits(m), F.lit(m)) for m in ms])
    close = lambda m: gaps[m] <= F.col("_gap") + 1e-9
    out = clips.withColumn("_gap", least)
    out = out.withColumn("_near", F.when(F.col("hero"), first(up[::-1], close)).otherwise(first(up, close)))
    out = out.withColumn("beats", first(up[::-1], lambda m: (F.col("_near") >= m) & (F.lit(m * beat) / ratio <= F.col(span) + 1e-9)))
    length = F.when(F.col("beats").isNotNull(), F.col("beats") * beat).otherwise(F.col(span) * ratio)
    return out.withColumns({"beat_duration_s": length, "beat_reason": F.when(F.col("beats").isNotNull(), "beat").otherwise("clamped")}).drop("_gap", "_near")


def beat_bounds(clips: DataFrame, fps: float) -> DataFrame:
    """final_start_s on the frame grid, halves to even; rounded down if it would pass the span's end, up if before its start."""
    length, at, grid = F.col("_length"), F.col("final_start_s"), F.lit(fps)
    out = clips.withColumn("_length", F.col("beat_duration_s") / F.coalesce(F.col("ratio"), F.lit(1.0)))
    out = out.withColumn("final_start_s", snap(F.col("center_s") - length / 2, grid))
    out = out.withColumn("final_start_s", F.when(at + length > F.col("end_s"), snap_down(F.col("end_s") - length, grid)).otherwise(at))
    out = out.withColumn("final_start_s", F.when(at < F.col("start_s"), snap_up(F.col("start_s"), grid)).otherwise(at))
    out = out.withColumn("grid_unreachable", at + length > F.col("end_s") + 1e-6)
    out = out.withColumn("final_start_s", F.when(F.col("grid_unreachable"), F.col("start_s")).otherwise(at))
    return out.withColumn("final_end_s", F.round(at + length, 6)).drop("_length")


def compare_bpm(measured: Column, proposed: Column, tolerance: float) -> Column:
    """none, agreed, half, double or drifted, the first that fits."""
    near = lambda a, b: F.abs(a - b) <= tolerance
    return F.when(proposed.isNull() | (proposed <= 0), "none").when(near(measured, proposed), "agreed").when(near(measured * 2, proposed), "half").when(near(measured / 2, proposed), "double").otherwise("drifted")


def propose_bpm(durations: DataFrame, rows: DataFrame, multiples: tuple) -> DataFrame:
    """(row, bpm): the whole tempo of each genre row's range with the least mean distance of the durations to a beat multiple;
    of equals the one nearest the range's middle, then the slower.

    Durations are first reduced to counts of equal values, and each meets the tempos of the genre rows, which are configuration.
    """
    values = durations.groupBy("duration_s").agg(F.count(F.lit(1)).alias("n"))
    found = rows.select("row", "low", "high").limit(MOST_ROWS + 1).collect()
    if len(found) > MOST_ROWS:
        raise ValueError(f"more than {MOST_ROWS} genre rows")
    tempos = [(r["row"], r["low"], r["high"], bpm) for r in found for bpm in range(r["low"], r["high"] + 1)]
    beat = F.lit(60.0) / F.col("bpm")
    gaps = [F.abs(F.col("duration_s") - F.lit(float(m)) * beat) for m in multiples]
    cost = F.least(*gaps) if len(gaps) > 1 else gaps[0]
    every = values.select("*", F.explode(F.array(*[F.struct(F.lit(a).alias("row"), F.lit(b).alias("low"), F.lit(c).alias("high"), F.lit(t).alias("bpm")) for a, b, c, t in tempos])).alias("t")).select("duration_s", "n", "t.*")
    fitted = every.groupBy("row", "low", "high", "bpm").agg((F.sum(cost * F.col("n")) / F.sum("n")).alias("cost"))
    middle = (F.col("low") + F.col("high")) / 2
    return fitted.groupBy("row").agg(F.min_by(F.struct("bpm", F.round("cost", 6).alias("cost")), F.struct(F.round("cost", 9).alias("c"), F.abs(F.col("bpm") - middle).alias("d"), F.col("bpm"))).alias("b")).select("row", "b.bpm", "b.cost")
