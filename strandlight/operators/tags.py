"""Zero-shot tags, tag lists, provider answers, the aesthetic head."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, IntegerType, StringType, StructField, StructType

from strandlight.functions.scalar import clip, dot, finite_in, l2_normalise

TAGS = "array<struct<label:string,confidence:double,source:string,group:string,primary:boolean>>"


MOST_LABELS = 10_000  # of the configuration table of labels, more are refused


def zero_shot(vectors: DataFrame, labels: DataFrame, scale: float, threshold: float, most: int, ident: str = "seg_id") -> DataFrame:
    """(id, label, confidence, primary, place) of the labels kept.

    ``labels`` (group, label, vector, primary; a null label is a group's "none of these") is a configuration table.
    Within a group, softmax over scale x dot; a label stays at ``threshold`` or more and above the null label.  Across groups the
    most confident primary one comes first, then by confidence; ``most`` at most.  Batches of vectors are multiplied with all labels at once; a
    vector that is null, holds nulls or has another length than the labels' gets none.
    """
    table = labels.select("group", "label", F.col("vector").cast("array<double>").alias("vector"), "primary").limit(MOST_LABELS + 1).collect()
    if len(table) > MOST_LABELS:
        raise ValueError(f"more than {MOST_LABELS} labels")
    width = len(table[0]["vector"]) if table else 0
    matrix = np.array([r["vector"] for r in table], float).reshape(len(table), width)
    groups = [np.array([k for k, r in enumerate(table) if r["group"] == g]) for g in dict.fromkeys(r["group"] for r in table)]
    named = np.array([r["label"] is not None for r in table], bool)
    names = [r["label"] for r in table]
    leading = [bool(r["primary"]) for r in table]

    def tag(batches):
        for batch in batches:
            out: tuple[list, list, list, list, list] = ([], [], [], [], [])
            own = [k for k, v in enumerate(batch.column(1)) if v.is_valid and len(v) == width and v.values.null_count == 0]
            if own and len(table):
                x = np.stack([batch.column(1)[k].values.to_numpy(zero_copy_only=False) for k in own]) @ matrix.T * scale
                shares, keep = np.zeros_like(x), np.zeros(x.shape, bool)
                for g in groups:
                    e = np.exp(x[:, g] - x[:, g].max(axis=1, keepdims=True))
                    p = e / e.sum(axis=1, keepdims=True)
                    none = p[:, ~named[g]].max(axis=1, initial=0.0)
                    shares[:, g], keep[:, g] = p, named[g] & (p >= threshold) & (p > none[:, None])
                for n, k in enumerate(own):
                    found = sorted(np.flatnonzero(keep[n]).tolist(), key=lambda j: (not leading[j], -round(shares[n, j], 9), names[j]))
                    first = found[:1] if found and leading[found[0]] else []
                    rest = sorted((j for j in found if j not in first), key=lambda j: (-round(shares[n, j], 9), names[j]))
                    for place, j in enumerate((first + rest)[:most], 1):
                        for column, value in zip(out, (batch.column(0)[k], names[j], float(shares[n, j]), leading[j], place)):
                            column.append(value)
            ids = pa.array([i.as_py() for i in out[0]], batch.schema.field(0).type)
            yield pa.RecordBatch.from_arrays([ids, pa.array(out[1], pa.string()), pa.array(out[2], pa.float64()), pa.array(out[3], pa.bool_()), pa.array(out[4], pa.int32())], names=[ident, "label", "confidence", "primary", "place"])

    schema = StructType([vectors.schema[ident], StructField("label", StringType()), StructField("confidence", DoubleType()), StructField("primary", BooleanType()), StructField("place", IntegerType())])
    return vectors.select(ident, F.col("vector").cast("array<double>").alias("vector")).mapInArrow(tag, schema)


def dominant_tag(tags: Column) -> Column:
    """The first primary cloud tag in list order, else the most confident primary one (first of equals), else null."""
    primary = F.filter(tags, lambda t: t["primary"])
    cloud = F.filter(primary, lambda t: t["source"] == "cloud")
    best = F.array_max(F.transform(primary, lambda t: t["confidence"]))
    first = F.try_element_at(F.filter(primary, lambda t: t["confidence"] == best), F.lit(1))
    return F.coalesce(F.try_element_at(cloud, F.lit(1))["label"], first["label"])


def secondary_tags(tags: Column) -> Column:
    return F.filter(tags, lambda t: ~t["primary"])


def replace_source(old: Column, new: Column, source: str) -> Column:
    """Tags of other sources kept, those of ``source`` replaced; cloud tags first."""
    both = F.concat(F.filter(F.coalesce(old, F.array().cast(TAGS)), lambda t: t["source"] != source), F.coalesce(new, F.array().cast(TAGS)))
    return F.concat(F.filter(both, lambda t: t["source"] == "cloud"), F.filter(both, lambda t: t["source"] != "cloud"))


def carried_counts(segments: DataFrame, labels: str = "labels", selected: str = "is_selected") -> DataFrame:
    """(label, total, selected): how many segments carry each label, each label once a segment."""
    single = segments.select(F.explode(F.array_distinct(labels)).alias("label"), F.col(selected).alias("_s"))
    return single.groupBy("label").agg(F.count(F.lit(1)).alias("total"), F.count_if("_s").alias("selected"))


def valid_answer(answers: DataFrame) -> DataFrame:
    """Parsed provider answers: up to five lower-case tags, a caption of up to 20 words without a last dot, a mark in 1..10;
    ``problem`` where nothing is left."""
    from strandlight.functions.scalar import bare_json

    parsed = answers.withColumn("_j", F.from_json(bare_json(F.col("answer")), "tags array<string>, caption string, aesthetic double"))
    tags = F.slice(F.array_distinct(F.filter(F.transform(F.coalesce("_j.tags", F.array().cast("array<string>")), lambda t: F.lower(F.btrim(t))), lambda t: t.isNotNull() & (t != ""))), 1, 5)
    words = F.slice(F.filter(F.split(F.btrim(F.coalesce("_j.caption", F.lit(""))), r"\s+"), lambda w: w != ""), 1, 20)
    caption = F.nullif(F.regexp_replace(F.array_join(words, " "), r"\.+$", ""), F.lit(""))
    mark = finite_in(F.col("_j.aesthetic"), float("-inf"), float("inf"))
    mark = F.when(mark.isNotNull(), clip(mark, 1.0, 10.0))
    out = parsed.withColumns({"tags": tags, "caption": caption, "aesthetic": mark}).drop("_j")
    return out.withColumn("problem", F.when((F.size("tags") == 0) & F.col("caption").isNull() & F.col("aesthetic").isNull(), "empty answer"))


def aesthetic(vector: Column, weights: list[float], bias: float, cloud: Column | None = None) -> Column:
    """A linear head over the unit vector, held to 1..10 and scaled to 0.1..1; a cloud value wins."""
    own = clip(dot(l2_normalise(vector), F.array(*[F.lit(float(w)) for w in weights])) + bias, 1.0, 10.0) / 10
    return own if cloud is None else F.coalesce(cloud, own)
