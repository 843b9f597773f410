"""Report aggregates and soundtrack signals."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.operators import report, soundtrack, tags
from strandlight.plans.registry import query, table


@query("""
WITH t AS (SELECT doc_id, unnest(list_distinct(string_split(lower(text), ' '))) AS label FROM documents)
SELECT label, count(*) AS total, count_if(doc_id % 3 = 0) AS selected FROM t GROUP BY 1""")
def tag_carried_counts(spark, sf_dir):
    """Labels of whole texts."""
    docs = table(spark, sf_dir, "documents").select(F.split(F.lower("text"), " ", -1).alias("labels"), (F.col("doc_id") % 3 == 0).alias("is_selected"))
    return tags.carried_counts(docs)


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, event_type, n, round(n / sum(n) OVER (PARTITION BY user_id), 3) AS share FROM c QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def dominant_with_tiebreak(spark, sf_dir):
    return report.most_common(table(spark, sf_dir, "events"), ["user_id"], "event_type", "event_id")


@query("SELECT user_id, event_type, count(*) AS n, round(count(*) / sum(count(*)) OVER (PARTITION BY user_id), 3) AS share FROM events GROUP BY 1, 2")
def class_mix_share(spark, sf_dir):
    return report.mix(table(spark, sf_dir, "events"), ["user_id"], "event_type")


BAND = "CASE WHEN hour(ts) >= 5 AND hour(ts) < 9 THEN 'morning' WHEN hour(ts) >= 9 AND hour(ts) < 17 THEN 'daytime' WHEN hour(ts) >= 17 AND hour(ts) < 21 THEN 'evening' ELSE 'night' END"


@query(f"""
WITH b AS (SELECT user_id, {BAND} AS band, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2)
SELECT user_id, band, n, round(n / sum(n) OVER (PARTITION BY user_id), 3) AS share FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1""")
def time_of_day_mode(spark, sf_dir):
    return report.most_common(table(spark, sf_dir, "events").withColumn("band", report.time_band(F.col("ts"))), ["user_id"], "band", "event_id")


@query("""
SELECT c_nationkey AS place_id, count(*) AS segments, count(DISTINCT c_custkey % 20) AS visits, count_if(c_acctbal > 5000) AS selected, round(avg(c_custkey * 0.001), 6) AS lat, round(avg(c_custkey % 180 * 1.0), 6) AS lon, n_name AS name
FROM customer JOIN nation ON n_nationkey = c_nationkey GROUP BY ALL""")
def place_summary(spark, sf_dir):
    s = table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("place_id"), (F.col("c_custkey") % 20).alias("visit_id"), (F.col("c_acctbal") > 5000).alias("is_selected"), (F.col("c_custkey") * 0.001).alias("lat"), (F.col("c_custkey") % 180 * 1.0).alias("lon"))
    names = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("place_id"), F.col("n_name").alias("name"), F.lit("").alias("region"))
    centres = report.place_centroids(s, names).select("place_id", F.round("lat", 6).alias("lat"), F.round("lon", 6).alias("lon"), "name")
    return report.place_summary(s).join(centres, "place_id")


@query("""
SELECT count_if(doc_id % 4 <> 0) AS requests, round(sum(n_chars * 0.001), 4) AS cost, count_if(doc_id % 7 = 0) AS failures, count_if(doc_id % 4 = 0) AS cache_hits FROM documents""")
def describe_usage(spark, sf_dir):
    d = F.col("doc_id")
    out = report.usage(table(spark, sf_dir, "documents").select((d % 4 == 0).alias("cached"), (F.col("n_chars") * 0.001).alias("cost"), (d % 7 == 0).alias("failed")))
    return out.withColumn("cost", F.round("cost", 4))


@query("SELECT count_if(doc_id % 9 <> 0) AS files_analyzed, count_if(doc_id % 2 = 0) AS files_from_cache, count_if(doc_id % 9 = 0) AS files_failed FROM documents")
def run_stats(spark, sf_dir):
    d = F.col("doc_id")
    return report.run_stats(table(spark, sf_dir, "documents").select(F.when(d % 9 == 0, "e").alias("error"), (d % 2 == 0).alias("from_cache")))


#: a row of each kind of condition
GENRES = [
    soundtrack.Genre("ambient", time_of_day=("night",)),
    soundtrack.Genre("surf rock", tags_dominant=("click", "view"), energy=("mid", "high"), tags_any=("signup", "purchase")),
    soundtrack.Genre("electronic", class_min_share={"click": 0.25, "view": 0.2}),
    soundtrack.Genre("cinematic", energy=("high",), region_any=("LAND", "isle")),
    soundtrack.Genre("upbeat folk", time_of_day=("daytime", "morning")),
    soundtrack.Genre("default rock", tags_any=("none of these",)),
]


@query(f"""
WITH t AS (SELECT user_id, event_type AS tag, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), d AS (SELECT user_id, tag, n FROM t QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1),
x AS (SELECT user_id, max(CASE WHEN tag = 'signup' THEN n ELSE 0 END) AS su, max(CASE WHEN tag = 'purchase' THEN n ELSE 0 END) AS pu, round(max(CASE WHEN tag = 'click' THEN n ELSE 0 END) / sum(n), 3) AS cs, round(max(CASE WHEN tag = 'view' THEN n ELSE 0 END) / sum(n), 3) AS vs FROM t GROUP BY 1),
b AS (SELECT user_id, {BAND} AS band, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2), m AS (SELECT user_id, band FROM b QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) = 1),
e AS (SELECT user_id, CASE WHEN avg(value) / 490 < 0.48 THEN 'low' WHEN avg(value) / 490 < 0.52 THEN 'mid' ELSE 'high' END AS en FROM events GROUP BY 1)
SELECT user_id AS project,
  CASE WHEN band = 'night' THEN 'ambient' WHEN tag IN ('click', 'view') AND en <> 'low' AND su + pu > 0 THEN 'surf rock' WHEN cs >= 0.25 AND vs >= 0.2 THEN 'electronic' WHEN en = 'high' AND user_id % 2 = 0 THEN 'cinematic' ELSE 'upbeat folk' END AS "row",
  CASE WHEN band = 'night' THEN 'time of day night (wants night)'
    WHEN tag IN ('click', 'view') AND en <> 'low' AND su + pu > 0 THEN 'dominant tag is ' || tag || ' (wants click, view); ' || CASE WHEN su > 0 AND pu > 0 THEN 'signup, purchase' WHEN su > 0 THEN 'signup' ELSE 'purchase' END || ' present; energy ' || en || ' (wants mid or high)'
    WHEN cs >= 0.25 AND vs >= 0.2 THEN printf('click share %.2f (wants 0.25); view share %.2f (wants 0.20)', cs, vs) WHEN en = 'high' AND user_id % 2 = 0 THEN 'energy high (wants high); region LAND'
    WHEN band IN ('daytime', 'morning') THEN 'time of day ' || band || ' (wants daytime or morning)' ELSE 'no row matched, so the default profile ''upbeat folk'' was used' END AS reason,
  band IN ('night', 'daytime', 'morning') OR (tag IN ('click', 'view') AND en <> 'low' AND su + pu > 0) OR (cs >= 0.25 AND vs >= 0.2) OR (en = 'high' AND user_id % 2 = 0) AS matched
FROM d JOIN x USING (user_id) JOIN m USING (user_id) JOIN e USING (user_id)""")
def genre_match(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    tag = report.most_common(e, ["user_id"], "event_type", "event_id").select("user_id", F.col("event_type").alias("dominant_tag"))
    band = report.most_common(e.withColumn("band", report.time_band(F.col("ts"))), ["user_id"], "band", "event_id").select("user_id", F.col("band").alias("time_of_day"))
    listed = report.mix(e, ["user_id"], "event_type").groupBy("user_id").agg(F.map_from_entries(F.collect_list(F.struct("event_type", "n"))).alias("tags"), F.map_from_entries(F.collect_list(F.struct("event_type", "share"))).alias("class_mix"))
    mean = F.avg("value") / 490
    energy = e.groupBy("user_id").agg(F.when(mean < 0.48, "low").when(mean < 0.52, "mid").otherwise("high").alias("energy_band"))
    signals = tag.join(band, "user_id").join(listed, "user_id").join(energy, "user_id").withColumn("regions", F.when(F.col("user_id") % 2 == 0, F.array(F.lit("Highlands"), F.lit("Somerset"))).otherwise(F.array().cast("array<string>")))
    return soundtrack.genre_match(signals.withColumnRenamed("user_id", "project"), GENRES)
