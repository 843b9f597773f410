"""Scoring, rules and joins over segments.

Stand-ins: a line item is a segment of its order's recording; its return flag is the source class;
quantity, discount, price and tax are metrics.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.config import Config, Durations, Rules, Weights, per_class
from strandlight.functions import scalar as S
from strandlight.operators import report, rules, scoring, telemetry
from strandlight.plans.registry import query, table


def segments(spark, sf_dir):
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws(":", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"),
        F.col("l_orderkey").alias("file_id"),
        F.col("l_returnflag").alias("source_class"),
        F.col("l_quantity").alias("sharpness"),
        F.col("l_discount").alias("exposure_clipped"),
        F.col("l_extendedprice").alias("motion"),
        F.col("l_tax").alias("stability"),
    )


RANK = "CASE WHEN count(*) OVER (PARTITION BY c) = 1 THEN 0.5 ELSE (rank() OVER (PARTITION BY c ORDER BY {m}) - 1 + (count(*) OVER (PARTITION BY c, {m}) - 1) / 2.0) / (count(*) OVER (PARTITION BY c) - 1) END"


@query(f"""
WITH s AS (SELECT l_orderkey || ':' || l_linenumber AS id, coalesce(o_orderpriority, 'generic') AS c, l_quantity AS q, l_discount AS d, l_extendedprice AS p
           FROM lineitem LEFT JOIN orders ON l_orderkey = o_orderkey),
r AS (SELECT id, c, {RANK.format(m='q')} AS rq, {RANK.format(m='d')} AS rd, {RANK.format(m='p')} AS rp FROM s)
SELECT id, c AS source_class, round((rq + 0.5 * (1 - rd) + rp) / 2.5, 6) AS score FROM r""")
def score_rank_by_class(spark, sf_dir):
    files = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("file_id"), F.col("o_orderpriority").alias("source_class"))
    own = segments(spark, sf_dir).drop("source_class").join(files, "file_id", "left").withColumn("source_class", F.coalesce("source_class", F.lit("generic")))
    scored = scoring.composite_score(own, {"sharpness": 1.0, "exposure_clipped": 0.5, "motion": 1.0})
    return scored.select("id", "source_class", F.round("score", 6).alias("score"))


@query(f"""
WITH d AS (SELECT doc_id AS id, lang AS c, n_chars AS m, quality AS a FROM documents LEFT JOIN labels USING (doc_id)),
r AS (SELECT id, c, {RANK.format(m='m')} AS rm, {RANK.format(m='a')} AS ra,
      count(a) OVER (PARTITION BY c) = count(*) OVER (PARTITION BY c) AS use_a FROM d)
SELECT id, c AS source_class, round(CASE WHEN use_a THEN (rm + ra) / 2 ELSE rm END, 6) AS score FROM r""")
def score_metric_dropped_on_null(spark, sf_dir):
    labels = table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("aesthetic"))
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("lang").alias("source_class"), F.col("n_chars").alias("motion")).join(labels, "doc_id", "left")
    scored = scoring.composite_score(docs, {"motion": 1.0, "aesthetic": 1.0})
    return scored.select(F.col("doc_id").alias("id"), "source_class", F.round("score", 6).alias("score"))


@query(f"""
WITH s AS (SELECT l_orderkey || ':' || l_linenumber AS id, l_returnflag AS c, l_quantity AS q, l_extendedprice AS p FROM lineitem),
r AS (SELECT id, c, {RANK.format(m='q')} AS rq, {RANK.format(m='p')} AS rp FROM s)
SELECT id, c AS source_class, round((2 * rq + 0.5 * rp) / 2.5, 6) AS score FROM r""")
def rescore_with_weights(spark, sf_dir):
    """New weights over stored metrics, through the rank by value counts that needs no task for a whole class."""
    scored = scoring.composite_score(segments(spark, sf_dir), {"sharpness": 2.0, "motion": 0.5}, window_rows=0)
    return scored.select("id", "source_class", F.round("score", 6).alias("score"))


@query("""
WITH f AS (SELECT event_id, event_type AS c, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events),
r AS (SELECT event_id, c, count(*) OVER (PARTITION BY c) AS n, percent_rank() OVER (PARTITION BY c ORDER BY v) AS a, percent_rank() OVER (PARTITION BY c ORDER BY k) AS b FROM f)
SELECT event_id, c AS source_class, round(CASE WHEN n < 2 THEN 0.5 ELSE (a + 0.5 * b) / 1.5 END, 6) AS frame_score FROM r""")
def frame_norm_scores(spark, sf_dir):
    frames = table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("source_class"), F.col("value").alias("motion"), F.get_json_object("props", "$.k").cast("double").alias("sharpness"))
    return scoring.frame_scores(frames, {"motion": 1.0, "sharpness": 0.5}).select("event_id", "source_class", F.round("frame_score", 6).alias("frame_score"))


@query("""
WITH u AS (SELECT user_id, count(*) AS n, count(value) AS h, max(value) AS mx, avg(value) AS av, min(value) AS mn,
           stddev_pop(value) AS sd FROM events GROUP BY user_id)
SELECT user_id, CASE WHEN n * 1.0 < 45 THEN 'too_short' WHEN h > 0 AND mx < 480 THEN 'low_altitude' WHEN mn / 490 > 0.02 THEN 'clipped'
  WHEN av / 490 < 0.19 THEN 'no_motion' WHEN 1 - sd / av < 0.2 AND av / 490 >= 0.2 THEN 'shaky' END AS reason FROM u""")
def reject_rules_case(spark, sf_dir):
    own = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("h"), F.max("value").alias("mx"), F.avg("value").alias("av"), F.min("value").alias("mn"), F.stddev_pop("value").alias("sd"))
    limits = Rules(min_height_m=480.0, min_motion=0.19, shaky_min_motion=0.2, min_stability=0.2, max_clipped=0.02, min_segment_s=45.0)
    reason = rules.rejection_reason(limits, F.col("n") * 1.0, F.col("h"), F.col("mx"), F.col("mn") / 490, F.col("av") / 490, 1 - F.try_divide("sd", "av"))
    return own.select("user_id", reason.alias("reason"))


#: probed files by page_id % 16: (telemetry, make, model, encoder, phone keys, vertical, fps, name), and the class and signal each has
PROBED = (
    (("dji_embedded_srt", None, None, None, False, False, 30.0, "DJI_0744.MP4"), ("drone", "telemetry")),
    (("dji_sidecar_srt", "FUJIFILM", None, None, False, True, 240.0, "clip.mp4"), ("drone", "telemetry")),
    (("gopro_gpmf", None, None, None, False, False, 30.0, "clip.mp4"), ("actioncam", "telemetry")),
    (("none", None, None, "DJI OsmoAction4", False, False, 50.0, "DJI_0194_D.MP4"), ("actioncam", "make_tag")),
    (("none", None, "HERO12 Black", None, False, False, 30.0, "clip.mp4"), ("actioncam", "make_tag")),
    (("none", "Xiaomi", "2312DRA50G", None, True, False, 30.0, "VID_20250720_211104.mp4"), ("phone", "manufacturer_tag")),
    (("none", "Xiaomi", None, None, False, False, 30.0, "clip.mp4"), ("generic", "default")),
    (("none", "FUJIFILM", None, None, False, False, 30.0, "VID_0001.mp4"), ("reflex", "make_tag")),
    (("none", None, None, None, False, True, 30.0, "clip.mp4"), ("phone", "aspect")),
    (("none", None, None, None, False, False, 240.0, "clip.mp4"), ("actioncam", "fps")),
    (("none", None, None, None, False, False, 30.0, "GX010001.MP4"), ("actioncam", "filename")),
    (("none", None, None, None, False, False, 30.0, "gh010001.mp4"), ("actioncam", "filename")),
    (("none", None, None, None, False, False, 30.0, "VID_0001.mp4"), ("phone", "filename")),
    (("none", None, None, None, False, False, 30.0, "DSC_0001.MOV"), ("reflex", "filename")),
    (("none", None, None, None, False, False, 30.0, "MVI_0001.MOV"), ("generic", "default")),
    ((None, None, "osmo action", None, False, False, 30.0, "clip0001.mp4"), ("generic", "default")),
)
CLASSED = ", ".join(f"({k}, '{kind}', '{signal}')" for k, (_, (kind, signal)) in enumerate(PROBED))


@query(f"""
WITH t AS (SELECT * FROM (VALUES {CLASSED}) t(k, kind, signal))
SELECT page_id, CASE WHEN page_id % 5 = 0 THEN 'drone' WHEN page_id % 10 < 3 THEN 'phone' ELSE kind END AS source_class, CASE WHEN page_id % 5 = 0 OR page_id % 10 < 3 THEN 'override' ELSE signal END AS class_signal, page_id % 5 = 0 OR page_id % 10 < 3 AS class_overridden
FROM pages JOIN t ON k = page_id % 16""")
def classify_first_match(spark, sf_dir):
    """Probed files whose classes are known; below the folder trip an override applies, and below trip/drone a later one."""
    names = ("telemetry", "make", "model", "encoder", "phone_keys", "is_vertical", "fps", "name")
    kinds = ("string", "string", "string", "string", "boolean", "boolean", "double", "string")
    row = F.lit(None)
    for k, (values, _) in enumerate(PROBED):
        row = F.when(F.col("page_id") % 16 == k, F.struct(*[F.lit(v).cast(t).alias(n) for v, t, n in zip(values, kinds, names)])).otherwise(row)
    folder = F.when(F.col("page_id") % 5 == 0, "trip/drone/").when(F.col("page_id") % 10 < 3, "trip/").otherwise("other/")
    files = table(spark, sf_dir, "pages").select("page_id", row.alias("r"), folder.alias("f")).select("page_id", "r.*", "f").withColumn("path", F.concat("f", "name"))
    overrides = rules.override_rules(spark, [("trip/**", "phone"), ("trip/drone/**", "drone")])
    return rules.classify(overrides, files).select("page_id", "source_class", "class_signal", "class_overridden")


@query("""
SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 THEN 'rejected' ELSE 'candidate' END AS outcome,
  CASE WHEN doc_id % 5 = 0 THEN 'clipped' WHEN n_chars > 1000 THEN 'vertical' END AS reason FROM documents""")
def policy_exclusion(spark, sf_dir):
    rejected = F.col("doc_id") % 5 == 0
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "n_chars", F.when(rejected, "rejected").otherwise("candidate").alias("outcome"), F.when(rejected, "clipped").alias("reason"))
    return rules.exclude_vertical(docs, "exclude", S.is_vertical(F.lit(1000), F.col("n_chars"), F.lit(0))).select("id", "outcome", "reason")


@query("""
SELECT o_orderkey AS id, coalesce(c_mktsegment, 'generic') AS source_class FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_custkey % 3 <> 0) ON o_custkey = c_custkey""")
def file_left_join_default(spark, sf_dir):
    files = table(spark, sf_dir, "customer").where(F.col("c_custkey") % 3 != 0).select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, sf_dir, "orders").join(files, "o_custkey", "left").select(F.col("o_orderkey").alias("id"), F.coalesce("c_mktsegment", F.lit("generic")).alias("source_class"))


TIMED = "SELECT event_id, user_id, date_diff('microsecond', min(ts) OVER (PARTITION BY user_id), ts) / 1000000.0 AS t, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"


def timed(spark, sf_dir):
    """Events of a user as the samples of a recording: seconds since the first, value, k."""
    from pyspark.sql import Window

    us = F.unix_micros(F.col("ts").cast("timestamp"))
    return table(spark, sf_dir, "events").select("event_id", "user_id", ((us - F.min(us).over(Window.partitionBy("user_id"))) / 1000000.0).cast("double").alias("t"), "value", F.get_json_object("props", "$.k").cast("double").alias("k"))


@query(f"""
WITH e AS ({TIMED}),
s AS (SELECT DISTINCT user_id, i, user_id || ':' || i AS seg_id, i * 200000.0 AS a, i * 200000.0 + 150000.0 AS b FROM e, range(13) t(i)),
h AS (SELECT s.seg_id, s.user_id, a, count(e.t) AS frames, avg(value) AS v, avg(k) AS k FROM s LEFT JOIN e ON e.user_id = s.user_id AND t >= a AND t < b GROUP BY ALL),
x AS (SELECT seg_id, e.value AS v, e.k FROM h JOIN e USING (user_id) WHERE frames = 0 QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY abs(t - a), t, e.value, e.k) = 1)
SELECT h.seg_id, greatest(frames, 1) AS frames, round(coalesce(h.v, x.v), 6) AS value, round(coalesce(h.k, x.k), 6) AS k FROM h LEFT JOIN x USING (seg_id)""")
def span_metrics_interval_join(spark, sf_dir):
    """Means over spans; a span without an event takes the one nearest its start."""
    e = timed(spark, sf_dir).select(F.col("user_id").alias("file_id"), F.col("t").alias("time_s"), "value", "k")
    spans = e.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(0), F.lit(12))).alias("i"))
    spans = spans.select(F.concat_ws(":", "file_id", "i").alias("seg_id"), "file_id", (F.col("i") * 200000.0).alias("start_s"), (F.col("i") * 200000.0 + 150000.0).alias("end_s"))
    out = telemetry.span_means(spans, e, ["value", "k"], seconds=200000.0)
    return out.select("seg_id", "frames", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"))


@query("""
SELECT l_returnflag, list_sort(list(l_quantity))[CAST(floor((count(*) - 1) * 0.75) AS INT) + 1] AS faces FROM lineitem GROUP BY 1""")
def face_percentile_lower(spark, sf_dir):
    """A value count first, so that a group's list holds distinct values only."""
    counts = table(spark, sf_dir, "lineitem").groupBy("l_returnflag", F.col("l_quantity").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    from pyspark.sql import Window

    w = Window.partitionBy("l_returnflag").orderBy("v")
    total = F.sum("n").over(Window.partitionBy("l_returnflag"))
    placed = counts.select("l_returnflag", "v", F.sum("n").over(w).alias("upto"), F.floor((total - 1) * 0.75).alias("k"))
    return placed.where(F.col("upto") > F.col("k")).groupBy("l_returnflag").agg(F.min("v").alias("faces"))


@query("""
WITH g AS (SELECT user_id % 50 AS g, value FROM events)
SELECT g, list_sort(list(value))[CAST(floor((count(*) - 1) * 0.75) AS INT) + 1] AS p FROM g GROUP BY 1""")
def percentile_lower(spark, sf_dir):
    return telemetry.lower_percentile(table(spark, sf_dir, "events").select((F.col("user_id") % 50).alias("g"), "value"), "g", "value", 0.75)


@query("""
SELECT coalesce(l_returnflag, 'all') AS l_returnflag, round(quantile_cont(l_extendedprice, 0.05), 4) AS p5, round(quantile_cont(l_extendedprice, 0.10), 4) AS p10, round(quantile_cont(l_extendedprice, 0.25), 4) AS p25,
  round(quantile_cont(l_extendedprice, 0.50), 4) AS p50, round(quantile_cont(l_extendedprice, 0.75), 4) AS p75, round(quantile_cont(l_extendedprice, 0.95), 4) AS p95
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), ())""")
def metric_percentiles_rollup(spark, sf_dir):
    out = report.metric_percentiles(table(spark, sf_dir, "lineitem"), "l_extendedprice", "l_returnflag")
    return out.select("l_returnflag", *[F.round(c, 4).alias(c) for c in out.columns[1:]])


@query("""
WITH s AS (SELECT CASE WHEN l_linestatus = 'O' THEN 'selected' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'candidate' END AS outcome,
                  CASE WHEN l_linestatus <> 'O' AND l_returnflag = 'R' THEN l_returnflag || '_rule' END AS reason, l_quantity AS s FROM lineitem)
SELECT 'outcome' AS grain, outcome AS key, count(*) AS n, sum(s) AS seconds FROM s GROUP BY outcome
UNION ALL SELECT 'reason', reason, count(*), sum(s) FROM s GROUP BY reason UNION ALL SELECT 'all', NULL, count(*), sum(s) FROM s""")
def report_counts_grouping_sets(spark, sf_dir):
    chosen, bad = F.col("l_linestatus") == "O", F.col("l_returnflag") == "R"
    own = table(spark, sf_dir, "lineitem").select(F.when(chosen, "selected").when(bad, "rejected").otherwise("candidate").alias("outcome"), F.when(~chosen & bad, F.concat("l_returnflag", F.lit("_rule"))).alias("reason"), F.col("l_quantity").alias("seconds"))
    return report.header_counts(own)


@query("""
WITH s AS (SELECT l_orderkey || ':' || l_linenumber AS id, l_quantity AS a, l_quantity + l_linenumber AS b, l_tax * 100 AS head, l_quantity + 3 AS total FROM lineitem),
t AS (SELECT id, greatest(a, least(head, total)) AS s, least(b, greatest(least(head, total), total - 0.5)) AS e FROM s)
SELECT id, round(CASE WHEN e > s THEN s END, 6) AS trimmed_start_s, round(CASE WHEN e > s THEN e END, 6) AS trimmed_end_s FROM t""")
def trims(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    s, e = rules.trimmed(F.col("l_quantity"), F.col("l_quantity") + F.col("l_linenumber"), F.col("l_quantity") + 3, F.col("l_tax") * 100, F.lit(0.5))
    return li.select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.round(s, 6).alias("trimmed_start_s"), F.round(e, 6).alias("trimmed_end_s"))


@query("""
SELECT doc_id AS id FROM documents WHERE source IN ('src0', 'src1', 'src2') AND list_contains(string_split(lower(text), ' '), 'the') AND lang = 'en' AND (n_chars IS NULL OR n_chars / 10000.0 BETWEEN 0.05 AND 0.5)""")
def grid_filter(spark, sf_dir):
    words = F.split(F.lower("text"), " ")
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.col("source").alias("outcome"), F.col("lang").alias("source_class"), F.transform(words, lambda w: F.struct(w.alias("label"))).alias("tags"), (F.col("n_chars") / 10000.0).alias("score"))
    return rules.grid_filter(docs, outcomes=("src0", "src1", "src2"), classes=("en",), tag="the", score=(0.05, 0.5)).select("id")


@query("""
WITH s AS (SELECT l_orderkey || ':' || l_linenumber AS id, CASE WHEN l_returnflag = 'A' THEN l_quantity END AS us, CASE WHEN l_returnflag = 'A' THEN l_quantity + l_linenumber - 3 END AS ue,
   CASE WHEN l_linestatus = 'O' THEN l_quantity + 0.5 END AS ts, CAST(NULL AS DOUBLE) AS te, l_quantity AS s, l_quantity + 4 AS e, CASE WHEN l_linenumber = 1 THEN l_quantity + 1 END AS bc FROM lineitem),
b AS (SELECT id, us IS NOT NULL AND ue IS NOT NULL AND ue > us AS u, * EXCLUDE (id) FROM s),
c AS (SELECT id, u, bc, CASE WHEN u THEN us ELSE coalesce(ts, s) END AS es, CASE WHEN u THEN ue ELSE coalesce(te, e) END AS ee FROM b)
SELECT id, es AS effective_start_s, ee AS effective_end_s, CASE WHEN u OR bc IS NULL THEN (es + ee) / 2 ELSE bc END AS effective_center_s FROM c""")
def effective_bounds(spark, sf_dir):
    q, n = F.col("l_quantity"), F.col("l_linenumber")
    s = table(spark, sf_dir, "lineitem").select(F.concat_ws(":", "l_orderkey", "l_linenumber").alias("id"), F.when(F.col("l_returnflag") == "A", q).alias("user_start_s"), F.when(F.col("l_returnflag") == "A", q + n - 3).alias("user_end_s"), F.when(F.col("l_linestatus") == "O", q + 0.5).alias("trimmed_start_s"), F.lit(None).cast("double").alias("trimmed_end_s"), q.alias("start_s"), (q + 4).alias("end_s"), F.when(n == 1, q + 1).alias("best_center_s"))
    return rules.effective_bounds(s).select("id", "effective_start_s", "effective_end_s", "effective_center_s")


@query("""
SELECT l_orderkey || ':' || l_linenumber || ':' || l_partkey || ':' || l_suppkey AS id, CASE WHEN l_linenumber = 2 THEN 'rejected' WHEN l_linenumber = 3 THEN 'candidate' WHEN l_returnflag = 'R' THEN 'rejected' ELSE 'candidate' END AS outcome,
  CASE l_linenumber WHEN 2 THEN 'reject' WHEN 3 THEN 'keep' END AS user_decision, CASE WHEN l_returnflag = 'R' THEN 'shaky' END AS reason FROM lineitem""")
def decisions_and_reset(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    ident = F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    s = li.select(ident.alias("seg_id"), F.when(F.col("l_returnflag") == "R", "rejected").when(F.col("l_returnflag") == "A", "selected").otherwise("candidate").alias("outcome"), F.when(F.col("l_returnflag") == "R", "shaky").when(F.col("l_returnflag") == "A", "place_cap").alias("reason"), F.lit(1).alias("cluster_id"))
    d = li.where(F.col("l_linenumber") <= 3).select(ident.alias("seg_id"), F.element_at(F.array(F.lit("clear"), F.lit("reject"), F.lit("keep")), F.col("l_linenumber").cast("int")).alias("decision"), F.lit(None).cast("double").alias("user_start_s"), F.lit(None).cast("double").alias("user_end_s"))
    out = rules.decided(rules.reset(s), d)
    return out.select(F.col("seg_id").alias("id"), "outcome", "user_decision", "reason")
