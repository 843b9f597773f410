"""Durations, beats and export plans.  Stand-ins: a line item is a clip of its order's edit; parts are recordings with sizes and rates."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.config import Durations, per_class
from strandlight.functions import scalar as S
from strandlight.operators import durations, export, report, series
from strandlight.plans.registry import query, table

CONFIG = Durations(base_s=per_class(4.0, 2.0, 2.5, 3.0, 3.0), hero_share=0.25)
CLASS = "CASE l_returnflag WHEN 'A' THEN 'drone' WHEN 'N' THEN 'actioncam' ELSE 'phone' END"
BASE = "CASE l_returnflag WHEN 'A' THEN 4.0 WHEN 'N' THEN 2.0 ELSE 2.5 END"

ASSIGNED = f"""
c AS (SELECT l_orderkey AS project, l_linenumber * 1000000000000000 + l_partkey * 100000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS o, l_quantity / 10 AS span, l_discount * 10 AS score, {BASE}::DOUBLE AS base,
        row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount * 10 DESC, l_linenumber * 1000000000000000 + l_partkey * 100000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT)) <= floor(count(*) OVER (PARTITION BY l_orderkey) * 0.25) AS hero FROM lineitem),
w AS (SELECT *, base * (0.8::DOUBLE + (1.2::DOUBLE - 0.8::DOUBLE) * least(greatest(score, 0), 1)) * CASE WHEN hero THEN 1.5 ELSE 1 END AS raw FROM c),
h AS (SELECT *, least(greatest(raw, 1.5), 6) AS held FROM w),
a AS (SELECT project, o, span, base, hero, least(held, span) AS d, CASE WHEN least(held, span) < held OR held <> raw THEN 'clamped' WHEN hero THEN 'hero' ELSE 'base' END AS reason FROM h)"""


def clips(spark, sf_dir):
    PLACE = F.col("l_linenumber") * 1000000000000000 + F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")  # line numbers repeat within an order
    kind = F.when(F.col("l_returnflag") == "A", "drone").when(F.col("l_returnflag") == "N", "actioncam").otherwise("phone")
    return table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), PLACE.alias("id"), PLACE.alias("order"), kind.alias("source_class"), (F.col("l_quantity") / 10).alias("span_s"), (F.col("l_discount") * 10).alias("score"))


@query(f"WITH {ASSIGNED} SELECT project, o AS id, hero, round(d, 6) AS duration_s, reason AS duration_reason FROM a")
def durations_assign(spark, sf_dir):
    return durations.assign(clips(spark, sf_dir), CONFIG, by=["project"]).select("project", "id", "hero", F.round("duration_s", 6).alias("duration_s"), "duration_reason")


ALTERNATED = """
WITH RECURSIVE {assigned}, k AS (SELECT *, row_number() OVER (PARTITION BY project ORDER BY o) AS i FROM a),
r AS (
  SELECT project, i, CAST(NULL AS DOUBLE) AS out1, CAST(NULL AS DOUBLE) AS d1, CAST(NULL AS DOUBLE) AS b1, CAST(NULL AS BOOLEAN) AS h1, CAST(NULL AS DOUBLE) AS s1, d AS d2, base AS b2, hero AS h2, span AS s2 FROM k WHERE i = 1
  UNION ALL
  SELECT project, i, nd1, x2, b2, h2, s2, x3, b3, h3, s3 FROM (
    SELECT r.project, k.i, r.b2, r.h2, r.s2, k.base AS b3, k.hero AS h3, k.span AS s3, r.d1 AS nd1,
      r.d1 IS NOT NULL AND r.d1 >= r.b1 AND r.d2 >= r.b2 AND k.d >= k.base AS lng, r.d1 IS NOT NULL AND r.d1 < r.b1 AND r.d2 < r.b2 AND k.d < k.base AS sht,
      CASE WHEN lng AND NOT r.h2 THEN least(least(greatest(r.d2 * 0.75, 1.5), 6), r.s2) WHEN sht THEN least(least(greatest(r.d2 * 1.25, 1.5), 6), r.s2) ELSE r.d2 END AS x2,
      CASE WHEN lng AND r.h2 AND NOT k.hero THEN least(least(greatest(k.d * 0.75, 1.5), 6), k.span) ELSE k.d END AS x3
    FROM r JOIN k ON k.project = r.project AND k.i = r.i + 1)),
m AS (SELECT project, max(i) AS n FROM k GROUP BY 1),
f AS (SELECT project, i - 2 AS i, out1 AS d FROM r WHERE i >= 3 UNION ALL SELECT r.project, r.i - 1, d1 FROM r JOIN m ON m.project = r.project AND m.n = r.i WHERE r.i >= 2 UNION ALL SELECT r.project, r.i, d2 FROM r JOIN m ON m.project = r.project AND m.n = r.i)
SELECT k.project, k.o AS "order", round(f.d, 6) AS duration_s FROM f JOIN k ON k.project = f.project AND k.i = f.i""".replace("{assigned}", ASSIGNED)


@query(ALTERNATED)
def durations_alternate(spark, sf_dir):
    own = durations.assign(clips(spark, sf_dir), CONFIG, by=["project"])
    return durations.alternate(own, CONFIG, "project").withColumn("duration_s", F.round("duration_s", 6))


@query(f"""
WITH {ASSIGNED}, t AS (SELECT *, 20 / sum(d) OVER (PARTITION BY project) AS f FROM a)
SELECT project, o AS id, round(least(least(greatest(d * f, 1.5), 6), span), 8) AS duration_s FROM t""")
def durations_scaled(spark, sf_dir):
    own = durations.assign(clips(spark, sf_dir), CONFIG, by=["project"])
    return durations.scale_to_total(own, 20.0, ["project"], 1.5, 6.0).select("project", "id", F.round("duration_s", 8).alias("duration_s"))


@query(f"""
WITH {ASSIGNED} SELECT project, round(sum(d), 4) AS total_s, round(20 - sum(d), 4) AS shortfall_s, count_if(d >= base) AS long, count_if(d < base) AS short, count_if(hero) AS heroes FROM a GROUP BY 1""")
def duration_summary(spark, sf_dir):
    from strandlight.operators.rules import class_value

    own = durations.assign(clips(spark, sf_dir), CONFIG, by=["project"])
    out = report.duration_summary(own, ["project"], class_value(CONFIG.base_s, F.col("source_class")), 20.0)
    return out.withColumns({"total_s": F.round("total_s", 4), "shortfall_s": F.round("shortfall_s", 4)})


QUANTISED = """
c AS (SELECT o_orderkey AS id, o_totalprice / 40000 AS d, o_totalprice / 40000 + 1.37 AS span, o_orderkey % 5 = 0 AS hero FROM orders),
m AS (SELECT id, d, span, hero, m, abs(m * 60.0 / 117 - d) AS x FROM c, (SELECT unnest([2, 4, 6, 8, 12, 16]) AS m)),
n AS (SELECT id, min(x) AS lx FROM m GROUP BY 1),
k AS (SELECT m.id, any_value(d) AS d, any_value(span) AS span, any_value(hero) AS hero, CASE WHEN any_value(hero) THEN max(m) ELSE min(m) END AS near FROM m JOIN n ON n.id = m.id AND x <= lx + 1e-9 GROUP BY 1),
q AS (SELECT k.id, k.d, k.span, max(m.m) AS beats FROM k LEFT JOIN m ON m.id = k.id AND m.m <= near AND m.m * 60.0 / 117 <= k.span + 1e-9 GROUP BY ALL)"""


def beat_clips(spark, sf_dir):
    d = F.col("o_totalprice") / 40000
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), d.alias("duration_s"), (d + 1.37).alias("span_s"), (F.col("o_orderkey") % 5 == 0).alias("hero"), F.lit(1.0).alias("ratio"))
    return durations.quantise(own, 117.0, (2, 4, 6, 8, 12, 16), 25.0)


@query(f"""
WITH {QUANTISED}, l AS (SELECT id, beats, coalesce(beats * 60.0 / 117, span) AS len, span FROM q),
s AS (SELECT *, 5 + span AS e, round(round_even((5 + span / 2 - len / 2) * 25, 0) / 25, 6) AS a FROM l),
t AS (SELECT *, CASE WHEN a + len > e THEN round(floor((e - len) * 25 + 1e-9) / 25, 6) ELSE a END AS b FROM s), u AS (SELECT *, CASE WHEN b < 5 THEN 5.0 ELSE b END AS f FROM t),
v AS (SELECT *, f + len > e + 1e-6 AS bad FROM u)
SELECT id, beats, round(len, 9) AS beat_duration_s, CASE WHEN beats IS NULL THEN 'clamped' ELSE 'beat' END AS beat_reason, round(CASE WHEN bad THEN 5.0 ELSE f END, 6) AS final_start_s, bad AS grid_unreachable FROM v""")
def beat_quantize(spark, sf_dir):
    own = beat_clips(spark, sf_dir).withColumns({"start_s": F.lit(5.0), "end_s": 5.0 + F.col("span_s"), "center_s": 5.0 + F.col("span_s") / 2})
    out = durations.beat_bounds(own, 25.0)
    return out.select("id", "beats", F.round("beat_duration_s", 9).alias("beat_duration_s"), "beat_reason", F.round("final_start_s", 6).alias("final_start_s"), "grid_unreachable")


@query(f"WITH {QUANTISED} SELECT beats, count(*) AS n, round(avg(abs(coalesce(beats * 60.0 / 117, span) - d)), 4) AS shift FROM q GROUP BY 1")
def beat_distribution(spark, sf_dir):
    return report.beat_distribution(beat_clips(spark, sf_dir))


@query("""
WITH d AS (SELECT round(o_totalprice / 40000, 1) AS d, count(*) AS n FROM orders GROUP BY 1), g AS (SELECT * FROM (VALUES ('slow', 60, 90), ('mid', 91, 120), ('fast', 121, 160)) t(r, lo, hi)),
t AS (SELECT r, lo, hi, unnest(range(lo, hi + 1)) AS bpm FROM g),
x AS (SELECT r, lo, hi, bpm, d, n, min(abs(d - m * 60.0 / bpm)) AS c FROM t, d, (SELECT unnest([2, 4, 6, 8, 12, 16]) AS m) GROUP BY ALL),
y AS (SELECT r, lo, hi, bpm, sum(c * n) / sum(n) AS cost FROM x GROUP BY ALL)
SELECT r AS "row", CAST(bpm AS INT) AS bpm, round(cost, 6) AS cost FROM y QUALIFY row_number() OVER (PARTITION BY r ORDER BY round(cost, 9), abs(bpm - (lo + hi) / 2.0), bpm) = 1""")
def bpm_fit(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select(F.round(F.col("o_totalprice") / 40000, 1).alias("duration_s"))
    rows = spark.createDataFrame([("slow", 60, 90), ("mid", 91, 120), ("fast", 121, 160)], "row string, low int, high int")
    return durations.propose_bpm(d, rows, (2, 4, 6, 8, 12, 16))


@query("""
SELECT o_orderkey AS id, CASE WHEN o_orderkey % 9 = 0 THEN 'none' WHEN abs(m - p) <= 3 THEN 'agreed' WHEN abs(m * 2 - p) <= 3 THEN 'half' WHEN abs(m / 2 - p) <= 3 THEN 'double' ELSE 'drifted' END AS verdict
FROM (SELECT o_orderkey, o_totalprice / 2000 AS m, 60 + o_orderkey % 80 AS p FROM orders)""")
def tempo_comparison(spark, sf_dir):
    proposed = F.when(F.col("o_orderkey") % 9 != 0, 60 + F.col("o_orderkey") % 80)
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), durations.compare_bpm(F.col("o_totalprice") / 2000, proposed, 3.0).alias("verdict"))


@query("""
SELECT l_orderkey AS project, l_linenumber * 1000000000000000 + l_partkey * 100000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) AS "order", round(coalesce(sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber * 1000000000000000 + l_partkey * 100000000 + l_suppkey * 100 + CAST(l_quantity AS BIGINT) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 6) AS clip_start_s FROM lineitem""")
def clip_running_start(spark, sf_dir):
    c = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("project"), (F.col("l_linenumber") * 1000000000000000 + F.col("l_partkey") * 100000000 + F.col("l_suppkey") * 100 + F.col("l_quantity").cast("long")).alias("order"), F.col("l_quantity").alias("duration_s"))
    return series.running_start(c, ["order"], by=["project"]).select("project", "order", F.round("clip_start_s", 6).alias("clip_start_s"))


@query("""
WITH p AS (SELECT round(p_size * 1.0, 3) AS r, count(*) AS n FROM part GROUP BY 1),
x AS (SELECT t.r AS rate, sum(CASE WHEN round_even(p.r / t.r, 0) >= 1 AND abs(p.r / t.r - round_even(p.r / t.r, 0)) <= 0.01 THEN p.n ELSE 0 END) AS c FROM p, p t WHERE p.r > 0 AND t.r > 0 GROUP BY 1)
SELECT rate, CAST(c AS BIGINT) AS clips FROM x ORDER BY c DESC, rate LIMIT 1""")
def dominant_rate_reach(spark, sf_dir):
    return export.dominant_rate(table(spark, sf_dir, "part").select((F.col("p_size") * 1.0).alias("fps")))


GEOMETRY = """
p AS (SELECT p_partkey AS id, p_size * 100 AS w, p_partkey % 40 * 90 + 100 AS h FROM part)"""
EVEN = "greatest(CAST(round_even({x}, 0) AS BIGINT) - CAST(round_even({x}, 0) AS BIGINT) % 2, 2)"


@query(f"""
WITH {GEOMETRY}, f AS (SELECT w, h, {EVEN.format(x='h * least(least(3840.0 / w, 2160.0 / h), 1.0)')} AS fh FROM p), l AS (SELECT min(fh) AS fh FROM f),
x AS (SELECT max(least(round_even(w * l.fh / h, 0), 3840)) AS fw, any_value(l.fh) AS fh FROM f, l) SELECT {EVEN.format(x='fw')} AS frame_w, fh AS frame_h FROM x""")
def common_frame(spark, sf_dir):
    return export.common_frame(sizes(spark, sf_dir), 3840, 2160)


def sizes(spark, sf_dir):
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k.alias("id"), (F.col("p_size") * 100).alias("width"), (k % 40 * 90 + 100).alias("height"))


@query(f"""
WITH {GEOMETRY}, c AS (SELECT *, {EVEN.format(x='w / (16.0 / 9)')} AS ch FROM p), d AS (SELECT *, h > w AND ch < h AS cut FROM c),
e AS (SELECT *, CASE WHEN cut THEN ch ELSE h END AS eh FROM d), s AS (SELECT *, least(least(1600.0 / w, 900.0 / eh), 1.0) AS s FROM e)
SELECT id, {EVEN.format(x='w * s')} AS out_w, {EVEN.format(x='eh * s')} AS out_h, CASE WHEN cut THEN 'crop=' || w || ':' || ch END AS crop FROM s""")
def export_plan_geometry(spark, sf_dir):
    own = sizes(spark, sf_dir).withColumns({"display_w": F.col("width"), "display_h": F.col("height")})
    return export.geometry(own, "center_crop", 1600, 900).select("id", "out_w", "out_h", "crop")


@query("""
WITH o AS (SELECT o_orderkey AS id, o_totalprice / 40000 AS d, o_orderkey % 30 * 1.0 AS c, 12.0 AS f, CASE WHEN o_orderkey % 6 = 0 THEN 1.5 END AS us, CASE WHEN o_orderkey % 6 = 0 THEN 3.5 END AS ue, CASE WHEN o_orderkey % 10 = 0 THEN 2.0 END AS fs, CASE WHEN o_orderkey % 10 = 0 THEN 4.0 END AS fe, 25.0 * (1 + o_orderkey % 5) AS fps FROM orders),
s AS (SELECT *, least(d, f) AS len, least(greatest(c - d / 2, 0), greatest(f - least(d, f), 0)) AS st FROM o),
b AS (SELECT id, coalesce(fs, us, st) AS a, coalesce(fe, ue, st + len) AS e, CASE WHEN fps >= 50 THEN greatest(1, CAST(round_even(fps / 25, 0) AS BIGINT)) ELSE 1 END AS ratio FROM s)
SELECT id, round(a, 10) AS plan_start_s, round(e, 10) AS plan_end_s, ratio, round((e - a) * ratio, 9) AS out_s FROM b""")
def export_plan_bounds(spark, sf_dir):
    k = F.col("o_orderkey")
    own = table(spark, sf_dir, "orders").select(k.alias("id"), (F.col("o_totalprice") / 40000).alias("duration_s"), (k % 30 * 1.0).alias("center_s"), F.lit(12.0).alias("file_s"), F.when(k % 6 == 0, 1.5).alias("user_start_s"), F.when(k % 6 == 0, 3.5).alias("user_end_s"), F.when(k % 10 == 0, 2.0).alias("final_start_s"), F.when(k % 10 == 0, 4.0).alias("final_end_s"), (25.0 * (1 + k % 5)).alias("fps"), F.lit(25.0).alias("target_fps"))
    out = export.with_slow_motion(export.plan_bounds(own), F.lit(True))
    return out.select("id", F.round("plan_start_s", 10).alias("plan_start_s"), F.round("plan_end_s", 10).alias("plan_end_s"), "ratio", F.round("out_s", 9).alias("out_s"))


@query("""
SELECT o_orderkey AS id, lpad(CAST(o_orderkey % 1000 AS VARCHAR), 3, '0') || '_' || CASE WHEN o_orderkey % 8 = 0 THEN '00000000' ELSE strftime(o_orderdate, '%Y%m%d') END || '_' ||
  lower(trim(regexp_replace(o_orderpriority, '[^A-Za-z0-9]+', '_', 'g'), '_')) || '_' || CASE WHEN o_orderkey % 3 = 0 THEN 'clip' ELSE lower(o_orderstatus) END || '_' || printf('%.1f', (o_orderkey % 97) / 4.0 + 0.03) || 's.mp4' AS name FROM orders""")
def clip_names(spark, sf_dir):
    k = F.col("o_orderkey")
    taken = F.when(k % 8 != 0, F.col("o_orderdate"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), S.clip_name(k % 1000, taken, F.col("o_orderpriority"), F.when(k % 3 != 0, F.col("o_orderstatus")).otherwise("--"), k % 97 / 4.0 + 0.03).alias("name"))


@query("""
SELECT o_orderkey AS id, substr(sha256('{"d":"' || strftime(o_orderdate, '%Y-%m-%d') || '","k":' || o_orderkey || ',"s":"' || o_orderstatus || '"}'), 1, 16) AS digest FROM orders""")
def export_fingerprints(spark, sf_dir):
    own = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderkey").alias("k"), F.col("o_orderstatus").alias("s"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"))
    return export.fingerprinted(own, ["s", "k", "d"]).select("id", "digest")


@query("""
WITH o AS (SELECT o_orderkey AS path, o_orderstatus AS digest FROM orders), d AS (SELECT o_orderkey AS path, CASE WHEN o_orderkey % 4 = 0 THEN 'x' ELSE o_orderstatus END AS digest FROM orders WHERE o_orderkey % 3 > 0)
SELECT path, digest FROM o WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.path = o.path AND d.digest = o.digest)""")
def export_pending(spark, sf_dir):
    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders")
    done = o.where(k % 3 > 0).select(k.alias("path"), F.when(k % 4 == 0, "x").otherwise(F.col("o_orderstatus")).alias("digest"))
    return report.pending(o.select(k.alias("path"), F.col("o_orderstatus").alias("digest")), done)


@query("SELECT c_name AS name FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 200000)")
def stale_anti_join(spark, sf_dir):
    used = table(spark, sf_dir, "orders").where("o_totalprice > 200000").select(F.col("o_custkey").alias("c_custkey")).distinct().join(table(spark, sf_dir, "customer"), "c_custkey").select(F.col("c_name").alias("name"))
    return report.stale(table(spark, sf_dir, "customer").select(F.col("c_name").alias("name")), used)


@query("""
WITH p AS (SELECT o_orderkey AS o, o_orderstatus AS codec, o_orderkey // 5000 AS width FROM orders), f AS (SELECT * FROM p ORDER BY o LIMIT 1)
SELECT p.o AS "order", CASE WHEN p.codec <> f.codec THEN 'codec' ELSE 'width' END AS "column" FROM p, f WHERE p.codec <> f.codec OR p.width <> f.width ORDER BY p.o LIMIT 1""")
def parts_uniform(spark, sf_dir):
    p = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("order"), F.col("o_orderstatus").alias("codec"), F.floor(F.col("o_orderkey") / 5000).alias("width"))
    return export.uniform(p, ["codec", "width"])
