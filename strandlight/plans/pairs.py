"""Similarity, clusters, places and selection.  Stand-ins: vectors are segments, labels are classes or projects; places of
customers come from arithmetic on their keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.config import CLASSES, Config, Selection, Similarity, merged, per_class
from strandlight.operators import edit, selection, similarity, tags
from strandlight.plans.registry import query, table

THRESHOLD = 0.3  # the table's vectors are nearly orthogonal; the engine's default is 0.75


def vectors(spark, sf_dir, kind="array<double>"):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast(kind).alias("vector"), F.col("label").alias("source_class"))


DOTS = "p AS (SELECT a.vec_id AS a, b.vec_id AS b, a.label AS c, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS d FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id)"


@query(f"WITH {DOTS} SELECT a, b, round(least(greatest(d, 0), 1), 6) AS sim FROM p WHERE d >= 0.15")
def pair_similarity_semantic(spark, sf_dir):
    p = similarity.dot_pairs(vectors(spark, sf_dir), "source_class", "id", "vector", 0.15)
    return p.select("a", "b", F.round("sim", 6).alias("sim"))


FIXES = "v AS (SELECT vec_id AS id, label, CAST(embedding AS DOUBLE[]) AS e, CASE WHEN vec_id % 3 > 0 THEN vec_id % 50 * 0.001 END AS lat, vec_id % 40 * 0.001 AS lon, CASE WHEN vec_id % 4 > 0 THEN vec_id * 7.0 END AS t, vec_id % 2 AS faces FROM embeddings)"


@query(f"""
WITH {FIXES}, p AS (SELECT a.id AS a, b.id AS b, least(greatest(list_dot_product(a.e, b.e), 0), 1) AS sem,
  CASE WHEN a.lat IS NOT NULL AND b.lat IS NOT NULL THEN 2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1))) END AS m, abs(a.t - b.t) AS dt, a.faces = b.faces AS same FROM v a JOIN v b ON a.label = b.label AND a.id < b.id),
q AS (SELECT a, b, same, sem, least(greatest(1 - m / 3000, 0), 1) AS sp, least(greatest(1 - dt / 600, 0), 1) AS te, m, dt FROM p)
SELECT a, b, round(CASE WHEN NOT same THEN 0 ELSE (0.5 * sem + CASE WHEN m IS NULL THEN 0 ELSE 0.2 * sp END + CASE WHEN dt IS NULL THEN 0 ELSE 0.2 * te END) / (0.5 + CASE WHEN m IS NULL THEN 0 ELSE 0.2 END + CASE WHEN dt IS NULL THEN 0 ELSE 0.2 END) END, 6) AS sim FROM q WHERE same AND (0.5 * sem + CASE WHEN m IS NULL THEN 0 ELSE 0.2 * sp END + CASE WHEN dt IS NULL THEN 0 ELSE 0.2 * te END) / (0.5 + CASE WHEN m IS NULL THEN 0 ELSE 0.2 END + CASE WHEN dt IS NULL THEN 0 ELSE 0.2 END) >= 0.2""")
def pair_similarity_combined(spark, sf_dir):
    i = F.col("id")
    v = vectors(spark, sf_dir, "array<float>").withColumns({"lat": F.when(i % 3 > 0, i % 50 * 0.001), "lon": i % 40 * 0.001, "time_s": F.when(i % 4 > 0, i * 7.0), "faces": i % 2})
    p = similarity.combined_pairs(v, "source_class", "id", Similarity(radius_m=3000.0, radius_s=600.0, semantic_floor=0.0), 0.2, visual=0.9)
    return p.select("a", "b", F.round("sim", 6).alias("sim"))


@query("""
WITH d AS (SELECT doc_id, source, n_chars * 2654435761 % 4294967296 AS h FROM documents)
SELECT a.doc_id AS a, b.doc_id AS b, round(1 - bit_count(xor(a.h, b.h)) / 64.0, 6) AS sim FROM d a JOIN d b ON a.source = b.source AND a.doc_id < b.doc_id WHERE bit_count(xor(a.h, b.h)) <= 8""")
def hamming_pairs(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select("doc_id", "source", (F.col("n_chars") * 2654435761 % 4294967296).alias("h"))
    p = similarity.pairs_within(d, ["source"], "doc_id").withColumn("sim", similarity.hash_similarity(F.col("a_h"), F.col("b_h")))
    return p.where(F.bit_count(F.col("a_h").bitwiseXOR(F.col("b_h"))) <= 8).select(F.col("a_doc_id").alias("a"), F.col("b_doc_id").alias("b"), F.round("sim", 6).alias("sim"))


@query("""
WITH c AS (SELECT user_id AS u, least(floor(value / 62.5), 7) AS bin, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT u, sum(n) AS n FROM c GROUP BY 1), g AS (SELECT u, b, t.n FROM t, range(8) r(b)),
h AS (SELECT g.u, b, coalesce(c.n, 0) / g.n AS x FROM g LEFT JOIN c ON c.u = g.u AND c.bin = b)
SELECT a.u AS a, b.u AS b, round(1 - 0.5 * sum(CASE WHEN a.x + b.x > 0 THEN pow(a.x - b.x, 2) / (a.x + b.x) ELSE 0 END), 5) AS sim
FROM h a JOIN h b ON a.b = b.b AND a.u < b.u AND a.u % 10 = b.u % 10 GROUP BY 1, 2 HAVING 1 - 0.5 * sum(CASE WHEN a.x + b.x > 0 THEN pow(a.x - b.x, 2) / (a.x + b.x) ELSE 0 END) >= 0.9""")
def histogram_similarity_pairs(spark, sf_dir):
    """Histograms of all of a user's values in eight bins; pairs from 0.9."""
    bins = F.least(F.floor(F.col("value") / 62.5), F.lit(7))
    counts = [F.sum((bins == k).cast("int")).alias(f"b{k}") for k in range(8)]
    h = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("u")).agg(F.count(F.lit(1)).alias("n"), *counts)
    h = h.select("u", (F.col("u") % 10).alias("g"), F.array(*[F.col(f"b{k}") / F.col("n") for k in range(8)]).alias("x"))
    p = similarity.pairs_within(h, ["g"], "u").withColumn("sim", similarity.histogram_similarity(F.col("a_x"), F.col("b_x")))
    return p.where("sim >= 0.9").select(F.col("a_u").alias("a"), F.col("b_u").alias("b"), F.round("sim", 5).alias("sim"))


@query("""
WITH t AS (SELECT user_id AS u, ntile(6) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, value FROM events QUALIFY count(*) OVER (PARTITION BY user_id) >= 6), m AS (SELECT u, k, avg(value) AS v FROM t GROUP BY 1, 2), h AS (SELECT u, list(v ORDER BY k) AS x FROM m GROUP BY 1),
p AS (SELECT a.u AS a, b.u AS b, a.x AS x, b.x AS y FROM h a JOIN h b ON a.u < b.u AND a.u % 10 = b.u % 10),
s AS (SELECT a, b, list_transform(x, lambda v: v - list_avg(x)) AS dx, list_transform(y, lambda v: v - list_avg(y)) AS dy FROM p), r AS (SELECT a, b, (list_dot_product(dx, dy) / sqrt(list_dot_product(dx, dx) * list_dot_product(dy, dy)) + 1) / 2 AS sim FROM s)
SELECT a, b, round(sim, 6) AS sim FROM r WHERE sim >= 0.9""")
def motion_similarity_pairs(spark, sf_dir):
    """Means of the sixths of all of a user's values; pairs from 0.9."""
    from pyspark.sql import Window

    w = Window.partitionBy("user_id")
    e = table(spark, sf_dir, "events").select(F.col("user_id"), "value", F.ntile(6).over(w.orderBy("ts", "event_id")).alias("k"), F.count(F.lit(1)).over(w).alias("n")).where("n >= 6")
    h = e.groupBy(F.col("user_id").alias("u")).agg(F.array(*[F.avg(F.when(F.col("k") == k, F.col("value"))) for k in range(1, 7)]).alias("x"))
    p = similarity.motion_pairs(h.withColumn("g", F.col("u") % 10), "g", "u", "x", 0.9)
    return p.select("a", "b", F.round("sim", 6).alias("sim"))


@query(f"""
WITH RECURSIVE {DOTS}, e AS (SELECT a, b FROM p WHERE d >= {THRESHOLD} UNION ALL SELECT b, a FROM p WHERE d >= {THRESHOLD}),
r AS (SELECT vec_id AS n, vec_id AS m FROM embeddings UNION SELECT r.n, e.b FROM r JOIN e ON e.a = r.m),
c AS (SELECT n AS id, min(m) AS root FROM r GROUP BY 1)
SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS cluster_id FROM c""")
def cluster_single_linkage(spark, sf_dir):
    v = vectors(spark, sf_dir)
    p = similarity.dot_pairs(v, "source_class", "id", "vector", THRESHOLD)
    return similarity.single_linkage(v, p, THRESHOLD).select("id", "cluster_id")


PLACES = "c AS (SELECT c_custkey AS id, c_custkey % 97 * 0.01 AS lat, c_custkey % 89 * 0.01 AS lon FROM customer)"
METRES = "2 * 6371000.0 * asin(sqrt(least(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2), 1)))"


def points(spark, sf_dir):
    k = F.col("c_custkey")
    return table(spark, sf_dir, "customer").select(k.alias("id"), (k % 97 * 0.01).alias("lat"), (k % 89 * 0.01).alias("lon"), k.alias("at"))


@query(f"WITH {PLACES}, p AS (SELECT a.id AS a, b.id AS b, {METRES} AS m FROM c a JOIN c b ON a.id < b.id) SELECT a, b, round(m, 3) AS metres FROM p WHERE m <= 1200")
def haversine_places(spark, sf_dir):
    return similarity.within_radius(points(spark, sf_dir), 1200.0, digits=3)


@query(f"""
WITH RECURSIVE {PLACES}, p AS (SELECT a.id AS a, b.id AS b FROM c a JOIN c b ON a.id <> b.id WHERE {METRES} <= 900),
r AS (SELECT id AS n, id AS m FROM c UNION SELECT r.n, p.b FROM r JOIN p ON p.a = r.m), g AS (SELECT n AS id, min(m) AS root FROM r GROUP BY 1)
SELECT id, dense_rank() OVER (ORDER BY root) - 1 AS place_id FROM g""")
def place_components(spark, sf_dir):
    return similarity.places(points(spark, sf_dir), 900.0, "at").select("id", "place_id")


def candidates(spark, sf_dir):
    i = F.col("id")
    return vectors(spark, sf_dir, "array<float>").select(F.col("source_class").cast("string").alias("project"), F.lpad(i.cast("string"), 8, "0").alias("id"), "vector", (i % 101 / 100).alias("score"), (i % 37).cast("string").alias("file_id"), F.lit("generic").alias("source_class"), F.lit(None).cast("long").alias("cluster_id"), (i % 11).alias("visit_id"), (i % 5).cast("string").alias("tag"), (i * 20.0).alias("time_s"), (i % 50 == 0).alias("pinned"))


@query()
def mmr_select(spark, sf_dir):
    """Ten clips of each project; tested against a plain loop."""
    picked = selection.select_near(candidates(spark, sf_dir), similarity.semantic_near, Selection(per_file=per_class(1, 1, 1, 1, 1)), 10)
    return picked.where("pick is not null").select("project", "id", "pick", "relaxed")


@query()
def select_edit(spark, sf_dir):
    """The whole selection of each label's vectors as a project; tested against a plain loop."""
    return edit.select_edit(edit_candidates(spark, sf_dir), EDIT, 12)


#: the table's vectors are nearly orthogonal
EDIT = merged(Config(), {"selection": {"per_file": per_class(2, 2, 1, 1, 1), "min_share": per_class(0.2, 0.0, 0.1, 0.0, 0.0), "cluster_threshold": 0.3, "per_visit": 2, "gap_s": 30.0}, "similarity": {"semantic_floor": 0.0, "radius_m": 600.0}, "places": {"radius_m": 700.0, "visit_gap_s": 3000.0}})


def edit_candidates(spark, sf_dir):
    i = F.col("id")
    v = vectors(spark, sf_dir, "array<float>").select(F.col("source_class").cast("string").alias("project"), F.lpad(i.cast("string"), 8, "0").alias("id"), "vector", i.alias("i"))
    i = F.col("i")
    return v.select("project", "id", "vector", (i % 41).cast("string").alias("file_id"), F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (i % 5 + 1).cast("int")).alias("source_class"), (i % 101 / 100).alias("score"), F.when(i % 6 > 0, (i % 4).cast("string")).alias("tag"), F.when(i % 7 > 0, i % 30 * 0.01).alias("lat"), (i % 3 * 0.004).alias("lon"), F.when(i % 11 > 0, i * 17.0).alias("time_s"), F.when(i % 5 > 1, i % 2).alias("faces"), (1.0 + i % 6).alias("span_s"), F.when(i % 29 == 0, "vertical").alias("reason"), F.when(i % 37 == 0, "reject").when(i % 53 == 0, "keep").alias("user_decision"))


@query(f"""
WITH {DOTS}, s AS (SELECT vec_id AS id, label, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS o FROM embeddings WHERE vec_id % 7 = 0),
e AS (SELECT a AS id, b AS other, d FROM p UNION ALL SELECT b, a, d FROM p), h AS (SELECT e.id, e.other, d, row_number() OVER (PARTITION BY e.id ORDER BY d DESC, o) AS rn FROM e JOIN s ON s.id = e.other WHERE d > 0)
SELECT vec_id AS id, round(coalesce(d, 0), 6) AS similarity, CASE WHEN d >= {THRESHOLD} THEN other END AS lost_to FROM embeddings LEFT JOIN h ON h.id = vec_id AND rn = 1 WHERE vec_id % 7 <> 0""")
def lost_to_winner(spark, sf_dir):
    v = vectors(spark, sf_dir)
    p = similarity.dot_pairs(v, "source_class", "id", "vector", 1e-9)
    chosen = selection.edit_order(v.where("id % 7 = 0"), "id", "id", ["source_class"])
    best = similarity.best_selected(v.where("id % 7 != 0"), p, chosen)
    return best.select("id", F.round("similarity", 6).alias("similarity"), F.when(F.col("similarity") >= THRESHOLD, F.col("winner")).alias("lost_to"))


@query("""
WITH f AS (SELECT vec_id // 9 AS v, list(vec_id ORDER BY vec_id) AS h FROM embeddings WHERE vec_id % 3 = 0 AND vec_id % 5 > 0 GROUP BY 1 HAVING count(*) = 3)
SELECT vec_id AS id, h AS held_by FROM embeddings JOIN f ON f.v = vec_id // 9 WHERE vec_id % 3 > 0 OR vec_id % 5 = 0""")
def held_by_visit(spark, sf_dir):
    """Nine vectors are a visit; most of every third are selected."""
    i = F.col("id")
    v = vectors(spark, sf_dir).withColumn("visit_id", F.floor(i / 9))
    chosen = (i % 3 == 0) & (i % 5 > 0)
    return selection.held_by(v.where(~chosen), v.where(chosen).withColumn("order", i), 3)


@query("""
WITH d AS (SELECT doc_id AS id, source AS g, n_chars / 10000.0 AS s, doc_id % 6 = 0 AS sel FROM documents WHERE doc_id % 4 <> 1),
n AS (SELECT g, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= 2), p AS (SELECT g, id FROM d QUALIFY row_number() OVER (PARTITION BY g ORDER BY NOT sel, s DESC, id) = 1),
r AS (SELECT d.g, d.id, row_number() OVER (PARTITION BY d.g ORDER BY d.s DESC, d.id) AS rn FROM d JOIN p ON p.g = d.g AND p.id <> d.id)
SELECT n.g AS source, CAST(n.n AS INT) AS size, p.id AS pick, list_aggregate(list(r.id ORDER BY rn), 'string_agg', ',') AS others FROM n JOIN p USING (g) JOIN r ON r.g = n.g AND rn <= 4 GROUP BY ALL""")
def group_stacks(spark, sf_dir):
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), "source", (F.col("n_chars") / 10000.0).alias("score"), F.when(F.col("doc_id") % 4 == 1, "rejected").when(F.col("doc_id") % 6 == 0, "selected").otherwise("candidate").alias("outcome"))
    return selection.group_stacks(d, "source").withColumn("others", F.array_join(F.transform("others", lambda x: x.cast("string")), ","))


@query("""
WITH l AS (SELECT vec_id AS k, 'g' || (vec_id % 2) AS g, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id < 8),
x AS (SELECT v.vec_id AS id, g, k, 10 * list_dot_product(CAST(v.embedding AS DOUBLE[]), l.e) AS x FROM embeddings v, l),
s AS (SELECT id, g, k, exp(x) / sum(exp(x)) OVER (PARTITION BY id, g) AS p FROM x), n AS (SELECT *, max(CASE WHEN k >= 6 THEN p END) OVER (PARTITION BY id, g) AS none FROM s),
f AS (SELECT *, g = 'g0' AS pr FROM n WHERE k < 6 AND p >= 0.2 AND p > none),
t AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY pr DESC, round(p, 9) DESC, k) = 1 AND pr AS lead FROM f)
SELECT id AS seg_id, 'l' || k AS label, round(p, 6) AS confidence, pr AS "primary", CAST(row_number() OVER (PARTITION BY id ORDER BY lead DESC, round(p, 9) DESC, k) AS INT) AS place FROM t QUALIFY row_number() OVER (PARTITION BY id ORDER BY lead DESC, round(p, 9) DESC, k) <= 3""")
def zero_shot_tags(spark, sf_dir):
    """The first eight vectors stand for label prompts of two groups, the last of each group for none of them."""
    v = vectors(spark, sf_dir)
    labels = v.where("id < 8").select(F.concat(F.lit("g"), (F.col("id") % 2).cast("string")).alias("group"), F.when(F.col("id") < 6, F.concat(F.lit("l"), F.col("id").cast("string"))).alias("label"), "vector", (F.col("id") % 2 == 0).alias("primary"))
    return tags.zero_shot(v.withColumnRenamed("id", "seg_id"), labels, 10.0, 0.2, 3).withColumn("confidence", F.round("confidence", 6))


@query("""
WITH v AS (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings)
SELECT id, round(CASE WHEN id % 5 = 0 THEN 0.7 ELSE least(greatest(list_sum(e) * 2 / sqrt(list_dot_product(e, e)) + 5, 1), 10) / 10 END, 6) AS aesthetic FROM v""")
def aesthetic_head(spark, sf_dir):
    v = vectors(spark, sf_dir)
    return v.select("id", F.round(tags.aesthetic(F.col("vector"), [2.0] * 64, 5.0, F.when(F.col("id") % 5 == 0, 0.7)), 6).alias("aesthetic"))
