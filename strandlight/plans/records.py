"""Listings, stores, scopes, digests and other records.  Stand-ins: documents, orders and events are segments, files and samples."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from strandlight.functions import scalar as S
from strandlight.operators import assembly, export, report, series, soundtrack, tags, telemetry
from strandlight.plans.registry import query, table
from strandlight.session import shared_folder
from strandlight.sources import files, store


def outcomes(spark, sf_dir):
    k = F.col("doc_id")
    return table(spark, sf_dir, "documents").select(k.alias("id"), "source", F.when(k % 5 == 0, "rejected").when(k % 5 < 3, "selected").otherwise("candidate").alias("outcome"), F.when(k % 5 < 3, -k).alias("order"), F.when(k % 7 > 0, (k * 37 % 1000).cast("double")).alias("time_s"))


@query("""
SELECT doc_id AS id, 'selected' AS scope, row_number() OVER (ORDER BY -doc_id, doc_id) AS place FROM documents WHERE doc_id % 5 IN (1, 2)
UNION ALL SELECT doc_id, 'all', row_number() OVER (ORDER BY doc_id) FROM documents WHERE doc_id % 5 > 0""")
def describe_scope(spark, sf_dir):
    own = outcomes(spark, sf_dir)
    parts = [report.describe_scope(own, scope).select("id", F.lit(scope).alias("scope"), "place") for scope in ("selected", "all")]
    return parts[0].unionByName(parts[1])


@query("""
SELECT doc_id AS id, row_number() OVER (ORDER BY CASE WHEN doc_id % 7 > 0 THEN doc_id * 37 % 1000 ELSE 0 END, doc_id) AS place FROM documents WHERE doc_id % 5 = 0""")
def rejects_by_capture(spark, sf_dir):
    return report.capture_order(outcomes(spark, sf_dir)).select("id", "place")


@query("""
WITH s AS (SELECT o_custkey AS e, o_orderkey AS id, CASE WHEN o_orderkey % 3 > 0 THEN o_orderpriority ELSE ' ' END AS c FROM orders), c AS (SELECT e, list(c ORDER BY n) AS captions FROM (SELECT e, c, row_number() OVER (PARTITION BY e ORDER BY id) AS n FROM s WHERE trim(c) <> '') WHERE n <= 5 GROUP BY 1),
p AS (SELECT o_custkey AS e, o_orderkey % 6 AS place, count(*) AS n FROM orders GROUP BY 1, 2), m AS (SELECT e, list('place ' || place ORDER BY k) AS names FROM (SELECT e, place, row_number() OVER (PARTITION BY e ORDER BY n DESC, place) AS k FROM p WHERE place > 0) WHERE k <= 3 GROUP BY 1),
r AS (SELECT e, list_sort(list(DISTINCT 'region ' || (place // 2))) AS regions FROM p GROUP BY 1)
SELECT DISTINCT s.e AS edit, coalesce(captions, []) AS captions, coalesce(names, []) AS place_names, regions FROM s LEFT JOIN c USING (e) LEFT JOIN m USING (e) LEFT JOIN r USING (e)""")
def signal_lists(spark, sf_dir):
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_custkey", "edit")
    k = F.col("o_orderkey")
    chosen = o.select("edit", k.alias("id"), k.alias("order"), F.when(k % 3 > 0, F.col("o_orderpriority")).alias("caption"))
    places = o.groupBy("edit", (k % 6).alias("place_id")).agg(F.count(F.lit(1)).alias("segments"))
    places = places.withColumns({"name": F.when(F.col("place_id") > 0, F.concat(F.lit("place "), F.col("place_id").cast("string"))), "region": F.concat(F.lit("region "), F.floor(F.col("place_id") / 2).cast("string"))})
    return report.signal_lists(chosen, places, ["edit"])


@query("""
WITH h AS (SELECT n_regionkey AS r, list(n_nationkey ORDER BY n_nationkey) AS held, string_agg(CASE WHEN n_nationkey % 3 > 0 THEN lpad(CAST(n_nationkey AS VARCHAR), 3, '0') ELSE CAST(n_nationkey AS VARCHAR) END, ', ' ORDER BY n_nationkey) AS held_by_label FROM nation GROUP BY 1)
SELECT c_custkey AS id, held_by_label FROM customer JOIN nation ON n_nationkey = c_nationkey JOIN h ON h.r = n_regionkey""")
def held_by_labels(spark, sf_dir):
    """A customer's place is held by the nations of its region; two of three have a label."""
    n = table(spark, sf_dir, "nation")
    held = n.groupBy("n_regionkey").agg(F.sort_array(F.collect_list("n_nationkey")).alias("held_by"))
    rows = table(spark, sf_dir, "customer").join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(held, "n_regionkey").select(F.col("c_custkey").alias("id"), "held_by")
    k = F.col("n_nationkey")
    return report.held_by_names(rows, n.select(k.alias("id"), F.when(k % 3 > 0, F.lpad(k.cast("string"), 3, "0")).alias("order_label")))


@query("""
WITH p AS (SELECT o_custkey AS edit, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o, o_orderkey % 7 * 0.25 + 1 AS d FROM orders),
s AS (SELECT *, coalesce(sum(d) OVER (PARTITION BY edit ORDER BY o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS a FROM p)
SELECT edit, o AS "order", id, round(a, 4) AS start_s, round(a + d, 4) AS end_s, d AS duration_s FROM s""")
def montage_index(spark, sf_dir):
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    parts = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("edit"), k.alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("order"), (k % 7 * 0.25 + 1).cast("double").alias("duration_s"))
    return series.montage_index(parts, ["edit"])


@query("""
SELECT l_orderkey AS file_id, 0 AS frame, count_if(l_discount >= 0.05 AND l_quantity >= 0.5 * 40) AS faces FROM lineitem GROUP BY 1""")
def face_rows(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_id"), F.lit(0).alias("frame"), F.col("l_discount").alias("score"), F.col("l_quantity").alias("box_height"))
    frames = li.select("file_id", "frame").distinct().withColumn("frame_height", F.lit(40))
    return report.face_counts(frames, li, 0.05, 0.5)


@query("""
SELECT o_orderkey AS id, o_orderkey % 3 = 0 AND o_orderkey % 4 < 3 AND o_orderkey % 10 < 5 AS synced FROM orders""")
def sync_validity(spark, sf_dir):
    k = F.col("o_orderkey")
    track = F.when(k % 4 < 3, F.lit("a.mp3"))
    return table(spark, sf_dir, "orders").select(k.alias("id"), report.synced_against(track, F.lit(120.0), F.when(k % 3 == 0, "a.mp3").otherwise("b.mp3"), 120.0 + k % 10 * 0.011).alias("synced"))


@query("""
SELECT event_id, 1 AS "index", 'mov_text' AS codec_name, CASE WHEN event_id % 2 = 0 THEN 'tx3g' END AS codec_tag, 'SubtitleHandler' AS handler_name, CASE WHEN event_id % 3 = 0 THEN 'eng' END AS language FROM events
UNION ALL SELECT event_id, 3, NULL, NULL, NULL, NULL FROM events WHERE event_id % 5 = 0""")
def stream_infos(spark, sf_dir):
    k = F.col("event_id")
    answer = F.concat(F.lit('{"streams":[{"index":0,"codec_type":"video","codec_name":"h264"},{"index":1,"codec_type":"subtitle","codec_name":"mov_text","codec_tag_string":"'), F.when(k % 2 == 0, "tx3g").otherwise(" "), F.lit('","tags":{"handler_name":"SubtitleHandler"'), F.when(k % 3 == 0, ',"language":"eng"').otherwise(""), F.lit("}}"), F.when(k % 5 == 0, ',{"index":3,"codec_type":"subtitle"}').otherwise(""), F.lit("]}"))
    return files.streams(table(spark, sf_dir, "events").select("event_id", answer.alias("probe")), "subtitle", "event_id")


@query("""
WITH c AS (SELECT o_custkey AS edit, o_orderkey AS id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS o, o_orderkey % 100 * 0.5 AS s, o_orderkey % 9 + 1 AS d FROM orders),
p AS (SELECT edit, id, o, left(sha256(id || '|' || printf('%.4f', s) || '|' || printf('%.4f', d * 1.0) || '|' || printf('%.4f', d * 2.0) || '|25.000|2|720|fast|23|' || CASE WHEN id % 4 > 0 THEN 'f' || id || ':' || (id * 10) || ':77' ELSE '' END), 16) AS digest FROM c)
SELECT edit, left(sha256('720|fast|' || string_agg(id || ':' || o || ':' || digest, '|' ORDER BY o)), 16) AS edit_digest FROM p GROUP BY 1""")
def edit_digests(spark, sf_dir):
    """Digests of parts, and of edits over those of their parts."""
    from pyspark.sql import Window

    k = F.col("o_orderkey")
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("edit"), k.alias("id"), F.row_number().over(Window.partitionBy("o_custkey").orderBy("o_orderkey")).alias("order"), (k % 100 * 0.5).cast("double").alias("plan_start_s"), (k % 9 + 1).cast("double").alias("duration_s"), ((k % 9 + 1) * 2).cast("double").alias("out_s"), F.lit(25.0).alias("target_fps"), F.lit(2).alias("ratio"), F.when(k % 4 > 0, F.concat(F.lit("f"), k.cast("string"))).alias("path"), (k * 10).alias("size"), F.lit(77.9).alias("mtime"))
    return export.chained_digests(export.part_digests(o, 720, "fast", 23), "edit", "720|fast")


@query("""
WITH p AS (SELECT p_partkey AS id, p_size * 40 + 100 AS w, p_partkey % 50 * 30 + 90 AS h FROM part),
r AS (SELECT id, w, h, CAST(round_even(CASE WHEN w >= h THEN CAST(h AS DOUBLE) / w ELSE CAST(w AS DOUBLE) / h END * 320, 0) AS BIGINT) AS o FROM p), e AS (SELECT *, greatest(o - o % 2, 2) AS e FROM r)
SELECT id, CASE WHEN w >= h THEN 320 ELSE e END AS sample_w, CASE WHEN w >= h THEN e ELSE 320 END AS sample_h FROM e""")
def sample_size(spark, sf_dir):
    k = F.col("p_partkey")
    w, h = S.fit_long_side(F.col("p_size") * 40 + 100, k % 50 * 30 + 90, 320)
    return table(spark, sf_dir, "part").select(k.alias("id"), w.alias("sample_w"), h.alias("sample_h"))


@query("""
SELECT event_id, user_id AS file_id, CAST(CASE WHEN user_id % 3 = 0 THEN 0 ELSE 1 END AS INT) AS source_no FROM events WHERE (user_id % 3 = 0 AND event_id % 2 = 0) OR (user_id % 3 = 1 AND event_id % 2 = 1)""")
def telemetry_source(spark, sf_dir):
    """Of two sources the first detected one counts, even if it is empty (users with a remainder of 2)."""
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("file_id"))
    first, second = e.where("file_id % 3 = 0 and event_id % 2 = 0"), e.where("event_id % 2 = 1")
    found = e.select("file_id").distinct()
    detected = found.where("file_id % 3 != 1").withColumn("source_no", F.lit(0)).unionByName(found.withColumn("source_no", F.lit(1)))
    return telemetry.first_source(detected, first, second).select("event_id", "file_id", "source_no")


@query("SELECT event_id, user_id AS content_key, value FROM events WHERE user_id % 2 = 0")
def frame_cache(spark, sf_dir):
    """Written for two settings and read back for one; what the cache doesn't cover is left out."""
    folder = f"{shared_folder(spark)}/frames-{uuid.uuid4().hex}"
    e = table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("content_key"), "value")
    store.write_frames(e.where("content_key % 2 = 0"), folder, 2.0, 320)
    store.write_frames(e.where("content_key % 2 = 1"), folder, 4.0, 320)
    return store.read_frames(spark, folder, 2.0, 320)


@query("""
SELECT user_id AS content_key FROM events GROUP BY 1 HAVING user_id % 2 = 1""")
def cache_missing(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("content_key")).distinct()
    return store.missing(e, e.where("content_key % 2 = 0"))


@query("""
WITH l AS (SELECT o_orderkey AS id, CAST(floor(o_totalprice) AS BIGINT) AS size, o_orderdate AS mtime FROM orders), old AS (SELECT * FROM l WHERE mtime < TIMESTAMP '1998-01-01' - INTERVAL 365 DAY)
SELECT (SELECT count(*) FROM l) AS entries, (SELECT sum(size) FROM l) AS bytes, count(*) AS prunable, coalesce(sum(size), 0) AS prunable_bytes FROM old""")
def cache_prune(spark, sf_dir):
    listing = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.floor("o_totalprice").alias("size"), F.col("o_orderdate").cast("timestamp").alias("mtime"))
    old = store.prunable(listing, 365, F.lit("1998-01-01").cast("timestamp"))
    gone = store.cache_stats(old).select(F.col("entries").alias("prunable"), F.col("bytes").alias("prunable_bytes"))
    every = store.cache_stats(listing)
    return every.withColumn("_k", F.lit(1)).join(gone.withColumn("_k", F.lit(1)), "_k").drop("_k")


@query("""
SELECT o_orderkey AS seg_id, CASE WHEN o_custkey % 2 = 0 THEN 'drone' ELSE 'generic' END AS source_class, CASE WHEN o_custkey % 2 = 0 THEN o_custkey * 0.5 END AS lat, CASE WHEN o_orderkey % 3 > 0 THEN o_orderkey % 64 END AS hash, CASE WHEN o_orderkey % 4 > 0 THEN 2 END AS vector_size, CASE WHEN o_custkey % 2 = 0 THEN 86400.0 + o_orderkey % 5 END AS time_s FROM orders""")
def feature_rows(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders")
    own = o.select(k.alias("seg_id"), c.alias("file_id"), (k % 5).cast("double").alias("center_s"))
    recordings = o.where(c % 2 == 0).select(c.alias("file_id")).distinct().select("file_id", F.lit("drone").alias("source_class"), F.struct((F.col("file_id") * 0.5).alias("lat"), F.lit(1.0).alias("lon")).alias("gps"), F.lit("1970-01-02").cast("timestamp").alias("creation_time"))
    pictures = o.where(k % 3 > 0).select(k.alias("seg_id"), (k % 64).alias("hash"))
    vectors = o.where(k % 4 > 0).select(k.alias("seg_id"), F.array(F.lit(0.0), F.lit(1.0)).alias("vector"))
    slices = o.select(k.alias("seg_id"), F.array(F.lit(0.5)).alias("motion"))
    out = assembly.features(own, recordings, pictures, vectors, slices)
    return out.select("seg_id", "source_class", "lat", "hash", F.size("vector").alias("n"), "time_s").select("seg_id", "source_class", "lat", "hash", F.when(F.col("n") > 0, F.col("n")).alias("vector_size"), "time_s")


@query("""
SELECT o_orderkey AS id, row_number() OVER (ORDER BY CASE WHEN o_orderkey % 3 = 0 THEN o_orderdate WHEN o_orderkey % 3 = 1 THEN o_orderdate + INTERVAL 1 DAY ELSE TIMESTAMP '1970-01-01' END, 'p' || lpad(CAST(o_orderkey AS VARCHAR), 12, '0')) AS place FROM orders""")
def file_chronology(spark, sf_dir):
    from strandlight.functions.ranks import numbered

    k, day = F.col("o_orderkey"), F.col("o_orderdate").cast("timestamp")
    own = table(spark, sf_dir, "orders").select(k.alias("id"), F.concat(F.lit("p"), F.lpad(k.cast("string"), 12, "0")).alias("path"), F.when(k % 3 == 0, day).alias("creation_time"), F.when(k % 3 == 1, day + F.expr("INTERVAL 1 DAY")).alias("mtime"))
    return numbered(own, [files.taken_at(), F.col("path")], "place", start=1).select("id", "place")


@query("""
SELECT doc_id AS id, CASE WHEN doc_id % 3 = 0 THEN 'sea,old' WHEN doc_id % 3 = 1 THEN 'sea,new' ELSE 'new' END AS labels FROM documents""")
def tags_replaced(spark, sf_dir):
    """Local tags give way to new ones, cloud tags stay and come first; without new ones the local are removed alone."""
    k = F.col("doc_id")
    tag = lambda label, source: F.struct(F.lit(label).alias("label"), F.lit(0.5).alias("confidence"), F.lit(source).alias("source"), F.lit("g").alias("group"), F.lit(True).alias("primary"))
    old = F.when(k % 3 == 0, F.array(tag("old", "hand"), tag("gone", "local"), tag("sea", "cloud"))).when(k % 3 == 1, F.array(tag("gone", "local"), tag("sea", "cloud"))).cast(tags.TAGS)
    new = F.when(k % 3 > 0, F.array(tag("new", "local"))).cast(tags.TAGS)
    out = tags.replace_source(old, new, "local")
    return table(spark, sf_dir, "documents").select(k.alias("id"), F.array_join(F.transform(out, lambda t: t["label"]), ",").alias("labels"))


@query("""
SELECT o_orderkey AS id, CASE o_orderkey % 4 WHEN 0 THEN 60.0 WHEN 1 THEN 50.0 WHEN 2 THEN 30.0 ELSE 25.0 END AS target_fps, 'apad,afade=t=out:st=' || printf('%.3f', greatest(o_orderkey % 7 - 2.5, 0)) || ':d=2.500' AS audio,
  '-ss ' || printf('%.6f', o_orderkey % 9 * 0.5) || ' -t 2.000000 -i f' || o_orderkey || ' -vf ' || CASE WHEN o_orderkey % 2 = 0 THEN 'setpts=2*PTS,' ELSE '' END || CASE WHEN o_orderkey % 3 = 0 THEN 'crop=608:1080,' ELSE '' END || 'scale=1920:1080,fps=' || CASE o_orderkey % 4 WHEN 0 THEN '60.0' WHEN 1 THEN '50.0' WHEN 2 THEN '30.0' ELSE '25.0' END || ' -crf 18 -an' AS command FROM orders""")
def encoder_commands(spark, sf_dir):
    k = F.col("o_orderkey")
    rate = export.target_rate(F.when(k % 4 == 0, 60.0), F.when(k % 4 <= 1, 50.0), F.when(k % 4 <= 2, 30.0), F.lit(25.0))
    o = table(spark, sf_dir, "orders").select(k.alias("id"), rate.alias("target_fps"), (k % 9 * 0.5).alias("plan_start_s"), (k % 9 * 0.5 + 2).alias("plan_end_s"), F.concat(F.lit("f"), k.cast("string")).alias("path"), F.when(k % 2 == 0, 2).otherwise(1).alias("ratio"), F.when(k % 3 == 0, "crop=608:1080").alias("crop"), F.lit(1920).alias("out_w"), F.lit(1080).alias("out_h"), F.lit(None).cast("string").alias("pad"), export.audio_filter((k % 7).cast("double"), 2.5).alias("audio"))
    return export.command(o).select("id", "target_fps", "audio", F.array_join("command", " ").alias("command"))


@query("SELECT user_id AS clip_count, 'x' AS dominant_tag FROM events GROUP BY 1")
def allowed_signals(spark, sf_dir):
    """What may leave: fields off the list do not."""
    return soundtrack.allowed(table(spark, sf_dir, "events").select(F.col("user_id").alias("clip_count"), F.lit("x").alias("dominant_tag"), F.lit("secret").alias("home_address")).distinct())


@query("""
WITH b AS (SELECT n_nationkey AS n, printf('beat %.3f', n_nationkey * 0.5) AS line FROM nation), c AS (SELECT r_regionkey AS n, printf('clip %.3f', coalesce(sum(r_regionkey + 1.5) OVER (ORDER BY r_regionkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS line FROM region)
SELECT line FROM b UNION ALL SELECT line FROM c""")
def beatmap_lines(spark, sf_dir):
    """The text file of beats and clips, read back."""
    path = f"{shared_folder(spark)}/beatmap-{uuid.uuid4().hex}"
    clips = table(spark, sf_dir, "region").select(F.col("r_regionkey").alias("order"), (F.col("r_regionkey") + 1.5).alias("duration_s"))
    store.beatmap(clips, table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 0.5).alias("time_s")), path)
    return spark.read.text(path).select(F.col("value").alias("line"))


@query("""
WITH p AS (SELECT n_nationkey AS edit, n_name AS t FROM nation), l AS (SELECT edit, unnest(['## Variant 1 (template)', '', '**Title**', '', lower(t), '', '**Description**', '', t || ', instrumental', '', '**Structure**', '', '```', '[sparse intro]', '[end]', '```', '']) AS line FROM p)
SELECT edit, line, count(*) AS n FROM l GROUP BY ALL""")
def prompt_file_lines(spark, sf_dir):
    """The prompt files of a few edits, read back."""
    folder = f"{shared_folder(spark)}/prompts-{uuid.uuid4().hex}"
    p = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("edit"), F.lit(1).alias("variant"), F.lit(None).cast("string").alias("origin"), F.lower("n_name").alias("title"), F.concat("n_name", F.lit(", instrumental")).alias("description"), F.array(F.lit("[sparse intro]"), F.lit("[end]")).alias("lines"))
    store.prompt_files(p, folder)
    read = spark.read.schema("value string, edit int").text(folder)
    return read.groupBy("edit", F.coalesce("value", F.lit("")).alias("line")).agg(F.count(F.lit(1)).alias("n"))
