"""Text and JSON: prompt validation, probe answers, provider answers, cues, listings."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.functions import scalar as S
from strandlight.operators import soundtrack, tags, telemetry
from strandlight.plans.registry import query, table
from strandlight.sources import files, store


#: a structure that keeps every rule, and eight variants of it by item_id % 8: the rule that each breaks, and where
STRUCTURE = ("[sparse intro]", "[guitar intro]", "[sunny intro]", "[steady verse]", "[drums verse]", "[sunny verse]", "[driving drop]", "[guitar drop]", "[drums drop]", "[fading outro]", "[guitar outro]", "[drums outro]", "[end]")
VARIANTS = (
    (STRUCTURE, ()),
    ((*STRUCTURE[:3], "[warm verse] [soft verse]", *STRUCTURE[3:]), (("multiple_tags_on_line", 4),)),
    ((*STRUCTURE[:2], "[slow, dark intro]", *STRUCTURE[3:]), (("comma_in_tag", 3), ("section_tag_count", None))),
    (("[slow dark sparse intro]", *STRUCTURE[1:]), (("too_many_modifiers", 1),)),
    (STRUCTURE[:-1], (("missing_end", 12),)),
    (("[soft vocals intro]", *STRUCTURE[1:]), (("vocal_tag", 1), ("section_tag_count", None))),
    (("[filtered intro]", *STRUCTURE[1:4], "[]", "[loud refrain]", *STRUCTURE[4:]), (("production_modifier", 1), ("unknown_section", 5), ("unknown_section", 6))),
    ((), (("missing_end", None), ("instrument_coverage", None), ("instrument_coverage", None))),
)
BROKEN = ", ".join(f"({k}, '{rule}', {'NULL' if line is None else line})" for k, (_, rules) in enumerate(VARIANTS) for rule, line in rules)


@query(f"""
WITH b AS (SELECT item_id, text AS d, list_filter(list_transform(string_split(text, ','), lambda x: regexp_replace(x, '^\\s+|\\s+$', '', 'g')), lambda x: x <> '') AS p FROM benchmark),
n AS (SELECT *, list_transform(p, lambda x: lower(x)) AS low, list_filter(p, lambda x: len(list_filter(regexp_split_to_array(x, '\\s+'), lambda w: w <> '')) > 5) AS wordy FROM b),
v AS (SELECT item_id, 'description_too_long' AS rule FROM n WHERE length(d) > 200 UNION ALL SELECT item_id, 'description_descriptor_count' FROM n WHERE NOT len(p) BETWEEN 4 AND 7
UNION ALL SELECT item_id, 'description_sentence' FROM n WHERE contains(d, '. ') OR ends_with(trim(d), '.') UNION ALL SELECT item_id, 'description_sentence' FROM (SELECT item_id, unnest(wordy) FROM n)
UNION ALL SELECT item_id, 'description_repeated' FROM n WHERE len(low) <> len(list_distinct(low)) UNION ALL SELECT item_id, 'missing_instrumental' FROM n WHERE len(low) < 2 OR low[-2] <> 'no vocals' OR low[-1] <> 'instrumental'),
s AS (SELECT * FROM (VALUES {BROKEN}) t(k, rule, line))
SELECT item_id AS prompt_id, rule, CAST(NULL AS INT) AS line FROM v UNION ALL SELECT item_id, rule, CAST(line AS INT) FROM benchmark JOIN s ON k = item_id % 8""")
def prompt_validate(spark, sf_dir):
    """Whole benchmark texts as descriptions, with structures whose faults are known."""
    lines = F.lit(None)
    for k, (structure, _) in enumerate(VARIANTS):
        lines = F.when(F.col("item_id") % 8 == k, F.array(*[F.lit(x) for x in structure]).cast("array<string>")).otherwise(lines)
    instruments = F.array(F.lit("twangy reverb guitar"), F.lit("driving drums"))
    p = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("prompt_id"), F.col("text").alias("description"), lines.alias("lines"), instruments.alias("instruments"))
    return soundtrack.violations(p)


@query("""
SELECT user_id AS edit, 'surf rock, ' || CASE WHEN user_id % 3 = 0 THEN 'twangy reverb guitar' WHEN user_id % 3 = 1 THEN 'shimmering tremolo guitar' END || ', driving drums, sunny, 128 bpm, no vocals, instrumental' AS description, CASE WHEN user_id % 2 = 0 THEN 17 ELSE 13 END AS n, 0 AS broken
FROM (SELECT DISTINCT user_id FROM events) WHERE user_id % 3 < 2""")
def prompt_build(spark, sf_dir):
    """Two variants of a prompt for each edit; what is built breaks no rule."""
    words = lambda *w: F.array(*[F.lit(x) for x in w])
    edits = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 3 < 2")
    edits = edits.select("user_id", F.lit("beach").alias("subject"), F.lit("evening").alias("time_of_day"), F.lit("peak-middle").alias("shape"), F.lit(128).alias("bpm"), F.lit("surf rock").alias("genre"), words("twangy reverb guitar", "driving drums", "warm bass").alias("instruments"), words("shimmering tremolo guitar").alias("instrument_alternates"), words("sunny").alias("mood"), words().cast("array<string>").alias("mood_alternates"))
    shaped = edits.withColumn("shape", F.when(F.col("user_id") % 2 == 0, "peak-late").otherwise("flat"))
    first, second = soundtrack.build_prompts(shaped.where("user_id % 3 = 0"), 0), soundtrack.build_prompts(shaped.where("user_id % 3 = 1"), 1)
    built = first.unionByName(second).select(F.col("user_id").alias("prompt_id"), "description", "lines", F.col("prompt_instruments").alias("instruments"))
    return prompts_checked(built)


def prompts_checked(built):
    broken = soundtrack.violations(built).groupBy("prompt_id").agg(F.count(F.lit(1)).alias("broken"))
    return built.join(broken, "prompt_id", "left").select(F.col("prompt_id").alias("edit"), "description", F.size("lines").alias("n"), F.coalesce("broken", F.lit(0)).alias("broken"))


@query("""
SELECT event_id, round(value, 3) AS duration_s, CASE WHEN event_id % 2 = 0 THEN 1080 ELSE 1920 END AS display_width, CASE WHEN event_id % 2 = 0 THEN 1920 ELSE 1080 END AS display_height, 'yuv420p10le' AS pix_fmt, 10 AS bit_depth,
  CASE WHEN event_id % 5 = 0 THEN 25.0 ELSE 50.0 END AS fps, CAST(event_id % 80 AS DOUBLE) AS lat, CASE WHEN event_id % 2 = 0 THEN 270 ELSE 0 END AS rotation FROM events""")
def json_probe_parse(spark, sf_dir):
    k = F.col("event_id")
    probe = F.concat(F.lit('{"streams":[{"index":0,"codec_type":"video","codec_name":"mjpeg","disposition":{"attached_pic":1}},{"index":1,"codec_type":"video","codec_name":"h264","width":1920,"height":1080,"pix_fmt":"yuv420p10le","avg_frame_rate":"'), F.when(k % 5 == 0, "0/0").otherwise("50/1"), F.lit('","r_frame_rate":"25/1","tags":{'), F.when(k % 2 == 0, '"rotate":"90"').otherwise(""), F.lit('}}],"format":{"duration":"'), F.round("value", 3).cast("string"), F.lit('","tags":{"location":"+'), F.format_string("%02d.0", k % 80), F.lit('-010.5/"}}}'))
    out = files.probe(table(spark, sf_dir, "events").select("event_id", probe.alias("probe")))
    return out.select("event_id", "duration_s", "display_width", "display_height", "pix_fmt", "bit_depth", "fps", F.col("gps.lat").alias("lat"), "rotation")


@query("""
SELECT doc_id, CASE WHEN doc_id % 4 = 0 THEN 0 ELSE 2 END AS tags, CASE WHEN doc_id % 4 > 0 THEN source || ' in ' || lang END AS caption, CASE WHEN doc_id % 4 > 0 THEN least(greatest(doc_id % 14 * 1.0, 1), 10) END AS aesthetic, CASE WHEN doc_id % 4 = 0 THEN 'empty answer' END AS problem FROM documents""")
def answer_validation(spark, sf_dir):
    k = F.col("doc_id")
    good = F.concat(F.lit('```json\n{"tags":[" Sea ","sea","SKY",""],"caption":" '), F.col("source"), F.lit("  in "), F.col("lang"), F.lit('.","aesthetic":'), (k % 14).cast("string"), F.lit("}\n```"))
    a = table(spark, sf_dir, "documents").select("doc_id", F.when(k % 4 == 0, "no json here").otherwise(good).alias("answer"))
    return tags.valid_answer(a).select("doc_id", F.size("tags").alias("tags"), "caption", "aesthetic", "problem")


@query("""
WITH f AS (SELECT DISTINCT 'd' || (page_id % 7) || '/' || CASE WHEN page_id % 11 = 0 THEN '.hidden/' ELSE '' END || 'C' || page_id AS stem, page_id FROM pages),
x AS (SELECT page_id, stem || CASE page_id % 3 WHEN 0 THEN '.MP4' WHEN 1 THEN '.mov' ELSE '.txt' END AS path, stem FROM f)
SELECT path, CASE WHEN page_id % 2 = 0 THEN lower(stem) || '.lrv' END AS proxy_path FROM x WHERE page_id % 3 < 2 AND page_id % 11 <> 0""")
def folder_scan(spark, sf_dir):
    k = F.col("page_id")
    stem = F.concat(F.lit("d"), (k % 7).cast("string"), F.lit("/"), F.when(k % 11 == 0, ".hidden/").otherwise(""), F.lit("C"), k.cast("string"))
    p = table(spark, sf_dir, "pages").select(stem.alias("s"), k)
    main = p.select(F.concat("s", F.when(k % 3 == 0, ".MP4").when(k % 3 == 1, ".mov").otherwise(".txt")).alias("path"))
    every = main.unionByName(main).unionByName(p.where(k % 2 == 0).select(F.concat(F.lower("s"), F.lit(".lrv")).alias("path")))
    return files.companions(files.scan(every), every, files.PROXIES, "proxy_path").select("path", "proxy_path")


@query("""
WITH c AS (SELECT c_custkey AS id, round(c_custkey * 0.0004, 3) AS la, round(c_custkey % 50 * 0.0006, 3) AS lo FROM customer), g AS (SELECT DISTINCT la, lo FROM c WHERE (CAST(round(la * 1000) AS INT)) % 2 = 0)
SELECT id, CASE WHEN g.la IS NULL THEN NULL ELSE CASE CAST(round(c.la * 1000) AS INT) % 8 WHEN 0 THEN 'La Pelosa' WHEN 2 THEN 'Stintino' WHEN 4 THEN 'Somewhere' ELSE 'Roma' END END AS name,
  CASE WHEN g.la IS NULL THEN NULL ELSE CASE CAST(round(c.la * 1000) AS INT) % 8 WHEN 0 THEN 'Sardegna' WHEN 2 THEN 'Sardegna' WHEN 4 THEN 'Italia' ELSE 'Lazio' END END AS region FROM c LEFT JOIN g USING (la, lo)""")
def reverse_geocode(spark, sf_dir):
    """Addresses of four kinds: a beach before its village, a village, blanks alone, and a region that repeats the name."""
    k = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(k.alias("id"), (k * 0.0004).alias("lat"), (k % 50 * 0.0006).alias("lon"))
    milli = F.round(F.round("lat", 3) * 1000).cast("int")
    g = c.select(F.round("lat", 3).alias("lat"), F.round("lon", 3).alias("lon")).distinct().where(milli % 2 == 0)
    made = lambda **address: F.create_map(*[F.lit(x) for pair in address.items() for x in pair])
    beach = made(village="Stintino", beach="La Pelosa", state="Sardegna", country="Italia")
    village = made(village=" Stintino ", county=" ", state="Sardegna", country="Italia")
    blank = made(village=" ", suburb="", county="Somewhere", country="Italia")
    twice = made(city="Roma", county="Roma", state="Lazio", country="Italia")
    address = F.when(milli % 8 == 0, beach).when(milli % 8 == 2, village).when(milli % 8 == 4, blank).otherwise(twice)
    return store.reverse_geocoded(c, g.select("lat", "lon", F.lit("Somewhere").alias("name"), address.alias("address"))).select("id", "name", "region")


@query("SELECT doc_id, CASE WHEN n_chars % 5 = 0 THEN -1 ELSE CAST(least(greatest(doc_id % 1000, 0), n_chars % 5 - 1) AS INT) END AS i FROM documents")
def clamped_index(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", telemetry.clamped_index(F.concat(F.lit("f:"), (F.col("doc_id") % 1000).cast("string")), F.col("n_chars") % 5).alias("i"))


@query("""
SELECT doc_id, 'c' || (n_chars % 4) AS first_word, floor(n_chars * 1.0 / 600) || ':' || printf('%04.1f', (n_chars % 600) / 10.0) AS clock FROM documents WHERE false
UNION ALL SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'loud' WHEN doc_id % 3 = 1 THEN 'calm' ELSE 'odd' END, CAST(n_chars // 600 AS VARCHAR) || ':' || printf('%04.1f', (n_chars % 600) / 10.0) FROM documents""")
def mood_and_clock(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    pool = F.when(F.col("doc_id") % 3 == 0, F.array(F.lit("odd"), F.lit("calm"), F.lit("loud"))).when(F.col("doc_id") % 3 == 1, F.array(F.lit("still"), F.lit("calm"))).otherwise(F.array(F.lit("odd"), F.lit("still")))
    return d.select("doc_id", soundtrack.mood_words(pool, ["still", "calm", "warm", "bright", "loud"], True)[0].alias("first_word"), S.timecode(F.col("n_chars") / 10).alias("clock"))
