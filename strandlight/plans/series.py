"""Time-series queries.  Stand-ins: a user's events are a recording's samples; seconds count from the user's first event."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from strandlight.operators import scoring, series, similarity, telemetry
from strandlight.plans.registry import query, table
from strandlight.plans.segments import TIMED, timed
from strandlight.session import kept

#: at most one event a user and second, so that order by time is total
ONE = f"(SELECT event_id, user_id, t, value, k FROM (SELECT *, row_number() OVER (PARTITION BY user_id, t ORDER BY event_id) AS rn FROM ({TIMED})) WHERE rn = 1)"


def single(spark, sf_dir):
    w = Window.partitionBy("user_id", "t").orderBy("event_id")
    return timed(spark, sf_dir).withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


@query(f"""
WITH e AS {ONE}, d AS (SELECT event_id, abs(value - lag(value) OVER w) AS a, abs(lead(value) OVER w - value) AS b FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, round(coalesce(a, b, 0), 6) AS motion FROM d""")
def motion_series_lag(spark, sf_dir):
    return series.motion_series(single(spark, sf_dir), "value", "user_id", "t").select("event_id", F.round("motion", 6).alias("motion"))


@query(f"""
WITH e AS {ONE}, d AS (SELECT event_id, count(*) OVER (PARTITION BY user_id) AS n, avg(value) OVER w AS m, stddev_pop(value) OVER w AS s FROM e
  WINDOW w AS (PARTITION BY user_id ORDER BY t ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING))
SELECT event_id, round(CASE WHEN n < 5 OR m <= 0 THEN 1 ELSE 1 - least(greatest(s / m, 0), 1) END, 6) AS stability FROM d""")
def stability_rolling(spark, sf_dir):
    return series.stability(single(spark, sf_dir), "value", 5, "user_id", "t").select("event_id", F.round("stability", 6).alias("stability"))


@query(f"""
WITH e AS {ONE}, d AS (SELECT event_id, value AS v, lag(value) OVER w AS b, lead(value) OVER w AS a FROM e WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT event_id FROM d WHERE b IS NOT NULL AND a IS NOT NULL AND ((v < b AND v <= a) OR (v <= b AND v < a))""")
def motion_minima(spark, sf_dir):
    return scoring.motion_minima(single(spark, sf_dir), "user_id", "t", "value").select("event_id")


@query(f"""
WITH e AS {ONE}, d AS (SELECT user_id, t, value < 100 AS below, lag(value < 100) OVER (PARTITION BY user_id ORDER BY t) AS was, min(t) OVER (PARTITION BY user_id) AS a, max(t) OVER (PARTITION BY user_id) AS b FROM e)
SELECT DISTINCT user_id, round(round_even(t * 2, 0) / 2, 6) AS cut_s FROM d WHERE was IS NOT NULL AND below <> was AND round(round_even(t * 2, 0) / 2, 6) > a AND round(round_even(t * 2, 0) / 2, 6) < b""")
def altitude_split(spark, sf_dir):
    return series.altitude_cuts(single(spark, sf_dir), 100.0, "user_id", "t", "value")


@query(f"""
WITH RECURSIVE e AS {ONE}, c AS (SELECT user_id, t, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e WHERE value >= 300),
f AS (SELECT user_id, min(t) AS a, max(t) AS b FROM e GROUP BY 1),
r AS (SELECT user_id, CAST(0 AS BIGINT) AS i, a AS last, CAST(NULL AS DOUBLE) AS cut FROM f
  UNION ALL SELECT r.user_id, r.i + 1, CASE WHEN c.t - r.last >= 40000 AND f.b - c.t >= 40000 THEN c.t ELSE r.last END, CASE WHEN c.t - r.last >= 40000 AND f.b - c.t >= 40000 THEN c.t END
  FROM r JOIN c ON c.user_id = r.user_id AND c.i = r.i + 1 JOIN f ON f.user_id = r.user_id),
p AS (SELECT user_id, cut AS z FROM r WHERE cut IS NOT NULL UNION ALL SELECT user_id, a FROM f UNION ALL SELECT user_id, b FROM f),
s AS (SELECT user_id, z AS start_s, lead(z) OVER (PARTITION BY user_id ORDER BY z) AS end_s FROM p)
SELECT user_id, round(start_s, 6) AS start_s, round(end_s, 6) AS end_s FROM s WHERE end_s IS NOT NULL""")
def shot_cuts_fold(spark, sf_dir):
    out = series.shot_cuts(single(spark, sf_dir), 300.0, 40000.0, "user_id", "t", "value")
    return out.select("user_id", F.round("start_s", 6).alias("start_s"), F.round("end_s", 6).alias("end_s"))


@query(f"""
WITH e AS {ONE}, d AS (SELECT event_id, user_id, t, CASE WHEN t - lag(t) OVER (PARTITION BY user_id ORDER BY t, event_id) > 7200 THEN 1 ELSE 0 END AS new FROM e)
SELECT event_id, user_id, CAST(sum(new) OVER (PARTITION BY user_id ORDER BY t, event_id) AS BIGINT) AS visit FROM d""")
def visits_by_gap(spark, sf_dir):
    return series.visits(single(spark, sf_dir), 7200.0, ["user_id"], "t", "event_id").select("event_id", "user_id", "visit")


@query(f"""
WITH e AS {ONE}, n AS (SELECT *, count(*) OVER (PARTITION BY user_id) AS n, row_number() OVER (PARTITION BY user_id ORDER BY value, t) AS o, row_number() OVER (PARTITION BY user_id ORDER BY t) AS i FROM e),
r AS (SELECT *, CASE WHEN n = 1 THEN 0.5 ELSE (o - 1) / (n - 1) END AS r FROM n),
s AS (SELECT *, CASE WHEN n >= 3 THEN (coalesce(lag(r) OVER w, 0) + r + coalesce(lead(r) OVER w, 0)) / 3 WHEN n = 2 THEN (coalesce(lag(r) OVER w, 0) + r) / 2 ELSE r END AS s FROM r WINDOW w AS (PARTITION BY user_id ORDER BY t)),
c AS (SELECT event_id, CASE WHEN n = 1 THEN s WHEN i = 1 THEN (s + lead(s) OVER w) / 2 WHEN i = n AND n = 2 THEN (s + (lag(s) OVER w + s) / 2) / 2 WHEN i = n THEN (s + lag(s) OVER w) / 2 ELSE s END AS c FROM s WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT event_id, round(least(greatest(c, 0), 1), 6) AS energy FROM c""")
def energy_curve(spark, sf_dir):
    return series.energy_curve(single(spark, sf_dir), "value", "t", "user_id").select("event_id", F.round("energy", 6).alias("energy"))


@query(f"""
WITH e AS {ONE}, a AS (SELECT user_id, ntile(3) OVER (PARTITION BY user_id ORDER BY t) - 1 AS third, value FROM e), m AS (SELECT user_id, third, avg(value) AS mean FROM a GROUP BY 1, 2),
p AS (SELECT user_id, third AS peak_third FROM m QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY round(mean, 9) DESC, third) = 1),
b AS (SELECT user_id, least((row_number() OVER (PARTITION BY user_id ORDER BY t) - 1) // greatest(count(*) OVER (PARTITION BY user_id) // 3, 1), 2) AS third, value FROM e)
SELECT user_id, CAST(peak_third AS INT) AS peak_third, CAST(b.third AS INT) AS third, round(avg(value), 6) AS mean FROM p JOIN b USING (user_id) GROUP BY ALL""")
def peak_third(spark, sf_dir):
    e = single(spark, sf_dir)
    shape = series.shape_thirds(e, "user_id", "t", "value").select("user_id", "third", F.round("mean", 6).alias("mean"))
    return series.peak_third(e, "user_id", "t", "value").join(shape, "user_id").select("user_id", F.col("peak_third").cast("int").alias("peak_third"), "third", "mean")


@query(f"""
WITH e AS {ONE}, p AS (SELECT user_id, value, count(*) OVER (PARTITION BY user_id) // 8 AS per, row_number() OVER (PARTITION BY user_id ORDER BY t, event_id) - 1 AS i FROM e)
SELECT user_id, CAST(i // per AS BIGINT) AS slice, min(value) AS low, max(value) AS high FROM p WHERE per > 0 AND i // per < 8 GROUP BY ALL""")
def envelope_minmax(spark, sf_dir):
    return series.envelope(single(spark, sf_dir), 8, "user_id", ["t", "event_id"], "value")


@query(f"""
WITH e AS {ONE}, g AS (SELECT user_id, (t - lag(t) OVER (PARTITION BY user_id ORDER BY t)) AS gap FROM e), q AS (SELECT user_id, gap FROM g WHERE gap > 0),
m AS (SELECT user_id, median(gap) AS md FROM q GROUP BY 1), a AS (SELECT q.user_id, avg(gap) AS av FROM q JOIN m USING (user_id) WHERE abs(gap - md) <= 0.5 * md GROUP BY 1)
SELECT DISTINCT e.user_id, coalesce(round(60000 / av, 1), 0) AS bpm FROM e LEFT JOIN a USING (user_id)""")
def bpm_from_beats(spark, sf_dir):
    """A thousandth of the time between events stands for the time between beats."""
    beats = single(spark, sf_dir).select("user_id", (F.col("t") / 1000).alias("t"))
    return series.bpm_of_beats(beats, "user_id", "t")


#: spans of 100,000 s from each user's first event up to and with the last, windows of 30,000 s
SPANS = f"e AS {ONE}, l AS (SELECT user_id, CAST(floor(max(t) / 100000) AS BIGINT) AS n FROM e GROUP BY 1), spans AS (SELECT user_id || ':' || i AS seg_id, user_id, i * 100000.0 AS a, (i + 1) * 100000.0 AS b FROM (SELECT user_id, unnest(range(n + 1)) AS i FROM l))"
MEANS = """
c AS (SELECT seg_id, s.user_id, a, b, t AS c FROM spans s JOIN e ON e.user_id = s.user_id AND t >= a AND t < b WHERE t + 30000 <= b UNION SELECT seg_id, user_id, a, b, b - 30000 FROM spans),
m AS (SELECT seg_id, c.user_id, a, b, c, avg(value) AS mean FROM c LEFT JOIN e ON e.user_id = c.user_id AND t >= c AND t < c + 30000 GROUP BY ALL),
f AS (SELECT DISTINCT seg_id FROM spans s JOIN e ON e.user_id = s.user_id AND t >= a AND t < b),
best AS (SELECT seg_id, c, mean FROM m QUALIFY row_number() OVER (PARTITION BY seg_id ORDER BY coalesce(mean, '-inf'::DOUBLE) DESC, c) = 1)"""


def scored(spark, sf_dir):
    return single(spark, sf_dir).select(F.col("user_id").alias("file_id"), F.col("t").alias("time_s"), F.col("value").alias("frame_score"), F.col("k").alias("motion"))


def spans(spark, sf_dir):
    """Spans of 100,000 s end to end, from each user's first event up to and with the last."""
    e = scored(spark, sf_dir)
    # the last time doesn't depend on which event of a second is taken; a row a user, kept
    last = kept(timed(spark, sf_dir).groupBy(F.col("user_id").alias("file_id")).agg(F.floor(F.max("t") / 100000).alias("last")))
    s = last.select("file_id", F.explode(F.sequence(F.lit(0).cast("long"), "last")).alias("i"))
    return s.select(F.concat_ws(":", "file_id", "i").alias("seg_id"), "file_id", (F.col("i") * 100000.0).alias("start_s"), ((F.col("i") + 1) * 100000.0).alias("end_s")), e


@query(f"""
WITH {SPANS}, {MEANS}
SELECT s.seg_id, round(CASE WHEN f.seg_id IS NULL THEN (a + b) / 2 ELSE best.c + 15000 END, 4) AS centre_s, 30000.0::DOUBLE AS duration_s FROM spans s LEFT JOIN best USING (seg_id) LEFT JOIN f ON f.seg_id = s.seg_id""")
def best_window(spark, sf_dir):
    s, e = spans(spark, sf_dir)
    return scoring.best_windows(s, e, 30000.0).select("seg_id", F.round("centre_s", 4).alias("centre_s"), "duration_s")


@query(f"""
WITH {SPANS}, {MEANS},
w AS (SELECT best.seg_id, best.c AS c0, best.mean AS m0 FROM best JOIN f USING (seg_id) WHERE mean IS NOT NULL),
lows AS (SELECT user_id, t, k FROM (SELECT user_id, t, k, lag(k) OVER x AS p, lead(k) OVER x AS n FROM e WINDOW x AS (PARTITION BY user_id ORDER BY t)) WHERE p IS NOT NULL AND n IS NOT NULL AND ((k < p AND k <= n) OR (k <= p AND k < n))),
z AS (SELECT w.seg_id, m.c FROM w JOIN m USING (seg_id) JOIN lows ON lows.user_id = m.user_id AND lows.t = m.c
  WHERE m0 > 0 AND abs(m.c - c0) > 0 AND abs(m.c - c0) <= 40000 AND m.c >= a AND m.c + 30000 <= b AND (m0 - m.mean) / m0 <= 0.3 QUALIFY row_number() OVER (PARTITION BY w.seg_id ORDER BY k, abs(m.c - c0), m.c) = 1)
SELECT w.seg_id, round(coalesce(z.c, c0), 4) AS start_s, z.c IS NOT NULL AS moved FROM w LEFT JOIN z USING (seg_id)""")
def snap_to_minimum(spark, sf_dir):
    s, e = spans(spark, sf_dir)
    return snapped(s, e)


def snapped(s, e):
    return scoring.snapped_windows(s, e, 30000.0, 40000.0, 0.3).select("seg_id", (F.round(F.col("start_s") * 10000) / 10000).alias("start_s"), "moved")


@query(f"""
WITH e AS {ONE}, g AS (SELECT * FROM e WHERE value < 250), x AS (SELECT e.event_id, g.value AS lat, g.k AS lon, row_number() OVER (PARTITION BY e.event_id ORDER BY abs(g.t - e.t), g.event_id) AS rn FROM e JOIN g USING (user_id) WHERE e.event_id % 20 = 0)
SELECT event_id AS seg_id, lat, lon FROM x WHERE rn = 1""")
def nearest_fix(spark, sf_dir):
    e = single(spark, sf_dir)
    targets = e.where("event_id % 20 = 0").select(F.col("event_id").alias("seg_id"), F.col("user_id").alias("file_id"), F.col("t").alias("time_s"))
    fixes = e.select(F.col("user_id").alias("file_id"), F.col("event_id").alias("seq"), F.col("t").alias("time_s"), F.when(F.col("value") < 250, F.col("value")).alias("lat"), F.col("k").alias("lon"))
    return similarity.nearest_fix(targets, fixes).where("lat is not null")


@query(f"""
WITH e AS {ONE}, s AS (SELECT user_id, shot_idx, shot_idx * 400000.0 AS a, (shot_idx + 1) * 400000.0 AS b FROM (SELECT DISTINCT user_id FROM e), range(4) r(shot_idx)),
h AS (SELECT e.event_id, min(CASE WHEN t >= a AND t < b THEN shot_idx END) AS i, max(shot_idx) AS l FROM e JOIN s USING (user_id) GROUP BY 1)
SELECT event_id AS seg_id, CAST(coalesce(i, l) AS INT) AS shot_idx FROM h""")
def shot_of_span(spark, sf_dir):
    e = single(spark, sf_dir).select(F.col("event_id").alias("seg_id"), F.col("user_id").alias("file_id"), F.col("t").alias("time_s"))
    shots = e.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shot_idx")).withColumns({"start_s": F.col("shot_idx") * 400000.0, "end_s": (F.col("shot_idx") + 1) * 400000.0})
    return telemetry.shot_of(e, shots)


@query(f"""
WITH e AS {ONE}, s AS (SELECT user_id, shot_idx, shot_idx * 400000.0 AS a, (shot_idx + 1) * 400000.0 AS b FROM (SELECT DISTINCT user_id FROM e), range(4) r(shot_idx)),
n AS (SELECT s.user_id, shot_idx, event_id, row_number() OVER (PARTITION BY s.user_id, shot_idx ORDER BY abs(t - (a + b) / 2), event_id) AS rn FROM s JOIN e USING (user_id))
SELECT user_id AS file_id, CAST(shot_idx AS INT) AS shot_idx, event_id AS frame_idx FROM n WHERE rn = 1""")
def representative_frame(spark, sf_dir):
    e = single(spark, sf_dir).select(F.col("event_id").alias("frame_idx"), F.col("user_id").alias("file_id"), F.col("t").alias("time_s"))
    shots = e.select("file_id").distinct().select("file_id", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("shot_idx")).withColumns({"start_s": F.col("shot_idx") * 400000.0, "end_s": (F.col("shot_idx") + 1) * 400000.0})
    return telemetry.representative_frames(shots, e)


@query("""
SELECT user_id AS file_id, count(*) AS sample_count, min(value) AS min_height_m, max(value) AS max_height_m, round(avg(CAST(json_extract_string(props, '$.k') AS DOUBLE)), 6) AS mean_speed_ms FROM events GROUP BY 1""")
def telemetry_summary(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("file_id"), F.unix_micros(F.col("ts").cast("timestamp")).alias("time_s"), F.col("value").alias("height_m"), F.get_json_object("props", "$.k").cast("double").alias("speed_h_ms"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lon"))
    return telemetry.summary(e).select("file_id", "sample_count", "min_height_m", "max_height_m", F.round("mean_speed_ms", 6).alias("mean_speed_ms"))


@query("""
SELECT user_id AS file_id, event_id AS cue, event_id % 3600 * 1.0 AS time_s, round(value, 1) AS height_m, CASE WHEN event_id % 4 > 0 THEN event_id % 90 * 1.0 END AS lat, CASE WHEN event_id % 4 > 0 THEN (event_id % 340 - 170) * 1.0 END AS lon, CAST(event_id % 800 AS INT) AS iso, 1.0 AS ev, -0.5 AS speed_v_ms FROM events""")
def srt_parse(spark, sf_dir):
    """Lines of subtitles written from the events, parsed back."""
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.round("value", 1).alias("h"))
    second = (F.col("event_id") % 3600).cast("int")
    stamp = F.format_string("00:%02d:%02d,000", F.floor(second / 60), second % 60)
    gps = F.when(F.col("event_id") % 4 > 0, F.format_string("GPS (%+d, %+d.0, 10)", F.col("event_id") % 340 - 170, F.col("event_id") % 90)).otherwise("")
    body = F.concat(F.lit("<font>H "), F.col("h").cast("string"), F.lit("m, ISO "), (F.col("event_id") % 800).cast("string"), F.lit(", EV +1.0, V.S -0.50m/s</font>"))
    rows = F.array(F.col("event_id").cast("string"), F.concat(stamp, F.lit(" --> "), stamp), gps, body, F.lit(""))
    lines = e.select(F.col("user_id").alias("file_id"), "event_id", F.posexplode(rows).alias("p", "line")).select("file_id", (F.col("event_id") * 5 + F.col("p")).alias("n"), "line")
    # a cue's number within its file, back to the event that wrote it
    found = telemetry.samples(telemetry.cues(lines))
    order = e.select(F.col("user_id").alias("file_id"), "event_id", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")).cast("long").alias("cue"))
    return found.join(order, ["file_id", "cue"]).select("file_id", F.col("event_id").alias("cue"), "time_s", "height_m", "lat", "lon", "iso", "ev", "speed_v_ms")
