"""Image metrics.  Stand-ins: an event is a frame of its user's recording, eight by eight pixels of one grey on the left and another on the right."""

from __future__ import annotations

from pyspark.sql import functions as F

from strandlight.operators import images
from strandlight.plans.registry import query
from strandlight.plans.series import ONE, single


@query(f"""
WITH e AS {ONE}, f AS (SELECT event_id, user_id, t, CAST(floor(value) AS INT) % 256 AS a, CAST(k AS INT) * 5 % 256 AS b FROM e),
p AS (SELECT *, lag(a) OVER w AS pa, lag(b) OVER w AS pb, lead(a) OVER w AS na, lead(b) OVER w AS nb FROM f WINDOW w AS (PARTITION BY user_id ORDER BY t))
SELECT user_id AS file_id, round(t, 3) AS time_s, (b - a) * (b - a) / 4.0 AS sharpness, (CASE WHEN a IN (0, 255) THEN 0.5 ELSE 0 END + CASE WHEN b IN (0, 255) THEN 0.5 ELSE 0 END) AS exposure_clipped, 0.0 AS colorfulness,
  round(coalesce(abs(a - pa) + abs(b - pb), abs(na - a) + abs(nb - b), 0) / 510.0, 6) AS motion, round(coalesce(abs(a - pa) + abs(b - pb), 0) / 1530.0, 6) AS content,
  CASE WHEN a = b THEN 0 WHEN b > a THEN 1085102592571150095 ELSE -1085102592571150096 END AS hash,
  CASE WHEN a // 32 = b // 32 THEN CAST(a // 32 AS VARCHAR) ELSE least(a // 32, b // 32) || ',' || greatest(a // 32, b // 32) END AS bins FROM p""")
def image_metrics(spark, sf_dir):
    e = single(spark, sf_dir)
    two = lambda c: F.lpad(F.hex(c), 2, "0")
    a, b = (F.floor("value") % 256).cast("int"), (F.col("k").cast("int") * 5 % 256).cast("int")
    line = F.concat(F.repeat(two(a), 12), F.repeat(two(b), 12))
    frames = e.select(F.col("user_id").alias("file_id"), F.col("t").alias("time_s"), F.lit(8).alias("height"), F.lit(8).alias("width"), F.unhex(F.repeat(line, 8)).alias("pixels"))
    out = images.frame_metrics(frames)
    used = F.filter(F.transform("histogram", lambda x, i: F.when(x > 0, (i / 73).cast("int"))), lambda x: x.isNotNull())
    return out.select("file_id", F.round("time_s", 3).alias("time_s"), "sharpness", "exposure_clipped", "colorfulness", F.round("motion", 6).alias("motion"), F.round("content", 6).alias("content"), "hash", F.array_join(F.transform(used, lambda x: x.cast("string")), ",").alias("bins"))
