"""Work that must not grow with the square of a table, and rows that differed from SQL at larger sizes."""

import random
from datetime import datetime, timedelta
from functools import reduce

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from strandlight.config import Config, Selection, Similarity
from strandlight.functions import scalar
from strandlight.operators import assembly, scoring, selection, similarity, telemetry
from strandlight.plans import ORACLES, QUERIES, pairs
from strandlight.sources import files
from tests.test_operators import plain_greedy

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


def test_a_selection_by_vectors_makes_no_pairs(spark):
    rng = random.Random(3)
    unit = [[rng.gauss(0, 1) for _ in range(4)] for _ in range(30)]
    vectors = [[x / sum(y * y for y in v) ** 0.5 for x in v] for v in unit]
    vectors[7], vectors[8], vectors[9], vectors[11] = vectors[6], None, [1.0, None, 0.0, 0.0], [1.0]
    rows = [{"project": "p", "id": f"c{i:02d}", "vector": v, "score": rng.random(), "file_id": str(i), "source_class": "generic", "cluster_id": None, "visit_id": None, "tag": None, "time_s": None, "pinned": False} for i, v in enumerate(vectors)]
    rows[7]["score"] = rows[6]["score"]
    whole = lambda v: v is not None and None not in v
    dot = lambda a, b: max(0.0, min(1.0, reduce(lambda t, p: t + p[0] * p[1], zip(a, b), 0.0))) if whole(a) and whole(b) and len(a) == len(b) else 0.0
    sims = {frozenset((a["id"], b["id"])): dot(a["vector"], b["vector"]) for a in rows for b in rows if a["id"] < b["id"]}
    schema = "project string, id string, vector array<double>, score double, file_id string, source_class string, cluster_id long, visit_id long, tag string, time_s double, pinned boolean"
    df = spark.createDataFrame(rows, schema)
    got = selection.select_near(df, similarity.semantic_near, Selection(), 8).collect()
    picks = [r.id for r in sorted((r for r in got if r.pick is not None), key=lambda r: r.pick)]
    assert len(got) == 30 and picks == plain_greedy(rows, sims, 8, 0.6)
    for r in got:
        own = [sims[frozenset((r.id, p))] for p in picks if p != r.id]
        if r.pick is None:
            assert r.similarity == max(own) and r.winner == (picks[own.index(max(own))] if max(own) > 0 else None)
    assert "CoGroup" not in plan(pairs.mmr_select(spark, SF)) and "Join" not in plan(pairs.mmr_select(spark, SF))


def test_the_whole_selection_makes_no_pairs_but_links_and_positions(spark, monkeypatch):
    def refused(*_, **__):
        raise AssertionError("pairs of all rows")

    monkeypatch.setattr(similarity, "pairs_within", refused)
    df = pairs.edit_candidates(spark, SF)
    assert pairs.select_edit(spark, SF).count() == df.count()


def test_combined_pairs_are_those_of_the_columns(spark):
    rng = random.Random(4)
    rows = [(i, i % 2, [rng.gauss(0, 0.5) for _ in range(3)], rng.choice([None, 0.001 * (i % 7)]), 0.002 * (i % 5), rng.choice([None, 50.0 * i]), rng.choice([None, 0, 1])) for i in range(60)]
    rows[3], rows[5], rows[8] = (3, 1, None, *rows[3][3:]), (5, 1, [1.0, None, 0.0], *rows[5][3:]), (8, 0, [1.0, 0.5], *rows[8][3:])
    df = spark.createDataFrame(rows, "id long, g int, vector array<double>, lat double, lon double, time_s double, faces int")
    config = Similarity(radius_m=900.0, semantic_floor=0.1)
    c = F.col
    p = similarity.pairs_within(df, ["g"], "id")
    signals = {"visual": F.lit(0.9), "semantic": similarity.semantic(c("a_vector"), c("b_vector"), 0.1), "spatial": similarity.spatial(c("a_lat"), c("a_lon"), c("b_lat"), c("b_lon"), 900.0), "temporal": similarity.temporal(c("a_time_s"), c("b_time_s"), 600.0)}
    whole = {(r.a_id, r.b_id): r.sim for r in p.withColumn("sim", similarity.combined(signals, config, c("a_faces"), c("b_faces"))).collect() if r.sim >= 0.25}
    got = {(r.a, r.b): r.sim for r in similarity.combined_pairs(df, "g", "id", config, 0.25, visual=0.9).collect()}
    assert got == pytest.approx(whole, abs=1e-12) and len(got) > 50
    load = lambda *a, **k: similarity.tile_pairs(*a, **k, tile=7, strip=3)
    series = df.select("id", "g", F.when(c("id") % 9 > 0, F.slice(F.array(*[(c("id") * k * k % 11).cast("double") for k in range(1, 7)]), 1, (c("id") % 5 + 2).cast("int"))).alias("series"))
    both = similarity.pairs_within(series, ["g"], "id").withColumn("sim", similarity.motion(c("a_series"), c("b_series")))
    moved = {(r.a_id, r.b_id): r.sim for r in both.where("sim >= 0.7").collect()}
    tiled = {(r.a, r.b): r.sim for r in load(series, "g", "id", similarity.Series.of, similarity.motion_array, 0.7).collect()}
    assert tiled == pytest.approx(moved, abs=1e-9) and len(tiled) > 50


def test_positions_are_compared_once(spark):
    points = spark.range(400).select("id", (F.col("id") % 5 * 0.01).alias("lat"), F.lit(9.0).alias("lon"))
    own = similarity.spots(points)
    assert own.select("spot").distinct().count() == 5 and similarity.spot_links(own, 1200.0).count() == 4
    got = [(r.a, r.b) for r in similarity.within_radius(points, 1200.0).collect()]
    assert sorted(got) == [(a, b) for a in range(400) for b in range(a + 1, 400) if abs(a % 5 - b % 5) <= 1]


def test_shares_are_printed_as_their_binary_values_demand(spark):
    values = [k / 1000 for k in range(1001)] + [0.125, 0.375, 2.675, 1.005, 12.345, 0.0, 7.0, 0.995, 0.29]
    df = spark.createDataFrame([(v,) for v in values], "x double").select("x", scalar.two_places(F.col("x")).alias("t"))
    assert [(r.x, r.t) for r in df.collect() if r.t != f"{r.x:.2f}"] == []


def test_a_probe_without_a_duration_over_0_has_0(spark):
    made = lambda d: '{"streams":[{"codec_type":"video","codec_name":"h264"}],"format":{"duration":' + d + "}}"
    df = spark.createDataFrame([(0, made('"0.0"')), (1, made("null")), (2, made('"2.5"'))], "id int, probe string")
    assert [r.duration_s for r in files.probe(df).orderBy("id").collect()] == [0.0, 0.0, 2.5]


def test_an_empty_span_has_the_nearest_frame_or_0(spark):
    spans = spark.createDataFrame([("a", "f", 0.5, 10.0), ("b", "f", 10.0, 20.0)], "seg_id string, file_id string, start_s double, end_s double")
    frames = spark.createDataFrame([("f", 0.0, 25.5), ("f", 12.0, 3.0)], "file_id string, time_s double, v double")
    got = {near: {r.seg_id: (r.frames, r.v) for r in telemetry.span_means(spans, frames, ["v"], nearest=near).collect()} for near in (True, False)}
    assert got == {True: {"a": (1, 25.5), "b": (1, 3.0)}, False: {"a": (0, 0.0), "b": (1, 3.0)}}


def test_a_window_that_is_not_moved_keeps_the_digits_of_its_start(spark):
    at = 520000.061451
    spans = spark.createDataFrame([("a", "f", 500000.0, 600000.0)], "seg_id string, file_id string, start_s double, end_s double")
    frames = spark.createDataFrame([("f", at, 5.0, 1.0)], "file_id string, time_s double, frame_score double, motion double")
    assert at + 15000.0 - 15000.0 != at
    assert [(r.start_s, r.moved) for r in scoring.snapped_windows(spans, frames, 30000.0, 40000.0, 0.3).collect()] == [(at, False)]


def test_a_long_span_is_spread_over_few_buckets(spark):
    spans = spark.createDataFrame([("a", "f", 0.0, 3e12), ("b", "f", 3e12, 3e12 + 1000), ("c", "f", 7.0, 7.0)], "seg_id string, file_id string, start_s double, end_s double")
    frames = spark.createDataFrame([("f", t, v) for t, v in ((-1.0, 9.0), (0.0, 1.0), (2e12, 2.0), (3e12 - 1, 6.0), (3e12, 4.0), (3e12 + 999, 5.0), (3e12 + 1000, 9.0))], "file_id string, time_s double, v double")
    got = telemetry.span_means(spans, frames, ["v"], nearest=False, also={"top": F.max("v")})
    assert sorted((r.seg_id, r.frames, r.v, r.top) for r in got.collect()) == [("a", 3, 3.0, 6.0), ("b", 2, 4.5, 5.0), ("c", 0, 0.0, None)]


def test_segments_take_heights_from_their_frames(spark):
    shots = spark.createDataFrame([("f", 0.0, 100.0), ("f", 100.0, 200.0), ("g", 0.0, 50.0)], "file_id string, start_s double, end_s double")
    cuts = spark.createDataFrame([("f", 40.0), ("f", 100.0), ("f", 400.0)], "file_id string, cut_s double")
    files = spark.createDataFrame([("f", "drone", 200.0), ("g", "phone", 50.0)], "file_id string, source_class string, duration_s double")
    frames = spark.createDataFrame([(f, float(t), t / 1000, float(t) if t % 20 else None) for f, n in (("f", 40), ("f", 110), ("g", 7)) for t in range(n, n + 60, 5)], "file_id string, time_s double, motion double, height_m double")
    frames = frames.withColumns({m: F.lit(0.5) for m in assembly.METRICS if m not in ("motion", "exposure_clipped")} | {"exposure_clipped": F.lit(0.0)})
    for nearest in (True, False):
        apart = assembly.segments(shots, cuts, frames.drop("height_m"), frames.select("file_id", "time_s", "height_m"), files, Config(), nearest=nearest)
        at_once = assembly.segments(shots, cuts, frames, None, files, Config(), nearest=nearest)
        assert sorted(map(repr, at_once.select(apart.columns).collect())) == sorted(map(repr, apart.collect()))
        assert at_once.count() == 4 and at_once.where("heights > 0").count() == 3


@pytest.mark.parametrize("name", ["snap_to_minimum", "best_window"])
def test_windows_have_the_means_of_their_own_events(spark, tmp_path, name):
    """At most two events a window, so that SQL has one sum for it, and many sums equal but for their last digit; one value dwarfs all later ones."""
    rng, rows = random.Random(5), []
    for user in range(20):
        at = 0
        for n in range(40):
            value = 1e17 if n == 0 and user % 2 else float("inf") if n == 0 and user == 4 else rng.randint(1, 12) / 20
            rows.append((len(rows), datetime(2024, 1, 1) + timedelta(seconds=at), user, value, '{"k": %d}' % rng.randint(0, 9)))
            at += rng.randint(15_001, 40_000)
    columns = [pa.array(c) for c in zip(*rows)]
    columns[1] = columns[1].cast(pa.timestamp("us"))
    pq.write_table(pa.table(columns, ["event_id", "ts", "user_id", "value", "props"]), tmp_path / "events.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    expected = con.sql(ORACLES[name])
    got = QUERIES[name](spark, str(tmp_path)).select(*expected.columns).collect()
    assert sorted(map(tuple, got)) == sorted(expected.fetchall())
