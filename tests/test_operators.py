"""Scenarios on small tables: edges, ties, boundaries, absent values."""

import random

import pytest
from pyspark.sql import functions as F

from strandlight.config import Config, Durations, Rules, Selection, Similarity, merged, per_class
from strandlight.functions import scalar as S
from strandlight.operators import durations, export, report, rules, scoring, selection, series, similarity, soundtrack, tags, telemetry


def rows(df, *columns):
    return sorted(tuple(r) for r in (df.select(*columns) if columns else df).collect())


def test_average_rank_of_ties_and_lone_rows(spark):
    df = spark.createDataFrame([("a", 1, 1.0), ("a", 2, 1.0), ("a", 3, 3.0), ("b", 4, 9.0)], "source_class string, id int, sharpness double")
    for limit in (1_000_000, 0):  # the window, and value counts
        scored = scoring.composite_score(df, {"sharpness": 1.0}, window_rows=limit)
        assert rows(scored, "id", "score") == [(1, 0.25), (2, 0.25), (3, 1.0), (4, 0.5)]


def test_metric_with_a_null_is_left_out_for_its_class_only(spark):
    df = spark.createDataFrame([("a", 1, 1.0, None), ("a", 2, 2.0, 5.0), ("b", 3, 1.0, 2.0), ("b", 4, 2.0, 1.0)], "source_class string, id int, sharpness double, aesthetic double")
    scored = scoring.composite_score(df, {"sharpness": 1.0, "aesthetic": 1.0})
    assert rows(scored, "id", "score") == [(1, 0.0), (2, 1.0), (3, 0.5), (4, 0.5)]
    assert rows(scoring.composite_score(df, {"sharpness": 0.0}), "score") == [(0.5,)] * 4


def window_of(spark, scores, span, target):
    frames = spark.createDataFrame([("f", i / 2, float(s)) for i, s in enumerate(scores)], "file_id string, time_s double, frame_score double")
    segment = spark.createDataFrame([("f:0", "f", *span)], "seg_id string, file_id string, start_s double, end_s double")
    return scoring.best_windows(segment, frames, target).first()


@pytest.mark.parametrize(
    "scores, span, expected",
    [
        ([0.1] * 12 + [0.9] * 8, (0.0, 10.0), (7.5, 3.0)),  # the earliest of equals
        ([0.0] * 17 + [1.0] * 3, (0.0, 10.0), (8.5, 3.0)),  # flush with the end
        ([0.5] * 4, (0.0, 2.0), (1.0, 2.0)),  # a span shorter than the target
        ([0.5] * 4, (5.0, 5.0), (5.0, 0.0)),
        ([0.5] * 4, (20.0, 30.0), (25.0, 3.0)),  # no frames inside
    ],
)
def test_best_window(spark, scores, span, expected):
    r = window_of(spark, scores, span, 3.0)
    assert (r["centre_s"], r["duration_s"]) == pytest.approx(expected)


def test_rules_are_ordered_and_absent_values_break_none(spark):
    df = spark.createDataFrame([(1, 1.0, 3, 2.0, 0.5, 0.0, 0.1), (2, 5.0, 3, 2.0, 0.5, 0.0, 0.1), (3, 5.0, 0, None, 0.5, 0.0, 0.1), (4, 5.0, 0, None, None, 0.01, 0.1), (5, 5.0, 0, None, 0.0, 0.5, 0.1), (6, 5.0, 0, None, None, None, None)], "id int, len double, n int, mx double, cl double, mo double, st double")
    reason = rules.rejection_reason(Rules(), F.col("len"), F.col("n"), F.col("mx"), F.col("cl"), F.col("mo"), F.col("st"))
    assert [r[1] for r in sorted(df.select("id", reason).collect())] == ["too_short", "low_altitude", "clipped", "no_motion", "shaky", None]


def test_visits_split_only_above_the_gap(spark):
    df = spark.createDataFrame([("p", "a", None), ("p", "b", 0.0), ("p", "c", 7200.0), ("p", "d", 14400.5)], "p string, id string, t double")
    assert rows(series.visits(df, 7200.0, ["p"], "t", "id"), "id", "visit") == [("a", 0), ("b", 0), ("c", 0), ("d", 1)]


@pytest.mark.parametrize("motion, expected", [([7], [0.5]), ([1, 2], [0.25, 0.375]), ([3, 1, 2, 9], [5 / 18, 1 / 3, 4 / 9, 4 / 9])])
def test_energy_curve(spark, motion, expected):
    df = spark.createDataFrame([("p", i, float(m)) for i, m in enumerate(motion)], "p string, o int, m double")
    got = [r[0] for r in series.energy_curve(df, "m", "o", "p").orderBy("o").select("energy").collect()]
    assert got == pytest.approx(expected)


def test_shot_cuts_measure_from_the_last_cut_taken(spark):
    df = spark.createDataFrame([("f", t, s) for t, s in ((0.0, 0), (0.5, 1), (1.2, 1), (1.4, 1), (3.0, 1), (4.5, 0))], "file_id string, time_s double, content int")
    assert rows(series.shot_cuts(df, 1, 1.0)) == [("f", 0.0, 1.2), ("f", 1.2, 3.0), ("f", 3.0, 4.5)]


def test_stability_of_short_and_flat_series(spark):
    df = spark.createDataFrame([("a", float(i), 5.0) for i in range(6)] + [("b", 0.0, 1.0), ("b", 1.0, 9.0)], "file_id string, time_s double, v double")
    assert {r[0] for r in series.stability(df, "v").select("stability").collect()} == {1.0}


def test_similarity_takes_semantic_for_visual_and_guards_faces(spark):
    df = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, None, 2)], "id int, fa int, fb int")
    c = Similarity()
    signals = {"visual": F.lit(0.2), "semantic": F.lit(0.8), "temporal": F.lit(None).cast("double")}
    got = rows(df.select("id", similarity.combined(signals, c, F.col("fa"), F.col("fb")).alias("s")))
    assert got == [(1, pytest.approx(0.8)), (2, 0.0), (3, pytest.approx(0.8))]
    assert rows(df.select(similarity.combined({"spatial": F.lit(None).cast("double")}, c)))[0] == (0.0,)


def test_motion_similarity_of_flat_and_short_series(spark):
    df = spark.createDataFrame([(1, [1.0, 1.0], [2.0, 2.0]), (2, [1.0, 2.0], [3.0, 3.0]), (3, [1.0], [2.0, 3.0]), (4, [1.0, 2.0, 3.0], [2.0, 4.0, 6.0]), (5, [1.0, 2.0], [2.0, 1.0])], "id int, a array<double>, b array<double>")
    assert [r[1] for r in sorted(df.select("id", similarity.motion(F.col("a"), F.col("b"))).collect())] == [1.0, 0.0, None, pytest.approx(1.0), pytest.approx(0.0)]


def test_clusters_of_a_long_chain(spark):
    n = 40
    nodes = spark.createDataFrame([(i,) for i in range(n + 2)], "id int")
    chain = list(range(n))
    random.Random(3).shuffle(chain)
    pairs = spark.createDataFrame([(a, b, 0.9) for a, b in zip(chain, chain[1:])] + [(n, n + 1, 0.1)], "a int, b int, sim double")
    got = {r["id"]: r["cluster_id"] for r in similarity.single_linkage(nodes, pairs, 0.75).collect()}
    assert {got[i] for i in range(n)} == {0} and got[n] == 1 and got[n + 1] == 2


def test_radius_join_matches_brute_force_across_the_date_line_and_near_a_pole(spark):
    rng = random.Random(5)
    pts = [(i, rng.uniform(60, 89.9), rng.choice([179.99, -179.99, 10.0]) + rng.uniform(-0.3, 0.3)) for i in range(120)]
    pts = [(i, a, (o + 180) % 360 - 180) for i, a, o in pts]
    df = spark.createDataFrame(pts, "id int, lat double, lon double")
    a, b = df.toDF("a", "la", "oa"), df.toDF("b", "lb", "ob")
    brute = a.join(b, F.col("a") < F.col("b")).where(S.haversine_m(F.col("la"), F.col("oa"), F.col("lb"), F.col("ob")) <= 20_000).select("a", "b")
    assert rows(similarity.within_radius(df, 20_000.0), "a", "b") == rows(brute)


def plain_greedy(cands, sims, k, lam):
    chosen = []
    while len(chosen) < k:
        best = max((c for c in cands if c["id"] not in chosen), key=lambda c: (c["score"] - lam * max([sims.get(frozenset((c["id"], s)), 0.0) for s in chosen], default=0.0), [-ord(x) for x in c["id"]]), default=None)
        if best is None:
            break
        chosen.append(best["id"])
    return chosen


def test_greedy_selection_matches_a_plain_loop(spark):
    rng = random.Random(1)
    cands = [{"project": "p", "id": f"c{i:02d}", "score": rng.random(), "file_id": str(i), "source_class": "generic", "cluster_id": None, "visit_id": None, "tag": None, "time_s": None, "pinned": False} for i in range(20)]
    sims = {frozenset((a["id"], b["id"])): rng.random() for a in cands for b in cands if a["id"] < b["id"]}
    schema = "project string, id string, score double, file_id string, source_class string, cluster_id long, visit_id long, tag string, time_s double, pinned boolean"
    pairs = spark.createDataFrame([("p", *sorted(k), v) for k, v in sims.items()], "project string, a string, b string, sim double")
    got = selection.select_diverse(spark.createDataFrame(cands, schema), pairs, Selection(), 8)
    assert [r["id"] for r in got.orderBy("pick").collect()] == plain_greedy(cands, sims, 8, 0.6)


def test_pins_outnumber_the_limit_and_caps_hold():
    def cand(i, **more):
        return {"id": f"c{i}", "score": 1.0 - i / 10, "file_id": "f", "source_class": "drone", "cluster_id": None, "visit_id": None, "tag": None, "time_s": None, "pinned": False} | more

    assert [i for i, _ in selection.greedy([cand(i, pinned=True) for i in range(3)], {}, Selection(), 2)] == ["c0", "c1", "c2"]
    assert selection.greedy([cand(0), cand(1)], {}, Selection(), 2) == [("c0", False)]  # one clip a file, never lifted
    near = [cand(0, file_id="a", time_s=0.0), cand(1, file_id="b", time_s=30.0), cand(2, file_id="c", time_s=60.0)]
    assert selection.greedy(near, {}, Selection(), 3) == [("c0", False), ("c2", False), ("c1", True)]


def test_alternation_sees_earlier_changes_and_skips_heroes(spark):
    c = Durations(base_s=per_class(3.0, 3.0, 3.0, 3.0, 3.0))
    df = spark.createDataFrame([("p", i, 4.0, "drone", i == 2, 9.0) for i in range(4)], "p string, order int, duration_s double, source_class string, hero boolean, span_s double")
    # the second is shortened to 3.0, still long; the third, a hero, passes it on to the fourth
    assert rows(durations.alternate(df, c, "p"), "order", "duration_s") == [(0, 4.0), (1, 3.0), (2, 4.0), (3, 3.0)]


def test_beats_step_down_to_fit_and_give_up_below(spark):
    df = spark.createDataFrame([(1, 2.4, 9.0, False), (2, 3.0, 9.0, False), (3, 3.0, 9.0, True), (4, 4.0, 2.5, False), (5, 1.0, 0.5, False)], "id int, duration_s double, span_s double, hero boolean").withColumn("ratio", F.lit(1.0))
    got = rows(durations.quantise(df, 120.0, (2, 4, 8), 25.0), "id", "beats", "beat_duration_s", "beat_reason")
    assert got == [(1, 4, 2.0, "beat"), (2, 4, 2.0, "beat"), (3, 8, 4.0, "beat"), (4, 4, 2.0, "beat"), (5, None, 0.5, "clamped")]


def test_zero_shot_respects_the_null_label(spark):
    v = spark.createDataFrame([("s", [1.0, 0.0])], "seg_id string, vector array<double>")
    labels = spark.createDataFrame([("g", "sea", [1.0, 0.0], True), ("g", None, [0.0, 1.0], True), ("h", "dark", [0.0, 1.0], False), ("h", None, [1.0, 0.0], False)], "group string, label string, vector array<double>, primary boolean")
    assert rows(tags.zero_shot(v, labels, 10.0, 0.2, 3), "label", "place") == [("sea", 1)]
    assert tags.zero_shot(v, labels, 10.0, 0.2, 0).count() == 0


def test_dominant_tag_prefers_cloud_then_confidence(spark):
    t = "label string, confidence double, source string, group string, primary boolean"
    df = spark.createDataFrame([(1, [("a", 0.9, "local", None, True), ("b", 0.1, "cloud", None, True)]), (2, [("a", 0.5, "local", None, True), ("b", 0.5, "local", None, True), ("c", 0.9, "local", None, False)]), (3, [])], f"id int, tags array<struct<{t.replace(' ', ':').replace(',:', ',')}>>")
    assert rows(df.select("id", tags.dominant_tag(F.col("tags")))) == [(1, "b"), (2, "a"), (3, None)]


def test_telemetry_cues(spark):
    text = ["1", "00:00:01,000 --> 00:00:02,000", "<font>ISO: 100, H 12.5m, H.S 3.0m/s", "GPS (10.5, 44.1, 20)</font>", "", "2", "00:00:03,500 --> 00:00:04,000", "no fields"]
    lines = spark.createDataFrame([("f", i, x) for i, x in enumerate(text)], "file_id string, n int, line string")
    cues = telemetry.cues(lines)
    assert rows(cues, "cue", "time_s") == [(1, 1.0), (2, 3.5)]
    assert rows(telemetry.samples(cues), "time_s", "lat", "lon", "height_m", "speed_h_ms", "iso") == [(1.0, 44.1, 10.5, 12.5, 3.0, 100)]
    assert [r[0] for r in cues.orderBy("cue").select(telemetry.is_telemetry(F.col("text"))).collect()] == [True, False]


def test_half_open_spans_and_empty_ones(spark):
    frames = spark.createDataFrame([("f", float(t), float(t)) for t in range(10)], "file_id string, time_s double, v double")
    spans = spark.createDataFrame([("a", "f", 2.0, 4.0), ("b", "f", 50.0, 60.0), ("c", "g", 0.0, 5.0)], "seg_id string, file_id string, start_s double, end_s double")
    assert rows(telemetry.span_means(spans, frames, ["v"], seconds=3.0)) == [("a", 2, 2.5), ("b", 1, 9.0), ("c", 0, 0.0)]  # b takes the nearest frame


def test_scalars(spark):
    one = spark.range(1)
    value = lambda c: one.select(c).first()[0]
    assert value(S.snap(F.lit(0.1), F.lit(25))) == pytest.approx(0.08) and value(S.snap(F.lit(1.3), F.lit(0))) == 1.3
    assert value(S.safe_name(F.lit("--"))) == "clip" and value(S.safe_name(F.lit(" Big Sea!"))) == "big_sea"
    assert value(S.timecode(F.lit(75.25))) == "1:15.2" and value(S.timecode_seconds(F.lit("01:02:03,5"))) == 3723.5
    assert value(S.rational(F.lit("30000/1001"))) == pytest.approx(29.97, abs=0.01) and value(S.rational(F.lit("0/0"))) is None
    assert value(S.finite_in(F.lit(float("inf")), 0, 10)) is None and value(S.even(F.lit(7.6))) == 8 and value(S.even(F.lit(0.2))) == 2
    assert value(S.even_picks(F.lit(5), 3)) == [0, 2, 4] and value(S.even_picks(F.lit(0), 3)) == []
    assert value(S.bare_json(F.lit('```json\n{"a":1}\n```'))) == '{"a":1}' and value(S.bare_json(F.lit("none"))) is None
    assert value(S.display_size(F.lit(16), F.lit(9), F.lit(-90))[0]) == 9 and value(S.normal_angle(F.lit(270))) == -90


def test_rates_and_frames(spark):
    clips = spark.createDataFrame([(50.0, 1920, 1080), (25.0, 1280, 720), (24.0, 1920, 1080), (0.0, 640, 480)], "fps double, width int, height int")
    assert rows(export.dominant_rate(clips)) == [(25.0, 2)] and rows(export.dominant_rate(clips.where("fps = 0"))) == [(25.0, 0)]
    assert rows(export.common_frame(clips, 3840, 2160)) == [(852, 480)]


def test_config_is_strict():
    assert merged(Config(), {"rules": {"min_motion": 0.1}, "durations": {"base_s": {"drone": 9.0}}}).durations.base_s["drone"] == 9.0
    for bad in ({"nope": 1}, {"rules": {"nope": 1}}, {"durations": {"base_s": {"submarine": 1}}}):
        with pytest.raises(ValueError):
            merged(Config(), bad)


def test_empty_inputs(spark):
    none = spark.createDataFrame([], "id string, source_class string, sharpness double")
    assert scoring.composite_score(none, {"sharpness": 1.0}).count() == 0
    pts = spark.createDataFrame([], "id int, lat double, lon double, at double")
    assert similarity.places(pts, 100.0, "at").count() == 0
    assert report.header_counts(spark.createDataFrame([], "outcome string, reason string, seconds double")).count() <= 1


def test_a_cue_with_signs(spark):
    text = "F/2.8, SS 50.00, ISO 200, EV +1.0, DZOOM 1.000, GPS (9.6850, 39.9664, 18), D 1.76m, H 22.70m, H.S 0.00m/s, V.S -0.00m/s"
    signed = "ISO 100, EV -0.7, GPS (+9.68, -39.96, +18), V.S +1.5m/s"
    cues = spark.createDataFrame([("f", 1, 0.0, text), ("f", 2, 1.0, signed), ("f", 3, 2.0, "no fields")], "file_id string, cue int, time_s double, text string")
    got = {r.cue: r for r in telemetry.samples(cues).collect()}
    assert sorted(got) == [1, 2]
    r = got[1]
    assert (r.height_m, r.speed_h_ms, r.speed_v_ms, r.lon, r.lat, r.gps_alt_m, r.iso, r.shutter, r.ev) == (22.7, 0.0, 0.0, 9.685, 39.9664, 18.0, 200, 50.0, 1.0)
    r = got[2]
    assert (r.height_m, r.speed_v_ms, r.lon, r.lat, r.gps_alt_m, r.iso, r.shutter, r.ev) == (None, 1.5, 9.68, -39.96, 18.0, 100, None, -0.7)


def test_a_detected_source_wins_even_if_empty(spark):
    first = spark.createDataFrame([("a", 0.0)], "file_id string, time_s double")
    second = spark.createDataFrame([("a", 1.0), ("b", 2.0)], "file_id string, time_s double")
    assert rows(telemetry.first_source(None, first, second), "file_id", "time_s") == [("a", 0.0), ("b", 2.0)]
    files = spark.createDataFrame([("a", 1), ("b", 0), ("b", 1)], "file_id string, source_no int")
    assert rows(telemetry.first_source(files, first, second), "file_id", "time_s") == [("a", 1.0)]


def test_an_empty_window_takes_the_nearest_frame(spark):
    frames = spark.createDataFrame([("f", 0.0, 1.0), ("f", 1.0, 2.0), ("f", 5.0, 6.0)], "file_id string, time_s double, sharpness double")
    spans = spark.createDataFrame([("a", "f", 0.0, 1.5), ("b", "f", 2.0, 3.0), ("c", "f", 3.0, 4.0), ("d", "f", 9.0, 9.5), ("e", "none", 0.0, 1.0)], "seg_id string, file_id string, start_s double, end_s double")
    assert rows(telemetry.span_means(spans, frames, ["sharpness"])) == [("a", 2, 1.5), ("b", 1, 2.0), ("c", 1, 2.0), ("d", 1, 6.0), ("e", 0, 0.0)]


def test_nearest_fix_without_times(spark):
    targets = spark.createDataFrame([(1, "a", 3.0), (2, "a", None), (3, "b", 1.0), (4, "c", 1.0)], "seg_id int, file_id string, time_s double")
    fixes = spark.createDataFrame([("a", 1, 5.0, 1.0, 1.0), ("a", 2, 1.0, 2.0, 2.0), ("a", 3, 4.0, None, 3.0), ("b", 1, 1.0, 4.0, 4.0), ("b", 0, None, 5.0, 5.0)], "file_id string, seq int, time_s double, lat double, lon double")
    tags = spark.createDataFrame([("c", 9.0, 9.0)], "file_id string, lat double, lon double")
    assert rows(similarity.nearest_fix(targets, fixes, tags)) == [(1, 1.0, 1.0), (2, 1.0, 1.0), (3, 5.0, 5.0), (4, 9.0, 9.0)]


def test_override_rules_are_not_dropped(spark, monkeypatch):
    monkeypatch.setattr(rules, "MOST_OVERRIDES", 2)
    with pytest.raises(ValueError):
        rules.classify(rules.override_rules(spark, [("*", "phone")] * 3), spark.createDataFrame([], "path string"))


def test_mood_words_along_a_scale(spark):
    pool = F.array(*[F.lit(w) for w in ("sunny", "unknown", "still", "other")])
    scale = ["still", "easy", "sunny", "bold"]
    got = spark.range(1).select(soundtrack.mood_words(pool, scale, True, 3).alias("up"), soundtrack.mood_words(pool, scale, False, 2).alias("down")).first()
    assert got.up == ["other", "unknown", "sunny"] and got.down == ["still", "sunny"]


def test_prompts_of_every_shape_keep_the_rules(spark):
    shapes = [("a", [0.1, 0.1, 0.15], 2), ("b", [0.9, 0.4, 0.1], 0), ("c", [0.1, 0.9, 0.1], 1), ("d", [0.1, 0.2, 0.9], 2), ("e", [], 1)]
    edits = spark.createDataFrame(shapes, "prompt_id string, curve array<double>, peak int").withColumn("shape", soundtrack.energy_shape(F.col("curve"), F.col("peak")))
    assert rows(edits, "prompt_id", "shape") == [("a", "flat"), ("b", "front"), ("c", "peak-middle"), ("d", "peak-late"), ("e", "flat")]
    words = lambda *w: F.array(*[F.lit(x) for x in w]).cast("array<string>")
    edits = edits.withColumns({"subject": F.lit("Stintino"), "time_of_day": F.lit(None).cast("string"), "bpm": F.lit(120), "genre": F.lit("Surf Rock"), "instruments": words("twangy reverb guitar", "driving drums", "warm bass"), "instrument_alternates": words(), "mood": words("sunny", "carefree"), "mood_alternates": words("breezy")})
    for variant, first in ((0, "twangy reverb guitar"), (1, "warm bass")):
        built = soundtrack.build_prompts(edits, variant)
        assert soundtrack.violations(built.withColumn("instruments", F.col("prompt_instruments"))).count() == 0
        one = built.where("prompt_id = 'c'").first()
        assert one.title == "stintino, surf rock" and one.description.startswith(f"Surf Rock, {first}, driving drums, {('sunny', 'carefree')[variant]}, 120 bpm")
        assert len(one.lines) == 17 and one.lines[-1] == "[end]" and one.lines[0] == "[sparse intro]"


def test_content_keys_and_listing(spark, tmp_path):
    import hashlib

    from strandlight.sources import files

    mib = files.MIB
    sizes = {"b.mp4": 10, "c.mp4": mib, "d.mp4": mib + 5, "e.mp4": 2 * mib + 7}
    texts = {n: random.Random(n).randbytes(k) for n, k in sizes.items()}
    for n, t in texts.items():
        (tmp_path / n).write_bytes(t)
    read = spark.read.format("binaryFile").load(str(tmp_path)).select("path", F.col("length").alias("size"), F.lit(5).cast("long").alias("mtime_ns"), "content")
    got = {r.path.rsplit("/", 1)[1]: r.key for r in files.content_keys(read).collect()}
    for n, t in texts.items():
        h = hashlib.blake2b(f"{len(t)}:5:".encode(), digest_size=16)
        h.update(t[:mib])
        h.update(t[max(len(t) - mib, mib) :] if len(t) > mib else b"")
        assert got[n] == h.hexdigest()
    listed = files.listing(spark, [str(tmp_path)])
    assert sorted((r.path.rsplit("/", 1)[1], r.size) for r in files.scan(listed).collect()) == sorted(sizes.items())


def test_streams(spark, tmp_path):
    from strandlight import streaming

    src = str(tmp_path / "in")
    spark.createDataFrame([("f", 0.0, 0.0), ("f", 2.0, 1.0), ("f", 2.5, 1.0), ("f", 4.0, 1.0)], "file_id string, time_s double, content double").coalesce(1).write.parquet(src)
    stream = spark.readStream.schema("file_id string, time_s double, content double").parquet(src)
    q = streaming.stateful_cuts(stream, "file_id", "time_s", "content", 1.0, 1.0).writeStream.format("memory").queryName("cuts").outputMode("append").option("checkpointLocation", str(tmp_path / "c")).start()
    q.processAllAvailable()
    q.stop()
    assert rows(spark.table("cuts"), "cut_s") == [(2.0,), (4.0,)]
