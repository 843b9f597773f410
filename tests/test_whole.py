"""Queries over whole tables against plain loops over the smallest tables."""

import pyarrow.parquet as pq
import pytest

from strandlight.plans import QUERIES

SF = "/root/testdata/sf0.001"


def rows(name):
    return pq.read_table(f"{SF}/{name}.parquet").to_pylist()


@pytest.fixture(scope="module")
def events():
    """{user: [(t, event_id, k, value)]} in order, one event a user and second."""
    import json

    first, found = {}, {}
    every = sorted(rows("events"), key=lambda r: r["event_id"])
    for r in every:
        first[r["user_id"]] = min(first.get(r["user_id"], r["ts"]), r["ts"])
    for r in every:
        t = (r["ts"] - first[r["user_id"]]).total_seconds()
        found.setdefault(r["user_id"], {}).setdefault(t, (t, r["event_id"], float(json.loads(r["props"])["k"]), r["value"]))
    return {u: sorted(x.values()) for u, x in found.items()}


def test_every_event_has_a_motion_slice(spark, events):
    got = {r.seg_id: r.motion for r in QUERIES["motion_slices"](spark, SF).collect()}
    expected = {i: ",".join(str(int(k)) for t, _, k, _ in own if c - 20000 <= t < c + 20000) for own in events.values() for c, i, _, _ in own}
    assert got == expected


def test_late_times_get_the_part_that_plays(spark):
    got = {r["at"]: r["order"] for r in QUERIES["part_at_time"](spark, SF).collect()}
    parts = [r["p_partkey"] for r in rows("part")]
    assert got == {z: next((k for k in parts if 2 * k <= z < 2 * k + 1.5), max(parts)) for z in (r["n_nationkey"] * 7.25 for r in rows("nation"))}
    assert got[166.75] == 83


#: keys of which some share a place (8,633 apart) and some are next to each other (1,068 apart)
KEYS = [1, 2, 50, 1069, 1070, 8634, 8635, 17267]


def near(limit):
    from math import asin, cos, radians, sin, sqrt

    own = [(k, k % 97 * 0.01, k % 89 * 0.01) for k in KEYS]
    metres = lambda p, q: 2 * 6371000 * asin(sqrt(sin(radians(q[1] - p[1]) / 2) ** 2 + cos(radians(p[1])) * cos(radians(q[1])) * sin(radians(q[2] - p[2]) / 2) ** 2))
    return [p[0] for p in own], {(p[0], q[0]) for p in own for q in own if p[0] < q[0] and metres(p, q) <= limit}


def test_odd_keys_have_neighbours_and_places(spark, tmp_path):
    spark.createDataFrame([(k,) for k in KEYS], "c_custkey long").write.parquet(str(tmp_path / "customer.parquet"))
    _, pairs = near(1200)
    got = {(r.a, r.b) for r in QUERIES["haversine_places"](spark, str(tmp_path)).collect()}
    assert got == pairs and any(a % 2 or b % 2 for a, b in got)
    ids, links = near(900)
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    order = {r: n for n, r in enumerate(sorted(set(root.values())))}
    assert {r.id: r.place_id for r in QUERIES["place_components"](spark, str(tmp_path)).collect()} == {i: order[root[i]] for i in ids}


def windows(events):
    """{seg_id: (start, end, c0, means by candidate, framed)} over spans of 100,000 s up to the last event."""
    found = {}
    for user, own in events.items():
        for i in range(int(own[-1][0] // 100_000) + 1):
            a, b = i * 1e5, (i + 1) * 1e5
            at = {t for t, *_ in own if a <= t < b and t + 30000 <= b} | {b - 30000}
            inside = {c: [v for t, _, _, v in own if c <= t < c + 30000] for c in at}
            means = {c: sum(x) / len(x) if x else None for c, x in inside.items()}
            c0 = min(means, key=lambda c: (-means[c] if means[c] is not None else float("inf"), c))
            found[f"{user}:{i}"] = a, b, c0, means, any(a <= t < b for t, *_ in own)
    return found


def test_windows_reach_the_last_event(spark, events):
    expected = windows(events)
    got = {r.seg_id: r.centre_s for r in QUERIES["best_window"](spark, SF).collect()}
    assert got.keys() == expected.keys() and max(int(s.split(":")[1]) for s in got) > 11
    assert got == {s: pytest.approx(c0 + 15000 if framed else (a + b) / 2, abs=1e-3) for s, (a, b, c0, _, framed) in expected.items()}


def test_snapping_reaches_the_last_event(spark, events):
    expected = {}
    for s, (a, b, c0, means, framed) in windows(events).items():
        own = events[int(s.split(":")[0])]
        lows = {t: k for (_, _, p, _), (t, _, k, _), (_, _, n, _) in zip(own, own[1:], own[2:]) if (k < p and k <= n) or (k <= p and k < n)}
        if framed and means[c0] is not None:
            good = [(lows[c], abs(c - c0), c) for c, m in means.items() if c in lows and means[c0] > 0 and 0 < abs(c - c0) <= 40000 and (means[c0] - m) / means[c0] <= 0.3]
            expected[s] = (pytest.approx(min(good)[2] if good else c0, abs=1e-3), bool(good))
    assert {r.seg_id: (r.start_s, r.moved) for r in QUERIES["snap_to_minimum"](spark, SF).collect()} == expected


def test_labels_and_prompts_of_whole_texts(spark, tmp_path):
    lead = "word " * 100
    spark.createDataFrame([(3, lead + "Late"), (4, "late x"), (5, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.label: (r.total, r.selected) for r in QUERIES["tag_carried_counts"](spark, str(tmp_path)).collect()}
    assert got == {"word": (1, 1), "late": (2, 1), "x": (1, 0)}
    text = "soft " * 60 + ", warm pads, slow drums, low strings, no vocals, instrumental"
    spark.createDataFrame([(1, text)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rules = {r.rule for r in QUERIES["prompt_validate"](spark, str(tmp_path)).collect()}
    assert not rules & {"missing_instrumental", "description_descriptor_count"} and "description_too_long" in rules
