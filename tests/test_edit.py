"""The whole selection against a plain loop over its rules."""

import math

import pytest
from pyspark.sql import functions as F

from strandlight.config import CLASSES, Config, merged, per_class
from strandlight.operators import edit
from strandlight.plans import pairs

SF = "/root/testdata/sf0.001"


def metres(a, b):
    p, q = math.radians(a["lat"]), math.radians(b["lat"])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b["lon"] - a["lon"]) / 2) ** 2
    return 2 * 6371000 * math.asin(math.sqrt(min(h, 1)))


def joined(ids, links):
    root = {i: i for i in ids}
    for _ in ids:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    return root


def plain(rows, config, max_clips):
    """{id: (outcome, order, reason, place, visit, lost_to, held_by, similarity)} by loops over the rows of one project."""
    s = config.selection
    sims = {}
    for a in rows:
        for b in rows:
            if a["id"] == b["id"]:
                continue
            signals = [(max(0.0, min(1.0, sum(x * y for x, y in zip(a["vector"], b["vector"])))), config.similarity.semantic)]
            if a["lat"] is not None and b["lat"] is not None:
                signals.append((max(0.0, 1 - metres(a, b) / config.similarity.radius_m), config.similarity.spatial))
            if a["time_s"] is not None and b["time_s"] is not None:
                signals.append((max(0.0, 1 - abs(a["time_s"] - b["time_s"]) / config.similarity.radius_s), config.similarity.temporal))
            sim = sum(v * w for v, w in signals) / sum(w for _, w in signals)
            if a["faces"] is not None and b["faces"] is not None and a["faces"] != b["faces"]:
                sim = 0.0
            sims[a["id"], b["id"]] = sim
    by = {r["id"]: r for r in rows}
    spots = [r for r in rows if r["lat"] is not None]
    root = joined([r["id"] for r in spots], [(a["id"], b["id"]) for a in spots for b in spots if a["id"] < b["id"] and metres(a, b) <= config.places.radius_m])
    groups = {}
    for r in spots:
        groups.setdefault(root[r["id"]], []).append(r)
    first = lambda g: min((r["time_s"] is None, r["time_s"] or 0.0, r["id"]) for r in g)
    place, visit, n = {}, {}, -1
    for k, g in enumerate(sorted(groups.values(), key=first)):
        last = None
        n += 1
        for r in sorted(g, key=lambda r: (r["time_s"] is not None, r["time_s"] or 0.0, r["id"])):
            if last is not None and r["time_s"] - last > config.places.visit_gap_s:
                n += 1
            last = r["time_s"] if r["time_s"] is not None else last
            place[r["id"]], visit[r["id"]] = k, n
    cluster = joined(list(by), [p for p, v in sims.items() if v >= s.cluster_threshold])
    chosen = [r["id"] for r in rows if r["user_decision"] == "keep"]
    count = lambda key, value: sum(key(c) == value for c in chosen)

    def able(i, relaxed):
        r = by[i]
        if i in chosen or r["reason"] == "vertical" or r["user_decision"] == "reject":
            return False
        if count(lambda c: by[c]["file_id"], r["file_id"]) >= s.per_file[r["source_class"]] or count(lambda c: cluster[c], cluster[i]) >= s.per_cluster:
            return False
        if relaxed:
            return True
        if r["tag"] is not None and count(lambda c: by[c]["tag"], r["tag"]) / max_clips >= s.tag_share:
            return False
        if i in visit and count(lambda c: visit.get(c), visit[i]) >= s.per_visit:
            return False
        return r["time_s"] is None or all(by[c]["time_s"] is None or abs(by[c]["time_s"] - r["time_s"]) >= s.gap_s for c in chosen)

    def pick(pool):
        for relaxed in (False, True):
            good = [i for i in pool if able(i, relaxed)]
            if good:
                chosen.append(max(good, key=lambda i: (by[i]["score"] - s.diversity * max([sims[i, c] for c in chosen], default=0.0), [-ord(x) for x in i])))
                return True
        return False

    reserved = 0
    for c in CLASSES:
        own = [r["id"] for r in rows if r["source_class"] == c]
        quota = min(math.ceil(s.min_share[c] * max_clips), len(own), max_clips - reserved)
        reserved += quota
        while len(chosen) < max_clips and count(lambda x: by[x]["source_class"], c) < quota and pick(own):
            pass
    while len(chosen) < max_clips and pick(list(by)):
        pass
    order = {i: k for k, i in enumerate(sorted(chosen, key=lambda i: (by[i]["time_s"] or 0.0, i)), 1)}
    held = {}
    for i in sorted(order, key=order.get):
        if i in visit:
            held.setdefault(visit[i], []).append(i)
    out = {}
    for i, r in by.items():
        if i in order:
            out[i] = ("selected", order[i], r["reason"], place.get(i), visit.get(i), None, None, None)
            continue
        best, winner = 0.0, None
        for c in chosen:
            if sims[i, c] > best:
                best, winner = sims[i, c], c
        full = held.get(visit.get(i)) if len(held.get(visit.get(i), [])) == s.per_visit else None
        out[i] = ("candidate", None, "place_cap" if full else r["reason"], place.get(i), visit.get(i), winner if best >= s.cluster_threshold else None, full, pytest.approx(best, abs=1e-9))
    return out


def test_the_whole_selection(spark):
    rows = {}
    for r in pairs.edit_candidates(spark, SF).orderBy("id").collect():
        rows.setdefault(r.project, []).append(r.asDict())
    got = {}
    for r in pairs.select_edit(spark, SF).collect():
        got.setdefault(r.project, {})[r.id] = (r.outcome, r.order, r.reason, r.place_id, r.visit_id, r.lost_to, r.held_by, r.similarity)
        assert (r.duration_s is not None) == (r.outcome == "selected") and (r.duration_s is None or 0 < r.duration_s <= 6)
    assert got.keys() == rows.keys()
    for project, own in rows.items():
        assert got[project] == plain(own, pairs.EDIT, 12), project
    every = [x for p in got.values() for x in p.values()]
    assert any(x[2] == "place_cap" and x[6] for x in every) and any(x[5] for x in every)


def test_a_kept_clip_is_above_the_caps_and_a_rejected_one_never_in(spark):
    words = "project string, id string, file_id string, source_class string, score double, tag string, vector array<double>, lat double, lon double, time_s double, faces int, span_s double, reason string, user_decision string"
    rows = [("p", i, f, "generic", s, None, v, 40.0, 9.0, t, None, 5.0, None, d) for i, f, s, v, t, d in [("a", "f1", 0.9, [1.0, 0.0], 0.0, "reject"), ("b", "f1", 0.1, [1.0, 0.0], 10.0, "keep"), ("c", "f1", 0.8, [0.0, 1.0], 20.0, "keep"), ("d", "f2", 0.7, [0.0, -1.0], 9000.0, None)]]
    got = {r.id: r for r in edit.select_edit(spark.createDataFrame(rows, words), merged(Config(), {"selection": {"per_file": per_class(1, 1, 1, 1, 1)}}), 3).collect()}
    assert {i for i, r in got.items() if r.outcome == "selected"} == {"b", "c", "d"} and [got[i].order for i in "bcd"] == [1, 2, 3]
    assert got["a"].lost_to == "b" and got["a"].order is None
    none = spark.createDataFrame([], words)
    assert edit.select_edit(none, Config(), 3).count() == 0


def test_blocks_over_a_tile_make_the_same_pairs(spark):
    from strandlight.operators import similarity

    df = spark.range(60).select("id", (F.col("id") % 2).alias("g"), F.array((F.col("id") % 5).cast("double"), F.lit(1.0)).alias("v"))
    whole = sorted(map(tuple, similarity.pairs_within(df, ["g"], "id").select("a_id", "b_id").collect()))
    assert whole == [(a, b) for a in range(60) for b in range(a + 1, 60) if a % 2 == b % 2]
    assert sorted(map(tuple, similarity.pairs_within(df, ["g"], "id", tile=7).select("a_id", "b_id").collect())) == whole
    for tile in (7, 1000):
        got = similarity.dot_pairs(df.withColumn("v", F.transform("v", lambda x: x / 5)), "g", "id", "v", 0.5, tile).collect()
        assert sorted((r.a, r.b) for r in got) == [(a, b) for a, b in whole if (a % 5) * (b % 5) / 25 + 0.04 >= 0.5]
