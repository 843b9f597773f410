"""Greedy diverse selection under caps, and what follows from it.

Each pick depends on all earlier ones, so a project is selected in one task; projects run in parallel.  The
similarities of picks to all rows are made in that task (``select_near``), or come as pairs (``select_diverse``).
"""

from __future__ import annotations

import math
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from strandlight.config import CLASSES, Selection

PICKS = "project string, id string, pick int, relaxed boolean"


def greedy(rows: list[dict], sims: dict, config: Selection, max_clips: int | None = None) -> list[tuple[str, bool]]:
    """(id, relaxed) in the order picked, from the similarities of pairs of ids, both ways; see ``greedy_near``."""
    place = {r["id"]: k for k, r in enumerate(rows)}
    near: dict[int, list] = {}
    for (a, b), s in sims.items():
        if a in place and b in place:
            near.setdefault(place[a], []).append((place[b], s))

    def to_all(k: int) -> np.ndarray:
        out = np.zeros(len(rows))
        for other, s in near.get(k, ()):
            out[other] = s
        return out

    return [(rows[k]["id"], relaxed) for k, relaxed in greedy_near(rows, to_all, config, max_clips)[0]]


def greedy_near(rows: list[dict], near: Callable[[int], np.ndarray], config: Selection, max_clips: int | None = None) -> tuple[list[tuple[int, bool]], np.ndarray, np.ndarray]:
    """(index, relaxed) in the order picked; each row's largest similarity to a pick; and the first pick that has it, -1 without one over 0.

    Rows have id, score, file_id, source_class, cluster_id, visit_id, tag, time_s, pinned, excluded, and stand in
    candidate order, which decides ties.  Kept rows go first and are above the caps; then each class in its fixed
    order up to its share; then all.  A pick first tries every cap, then those of file and cluster alone.  ``near`` gives a row's
    similarities to all rows; it is asked for picks alone.
    """
    free = np.array([not r.get("excluded") for r in rows], dtype=bool)
    able = int(free.sum())
    limit = config.max_clips if max_clips is None else max_clips
    if max_clips is None and config.candidate_share > 0 and able:
        limit = min(limit, math.ceil(config.candidate_share * able))
    out: list[tuple[int, bool]] = []
    score = np.array([r["score"] or 0.0 for r in rows], dtype=float)
    best_sim, winner = np.zeros(len(rows)), np.full(len(rows), -1)
    counts = {k: Counter() for k in ("file_id", "cluster_id", "tag", "visit_id", "source_class")}
    times: list[float] = []

    def take(k: int, relaxed: bool) -> None:
        r = rows[k]
        free[k] = False
        out.append((k, relaxed))
        for name, seen in counts.items():
            if r.get(name) is not None:
                seen[r[name]] += 1
        if r.get("time_s") is not None:
            insort(times, r["time_s"])
        s = near(k)
        more = s > best_sim
        best_sim[more], winner[more] = s[more], k

    def allowed(r: dict, strict: bool) -> bool:
        if counts["file_id"][r["file_id"]] >= config.per_file.get(r["source_class"], config.per_file["generic"]):
            return False
        if r.get("cluster_id") is not None and counts["cluster_id"][r["cluster_id"]] >= config.per_cluster:
            return False
        if not strict:
            return True
        if r.get("tag") is not None and config.tag_share > 0 and limit > 0 and counts["tag"][r["tag"]] / limit >= config.tag_share:
            return False
        if r.get("visit_id") is not None and counts["visit_id"][r["visit_id"]] >= config.per_visit:
            return False
        at = r.get("time_s")
        if at is None:
            return True
        k = bisect_left(times, at)
        return not any(abs(t - at) < config.gap_s for t in times[max(0, k - 1) : k + 1])

    def pick(pool: np.ndarray) -> bool:
        # by value, best first; the first that the caps allow is the pick
        pool = pool[free[pool]]
        order = pool[np.argsort(config.diversity * best_sim[pool] - score[pool], kind="stable")].tolist()
        for strict in (True, False):
            for k in order:
                if allowed(rows[k], strict):
                    take(k, not strict)
                    return True
        return False

    for k, r in enumerate(rows):
        if r.get("pinned"):
            take(k, False)
    reserved = 0
    for c in CLASSES:
        own = np.array([k for k, r in enumerate(rows) if r["source_class"] == c], dtype=int)
        quota = max(0, min(math.ceil(config.min_share.get(c, 0.0) * limit), len(own), limit - reserved))
        reserved += quota
        while len(out) < limit and counts["source_class"][c] < quota and pick(own):
            pass
    while len(out) < limit and pick(np.arange(len(rows))):
        pass
    return out, best_sim, winner


def select_diverse(candidates: DataFrame, pairs: DataFrame, config: Selection, max_clips: int | None = None) -> DataFrame:
    """(project, id, pick, relaxed) for each project of ``candidates``; ``pairs`` has project, a, b, sim (0 and absent are the same).

    For similarities that come from the candidates' own columns, ``select_near`` needs no pairs.
    """

    def run(key, rows: pd.DataFrame, sims: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("id").astype(object).where(rows.sort_values("id").notna(), None)
        table = {}
        for a, b, s in zip(sims["a"], sims["b"], sims["sim"]):
            table[a, b] = table[b, a] = s
        picked = greedy(rows.to_dict("records"), table, config, max_clips) if len(rows) else []
        return pd.DataFrame([(key[0], i, n, relaxed) for n, (i, relaxed) in enumerate(picked)], columns=["project", "id", "pick", "relaxed"])

    return candidates.groupBy("project").cogroup(pairs.where("sim > 0").groupBy("project")).applyInPandas(run, PICKS)


def select_near(candidates: DataFrame, similar: Callable[[pa.Table], Callable[[int], np.ndarray]], config: Selection, max_clips: int | None = None) -> DataFrame:
    """(project, id, pick, relaxed, similarity, winner), a row a candidate; pick is null where it was not picked.

    ``similar`` makes, from a project's rows, the function that gives one row's similarities to all.  It is asked for picks
    alone, so a project costs its rows times its picks, and no pair is stored or shuffled.  ``similarity`` is the largest to a
    pick, ``winner`` the first pick that has it.
    """
    fields = [c for c in ("id", "score", "file_id", "source_class", "cluster_id", "visit_id", "tag", "time_s", "pinned", "excluded") if c in candidates.columns]

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("id").combine_chunks()
        picked, best, winner = greedy_near(rows.select(fields).to_pylist(), similar(rows), config, max_clips)
        pick, relaxed = np.full(len(rows), -1), np.zeros(len(rows), dtype=bool)
        for n, (k, loose) in enumerate(picked):
            pick[k], relaxed[k] = n, loose
        ids = rows.column("id")
        first = ids.take(pa.array(winner, mask=winner < 0))
        columns = [rows.column("project"), ids, pa.array(pick, pa.int32(), mask=pick < 0), pa.array(relaxed, mask=pick < 0), pa.array(best), first]
        return pa.table(columns, names=["project", "id", "pick", "relaxed", "similarity", "winner"])

    return candidates.groupBy("project").applyInArrow(run, f"{PICKS}, similarity double, winner string")


def edit_order(selected: DataFrame, at: str = "time_s", ident: str = "id", by: list[str] | None = None) -> DataFrame:
    """``order`` from 1 by time, rows without one first, then by id."""
    w = Window.partitionBy(*(by or [])).orderBy(F.col(at).asc_nulls_first(), ident)
    return selected.withColumn("order", F.row_number().over(w))


def held_by(candidates: DataFrame, selected: DataFrame, per_visit: int) -> DataFrame:
    """(id, held_by): for rows of visits that hold exactly the cap of clips, those clips' ids in edit order."""
    full = selected.where("visit_id is not null").groupBy("visit_id").agg(F.sort_array(F.collect_list(F.struct("order", "id"))).alias("c")).where(F.size("c") == per_visit)
    return candidates.join(full, "visit_id").select("id", F.transform("c", lambda c: c["id"]).alias("held_by"))


def group_stacks(segments: DataFrame, group: str, others: int = 4) -> DataFrame:
    """(group, size, pick, others): groups of two or more rows that are not rejected, best first; the pick is the best selected row, else the best."""
    live = segments.where((F.col("outcome") != "rejected") & F.col(group).isNotNull())
    listed = live.groupBy(group).agg(F.sort_array(F.collect_list(F.struct((F.col("outcome") != "selected").alias("o"), (-F.coalesce("score", F.lit(0.0))).alias("s"), F.col("id")))).alias("l")).where(F.size("l") >= 2)
    rest = F.transform(F.slice(F.array_sort(F.transform(F.slice("l", 2, 1_000_000_000), lambda x: F.struct(x["s"].alias("s"), x["id"].alias("id")))), 1, others), lambda x: x["id"])
    return listed.select(group, F.size("l").alias("size"), F.col("l")[0]["id"].alias("pick"), rest.alias("others"))
