"""Structured Streaming counterparts of the series operators.  The batch engine does not need them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def visit_sessions(events: DataFrame, at: str, by: str, gap: str = "2 hours", late: str = "10 minutes") -> DataFrame:
    """(by, start, end, n) of each session, emitted once the watermark has passed it.  Rows without a time are dropped."""
    return events.withWatermark(at, late).groupBy(F.session_window(at, gap).alias("w"), by).agg(F.count(F.lit(1)).alias("n")).select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def minute_metrics(frames: DataFrame, at: str, by: str, value: str, late: str = "10 minutes") -> DataFrame:
    """(by, minute, n, mean) by tumbling minutes."""
    return frames.withWatermark(at, late).groupBy(F.window(at, "1 minute").alias("w"), by).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean")).select(by, F.col("w.start").alias("minute"), "n", "mean")


def stateful_cuts(frames: DataFrame, by: str, at: str, score: str, threshold: float, least_s: float) -> DataFrame:
    """(by, cut_s) as cuts are found: a score at the threshold at least ``least_s`` after the file's last cut.  State is one number a file."""

    def find(key, batches: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        found = []
        rows = pd.concat(list(batches)).sort_values(at)
        for t, s in zip(rows[at], rows[score]):
            if last is None:
                last = t
            elif s >= threshold and t - last >= least_s:
                found.append(t)
                last = t
        state.update((float(last),))
        yield pd.DataFrame({by: [key[0]] * len(found), "cut_s": found})

    kind = dict(frames.dtypes)[by]
    return frames.groupBy(by).applyInPandasWithState(find, f"{by} {kind}, cut_s double", "last double", "append", "NoTimeout")
