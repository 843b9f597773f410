"""Components of graphs, without a driver-side or single-task step that grows with the data."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.functions import ranks
from strandlight.session import kept


def roots(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, root) of each node of ``edges`` (a, b) that is not the smallest of its component.

    Each round hangs all of a node's larger neighbours, and then its smaller ones, on the smallest; edges
    stop changing when every node hangs on its root.  A round's work is in proportion to the edges: hubs are summed up
    before they are dealt, and skewed joins are split at run time.  Raises if the edges do not settle.
    """

    def down(df: DataFrame) -> DataFrame:
        return df.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct()

    def mark(df: DataFrame) -> tuple:
        return tuple(df.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    now = kept(down(edges.where("a is not null and b is not null")))
    state = mark(now)
    for _ in range(rounds):
        if not state[0]:
            break
        both = now.union(now.select("v", "u")).toDF("u", "v")
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        upward = kept(down(both.join(low, "u").where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))), state[0])
        low = upward.groupBy("u").agg(F.min("v").alias("m"))
        hung = upward.join(low, "u")
        now = kept(down(hung.select(F.col("v").alias("a"), F.col("m").alias("b")).union(hung.select(F.col("u").alias("a"), F.col("m").alias("b")))), 2 * state[0])
        state, before = mark(now), state
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(nodes: DataFrame, edges: DataFrame, node: str = "id") -> DataFrame:
    """``nodes`` with ``root``, the smallest node that edges (a, b) connect each to; alone, itself."""
    found = roots(edges).select(F.col("node").alias(node), F.col("root").alias("_root"))
    return nodes.join(found, node, "left").select(*nodes.columns, F.coalesce("_root", node).alias("root"))


def numbered(rooted: DataFrame, first: str, name: str = "cluster_id") -> DataFrame:
    """Components numbered from 0 by their smallest ``first``."""
    order = rooted.groupBy("root").agg(F.min(first).alias("_first"))
    order = ranks.numbered(order, [F.col("_first"), F.col("root")], name).drop("_first")
    return rooted.join(order, "root").drop("root")
