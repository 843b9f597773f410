"""URL filters: host and path rules first, gradient-boosted trees on lexical features for the rest.

The URLs that a rule decides are the labelled ones (block is 1).  Trees are grown on a bounded sample
of them, on histograms of lexical features: lengths, depth, digit ratio, entropy, parameter counts, and
the smoothed block rate of the host's suffixes.  The trees become SQL expressions, and the suffix rates tables to join with, so
that every URL is scored within the JVM, without Python.

Null URLs, and those without ``://``, have an empty host and path and no rule; their verdict is the
trees'.  Without labelled URLs, or with one verdict alone among them, that verdict (or ``allow``) stands for all.
Repeated rows give repeated results, and a URL counts once in the sample.  Of equally long rules the first wins, of equally good cuts the first
feature's lowest.  Very long URLs are read whole; lengths and entropy are of code points.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAMPLE = 20_000  # labelled URLs that trees are grown on at most
TREES, DEPTH, RATE, BINS = 24, 3, 0.3, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))


def with_parts(pages: DataFrame) -> DataFrame:
    """``pages`` with host and path."""
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    url = F.coalesce(F.col("url").cast("string"), F.lit(""))
    return pages.withColumn("host", F.translate(F.regexp_extract(url, pattern, 1), UPPER, LOWER)).withColumn("path", F.regexp_extract(url, pattern, 2))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """(rule, verdict) of the longest rule that fits ``host`` and ``path``, else nulls; of equally long ones the first."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for says, text in sorted(rules, key=lambda r: len(r[1])):
        host, _, rest = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


FEATURES = ("length", "host_length", "path_length", "labels", "depth", "digits", "entropy", "parameters", "query_length", "hyphens", "last_length", "has_extension", "secure", "fragment")


def lexical(url: Column) -> dict[str, Column]:
    """The numeric features of ``url``, ``host`` and ``path``, each a double."""
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1)
    length = F.length(url)
    chars = F.array_sort(F.regexp_extract_all(url, F.lit("(?s)."), F.lit(0)))

    def run(state: Column, c: Column) -> Column:
        """One more of the same character, or the first of the next: sum has n * log2(n) of the runs before."""
        same = state["last"] == c
        return F.struct(c.alias("last"), F.when(same, state["n"] + 1).otherwise(F.lit(1.0)).alias("n"), F.when(same, state["sum"]).otherwise(state["sum"] + state["n"] * F.log2(state["n"])).alias("sum"))

    runs = F.aggregate(chars, F.struct(F.lit("").alias("last"), F.lit(1.0).alias("n"), F.lit(0.0).alias("sum")), run, lambda state: state["sum"] + state["n"] * F.log2(state["n"]))
    # Shannon entropy over the characters
    entropy = F.when(length > 0, F.log2(length) - runs / length).otherwise(0.0)
    found = {
        "length": length,
        "host_length": F.length(host),
        "path_length": F.length(path),
        "labels": F.size(F.split(host, r"\.")),
        "depth": F.length(path) - F.length(F.replace(path, F.lit("/"))),
        "digits": F.when(length > 0, F.length(F.regexp_replace(url, "[^0-9]", "")) / length).otherwise(0.0),
        "entropy": F.round(entropy, 6),
        "parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "query_length": F.length(query),
        "hyphens": F.length(url) - F.length(F.replace(url, F.lit("-"))),
        "last_length": F.length(F.element_at(F.split(path, "/"), -1)),
        "has_extension": path.rlike(r"\.[A-Za-z0-9]{1,5}$").cast("int"),
        "secure": F.startswith(url, F.lit("https:")).cast("int"),
        "fragment": F.contains(url, F.lit("#")).cast("int"),
    }
    return {k: v.cast("double") for k, v in found.items()}


def suffix_columns() -> dict[str, Column]:
    """The host's last label and last two, and the path's first segment: what suffix statistics are kept of."""
    parts = F.split(F.col("host"), r"\.")
    return {
        "top": F.element_at(parts, -1),
        "site": F.when(F.size(parts) >= 2, F.concat_ws(".", F.element_at(parts, -2), F.element_at(parts, -1))).otherwise(F.col("host")),
        "section": F.coalesce(F.try_element_at(F.split(F.col("path"), "/"), F.lit(2)), F.lit("")),
    }


@dataclass
class Trees:
    """Nested (feature, cut, left, right) tuples with leaf log-odds, and the suffix tables."""

    base: float
    trees: list
    rates: dict[str, dict[str, float]]
    prior: float
    constant: str | None = None


def _grow(x: np.ndarray, cuts: list[np.ndarray], gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int, least: float = 2.0):
    g, h = gradient[rows].sum(), hessian[rows].sum()
    leaf = -g / (h + 1.0) * RATE
    if depth == 0 or len(rows) < 20:
        return leaf
    best = (1e-6, None)
    for f, cut in enumerate(cuts):
        if not len(cut):
            continue
        bins = x[rows, f]
        gs = np.cumsum(np.bincount(bins, gradient[rows], len(cut) + 1))[:-1]
        hs = np.cumsum(np.bincount(bins, hessian[rows], len(cut) + 1))[:-1]
        gain = gs**2 / (hs + 1) + (g - gs) ** 2 / (h - hs + 1) - g**2 / (h + 1)
        gain[(hs < least) | (h - hs < least)] = -1
        k = int(gain.argmax())
        if gain[k] > best[0]:
            best = float(gain[k]), (f, k)
    if best[1] is None:
        return leaf
    f, k = best[1]
    left = x[rows, f] <= k
    return f, float(cuts[f][k]), _grow(x, cuts, gradient, hessian, rows[left], depth - 1), _grow(x, cuts, gradient, hessian, rows[~left], depth - 1)


def boost(values: np.ndarray, blocked: np.ndarray) -> tuple[float, list]:
    """(base log-odds, trees) for features ``values`` by gradient boosting of the logistic loss."""
    rate = min(max(float(blocked.mean()), 1e-3), 1 - 1e-3)
    base = math.log(rate / (1 - rate))
    cuts, binned = [], np.zeros(values.shape, np.int64)
    for f in range(values.shape[1]):
        column = values[:, f]
        edges = np.unique(np.quantile(column, np.linspace(0, 1, BINS + 1)[1:-1], method="lower"))
        edges = edges[edges < column.max()]
        cuts.append(edges)
        binned[:, f] = np.searchsorted(edges, column, side="left")
    score = np.full(len(blocked), base)
    trees = []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _grow(binned, cuts, p - blocked, p * (1 - p), np.arange(len(blocked)), DEPTH)
        trees.append(tree)
        score = score + _predict(tree, values)
    return base, trees


def _predict(tree, values: np.ndarray) -> np.ndarray:
    if not isinstance(tree, tuple):
        return np.full(len(values), tree)
    f, cut, left, right = tree
    return np.where(values[:, f] <= cut, _predict(left, values), _predict(right, values))


def fit(pages: DataFrame, rules=RULES, sample: int = SAMPLE) -> Trees:
    """Grow trees on the labelled URLs with the ``sample`` smallest hashes (each URL once)."""
    rule, verdict = rule_of(rules)
    labelled = with_parts(pages.select("url")).withColumn("verdict", verdict).where("verdict is not null and url is not null")
    labelled = labelled.select("url", "host", "path", "verdict").distinct().orderBy(F.xxhash64("url"), "url").limit(sample)
    got = labelled.select((F.col("verdict") == "block").cast("double").alias("blocked"), *[c.alias(k) for k, c in lexical(F.col("url")).items()], *[c.alias("s_" + k) for k, c in suffix_columns().items()]).toPandas()
    if got["blocked"].nunique() < 2:
        return Trees(0.0, [], {}, 0.0, "block" if len(got) and got["blocked"].iloc[0] == 1 else "allow")
    blocked = got["blocked"].to_numpy()
    prior, rates, columns = float(blocked.mean()), {}, [got[list(FEATURES)].to_numpy(float)]
    # statistics from one half of the sample are used on the other, so that trees do not see their own labels
    half = np.arange(len(got)) % 2
    for name in suffix_columns():
        keys = got["s_" + name]
        own = np.full(len(got), prior)
        for h in (0, 1):
            stats = got[half != h].groupby("s_" + name)["blocked"].agg(["sum", "count"])
            rate = (stats["sum"] + 5 * prior) / (stats["count"] + 5)
            own[half == h] = keys[half == h].map(rate).fillna(prior)
        stats = got.groupby("s_" + name)["blocked"].agg(["sum", "count"]).reset_index()
        rates[name] = {k: round(float((s + 5 * prior) / (c + 5)), 6) for k, s, c in zip(stats["s_" + name], stats["sum"], stats["count"])}
        columns.append(own[:, None])
    base, trees = boost(np.concatenate(columns, axis=1), blocked)
    return Trees(base, trees, rates, prior)


def _expression(tree, names: list[str]) -> Column:
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    f, cut, left, right = tree
    return F.when(F.col(names[f]) <= F.lit(cut), _expression(left, names)).otherwise(_expression(right, names))


def judge(pages: DataFrame, model: Trees | None = None, rules=RULES) -> DataFrame:
    """(page_id, host, path, rule, verdict, score): score is the trees' chance of block, for all URLs."""
    spark = pages.sparkSession
    model = model or fit(pages, rules)
    rule, verdict = rule_of(rules)
    own = with_parts(pages.select("page_id", F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url")))
    if model.constant is not None:
        return own.select("page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, F.lit(model.constant)).alias("verdict"), F.lit(1.0 if model.constant == "block" else 0.0).alias("score"))
    own = own.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("_verdict"), *[c.alias(k) for k, c in lexical(F.col("url")).items()], *[c.alias("k_" + k) for k, c in suffix_columns().items()])
    for name, rates in model.rates.items():
        # one row for each suffix of the sample, and so of a bounded size
        table = spark.createDataFrame(list(rates.items()), f"k_{name} string, s_{name} double")
        own = own.join(F.broadcast(table), "k_" + name, "left").withColumn("s_" + name, F.coalesce("s_" + name, F.lit(model.prior)))
    names = [*FEATURES, *("s_" + name for name in model.rates)]
    odds = F.lit(model.base)
    for tree in model.trees:
        odds = odds + _expression(tree, names)
    scored = own.withColumn("score", 1 / (1 + F.exp(-odds)))
    return scored.select("page_id", "host", "path", "rule", F.coalesce("_verdict", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
