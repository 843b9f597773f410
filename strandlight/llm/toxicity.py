"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A feature is present or not, whatever the document's length, so that a few words are found in a very
long text as well.  Null and empty texts score the bias alone; very long ones are read whole.  Repeated rows get equal scores, and of an
id's repeated labels the larger counts.  A score at the threshold is on the upper side.  An empty table gives no rows.  Without labels the score is 0.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.ftrl import Model, View, fit, remainder, scored

VIEW = View(grams=((0,), (1, 0), (2, 0)))
THRESHOLD = 0.5


def fit_toxicity(docs: DataFrame, labels: DataFrame, **settings) -> Model:
    return fit(docs, labels, "toxic", VIEW, calibrate=True, **({"alpha": 1.0, "l1": 5.0, "l2": 0.0, "constant": 0.0} | settings))


def toxicity_scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted); a null doc_id counts as held out."""
    out = scored(docs.select("doc_id", "text"), fit_toxicity(docs, labels, **settings))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that are not predicted toxic, with their columns."""
    return scored(docs, fit_toxicity(docs, labels, **settings), "__toxicity_score").where(F.col("__toxicity_score") < THRESHOLD).drop("__toxicity_score")
