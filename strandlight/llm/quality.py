"""Quality classifier: logistic regression over hashed word n-grams, trained by FTRL updates.

Words are seen twice: as normalised words, and as shapes (case, digits, outer punctuation), since text
that is broken in form shares no words.  A feature's value is its share of the document's words, so a score is a sparse dot product over
the occurrences.  Null and empty texts score the bias alone; very long ones are read whole.  Repeated rows get equal scores, and of an
id's repeated labels the larger counts.  A score at the threshold is on the upper side.  An empty table gives no rows.  Without labels the score is 1.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlight.llm.ftrl import Model, View, fit, remainder, scored

VIEW = View(grams=((0,), (1, 0)), shape_grams=((0,), (1, 0), (2, 1, 0)), repeats=True, presence=False)
THRESHOLD = 0.3


def fit_quality(docs: DataFrame, labels: DataFrame, **settings) -> Model:
    return fit(docs, labels, "quality", VIEW, **({"alpha": 3.0, "l1": 0.05, "l2": 0.0, "epochs": 2, "constant": 1.0} | settings))


def quality_scores(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """(doc_id, held_out, score, predicted); a null doc_id counts as held out."""
    out = scored(docs.select("doc_id", "text"), fit_quality(docs, labels, **settings))
    return out.select("doc_id", F.coalesce(remainder(F.col("doc_id")) == 0, F.lit(True)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The documents that are predicted good, with their columns."""
    return scored(docs, fit_quality(docs, labels, **settings), "__quality_score").where(F.col("__quality_score") >= THRESHOLD).drop("__quality_score")
