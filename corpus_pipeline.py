"""The corpus pipeline: quality, toxicity, near duplicates, secrets, packing.

Each stage takes (spark, docs, sf_dir) and works on all that the one before it kept; all but the last
return the columns of documents.  ``run`` writes each stage's rows as Parquet to the shared folder and reads them again.

In every stage null text is the empty text (and stays null), very long texts are read whole, repeated rows are judged alike, columns of any
further name pass through, and an empty table gives no rows.  A null doc_id is kept by the filters and by the near-duplicate stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from strandlight.llm import packing, quality, secret_scan, simhash, toxicity
from strandlight.llm.common import shared_folder, ship_package, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go; without labels all stay."""
    ship_package(spark)
    return quality.keep_good(docs, table(spark, sf_dir, "labels"))


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier rejects go; without labels all stay."""
    ship_package(spark)
    return toxicity.drop_toxic(docs, table(spark, sf_dir, "labels"))


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays: the one with the smallest id; of repeated rows one."""
    ship_package(spark)
    return simhash.keep_first(docs, repeats=True)


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Credentials that look live, those of one source alone, are blanked; examples that several sources share stay as they are."""
    ship_package(spark)
    return secret_scan.redact(docs)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' token pieces, packed into sequences; repeated rows are packed each."""
    import public_tokenizers

    ship_package(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("quality", quality_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("secrets", secret_stage),
    ("packing", packing_stage),
]

# the classifiers' training and the tokenizer have no counterpart in SQL
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (name, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}-{name}")
        docs = spark.read.parquet(f"{folder}/{k}-{name}")
    return docs
