"""The text operators where copies, ids and stores are not as usual."""

import shutil

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strandlight.llm import secret_scan, simhash, tokenstore
from strandlight.llm.common import ship_package

LIVE = "aB3dEfGh1JkLmNoPqRsTuVwXyZ"


def test_copies_of_one_owner_do_not_hide_a_secret(spark):
    ship_package(spark)
    copies = spark.range(51).select(F.col("id").alias("doc_id"), F.lit(f"key {LIVE} end").alias("text"), F.lit("s1").alias("source"))
    assert {r.text for r in secret_scan.redact(copies).collect()} == {"key [secret] end"}
    shared = copies.withColumn("source", F.concat(F.lit("s"), (F.col("doc_id") % 2).cast("string")))
    assert {r.text for r in secret_scan.redact(shared).collect()} == {f"key {LIVE} end"}


@pytest.fixture()
def store(spark, tmp_path):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    ship_package(spark)
    docs = spark.createDataFrame([(i, f"text number {i}") for i in range(12)], "doc_id long, text string")
    folder = str(tmp_path / "store")
    tokenstore.write_store(docs, folder, public_tokenizers.path("word_bpe_49k.json"), 2)
    assert all(r.verified for r in tokenstore.read_store(spark, folder).collect())

    def replace(change):
        change(spark.read.parquet(f"{folder}/recipes")).write.parquet(f"{folder}/changed")
        shutil.rmtree(f"{folder}/recipes")
        shutil.move(f"{folder}/changed", f"{folder}/recipes")
        return tokenstore.read_store(spark, folder).collect()

    return spark.read.parquet(f"{folder}/recipes").collect(), replace


def test_a_lost_part_of_the_recipes_is_seen(store):
    before, replace = store
    part = before[0].part
    got = replace(lambda recipes: recipes.where(f"part != {part}"))
    lost = sum(r.part == part for r in before)
    assert len(got) == len(before) and sum(not r.verified for r in got) == lost == sum(r.doc_id is None for r in got)


def test_a_changed_root_and_a_lost_document_are_seen(store):
    before, replace = store
    part = {r.doc_id: r.part for r in before}
    got = replace(lambda recipes: recipes.withColumn("root", F.when(F.col("doc_id") == 3, F.lit(b"x")).otherwise(F.col("root"))))
    assert {r.doc_id for r in got if not r.verified} == {3}
    got = replace(lambda recipes: recipes.where("doc_id != 5"))
    assert {r.doc_id for r in got if not r.verified} == {None, 3, *(i for i in part if part[i] == part[5] and i != 5)}


def test_unrelated_texts_under_one_id_stay(spark):
    ship_package(spark)
    words = {k: " ".join(f"{k}{i}" for i in range(40)) for k in "abcd"}
    rows = [(1, "a"), (2, "a"), (2, "b"), (2, "b"), (3, "b"), (4, "c"), (4, "d"), (5, "c"), (None, "a")]
    docs = spark.createDataFrame([(i, words[k], k) for i, k in rows], "doc_id long, text string, k string")
    kept = simhash.keep_first(docs, repeats=True)
    assert kept.columns == docs.columns
    assert sorted((repr(r.doc_id), r.k) for r in kept.collect()) == [("1", "a"), ("2", "b"), ("4", "c"), ("4", "d"), ("None", "a")]
    assert sorted((r.doc_id, r.k) for r in corpus_pipeline.near_duplicate_stage(spark, docs.where("doc_id is not null"), "").collect()) == [(1, "a"), (2, "b"), (4, "c"), (4, "d")]
