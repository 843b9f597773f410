"""The stages one after another on the smallest documents, each held to what it should do to its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from strandlight.llm import simhash
from strandlight.llm.common import ship_package

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    ship_package(spark)
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, out[-1], SF).write.parquet(str(folder / str(k)))
        out.append(spark.read.parquet(str(folder / str(k))))
    return out


def test_columns_and_order(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "secrets", "packing"]
    for before, after in zip(stages[:-2], stages[1:-1]):
        assert after.columns == stages[0].columns and after.count() <= before.count()


def test_one_document_of_each_group_stays(stages):
    groups = simhash.near_duplicates(stages[2])
    expected = {r.doc_id for r in groups.collect() if r.doc_id == r.component_id}
    assert {r.doc_id for r in stages[3].collect()} == expected


def test_secrets_change_texts_only(stages):
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()}


def test_all_that_is_left_is_packed(stages):
    assert {r.doc_id for r in stages[5].collect()} == {r.doc_id for r in stages[4].collect()}


def test_run_gives_the_same_documents(spark, stages):
    got = corpus_pipeline.run(spark, SF)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in got.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in stages[5].collect())


def test_empty_corpus(spark, stages):
    docs = stages[0].limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
    assert docs.count() == 0


def test_awkward_rows_go_through_every_stage(spark, tmp_path):
    """Nulls in any column, empty and very long texts, repeated rows and ids, and columns whose names the operators use."""
    plain = spark.read.parquet(f"{SF}/documents.parquet").where("doc_id < 40")
    kinds = dict(plain.dtypes)
    odd = [(9001, None, None, None, None), (9002, "", "en", "s", 0), (9003, "ordinary words of a long text " * 20_000, "en", "s", 1), (9004, "x" * 200_000, None, "s", 1), (None, "a text without an id but with words", "en", None, 1), (None, None, None, None, None)]
    odd += [(9005, "the same row twice, word for word", "en", "s", 33)] * 2 + [(9006, "one text under an id", "en", "s", 1), (9006, "and another under it", "en", "s", 1)]
    docs = plain.unionByName(spark.createDataFrame(odd, ", ".join(f"{c} {kinds[c]}" for c in ("doc_id", "text", "lang", "source", "n_chars"))))
    for c in ("fp", "score", "_id", "_y", "root", "live", "base", "part", "bin", "length", "_text", "turn"):
        docs = docs.withColumn(c, F.lit(1))
    columns = docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        before, docs = docs, spark.read.parquet(str(tmp_path / str(k)))
        if name != "packing":
            assert docs.columns == columns and 0 < docs.count() <= before.count()
            assert docs.select("doc_id").subtract(before.select("doc_id")).count() == 0
        if name == "near_duplicates":
            kept = [(r.doc_id, r.text) for r in docs.where("doc_id >= 9001").collect()]
            assert len(kept) == len(set(kept))  # of repeated rows one stays
    lengths = {r.doc_id: r.n for r in docs.groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    assert lengths.keys() == {r.doc_id for r in before.select("doc_id").distinct().collect()} and all(n >= 1 for n in lengths.values())
