"""The pipeline's stages against plain computations on each one's own input, and the SQL of the queries that have it."""

import os
from collections import Counter

import duckdb
import pytest

import __spark_entry__
import corpus_pipeline
from cloakwork.llm import common
from tests.llm.test_training_ops import SCHEMA, components, odd_rows, pieces, plain_dedup

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    outs = {}
    for name, stage in corpus_pipeline.STAGES:
        outs[name] = docs = stage(spark, docs, SF).cache()
        if name != "pieces":
            assert docs.columns == spark.read.parquet(f"{SF}/documents.parquet").columns
    kept = outs["language_id"].collect()
    assert 0.9 * spark.read.parquet(f"{SF}/documents.parquet").count() <= len(kept)
    first = {k[1] for k in plain_dedup(kept)}
    assert Counter(r["doc_id"] for r in outs["exact_dedup"].collect()) == Counter(first)
    plain = components([(r["doc_id"], r["text"]) for r in outs["exact_dedup"].collect()])
    assert Counter(r["doc_id"] for r in outs["ngram_join"].collect()) == Counter(set(plain.values()))
    texts = {r["doc_id"]: r["text"] for r in outs["ngram_join"].collect()}
    mixed = outs["mixing"].collect()
    assert {r["doc_id"] for r in mixed} <= set(texts) and max(Counter(r["doc_id"] for r in mixed).values()) <= 3
    want = dict(zip(texts, pieces(texts.values())))
    assert Counter(tuple(r) for r in outs["pieces"].collect()) == Counter((r["doc_id"], *want[r["doc_id"]]) for r in mixed)
    assert Counter(corpus_pipeline.run(spark, SF).collect()) == Counter(outs["pieces"].collect())


@pytest.mark.parametrize("name", ["op3_ngram_join", "op8_exact_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    found = __spark_entry__.queries()[name](spark, SF).select(*want.columns)
    assert Counter(map(tuple, found.collect())) == Counter(want.fetchall())


def test_stages_on_odd_and_empty_tables(spark):
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    for table in (odd, odd.where("false")):
        docs = table
        for name, stage in corpus_pipeline.STAGES:
            before, docs = docs, stage(spark, docs, SF).cache()
            if name != "pieces":
                assert docs.columns == odd.columns and {r["doc_id"] for r in docs.collect()} <= {r["doc_id"] for r in before.collect()}
        assert docs.count() == before.count()


def test_run_leaves_its_result_only(spark, tmp_path):
    odd = spark.createDataFrame(odd_rows(), SCHEMA)
    odd.write.parquet(str(tmp_path / "documents.parquet"))
    root = common.shared_dir(spark)
    had = set(os.listdir(root))
    found = corpus_pipeline.run(spark, str(tmp_path))
    assert found.count() > 0 and [n.split("-")[:2] for n in set(os.listdir(root)) - had] == [["pipeline", "pieces"]]
