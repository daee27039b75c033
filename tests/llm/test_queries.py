"""The registered queries and the pipeline over a whole small table."""

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from parecer.llm import queries
from tools.check_oracle import compare, connect

FOLDER = "/root/testdata/sf0.001"
ROWS = {"op8_chat": "conversations", "op9_url_filter": "pages"}


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query_covers_its_table(spark, name):
    got = entry.queries()[name](spark, FOLDER)
    table = spark.read.parquet(f"{FOLDER}/{ROWS.get(name, 'documents')}.parquet")
    if name == "op8_chat":
        assert got.count() == table.select("conv_id").distinct().count() + 1
    elif name == "op13_hard_negatives":
        anchors = spark.read.parquet(f"{FOLDER}/embeddings.parquet").where("vec_id % 100 = 0")
        assert got.select("anchor_id").distinct().count() == anchors.count()
    elif name == "op4_packing":
        assert got.select("doc_id").distinct().count() == table.count()
    else:
        assert got.count() == table.count()


def test_one_query_for_each_operator():
    numbers = [int(n[2:].split("_")[0]) for n in queries.QUERIES]
    assert sorted(numbers) == list(range(1, 14))
    assert "pipeline" in entry.queries()


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    schema, n = docs.schema, docs.count()
    for i, (name, stage) in enumerate(corpus_pipeline.STAGES):
        docs = stage(spark, docs, FOLDER)
        if i < len(corpus_pipeline.STAGES) - 1:
            assert docs.schema == schema
        docs.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
    assert 0 < docs.select("doc_id").distinct().count() <= n


@pytest.mark.parametrize("name", ["op11_mixing", "op12_periodic_runs", "op13_hard_negatives"])
def test_query_gives_what_its_sql_gives(spark, name):
    folder = FOLDER.replace("0.001", "0.01")
    verdict, _, _ = compare(
        spark, connect(folder), folder, name, queries.QUERIES[name], queries.ORACLE_SQL[name]
    )
    assert verdict == "ok"
