"""The pipeline's stages and the registered queries."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from duskrank.llm import queries
from tests.oracle_check import connect, differences

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_edge_rows(spark, edge_docs, no_docs, sf_dir):
    for docs in (edge_docs, no_docs):
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf_dir)
            assert set(COLUMNS) <= set(docs.columns)
        assert "ids" in corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).columns


def test_stages_keep_clean_documents(spark, make_docs, prose, sf_dir):
    docs = make_docs([(i, prose(i), f"s{i % 3}") for i in range(30)])
    for name, stage in corpus_pipeline.STAGES[:3]:
        out = stage(spark, docs, sf_dir)
        assert sorted(map(str, out.collect())) == sorted(map(str, docs.collect())), name


def test_near_dedup_stage_keeps_one(spark, make_docs, prose, sf_dir):
    docs = make_docs([(i, prose(i % 7) + f" tail {i}", "a") for i in range(70)])
    out = dict(corpus_pipeline.STAGES)["near_dedup"](spark, docs, sf_dir)
    assert sorted(r["doc_id"] for r in out.collect()) == list(range(7))


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.columns == ["doc_id", "source", "n_tokens", "ids", "round_trip"]
    rows = out.collect()
    assert rows and all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in rows)
    assert max(rows.count(r) for r in rows[:50]) <= 2


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_queries_equal_sql(spark, name):
    sf_dir = "/root/testdata/sf0.01"
    got = queries.QUERIES[name](spark, sf_dir).toPandas()
    assert differences(got, connect(sf_dir).execute(queries.ORACLE_SQL[name]).df()) == ""
    assert len(got)


def test_recall_of_the_query(spark):
    sf_dir = "/root/testdata/sf0.01"
    got = {tuple(r) for r in queries.QUERIES["op3_hnsw"](spark, sf_dir).select("query_id", "vec_id").collect()}
    want = connect(sf_dir).execute(
        """SELECT query_id, vec_id FROM (
             SELECT q.vec_id AS query_id, c.vec_id, row_number() OVER (
               PARTITION BY q.vec_id ORDER BY list_inner_product(q.embedding, c.embedding) DESC, c.vec_id) AS r
             FROM embeddings q JOIN embeddings c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0) WHERE r <= 20"""
    ).fetchall()
    assert len(got & set(want)) >= 0.9 * len(want) and len(got) == len(want)


def test_every_operator_is_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert {n.split("_")[0] for n in names if n.startswith("op")} == {f"op{k}" for k in range(1, 14)} and "pipeline" in names


def test_stages_keep_columns_with_common_names(spark, edge_docs, sf_dir):
    names = ["removed", "depleted", "_id", "size", "node", "digest", "copies", "seeds"]
    docs = edge_docs
    for k, name in enumerate(names):
        docs = docs.withColumn(name, F.lit(k))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns
        assert out.select(*names).distinct().count() <= 1


def test_no_task_of_the_encoding_has_two_python_workers(spark, edge_docs, sf_dir):
    out = corpus_pipeline.encode(spark, edge_docs, sf_dir)
    assert out._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert out.count() == edge_docs.count() and out.filter("NOT round_trip").count() == 0
