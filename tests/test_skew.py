"""One key holds a third of all rows: results must be whole, and no group unbounded."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusql.operators import chunking as ck
from corpusql.operators import provenance as pv
from corpusql.operators import quality as ql
from corpusql.operators import schema as sc
from corpusql.operators import stats
from corpusql.plans import relational as rel

ROWS = 6000


@pytest.fixture(scope="module")
def skewed(spark):
    rng = random.Random(11)
    rows = [(i, "hot" if i % 3 == 0 else f"k{rng.randrange(900)}", rng.randrange(50)) for i in range(ROWS)]
    return rows, spark.createDataFrame(rows, "id int, k string, v int").repartition(8)


def test_value_counts(skewed):
    rows, df = skewed
    got = {r.value: r.n for r in stats.value_counts(df).collect()}
    assert got == dict(Counter(k for _, k, _ in rows))


def test_ranking_per_group(skewed):
    rows, df = skewed
    got = {(r.k, r.rank): r.id for r in rel.ranking(df, ["-v", "id"], 3, within=["k"]).collect()}
    for key in {k for _, k, _ in rows}:
        best = sorted((-v, i) for i, k, v in rows if k == key)[:3]
        assert [got[key, n + 1] for n in range(len(best))] == [i for _, i in best]


def test_dedup(skewed):
    rows, df = skewed
    got = {r.k: (r.id, r.copies) for r in ql.dedup_documents(df, "id", "k").collect()}
    assert len(got) == len({k for _, k, _ in rows})
    assert got["hot"] == (0, ROWS // 3)


def test_relationship(skewed, spark):
    rows, df = skewed
    parent = df.select("k").distinct().filter("k != 'hot'")
    row = sc.relationship_check(df, "k", parent, "k").collect()[0]
    assert (row.child_rows, row.orphan_rows, row.max_children) == (ROWS, ROWS // 3, ROWS // 3)


def test_registry(skewed):
    rows, df = skewed
    registry = df.select(F.col("k").alias("table_name"), F.col("v").alias("schema_json"), F.col("id").alias("created_at"))
    got = {r.table_name: r.created_at for r in sc.registry_upsert(registry, registry.limit(0)).collect()}
    assert got == {k: max(i for i, x, _ in rows if x == k) for k in {k for _, k, _ in rows}}


def test_a_document_of_very_many_chunks(spark):
    text = " ".join(f"w{i}" for i in range(9000))
    docs = spark.createDataFrame([("hot", text), ("cold", "a b c")], "doc_id string, text string")
    chunks = ck.token_chunks(docs, 2, 1).repartition(8)
    parts = ck.reassemble(chunks, dedup_overlap=True, overlap=1, segment_chunks=500)
    assert parts.agg(F.max("chunks")).first()[0] == 500
    hot = [r.text for r in parts.filter("doc_id = 'hot'").orderBy("segment").collect()]
    assert len(hot) == 18 and "".join(hot) == text


def test_a_document_used_by_a_third_of_the_queries(skewed, spark):
    rows, df = skewed
    log = df.select(
        F.col("id").cast("string").alias("query_id"), F.lit("q").alias("question"), F.lit("s").alias("sql_executed"),
        F.array("k").alias("source_docs"), F.timestamp_seconds("id").alias("executed_at"),
        F.lit(1.0).alias("execution_time_ms"),
    )
    docs = df.select(F.col("k").alias("doc_id")).distinct().withColumn("filename", F.col("doc_id"))
    assert pv.trace_query(log, docs).count() == ROWS
    used = pv.document_queries(log).filter("doc_id = 'hot'").orderBy("rank").collect()
    assert [r.query_id for r in used] == [str(i) for i in range(ROWS - 3, ROWS - 63, -3)]


def test_a_label_in_every_document(spark):
    docs = spark.range(3000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("Status: "), F.when(F.col("id") % 3 == 0, "open").otherwise(F.col("id").cast("string"))).alias("text")
    )
    row, = sc.induce_attributes(sc.labelled_values(docs), docs, "Deal").collect()
    assert (row.confidence, row.documents, row.examples[0], row.type) == (1.0, 3000, "open", "TEXT")


def test_no_plan_uses_a_cross_join(spark, sf_dir, capsys):
    from corpusql.catalog import QUERIES

    for name in ("audit_summary", "q_semantic_range", "vector_topk", "induce_attributes", "ingest_summary",
                 "discover_relationships", "json_documents", "hybrid_context"):
        QUERIES[name](spark, sf_dir).explain()
        plan = capsys.readouterr().out
        assert "CartesianProduct" not in plan and "NestedLoopJoin" not in plan, name
