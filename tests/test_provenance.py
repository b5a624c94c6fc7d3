import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusql.functions import ids
from corpusql.operators import hybrid as hy
from corpusql.operators import provenance as pv


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(f"d{i}", f"f{i}.txt", "text") for i in range(30)], "doc_id string, filename string, source_type string")


@pytest.fixture(scope="module")
def chunks(spark):
    rows = [(f"d{i}_chunk_{j}", f"d{i}", j, 10 + j, f"text {i} {j}") for i in range(29) for j in range(i % 3 + 1)]
    return spark.createDataFrame(rows, "chunk_id string, doc_id string, chunk_index int, token_count int, text string")


@pytest.fixture(scope="module")
def log(spark):
    rows = [
        (f"q{i:02d}", f"question {i % 4}", "SELECT 1", None, ["d1", f"d{i}"], datetime(2024, 1, 1, 0, i), float(i), "bad" if i % 5 == 0 else None)
        for i in range(40)
    ]
    return spark.createDataFrame(rows, pv.LOG_SCHEMA)


def test_ids(spark):
    row = spark.range(1).select(
        ids.doc_id(F.lit("a.txt"), F.lit("/tmp/a.txt")).alias("d"), ids.query_id(F.lit("q"), F.lit("t")).alias("q"),
        ids.chunk_id(F.lit("doc_123"), F.lit(0)).alias("c"),
    ).collect()[0]
    assert row.c == "doc_123_chunk_0"
    assert re.fullmatch(r"[0-9a-f]{16}", row.d) and re.fullmatch(r"[0-9a-f]{16}", row.q)


def test_sources(spark, docs, chunks):
    results = spark.createDataFrame([("d2_chunk_0", 1), ("d2_chunk_1", 2), ("zzz", 3), (None, 4)], "source_chunk_id string, v int")
    assert [r.doc_id for r in pv.result_sources(results, chunks, docs).collect()] == ["d2"]
    every = chunks.select("chunk_id")
    assert pv.result_sources(every, chunks, docs, limit=10).count() == 10
    assert pv.result_sources(every, chunks, docs).count() == chunks.select("doc_id").distinct().count() > 10
    named = spark.createDataFrame([("d3", 1), (None, 2)], "doc_id string, v int")
    assert [r.doc_id for r in pv.result_sources(named, chunks, docs).collect()] == ["d3"]
    with pytest.raises(ValueError):
        pv.result_sources(docs.select("filename"), chunks, docs)


def test_trace(log, docs):
    rows = pv.trace_query(log, docs, "q02").collect()
    assert {r.doc_id for r in rows} == {"d1", "d2"} and {r.document_count for r in rows} == {2}
    assert [r.doc_id for r in pv.trace_query(log, docs, "q01").collect()] == ["d1"]
    assert [r.doc_id for r in pv.trace_query(log, docs, "q35").collect()] == ["d1"]
    assert pv.trace_query(log, docs, "unknown").count() == 0
    with pytest.raises(LookupError):
        pv.find_query(log, "unknown")


def test_lineage(log, docs, chunks):
    rows = pv.document_lineage(docs, chunks, log, "d1").orderBy("item", "position").collect()
    assert [r.item_id for r in rows if r.item == "chunk"] == ["d1_chunk_0", "d1_chunk_1"]
    assert [r.item_id for r in rows if r.item == "query"] == [f"q{i:02d}" for i in range(39, 19, -1)]
    counts = {r.doc_id: r for r in pv.lineage_counts(docs, chunks, log).collect()}
    assert (counts["d1"].chunk_count, counts["d1"].query_count, counts["d1"].total_queries) == (2, 20, 40)
    assert (counts["d29"].chunk_count, counts["d29"].query_count) == (0, 1)


def test_lineage_matches_whole_ids_only(spark, docs, chunks):
    other = spark.createDataFrame([("q", "x", "s", None, ["d10"], datetime(2024, 1, 1), 1.0, None)], pv.LOG_SCHEMA)
    assert pv.document_queries(other, "d1").count() == 0


def test_audit(log, docs, chunks):
    row = pv.audit_summary(docs, chunks, log).collect()[0]
    assert (row.total_queries, row.successful_queries, row.avg_execution_time_ms) == (40, 32, 19.5)
    assert (row.total_documents, row.total_chunks) == (30, chunks.count())
    recent = pv.recent_queries(log).collect()
    assert [r.query_id for r in recent] == [f"q{i}" for i in range(39, 29, -1)]
    assert [r.has_error for r in recent] == [i % 5 == 0 for i in range(39, 29, -1)]
    period = pv.audit_period(log, 7).collect()[0]
    assert period.first_query == datetime(2024, 1, 1, 0, 0) and period.total_entities == 7
    assert [(r.question, r.n) for r in pv.frequent_queries(log, 2).collect()] == [("question 0", 10), ("question 1", 10)]


def test_entity_provenance(spark, docs):
    deals = spark.createDataFrame([("k1", "d3", 5), ("k2", None, 6), ("k3", "gone", 7)], "deal_id string, doc_id string, v int")
    got = {r.deal_id: r.filename for r in pv.entity_provenance(deals, docs, "deal").collect()}
    assert got == {"k1": "f3.txt", "k2": None, "k3": None}
    assert pv.entity_provenance(deals, docs, "deal", "k1").count() == 1


def test_log_holds_failures(spark, tmp_path):
    runs = spark.createDataFrame([("ok", None), ("bad", "syntax")], "question string, error string")
    rows = pv.log_rows(
        runs, F.col("question"), F.lit("SELECT 1"), F.struct(F.lit(1).alias("n")), F.array(F.lit("d1")),
        F.lit("2024-01-01").cast("timestamp"), F.lit(5), F.col("error"),
    )
    pv.append_log(rows, str(tmp_path / "log"))
    back = {r.question: r for r in spark.read.parquet(str(tmp_path / "log")).collect()}
    assert back["ok"].result_json == '{"n":1}' and back["ok"].error is None
    assert back["bad"].result_json is None and back["bad"].error == "syntax"


def test_table_counts(spark):
    got = {r.table_name: (r.row_count, r.readable) for r in pv.entity_table_counts({"a": spark.range(3), "b": None}).collect()}
    assert got == {"a": (3, True), "b": (None, False)}


def test_filter_ids(spark):
    rows = spark.createDataFrame([("a", "x", 1), ("", "y", 2), (None, None, 3), (None, "", None)], "doc_id string, document_id string, id int")
    assert sorted(r.doc_id for r in hy.filter_doc_ids(rows).collect()) == ["3", "a", "y"]
    assert hy.filter_doc_ids(rows.select(F.lit(1).alias("other"))).count() == 0


def test_narrowing_and_context(spark, docs, chunks):
    hits = spark.createDataFrame([("d2",), ("d2",), ("d4",), ("nope",)], "doc_id string")
    few = hy.narrow_corpus(docs, hits)
    assert [r.doc_id for r in few.collect()] == ["d2", "d4"]
    assert hy.narrow_corpus(docs, None).count() == 10
    assert hy.narrow_corpus(docs, None, None).count() == 30
    row = hy.hybrid_context(chunks, few).collect()[0]
    assert row.documents == 2 and row.confidence == 0.8
    assert row.context == "[Document 1]\ntext 2 0\n\ntext 2 1\n\ntext 2 2\n\n---\n\n[Document 2]\ntext 4 0\n\ntext 4 1"
    none = hy.hybrid_context(chunks, docs.limit(0)).collect()[0]
    assert (none.documents, none.confidence, none.context) == (0, 0.0, hy.NO_DOCUMENTS)
    assert hy.document_metadata(docs, few, ["filename"]).count() == 2
    with pytest.raises(ValueError):
        hy.hybrid_context(chunks, few, None, None)


@pytest.mark.parametrize("segment_chunks, order_by", [(1, ["doc_id"]), (2, ["filename", "doc_id"]), (1000, ["doc_id"])])
def test_blocks_are_the_whole_context(spark, docs, chunks, segment_chunks, order_by):
    """The rows put together are the same text as the one value with wide limits; empty and missing chunks included."""
    odd = chunks.withColumn("text", F.when((F.col("doc_id") == "d7") | (F.col("chunk_index") == 1), "").otherwise(F.col("text")))
    made = hy.hybrid_blocks(odd, docs.union(docs.limit(3)), order_by, segment_chunks)
    rows = sorted(made.collect(), key=lambda r: (r.document, r.segment))
    assert made.columns == ["document", "segment", "doc_id", "chunks", "block"]
    assert len({(r.document, r.segment) for r in rows}) == len(rows)
    if order_by == ["doc_id"]:
        whole = hy.hybrid_context(odd, docs, None, 10**8, 10**6).first()
        assert "".join(r.block for r in rows) == whole.context and rows[-1].document == whole.documents
    assert hy.hybrid_blocks(odd, docs.limit(0)).count() == 0


def test_stored_uses_equal_the_log(spark, log, tmp_path):
    path = str(tmp_path / "uses")
    with pytest.raises(ValueError):
        pv.stored_document_queries(spark, path)
    for batch, part in enumerate(["query_id < 'q15'", "query_id >= 'q30'", "query_id BETWEEN 'q15' AND 'q29'", "false"]):
        pv.store_uses(log.filter(part), path, batch, buckets=4)
    pv.store_uses(log.filter("query_id < 'q15'"), path, 0, buckets=4)

    def plain(df):
        return sorted(map(tuple, df.select("doc_id", "query_id", "question", "executed_at", "rank").collect()))

    assert plain(pv.stored_document_queries(spark, path)) == plain(pv.document_queries(log))
    one = pv.stored_document_queries(spark, path, ["d1", "d7", "none"], 3)
    assert plain(one) == plain(pv.document_queries(log, "d1", 3).union(pv.document_queries(log, "d7", 3)))
    plan = one._jdf.queryExecution().toString()
    assert "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]
    counts = {r.doc_id: r.total_queries for r in pv.stored_use_counts(spark, path).collect()}
    assert counts == {f"d{i}": 40 if i == 1 else 1 for i in range(40)}
    with pytest.raises(ValueError):
        pv.stored_document_queries(spark, path, n=pv.LINEAGE_QUERIES + 1)


def test_lineage_of_a_document_from_stored_uses(spark, log, tmp_path):
    path = str(tmp_path / "uses")
    pv.store_uses(log, path, 0, buckets=4)
    docs = spark.createDataFrame([("d1",), ("d2",)], "doc_id string")
    parts = spark.createDataFrame([("d1", "d1_chunk_0", 0, 5), ("d2", "d2_chunk_0", 0, 7)], "doc_id string, chunk_id string, chunk_index int, token_count int")
    for doc_id in ("d1", None):
        got, want = (sorted(map(str, pv.document_lineage(docs, parts, log, doc_id, stored=s).collect())) for s in (path, None))
        assert got == want and len(got) >= 21
