import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusql.operators import evaluate as ev
from corpusql.operators import quality as ql
from corpusql.operators import vectors as vc


def test_dedup(spark):
    docs = spark.createDataFrame([(3, "a"), (1, "a"), (2, "b"), (4, None)], "doc_id int, text string")
    got = {r.doc_id: r.copies for r in ql.dedup_documents(docs).collect()}
    assert got == {1: 2, 2: 1, 4: 1}
    seen = docs.filter("text = 'b'").select(ql.content_hash(F.col("text")).alias("content_hash"))
    assert {r.doc_id for r in ql.dedup_documents(docs, seen=seen).collect()} >= {1}
    assert 2 not in {r.doc_id for r in ql.dedup_documents(docs, seen=seen).collect()}


def test_flags(spark):
    docs = spark.createDataFrame([("x" * 99,), ("x" * 100,)], "text string")
    assert [r.maybe_scanned for r in ql.text_flags(docs).collect()] == [True, False]
    chunks = spark.createDataFrame([(49,), (50,)], "token_count int")
    assert [r.too_short for r in ql.chunk_flags(chunks).collect()] == [True, False]
    rows = spark.createDataFrame([("a", 0.8), ("a", 0.9), ("b", 0.85), ("b", None), ("b", 0.9), ("b", 0.99)], "entity string, confidence double")
    got = {r.entity: (r.low_share, r.needs_review) for r in ql.extraction_flags(rows).collect()}
    assert got == {"a": (0.5, True), "b": (0.25, False)}


def test_rules(spark):
    rows = spark.createDataFrame([(1.0, "Won"), (-1.0, "Lost"), (-2.0, "Maybe"), (None, None)], "v double, status string")
    rules = {"v not negative": F.col("v") >= 0, "status": F.col("status").isin("Won", "Lost", "Open")}
    got = {r.rule: (r.violations, r.rows) for r in ql.validation_counts(rows, rules).collect()}
    assert got == {"v not negative": (2, 4), "status": (1, 4)}
    good, bad = ql.validate(rows, rules)
    assert good.count() == 2
    assert {r.broken_rules for r in bad.collect()} == {"v not negative", "v not negative,status"}


def test_extractors_mix_expressions_and_pandas(spark):
    extractors = ql.Extractors()
    extractors.register("first")(lambda c: F.substring(c, 1, 1))

    @extractors.register("size")
    @F.pandas_udf("long")
    def size(texts: pd.Series) -> pd.Series:
        return texts.str.len()

    row, = extractors.apply(spark.createDataFrame([("hello",)], "text string")).collect()
    assert (row["first"], row["size"]) == ("h", 5)


def test_keyword_rank(spark):
    rows = spark.createDataFrame([(1, "Quick Implementation", 5), (2, "slow", 9), (3, "a quick implementation", 7)], "id int, text string, v int")
    got = ql.keyword_rank(rows, "QUICK implementation", [F.desc("v"), F.asc("id")], 3).collect()
    assert [r.id for r in got] == [3, 1]


def test_accuracy_and_recall(spark):
    rows = spark.createDataFrame(
        [
            ("q1", "It is $28.3 billion.", "it is  28.3 BILLION"), ("q2", "Yes. Acme has 500 employees. It was founded in 1995.", "Yes, Acme has 500 employees."),
            ("q3", "12", None), ("q4", "", "x"),
        ],
        "query_id string, gold_answer string, judged_answer string",
    )
    row = ev.answer_accuracy(rows).collect()[0]
    assert (row.answers, row.correct, row.accuracy) == (4, 1, 0.25)
    got = {r.query_id: (r.total_claims, r.covered_claims, r.recall) for r in ev.answer_recall(rows).collect()}
    assert got == {"q1": (1, 1, 1.0), "q2": (3, 2, pytest.approx(2 / 3)), "q3": (1, 0, 0.0), "q4": (0, 0, None)}
    whole = ev.mean_recall(ev.answer_recall(rows)).collect()[0]
    assert whole.recall == pytest.approx(3 / 5)


def test_model_verdict(column):
    assert column([" Yes, it is", "No", "yesterday", None], ev.model_verdict) == [True, False, False, False]


@pytest.fixture(scope="module")
def space():
    rng = np.random.default_rng(5)
    rows, queries = rng.normal(size=(300, 8)), rng.normal(size=(7, 8))
    rows[10] = rows[11] = rows[12]
    rows[13] = 0
    return rows, queries


def brute(rows, queries, k):
    unit = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300)
    scores = np.round(unit(queries) @ unit(rows).T, 6)
    return {
        (str(q), rank + 1): (name, pytest.approx(scores[q][int(name)], abs=2e-6))
        for q in range(len(queries))
        for rank, name in enumerate(sorted(map(str, range(len(rows))), key=lambda n: (-scores[q][int(n)], n))[:k])
    }


def frame(spark, matrix, name):
    return spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(matrix)], f"{name} int, embedding array<double>")


@pytest.mark.parametrize("k", [1, 5, 400])
@pytest.mark.parametrize("way", ["shipped", "cells"])
def test_nearest_against_brute_force(spark, space, k, way, monkeypatch):
    rows, queries = space
    if way == "cells":
        monkeypatch.setattr(vc, "MAX_QUERY_VALUES", 0)
        monkeypatch.setattr(vc._cells, "__defaults__", (64, 2))
    found = vc.vector_topk(frame(spark, rows, "id").repartition(5), frame(spark, queries, "query_id"), k)
    got = {(r.query_id, r.rank): (r.id, r.similarity) for r in found.collect()}
    assert got == brute(rows, queries, k)


def test_no_query_gives_no_hit(spark, space):
    rows, queries = space
    none = frame(spark, queries, "query_id").limit(0)
    assert vc.vector_topk(frame(spark, rows, "id"), none, 3).count() == 0


def test_limited_to_filtered_documents(spark, space):
    rows, queries = space
    allowed = spark.createDataFrame([(i,) for i in range(0, 300, 50)] * 2, "id int")
    kept = vc.limit_to(frame(spark, rows, "id"), allowed, "id")
    assert kept.count() == 6


def test_hybrid_rank(spark):
    hits = spark.createDataFrame([("q", "a", 0.9), ("q", "b", 0.5), ("q", "c", 0.1)], "query_id string, id string, similarity double")
    scored = spark.createDataFrame([("a", 0.0), ("b", 1.0)], "id string, score double")
    got = [(r.id, r.total) for r in vc.hybrid_rank(hits, scored).orderBy("rank").collect()]
    assert got == [("b", 0.75), ("a", 0.45)]
