import math
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from corpusql.operators import textindex as ix
from corpusql.operators import vectors as vc

TEXTS = {
    "1": "The quick fox. The lazy dog!", "2": "quick quick QUICK", "3": None, "4": "", "5": "Ein Fuchs, the fox über 42 dogs",
    "6": "lazy the", **{str(n): f"common filler {n} the" for n in range(100, 160)},
}


def best(texts, question, k):
    held = {i: re.findall(r"[^\W_]+", (t or "").lower()) for i, t in texts.items()}
    mean = sum(map(len, held.values())) / len(held)
    scores = Counter()
    for word in set(re.findall(r"[^\W_]+", question.lower())):
        n = sum(word in w for w in held.values())
        for i, w in held.items():
            if word in w:
                tf = w.count(word)
                weight = math.log(1 + (len(held) - n + 0.5) / (n + 0.5))
                scores[i] += weight * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(w) / mean))
    rounded = {i: round(s + 1e-9, 6) for i, s in scores.items()}
    return sorted(rounded.items(), key=lambda r: (-r[1], r[0]))[:k]


@pytest.fixture(scope="module")
def path(spark, tmp_path_factory):
    """Three appends: the second has rows of the first, the third nothing new."""
    where = str(tmp_path_factory.mktemp("index") / "i")
    rows = list(TEXTS.items())
    df = lambda some: spark.createDataFrame(some, "doc_id string, text string")
    assert ix.append(df(rows[:40] + [rows[0], (None, "the")]), where, buckets=4, segment_docs=8) == 40
    assert ix.append(df(rows[20:]), where, buckets=4, segment_docs=8) == len(rows) - 40
    assert ix.append(df(rows), where, buckets=4) == 0
    return where


@pytest.mark.parametrize("named, sent", [(ix.NAMED_WORDS, ix.SENT_PAIRS), (1, 4)])
def test_ranking_against_brute_force(spark, path, named, sent, monkeypatch):
    monkeypatch.setattr(ix, "NAMED_WORDS", named)
    monkeypatch.setattr(ix, "SENT_PAIRS", sent)
    asked = {"a": "the quick FOX", "b": "lazy lazy", "c": "nothing of this kind", "d": None, "e": "über 42 the common"}
    got = ix.search(spark, path, spark.createDataFrame(list(asked.items()), "query_id string, question string"), 7).collect()
    for name, question in asked.items():
        mine = sorted((r.rank, r.id, r.score) for r in got if r.query_id == name)
        assert [(i, pytest.approx(s, abs=2e-6)) for i, s in best(TEXTS, question or "", 7)] == [(i, s) for _, i, s in mine]
    assert {r.matched for r in got if r.query_id == "a" and r.id == "1"} == {3}


def test_words_that_all_texts_hold_are_many_rows(spark, path):
    rows = ix.postings(spark, path, spark.createDataFrame([("the",)], "word string"))
    sizes = [r.documents for r in rows.collect()]
    assert sum(sizes) == sum("the" in (t or "").lower().split() for t in TEXTS.values()) and len(sizes) > 4 and max(sizes) < 30
    plan = rows._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in plan and "bucket" in plan.split("PartitionFilters: [")[1].split("]")[0]


def test_vocabulary(spark, path):
    got = {r.word: (r.documents, r.occurrences) for r in ix.vocabulary(spark, path).collect()}
    assert got["quick"] == (2, 4) and got["über"] == (1, 1) and got["the"][1] == got["the"][0] + 1
    assert ix.totals(spark, path)[:2] == (2, len(TEXTS))


def test_a_batch_that_was_not_finished_does_not_count(spark, tmp_path):
    where = str(tmp_path / "i")
    docs = spark.createDataFrame([(1, "one two"), (2, "two three")], "doc_id int, text string")
    ix.append(docs.limit(1), where, buckets=2)
    done = ix.vocabulary(spark, where).count()
    ix.append(docs, where, buckets=2)
    torn = [p for p in (tmp_path / "i" / "batches").iterdir() if "part-" in p.name and p.suffix == ".parquet"]
    last = max(torn, key=lambda p: spark.read.parquet(str(p)).first().batch)
    last.unlink()
    assert ix.vocabulary(spark, where).count() == done
    assert ix.append(docs, where, buckets=2) == 1
    assert {r.word: r.documents for r in ix.vocabulary(spark, where).collect()} == {"one": 1, "two": 2, "three": 1}


def test_no_index_and_no_documents(spark, tmp_path):
    with pytest.raises(ValueError):
        ix.totals(spark, str(tmp_path / "none"))
    assert ix.append(spark.createDataFrame([], "doc_id int, text string"), str(tmp_path / "none")) == 0


def test_phrases(spark, path):
    docs = spark.createDataFrame(list(TEXTS.items()), "doc_id string, text string")
    find = lambda phrase, **more: [r.doc_id for r in ix.mentions(docs, path, phrase, [F.asc("doc_id")], 5, **more).collect()]
    assert find("LAZY dog") == ["1"] and find("dog lazy") == [] and find("fox. the") == ["1"] and find("absent words") == []
    assert find("the fox") == ["5"] and find("quick quick", where=F.col("doc_id") > "2") == []


def test_rerank(spark):
    hits = spark.createDataFrame([("q", "a", 10.0), ("q", "b", 1.0), ("p", "b", 30.0), ("q", "c", 9.0)], "query_id string, id string, score double")
    vectors = spark.createDataFrame([("a", [0.0, 1.0]), ("b", [2.0, 0.0]), ("d", [1.0, 1.0])], "id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("p", [1.0, 0.0])], "query_id string, embedding array<double>")
    got = {(r.query_id, r.rank): (r.id, r.total) for r in vc.rerank(hits, vectors, asked, 5).collect()}
    assert got == {("q", 1): ("b", pytest.approx(0.545455, abs=1e-6)), ("q", 2): ("a", 0.25), ("p", 1): ("b", 0.875)}


def test_known_documents_are_left_out_by_ids_alone(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    docs = spark.createDataFrame([(i, f"word{i % 3} word{i % 3} other") for i in range(10)], "doc_id long, text string")
    assert ix.append(docs, path, buckets=4, segment_docs=4) == 10
    monkeypatch.setattr(ix, "materialize", lambda *_: pytest.fail("texts were read for documents that are known"))
    assert ix.append(docs, path, buckets=4, segment_docs=4) == 0


def test_a_task_gives_the_complete_rows_of_its_segments(spark):
    """Segments go over batches and a batch over segments; the places of a word in a segment are one row."""
    texts = [["b", "a", "b"], [], ["a"], ["c", "c", "c"], ["a", "b"]]
    rows = spark.createDataFrame([(str(i), w) for i, w in enumerate(texts)], "id string, words array<string>").coalesce(1)
    for size in (1, 3, 100):
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        try:
            got = rows.mapInArrow(lambda batches: ix._segments(batches, 2), ix.SEGMENT_ROWS).collect()
        finally:
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 2000)
        own = [(r.id, r.length, r.segment, r.place) for r in got if r.word is None]
        assert own == [(str(i), len(w), i // 2, i % 2) for i, w in enumerate(texts)]
        held = {(r.word, r.segment): (r.documents, r.occurrences, r.places, r.times) for r in got if r.word is not None}
        assert held == {
            ("a", 0): (1, 1, [0], [1]), ("b", 0): (1, 2, [0], [2]), ("a", 1): (1, 1, [0], [1]), ("c", 1): (1, 3, [1], [3]),
            ("a", 2): (1, 1, [0], [1]), ("b", 2): (1, 1, [0], [1]),
        }
