"""Toxicity and quality: held-out accuracy, and inputs without anything to learn from."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusql.llm import learning, quality, toxicity
from corpusql.llm.queries import QUERIES


def test_bins_of_one_text_alone():
    one = {(a, b) for owner, bins in toxicity.hashed_ngrams(["Größe", "", "abcdef"]) for a, b in zip(owner.tolist(), bins.tolist()) if a >= 0}
    alone = {b for owner, bins in toxicity.hashed_ngrams(["ABCDEF"]) for b in bins.tolist()}
    assert {b for a, b in one if a == 2} == alone and len(alone) == 6


def test_present_counts_once():
    place = np.arange(1 << toxicity.BITS)
    number, feature = toxicity.present(["abcdabcdabcd", "abcd"], place, 1 << toxicity.BITS)
    assert len(set(zip(number.tolist(), feature.tolist()))) == len(number)
    assert set(feature[number == 1].tolist()) <= set(feature[number == 0].tolist())


def test_rising_curve():
    x = np.array([0, 0, 1, 2, 3, 4, 5, 6.0])
    y = np.array([0, 0, 1, 0, 0, 1, 1, 1.0])
    places, shares = learning.fit_rising(x, y)
    assert (np.diff(places) > 0).all() and (np.diff(shares) >= 0).all() and 0 < shares[0] < shares[-1] < 1


def held_out_hits(spark, sf_dir, name, label):
    got = QUERIES[name](spark, sf_dir)
    assert set(got.columns) == {"doc_id", "held_out", "score", "predicted"}
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows = got.join(labels, "doc_id").select("doc_id", "held_out", "score", "predicted", F.col(label).alias("label")).collect()
    parts, part = (4, 2) if label == "toxic" else (5, 0)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == part) for r in rows)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    hidden = [r for r in rows if r.held_out]
    return sum(r.predicted == r.label for r in hidden) / len(hidden)


@pytest.mark.parametrize("name, label, least", [("op1_toxicity", "toxic", 0.93), ("op5_quality", "quality", 0.92)])
def test_held_out_accuracy(spark, name, label, least):
    assert held_out_hits(spark, "/root/testdata/sf0.01", name, label) >= least


@pytest.mark.parametrize("part", [toxicity, quality])
def test_odd_rows_and_labels(spark, part):
    docs = spark.createDataFrame(
        [(i, "good plain words here " * 9 if i % 2 else "BAD!! ###$$$ idiot " * 9, "p") for i in range(60)]
        + [(100, None, "p"), (101, "", "p"), (101, "", "p"), (None, "x" * 300_000, "p")],
        "doc_id long, text string, score string",
    )
    labels = spark.createDataFrame(
        [(i, i % 2) for i in range(60)] + [(0, 0), (1, None), (None, 1), (100, 5)], "doc_id long, label int"
    )
    model = part.train(docs, labels, F.lit(True), label_col="label")
    got = part.score(docs.withColumnRenamed("score", "kept"), model).collect()
    assert len(got) == 64 and all(0 <= r.score <= 1 for r in got)
    by_id = {r.doc_id: r for r in got}
    assert by_id[1].score > by_id[0].score or part is toxicity and by_id[1].score != by_id[0].score
    nothing = part.train(docs, labels.limit(0), F.lit(True), label_col="label")
    assert {r.score for r in part.score(docs, nothing).collect()} == {0.5}
    assert part.score(docs.limit(0), model).count() == 0


def test_clean_rows_stay_whole(spark):
    docs = spark.createDataFrame([(1, "abcdef", "x"), (2, None, "y"), (None, "zzzz", None)], "doc_id long, text string, score string")
    weights = np.zeros(1 << toxicity.BITS, np.float32)
    for owner, bins in toxicity.hashed_ngrams(["zzzz"]):
        weights[bins] = 50
    model = toxicity.ToxicityModel(weights, -10.0)
    assert sorted(r.doc_id for r in toxicity.keep_clean(docs, model).collect()) == [1, 2]
