"""Labelled samples, and logistic models on sparse and on single features."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.session import materialize


def held_out(id_col: str, parts: int, part: int) -> Column:
    """Whether the crc32 of the id as text falls into the part that learning must not see. Null ids do."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % parts == part, F.lit(True))


def labelled_sample(
    docs: DataFrame,
    labels: DataFrame,
    label_col: str,
    allowed: Column,
    max_rows: int,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(text, label, place) of at most ``max_rows`` labelled documents, written to the shared folder.

    The ids come first in hash order; only they, ``max_rows`` at most, are sent to
    the scan of the texts. ``place`` is the hash, so that callers can cut the
    sample in a repeatable way. An id with several labels counts as 1 if any is;
    null labels and labels but 0 and 1 are no labels; of several texts
    with one id the least in byte order counts.
    """
    value = F.col(label_col).cast("int")
    few = (
        labels.filter(value.isin(0, 1) & F.col(id_col).isNotNull() & allowed)
        .groupBy(F.col(id_col).alias("_id"))
        .agg(F.max(value).alias("label"))
        .withColumn("place", F.xxhash64(F.col("_id").cast("string"), F.lit("sample")))
        .orderBy("place", "_id")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    found = texts.join(F.broadcast(few), "_id").groupBy("_id", "label", "place").agg(F.min("text").alias("text"))
    return materialize(found.select("text", "label", "place"), "sample")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -500, 500)))


def fit_sparse(
    rows: np.ndarray, columns: np.ndarray, values: np.ndarray, y: np.ndarray, width: int,
    penalty: float, passes: int = 120, rate: float = 0.03,
) -> tuple[np.ndarray, float]:
    """Logistic weights and intercept by full gradient steps with adaptive rates. The same input gives the same weights."""
    n = max(1, len(y))
    share = (y.sum() + 0.5) / (n + 1)
    w, m, v = (np.zeros(width + 1) for _ in range(3))
    w[-1] = np.log(share / (1 - share))
    for step in range(1, passes + 1):
        score = np.bincount(rows, weights=values * w[columns], minlength=len(y)) + w[-1]
        error = sigmoid(score) - y
        slope = np.append(np.bincount(columns, weights=error[rows] * values, minlength=width), error.sum()) / n
        slope[:-1] += penalty * w[:-1]
        m = 0.9 * m + 0.1 * slope
        v = 0.999 * v + 0.001 * slope * slope
        w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return w[:-1], float(w[-1])


def fit_rising(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Calibration curve: places and the share of label 1 there, never falling (pooled neighbours), for interpolation.

    Equal values count as one place. Each pool's share is smoothed by half a row of either
    label, so no share is 0 or 1.
    """
    if not len(y):
        return np.zeros(1), np.full(1, 0.5)
    places, which = np.unique(x, return_inverse=True)
    ones = np.bincount(which, weights=y, minlength=len(places))
    rows = np.bincount(which, minlength=len(places)).astype(float)
    pools: list[list[float]] = []  # ones, rows, weighted place
    for one, n, place in zip(ones, rows, places):
        pools.append([one, n, place * n])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            last = pools.pop()
            pools[-1] = [a + b for a, b in zip(pools[-1], last)]
    found = np.array(pools)
    return found[:, 2] / found[:, 1], np.maximum.accumulate((found[:, 0] + 0.5) / (found[:, 1] + 1))
