"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from corpusql.llm.common import map_texts, slices
from corpusql.llm.learning import fit_sparse, labelled_sample, sigmoid

BITS = 18
LENGTHS = (4, 5, 6)
MAX_FEATURES = 1 << 11
MAX_ROWS = 6000
THRESHOLD = 0.3


@dataclass(frozen=True)
class ToxicityModel:
    """A weight per hashed n-gram (zero for most) and the intercept."""

    weights: np.ndarray
    intercept: float


def hashed_ngrams(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(text number, bin) of each character n-gram of the lower-cased texts, one length at a time, repeats included."""
    lower = [text.lower() for text in texts]
    code = np.frombuffer("".join(lower).encode("utf-32-le", "surrogatepass"), np.uint32)
    owner = np.repeat(np.arange(len(lower), dtype=np.int32), [len(text) for text in lower])
    state = np.zeros(len(code), np.uint32)
    for n in range(1, max(LENGTHS) + 1):
        size = len(code) - n + 1
        if size <= 0:
            return
        state = (state[:size] ^ (code[n - 1 :] + np.uint32(n))) * np.uint32(0x9E3779B1)
        state ^= state >> np.uint32(15)
        if n in LENGTHS:
            bins = (state * np.uint32(0x85EBCA6B)) >> np.uint32(32 - BITS)
            yield np.where(owner[:size] == owner[n - 1 :], owner[:size], -1), bins


def present(texts: list[str], place: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(text number, feature) of the features that occur in each text, once each.

    ``place`` gives a bin's feature number, or -1; memory is one bit map of texts by features.
    """
    seen = np.zeros(len(texts) * width, bool)
    for owner, bins in hashed_ngrams(texts):
        feature = place[bins]
        keep = (feature >= 0) & (owner >= 0)
        seen[owner[keep].astype(np.int64) * width + feature[keep]] = True
    found = np.flatnonzero(seen)
    return found // width, found % width


def blocks(texts: list[str], width: int, cells: int = 1 << 24) -> Iterator[tuple[int, list[str]]]:
    step = max(1, cells // max(1, width))
    for start in range(0, len(texts), step):
        yield start, texts[start : start + step]


def train(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    label_col: str = "toxic",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    max_features: int = MAX_FEATURES,
    penalty: float = 2e-3,
) -> ToxicityModel:
    """Fit on a bounded sample of labelled documents (``max_rows``).

    Executors count in how many texts of either class each hashed n-gram occurs,
    one pair of arrays of fixed width per task. The bins whose counts differ most
    from chance (``max_features`` of them) are the features; a present feature has the log of
    the ratio of its smoothed class shares as value. The sparse rows of the
    sample, bounded by rows times features, are fitted on the driver. Without
    labels of both classes every text gets the share of label 1 (half if there are none).
    """
    sample = labelled_sample(docs, labels, label_col, allowed, max_rows, id_col, text_col).select("label", "text", "place")
    width = 1 << BITS
    everything = np.arange(width, dtype=np.int32)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros((2, width), np.int64)
        rows = np.zeros(2, np.int64)
        for batch in (part for whole in batches for part in slices(whole)):
            label = batch.column(0).to_numpy()
            for start, texts in blocks(batch.column(1).to_pylist(), width):
                number, feature = present(texts, everything, width)
                which = label[start + number]
                for value in (0, 1):
                    sums[value] += np.bincount(feature[which == value], minlength=width)
            rows += np.bincount(label, minlength=2)
        yield pa.RecordBatch.from_pydict({"sums": [sums.astype("<i4").tobytes()], "none": [int(rows[0])], "one": [int(rows[1])]})

    totals = np.zeros((2, width), np.int64)
    rows = np.zeros(2, np.int64)
    for row in sample.coalesce(8).mapInArrow(count, "sums binary, none long, one long").toLocalIterator():
        totals += np.frombuffer(row["sums"], "<i4").reshape(2, width)
        rows += (row["none"], row["one"])
    if not rows.all():
        share = 0.5 if not rows.sum() else float(np.clip(rows[1] / rows.sum(), 1e-3, 1 - 1e-3))
        return ToxicityModel(np.zeros(width, np.float32), float(np.log(share / (1 - share))))

    both = totals.sum(axis=0)
    share = rows[1] / rows.sum()
    surprise = (totals[1] - both * share) / np.sqrt(both * share * (1 - share) + 1)
    chosen = np.sort(np.argsort(-np.abs(surprise), kind="stable")[:max_features])
    ratio = np.log((totals[1, chosen] + 1) / (rows[1] + 2)) - np.log((totals[0, chosen] + 1) / (rows[0] + 2))
    place = np.full(width, -1, np.int32)
    place[chosen] = np.arange(len(chosen))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            label, order = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            for start, texts in blocks(batch.column(1).to_pylist(), len(chosen)):
                number, feature = present(texts, place, len(chosen))
                ends = np.searchsorted(number, np.arange(len(texts) + 1))
                packed = [feature[a:b].astype("<u4").tobytes() for a, b in zip(ends[:-1], ends[1:])]
                part = slice(start, start + len(texts))
                yield pa.RecordBatch.from_pydict({"place": order[part], "label": pa.array(label[part], pa.int32()), "bins": packed})

    rows_of = sample.mapInArrow(features, "place long, label int, bins binary")
    table = rows_of.orderBy("place", "label", "bins").toArrow()
    lists = [np.frombuffer(x, "<u4").astype(np.int64) for x in table.column("bins").to_pylist()]
    y = table.column("label").to_numpy().astype(np.float64)
    columns = np.concatenate(lists)
    numbers = np.repeat(np.arange(len(lists)), [len(x) for x in lists])
    weights, intercept = fit_sparse(numbers, columns, ratio[columns], y, len(chosen), penalty)
    out = np.zeros(width, np.float32)
    out[chosen] = weights * ratio
    return ToxicityModel(out, intercept)


def scorer(weights: np.ndarray, intercept: float) -> Callable[[list[str]], np.ndarray]:
    """Texts to probabilities of label 1."""
    used = np.flatnonzero(weights)
    place = np.full(len(weights), -1, np.int32)
    place[used] = np.arange(len(used))
    own = weights[used].astype(np.float64)

    def rate(texts: list[str]) -> np.ndarray:
        sums = np.full(len(texts), intercept)
        for start, part in blocks(texts, len(used)):
            number, feature = present(part, place, max(1, len(used)))
            sums[start : start + len(part)] += np.bincount(number, weights=own[feature], minlength=len(part))
        return sigmoid(sums)

    return rate


def score(
    docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, score, predicted) of every whole text, one pass without a shuffle.

    The score is the probability of label 1. Null and empty texts have no
    n-gram and score by the intercept. A repeated n-gram counts once, so a long
    text is not judged by its length. Repeated rows give repeated rows; columns other
    than id and text are not read.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))

    def work():
        rate = scorer(*shipped.value)

        def apply(texts: list[str]) -> list:
            probability = rate(texts)
            return [probability, (probability >= threshold).astype(np.int32)]

        return apply

    return map_texts(docs, id_col, text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], work)


def keep_clean(
    docs: DataFrame, model: ToxicityModel, text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """The rows of ``docs``, all columns, whose text scores below the threshold. No shuffle."""
    shipped = docs.sparkSession.sparkContext.broadcast((model.weights, model.intercept))
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = scorer(*shipped.value)
        for batch in (part for whole in batches for part in slices(whole, at)):
            texts = [text or "" for text in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(rate(texts) < threshold))

    return docs.mapInArrow(run, docs.schema)
