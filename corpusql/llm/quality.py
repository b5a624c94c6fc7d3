"""Quality: how much better a text compresses with a dictionary of good texts than with one of bad texts."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.llm.common import map_texts
from corpusql.llm.learning import fit_rising, labelled_sample

MAX_ROWS = 8000
CLASS_BYTES = 8 << 20
DICTIONARY_BYTES = 110 << 10
BLOCK_BYTES = 2048
LEVEL = 3
THRESHOLD = 0.3


@dataclass(frozen=True)
class QualityModel:
    """Two dictionaries (empty: none), and the calibration curve over the difference."""

    good: bytes
    bad: bytes
    places: np.ndarray
    shares: np.ndarray


def _pieces(text: str) -> list[bytes]:
    raw = text.encode("utf-8")
    return [raw[i : i + BLOCK_BYTES] for i in range(0, len(raw), BLOCK_BYTES)]


def _compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    plain = {"write_content_size": False, "write_checksum": False, "write_dict_id": False}
    if not dictionary:
        return zstandard.ZstdCompressor(level=LEVEL, **plain)
    data = zstandard.ZstdCompressionDict(dictionary)
    data.precompute_compress(level=LEVEL)
    return zstandard.ZstdCompressor(level=LEVEL, dict_data=data, **plain)


class Differ:
    """The normalised difference: bytes saved by the good dictionary over the bad one, per byte of text.

    A text is compressed in blocks of fixed size, so what a long text says early
    does not hide the dictionaries' part in what follows.
    """

    def __init__(self, good: bytes, bad: bytes) -> None:
        self.good, self.bad = _compressor(good), _compressor(bad)

    def __call__(self, text: str) -> float:
        blocks = _pieces(text)
        saved = sum(len(self.bad.compress(b)) - len(self.good.compress(b)) for b in blocks)
        return saved / max(1, sum(map(len, blocks)))


def _dictionary(blocks: list[bytes]) -> bytes:
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, blocks).as_bytes() if len(blocks) >= 8 else b"".join(blocks)
    except zstandard.ZstdError:  # too little text to train on: the text itself is the dictionary
        return b"".join(blocks)[:DICTIONARY_BYTES]


def train(
    docs: DataFrame,
    labels: DataFrame,
    allowed: Column,
    label_col: str = "quality",
    id_col: str = "doc_id",
    text_col: str = "text",
    max_rows: int = MAX_ROWS,
    class_bytes: int = CLASS_BYTES,
) -> QualityModel:
    """Fit on a bounded sample of labelled documents (``max_rows``).

    One half gives the dictionaries: up to ``class_bytes`` of blocks per class in
    hash order, in one task. The other half, unseen by them, gives the curve from
    difference to share of good texts. Without labels of both classes both
    dictionaries are empty or one-sided and the curve is the share of label 1.
    """
    sample = labelled_sample(docs, labels, label_col, allowed, max_rows, id_col, text_col)
    half = F.pmod(F.xxhash64("place"), F.lit(2)) == 0

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks: dict[int, list[bytes]] = {0: [], 1: []}
        held = {0: 0, 1: 0}
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for block in _pieces(text):
                    if held[label] + len(block) <= class_bytes:
                        blocks[label].append(block)
                        held[label] += len(block)
        made = [_dictionary(blocks[label]) for label in (0, 1)]
        yield pa.RecordBatch.from_pydict({"label": pa.array([0, 1], pa.int32()), "dictionary": made})

    ordered = sample.filter(half).select("label", "text", "place").orderBy("place").coalesce(1)
    found = {r["label"]: bytes(r["dictionary"]) for r in ordered.mapInArrow(build, "label int, dictionary binary").collect()}
    good, bad = found.get(1, b""), found.get(0, b"")
    if not good or not bad:
        good = bad = b""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        differ = Differ(good, bad)
        for batch in batches:
            values = [differ(text) for text in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values, pa.float64())], names=["label", "x"])

    rows = sample.filter(~half).select("label", "text").mapInArrow(measure, "label int, x double").collect()
    rows.sort(key=lambda r: (r["x"], r["label"]))
    places, shares = fit_rising(np.array([r["x"] for r in rows]), np.array([r["label"] for r in rows], dtype=float))
    return QualityModel(good, bad, places, shares)


def score(
    docs: DataFrame, model: QualityModel, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD
) -> DataFrame:
    """(id, score, predicted) of every whole text, one pass without a shuffle.

    Null and empty texts have a difference of zero and score as such. Repeated
    rows give repeated rows; columns other than id and text are not read. What
    is sent to executors is two dictionaries and a curve of at most ``max_rows`` places.
    """
    shipped = docs.sparkSession.sparkContext.broadcast((model.good, model.bad, model.places, model.shares))

    def work():
        good, bad, places, shares = shipped.value
        differ = Differ(good, bad)

        def apply(texts: list[str]) -> list:
            values = np.interp([differ(text) for text in texts], places, shares)
            return [values, (values >= threshold).astype(np.int32)]

        return apply

    return map_texts(docs, id_col, text_col, [("score", T.DoubleType()), ("predicted", T.IntegerType())], work)
