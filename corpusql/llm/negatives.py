"""Hard negatives: scores bounded by means and deviations of vector segments, halved until the exact product is worth it."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.llm.pivots import finite, products
from corpusql.operators.ranks import numbered
from corpusql.session import materialize

CELL_ROWS = 4096
TURN_ROWS = 2048
LEAF = 4
CHUNK = 1024
GROUP = 64
HITS = "anchor_row long, place int, anchor_id long, vec_id long, score long, aim long"


def summaries(x: np.ndarray, leaf: int = LEAF) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, deviations, widths) of the segments of ``leaf`` dimensions. The deviation is the length of what is left of the segment without its mean."""
    d = x.shape[1]
    starts = np.arange(0, d, leaf)
    widths = np.diff(np.append(starts, d)).astype(float)
    if not d:
        return np.zeros((len(x), 0)), np.zeros((len(x), 0)), widths
    means = np.add.reduceat(x, starts, axis=1) / widths
    rest = x - np.repeat(means, widths.astype(int), axis=1)
    return means, np.sqrt(np.add.reduceat(rest * rest, starts, axis=1)), widths


def pyramid(means: np.ndarray, devs: np.ndarray, widths: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels from one segment down to the leaves: (means times the root of the width, deviations).

    A pair of segments becomes one: its mean is the weighted mean, and its squared deviation
    holds those of both and what their means lie apart. With these weights a score is the product of the first parts, give or
    take the product of the second (the inner product of the rests is at most that of their lengths).
    """
    levels = [(means * np.sqrt(widths), devs)]
    while len(widths) > 1:
        starts = np.arange(0, len(widths), 2)
        total = np.add.reduceat(widths, starts)
        joint = np.add.reduceat(means * widths, starts, axis=1) / total
        apart = means - np.repeat(joint, np.diff(np.append(starts, len(widths))), axis=1)
        devs = np.sqrt(np.add.reduceat(devs * devs + widths * apart * apart, starts, axis=1))
        means, widths = joint, total
        levels.append((means * np.sqrt(widths), devs))
    return levels[::-1]


class Aims:
    """What is still sought for one anchor: several score ranges, the ``k`` first of each, by falling score and rising id."""

    def __init__(self, low: list[int], high: list[int], k: int) -> None:
        self.k, self.low, self.high = k, list(low), high
        self.need = np.array(low, float)  # low, for bounds, which have room for its rounding
        self.top = np.array(high, float)
        empty = np.zeros(0, np.int64)
        self.found = [(empty, empty) for _ in low]

    def wanted(self, lower: np.ndarray, upper: np.ndarray) -> np.ndarray:
        """Rows that may still count in one of the ranges."""
        out = np.zeros(len(lower), bool)
        for need, top in zip(self.need, self.top):
            out |= (upper >= need) & (lower <= top)
        return out

    def add(self, ids: np.ndarray, scores: np.ndarray) -> None:
        for a, (low, high) in enumerate(zip(self.low, self.high)):
            fit = (scores >= low) & (scores <= high)
            if fit.any():
                every, values = np.append(self.found[a][0], ids[fit]), np.append(self.found[a][1], scores[fit])
                best = np.lexsort((every, -values))[: self.k]
                self.found[a] = every[best], values[best]
                if len(best) == self.k:
                    self.low[a] = int(values[best[-1]])
                    self.need[a] = float(self.low[a])


def search(ids: np.ndarray, x: np.ndarray, levels: list, anchors: np.ndarray, anchor_levels: list, fit: np.ndarray, aims: list[Aims]) -> None:
    """Fill ``aims``, one per anchor, from the rows of one cell. ``fit`` (anchors by rows) says which may be used at all.

    Whole-vector summaries bound a chunk of rows for many anchors at once. Rows whose bounds leave a range open are bounded again by
    the halves of their segments, down to the leaves; only what is left then gets its exact score.
    """
    for first in range(0, len(ids), CHUNK):
        rows = slice(first, first + CHUNK)
        mean, dev = (part[rows] for part in levels[0])
        middle, spread = anchor_levels[0][0] @ mean.T, anchor_levels[0][1] @ dev.T
        slack = 1e-9 * (np.abs(middle) + spread) + 1e-6
        for a, aim in enumerate(aims):
            left = np.flatnonzero(fit[a, rows])
            left = left[aim.wanted(middle[a, left] - spread[a, left] - slack[a, left], middle[a, left] + spread[a, left] + slack[a, left])] + first
            for (means, devs), (mean_a, dev_a) in zip(levels[1:], anchor_levels[1:]):
                if not len(left):
                    break
                near, far = means[left] @ mean_a[a], devs[left] @ dev_a[a]
                room = 1e-9 * (np.abs(near) + far) + 1e-6
                left = left[aim.wanted(near - far - room, near + far + room)]
            if len(left):
                aim.add(ids[left], products(anchors[a : a + 1], x[left])[0])


def mine(
    vectors: DataFrame,
    anchors: Column,
    n_positives: int = 5,
    n_negatives: int = 10,
    percent: tuple[int, int] = (30, 90),
    scale: int = 256,
    label: Column | None = None,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    label_col: str = "label",
    cell_rows: int = CELL_ROWS,
    turn_rows: int = TURN_ROWS,
) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score).

    Vectors become floor(scale * x); a score is the whole inner product with the anchor, and higher scores come first, ties by
    smaller id. Anchors are rows for which ``anchors`` holds. An anchor's positives are its first
    ``n_positives`` other rows of its label, its negatives for one of them the first ``n_negatives`` rows of other labels whose score is
    between the two ``percent`` of the positive's score (as integers, both ends included; for a negative positive score no number is).
    ``label`` computes the label in place of ``label_col``. Rows with a null id, label or vector or with
    null or non-finite components take no part. Vectors meet only vectors of their length. Rows
    that repeat an id are rows of their own: as candidates, and as anchors, whose answers then repeat. Scores beyond 64 bits stay at the border.

    Rows are numbered by length and label and cut into cells of ``cell_rows`` neighbours, stored with the means and deviations
    of their smallest segments. Positives only ask cells that hold the anchor's label, negatives all cells with another one. Anchors
    meet a cell in turns of about ``turn_rows``; a cell is copied only to turns that ask it. Each cell returns the first
    few of each anchor, which windows merge.
    """
    value = F.coalesce(label, F.lit(None)) if label is not None else F.col(label_col)
    rows = vectors.select(
        F.col(id_col).cast("long").alias("id"), value.cast("string").alias("label"), F.col(vector_col).alias("raw"), F.coalesce(anchors, F.lit(False)).alias("asks")
    ).filter(F.col("id").isNotNull() & F.col("label").isNotNull() & finite(F.col("raw")))
    whole = F.transform("raw", lambda x: F.floor(x.cast("double") * scale).cast("long"))
    stored = materialize(rows.select("id", "label", whole.alias("v"), F.size("raw").alias("d"), "asks"), "whole")
    placed = numbered(stored.withColumn("all", F.lit("")), "all", [F.col("d"), F.col("label"), F.col("id")], "row", "total")
    cells = materialize(
        placed.withColumn("cell", F.expr(f"row div {cell_rows}")).drop("all", "total").mapInArrow(
            _summarised, "id long, label string, v array<long>, d int, asks boolean, row long, cell long, means array<double>, devs array<double>"
        ), "cells",
    )
    asked = cells.filter("asks").drop("asks", "means", "devs")
    turns = max(1, -(-asked.count() // turn_rows))
    asked = asked.withColumn("turn", F.pmod(F.xxhash64("row"), F.lit(turns)))
    # Cells with what they hold; a cell's rows are neighbours, so labels and lengths are few but at borders.
    held = materialize(cells.groupBy("cell", "d", "label").agg(F.count("*").alias("n")), "held")
    groups = held.groupBy("d", "cell").agg(F.min("label").alias("low"), F.max("label").alias("high"))

    own = asked.join(held.select("d", "label", F.col("cell").alias("ask")), ["d", "label"])
    own = own.select("ask", "turn", "row", "id", "label", "v", F.array(F.lit(None).cast("long")).alias("aims"))
    hits = materialize(_ask(cells, own, True, n_positives, percent), "same-label")
    order = W.partitionBy("anchor_row").orderBy(F.desc("score"), "vec_id")
    positives = materialize(hits.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n_positives), "positives")

    aims = positives.groupBy(F.col("anchor_row").alias("row")).agg(F.sort_array(F.collect_list(F.struct("place", "score"))).alias("aims"))
    aimed = asked.join(aims.select("row", F.col("aims.score").alias("aims")), "row")
    # All cells of a length, as ranges of numbers: every anchor asks each but those of its own label alone.
    spans = held.groupBy("d").agg(F.min("cell").alias("from_cell"), F.max("cell").alias("to_cell"))
    every = aimed.join(spans, "d").withColumn("ask", F.explode(F.sequence("from_cell", "to_cell")))
    single = groups.filter("low = high").select("d", F.col("cell").alias("ask"), F.col("low").alias("label"))
    other = every.join(single, ["d", "ask", "label"], "left_anti").select("ask", "turn", "row", "id", "label", "v", "aims")
    found = _ask(cells, other, False, n_negatives, percent)
    best = W.partitionBy("anchor_row", "place").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= n_negatives)
    chosen = positives.select("anchor_row", "place", F.col("vec_id").alias("positive_id"))
    return ranked.join(chosen, ["anchor_row", "place"]).select(
        "anchor_id", "positive_id", "rank", F.col("vec_id").alias("negative_id"), F.col("aim").alias("positive_score"),
        F.col("score").alias("negative_score"),
    )


def _matrix(column: pa.ChunkedArray | pa.Array, d: int) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)


def _summarised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sizes = batch.column("d").to_numpy()
        means, devs = np.empty(len(sizes), object), np.empty(len(sizes), object)
        for d in np.unique(sizes):
            at = np.flatnonzero(sizes == d)
            m, s, _ = summaries(_matrix(batch.column("v").take(pa.array(at)), d).astype(float))
            for i, a, b in zip(at, m, s):
                means[i], devs[i] = a, b
        kind = pa.list_(pa.float64())
        columns = [batch.column(c) for c in ("id", "label", "v", "d", "asks", "row", "cell")]
        yield pa.RecordBatch.from_arrays(
            [*columns, pa.array(list(means), kind), pa.array(list(devs), kind)],
            names=["id", "label", "v", "d", "asks", "row", "cell", "means", "devs"],
        )


def _ask(cells: DataFrame, asked: DataFrame, same: bool, k: int, percent: tuple[int, int]) -> DataFrame:
    """HITS of the anchors in the cells they ask, for rows of the same label or of others."""
    asked = materialize(asked, "asked")
    pairs = asked.select(F.col("ask").alias("cell"), F.col("turn").alias("copy")).distinct()
    copies = cells.drop("asks").join(pairs, "cell")
    asking = asked.select(F.col("ask").alias("a_cell"), F.col("turn").alias("a_turn"), "row", "id", "label", "v", "aims")

    def look(rows: pa.Table, wanted: pa.Table) -> pa.Table:
        out: list[list] = [[] for _ in range(6)]
        for d in np.unique(rows.column("d").to_numpy()) if wanted.num_rows and rows.num_rows else ():
            mine = rows.filter(pa.array(rows.column("d").to_numpy() == d))
            theirs = wanted.filter(pa.array(pc.list_value_length(wanted.column("v")).to_numpy() == d))
            if not theirs.num_rows:
                continue
            order = np.argsort(mine.column("row").to_numpy())
            mine = mine.take(pa.array(order))
            ids, x, labels, numbers = mine.column("id").to_numpy(), _matrix(mine.column("v"), d), np.array(mine.column("label").to_pylist(), object), mine.column("row").to_numpy()
            widths = summaries(np.zeros((0, d)))[2]
            levels = pyramid(_matrix(mine.column("means"), len(widths)), _matrix(mine.column("devs"), len(widths)), widths)
            for start in range(0, theirs.num_rows, GROUP):
                part = theirs.slice(start, GROUP)
                v = _matrix(part.column("v"), d)
                own_levels = pyramid(*summaries(v.astype(float)))
                own_labels, own_rows = np.array(part.column("label").to_pylist(), object), part.column("row").to_numpy()
                fit = (labels[None] == own_labels[:, None]) == same
                fit &= numbers[None] != own_rows[:, None]
                goals = part.column("aims").to_pylist()
                if same:
                    sought = [Aims([-(2**63)], [2**63 - 1], k) for _ in goals]
                else:
                    sought = [Aims([-(-percent[0] * p // 100) for p in g], [percent[1] * p // 100 for p in g], k) for g in goals]
                search(ids, x, levels, v, own_levels, fit, sought)
                for number, own_id, goal, aim in zip(own_rows, part.column("id").to_pylist(), goals, sought):
                    for place, (target, (hit, score)) in enumerate(zip(goal, aim.found), 1):
                        for column, values in zip(out, ([int(number)] * len(hit), [place] * len(hit), [own_id] * len(hit), hit, score, [target] * len(hit))):
                            column.extend(values)
        kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]
        return pa.table({n: pa.array(c, t) for n, c, t in zip(["anchor_row", "place", "anchor_id", "vec_id", "score", "aim"], out, kinds)})

    return copies.groupBy("cell", "copy").cogroup(asking.groupBy("a_cell", "a_turn")).applyInArrow(look, HITS)
