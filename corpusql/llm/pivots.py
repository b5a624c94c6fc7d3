"""Exact top-k by inner product with a pivot-distance index."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.llm.lattice import matrix
from corpusql.session import materialize

PIVOTS = 32
SAMPLE = 2048
RING_ROWS = 4096
QUERY_ROWS = 4096
STEP = 512
HITS = "query_id long, vec_id long, score long"


def finite(vector: Column) -> Column:
    """Not null and without null or non-finite components; the empty vector is one."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))


class Index:
    """Pivots of the vectors of one dimension, and the ring borders around each.

    The largest inner product is the nearest vector once every vector x has the extra
    coordinate sqrt(R2 - |x|2), where R2 is the largest squared length, and a query has zero there:
    then |q - x|2 = |q|2 + R2 - 2 q.x. Distances below are of that kind.
    """

    def __init__(self, sample: np.ndarray, square: float, rows: int, pivots: int, ring_rows: int) -> None:
        self.square = square
        points = self.lift(sample)
        chosen = [0]
        away = self._to(points, points[:1])[:, 0]
        while len(chosen) < min(pivots, len(points)) and away.max() > 0:
            chosen.append(int(away.argmax()))
            away = np.minimum(away, self._to(points, points[chosen[-1:]])[:, 0])
        self.pivots = points[chosen]
        near, distance = self.nearest(points)
        self.borders = []
        for p in range(len(self.pivots)):
            own = np.sort(distance[near == p])
            rings = max(1, round(len(own) / len(points) * rows / ring_rows))
            self.borders.append(np.unique(own[np.linspace(0, len(own) - 1, min(rings, len(own)) + 1).astype(int)[1:-1]]) if len(own) else own)

    @staticmethod
    def _to(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1) - 2 * (a @ b.T)
        return np.sqrt(np.maximum(squares, 0))

    def lift(self, x: np.ndarray) -> np.ndarray:
        rest = np.sqrt(np.maximum(self.square - (x * x).sum(axis=1), 0))
        return np.column_stack([x, rest])

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        every = self._to(points, self.pivots)
        near = every.argmin(axis=1)
        return near, every[np.arange(len(points)), near]

    def ring(self, near: np.ndarray, distance: np.ndarray) -> np.ndarray:
        out = np.zeros(len(near), np.int64)
        for p in np.unique(near):
            at = near == p
            out[at] = np.searchsorted(self.borders[p], distance[at], side="right")
        return out

    def query_distances(self, q: np.ndarray) -> np.ndarray:
        return self._to(np.column_stack([q, np.zeros(len(q))]), self.pivots)

    def best_score(self, q: np.ndarray, gap: np.ndarray) -> np.ndarray:
        """No vector at a distance of ``gap`` or more scores above this; rounding errors are allowed for."""
        whole = (q * q).sum(axis=1)[:, None] + self.square
        low = np.maximum(gap - 1e-6 * np.sqrt(whole) - 1e-6, 0)
        return (whole - low * low) / 2 + 1e-9 * whole


def top_rows(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best, ties to the smaller id."""
    if len(scores) > k:
        edge = np.partition(scores, len(scores) - k)[len(scores) - k]
        at = np.flatnonzero(scores >= edge)
        return at[np.lexsort((ids[at], -scores[at]))][:k]
    return np.lexsort((ids, -scores))


def products(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Whole inner products: by floating point where that is exact, else by 64-bit integers."""
    if not q.size or not x.size:
        return np.zeros((len(q), len(x)), np.int64)
    bound = q.shape[1] * float(np.abs(q).max()) * float(np.abs(x).max())
    if bound < 2**53:
        return (q.astype(np.float64) @ x.astype(np.float64).T).astype(np.int64)
    if bound < 2**63:
        return q @ x.T
    wide = q.astype(object) @ x.astype(object).T
    return np.clip(wide, -(2**63), 2**63 - 1).astype(np.int64)


def search_cell(
    index: Index, pivot: int, ids: np.ndarray, x: np.ndarray, r: np.ndarray,
    q_ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, step: int = STEP,
) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query number, places, scores) of the k best of one pivot's vectors ``x`` with distances ``r``.

    Vectors are sorted by distance to the pivot and cut into annuli. Each
    query takes them outward from its own distance, and stops once no vector
    of those left can reach the k-th score it has (at first ``floor``).
    """
    order = np.argsort(r, kind="stable")
    starts = np.arange(0, len(order), step)
    low, high = r[order[starts]], r[order[np.minimum(starts + step, len(order)) - 1]]
    own = index.query_distances(q.astype(np.float64))[:, [pivot]]
    gap = np.maximum(0, np.maximum(low[None] - own, own - high[None]))
    limit = index.best_score(q.astype(np.float64), gap)
    turn = np.argsort(gap, axis=1, kind="stable")
    found: list[tuple[np.ndarray, np.ndarray]] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * len(q)
    need = floor.astype(np.float64).copy()
    alive = np.ones(len(q), bool)
    for t in range(len(starts)):
        ring = turn[:, t]
        alive &= limit[np.arange(len(q)), ring] >= need
        if not alive.any():
            break
        for a in np.unique(ring[alive]):
            asked = np.flatnonzero(alive & (ring == a))
            part = order[starts[a] : starts[a] + step]
            scores = products(q[asked], x[part])
            for number, row in zip(asked, scores):
                fit = np.flatnonzero((row >= need[number]) & (ids[part] != q_ids[number]))
                if not len(fit):
                    continue
                places = np.concatenate([found[number][0], part[fit]])
                values = np.concatenate([found[number][1], row[fit]])
                best = top_rows(values, ids[places], k)
                found[number] = places[best], values[best]
                if len(best) == k:
                    need[number] = max(need[number], float(values[best[-1]]))
    for number, (places, values) in enumerate(found):
        if len(places):
            yield number, places, values


def top_k(
    vectors: DataFrame,
    queries: Column,
    k: int = 5,
    scale: int = 256,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    pivots: int = PIVOTS,
    sample_rows: int = SAMPLE,
    ring_rows: int = RING_ROWS,
    query_rows: int = QUERY_ROWS,
) -> DataFrame:
    """(query_id, rank, id, score) of the k largest inner products of whole vectors floor(scale * x).

    Queries are the rows for which ``queries`` holds; candidates are all rows but the query's own.
    Ties go to the smaller id. Vectors meet only vectors of their length. Vectors
    that are null or hold null or non-finite components and rows without an id take no part; of
    rows with one id the least vector counts. Scores beyond 64 bits stay at the border.

    Pivots and ring borders come from a bounded sample (``sample_rows``), then every vector gets its
    nearest pivot, its distance and its ring. A ring with more than ``ring_rows`` vectors (equal ones, say)
    is cut into several cells, and a cell that more than ``query_rows`` queries ask is copied once for about so many of them, so a task holds one bounded cell. First each
    query searches the cell nearest to it; its k-th score then rules out, by the triangle
    inequality, all other rings but those that could still hold a better vector.
    """
    spark = vectors.sparkSession
    clean = vectors.filter(F.col(id_col).isNotNull() & finite(F.col(vector_col)))
    one = clean.groupBy(F.col(id_col).cast("long").alias("id")).agg(
        F.min(F.transform(vector_col, lambda x: x.cast("double"))).alias("v")
    )
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    rows = materialize(
        one.select("id", whole.alias("v"), F.size("v").alias("d"), F.coalesce(queries, F.lit(False)).alias("asks")), "whole"
    )
    length = F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    sizes = rows.groupBy("d").agg(F.count("*").alias("n"), F.max(length).alias("square")).collect()
    if len(sizes) > 1000:
        raise ValueError("vectors of more than 1000 lengths")
    results = []
    for size in sorted(sizes, key=lambda r: r["d"]):
        d, n = size["d"], size["n"]
        same = rows.filter(F.col("d") == d)
        sample = same.orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("v").toArrow().column("v").combine_chunks()
        index = Index(matrix(sample, d) if d else np.zeros((len(sample), 0)), size["square"], n, pivots, ring_rows)
        results.append(_search(spark, same, index, d, k, ring_rows, query_rows))
    if not results:
        return spark.createDataFrame([], f"query_id long, rank int, {id_col} long, score long")
    hits = results[0]
    for more in results[1:]:
        hits = hits.union(more)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", "rank", F.col("vec_id").alias(id_col), "score")


def _search(spark, same: DataFrame, index: Index, d: int, k: int, ring_rows: int, query_rows: int) -> DataFrame:
    def whole(column: pa.Array) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), d)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near, distance = index.nearest(index.lift(whole(batch.column(1)).astype(np.float64)))
            columns = [batch.column(0), batch.column(1), pa.array(near.astype(np.int64)), pa.array(index.ring(near, distance)), pa.array(distance)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "v", "pivot", "ring", "r"])

    keyed = materialize(same.select("id", "v").mapInArrow(place, "id long, v array<long>, pivot long, ring long, r double"), "keyed")
    # At most as many rings as sampled vectors and pivots.
    rings = keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("r").alias("low"), F.max("r").alias("high")).collect()
    rings = sorted(rings, key=lambda r: (r["pivot"], r["ring"]))
    pivot = np.array([r["pivot"] for r in rings])
    low, high = (np.array([r[c] for r in rings]) for c in ("low", "high"))
    cells = np.array([-(-r["n"] // ring_rows) for r in rings])
    first = np.cumsum(cells) - cells
    asked = same.filter("asks").select("id", "v")
    directory = spark.createDataFrame(
        [(r["pivot"], r["ring"], int(a), int(c)) for r, a, c in zip(rings, first, cells)], "pivot long, ring long, first long, cells long"
    )
    base = keyed.join(F.broadcast(directory), ["pivot", "ring"]).select(
        (F.col("first") + F.pmod(F.xxhash64("id"), F.col("cells"))).alias("cell"), "id", "v", "r", "pivot"
    )

    def route(nearest_only: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole_batch in batches:
                for start in range(0, whole_batch.num_rows, 512):
                    batch = whole_batch.slice(start, 512)
                    q = whole(batch.column(1)).astype(np.float64)
                    own = index.query_distances(q)[:, pivot]
                    gap = np.maximum(0, np.maximum(low[None] - own, own - high[None]))
                    home = np.lexsort((own, gap), axis=1)[:, 0] if len(rings) > 1 else np.zeros(len(q), np.int64)
                    if nearest_only:
                        number, cell = np.arange(len(q)), first[home]
                    else:
                        floor = batch.column(2).to_numpy(zero_copy_only=False)
                        number, ring = np.nonzero(index.best_score(q, gap) >= floor[:, None])
                        number, ring, within = np.repeat(number, cells[ring]), np.repeat(ring, cells[ring]), np.concatenate(
                            [np.arange(c) for c in cells[ring]] or [np.zeros(0, np.int64)]
                        )
                        cell = first[ring] + within
                        other = cell != first[home[number]]
                        number, cell = number[other], cell[other]
                    out = batch.take(pa.array(number))
                    floors = out.column(2).cast(pa.float64()) if out.num_columns > 2 else pa.array(np.full(len(number), -np.inf))
                    yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int64)), out.column(0), floors], names=["cell", "id", "floor"])

        return run

    def look(table: pa.Table, ask: pa.Table) -> pa.Table:
        hits: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        if table.num_rows and ask.num_rows:
            ids = table.column("id").to_numpy()
            x = whole(table.column("v").combine_chunks())
            q_ids = ask.column("id").to_numpy()
            q = whole(ask.column("v").combine_chunks())
            at = table.column("pivot")[0].as_py()
            floor = ask.column("floor").to_numpy()
            for number, places, values in search_cell(index, at, ids, x, table.column("r").to_numpy(), q_ids, q, floor, k):
                hits.append((np.full(len(places), q_ids[number]), ids[places], values))
        columns = [np.concatenate(c) for c in zip(*hits)] if hits else [np.zeros(0, np.int64)] * 3
        return pa.table(dict(zip(["query_id", "vec_id", "score"], columns)))

    def ask(routed: DataFrame) -> DataFrame:
        # A cell is copied as often as its own queries need, and one that no query asks is not moved.
        routes = materialize(routed, "routes")
        load = routes.groupBy("cell").agg(F.ceil(F.count("*") / query_rows).alias("turns"))
        stored = base.join(load, "cell").withColumn("turn", F.explode(F.sequence(F.lit(0).cast("long"), F.col("turns") - 1))).drop("turns")
        cut = routes.join(load, "cell").join(asked, "id").withColumn("turn", F.pmod(F.xxhash64("id"), F.col("turns"))).drop("turns")
        return stored.groupBy("cell", "turn").cogroup(cut.groupBy("cell", "turn")).applyInArrow(look, HITS)

    shape = "cell long, id long, floor double"
    home = materialize(ask(asked.mapInArrow(route(True), shape)), "home-hits")
    floors = home.groupBy(F.col("query_id").alias("id")).agg(F.count("*").alias("n"), F.min("score").alias("least"))
    known = F.when(F.col("n") >= k, F.col("least").cast("double")).otherwise(F.lit(float("-inf")))
    second = asked.join(floors, "id", "left").select("id", "v", F.coalesce(known, F.lit(float("-inf"))).alias("floor"))
    return home.union(ask(second.mapInArrow(route(False), shape)))
