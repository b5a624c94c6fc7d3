"""Exact nearest vectors by cosine similarity, alone or next to a structured rank."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

MAX_QUERY_VALUES = 1 << 20
CELL_ROWS = 50_000
QUERIES_PER_CELL = 1024
DECIMALS = 6

HITS = "query_id string, id string, similarity double"


def _matrix(vectors: pd.Series) -> np.ndarray:
    rows = np.array([np.asarray(v, dtype=np.float64) for v in vectors])
    norms = np.linalg.norm(rows, axis=1, keepdims=True)
    return np.divide(rows, norms, out=np.zeros_like(rows), where=norms > 0)


def _best(ids: np.ndarray, vectors: np.ndarray, names: Sequence[str], queries: np.ndarray, k: int) -> pd.DataFrame:
    """The k best rows per query of one block. Ties at the edge are all kept."""
    scores = np.round(queries @ vectors.T, DECIMALS)
    out = []
    for name, row in zip(names, scores):
        if len(row) > k:
            edge = np.partition(row, len(row) - k)[len(row) - k]
            picked = np.flatnonzero(row >= edge)
            # Of equal scores the smallest ids stay, as in the final ranking.
            order = np.lexsort((ids[picked], -row[picked]))[:k]
            picked = picked[order]
        else:
            picked = np.arange(len(row))
        out.append(pd.DataFrame({"query_id": name, "id": ids[picked], "similarity": row[picked]}))
    return pd.concat(out, ignore_index=True)


def _columns(df: DataFrame, id_col: str, vector_col: str, id_name: str) -> DataFrame:
    return df.select(
        F.col(id_col).cast("string").alias(id_name), F.col(vector_col).alias("vector")
    ).filter(F.col("vector").isNotNull())


def vector_topk(
    vectors: DataFrame,
    queries: DataFrame,
    k: int,
    id_col: str = "id",
    vector_col: str = "embedding",
    query_id_col: str = "query_id",
    query_col: str = "embedding",
) -> DataFrame:
    """(query_id, id, similarity, rank) of the ``k`` most similar vectors per query.

    Similarity is rounded to six digits and ties go to the smaller id (as text),
    so a result does not depend on how rows are spread.

    A few queries (a bounded number of values, checked) go to every task; each
    Arrow batch is one matrix product and hands on at most ``k`` rows per query.
    With more queries both sides are cut into cells of bounded size, see
    ``_cells``. Neither way forms query-vector pairs as rows.
    """
    rows = _columns(vectors, id_col, vector_col, "id")
    asked = _columns(queries, query_id_col, query_col, "query_id")
    size = asked.agg(F.coalesce(F.sum(F.size("vector")), F.lit(0))).first()[0]
    if size == 0:
        hits = vectors.sparkSession.createDataFrame([], HITS)
    elif size <= MAX_QUERY_VALUES:
        hits = _shipped(rows, asked, k)
    else:
        hits = _cells(rows, asked, k)
    order = W.partitionBy("query_id").orderBy(F.desc("similarity"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _shipped(rows: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    few = asked.toPandas()
    names, matrix = few["query_id"].tolist(), _matrix(few["vector"])

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # The best of all batches so far: a task hands on at most k rows per query.
        held: pd.DataFrame | None = None
        for batch in batches:
            if not len(batch):
                continue
            new = _best(batch["id"].to_numpy(), _matrix(batch["vector"]), names, matrix, k)
            both = new if held is None else pd.concat([held, new], ignore_index=True)
            ranked = both.sort_values(["similarity", "id"], ascending=[False, True], kind="stable")
            held = ranked.groupby("query_id", sort=False).head(k)
        if held is not None:
            yield held

    return rows.mapInPandas(search, HITS)


def _cells(
    rows: DataFrame, asked: DataFrame, k: int,
    cell_rows: int = CELL_ROWS, queries_per_cell: int = QUERIES_PER_CELL,
) -> DataFrame:
    """Grid of (row block, query block) cells, each a bounded matrix product.

    Blocks are chosen by hash of the id; a vector goes once to each query block
    and a query once to each row block.
    """
    n_rows = max(1, -(-rows.count() // cell_rows))
    n_cols = max(1, -(-asked.count() // queries_per_cell))

    def block(column: str, n: int) -> Column:
        return F.pmod(F.xxhash64(column), F.lit(n)).cast("int")

    left = rows.select(
        "*", block("id", n_rows).alias("r"), F.explode(F.sequence(F.lit(0), F.lit(n_cols - 1))).alias("c")
    )
    right = asked.select(
        "*", block("query_id", n_cols).alias("c"),
        F.explode(F.sequence(F.lit(0), F.lit(n_rows - 1))).alias("r"),
    )

    def search(vectors: pd.DataFrame, queries: pd.DataFrame) -> pd.DataFrame:
        if not len(vectors) or not len(queries):
            return pd.DataFrame({"query_id": [], "id": [], "similarity": []})
        return _best(
            vectors["id"].to_numpy(), _matrix(vectors["vector"]),
            queries["query_id"].tolist(), _matrix(queries["vector"]), k,
        )

    return left.groupBy("r", "c").cogroup(right.groupBy("r", "c")).applyInPandas(search, HITS)


def limit_to(vectors: DataFrame, allowed: DataFrame, on: str) -> DataFrame:
    """Vectors of the documents a structured filter keeps; only ids are shuffled from ``allowed``."""
    return vectors.join(allowed.select(on).distinct(), on, "left_semi")


def hybrid_rank(hits: DataFrame, scored: DataFrame, weight: float = 0.5, n: int = 10) -> DataFrame:
    """Merge similarity with a score in [0, 1]: ``scored`` has (id, score), or (query_id, id, score) where it differs by query."""
    keys = ["query_id", "id"] if "query_id" in scored.columns else ["id"]
    merged = hits.join(scored.select(*[F.col(c).cast("string") for c in keys], "score"), keys, "inner")
    total = F.round(F.col("similarity") * weight + F.col("score") * (1 - weight), DECIMALS + 2)
    order = W.partitionBy("query_id").orderBy(F.desc("total"), "id")
    return (
        merged.withColumn("total", total)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
    )


def rerank(
    hits: DataFrame, vectors: DataFrame, queries: DataFrame, n: int = 10, weight: float = 0.5, half: float = 10.0,
    id_col: str = "id", vector_col: str = "embedding",
) -> DataFrame:
    """Hits of a word search (query_id, id, score) in the order of words and vectors together.

    A word score has no upper bound; ``score / (score + half)`` maps it to 0 to 1. Only the vectors of hits are read
    on; hits without a vector, or with one of other length, go.
    """
    own = _columns(vectors, id_col, vector_col, "id")
    asked = queries.select(F.col("query_id").cast("string"), F.col(vector_col).alias("asked")).filter(F.col("asked").isNotNull())
    pairs = hits.join(asked, "query_id").join(own, "id").filter(F.size("asked") == F.size("vector"))

    def dot(a: str, b: str) -> Column:
        products = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
        return F.aggregate(products, F.lit(0.0), lambda s, p: s + p)

    length = F.sqrt(dot("asked", "asked")) * F.sqrt(dot("vector", "vector"))
    similar = F.round(F.when(length > 0, dot("asked", "vector") / length).otherwise(0.0), DECIMALS)
    both = pairs.select("query_id", "id", similar.alias("similarity"))
    return hybrid_rank(both, hits.select("query_id", "id", (F.col("score") / (F.col("score") + half)).alias("score")), weight, n)
