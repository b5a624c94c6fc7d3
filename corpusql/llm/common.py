"""What several operators of this subpackage share: batches of texts, runs of equal keys, components."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusql.session import materialize

SLICE_BYTES = 4 << 20


def schema_with_id(df: DataFrame, id_col: str, fields: list[tuple[str, T.DataType]]) -> T.StructType:
    """The id column under its own name and type, then the given fields."""
    if id_col in [name for name, _ in fields]:
        raise ValueError(f"the id column {id_col!r} has the name of a result column")
    kind = df.schema[id_col].dataType
    return T.StructType([T.StructField(id_col, kind), *[T.StructField(n, t) for n, t in fields]])


def slices(batch: pa.RecordBatch, column: int = 1, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each piece holds about ``limit`` bytes of the column, one row at least."""
    if not batch.num_rows:
        return
    sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
    ends = np.cumsum(sizes.astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, side="right")))
        yield batch.slice(start, stop - start)
        start = stop


def map_texts(
    df: DataFrame,
    id_col: str,
    text_col: str,
    fields: list[tuple[str, T.DataType]],
    work: Callable[[], Callable[[list[str]], list]],
) -> DataFrame:
    """Whole texts to result columns, next to the id.

    ``work`` is called once per task and returns the function that turns a list
    of texts (null: empty) into one list or array per field.
    """
    schema = schema_with_id(df, id_col, fields)
    kinds = list(to_arrow_schema(schema))[1:]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        apply = work()
        for whole in batches:
            for batch in slices(whole):
                texts = pc.fill_null(batch.column(1), "").to_pylist()
                columns = [batch.column(0), *[pa.array(x, kind.type) for x, kind in zip(apply(texts), kinds)]]
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def runs_of(
    batches: Iterator[pa.RecordBatch], key: str, at_least: int, sized: str | None = None
) -> Iterator[pa.Table]:
    """Tables of whole key groups from batches sorted by ``key``, ``at_least`` rows each but for the last.

    With ``sized``, the name of a text or binary column, ``at_least`` counts its bytes. A task holds one
    such table plus the largest group.
    """
    held: list[pa.RecordBatch] = []
    rows = 0

    def weight(part: pa.RecordBatch) -> int:
        return pc.sum(pc.binary_length(part.column(sized))).as_py() or 0 if sized else part.num_rows

    def pieces() -> Iterator[pa.RecordBatch]:
        for whole in batches:
            if sized and whole.num_rows:
                yield from slices(whole, whole.schema.get_field_index(sized), max(1, at_least // 4))
            elif whole.num_rows:
                yield whole

    for batch in pieces():
        if rows >= at_least:
            keys = batch.column(key)
            last = held[-1].column(key)[-1].as_py()
            same = pc.index(pc.not_equal(keys, pa.scalar(last, keys.type)), True).as_py()
            if same < 0:
                held.append(batch)
                rows += weight(batch)
                continue
            yield pa.Table.from_batches([*held, batch.slice(0, same)] if same else held)
            held, rows = [], 0
            batch = batch.slice(same)
        held.append(batch)
        rows += weight(batch)
    if held:
        yield pa.Table.from_batches(held)


def components(edges: DataFrame, a: str = "a", b: str = "b", max_rounds: int = 60) -> DataFrame:
    """(id, component): the smallest id reachable over the edges. Ids without edges have no row.

    Alternating large and small stars: each round hangs neighbours on the least
    of them, by aggregates and joins alone; the edges of a round are a table in
    the shared folder. Ends when a round changes nothing.
    """
    now = materialize(
        edges.select(F.least(a, b).alias("v"), F.greatest(a, b).alias("u")).filter("u <> v").distinct(), "edges"
    )
    mark = None
    for _ in range(max_rounds):
        both = now.union(now.select("u", "v")).toDF("v", "u")
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.filter("v > u").join(least, "u").select(F.col("m").alias("v"), F.col("v").alias("u")).filter("u <> v")
        large = large.distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        joined = large.join(low, "u")
        small = joined.select(F.col("m").alias("v"), F.col("v").alias("u")).union(joined.select("m", "u"))
        now = materialize(small.filter("u <> v").distinct(), "edges")
        row = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(row) == mark:
            break
        mark = tuple(row)
    else:
        raise RuntimeError("components did not settle")
    found = now.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "id")
    roots = now.select(F.col("v").alias("id")).distinct().select("id", F.col("id").alias("component"))
    return found.union(roots)
