"""Row numbers within keys, by range partitions instead of one window per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.session import materialize

SMALL_PART = 20_000
LARGE_PART = 2_000_000


def numbered(stored: DataFrame, key: str, order: Sequence[Column], name: str, count: str) -> DataFrame:
    """``stored`` (a written table) with ``name``, the row's number from 0 within ``key`` by ``order``, and ``count``, the key's rows.

    Rows are dealt to ranges of (key, order, row), each range is sorted and written; the numbers inside it
    then need only the rows of the same key in earlier ranges, which is a sum over as many
    rows as there are ranges and keys. A key with most of the rows is spread over many ranges, and so are
    equal rows: the number they have in ``stored`` comes last in the order. ``key`` must not be null.
    """
    rows = stored.count()
    cores = stored.sparkSession.sparkContext.defaultParallelism
    parts = max(1, min(-(-rows // SMALL_PART), max(cores, -(-rows // LARGE_PART))))
    by = [F.col(key), *order, F.col("_row")]
    ranges = stored.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *by).sortWithinPartitions(*by)
    inside = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    placed = materialize(ranges.withColumn("_part", F.spark_partition_id()).withColumn("_inside", inside).drop("_row"), "ranges")
    sums = placed.groupBy(key, "_part").agg(F.min("_inside").alias("_first"), F.count("*").alias("_rows"))
    whole = W.partitionBy(key)
    before = F.sum("_rows").over(whole.orderBy("_part").rowsBetween(W.unboundedPreceding, -1))
    offsets = sums.select(
        key, "_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_offset"), F.sum("_rows").over(whole).alias(count)
    )
    both = placed.join(offsets, [key, "_part"])
    return both.withColumn(name, F.col("_inside") + F.col("_offset")).drop("_part", "_inside", "_offset")
