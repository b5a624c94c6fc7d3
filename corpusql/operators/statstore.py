"""Column statistics kept per batch: exact sums and counts, sketches that merge, and values that fill a share of a batch.

A new batch is described on its own and stored in its own folder; the statistics of the whole table, or of any
batches, are merged from the folders without reading a row again.
"""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.operators.stats import family, value_counts

SHARE = 0.001
DISTINCT_LOG = 12
QUANTILE_K = 400

SUMMARY = (
    "column_name string, column_type string, total_count long, non_null_count long, total double, min double, "
    "max double, non_zero_count long, distinct_sketch binary, quantile_sketch binary, share double, batch string"
)
VALUES = "column_name string, value string, n long, batch string"


def add_batch(rows: DataFrame, out: str, batch: str, share: float = SHARE) -> None:
    """Describe one batch and store it under its name; a batch that comes again replaces itself.

    One wide aggregate gives exact counts, sums and ends with a distinct sketch of every
    column and a quantile sketch of the numbers. Of string columns the values are kept, counted,
    that fill at least ``share`` of the column's filled rows: at most 1 / ``share`` of them, however many
    values there are. Columns of NULLs, and batches without rows, have counts of zero. ``share`` is the
    same for all batches of a store.
    """
    if not re.fullmatch(r"[\w-]+", batch):
        raise ValueError(f"not a name for a batch: {batch!r}")
    if not 0 < share <= 1:
        raise ValueError("a share is above 0 and at most 1")
    spark = rows.sparkSession
    aggs: list[Column] = [F.count(F.lit(1)).alias("n")]
    made = []
    for i, field in enumerate(rows.schema.fields):
        column = F.col(f"`{field.name}`")
        number = column.cast("double") if family(field.dataType) == "numeric" else F.lit(None).cast("double")
        parts = {
            "non_null_count": F.count(column),
            "total": F.sum(number),
            "min": F.min(number),
            "max": F.max(number),
            "non_zero_count": F.count_if(number != 0),
            "distinct_sketch": F.hll_sketch_agg(column.cast("string"), F.lit(DISTINCT_LOG)),
        }
        if family(field.dataType) == "numeric":
            parts["quantile_sketch"] = F.kll_sketch_agg_double(number, F.lit(QUANTILE_K))
        aggs += [e.alias(f"m{i}_{name}") for name, e in parts.items()]
        quantiles = F.col(f"m{i}_quantile_sketch") if "quantile_sketch" in parts else F.lit(None).cast("binary")
        made.append(
            F.struct(
                F.lit(field.name).alias("column_name"), F.lit(field.dataType.simpleString()).alias("column_type"),
                F.col("n").alias("total_count"),
                *[F.col(f"m{i}_{name}").alias(name) for name in parts if name != "quantile_sketch"],
                quantiles.alias("quantile_sketch"), F.lit(share).alias("share"),
            )
        )
    rows.agg(*aggs).select(F.inline(F.array(*made))).write.mode("overwrite").parquet(f"{out}/columns/batch={batch}")
    # Counts that later looks took of an earlier form of this batch go.
    spark.createDataFrame([], "column_name string, value string, n long").write.mode("overwrite").parquet(f"{out}/late/batch={batch}")
    summary = summaries(spark, out, [batch]).select("column_name", "non_null_count")
    texts = [f for f in rows.schema.fields if family(f.dataType) == "string"]
    if texts:
        frequent = value_counts(rows.select(*[F.col(f"`{f.name}`") for f in texts])).join(summary, "column_name")
        frequent = frequent.filter(F.col("n") >= F.col("non_null_count") * share).select("column_name", "value", "n")
    else:
        frequent = spark.createDataFrame([], "column_name string, value string, n long")
    frequent.write.mode("overwrite").parquet(f"{out}/values/batch={batch}")


def _stored(spark: SparkSession, path: str, schema: str, batches: Sequence[str] | None) -> DataFrame:
    found = spark.read.schema(schema).parquet(path)
    return found if batches is None else found.filter(F.col("batch").isin(list(batches)))


def summaries(spark: SparkSession, out: str, batches: Sequence[str] | None = None) -> DataFrame:
    """One row per column and stored batch."""
    return _stored(spark, f"{out}/columns", SUMMARY, batches)


def stored_statistics(
    spark: SparkSession, out: str, batches: Sequence[str] | None = None, fractions: Sequence[float] = (0.5, 0.95)
) -> DataFrame:
    """Statistics per column of all stored batches, or of some, merged from the stored rows alone.

    Counts, ends and the mean are exact. ``approx_unique`` is off by about 1.6 % (one standard deviation) and a
    percentile by about 1 % of the ranks; both are NULL or 0 for a column without values. A column
    that some batches lack counts where it is.
    """
    one = summaries(spark, out, batches).groupBy("column_name").agg(
        F.max("column_type").alias("column_type"),
        F.sum("total_count").alias("total_count"),
        F.sum("non_null_count").alias("non_null_count"),
        F.sum("total").alias("total"),
        F.min("min").alias("min"),
        F.max("max").alias("max"),
        F.sum("non_zero_count").alias("non_zero_count"),
        F.hll_union_agg("distinct_sketch").alias("d"),
        F.kll_merge_agg_double(F.when(F.col("total").isNotNull(), F.col("quantile_sketch"))).alias("q"),
    )
    wanted = [
        F.when(F.col("total").isNotNull(), F.kll_sketch_get_quantile_double("q", F.lit(float(f)))).alias(f"p{round(f * 100)}")
        for f in fractions
    ]
    return one.select(
        "column_name", "column_type", "total_count", "non_null_count",
        (F.col("total_count") - F.col("non_null_count")).alias("null_count"),
        (F.col("total") / F.col("non_null_count")).alias("mean"), "min", "max",
        F.when(F.col("total").isNotNull(), F.col("non_zero_count")).alias("non_zero_count"),
        F.hll_sketch_estimate("d").alias("approx_unique"), *wanted,
    )


def frequent_values(rows: DataFrame, out: str, batch_col: str, share: float = SHARE) -> DataFrame:
    """(column_name, value, n, rank): the values that fill at least ``share`` of a column over all batches, exactly counted.

    A value with that share of all rows has it in one batch at least, so the stored values hold all
    of them. Where a batch did not store a value, its count there is below the stored limit: values that cannot
    reach the share even so are ruled out, and the others are counted in those batches of
    ``rows`` (the whole table, its batch names in ``batch_col``) and nowhere else. These counts are stored
    too, so the next look reads only what is new. Ties rank by text order.
    """
    spark = rows.sparkSession
    columns = summaries(spark, out).select("column_name", "batch", "non_null_count", "share")
    limit = columns.agg(F.max("share")).first()[0]
    if limit is None or limit > share:
        raise ValueError(f"the store keeps values from a share of {limit} on, not {share}")
    totals = columns.groupBy("column_name").agg(
        F.sum("non_null_count").alias("filled"), F.sum(F.col("non_null_count") * F.col("share")).alias("slack")
    )
    keys = ["column_name", "value", "batch"]

    def counts() -> DataFrame:
        late = _stored(spark, f"{out}/late", VALUES, None)
        return _stored(spark, f"{out}/values", VALUES, None).unionByName(late).groupBy(*keys).agg(F.max("n").alias("n"))

    known = counts().join(columns, ["column_name", "batch"])
    reach = known.groupBy("column_name", "value").agg(
        F.sum("n").alias("n"), F.sum(F.col("non_null_count") * F.col("share")).alias("own_slack")
    ).join(totals, "column_name")
    possible = reach.filter(F.col("n") + F.col("slack") - F.col("own_slack") >= F.col("filled") * share)
    asked = possible.select("column_name", "value").join(columns.filter("non_null_count > 0").select("column_name", "batch"), "column_name")
    missing = asked.join(known.select(*keys), keys, "left_anti")
    names = [r[0] for r in missing.select("batch").distinct().collect()]
    if names:
        texts = [r[0] for r in missing.select("column_name").distinct().collect()]
        some = rows.filter(F.col(batch_col).isin(names))
        cells = F.array(*[F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("string").alias("value")) for c in texts])
        long = some.select(F.col(batch_col).alias("batch"), F.inline(cells)).filter(F.col("value").isNotNull())
        seen = long.join(missing, keys, "left_semi").groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
        late = missing.join(seen, keys, "left").select("column_name", "value", F.coalesce("n", F.lit(0).cast("long")).alias("n"), "batch")
        late.write.mode("append").partitionBy("batch").parquet(f"{out}/late")
    whole = counts().join(possible.select("column_name", "value", "filled"), ["column_name", "value"])
    summed = whole.groupBy("column_name", "value").agg(F.sum("n").alias("n"), F.first("filled").alias("filled"))
    order = W.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return summed.filter(F.col("n") >= F.col("filled") * share).select(
        "column_name", "value", "n", F.row_number().over(order).alias("rank")
    )
