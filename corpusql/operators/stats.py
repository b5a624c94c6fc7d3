"""Column statistics: what a question writer needs to know about a table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.operators.quantile import exact_percentiles

TOP_VALUES = 50
PROMPT_VALUES = 10


def family(dtype: T.DataType) -> str:
    """numeric, boolean or string; dates and anything else are described like strings."""
    if isinstance(dtype, T.NumericType):
        return "numeric"
    if isinstance(dtype, T.BooleanType):
        return "boolean"
    return "string"


def _columns(df: DataFrame, *families: str) -> list[T.StructField]:
    return [f for f in df.schema.fields if not families or family(f.dataType) in families]


def _name(field: T.StructField) -> Column:
    return F.col(f"`{field.name}`")


def _one_row_each(df: DataFrame, fields: Sequence[T.StructField], measures) -> DataFrame:
    """Aggregate all columns in one scan, then turn the single row into one per column."""
    aggs, rows = [], []
    for i, field in enumerate(fields):
        made = measures(field)
        aggs += [expr.alias(f"m{i}_{name}") for name, expr in made.items()]
        rows.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("column_type"),
                *[F.col(f"m{i}_{name}").alias(name) for name in made],
            )
        )
    return df.agg(*aggs).select(F.inline(F.array(*rows)))


def counts(df: DataFrame) -> DataFrame:
    def measures(field: T.StructField) -> dict[str, Column]:
        n, filled = F.count(F.lit(1)), F.count(_name(field))
        return {"total_count": n, "non_null_count": filled, "null_count": n - filled}

    return _one_row_each(df, _columns(df), measures)


def _numeric_measures(field: T.StructField) -> dict[str, Column]:
    value = _name(field).cast("double")
    return {
        "mean": F.avg(value),
        "max": F.max(value),
        "min": F.min(value),
        "non_zero_count": F.count_if(value != 0),
    }


def numeric(df: DataFrame) -> DataFrame:
    return _one_row_each(df, _columns(df, "numeric"), _numeric_measures)


def boolean(df: DataFrame) -> DataFrame:
    def measures(field: T.StructField) -> dict[str, Column]:
        value = _name(field)
        true, false = F.count_if(value), F.count_if(~value)
        return {
            "unique_count": (true > 0).cast("bigint") + (false > 0).cast("bigint"),
            "true_count": true,
            "false_count": false,
        }

    return _one_row_each(df, _columns(df, "boolean"), measures)


def extended(df: DataFrame, fraction: float = 0.95) -> DataFrame:
    """Percentile of numeric columns and the mode of all columns.

    The mode comes from the value counts (ties go to the smallest text), so
    the only state kept per column is one candidate; the percentile is exact.
    """
    mode = (
        _unpivot(df, _columns(df))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy("column_name")
        .agg(F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("mode"))
    )
    fields = _columns(df, "numeric")
    if not fields:
        return mode.withColumn("percentile", F.lit(None).cast("double"))
    numbers = df.select(
        F.inline(
            F.array(
                *[
                    F.struct(
                        F.lit(f.name).alias("column_name"),
                        _name(f).cast("double").alias("value"),
                    )
                    for f in fields
                ]
            )
        )
    )
    exact = exact_percentiles(numbers, "value", fraction, ["column_name"])
    return mode.join(exact, "column_name", "left")


def _unpivot(df: DataFrame, fields: Sequence[T.StructField]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(f.name).alias("column_name"), _name(f).cast("string").alias("value")
            )
            for f in fields
        ]
    )
    return df.select(F.inline(rows)).filter(F.col("value").isNotNull())


def value_counts(df: DataFrame) -> DataFrame:
    """(column, value, count) of the string columns.

    One shuffle on (column, value) after counting within each task, so a value
    that fills the table still reaches the shuffle as one row per task.
    """
    return (
        _unpivot(df, _columns(df, "string"))
        .groupBy("column_name", "value")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def top_values(df: DataFrame, limit: int = TOP_VALUES) -> DataFrame:
    """Most common values per column; ties in text order. The row limit is pushed
    below the shuffle by the planner, so a column of unique values stays cheap."""
    order = W.partitionBy("column_name").orderBy(F.desc("n"), "value")
    return (
        value_counts(df)
        .withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= limit)
    )


def _value_summary(df: DataFrame) -> DataFrame:
    return value_counts(df).groupBy("column_name").agg(
        F.count(F.lit(1)).alias("unique_count"),
        F.min_by("value", F.struct(-F.col("n"), F.col("value"))).alias("most_common"),
    )


def string(df: DataFrame) -> DataFrame:
    """Distinct values and the most common one; a column of NULLs has none."""
    filled = _one_row_each(
        df, _columns(df, "string"), lambda f: {"non_null_count": F.count(_name(f))}
    )
    return filled.join(_value_summary(df), "column_name", "left").withColumn(
        "unique_count", F.coalesce("unique_count", F.lit(0).cast("long"))
    )


STAT_COLUMNS = (
    "table_name", "column_name", "column_type", "total_count", "non_null_count", "null_count",
    "mean", "min", "max", "non_zero_count", "unique_count", "most_common", "true_count",
    "false_count",
)


def column_statistics(df: DataFrame, table_name: str) -> DataFrame:
    """All columns of a table in two jobs: one wide aggregate, one value count."""
    fields, aggs, rows = _columns(df), [F.count(F.lit(1)).alias("n")], []
    for i, field in enumerate(fields):
        kind, value = family(field.dataType), _name(field)
        made = {"non_null_count": F.count(value)}
        if kind == "numeric":
            made |= _numeric_measures(field)
        if kind == "boolean":
            made |= {"true_count": F.count_if(value), "false_count": F.count_if(~value)}
        aggs += [expr.alias(f"m{i}_{name}") for name, expr in made.items()]

        def got(name: str, type_name: str, i: int = i, made: dict = made) -> Column:
            out = F.col(f"m{i}_{name}") if name in made else F.lit(None)
            return out.cast(type_name).alias(name)

        rows.append(
            F.struct(
                F.lit(field.name).alias("column_name"),
                F.lit(field.dataType.simpleString()).alias("column_type"),
                F.lit(kind).alias("family"),
                F.col("n").alias("total_count"),
                got("non_null_count", "bigint"),
                (F.col("n") - F.col(f"m{i}_non_null_count")).alias("null_count"),
                *[got(name, "double") for name in ("mean", "min", "max")],
                *[got(name, "bigint") for name in ("non_zero_count", "true_count", "false_count")],
            )
        )
    stats = df.agg(*aggs).select(F.inline(F.array(*rows)))
    if _columns(df, "string"):
        stats = stats.join(_value_summary(df), "column_name", "left")
    else:
        stats = stats.withColumns(
            {
                "unique_count": F.lit(None).cast("bigint"),
                "most_common": F.lit(None).cast("string"),
            }
        )
    booleans = (F.col("true_count") > 0).cast("bigint") + (F.col("false_count") > 0).cast("bigint")
    unique = (
        F.when(F.col("family") == "string", F.coalesce("unique_count", F.lit(0).cast("bigint")))
        .when(F.col("family") == "boolean", booleans)
    )
    return (
        stats.withColumn("unique_count", unique)
        .withColumn("table_name", F.lit(table_name))
        .select(*STAT_COLUMNS)
    )


def all_table_statistics(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Statistics of several tables in one frame, with ``error``.

    A table that cannot be planned (a missing file, an unsupported type) has one
    row with its name and the error; the others are described all the same. What fails
    only while it is read stops the whole frame, as it does for one table.
    """
    parts, failed = [], []
    for name, df in tables.items():
        try:
            parts.append(column_statistics(df, name).withColumn("error", F.lit(None).cast("string")))
        except Exception as problem:  # the other tables must still be described
            failed.append((name, f"{type(problem).__name__}: {str(problem)[:500]}"))
    if failed:
        parts.append(SparkSession.active().createDataFrame(failed, "table_name string, error string"))
    if not parts:
        raise ValueError("no table given")
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part, allowMissingColumns=True)
    return out


def statistics_text(df: DataFrame, table_name: str) -> DataFrame:
    """One line per column, as it goes into a prompt."""
    stats = column_statistics(df, table_name)
    top = top_values(df, PROMPT_VALUES).groupBy("column_name").agg(
        F.array_sort(F.collect_list(F.struct("rank", "value"))).alias("v")
    )
    values = F.array_join(F.transform("v", lambda x: F.concat(F.lit("'"), x["value"], F.lit("'"))), ", ")
    flags = F.concat_ws(
        ", ",
        F.when(F.col("false_count") > 0, F.lit("False")),
        F.when(F.col("true_count") > 0, F.lit("True")),
    )
    number = F.concat(
        F.lit(", range ["), F.format_string("%.2f", "min"), F.lit(" - "),
        F.format_string("%.2f", "max"), F.lit("], mean "), F.format_string("%.2f", "mean"),
    )
    detail = (
        F.when(F.col("mean").isNotNull(), number)
        .when(F.size("v") > 0, F.concat(F.lit(", values: ["), values, F.lit("]")))
        .when(flags != "", F.concat(F.lit(", values: ["), flags, F.lit("]")))
        .otherwise("")
    )
    line = F.concat(
        F.lit("- "), F.col("column_name"), F.lit(" ("), F.col("column_type"), F.lit("): "),
        F.col("non_null_count").cast("string"), F.lit("/"), F.col("total_count").cast("string"),
        F.lit(" non-null values"), detail,
    )
    return stats.join(top, "column_name", "left").select(
        "table_name", "column_name", line.alias("line")
    )
