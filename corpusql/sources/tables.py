"""Tables and line-delimited files as documents."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.functions import ids

SAMPLE_ROWS = 10

# Layout of the text view of a table.
TABLE_HEAD = "CSV Data: %s\nColumns: %s\nRows: %d\n\nData:"
TABLE_ROW = "Row %d: %s"
TABLE_MORE = "... (%d more rows)"

LINE_ORDER = ("_file", "_block", "_line")


def csv_rows(spark: SparkSession, path: str, sep: str = ",") -> DataFrame:
    """Rows of CSV files plus the columns that order them as they lie in the files."""
    rows = spark.read.csv(path, header=True, inferSchema=True, sep=sep)
    return rows.select(
        "*",
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_line"),
    )


def _shown(field: T.StructField) -> Column:
    value = F.coalesce(F.col(f"`{field.name}`").cast("string"), F.lit("nan"))
    if isinstance(field.dataType, T.StringType):
        value = F.when(
            F.col(f"`{field.name}`").isNull(), F.lit("nan")
        ).otherwise(F.concat(F.lit("'"), value, F.lit("'")))
    return F.concat(F.lit(f"'{field.name}': "), value)


def table_to_document(
    rows: DataFrame, name: str, order_by: Sequence[str], sample_rows: int = SAMPLE_ROWS
) -> DataFrame:
    """One row with a text view of a table: columns, row count, first rows.

    The first rows come from a top-k, the count from column-free scanning; the
    table itself is never gathered.
    """
    fields = [f for f in rows.schema.fields if f.name not in LINE_ORDER]
    total = rows.select(F.count(F.lit(1)).alias("n")).scalar()
    shown = F.concat(F.lit("{"), F.concat_ws(", ", *[_shown(f) for f in fields]), F.lit("}"))
    first = rows.orderBy(*order_by).limit(sample_rows)
    parts = first.agg(
        F.array_sort(
            F.collect_list(F.struct(*[F.col(c).alias(f"k{i}") for i, c in enumerate(order_by)],
                                    shown.alias("shown")))
        ).alias("p")
    )
    lines = F.transform("p", lambda x, i: F.format_string(TABLE_ROW, i + 1, x["shown"]))
    names = ", ".join(f.name for f in fields)
    head = F.format_string(TABLE_HEAD, F.lit(name), F.lit(names), F.col("row_count"))
    left = F.col("row_count") - F.size("p")
    more = F.when(left > 0, F.format_string(TABLE_MORE, left))
    text = F.concat_ws(
        "\n", head, F.when(F.size("p") > 0, F.array_join(lines, "\n")), more
    )
    return parts.withColumn("row_count", total).select(
        F.lit(name).alias("filename"), "row_count", F.lit(len(fields)).alias("column_count"),
        text.alias("text"),
    )


def _family(dtype: T.DataType, has_null: Column) -> Column:
    if isinstance(dtype, T.IntegralType):
        return F.when(has_null, F.lit("float64")).otherwise(F.lit("int64"))
    if isinstance(dtype, (T.FractionalType, T.DecimalType)):
        return F.lit("float64")
    if isinstance(dtype, T.BooleanType):
        return F.when(has_null, F.lit("object")).otherwise(F.lit("bool"))
    if isinstance(dtype, (T.TimestampType, T.TimestampNTZType)):
        return F.lit("datetime64[ns]")
    return F.lit("object")


def table_profile(rows: DataFrame, name: str) -> DataFrame:
    """One row per column: inferred type, row count, column count. One scan."""
    fields = [f for f in rows.schema.fields if f.name not in LINE_ORDER]
    counts = rows.agg(
        F.count(F.lit(1)).alias("n"),
        *[F.count(f"`{f.name}`").alias(f"c{i}") for i, f in enumerate(fields)],
    )
    columns = [
        F.struct(
            F.lit(name).alias("table_name"),
            F.lit(i + 1).alias("position"),
            F.lit(f.name).alias("column_name"),
            _family(f.dataType, F.col(f"c{i}") < F.col("n")).alias("dtype"),
            F.col("n").alias("row_count"),
            F.lit(len(fields)).alias("column_count"),
        )
        for i, f in enumerate(fields)
    ]
    return counts.select(F.inline(F.array(*columns)))


def jsonl_corpus(spark: SparkSession, path: str, text_field: str = "document_content") -> DataFrame:
    """Documents of line-delimited JSON; equal lines of a file are one document id."""
    rows = spark.read.schema(f"`{text_field}` string").json(path)
    name = F.col("_metadata.file_name")
    return rows.select(
        ids.doc_id(name, F.md5(F.col(text_field))).alias("doc_id"),
        name.alias("filename"),
        F.col(text_field).alias("text"),
    )


def jsonl_questions(spark: SparkSession, path: str, field: str = "question") -> DataFrame:
    return spark.read.schema(f"`{field}` string").json(path).select(F.col(field).alias("question"))


def row_documents(
    rows: DataFrame, text_col: str, id_cols: Sequence[str], table_name: str
) -> DataFrame:
    """Each row with a text column is a document of its own."""
    key = F.concat_ws("/", *[F.col(c).cast("string") for c in id_cols])
    rest = [c for c in rows.columns if c != text_col]
    return rows.select(
        ids.doc_id(F.lit(table_name), key).alias("doc_id"),
        F.lit(table_name).alias("filename"),
        F.col(text_col).alias("text"),
        F.to_json(F.struct(*rest)).alias("metadata"),
    )


def read_if_present(spark: SparkSession, path: str) -> DataFrame | None:
    """The table at ``path``, or None when nothing was written there yet."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as problem:
        if problem.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def leave_out(rows: DataFrame, stored: DataFrame | None, key: str) -> DataFrame:
    """Rows whose key is not stored. Only keys are compared; ``rows`` is read as it is
    when nothing is stored, otherwise the keys in common are taken out."""
    if stored is None:
        return rows
    common = stored.select(key).join(rows.select(key), key, "left_semi").distinct()
    if common.isEmpty():
        return rows
    return rows.join(common, key, "left_anti")
