"""One function per question class. Each returns a lazy DataFrame.

A spec is plain data: measures are (name, function, column), orders are column
names with an optional leading minus, filters are boolean Columns. Catalyst
does the planning: filters and columns reach the scan, small sides are
broadcast by their measured size, and top-k never sorts the whole input.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions.questions import (
    complexity, confidence, is_safe_sql, is_safe_text, question_class, requires_join,
)
from corpusql.operators.quantile import exact_percentiles

Measure = tuple[str, str, str | Column]

_MEASURES = {
    "count": lambda c: F.count(c),
    "count_distinct": lambda c: F.count_distinct(c),
    "sum": lambda c: F.sum(c),
    "avg": lambda c: F.avg(c),
    "min": lambda c: F.min(c),
    "max": lambda c: F.max(c),
    "count_if": lambda c: F.count_if(c),
    "rate": lambda c: F.avg(c.cast("double")),
}


def _measure(spec: Measure) -> Column:
    name, function, column = spec
    if isinstance(column, str):
        column = F.lit(1) if column == "*" else F.col(column)
    return _MEASURES[function](column).alias(name)


def _order(spec: str) -> Column:
    return F.desc(spec[1:]) if spec.startswith("-") else F.asc(spec)


def _where(df: DataFrame, where: Column | None) -> DataFrame:
    return df if where is None else df.filter(where)


def count(df: DataFrame, where: Column | None = None) -> DataFrame:
    return _where(df, where).agg(F.count(F.lit(1)).alias("n"))


def aggregate(df: DataFrame, measures: Sequence[Measure], where: Column | None = None) -> DataFrame:
    return _where(df, where).agg(*[_measure(m) for m in measures])


def select_rows(
    df: DataFrame, columns: Sequence[str | Column], predicates: Sequence[Column] = ()
) -> DataFrame:
    for predicate in predicates:
        df = df.filter(predicate)
    return df.select(*columns)


def group_by(
    df: DataFrame,
    keys: Sequence[str | Column],
    measures: Sequence[Measure],
    where: Column | None = None,
    order: Sequence[str] = (),
) -> DataFrame:
    grouped = _where(df, where).groupBy(*keys).agg(*[_measure(m) for m in measures])
    return grouped.orderBy(*[_order(o) for o in order]) if order else grouped


def join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str] | Column,
    where: Column | None = None,
    columns: Sequence[str | Column] = ("*",),
) -> DataFrame:
    """Inner equi-join, filtered. The join algorithm is left to size statistics and AQE."""
    return _where(left.join(right, on, "inner"), where).select(*columns)


def multi_join(
    base: DataFrame,
    steps: Sequence[tuple[DataFrame, Column | str | Sequence[str]]],
    where: Column | None = None,
) -> DataFrame:
    for other, on in steps:
        base = base.join(other, on, "inner")
    return _where(base, where)


def by_period(
    df: DataFrame, time_col: str, period: str, measures: Sequence[Measure], where: Column | None = None
) -> DataFrame:
    """Measures per month, quarter or year; the period is its first day as text."""
    start = F.date_format(F.date_trunc(period, time_col), "yyyy-MM-dd").alias("period")
    return group_by(df, [start], measures, where)


def mean_delay(df: DataFrame, start_col: str, end_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """Average number of days between two dates."""
    return df.groupBy(*keys).agg(F.avg(F.datediff(end_col, start_col)).alias("mean_days"))


def in_period_before(df: DataFrame, time_col: str, moment: Column, months: int = 1) -> DataFrame:
    """Rows of the ``months`` calendar months before the month of ``moment``."""
    end = F.trunc(moment, "month")
    return df.filter((F.col(time_col) >= F.add_months(end, -months)) & (F.col(time_col) < end))


def ranking(
    df: DataFrame, order: Sequence[str], n: int, within: Sequence[str] = (), where: Column | None = None
) -> DataFrame:
    """Top or bottom ``n``; per group with ``within``. ``order`` must end in a unique key."""
    rows = _where(df, where)
    keys = [_order(o) for o in order]
    if not within:
        return rows.orderBy(*keys).limit(n)
    ranked = rows.withColumn("rank", F.row_number().over(W.partitionBy(*within).orderBy(*keys)))
    return ranked.filter(F.col("rank") <= n)


def lookup(df: DataFrame, **values: object) -> DataFrame:
    for name, value in values.items():
        df = df.filter(F.col(name) == F.lit(value))
    return df


def ratio(df: DataFrame, name: str, numerator: Column, denominator: Column, percent: bool = True) -> DataFrame:
    value = F.try_divide(numerator, denominator)
    return df.withColumn(name, value * 100 if percent else value)


def yoy_growth(df: DataFrame, key: str, year_col: str, metric: str, year: int) -> DataFrame:
    """Metric of a year next to the year before. One pass, no self join.

    ``df`` has one row per key and year, or is summed to that.
    """
    pair = (
        df.filter(F.col(year_col).isin(year, year - 1))
        .groupBy(key)
        .agg(
            F.sum(F.when(F.col(year_col) == year, F.col(metric))).alias("current"),
            F.sum(F.when(F.col(year_col) == year - 1, F.col(metric))).alias("previous"),
        )
        .filter(F.col("current").isNotNull() & F.col("previous").isNotNull())
    )
    growth = F.try_divide(F.col("current") - F.col("previous"), F.col("previous")) * 100
    return pair.withColumn("growth_pct", growth)


def above_percentile(df: DataFrame, column: str, fraction: float = 0.95) -> DataFrame:
    """Rows a vague word such as "high" stands for: above a percentile of the column.

    The bound is one value, computed once and used as a subquery.
    """
    bound = exact_percentiles(df.select(column), column, fraction).scalar()
    return df.filter(F.col(column) > bound)


def conditional_rate(df: DataFrame, keys: Sequence[str], condition: Column) -> DataFrame:
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(condition).alias("matching"),
        F.avg(condition.cast("double")).alias("rate"),
    )


def run_sql(
    spark: SparkSession,
    sql: str,
    tables: Mapping[str, DataFrame],
    args: Mapping[str, object] | Sequence[object] | None = None,
) -> DataFrame:
    """Read-only SQL over the given tables (as temporary views), with bound parameters."""
    if not is_safe_text(sql):
        raise ValueError("only SELECT and WITH statements are allowed")
    own = {t.name for t in spark.catalog.listTables() if t.isTemporary}
    before = {name: spark.table(name) for name in tables if name.lower() in own}
    try:
        for name, df in tables.items():
            df.createOrReplaceTempView(name)
        return spark.sql(sql, args=args)  # names are resolved here, so the views may go
    finally:
        for name in tables:
            if name in before:
                before[name].createOrReplaceTempView(name)
            else:
                spark.catalog.dropTempView(name)


def classify_questions(questions: DataFrame, text_col: str = "question") -> DataFrame:
    text = F.col(text_col)
    return questions.withColumns(
        {
            "query_type": question_class(text),
            "requires_join": requires_join(text),
            "complexity": complexity(text),
            "confidence": confidence(text),
        }
    )


def flag_unsafe_sql(statements: DataFrame, sql_col: str = "sql") -> DataFrame:
    return statements.withColumn("is_safe", is_safe_sql(F.col(sql_col)))


def explain_questions(
    questions: DataFrame, statements: DataFrame, on: str, text_col: str = "question", sql_col: str = "sql"
) -> DataFrame:
    """Class, statement and safety of each question; nothing is executed."""
    return classify_questions(questions, text_col).join(
        flag_unsafe_sql(statements, sql_col), on, "left"
    )
