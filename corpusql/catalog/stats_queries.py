"""F: column statistics."""

from pyspark.sql import functions as F

from corpusql.catalog.base import load, query, six
from corpusql.operators import quantile, stats, statstore
from corpusql.session import shared_dir


def sparse_orders(spark, d):
    """Orders with gaps: the tables hold no NULL, statistics must cope with them."""
    gap = F.col("o_orderkey") % 7 == 0
    return load(spark, d, "orders").select(
        "o_orderkey",
        F.when(~gap, F.col("o_totalprice")).alias("o_totalprice"),
        F.when(~gap, F.col("o_orderstatus")).alias("o_orderstatus"),
        "o_orderpriority",
        F.when(~gap, F.col("o_orderstatus") == "F").alias("finished"),
    )


SPARSE_SQL = """
so AS (SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN o_totalprice END AS o_totalprice,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus END AS o_orderstatus, o_orderpriority,
         CASE WHEN o_orderkey % 7 <> 0 THEN o_orderstatus = 'F' END AS finished FROM orders)
"""


def _counts_sql(columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*)::BIGINT AS total_count, count({c})::BIGINT AS non_null_count, "
        f"(count(*) - count({c}))::BIGINT AS null_count FROM so"
        for c in columns
    )


@query("stats_counts", f"WITH {SPARSE_SQL} " + _counts_sql(
    ["o_orderkey", "o_totalprice", "o_orderstatus", "o_orderpriority", "finished"]))
def stats_counts(spark, d):
    return stats.counts(sparse_orders(spark, d)).drop("column_type")


LINE_NUMBERS = ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("stats_numeric", " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, round(avg({c}) + 1e-9, 6) AS mean, max({c})::DOUBLE AS max, min({c})::DOUBLE AS min, "
    f"count(*) FILTER ({c} <> 0)::BIGINT AS non_zero_count FROM lineitem" for c in LINE_NUMBERS))
def stats_numeric(spark, d):
    made = stats.numeric(load(spark, d, "lineitem").select(*LINE_NUMBERS))
    return made.select("column_name", six("mean").alias("mean"), "max", "min", "non_zero_count")


@query("stats_boolean", """
SELECT 'quality' AS column_name, count(DISTINCT quality)::BIGINT AS unique_count,
  count(*) FILTER (quality = 1)::BIGINT AS true_count, count(*) FILTER (quality = 0)::BIGINT AS false_count FROM labels
UNION ALL SELECT 'toxic', count(DISTINCT toxic)::BIGINT, count(*) FILTER (toxic = 1)::BIGINT,
  count(*) FILTER (toxic = 0)::BIGINT FROM labels
""")
def stats_boolean(spark, d):
    flags = load(spark, d, "labels").select(
        F.col("quality").cast("boolean"), F.col("toxic").cast("boolean")
    )
    return stats.boolean(flags).drop("column_type")


def _string_sql(table, columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*)::BIGINT AS unique_count, sum(n)::BIGINT AS non_null_count, "
        f"(SELECT v FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1) "
        f"ORDER BY n DESC, v LIMIT 1) AS most_common "
        f"FROM (SELECT {c} AS v, count(*) AS n FROM {table} WHERE {c} IS NOT NULL GROUP BY 1)"
        for c in columns
    )


PART_TEXTS = ["p_name", "p_brand", "p_type"]


@query("stats_string", _string_sql("part", PART_TEXTS))
def stats_string(spark, d):
    return stats.string(load(spark, d, "part").select(*PART_TEXTS, "p_size")).drop("column_type")


@query("stats_top_values", "WITH v AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS column_name, {c} AS value, count(*)::BIGINT AS n FROM customer GROUP BY 2"
    for c in ("c_name", "c_mktsegment")) + """),
r AS (SELECT *, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value) AS rank FROM v)
SELECT column_name, value, n, rank::INTEGER AS rank FROM r WHERE rank <= 50
""")
def stats_top_values(spark, d):
    return stats.top_values(load(spark, d, "customer"))


def _column_sql(source, table, column, kind, dtype):
    number = kind == "numeric"
    parts = [
        f"'{table}' AS table_name", f"'{column}' AS column_name", f"'{dtype}' AS column_type",
        "count(*)::BIGINT AS total_count", f"count({column})::BIGINT AS non_null_count",
        f"(count(*) - count({column}))::BIGINT AS null_count",
        f"round(avg({column}) + 1e-9, 6) AS mean" if number else "NULL::DOUBLE AS mean",
        f"min({column})::DOUBLE AS min" if number else "NULL::DOUBLE AS min",
        f"max({column})::DOUBLE AS max" if number else "NULL::DOUBLE AS max",
        (f"count(*) FILTER ({column} <> 0)::BIGINT" if number else "NULL::BIGINT") + " AS non_zero_count",
        (f"count(DISTINCT {column})::BIGINT" if not number else "NULL::BIGINT") + " AS unique_count",
        (f"(SELECT v FROM (SELECT {column}::VARCHAR AS v, count(*) AS n FROM {source} WHERE {column} IS NOT NULL GROUP BY 1) "
         "ORDER BY n DESC, v LIMIT 1)" if kind == "string" else "NULL::VARCHAR") + " AS most_common",
        (f"count(*) FILTER ({column})::BIGINT" if kind == "boolean" else "NULL::BIGINT") + " AS true_count",
        (f"count(*) FILTER (NOT {column})::BIGINT" if kind == "boolean" else "NULL::BIGINT") + " AS false_count",
    ]
    return f"SELECT {', '.join(parts)} FROM {source}"


SPARSE_COLUMNS = [
    ("o_orderkey", "numeric", "bigint"), ("o_totalprice", "numeric", "double"),
    ("o_orderstatus", "string", "string"), ("o_orderpriority", "string", "string"),
    ("finished", "boolean", "boolean"),
]


@query("column_statistics", f"WITH {SPARSE_SQL} " + " UNION ALL ".join(
    _column_sql("so", "orders", *c) for c in SPARSE_COLUMNS))
def column_statistics(spark, d):
    made = stats.column_statistics(sparse_orders(spark, d), "orders")
    return made.withColumn("mean", six("mean"))


ALL_COLUMNS = {
    "customer": [("c_custkey", "numeric", "bigint"), ("c_name", "string", "string"),
                 ("c_nationkey", "numeric", "int"), ("c_acctbal", "numeric", "double"),
                 ("c_mktsegment", "string", "string")],
    "supplier": [("s_suppkey", "numeric", "bigint"), ("s_name", "string", "string"),
                 ("s_nationkey", "numeric", "int"), ("s_acctbal", "numeric", "double")],
    "part": [("p_partkey", "numeric", "bigint"), ("p_name", "string", "string"),
             ("p_brand", "string", "string"), ("p_type", "string", "string"),
             ("p_size", "numeric", "int"), ("p_retailprice", "numeric", "double")],
}


@query("all_table_statistics", " UNION ALL ".join(
    _column_sql(t, t, *c) for t, cols in ALL_COLUMNS.items() for c in cols))
def all_table_statistics(spark, d):
    made = stats.all_table_statistics({t: load(spark, d, t) for t in ALL_COLUMNS})
    return made.drop("error").withColumn("mean", six("mean"))


@query("statistics_text", """
SELECT 'part' AS table_name, 'p_size' AS column_name, '- p_size (int): ' || count(p_size) || '/' || count(*)
  || ' non-null values, range [' || printf('%.2f', min(p_size)::DOUBLE) || ' - ' || printf('%.2f', max(p_size)::DOUBLE)
  || '], mean ' || printf('%.2f', avg(p_size)) AS line FROM part
UNION ALL SELECT 'part', 'p_type', '- p_type (string): ' || (SELECT count(p_type) || '/' || count(*) FROM part)
  || ' non-null values, values: [' || (SELECT string_agg('''' || v || '''', ', ' ORDER BY n DESC, v)
     FROM (SELECT p_type AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) || ']'
UNION ALL SELECT 'part', 'p_brand', '- p_brand (string): ' || (SELECT count(p_brand) || '/' || count(*) FROM part)
  || ' non-null values, values: [' || (SELECT string_agg('''' || v || '''', ', ' ORDER BY n DESC, v)
     FROM (SELECT p_brand AS v, count(*) AS n FROM part GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10)) || ']'
""")
def statistics_text(spark, d):
    return stats.statistics_text(load(spark, d, "part").select("p_size", "p_type", "p_brand"), "part")


def _extended_sql(columns):
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, (SELECT v FROM (SELECT {c}::VARCHAR AS v, count(*) AS n FROM lineitem GROUP BY 1) "
        f"ORDER BY n DESC, v LIMIT 1) AS mode, "
        + (f"round((SELECT quantile_cont({c}::DOUBLE, 0.95) FROM lineitem) + 1e-9, 6)" if number else "NULL::DOUBLE")
        + " AS percentile"
        for c, number in columns
    )


@query("extended_statistics", _extended_sql(
    [("l_quantity", True), ("l_extendedprice", True), ("l_linenumber", True), ("l_returnflag", False)]))
def extended_statistics(spark, d):
    columns = ["l_quantity", "l_extendedprice", "l_linenumber", "l_returnflag"]
    made = stats.extended(load(spark, d, "lineitem").select(*columns))
    return made.withColumn("percentile", six("percentile"))


@query("exact_percentiles", """
SELECT l_returnflag, round(quantile_cont(l_extendedprice, 0.5) + 1e-9, 6) AS percentile FROM lineitem GROUP BY 1
""")
def exact_percentiles(spark, d):
    made = quantile.exact_percentiles(load(spark, d, "lineitem"), "l_extendedprice", 0.5, ["l_returnflag"])
    return made.withColumn("percentile", six("percentile"))


BATCHES = 3
STORED = ["l_orderkey", "l_quantity", "l_discount", "l_returnflag", "l_shipdate"]


def _stored_sql(column):
    number = column in ("l_orderkey", "l_quantity", "l_discount")
    value = f"{column}::DOUBLE" if number else "NULL::DOUBLE"
    return (
        f"SELECT '{column}' AS column_name, count(*)::BIGINT AS total_count, count({column})::BIGINT AS non_null_count, "
        f"(count(*) - count({column}))::BIGINT AS null_count, round(avg({value}) + 1e-9, 6) AS mean, min({value}) AS min, "
        f"max({value}) AS max, " + (f"count(*) FILTER ({column} <> 0)::BIGINT" if number else "NULL::BIGINT") + " AS non_zero_count FROM l"
    )


@query("stored_statistics", """
WITH l AS (SELECT l_orderkey, CASE WHEN l_orderkey % 5 <> 0 THEN l_quantity END AS l_quantity, l_discount, l_returnflag, l_shipdate FROM lineitem)
""" + " UNION ALL ".join(_stored_sql(c) for c in STORED))
def stored_statistics(spark, d):
    """Three batches, one of them stored twice; the statistics come from the stored rows."""
    rows = load(spark, d, "lineitem").withColumn("l_quantity", F.when(F.col("l_orderkey") % 5 != 0, F.col("l_quantity"))).select(*STORED)
    out = shared_dir(spark, "statistics")
    for i in (*range(BATCHES), 0):
        statstore.add_batch(rows.filter(F.col("l_orderkey") % BATCHES == i), out, f"b{i}")
    made = statstore.stored_statistics(spark, out).withColumn("mean", six("mean"))
    return made.drop("column_type", "approx_unique", "p50", "p95")


FREQUENT = 0.0201


@query("frequent_values", f"""
WITH l AS (SELECT l_returnflag, l_quantity::INTEGER::VARCHAR AS quantity FROM lineitem),
v AS (SELECT 'l_returnflag' AS column_name, l_returnflag AS value, count(*)::BIGINT AS n FROM l GROUP BY 2
  UNION ALL SELECT 'quantity', quantity, count(*)::BIGINT FROM l GROUP BY 2)
SELECT column_name, value, n, row_number() OVER (PARTITION BY column_name ORDER BY n DESC, value)::INTEGER AS rank
FROM v WHERE n >= {FREQUENT} * (SELECT count(*) FROM l)
""")
def frequent_values(spark, d):
    """Batches by ship date; a value that some batch did not store is counted there."""
    batch = F.concat(F.lit("y"), F.floor((F.year("l_shipdate") - 1990) / BATCHES).cast("string"))
    rows = load(spark, d, "lineitem").select(
        "l_returnflag", F.col("l_quantity").cast("int").cast("string").alias("quantity"), batch.alias("batch")
    )
    out = shared_dir(spark, "frequent")
    for name in sorted(r[0] for r in rows.select("batch").distinct().collect()):
        statstore.add_batch(rows.filter(F.col("batch") == name).drop("batch"), out, name, FREQUENT)
    return statstore.frequent_values(rows, out, "batch", FREQUENT)
