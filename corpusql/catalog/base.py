"""Registration of queries, and inputs several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.functions import ids
from corpusql.functions.text import TOKEN
from corpusql.operators.chunking import CHUNK_SIZE, OVERLAP, token_chunks
from corpusql.session import load, spread

Query = Callable[[SparkSession, str], DataFrame]

QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(fn: Query) -> Query:
        if name in QUERIES:
            raise ValueError(f"registered twice: {name}")
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql.strip()
        return fn

    return add


# Extension by document number: every supported type, and one that is not.
EXTENSIONS = ("txt", "md", "json", "csv", "pdf", "markdown", "tsv", "xyz")


def documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents table with text ids, file name, path and extension."""
    docs = spread(load(spark, d, "documents"), "doc_id")
    ext = F.element_at(
        F.array(*[F.lit(e) for e in EXTENSIONS]), (F.col("doc_id") % len(EXTENSIONS) + 1).cast("int")
    )
    name = F.concat(F.lit("doc_"), F.col("doc_id").cast("string"), F.lit("."), ext)
    return docs.select(
        F.col("doc_id").cast("string").alias("doc_id"),
        name.alias("filename"),
        F.concat(F.lit("/corpus/"), F.col("source"), F.lit("/"), name).alias("file_path"),
        ext.alias("extension"),
        "source",
        "lang",
        "n_chars",
        "text",
    )


def orders(spark: SparkSession, d: str) -> DataFrame:
    return spread(load(spark, d, "orders"), "o_orderkey")


DOCS_SQL = """
docs AS (
  SELECT doc_id::VARCHAR AS doc_id, 'doc_' || doc_id || '.' || ext AS filename,
         '/corpus/' || source || '/doc_' || doc_id || '.' || ext AS file_path,
         ext AS extension, source, lang, n_chars, text
  FROM (SELECT *, CASE doc_id % 8 WHEN 0 THEN 'txt' WHEN 1 THEN 'md' WHEN 2 THEN 'json'
                  WHEN 3 THEN 'csv' WHEN 4 THEN 'pdf' WHEN 5 THEN 'markdown'
                  WHEN 6 THEN 'tsv' ELSE 'xyz' END AS ext FROM documents))
"""


def chunks(spark: SparkSession, d: str) -> DataFrame:
    return token_chunks(documents(spark, d))


STEP = CHUNK_SIZE - OVERLAP

CHUNKS_SQL = f"""
toks AS (SELECT doc_id, regexp_extract_all(text, '{TOKEN}', 1) AS t FROM documents),
starts AS (SELECT doc_id, t, unnest(range(0, len(t), {STEP})) AS s FROM toks),
chunks AS (
  SELECT doc_id::VARCHAR || '_chunk_' || (s // {STEP}) AS chunk_id, doc_id::VARCHAR AS doc_id,
         (s // {STEP})::BIGINT AS chunk_index, array_to_string(t[s+1:s+{CHUNK_SIZE}], '') AS text,
         least(len(t) - s, {CHUNK_SIZE})::BIGINT AS token_count, s::BIGINT AS start_token,
         least(len(t), s + {CHUNK_SIZE})::BIGINT AS end_token
  FROM starts)
"""


def event_log(spark: SparkSession, d: str) -> DataFrame:
    """The events table as a query log: errors are failed queries, ``k`` names source documents."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    failed = F.when(F.col("event_type") == "error", F.lit("execution failed"))
    return load(spark, d, "events").select(
        F.concat(F.lit("q"), F.col("event_id").cast("string")).alias("query_id"),
        F.concat(F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string")).alias("question"),
        F.concat(F.lit("SELECT * FROM t WHERE k = "), k.cast("string")).alias("sql_executed"),
        F.array(k.cast("string"), (k * 7).cast("string")).alias("source_docs"),
        F.col("ts").alias("executed_at"),
        F.col("value").alias("execution_time_ms"),
        failed.alias("error"),
    )


LOG_SQL = r"""
ks AS (SELECT *, regexp_extract(props, '(\d+)', 1)::BIGINT AS k FROM events),
log AS (
  SELECT 'q' || event_id AS query_id, event_type || ' of user ' || user_id AS question,
         'SELECT * FROM t WHERE k = ' || k AS sql_executed, k::VARCHAR AS src1, (k * 7)::VARCHAR AS src2,
         ts AS executed_at, value AS execution_time_ms,
         CASE WHEN event_type = 'error' THEN 'execution failed' END AS error
  FROM ks),
uses AS (SELECT query_id, question, executed_at, src1 AS doc_id FROM log
         UNION SELECT query_id, question, executed_at, src2 FROM log)
"""


def stamp(column: str) -> Column:
    return F.date_format(column, "yyyy-MM-dd HH:mm:ss")


def six(name: str) -> Column:
    """Six digits. The nudge keeps values that lie just between two roundings from
    depending on the order of summation; the checking SQL does the same."""
    return F.round(F.col(name) + 1e-9, 6)


def joined(column: Column | str, separator: str = ",") -> Column:
    return F.array_join(column, separator)


__all__ = [
    "CHUNKS_SQL", "DOCS_SQL", "LOG_SQL", "ORACLES", "QUERIES", "chunks", "documents", "event_log",
    "ids", "joined", "load", "orders", "query", "six", "spread", "stamp",
]
