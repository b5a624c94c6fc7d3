"""Where results come from: sources, query log, lineage and audit."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions import ids
from corpusql.session import materialize
from corpusql.sources.tables import read_if_present

LINEAGE_QUERIES = 20
# Folders of the stored uses; a lookup opens those of its documents.
USE_BUCKETS = 64
RECENT_QUERIES = 10

LOG_SCHEMA = (
    "query_id string, question string, sql_executed string, result_json string, "
    "source_docs array<string>, executed_at timestamp, execution_time_ms double, error string"
)


def result_sources(
    results: DataFrame,
    chunks: DataFrame,
    documents: DataFrame,
    limit: int | None = None,
    columns: Sequence[str] = ("filename", "source_type"),
) -> DataFrame:
    """Documents behind result rows that carry chunk or document ids: all, or the first ``limit`` by id.

    Ids are made distinct before any join, and only ids travel until the
    documents are known. Rows that name their document need no chunk.
    """
    carried = [c for c in ("source_chunk_id", "chunk_id") if c in results.columns]
    if not carried and "doc_id" not in results.columns:
        raise ValueError("results carry no chunk id and no document id")
    named = None
    if carried:
        found = results.select(F.explode(F.array(*[F.col(c) for c in carried])).alias("chunk_id"))
        wanted = found.filter(F.col("chunk_id").isNotNull()).distinct()
        named = chunks.select("chunk_id", "doc_id").join(wanted, "chunk_id", "left_semi").select("doc_id")
    if "doc_id" in results.columns:
        direct = results.select("doc_id").filter(F.col("doc_id").isNotNull())
        named = direct if named is None else named.union(direct)
    docs = named.distinct()
    few = docs if limit is None else docs.orderBy("doc_id").limit(limit)
    return documents.join(few, "doc_id", "left_semi").select("doc_id", *columns)


def log_rows(
    runs: DataFrame,
    question: Column,
    sql: Column,
    result: Column,
    source_docs: Column,
    executed_at: Column,
    ms: Column,
    error: Column,
) -> DataFrame:
    """Query-log rows, failed queries included. The id is a digest of question and time."""
    stamp = F.date_format(executed_at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")
    return runs.select(
        ids.query_id(question, stamp).alias("query_id"),
        question.alias("question"),
        sql.alias("sql_executed"),
        F.when(error.isNull(), F.to_json(result)).alias("result_json"),
        source_docs.alias("source_docs"),
        executed_at.alias("executed_at"),
        ms.cast("double").alias("execution_time_ms"),
        error.alias("error"),
    )


def append_log(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def result_rows(results: DataFrame, query_id: str) -> DataFrame:
    """All rows of a result as JSON, keyed by the query: the part of the log that can be large."""
    return results.select(F.lit(query_id).alias("query_id"), F.to_json(F.struct("*")).alias("row_json"))


def trace_query(
    log: DataFrame,
    documents: DataFrame,
    query_id: str | None = None,
    columns: Sequence[str] = ("filename",),
) -> DataFrame:
    """Log rows with their source documents, one row per query and document.

    ``document_count`` counts the documents that exist. A query without sources
    keeps one row; an unknown id gives no row.
    """
    asked = log if query_id is None else log.filter(F.col("query_id") == query_id)
    base = ["query_id", "question", "sql_executed", "executed_at", "execution_time_ms"]
    used = asked.select(
        *base, F.explode_outer(F.array_distinct("source_docs")).alias("doc_id")
    )
    found = used.join(documents.select("doc_id", *columns, F.lit(1).alias("hit")), "doc_id", "left")
    # A window over the sources of one query, which one log row holds: no second join.
    counted = found.withColumn("document_count", F.count("hit").over(W.partitionBy("query_id")))
    return counted.filter(F.col("hit").isNotNull() | F.col("doc_id").isNull()).drop("hit")


def find_query(log: DataFrame, query_id: str) -> DataFrame:
    """The log row, or an error when the id is unknown."""
    row = log.filter(F.col("query_id") == query_id)
    if row.isEmpty():
        raise LookupError(f"query not found: {query_id}")
    return row


def _uses(log: DataFrame) -> DataFrame:
    return log.select(
        F.explode(F.array_distinct("source_docs")).alias("doc_id"),
        "query_id", "question", "executed_at",
    )


def document_queries(log: DataFrame, doc_id: str | None = None, n: int = LINEAGE_QUERIES) -> DataFrame:
    """The newest ``n`` queries per document."""
    if doc_id is not None:
        log = log.filter(F.array_contains("source_docs", doc_id))
    uses = _uses(log)
    if doc_id is not None:
        uses = uses.filter(F.col("doc_id") == doc_id)
    order = W.partitionBy("doc_id").orderBy(F.desc("executed_at"), "query_id")
    return uses.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def _use_bucket(doc_id: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(doc_id), F.lit(buckets)).cast("int")


def store_uses(rows: DataFrame, path: str, batch: int, buckets: int = USE_BUCKETS) -> None:
    """Which queries used a document, from the log rows of one write, next to the log.

    A batch holds the newest ``LINEAGE_QUERIES`` uses of each of its documents and, with each of them, the number of all: the newest
    over all batches are among these, so a document that every query uses adds no more than that. A batch that is
    written again replaces itself. All batches have the same number of ``buckets``.
    """
    uses = materialize(_uses(rows).filter(F.col("doc_id").isNotNull()), "uses")
    order = W.partitionBy("doc_id").orderBy(F.desc("executed_at"), "query_id")
    newest = uses.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= LINEAGE_QUERIES)
    counts = uses.groupBy("doc_id").agg(F.count(F.lit(1)).alias("total"))
    both = newest.join(counts, "doc_id").withColumns({"buckets": F.lit(buckets), "bucket": _use_bucket(F.col("doc_id"), buckets)})
    # A bucket of one batch is one file, sorted so that statistics leave most of it out; large ones are cut by size.
    placed = both.repartition("bucket").sortWithinPartitions("bucket", "doc_id")
    placed.write.mode("overwrite").option("maxRecordsPerFile", 5_000_000).partitionBy("bucket").parquet(f"{path}/batch={batch}")


def _stored_uses(spark: SparkSession, path: str, doc_ids: Sequence[str] | None) -> DataFrame:
    rows = read_if_present(spark, path)
    if rows is None:
        raise ValueError(f"no stored uses at {path}")
    if doc_ids is None:
        return rows
    first = rows.select("buckets").first()
    wanted = spark.createDataFrame([(d,) for d in doc_ids], "doc_id string")
    buckets = [r[0] for r in wanted.select(_use_bucket(F.col("doc_id"), first[0])).distinct().collect()] if first else []
    return rows.filter(F.col("bucket").isin(buckets) & F.col("doc_id").isin(list(doc_ids)))


def stored_document_queries(
    spark: SparkSession, path: str, doc_ids: Sequence[str] | None = None, n: int = LINEAGE_QUERIES
) -> DataFrame:
    """``document_queries`` of stored uses. For named documents only their folders are read, however long the log is."""
    if n > LINEAGE_QUERIES:
        raise ValueError(f"{LINEAGE_QUERIES} queries per document are stored")
    rows = _stored_uses(spark, path, doc_ids).select("doc_id", "query_id", "question", "executed_at")
    order = W.partitionBy("doc_id").orderBy(F.desc("executed_at"), "query_id")
    return rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)


def stored_use_counts(spark: SparkSession, path: str, doc_ids: Sequence[str] | None = None) -> DataFrame:
    """(doc_id, total_queries) over all batches."""
    rows = _stored_uses(spark, path, doc_ids).filter(F.col("rank") == 1)
    return rows.groupBy("doc_id").agg(F.sum("total").alias("total_queries"))


def document_lineage(
    documents: DataFrame,
    chunks: DataFrame,
    log: DataFrame,
    doc_id: str | None = None,
    n: int = LINEAGE_QUERIES,
    stored: str | None = None,
) -> DataFrame:
    """Long form: one row per chunk (in order) and per recent query of a document.

    With ``stored``, the path of stored uses, the log is not read. Rows are not packed into arrays, so a document with very many chunks stays
    spread over tasks. ``lineage_counts`` has the numbers.
    """
    if doc_id is not None:
        documents = documents.filter(F.col("doc_id") == doc_id)
        chunks = chunks.filter(F.col("doc_id") == doc_id)
    known = documents.select("doc_id")
    parts = chunks.join(known, "doc_id", "left_semi").select(
        "doc_id",
        F.lit("chunk").alias("item"),
        F.col("chunk_index").cast("bigint").alias("position"),
        F.col("chunk_id").alias("item_id"),
        F.col("token_count").cast("bigint").alias("token_count"),
    )
    if stored is None:
        queries = document_queries(log, doc_id, n)
    else:
        queries = stored_document_queries(documents.sparkSession, stored, None if doc_id is None else [doc_id], n)
    used = queries.join(known, "doc_id", "left_semi").select(
        "doc_id",
        F.lit("query").alias("item"),
        F.col("rank").cast("bigint").alias("position"),
        F.col("query_id").alias("item_id"),
        F.lit(None).cast("bigint").alias("token_count"),
    )
    return parts.unionByName(used)


def lineage_counts(documents: DataFrame, chunks: DataFrame, log: DataFrame, n: int = LINEAGE_QUERIES) -> DataFrame:
    """Chunks and queries per document; ``query_count`` is what the lineage lists."""
    none = F.lit(0).cast("bigint")
    per_chunk = chunks.groupBy("doc_id").agg(F.count(F.lit(1)).alias("chunk_count"))
    per_query = _uses(log).groupBy("doc_id").agg(F.count(F.lit(1)).alias("total_queries"))
    return (
        documents.join(per_chunk, "doc_id", "left")
        .join(per_query, "doc_id", "left")
        .withColumns(
            {
                "chunk_count": F.coalesce("chunk_count", none),
                "total_queries": F.coalesce("total_queries", none),
            }
        )
        .withColumn("query_count", F.least("total_queries", F.lit(n).cast("bigint")))
    )


def entity_provenance(
    entities: DataFrame,
    documents: DataFrame,
    table: str,
    entity_id: str | None = None,
    columns: Sequence[str] = ("filename", "source_type"),
) -> DataFrame:
    """Entity rows with their source document; an entity without one keeps its row."""
    key = f"{table}_id"
    rows = entities if entity_id is None else entities.filter(F.col(key) == entity_id)
    return rows.join(documents.select("doc_id", *columns), "doc_id", "left")


def audit_summary(documents: DataFrame, chunks: DataFrame, log: DataFrame) -> DataFrame:
    """One row. The document and chunk counts are single-value subqueries."""
    queries = log.agg(
        F.count(F.lit(1)).alias("total_queries"),
        F.count_if(F.col("error").isNull()).alias("successful_queries"),
        F.avg("execution_time_ms").alias("avg_execution_time_ms"),
    )
    return queries.withColumns(
        {
            "total_documents": documents.select(F.count(F.lit(1))).scalar(),
            "total_chunks": chunks.select(F.count(F.lit(1))).scalar(),
        }
    )


def recent_queries(log: DataFrame, n: int = RECENT_QUERIES) -> DataFrame:
    return (
        log.orderBy(F.desc("executed_at"), "query_id")
        .limit(n)
        .select("query_id", "question", "executed_at", F.col("error").isNotNull().alias("has_error"))
    )


def entity_table_counts(tables: Mapping[str, DataFrame | None]) -> DataFrame:
    """Rows per entity table; a table that could not be read is flagged, not fatal."""
    readable = {n: d for n, d in tables.items() if d is not None}
    parts = [
        df.agg(F.count(F.lit(1)).alias("row_count")).select(
            F.lit(name).alias("table_name"), "row_count", F.lit(True).alias("readable")
        )
        for name, df in readable.items()
    ]
    broken = [n for n, d in tables.items() if d is None]
    if broken and parts:
        spark = next(iter(readable.values())).sparkSession
        parts.append(
            spark.createDataFrame(
                [(n, None, False) for n in broken],
                "table_name string, row_count bigint, readable boolean",
            )
        )
    if not parts:
        rows = [(n, None, False) for n in broken]
        return SparkSession.active().createDataFrame(rows, "table_name string, row_count bigint, readable boolean")
    return reduce(DataFrame.unionByName, parts)


def audit_period(log: DataFrame, entities: int | Column = 0) -> DataFrame:
    """First and last query, number of queries, and entity total."""
    total = F.lit(entities) if isinstance(entities, int) else entities
    return log.agg(
        F.min("executed_at").alias("first_query"),
        F.max("executed_at").alias("last_query"),
        F.count(F.lit(1)).alias("total_queries"),
    ).withColumn("total_entities", total.cast("bigint"))


def frequent_queries(log: DataFrame, n: int = RECENT_QUERIES) -> DataFrame:
    counted = log.groupBy("question").agg(F.count(F.lit(1)).alias("n"))
    return counted.orderBy(F.desc("n"), "question").limit(n)
