"""L11-L13: streams over the table files, run until all available data is read."""

from pyspark.sql import functions as F

from corpusql.catalog.base import CHUNKS_SQL, load, query, six, stamp
from corpusql.session import shared_dir
from corpusql.streaming import incremental as inc


@query("stream_ingest", f"""
WITH {CHUNKS_SQL}
SELECT doc_id, lang, count(chunk_id)::BIGINT AS chunks, sum(token_count)::BIGINT AS tokens
FROM chunks JOIN (SELECT doc_id::VARCHAR AS doc_id, lang FROM documents) USING (doc_id) GROUP BY ALL
""")
def stream_ingest(spark, d):
    """The documents file as a stream, ingested twice: the second run adds nothing."""
    schema = load(spark, d, "documents").schema
    out = shared_dir(spark, "stream")
    for run in ("first", "second"):
        rows = inc.read_table_stream(spark, f"{d}/documents.parquet", schema)
        query = inc.stream_ingest(rows, out, f"{out}/checkpoint-{run}", doc_columns=["doc_id", "lang"])
        query.awaitTermination()
    docs = spark.read.parquet(f"{out}/documents")
    chunks = spark.read.parquet(f"{out}/chunks")
    counts = chunks.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("chunks"), F.sum("token_count").alias("tokens")
    )
    return docs.join(counts, "doc_id").select(
        F.col("doc_id").cast("string"), "lang", "chunks", F.col("tokens").cast("bigint")
    )


@query("stream_statistics", """
SELECT strftime(date_trunc('day', ts), '%Y-%m-%d %H:%M:%S') AS period_start, event_type, count(*)::BIGINT AS total_count,
  count(value)::BIGINT AS non_null_count, round(avg(value) + 1e-9, 6) AS mean, min(value) AS min, max(value) AS max,
  count(*) FILTER (value <> 0)::BIGINT AS non_zero_count FROM events GROUP BY ALL
""")
def stream_statistics(spark, d):
    rows = inc.read_table_stream(spark, f"{d}/events.parquet", load(spark, d, "events").schema)
    stats = inc.refresh_statistics(rows, "ts", "value", ["event_type"], "1 day", "1 day").drop("approx_unique")
    made = inc.run_updates(stats, ["period_start", "event_type"], "stream-statistics")
    return made.withColumns({"period_start": stamp("period_start"), "mean": six("mean")})


@query("stream_query_metrics", """
SELECT strftime(time_bucket(INTERVAL '10 minutes', ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M:%S') AS period_start, count(*)::BIGINT AS total_queries,
  count(*) FILTER (event_type <> 'error')::BIGINT AS successful_queries, round(avg(value) + 1e-9, 6) AS avg_execution_time_ms
FROM events GROUP BY 1
""")
def stream_query_metrics(spark, d):
    rows = inc.read_table_stream(spark, f"{d}/events.parquet", load(spark, d, "events").schema)
    log = rows.select(
        F.col("ts").alias("executed_at"), F.col("value").alias("execution_time_ms"),
        F.when(F.col("event_type") == "error", F.lit("failed")).alias("error"),
    )
    made = inc.run_updates(inc.query_metrics(log), ["period_start"], "stream-metrics")
    return made.withColumns(
        {"period_start": stamp("period_start"), "avg_execution_time_ms": six("avg_execution_time_ms")}
    )
