"""Streams over files and logs, with results that survive restarts."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from corpusql.operators.chunking import CHUNK_SIZE, OVERLAP, token_chunks
from corpusql.session import materialize, shared_dir
from corpusql.sources.tables import leave_out, read_if_present

STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
DEFAULT_STORE = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"


def read_stream(
    spark: SparkSession,
    folder: str,
    schema: T.StructType,
    glob: str = "*.parquet",
    max_files_per_trigger: int | None = None,
    fmt: str = "parquet",
) -> DataFrame:
    reader = spark.readStream.schema(schema).format(fmt).option("pathGlobFilter", glob)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(folder)


def read_table_stream(spark: SparkSession, table: str, schema: T.StructType) -> DataFrame:
    """A Parquet table as a stream, be it one file or a folder of part files.

    Only a pattern may stand for either: a plain path must be a folder, and a filter on
    names would be compared with those of the part files.
    """
    folder, _, name = table.rpartition("/")
    return read_stream(spark, f"{folder}/{{{name}}}", schema, glob="*")


def stream_ingest(
    docs: DataFrame,
    out: str,
    checkpoint: str,
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    doc_columns: Sequence[str] = ("doc_id",),
) -> StreamingQuery:
    """New documents of a stream to the ``documents`` and ``chunks`` tables.

    Every micro-batch owns one partition of each table and overwrites it, so a
    batch repeated after a failure replaces its own rows. Which ids this run has seen is keyed state of the stream, in a
    RocksDB store per partition with its changes in the checkpoint: a batch looks up its own ids and nothing else, so
    its cost does not grow with the tables, which are neither listed nor read. Only when it starts, a run looks once for
    documents of other runs; their ids are left out as well. Of rows that share an id within a batch one stays.
    """
    run = hashlib.md5(checkpoint.encode()).hexdigest()[:8]
    spark = docs.sparkSession
    stored = read_if_present(spark, f"{out}/documents")
    others = None
    if stored is not None:
        others = materialize(stored.filter(~F.col("batch").startswith(f"{run}-")).select("doc_id").distinct(), "known-ids")
        others = None if others.isEmpty() else others

    def write(batch: DataFrame, number: int) -> None:
        own = f"{run}-{number}"
        fresh = leave_out(batch, others, "doc_id").persist()
        try:
            token_chunks(fresh, size, overlap).write.mode("overwrite").parquet(
                f"{out}/chunks/batch={own}"
            )
            fresh.select(*doc_columns).write.mode("overwrite").parquet(
                f"{out}/documents/batch={own}"
            )
        finally:
            fresh.unpersist()

    with _setting(spark, STATE_STORE, ROCKSDB):
        return (
            docs.dropDuplicates(["doc_id"]).writeStream.foreachBatch(write)
            .option("checkpointLocation", checkpoint)
            .trigger(availableNow=True)
            .start()
        )


@contextmanager
def _setting(spark: SparkSession, key: str, value: str) -> Iterator[None]:
    """A session setting for a query that starts inside; a choice made elsewhere wins."""
    if spark.conf.get(key, None) not in (None, DEFAULT_STORE):
        yield
        return
    before = spark.conf.get(key, None)
    spark.conf.set(key, value)
    try:
        yield
    finally:
        spark.conf.set(key, before) if before else spark.conf.unset(key)


def refresh_statistics(
    rows: DataFrame, time_col: str, value_col: str, keys: Sequence[str], delay: str, period: str
) -> DataFrame:
    """Mergeable statistics per key and period; rows later than ``delay`` are dropped.

    Distinct values are a sketch: an exact count would keep every value as state.
    """
    value = F.col(value_col)
    timed = rows.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return (
        timed.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, period), *keys)
        .agg(
            F.count(F.lit(1)).alias("total_count"),
            F.count(value).alias("non_null_count"),
            F.avg(value).alias("mean"),
            F.min(value).alias("min"),
            F.max(value).alias("max"),
            F.count_if(value != 0).alias("non_zero_count"),
            F.approx_count_distinct(value).alias("approx_unique"),
        )
        .withColumn("period_start", F.col("window.start"))
        .drop("window")
    )


def query_metrics(
    log: DataFrame, time_col: str = "executed_at", delay: str = "10 minutes", period: str = "10 minutes"
) -> DataFrame:
    """Queries, failures and mean time per tumbling period of the query log."""
    timed = log.withColumn(time_col, F.col(time_col).cast("timestamp"))
    return (
        timed.withWatermark(time_col, delay)
        .groupBy(F.window(time_col, period))
        .agg(
            F.count(F.lit(1)).alias("total_queries"),
            F.count_if(F.col("error").isNull()).alias("successful_queries"),
            F.avg("execution_time_ms").alias("avg_execution_time_ms"),
        )
        .withColumn("period_start", F.col("window.start"))
        .drop("window")
    )


def run_updates(stream: DataFrame, keys: Sequence[str], label: str) -> DataFrame:
    """Run an aggregating stream over what is available; the newest row per key comes back.

    Update mode also emits windows that are still open. Each batch is written to
    its own folder, overwritten when the batch is repeated.
    """
    spark = stream.sparkSession
    out = shared_dir(spark, label)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/rows/batch={number}")

    query = (
        stream.writeStream.outputMode("update")
        .foreachBatch(write)
        .option("checkpointLocation", f"{out}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    schema = T.StructType([*stream.schema.fields, T.StructField("batch", T.LongType())])
    rows = spark.read.schema(schema).parquet(f"{out}/rows")
    rest = [c for c in stream.columns if c not in keys]
    newest = F.max_by(F.struct(*rest), "batch").alias("r")
    return rows.groupBy(*keys).agg(newest).select(*keys, *[f"r.{c}" for c in rest])
