from datetime import datetime

import pytest
from pyspark.sql import functions as F

from corpusql.catalog import stream_queries
from corpusql.streaming import incremental as inc


def test_ingest_is_incremental_and_idempotent(spark, tmp_path):
    inbox, out = tmp_path / "in", tmp_path / "out"
    schema = "doc_id string, text string"
    spark.createDataFrame([("a", "one two"), ("b", "three")], schema).write.parquet(str(inbox / "p1"))

    def run(checkpoint):
        stream = inc.read_stream(spark, f"{inbox}/*", spark.createDataFrame([], schema).schema)
        inc.stream_ingest(stream, str(out), str(tmp_path / checkpoint)).awaitTermination()
        docs = spark.read.parquet(str(out / "documents"))
        return sorted(r.doc_id for r in docs.collect()), spark.read.parquet(str(out / "chunks")).count()

    assert run("c1") == (["a", "b"], 2)
    spark.createDataFrame([("b", "three"), ("c", "x y z")], schema).write.parquet(str(inbox / "p2"))
    assert run("c1") == (["a", "b", "c"], 3)
    assert run("c2") == (["a", "b", "c"], 3)


def test_batches_do_not_read_the_tables(spark, tmp_path, monkeypatch):
    """Ids are state of the stream: the tables are looked at when a run starts, however many batches follow."""
    inbox, out = tmp_path / "in", tmp_path / "out"
    for i in range(4):
        rows = [(f"d{k}", f"text {k}") for k in range(3 * i, 3 * i + 5)] + [("d0", "text 0")]
        spark.createDataFrame(rows, "doc_id string, text string").coalesce(1).write.parquet(str(inbox / f"p{i}"))
    looked = []
    monkeypatch.setattr(inc, "read_if_present", lambda s, path: looked.append(path))
    stream = inc.read_stream(spark, f"{inbox}/*", spark.read.parquet(f"{inbox}/*").schema, max_files_per_trigger=1)
    query = inc.stream_ingest(stream, str(out), str(tmp_path / "c"))
    query.awaitTermination()
    docs = spark.read.parquet(str(out / "documents"))
    assert sorted(r.doc_id for r in docs.collect()) == sorted(f"d{k}" for k in range(14))
    assert docs.select("batch").distinct().count() == 4 and len(looked) == 1
    assert spark.conf.get(inc.STATE_STORE, None) in (None, inc.DEFAULT_STORE)


def events(spark, path, *rows):
    made = spark.createDataFrame(list(rows), "executed_at timestamp, execution_time_ms double, error string")
    made.coalesce(1).write.mode("append").parquet(path)


def test_metrics_over_batches_and_late_rows(spark, tmp_path):
    path = str(tmp_path / "log")
    at = lambda h, m: datetime(2024, 1, 1, h, m)
    events(spark, path, (at(0, 1), 10.0, None), (at(0, 2), 20.0, "x"), (at(0, 11), 5.0, None))
    schema = spark.read.parquet(path).schema

    def run():
        log = inc.read_stream(spark, path, schema, max_files_per_trigger=1)
        made = inc.run_updates(inc.query_metrics(log), ["period_start"], "metrics")
        return {r.period_start: (r.total_queries, r.successful_queries, r.avg_execution_time_ms) for r in made.collect()}

    first = run()
    assert first == {at(0, 0): (2, 1, 15.0), at(0, 10): (1, 1, 5.0)}
    events(spark, path, (at(5, 0), 1.0, None))
    events(spark, path, (at(0, 3), 100.0, None))
    assert run()[at(5, 0)] == (1, 1, 1.0)


def test_statistics_per_key(spark, tmp_path):
    path = str(tmp_path / "rows")
    rows = [(datetime(2024, 1, d, 3), k, v) for d in (1, 2) for k, v in (("a", 1.0), ("a", 3.0), ("b", None), ("b", 0.0))]
    spark.createDataFrame(rows, "ts timestamp, k string, v double").write.parquet(path)
    stream = inc.read_stream(spark, path, spark.read.parquet(path).schema)
    made = inc.run_updates(inc.refresh_statistics(stream, "ts", "v", ["k"], "1 day", "1 day"), ["period_start", "k"], "stats")
    got = {(r.period_start.day, r.k): r for r in made.collect()}
    assert set(got) == {(1, "a"), (2, "a"), (1, "b"), (2, "b")}
    a, b = got[1, "a"], got[2, "b"]
    assert (a.total_count, a.mean, a.min, a.max, a.approx_unique) == (2, 2.0, 1.0, 3.0, 2)
    assert (b.total_count, b.non_null_count, b.non_zero_count) == (2, 1, 0)


def test_timestamp_without_zone_is_accepted(spark, tmp_path):
    path = str(tmp_path / "ntz")
    rows = spark.createDataFrame([("2024-01-01 00:00:00", 1.0)], "t string, v double")
    rows.select(F.col("t").cast("timestamp_ntz").alias("ts"), "v").write.parquet(path)
    stream = inc.read_stream(spark, path, spark.read.parquet(path).schema)
    made = inc.run_updates(inc.refresh_statistics(stream, "ts", "v", [], "1 hour", "1 hour"), ["period_start"], "ntz")
    assert made.count() == 1


@pytest.mark.parametrize("folder", [False, True])
def test_tables_of_one_or_many_files_are_streamed(spark, tmp_path, folder):
    """A table may be a single file or a folder of part files; the queries stream every row of either."""
    documents = spark.createDataFrame(
        [(i, f"word{i} two three", "en", "web", 15) for i in range(40)], "doc_id long, text string, lang string, source string, n_chars long"
    )
    events = spark.createDataFrame(
        [(i, datetime(2024, 1, 1 + i % 2, 3), "error" if i % 4 else "view", float(i)) for i in range(40)],
        "event_id long, ts timestamp, event_type string, value double",
    )
    for name, rows in (("documents", documents), ("events", events)):
        rows.repartition(3 if folder else 1).write.parquet(str(tmp_path / (name if not folder else f"{name}.parquet")))
        if not folder:
            next((tmp_path / name).glob("part-*.parquet")).rename(tmp_path / f"{name}.parquet")
    got = stream_queries.stream_ingest(spark, str(tmp_path)).collect()
    assert sorted(int(r.doc_id) for r in got) == list(range(40)) and {(r.chunks, r.tokens) for r in got} == {(1, 3)}
    assert sum(r.total_count for r in stream_queries.stream_statistics(spark, str(tmp_path)).collect()) == 40
    assert sum(r.total_queries for r in stream_queries.stream_query_metrics(spark, str(tmp_path)).collect()) == 40
