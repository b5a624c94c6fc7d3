"""Documents to entity tables in one path, and questions to rows, sources and a log entry in one path."""

from __future__ import annotations

import time
from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.operators import extract as ex
from corpusql.operators import provenance as pv
from corpusql.operators import schema as sc
from corpusql.operators.model import Complete, rule_based_extractor
from corpusql.plans import relational as rel
from corpusql.session import materialize
from corpusql.sources.tables import read_if_present

MAX_ATTRIBUTES = 10_000


def build_structure(
    chunks: DataFrame,
    entities: Sequence[str],
    out: str,
    complete: Complete = rule_based_extractor,
    min_confidence: float = sc.MIN_CONFIDENCE,
    doc_col: str = "doc_id",
    chunk_col: str = "chunk_id",
    text_col: str = "text",
) -> DataFrame:
    """Induce, filter by confidence, ensure a key, extract, conform and store, for all entities; returns the attribute rows.

    ``chunks`` are documents or chunks with their ids. Tables go to ``<out>/<entity>`` with
    document id and ``source_chunk_id`` in every row, misfits to ``<out>/<entity>_rejects``. Running it again
    adds nothing. The attribute rows are bounded by the labels of the corpus that are frequent
    enough; more than MAX_ATTRIBUTES are an error.
    """
    values = sc.labelled_values(chunks, doc_col, text_col)
    found = None
    for entity in entities:
        one = sc.induce_attributes(values, chunks, entity)
        found = one if found is None else found.unionByName(one)
    attributes = sc.ensure_primary_key(sc.confidence_filter(found, min_confidence))
    rows = [r.asDict() for r in attributes.limit(MAX_ATTRIBUTES + 1).collect()]
    if len(rows) > MAX_ATTRIBUTES:
        raise ValueError(f"more than {MAX_ATTRIBUTES} attributes")
    declared = {e: [r for r in rows if r["entity"] == e] for e in entities}
    types = {
        e: {r["name"]: r["type"] for r in declared[e] if not r["is_primary_key"]} for e in entities
    }
    wanted = {e: t for e, t in types.items() if t}
    sourced = chunks.withColumn("source_chunk_id", F.col(chunk_col))
    made, _, _ = ex.extract_corpus(
        sourced, wanted, complete, doc_col, text_col, min_confidence, keep=["source_chunk_id"]
    )
    for entity in wanted:
        # The chunk tells apart the entities of one document.
        own = made.filter(F.col("entity") == entity).withColumn("doc_id", F.col(doc_col).cast("string"))
        ex.conform_and_store(own, entity, declared[entity], out)
    return attributes


def entity_tables(spark: SparkSession, out: str, entities: Sequence[str]) -> dict[str, DataFrame]:
    """The stored tables by lower-cased name; those that do not exist are left out."""
    found = {e.lower(): read_if_present(spark, f"{out}/{e.lower()}") for e in entities}
    return {name: df for name, df in found.items() if df is not None}


def _stored(rows: DataFrame) -> DataFrame:
    """The rows written once; any column names and columns without a type are allowed."""
    names = [f"c{i}" for i in range(len(rows.columns))]
    kinds = [f.dataType for f in rows.schema]
    plain = rows.toDF(*names).select(*[
        F.col(n).cast("string").alias(n) if isinstance(k, T.NullType) else F.col(n) for n, k in zip(names, kinds)
    ])
    return materialize(plain, "result").toDF(*rows.columns)


def query_structured(
    spark: SparkSession,
    question: str,
    sql: str,
    tables: Mapping[str, DataFrame],
    chunks: DataFrame,
    documents: DataFrame,
    log_path: str | None = None,
    source_limit: int | None = None,
) -> tuple[DataFrame | None, DataFrame | None, DataFrame]:
    """Safety check, SQL, rows, source documents and log row: (rows, sources, log).

    The statement runs once: its rows are written to the shared folder, and what is returned, the sources and the log come from
    there. A statement that is not allowed, cannot be planned or fails while it runs is logged with its error and has
    neither rows nor sources; the time logged is that of the run. Rows without document or chunk ids have no sources. The log
    keeps at most 100 source ids of a query, as a record of where to look; ``sources`` has all.
    """
    started = time.time()
    rows = sources = None
    error = None
    listed: list[str] = []
    try:
        rows = _stored(rel.run_sql(spark, sql, tables))
        spent = time.time() - started
        if {"doc_id", "chunk_id", "source_chunk_id"}.intersection(rows.columns):
            sources = pv.result_sources(rows, chunks, documents, source_limit, columns=[])
            listed = [r["doc_id"] for r in sources.orderBy("doc_id").limit(100).collect()]
    except Exception as problem:  # a failed query is part of the log
        error, spent = f"{type(problem).__name__}: {str(problem)[:500]}", time.time() - started
        rows = sources = None
    one = spark.createDataFrame(
        [(question, sql, listed, spent * 1000, error)],
        "question string, sql string, docs array<string>, ms double, error string",
    )
    log = pv.log_rows(
        one, F.col("question"), F.col("sql"), F.struct("sql"), F.col("docs"), F.current_timestamp(), F.col("ms"), F.col("error")
    )
    if log_path is not None:
        pv.append_log(log, log_path)
    return rows, sources, log
