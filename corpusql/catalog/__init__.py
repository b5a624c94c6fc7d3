"""Registered queries: each operator on the test tables, next to the SQL that checks it."""

from corpusql.catalog import (  # noqa: F401  (importing registers the queries)
    chunk_queries,
    documented_queries,
    extract_queries,
    hybrid_queries,
    index_queries,
    model_queries,
    provenance_queries,
    question_queries,
    schema_queries,
    source_queries,
    stats_queries,
    stream_queries,
    structure_queries,
)
from corpusql.catalog.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
