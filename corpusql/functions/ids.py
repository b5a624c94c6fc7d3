"""Stable identifiers for documents, chunks, queries and entity rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

ID_LENGTH = 16


def _short_md5(*parts: Column) -> Column:
    return F.substring(F.md5(F.concat_ws("_", *parts)), 1, ID_LENGTH)


def doc_id(filename: Column, path: Column) -> Column:
    return _short_md5(filename, path)


def query_id(question: Column, asked_at: Column) -> Column:
    """``asked_at`` is the ISO text of the moment the question was asked."""
    return _short_md5(question, asked_at)


def chunk_id(doc: Column, index: Column) -> Column:
    return F.concat(doc.cast("string"), F.lit("_chunk_"), index.cast("string"))


def entity_id(*parts: Column) -> Column:
    """Key of an extracted row: the same source and ordinal give the same key."""
    return _short_md5(*[p.cast("string") for p in parts])
