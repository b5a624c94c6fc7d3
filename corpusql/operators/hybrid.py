"""Narrow a corpus by a structured filter, then read the text of what is left."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.operators.chunking import BLANK_LINE, numbered_context, reassemble
from corpusql.operators.ranks import numbered
from corpusql.session import materialize

MAX_DOCUMENTS = 10
DOC_CHARS, CONTEXT_CHARS = 5000, 15000

# Fixed value: the answer when the filter leaves nothing.
NO_DOCUMENTS = "No relevant documents found for your query."
FOUND_CONFIDENCE = 0.8

# Layout of the context: a heading per document, and what stands between documents.
HEADING = "[Document %d]"
SEPARATOR = BLANK_LINE + "---" + BLANK_LINE
SEGMENT_CHUNKS = 1000


def filter_doc_ids(rows: DataFrame) -> DataFrame:
    """Ids in result rows: doc_id, else document_id, else id; as text, empties dropped."""
    present = [c for c in ("doc_id", "document_id", "id") if c in rows.columns]
    if not present:
        return rows.select(F.lit(None).cast("string").alias("doc_id")).filter(F.lit(False))
    named = [F.nullif(F.col(c).cast("string"), F.lit("")) for c in present]
    ids = rows.select(F.coalesce(*named).alias("doc_id"))
    return ids.filter(F.col("doc_id").isNotNull())


def narrow_corpus(
    documents: DataFrame,
    matches: DataFrame | None,
    max_documents: int | None = MAX_DOCUMENTS,
    order_by: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """Documents named by ``matches`` (all when None), at most ``max_documents``.

    ``matches`` is reduced to distinct ids first; the semi join never multiplies
    rows. Pass ``max_documents=None`` to keep the whole filtered corpus.
    """
    kept = documents
    if matches is not None:
        kept = documents.join(matches.select("doc_id").distinct(), "doc_id", "left_semi")
    return kept if max_documents is None else kept.orderBy(*order_by).limit(max_documents)


def hybrid_context(
    chunks: DataFrame,
    narrowed: DataFrame,
    doc_chars: int | None = DOC_CHARS,
    total_chars: int | None = CONTEXT_CHARS,
    max_documents: int = MAX_DOCUMENTS,
) -> DataFrame:
    """One row: numbered context over the narrowed documents, with their number.

    With no document the row says so and has confidence zero. The limits are those of a
    prompt; the text itself is never changed in the tables. One of the character limits may be None. A context over any number of
    whole documents is no single value: ``hybrid_blocks`` gives its rows.
    """
    longest = doc_chars if doc_chars is not None else total_chars
    if longest is None or max_documents is None:
        raise ValueError("a context in one value needs a limit of documents and of characters; see hybrid_blocks")
    wanted = narrowed.select("doc_id").distinct()
    texts = reassemble(chunks.join(wanted, "doc_id", "left_semi"), max_chars=longest)
    context = numbered_context(
        texts, ["doc_id"], max_documents, doc_chars=doc_chars, total_chars=total_chars
    )
    return context.select(
        "documents",
        F.when(F.col("documents") > 0, F.col("context")).otherwise(NO_DOCUMENTS).alias("context"),
        F.when(F.col("documents") > 0, F.lit(FOUND_CONFIDENCE)).otherwise(F.lit(0.0)).alias("confidence"),
    )


def hybrid_blocks(
    chunks: DataFrame,
    narrowed: DataFrame,
    order_by: Sequence[str] = ("doc_id",),
    segment_chunks: int = SEGMENT_CHUNKS,
    heading: str = HEADING,
) -> DataFrame:
    """(document, segment, doc_id, chunks, block): the numbered context over all narrowed documents, without any limit.

    The blocks in the order of ``document`` (from 1, by ``order_by``, columns of ``narrowed``) and ``segment``, put one behind the
    other, are the whole context: the first segment of a document brings the separator and its heading along, later
    ones the blank line between chunks. Documents without text have no number, as in ``hybrid_context``.

    Only ids are numbered, by range partitions. Texts are shuffled once, by document and segment of ``segment_chunks`` chunk numbers, so
    neither the corpus nor a long document is ever one group.
    """
    part = F.col("chunk_index").cast("long")
    pieces = chunks.filter(F.length("text") > 0).select(
        "doc_id", F.floor(part / segment_chunks).alias("segment"), part.alias("i"), F.col("text").alias("t")
    )
    others = [c for c in order_by if c != "doc_id"]
    wanted = narrowed.groupBy("doc_id").agg(F.count("*").alias("_n"), *[F.min(c).alias(f"_by_{c}") for c in others])
    segments = materialize(pieces.select("doc_id", "segment").distinct().join(wanted, "doc_id"), "segments")
    # The least segment with text stands for the document: one row each, small beside the texts.
    first = segments.groupBy("doc_id", "_n", *[f"_by_{c}" for c in others]).agg(F.min("segment").alias("first"))
    order = [F.col(c if c == "doc_id" else f"_by_{c}") for c in order_by] + [F.col("doc_id")]
    numbers = numbered(materialize(first.withColumn("all", F.lit(0)), "documents"), "all", order, "document", "documents")
    keys = segments.select("doc_id", "segment").join(
        numbers.select("doc_id", (F.col("document") + 1).alias("document"), "first"), "doc_id"
    )
    gathered = pieces.join(keys, ["doc_id", "segment"]).groupBy("doc_id", "segment", "document", "first").agg(
        F.array_sort(F.collect_list(F.struct("i", "t"))).alias("parts")
    )
    text = F.array_join(F.transform("parts", lambda p: p["t"]), BLANK_LINE)
    opening = F.concat(
        F.when(F.col("document") > 1, F.lit(SEPARATOR)).otherwise(F.lit("")), F.format_string(heading + "\n", F.col("document"))
    )
    lead = F.when(F.col("segment") == F.col("first"), opening).otherwise(F.lit(BLANK_LINE))
    return gathered.select(
        "document", "segment", "doc_id", F.size("parts").alias("chunks"), F.concat(lead, text).alias("block")
    )


def document_metadata(documents: DataFrame, narrowed: DataFrame, columns: Sequence[str | Column]) -> DataFrame:
    return documents.join(narrowed.select("doc_id").distinct(), "doc_id", "left_semi").select(
        "doc_id", *columns
    )
