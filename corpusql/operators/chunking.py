"""Documents to chunks and back."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions import ids
from corpusql.functions import text as tx
from corpusql.functions.binding import let

CHUNK_SIZE, OVERLAP = 512, 50
BLANK_LINE = "\n\n"


def _check(size: int, overlap: int) -> int:
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("need 0 <= overlap < size")
    return size - overlap


def _windows(toks: Column, size: int, overlap: int) -> Column:
    """Windows over a token array; one starts every ``size - overlap`` tokens."""
    step = _check(size, overlap)
    total = F.size(toks)
    starts = F.when(total > 0, F.sequence(F.lit(0), total - 1, F.lit(step))).otherwise(
        F.array().cast("array<int>")
    )

    def window(start: Column) -> Column:
        return F.struct(
            (start / step).cast("int").alias("chunk_index"),
            F.array_join(F.slice(toks, start + 1, size), "").alias("text"),
            F.least(total - start, F.lit(size)).alias("token_count"),
            start.alias("start_token"),
            F.least(start + size, total).alias("end_token"),
        )

    return F.transform(starts, window)


def token_chunks(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    doc_col: str = "doc_id",
    text_col: str = "text",
    tokenizer: Callable[[Column], Column] = tx.tokens,
    keep: Sequence[str] = (),
) -> DataFrame:
    """Overlapping token windows; blank text gives no rows.

    ``tokenizer`` maps a text column to an array of strings whose concatenation
    is the text; a Pandas UDF with a byte-pair vocabulary fits as well. Only the
    id, ``keep`` and the windows leave the generator, so each document's tokens
    are held once, not once per window.
    """
    _check(size, overlap)
    built = let(tokenizer(F.col(text_col)), lambda t: _windows(t, size, overlap))
    rows = docs.select(doc_col, *keep, F.inline(built))
    return rows.select(
        ids.chunk_id(F.col(doc_col), F.col("chunk_index")).alias("chunk_id"),
        doc_col,
        "chunk_index",
        "text",
        "token_count",
        "start_token",
        "end_token",
        F.length("text").alias("char_count"),
        *keep,
    )


def sentence_chunks(
    docs: DataFrame,
    size: int = CHUNK_SIZE,
    overlap: int = OVERLAP,
    doc_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Greedy packing of sentences up to ``size`` tokens.

    A new chunk opens with the last two sentences of the previous one. A
    sentence longer than ``size`` closes the open chunk and is cut into token
    windows. The packing is a fold over the sentence array of one document.
    """
    _check(size, overlap)
    piece = "struct<s:string,n:int>"
    pieces = F.transform(
        tx.sentences(F.col(text_col)),
        lambda s: F.struct(s.alias("s"), tx.token_count(s).alias("n")),
    )
    start = F.struct(
        F.array().cast("array<string>").alias("done"),
        F.array().cast(f"array<{piece}>").alias("open"),
        F.lit(0).alias("size"),
    )

    def state(done: Column, opened: Column, total: Column) -> Column:
        return F.struct(done.alias("done"), opened.alias("open"), total.alias("size"))

    def joined(opened: Column) -> Column:
        return F.array_join(F.transform(opened, lambda p: p["s"]), " ")

    def closed(acc: Column) -> Column:
        return F.when(F.size(acc["open"]) == 0, acc["done"]).otherwise(
            F.concat(acc["done"], F.array(joined(acc["open"])))
        )

    def cut(sentence: Column) -> Column:
        return let(
            tx.tokens(sentence),
            lambda t: F.transform(_windows(t, size, overlap), lambda w: w["text"]),
        )

    def step(acc: Column, p: Column) -> Column:
        tail = F.slice(acc["open"], -F.least(F.size(acc["open"]), F.lit(2)), 2)
        carried = F.aggregate(tail, F.lit(0), lambda a, q: a + q["n"])
        return (
            F.when(
                p["n"] > size,
                state(
                    F.concat(closed(acc), cut(p["s"])),
                    F.array().cast(f"array<{piece}>"),
                    F.lit(0),
                ),
            )
            .when(
                acc["size"] + p["n"] <= size,
                state(acc["done"], F.concat(acc["open"], F.array(p)), acc["size"] + p["n"]),
            )
            .otherwise(state(closed(acc), F.concat(tail, F.array(p)), carried + p["n"]))
        )

    packed = F.aggregate(pieces, start, step, closed)
    rows = docs.select(doc_col, F.posexplode(packed).alias("chunk_index", "text"))
    return rows.select(
        ids.chunk_id(F.col(doc_col), F.col("chunk_index")).alias("chunk_id"),
        doc_col,
        "chunk_index",
        "text",
        tx.token_count(F.col("text")).alias("token_count"),
        F.length("text").alias("char_count"),
    )


def reassemble(
    chunks: DataFrame,
    doc_col: str = "doc_id",
    index_col: str = "chunk_index",
    text_col: str = "text",
    max_chars: int | None = None,
    segment_chunks: int = 1000,
    dedup_overlap: bool = False,
    overlap: int = OVERLAP,
) -> DataFrame:
    """Chunk texts in order, joined by a blank line.

    Without ``max_chars`` the whole text comes back, one row per ``segment``
    of ``segment_chunks`` chunks, so that no single group grows without bound;
    all but very long documents have the one segment 0. With ``max_chars``
    only chunks that can reach into the cut are gathered (each takes at least
    one character and the separator) and the text is one row.

    ``dedup_overlap`` drops the tokens a window shares with the one before it
    and joins with nothing, which gives back the original text.
    """
    separator = "" if dedup_overlap else BLANK_LINE
    body = F.col(text_col)
    if dedup_overlap:
        fresh = F.array_join(
            F.slice(tx.tokens(body), F.lit(overlap + 1), F.greatest(F.col("token_count"), F.lit(1))),
            "",
        )
        body = F.when(F.col(index_col) == 0, body).otherwise(fresh)
    part = F.col(index_col).cast("long")
    rows = chunks.filter(F.length(text_col) > 0)
    if max_chars is None:
        segment = F.floor(part / segment_chunks)
    else:
        shortest = 1 if dedup_overlap else 1 + len(separator)
        rows = rows.filter(part * shortest < max_chars)
        body = F.substring(body, 1, max_chars)
        segment = F.lit(0).cast("long")
    grouped = rows.groupBy(doc_col, segment.alias("segment")).agg(
        F.array_sort(F.collect_list(F.struct(part.alias("i"), body.alias("t")))).alias("parts")
    )
    full = F.array_join(F.transform("parts", lambda p: p["t"]), separator)
    if max_chars is not None:
        full = F.substring(full, 1, max_chars)
    return grouped.select(
        doc_col, "segment", F.size("parts").alias("chunks"), full.alias("text")
    )


def sample_documents(
    chunks: DataFrame, n: int, seed: str = "0", key_col: str = "chunk_id"
) -> DataFrame:
    """``n`` rows in an order that depends only on the seed and the key."""
    order = F.md5(F.concat_ws("|", F.lit(seed), F.col(key_col).cast("string")))
    return chunks.withColumn("sample_order", order).orderBy("sample_order", key_col).limit(n)


def numbered_context(
    docs: DataFrame,
    order_by: Sequence[str],
    max_docs: int | None,
    text_col: str = "text",
    group_cols: Sequence[str] = (),
    doc_chars: int | None = None,
    total_chars: int | None = None,
    heading: str = "[Document %d]",
    separator: str = BLANK_LINE + "---" + BLANK_LINE,
) -> DataFrame:
    """Numbered blocks of the first ``max_docs`` documents per group, joined.

    The number of documents is the operator's feature: it bounds every group
    before anything is gathered. With None all documents of a group become one text,
    for callers who know that it fits.
    """
    body = F.col(text_col) if doc_chars is None else F.substring(text_col, 1, doc_chars)
    if group_cols:
        order = W.partitionBy(*group_cols).orderBy(*order_by)
        first = docs.withColumn("n", F.row_number().over(order))
        first = first if max_docs is None else first.filter(F.col("n") <= max_docs)
    else:
        few = docs if max_docs is None else docs.orderBy(*order_by).limit(max_docs)
        first = few.withColumn("n", F.row_number().over(W.orderBy(*order_by)))
    block = F.concat(F.format_string(heading + "\n", F.col("n")), body)
    gathered = first.groupBy(*group_cols).agg(
        F.array_sort(F.collect_list(F.struct("n", block.alias("t")))).alias("parts")
    )
    context = F.array_join(F.transform("parts", lambda p: p["t"]), separator)
    if total_chars is not None:
        context = F.substring(context, 1, total_chars)
    return gathered.select(
        *group_cols, F.size("parts").alias("documents"), context.alias("context")
    )
