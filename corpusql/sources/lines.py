"""Lines of files of any size, numbered: several tasks read one file, and no file is ever one value."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.functions import ids
from corpusql.functions import text as tx
from corpusql.operators.chunking import CHUNK_SIZE, OVERLAP
from corpusql.sources.listing import Listing, read_lines


def runs(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """Where in a batch of lines a new (location, block) starts, and where it ends."""
    place = batch.column("location").dictionary_encode().indices.to_numpy()
    block = batch.column("block").to_numpy()
    new = np.flatnonzero((np.diff(place) != 0) | (np.diff(block) != 0)) + 1
    starts = np.concatenate([[0], new])
    return starts, np.append(new, batch.num_rows)


def placed_lines(lines: DataFrame) -> DataFrame:
    """``lines`` (location, block, text, n) with ``at``, the line's number in its block, and ``upto``, the sum of ``n`` of the block's lines before it."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held, total = None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy()
            at, upto = np.empty(batch.num_rows, np.int64), np.empty(batch.num_rows, np.int64)
            for a, b in zip(*runs(batch)):
                key = (batch.column("location")[a].as_py(), batch.column("block")[a].as_py())
                if key != last:
                    last, held, total = key, 0, 0
                at[a:b] = np.arange(held, held + b - a)
                sums = total + np.cumsum(n[a:b])
                upto[a:b] = sums - n[a:b]
                held, total = held + b - a, int(sums[-1])
            yield batch.append_column("at", pa.array(at)).append_column("upto", pa.array(upto))

    return lines.mapInArrow(count, "location string, block long, text string, n long, at long, upto long")


def long_text_files(files: Listing, extensions: Sequence[str], larger_than: int) -> DataFrame:
    """(location, block, lines, tokens, bytes, chars, invalid) of the blocks of large text files: some hundred bytes for a block's millions."""
    lines = read_lines(files, extensions, larger_than)
    return lines.groupBy("location", "block").agg(
        F.count("*").alias("lines"), F.sum(tx.token_count(F.col("text")).cast("long")).alias("tokens"),
        F.sum(F.octet_length("text")).alias("bytes"), F.sum(F.length("text")).alias("chars"),
        F.count_if(F.col("text").isNull()).alias("invalid"),
    )


def long_text_chunks(
    listed: Listing, extensions: Sequence[str], larger_than: int, files: DataFrame, blocks: DataFrame,
    size: int = CHUNK_SIZE, overlap: int = OVERLAP,
) -> DataFrame:
    """The rows of ``token_chunks`` for text files too large for one value: the same windows, read by many tasks.

    ``files`` (location, doc_id, file_size) says which files, ``blocks`` is ``long_text_files`` of them. Token numbers come from sums per
    block. Each line gives each window it reaches into a piece; a window is put together
    from its pieces, so a group holds ``size`` tokens. White space behind a line's last token goes to the windows of the next token, that
    at the end of the file to those of the last one. One line must fit into a value.
    """
    if size < 1 or overlap < 0 or overlap >= size:
        raise ValueError("need 0 <= overlap < size")
    step = size - overlap
    of_file, earlier = W.partitionBy("location"), W.partitionBy("location").orderBy("block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.join(files.select("location", "doc_id", "file_size"), "location").select(
        "location", "block", "doc_id",
        F.coalesce(F.sum("tokens").over(earlier), F.lit(0)).alias("tokens_before"),
        F.coalesce(F.sum("lines").over(earlier), F.lit(0)).alias("lines_before"),
        F.sum("tokens").over(of_file).alias("total"), F.sum("lines").over(of_file).alias("all_lines"),
        (F.col("file_size") - F.sum("bytes").over(of_file) - F.sum("lines").over(of_file) + 1).alias("feeds"),
    )
    lines = read_lines(listed, extensions, larger_than, files)
    counted = lines.select("location", "block", "text", tx.token_count(F.col("text")).cast("long").alias("n"))
    placed = placed_lines(counted).join(offsets, ["location", "block"]).filter("total > 0")
    line = F.col("lines_before") + F.col("at")
    first = F.col("tokens_before") + F.col("upto")
    # The line feed before a line is white space before its first token; a feed at the end of the file stands behind the last line.
    body = F.concat(
        F.when(line > 0, F.lit("\n")).otherwise(F.lit("")), F.col("text"),
        F.when((line == F.col("all_lines") - 1) & (F.col("feeds") > 0), F.lit("\n")).otherwise(F.lit("")),
    )
    rows = placed.select("doc_id", "n", "total", line.alias("line"), first.alias("o"), body.alias("body"))
    rows = rows.withColumn("toks", F.regexp_extract_all("body", F.lit(rf"({tx.SPACE}*{tx.NON_SPACE}+)"), 1))
    rows = rows.withColumn("tail", F.regexp_extract("body", rf"({tx.SPACE}*)\z", 1))

    def reach(from_token: Column, to_token: Column) -> Column:
        """Windows that hold any of the tokens."""
        low = F.greatest(F.floor((from_token - size) / step) + 1, F.lit(0))
        return F.sequence(low, F.floor(to_token / step))

    o, n = F.col("o"), F.col("n")

    def piece(w: Column) -> Column:
        start, stop = F.greatest(w * step, o), F.least(w * step + size, o + n)
        text = F.array_join(F.slice("toks", (start - o + 1).cast("int"), (stop - start).cast("int")), "")
        return F.struct(w.alias("w"), F.lit(0).alias("part"), text.alias("t"), (stop - start).alias("k"))

    none = F.array().cast("array<struct<w: bigint, part: int, t: string, k: bigint>>")
    words = F.when(n > 0, F.transform(reach(o, o + n - 1), piece)).otherwise(none)
    owner = F.least(o + n, F.col("total") - 1)
    behind = F.when(F.col("tail") != "", F.transform(
        reach(owner, owner), lambda w: F.struct(w.alias("w"), F.lit(1).alias("part"), F.col("tail").alias("t"), F.lit(0).cast("long").alias("k"))
    )).otherwise(none)
    pieces = rows.select("doc_id", "line", F.inline(F.concat(words, behind)))
    gathered = pieces.groupBy("doc_id", "w").agg(
        F.array_sort(F.collect_list(F.struct("line", "part", "t"))).alias("parts"), F.sum("k").cast("int").alias("token_count")
    )
    text = F.array_join(F.transform("parts", lambda p: p["t"]), "")
    start = (F.col("w") * step).cast("int")
    return gathered.select(
        ids.chunk_id(F.col("doc_id"), F.col("w")).alias("chunk_id"), "doc_id", F.col("w").cast("int").alias("chunk_index"),
        text.alias("text"), "token_count", start.alias("start_token"), (start + F.col("token_count")).alias("end_token"),
        F.length(text).alias("char_count"),
    )
