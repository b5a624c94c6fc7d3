"""Appending documents, chunks and results, and the ingest run."""

from __future__ import annotations

import uuid
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.operators.chunking import CHUNK_SIZE, OVERLAP, token_chunks
from corpusql.session import file_store, many_files, materialize
from corpusql.sources import files as fs
from corpusql.sources.lines import long_text_chunks, long_text_files
from corpusql.sources.listing import Listing, has_extension, list_files
from corpusql.sources.tables import leave_out, read_if_present


def new_documents(docs: DataFrame, existing: DataFrame | None, key: str = "doc_id") -> DataFrame:
    """Documents not stored yet, each id once.

    The rows are written to the shared folder as they come; ids alone are counted and compared with those stored. Only
    rows whose id comes twice are shuffled, and of these the one with the least hash of its whole row stays, so a second run
    gives the same.
    """
    rows = materialize(docs, "incoming")
    twice = materialize(rows.groupBy(key).count().filter("count > 1").select(F.col(key).alias("_key")), "doubles")
    if not twice.isEmpty():
        same, whole = rows[key].eqNullSafe(twice["_key"]), F.struct(*[rows[c] for c in rows.columns])
        least = F.min_by(whole, F.sha2(F.to_json(whole), 256)).alias("_row")
        one = rows.join(twice, same, "left_semi").groupBy(key).agg(least).select("_row.*")
        rows = rows.join(twice, same, "left_anti").unionByName(one)
    return leave_out(rows, existing, key)


def write_documents(
    docs: DataFrame, path: str, key: str = "doc_id", partition_by: Sequence[str] = ()
) -> None:
    """Append the documents whose id is not there yet; running it twice adds nothing."""
    existing = read_if_present(docs.sparkSession, path)
    fresh = new_documents(docs, existing, key)
    fresh.write.mode("append").partitionBy(*partition_by).parquet(path)


def write_chunks(chunks: DataFrame, path: str, partition_by: Sequence[str] = ()) -> None:
    """One columnar append for all chunks that are not stored yet."""
    write_documents(chunks, path, "chunk_id", partition_by)


def chunk_counts(docs: DataFrame, chunks: DataFrame, doc_col: str = "doc_id") -> DataFrame:
    """Documents with ``chunk_count`` refreshed, zero when a document has no chunk."""
    counts = chunks.groupBy(doc_col).agg(F.count(F.lit(1)).alias("chunk_count"))
    joined = docs.drop("chunk_count").join(counts, doc_col, "left")
    return joined.withColumn("chunk_count", F.coalesce("chunk_count", F.lit(0).cast("long")))


def ingest_summary(status: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: files, failures, skips, chunks, tokens, files per parser, first ten errors.

    ``status`` has one row per file with ``filename``, ``parser`` (NULL when the
    type is not supported), ``error`` and, optionally, ``skipped`` (stored by an earlier run).
    """
    skipped = F.coalesce("skipped", F.lit(False)) if "skipped" in status.columns else F.lit(False)
    ok = F.col("parser").isNotNull() & F.col("error").isNull() & ~skipped
    files = status.agg(
        F.count(F.lit(1)).alias("total_files"),
        F.count_if(ok).alias("files_processed"),
        F.count_if(F.col("parser").isNotNull() & F.col("error").isNotNull()).alias("files_failed"),
        F.count_if(skipped).alias("files_skipped"),
    )
    # At most one row per parser, and at most ten errors, are gathered.
    parsers = status.filter(ok).groupBy("parser").count().agg(
        F.array_join(
            F.array_sort(F.collect_list(F.concat_ws("=", "parser", F.col("count").cast("string")))),
            ",",
        ).alias("t")
    )
    message = F.concat_ws(": ", "filename", "error")
    first = (
        status.filter(F.col("error").isNotNull()).select(message.alias("m")).orderBy("m").limit(10)
    )
    errors = first.agg(F.array_join(F.array_sort(F.collect_list("m")), "\n").alias("t"))
    sums = chunks.agg(
        F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("token_count"), F.lit(0)).alias("tokens")
    )
    pair = sums.select(F.struct("n", "tokens").alias("s")).scalar()
    return (
        files.withColumn("_s", pair)
        .withColumns({"parsers_used": parsers.scalar(), "errors": errors.scalar()})
        .select(
            "total_files", "files_processed", "files_failed", "files_skipped",
            F.col("_s.n").alias("total_chunks"), F.col("_s.tokens").alias("total_tokens"),
            "parsers_used", "errors",
        )
    )


def rows_as_json(df: DataFrame) -> DataFrame:
    return df.select(F.to_json(F.struct("*")).alias("row_json"))


def write_result(df: DataFrame, path: str, fmt: str = "json") -> None:
    writer = df.write.mode("errorifexists")
    if fmt == "csv":
        writer.option("header", True).csv(path)
    elif fmt == "json":
        writer.json(path)
    else:
        raise ValueError("fmt is csv or json")


FOLDER_FILES = 1000


def write_files(rows: DataFrame, content: Column, path: str, suffix: str) -> int:
    """One file per row below ``path``, holding the text ``content`` (null: empty) and a line feed; returns how many.

    Spark's writers can make a file per row too, but every file of theirs is set up, given its permissions and
    renamed by itself. Here a task writes its files into a folder of its own, and the folder gets its name when it is
    complete: a repeated task leaves one such folder. Inside, ``FOLDER_FILES`` share a folder, so that Spark lists many
    folders side by side. Readers look into folders with ``recursiveFileLookup``.
    """

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        store, folder = file_store(path)
        part, number = TaskContext.get().partitionId(), 0
        own, done = f"{folder}/_{part:06d}-{uuid.uuid4().hex}", f"{folder}/part-{part:06d}"
        for batch in batches:
            for value in batch.column(0):
                inner = f"{own}/{number // FOLDER_FILES:06d}"
                if number % FOLDER_FILES == 0:
                    store.create_dir(inner, recursive=True)
                with store.open_output_stream(f"{inner}/{number:08d}.{suffix}") as out:
                    out.write((value.as_py() or "").encode() + b"\n")
                number += 1
        if number:
            try:
                store.move(own, done)
            except OSError:
                # An attempt before this one was complete.
                if store.get_file_info(done).type.name != "Directory":
                    raise
                store.delete_dir(own)
        yield pa.RecordBatch.from_pydict({"files": pa.array([number], pa.int64())})

    made = rows.select(content.cast("string").alias("content")).mapInArrow(save, "files long")
    return made.agg(F.coalesce(F.sum("files"), F.lit(0))).first()[0]


PARSED = ["doc_id", "filename", "file_path", "file_size", "extension", "source_type", "modified_at", "parser", "text", "error"]


def parse_corpus(
    spark: SparkSession, path: str, max_bytes: int = fs.MAX_FILE_BYTES, files: Listing | None = None
) -> DataFrame:
    """Documents of all supported files below ``path``; failed files carry an error.

    Text files over ``max_bytes`` have neither text nor error: their text is no single value, and
    ``long_documents`` reads it.
    """
    files = files or list_files(spark, path)
    text = fs.text_documents(fs.read_files(spark, path, "Text", max_bytes, files)).withColumn("parser", F.lit("Text"))
    table = fs.csv_documents(spark, path, files).withColumn("parser", F.lit("CSV"))
    pdf_files = fs.read_files(spark, path, "PDF", max_bytes, files)
    # A document is gathered whole here because it is one file of bounded size.
    assembled = (
        fs.page_assembly(fs.pdf_pages(pdf_files), segment_pages=1 << 31)
        .select("doc_id", F.nullif("text", F.lit("")).alias("text"))
        .withColumn("error", F.when(F.col("text").isNull(), F.lit("no page could be read")))
    )
    pdf = pdf_files.drop("content").join(assembled, "doc_id", "left").withColumn(
        "parser", F.lit("PDF")
    )
    scan = fs.corpus_scan(spark, path, files)
    rest = scan.filter(F.col("parser").isNull()).withColumn("error", F.lit(None).cast("string"))
    others = fs.oversize_files(scan, max_bytes).unionByName(rest).withColumn(
        "text", F.lit(None).cast("string")
    )
    parsed = [d.select(*PARSED) for d in (text, table, pdf, others)]
    out = parsed[0]
    for part in parsed[1:]:
        out = out.unionByName(part)
    return out


def long_documents(
    spark: SparkSession, path: str, known: DataFrame | None, size: int = CHUNK_SIZE, overlap: int = OVERLAP,
    max_bytes: int = fs.MAX_FILE_BYTES, files: Listing | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(doc_id, error) and the chunks of the text files over ``max_bytes``, but for documents in ``known``.

    Each file is read by as many tasks as it has blocks. JSON of this size stays as it is written.
    """
    files, extensions = files or list_files(spark, path), fs.extensions_of("Text")
    large = files.rows.filter(has_extension(*extensions) & (F.col("length") > max_bytes))
    named = leave_out(fs.file_metadata(large, "location"), known, "doc_id")
    blocks = materialize(long_text_files(files, extensions, max_bytes), "blocks")
    bad = blocks.groupBy("location").agg(F.sum("invalid").alias("invalid"))
    checked = materialize(named.join(bad, "location", "left").select("location", "doc_id", "file_size", "invalid"), "long-files")
    status = checked.select("doc_id", F.when(F.col("invalid") > 0, F.lit("not valid UTF-8")).alias("error"))
    good = checked.filter("coalesce(invalid, 0) = 0").select("location", "doc_id", "file_size")
    return status, long_text_chunks(files, extensions, max_bytes, good, blocks, size, overlap)


def ingest(
    spark: SparkSession, path: str, out: str, size: int = CHUNK_SIZE, overlap: int = OVERLAP,
    max_bytes: int = fs.MAX_FILE_BYTES,
) -> DataFrame:
    """Files to the ``documents`` and ``chunks`` tables below ``out``; returns the summary.

    Files already ingested are skipped. Parsed text is written once to the
    shared folder because three results are taken from it. Texts are not
    shuffled unless something of this run is stored already. A text file over ``max_bytes`` becomes the
    same chunks as any other, without being one value at any time.
    """
    with many_files(spark):
        files = list_files(spark, path)
        parsed = materialize(parse_corpus(spark, path, max_bytes, files), "parsed")
    stored = read_if_present(spark, f"{out}/documents")
    long = (F.col("parser") == "Text") & F.col("text").isNull() & F.col("error").isNull()
    pieces = None
    if not parsed.filter(long).isEmpty():
        found, pieces = long_documents(spark, path, stored, size, overlap, max_bytes, files)
        late = found.select("doc_id", F.col("error").alias("late"))
        parsed = parsed.join(late, "doc_id", "left").withColumn("error", F.coalesce("error", "late")).drop("late")
        parsed = materialize(parsed.withColumn("whole", ~long), "checked")
    else:
        parsed = parsed.withColumn("whole", F.lit(True))
    good = parsed.filter(F.col("text").isNotNull() | (~F.col("whole") & F.col("error").isNull())).drop("whole")
    status = parsed.select("doc_id", "filename", "parser", "error")
    if stored is None:
        status = status.withColumn("skipped", F.lit(False))
    else:
        known = stored.select("doc_id").distinct().withColumn("skipped", F.lit(True))
        status = status.join(known, "doc_id", "left")
    # Before this run's documents are there.
    status = materialize(status, "status")
    fresh = leave_out(good, stored, "doc_id")
    made = token_chunks(fresh, size, overlap)
    chunks = materialize(made if pieces is None else made.unionByName(pieces), "chunks")
    docs = chunk_counts(fresh.drop("text", "error"), chunks).withColumn(
        "ingested_at", F.current_timestamp()
    )
    # Chunks go first, and a write is all or nothing: after a run that stopped in
    # between, the next run adds the documents and leaves their chunks alone.
    missing = leave_out(chunks, read_if_present(spark, f"{out}/chunks"), "doc_id")
    missing.write.mode("append").parquet(f"{out}/chunks")
    docs.write.mode("append").parquet(f"{out}/documents")
    return ingest_summary(status, chunks)
