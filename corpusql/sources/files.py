"""A folder of files as a table of documents."""

from __future__ import annotations

import io
import json
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.functions import ids
from corpusql.functions import text as tx
from corpusql.sources.csvfiles import csv_summaries, describe
from corpusql.sources.listing import Listing, has_extension, list_files, read_whole

# Parser and source type by file extension.
PARSERS = {
    "pdf": "PDF", "csv": "CSV", "tsv": "CSV",
    "txt": "Text", "md": "Text", "markdown": "Text", "json": "Text",
}
SOURCE_TYPES = {
    "pdf": "pdf", "csv": "csv", "tsv": "csv", "txt": "text",
    "md": "markdown", "markdown": "markdown", "json": "json",
}
MAX_FILE_BYTES = 1 << 30


def _lookup(key: Column, table: Mapping[str, str]) -> Column:
    pairs = [F.lit(x) for item in table.items() for x in item]
    return F.try_element_at(F.create_map(*pairs), key)


def extension(name: Column) -> Column:
    """Lower-cased suffix without the dot; empty when there is none."""
    return F.lower(F.regexp_extract(name, r"[^/]\.([^./]+)\z", 1))


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)\z", 1)


def source_type(ext: Column) -> Column:
    plain = F.regexp_replace(F.lower(ext), r"\A\.+", "")
    return F.coalesce(_lookup(plain, SOURCE_TYPES), F.lit("unknown"))


def parser_name(ext: Column) -> Column:
    """NULL for a file no parser takes."""
    return _lookup(F.lower(ext), PARSERS)


def corpus_scan(spark: SparkSession, path: str, files: Listing | None = None) -> DataFrame:
    """Every file below ``path`` with its metadata and parser.

    No file is opened. Files of zero bytes hold no document and are left out. Here and below ``files`` is a listing of
    ``path``, where there is one already.
    """
    files = files or list_files(spark, path)
    return file_metadata(files.rows).withColumn("parser", parser_name(F.col("extension")))


def file_metadata(files: DataFrame, *keep: str) -> DataFrame:
    name, ext = file_name(F.col("path")), extension(F.col("path"))
    return files.select(
        ids.doc_id(name, F.col("path")).alias("doc_id"),
        name.alias("filename"),
        F.col("path").alias("file_path"),
        F.col("length").alias("file_size"),
        ext.alias("extension"),
        source_type(ext).alias("source_type"),
        F.col("modificationTime").alias("modified_at"),
        *keep,
    )


def extensions_of(parser: str) -> list[str]:
    """Extensions of the files that one parser takes."""
    return [ext for ext, name in PARSERS.items() if name == parser]


def read_files(
    spark: SparkSession, path: str, parser: str, max_bytes: int = MAX_FILE_BYTES, files: Listing | None = None
) -> DataFrame:
    """Metadata and bytes of the files one parser takes.

    The files of other parsers are not opened, and a file too large for one row is left out here; see ``oversize_files``.
    """
    found = read_whole(files or list_files(spark, path), extensions_of(parser), max_bytes)
    return file_metadata(found.filter(parser_name(extension(F.col("path"))) == parser), "content")


def oversize_files(scan: DataFrame, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """Files that are no single value: text of any size is read by its lines, a PDF of this size has an error. CSV files are never read whole."""
    big = scan.filter(F.col("parser").isin("Text", "PDF") & (F.col("file_size") > max_bytes))
    return big.withColumn("error", F.when(F.col("parser") == "PDF", F.lit(f"larger than {max_bytes} bytes")))


def _decoded(content: Column) -> Column:
    raw = content.cast("string")
    return F.when(F.is_valid_utf8(raw), raw)


def text_documents(files: DataFrame) -> DataFrame:
    """Whole files as UTF-8 text. A file that is not UTF-8 keeps its row, with an error."""
    text = _decoded(F.col("content"))
    fmt = F.when(F.col("extension") == "markdown", "md").otherwise(F.col("extension"))
    out = files.withColumns({"text": text, "format": fmt}).drop("content")
    out = json_documents(out)
    return out.withColumns(
        {
            "line_count": tx.line_count(F.col("text")),
            "char_count": F.length("text"),
            "error": F.when(F.col("text").isNull(), F.lit("not valid UTF-8")),
        }
    )


@F.pandas_udf(T.StringType())
def _indent_json(texts: pd.Series) -> pd.Series:
    def render(value: str | None) -> str | None:
        try:
            return json.dumps(json.loads(value), indent=2)
        except Exception:  # whatever is wrong with one file (too deep nesting, say) must not stop the others
            return None

    return texts.map(render)


def json_documents(docs: DataFrame) -> DataFrame:
    """Valid JSON is re-rendered with an indent of two; invalid JSON stays raw.

    Rendering is a per-row codec that keeps key order, so it runs in Arrow
    batches, on the JSON rows only.
    """
    is_json = F.col("format") == "json"
    rendered = _indent_json(F.when(is_json, F.col("text")))
    return (
        docs.withColumn("_rendered", rendered)
        .withColumn(
            "warning",
            F.when(
                is_json & F.col("text").isNotNull() & F.col("_rendered").isNull(),
                F.lit("invalid JSON kept as it is"),
            ),
        )
        .withColumn("text", F.coalesce("_rendered", "text"))
        .drop("_rendered")
    )


CSV_RESULT = T.StructType(
    [
        T.StructField("text", T.StringType()),
        T.StructField("row_count", T.LongType()),
        T.StructField("column_count", T.IntegerType()),
        T.StructField("columns", T.StringType()),
        T.StructField("dtypes", T.StringType()),
        T.StructField("error", T.StringType()),
    ]
)


@F.pandas_udf(CSV_RESULT)
def _csv_text(
    names: pd.Series, first: pd.Series, counts: pd.Series, rows: pd.Series, widest: pd.Series, errors: pd.Series
) -> pd.DataFrame:
    out = []
    for name, head, kinds, n, most, error in zip(names, first, counts, rows, widest, errors):
        if head is None:
            out.append((None, None, None, None, None, error or "no columns in the file"))
        else:
            out.append(describe(name, [list(x) for x in head], [list(map(int, x)) for x in kinds], int(n), int(most)))
    return pd.DataFrame(out, columns=CSV_RESULT.names)


def csv_documents(spark: SparkSession, path: str, files: Listing | None = None) -> DataFrame:
    """Each CSV or TSV file below ``path`` as one document: its shape, column types and first ten rows.

    Files of any size: lines are read by as many tasks as a file has blocks and become records where they lie, value
    kinds are counted in the tasks, and a file leaves only its counts and first rows. Quoted fields may span
    lines. A file that cannot be read has a row with the error. Short rows miss their last values.
    """
    files = files or list_files(spark, path)
    parts = [csv_summaries(files, ext, sep) for ext, sep in (("csv", ","), ("tsv", "\t"))]
    found = files.rows.filter(has_extension(*extensions_of("CSV")))
    known = file_metadata(found, "location").join(parts[0].union(parts[1]), "location", "left")
    text = _csv_text("filename", "first", "counts", "rows", "widest", "error")
    kept = known.drop("location", "first", "counts", "rows", "widest", "error").columns
    return known.withColumn("_csv", text).select(*kept, "_csv.*")


def pdf_pages(files: DataFrame) -> DataFrame:
    """Page rows of PDF files, where the optional decoder is installed."""

    def decode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for doc, content in zip(batch["doc_id"], batch["content"]):
                try:
                    from pypdf import PdfReader

                    pages = PdfReader(io.BytesIO(content)).pages
                except Exception as problem:
                    rows.append((doc, None, None, str(problem)))
                    continue
                for number, page in enumerate(pages, 1):
                    try:
                        rows.append((doc, number, page.extract_text(), None))
                    except Exception as problem:
                        rows.append((doc, number, "", str(problem)))
            yield pd.DataFrame(rows, columns=["doc_id", "page", "text", "error"])

    return files.select("doc_id", "content").mapInPandas(
        decode, "doc_id string, page int, text string, error string"
    )


def page_rows(pages: DataFrame, text_col: str = "text") -> DataFrame:
    """Pages with text, stripped; pages without text only if they failed."""
    stripped = tx.strip(F.coalesce(F.col(text_col), F.lit("")))
    return pages.withColumn(text_col, stripped).filter(
        (F.length(text_col) > 0) | F.col("error").isNotNull()
    )


def page_assembly(
    pages: DataFrame,
    doc_col: str = "doc_id",
    page_col: str = "page",
    text_col: str = "text",
    error_col: str | None = "error",
    segment_pages: int = 1000,
) -> DataFrame:
    """Pages in order, joined by a blank line.

    One row per ``segment_pages`` pages, so no group grows without bound;
    ordinary documents have one row. ``page_count`` counts the pages of the
    segment, empty and failed ones included.
    """
    has_text = F.length(text_col) > 0
    failed = F.col(error_col).isNotNull() if error_col else F.lit(False)
    page = F.col(page_col).cast("long")
    gathered = pages.groupBy(
        doc_col, F.floor(page / segment_pages).alias("segment")
    ).agg(
        F.count(F.lit(1)).alias("page_count"),
        F.count_if(has_text).alias("text_pages"),
        F.count_if(failed).alias("failed_pages"),
        F.array_sort(
            F.collect_list(F.when(has_text, F.struct(page.alias("p"), F.col(text_col).alias("t"))))
        ).alias("parts"),
    )
    return gathered.select(
        doc_col,
        "segment",
        "page_count",
        "text_pages",
        "failed_pages",
        F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("text"),
    )


def merge_metadata(
    file_fields: Column, doc_fields: Column, custom: Column, ext: Column, ingested_at: Column
) -> Column:
    """Struct(base, doc_metadata, custom) from three map<string,string> columns.

    File fields win over the defaults. Document metadata keeps its original
    under ``raw`` next to the common fields; an empty map gives NULL.
    """
    defaults = F.create_map(
        F.lit("source_type"), source_type(ext), F.lit("ingested_at"), ingested_at
    )
    fields = F.coalesce(file_fields, F.create_map().cast("map<string,string>"))
    kept = F.map_filter(defaults, lambda k, _: ~F.map_contains_key(fields, k))
    doc = F.struct(
        doc_fields["author"].alias("author"),
        doc_fields["title"].alias("title"),
        doc_fields["subject"].alias("subject"),
        doc_fields["creation_date"].alias("created"),
        doc_fields.alias("raw"),
    )
    return F.struct(
        F.map_concat(kept, fields).alias("base"),
        F.when(F.size(doc_fields) > 0, doc).alias("doc_metadata"),
        F.when(F.size(custom) > 0, custom).alias("custom"),
    )
