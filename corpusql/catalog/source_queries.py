"""A: sources, document building and sinks.

Files are made from the tables: the queries first write the tables out as a
corpus folder in the shared directory and then read that folder.
"""

from pyspark.sql import functions as F

from corpusql.catalog.base import CHUNKS_SQL, DOCS_SQL, chunks, documents, load, query, spread, stamp
from corpusql.functions import ids
from corpusql.functions import text as tx
from corpusql.session import shared_dir
from corpusql.sources import files as fs
from corpusql.sources import sinks, tables
from corpusql.sources.listing import list_files

_FOLDERS: dict[tuple[str, str], str] = {}


def corpus_folder(spark, d: str) -> str:
    """One file per document, label, supplier and region: text, JSON, CSV and an unsupported type."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _FOLDERS:
        root = shared_dir(spark, "corpus")
        docs, row = spread(load(spark, d, "documents"), "doc_id"), F.struct("*")
        sinks.write_files(docs, F.col("text"), f"{root}/notes", "txt")
        sinks.write_files(spread(load(spark, d, "labels")), F.to_json(row), f"{root}/labels", "json")
        suppliers = spread(load(spark, d, "supplier"))
        header = F.lit(",".join(suppliers.columns) + "\n")
        sinks.write_files(suppliers, F.concat(header, F.to_csv(row)), f"{root}/tables/supplier", "csv")
        load(spark, d, "region").write.option("maxRecordsPerFile", 1).parquet(f"{root}/other")
        _FOLDERS[key] = root
    return _FOLDERS[key]


@query("corpus_scan", """
SELECT 'txt' AS extension, 'text' AS source_type, 'Text' AS parser, count(*)::BIGINT AS files,
       sum(strlen(text) + 1)::BIGINT AS bytes FROM documents
UNION ALL SELECT 'json', 'json', 'Text', count(*)::BIGINT,
       sum(length('{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}') + 1)::BIGINT FROM labels
UNION ALL SELECT 'csv', 'csv', 'CSV', count(*)::BIGINT,
       sum(length('s_suppkey,s_name,s_nationkey,s_acctbal') + 1
           + length(s_suppkey || ',' || s_name || ',' || s_nationkey || ',' || s_acctbal) + 1)::BIGINT FROM supplier
UNION ALL SELECT 'parquet', 'unknown', NULL, count(*)::BIGINT, NULL FROM region
""")
def corpus_scan(spark, d):
    scan = fs.corpus_scan(spark, corpus_folder(spark, d))
    size = F.sum(F.when(F.col("parser").isNotNull(), F.col("file_size")))
    return scan.groupBy("extension", "source_type", "parser").agg(
        F.count(F.lit(1)).alias("files"), size.alias("bytes")
    )


@query("text_documents", """
SELECT 'txt' AS format, md5(text || chr(10)) AS text_md5, length(text)::BIGINT + 1 AS char_count,
       (length(text) - length(replace(text, chr(10), '')))::BIGINT + 2 AS line_count FROM documents
""")
def text_documents(spark, d):
    made = fs.text_documents(fs.read_files(spark, corpus_folder(spark, d) + "/notes", "Text"))
    return made.select(
        "format", F.md5("text").alias("text_md5"), F.col("char_count").cast("bigint"),
        F.col("line_count").cast("bigint"),
    )


@query("json_documents", """
SELECT '{' || chr(10) || '  "doc_id": ' || doc_id || ',' || chr(10) || '  "quality": ' || quality || ','
       || chr(10) || '  "toxic": ' || toxic || chr(10) || '}' AS text, NULL::VARCHAR AS warning FROM labels
""")
def json_documents(spark, d):
    made = fs.text_documents(fs.read_files(spark, corpus_folder(spark, d) + "/labels", "Text"))
    return made.select("text", "warning")


@query("csv_documents", """
SELECT 1::BIGINT AS row_count, 4 AS column_count, split_part(text, chr(10), 2) AS header, md5(text) AS data_md5
FROM (SELECT 'x' || chr(10) || 'Columns: s_suppkey, s_name, s_nationkey, s_acctbal' || chr(10) || 'Rows: 1' || chr(10) || chr(10)
  || 'Data:' || chr(10) || 'Row 1: {''s_suppkey'': ' || s_suppkey || ', ''s_name'': ''' || s_name
  || ''', ''s_nationkey'': ' || s_nationkey || ', ''s_acctbal'': ' || s_acctbal || '}' AS text FROM supplier)
""")
def csv_documents(spark, d):
    made = fs.csv_documents(spark, corpus_folder(spark, d) + "/tables")
    anonymous = F.regexp_replace("text", r"\ACSV Data: [^\n]*", "x")
    return made.select(
        "row_count", "column_count", F.split("text", "\n")[1].alias("header"), F.md5(anonymous).alias("data_md5")
    )


@query("table_to_document", """
WITH f AS (SELECT *, row_number() OVER (ORDER BY c_custkey) AS i FROM customer),
l AS (SELECT string_agg('Row ' || i || ': {''c_custkey'': ' || c_custkey || ', ''c_name'': ''' || c_name
        || ''', ''c_nationkey'': ' || c_nationkey || ', ''c_acctbal'': ' || c_acctbal || ', ''c_mktsegment'': '''
        || c_mktsegment || '''}', chr(10) ORDER BY i) AS rows FROM f WHERE i <= 10),
n AS (SELECT count(*) AS n FROM customer)
SELECT 'customer.csv' AS filename, n::BIGINT AS row_count, 5 AS column_count,
  'CSV Data: customer.csv' || chr(10) || 'Columns: c_custkey, c_name, c_nationkey, c_acctbal, c_mktsegment'
  || chr(10) || 'Rows: ' || n || chr(10) || chr(10) || 'Data:' || chr(10) || rows || chr(10)
  || '... (' || (n - 10) || ' more rows)' AS text FROM l, n
""")
def table_to_document(spark, d):
    return tables.table_to_document(load(spark, d, "customer"), "customer.csv", ["c_custkey"])


@query("table_profile", """
SELECT 'customer' AS table_name, p.position, p.column_name, p.dtype, c.n AS row_count, 5 AS column_count
FROM (VALUES (1, 'c_custkey', 'int64'), (2, 'c_name', 'object'), (3, 'c_nationkey', 'int64'),
             (4, 'c_acctbal', 'float64'), (5, 'c_mktsegment', 'object')) p(position, column_name, dtype),
     (SELECT count(*)::BIGINT AS n FROM customer) c
""")
def table_profile(spark, d):
    return tables.table_profile(load(spark, d, "customer"), "customer")


@query("page_assembly", """
WITH p AS (SELECT conv_id, turn, CASE WHEN role = 'system' THEN '' ELSE text END AS text,
                  CASE WHEN role = 'system' THEN 'no text layer' END AS error FROM conversations)
SELECT conv_id, turn // 1000 AS segment, count(*)::BIGINT AS page_count,
       count(*) FILTER (text <> '')::BIGINT AS text_pages, count(error)::BIGINT AS failed_pages,
       coalesce(string_agg(text, chr(10) || chr(10) ORDER BY turn) FILTER (text <> ''), '') AS text
FROM p GROUP BY ALL
""")
def page_assembly(spark, d):
    """Conversation turns as pages; system turns stand for pages that failed."""
    failed = F.col("role") == "system"
    pages = load(spark, d, "conversations").select(
        "conv_id", "turn", F.when(failed, "").otherwise(F.col("text")).alias("text"),
        F.when(failed, F.lit("no text layer")).alias("error"),
    )
    return fs.page_assembly(pages, "conv_id", "turn")


@query("file_metadata", """
SELECT 'txt' AS extension, 'text' AS source_type, strlen(text)::BIGINT + 1 AS file_size FROM documents
""")
def file_metadata(spark, d):
    files = list_files(spark, corpus_folder(spark, d) + "/notes")
    return fs.file_metadata(files.rows).select("extension", "source_type", "file_size")


@query("source_type_map", f"""
WITH {DOCS_SQL}
SELECT doc_id, extension, CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'csv'
  WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'json' THEN 'json'
  ELSE 'unknown' END AS source_type FROM docs
""")
def source_type_map(spark, d):
    docs = documents(spark, d)
    ext = fs.extension(F.col("file_path"))
    return docs.select("doc_id", ext.alias("extension"), fs.source_type(ext).alias("source_type"))


@query("metadata_merge", f"""
WITH {DOCS_SQL}
SELECT doc_id, '{{"file_name":"' || filename || '","ingested_at":"2024-01-01T00:00:00","source_type":"' ||
  CASE WHEN lang = 'en' THEN 'override' ELSE CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'csv'
  WHEN 'tsv' THEN 'csv' WHEN 'txt' THEN 'text' WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown'
  WHEN 'json' THEN 'json' ELSE 'unknown' END END || '"}}' AS base,
  source AS author, NULL::VARCHAR AS title, '2024' AS created,
  CASE WHEN lang <> 'fr' THEN lang END AS custom_lang FROM docs
""")
def metadata_merge(spark, d):
    docs = documents(spark, d)
    pairs = F.create_map(F.lit("file_name"), F.col("filename"))
    override = F.create_map(F.lit("source_type"), F.lit("override"))
    file_fields = F.when(F.col("lang") == "en", F.map_concat(pairs, override)).otherwise(pairs)
    doc_fields = F.create_map(
        F.lit("author"), F.col("source"), F.lit("creation_date"), F.lit("2024")
    )
    custom = F.when(F.col("lang") != "fr", F.create_map(F.lit("lang"), F.col("lang"))).otherwise(
        F.create_map().cast("map<string,string>")
    )
    merged = fs.merge_metadata(
        file_fields, doc_fields, custom, F.col("extension"), F.lit("2024-01-01T00:00:00")
    )
    sorted_base = F.map_from_entries(F.array_sort(F.map_entries("m.base")))
    return docs.select("doc_id", merged.alias("m")).select(
        "doc_id",
        F.to_json(sorted_base).alias("base"),
        F.col("m.doc_metadata.author").alias("author"),
        F.col("m.doc_metadata.title").alias("title"),
        F.col("m.doc_metadata.created").alias("created"),
        F.col("m.custom")["lang"].alias("custom_lang"),
    )


@query("write_documents", f"""
WITH {DOCS_SQL}
SELECT substr(md5(filename || '_' || file_path), 1, 16) AS doc_id, filename, extension, n_chars FROM docs
""")
def write_documents(spark, d):
    """Half of the corpus first, then all of it twice: every document is stored once."""
    docs = documents(spark, d).select(
        ids.doc_id(F.col("filename"), F.col("file_path")).alias("doc_id"), "filename", "extension", "n_chars"
    )
    out = shared_dir(spark, "documents")
    sinks.write_documents(docs.filter(F.col("extension").isin("txt", "md", "json", "csv")), out)
    sinks.write_documents(docs, out)
    sinks.write_documents(docs, out)
    return spark.read.parquet(out)


@query("write_chunks", f"""
WITH {CHUNKS_SQL}
SELECT chunk_id, doc_id, chunk_index, token_count, md5(text) AS text_md5, lang FROM chunks
JOIN (SELECT doc_id::VARCHAR AS doc_id, lang FROM documents) USING (doc_id)
""")
def write_chunks(spark, d):
    from corpusql.operators.chunking import token_chunks

    out = shared_dir(spark, "chunks")
    sinks.write_chunks(token_chunks(documents(spark, d), keep=["lang"]), out, ["lang"])
    return spark.read.parquet(out).select(
        "chunk_id", F.col("doc_id").cast("string"), F.col("chunk_index").cast("bigint"),
        F.col("token_count").cast("bigint"), F.md5("text").alias("text_md5"), "lang",
    )


@query("chunk_count_refresh", f"""
WITH {CHUNKS_SQL}
SELECT d.doc_id::VARCHAR AS doc_id, count(c.chunk_id)::BIGINT AS chunk_count
FROM documents d LEFT JOIN (SELECT * FROM chunks WHERE token_count >= 50) c ON c.doc_id = d.doc_id::VARCHAR
GROUP BY 1
""")
def chunk_count_refresh(spark, d):
    """Counted over chunks that are long enough, so some documents have none."""
    long_enough = chunks(spark, d).filter(F.col("token_count") >= 50)
    return sinks.chunk_counts(documents(spark, d).select("doc_id"), long_enough)


@query("ingest_summary", f"""
WITH {DOCS_SQL}, {CHUNKS_SQL},
s AS (SELECT doc_id, filename, CASE extension WHEN 'pdf' THEN 'PDF' WHEN 'csv' THEN 'CSV' WHEN 'tsv' THEN 'CSV'
        WHEN 'xyz' THEN NULL ELSE 'Text' END AS parser,
        CASE WHEN extension <> 'xyz' AND n_chars < 200 THEN 'only ' || n_chars || ' characters' END AS error FROM docs),
c AS (SELECT count(*) AS n, sum(token_count) AS t FROM chunks
      WHERE doc_id IN (SELECT doc_id FROM s WHERE parser IS NOT NULL AND error IS NULL))
SELECT count(*)::BIGINT AS total_files,
  count(*) FILTER (parser IS NOT NULL AND error IS NULL)::BIGINT AS files_processed,
  count(*) FILTER (parser IS NOT NULL AND error IS NOT NULL)::BIGINT AS files_failed, 0::BIGINT AS files_skipped,
  (SELECT n FROM c)::BIGINT AS total_chunks, (SELECT t FROM c)::BIGINT AS total_tokens,
  (SELECT string_agg(x, ',' ORDER BY x) FROM (SELECT parser || '=' || count(*) AS x FROM s
     WHERE parser IS NOT NULL AND error IS NULL GROUP BY parser)) AS parsers_used,
  (SELECT string_agg(m, chr(10) ORDER BY m) FROM (SELECT filename || ': ' || error AS m FROM s
     WHERE error IS NOT NULL ORDER BY m LIMIT 10)) AS errors
FROM s
""")
def ingest_summary(spark, d):
    docs = documents(spark, d)
    parser = fs.parser_name(F.col("extension"))
    error = F.when(
        parser.isNotNull() & (F.col("n_chars") < 200),
        F.concat(F.lit("only "), F.col("n_chars").cast("string"), F.lit(" characters")),
    )
    status = docs.select("doc_id", "filename", parser.alias("parser"), error.alias("error"))
    good = status.filter(F.col("parser").isNotNull() & F.col("error").isNull())
    kept = chunks(spark, d).join(good.select("doc_id"), "doc_id", "left_semi")
    return sinks.ingest_summary(status, kept)


@query("ingest_corpus", r"""
WITH t AS (SELECT strlen(text) AS b, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+')) AS n FROM documents
  UNION ALL SELECT 1, 8 FROM labels UNION ALL SELECT 1, 19 FROM supplier)
SELECT ((SELECT count(*) FROM documents) + (SELECT count(*) FROM labels) + (SELECT count(*) FROM supplier)
        + (SELECT count(*) FROM region))::BIGINT AS total_files,
  ((SELECT count(*) FROM documents) + (SELECT count(*) FROM labels) + (SELECT count(*) FROM supplier))::BIGINT AS files_processed,
  0::BIGINT AS files_failed, sum(ceil(n / 462.0))::BIGINT AS total_chunks
FROM t
""")
def ingest_corpus(spark, d):
    """The whole run over the folder: parse, chunk, store, summarise."""
    out = shared_dir(spark, "ingested")
    summary = sinks.ingest(spark, corpus_folder(spark, d), out)
    return summary.select("total_files", "files_processed", "files_failed", "total_chunks")


@query("ingest_again", """
SELECT n + (SELECT count(*) FROM region) AS total_files, 0::BIGINT AS files_processed, n AS files_skipped, 0::BIGINT AS total_chunks
FROM (SELECT (SELECT count(*) FROM documents) + (SELECT count(*) FROM labels) + (SELECT count(*) FROM supplier) AS n)
""")
def ingest_again(spark, d):
    """A second run over the same folder stores nothing and says so."""
    out = shared_dir(spark, "ingested")
    folder = corpus_folder(spark, d)
    sinks.ingest(spark, folder, out)
    summary = sinks.ingest(spark, folder, out)
    return summary.select("total_files", "files_processed", "files_skipped", "total_chunks")


@query("jsonl_corpus", "SELECT md5(text) AS text_md5, length(text)::BIGINT AS chars FROM documents")
def jsonl_corpus(spark, d):
    out = shared_dir(spark, "jsonl")
    load(spark, d, "documents").select(F.col("text").alias("document_content")).write.json(out)
    return tables.jsonl_corpus(spark, out).select(
        F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars")
    )


@query("jsonl_questions", "SELECT text AS question FROM conversations WHERE role = 'user'")
def jsonl_questions(spark, d):
    out = shared_dir(spark, "questions")
    asked = load(spark, d, "conversations").filter(F.col("role") == "user")
    asked.select(F.col("text").alias("question")).write.json(out)
    return tables.jsonl_questions(spark, out)


@query("result_sink", """
SELECT o_orderkey, o_orderstatus, o_totalprice, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') AS o_orderdate FROM orders
""")
def result_sink(spark, d):
    """A result written as JSON and as CSV, read back from both."""
    rows = load(spark, d, "orders").select(
        "o_orderkey", "o_orderstatus", "o_totalprice", stamp("o_orderdate").alias("o_orderdate")
    )
    as_json, as_csv = shared_dir(spark, "json"), shared_dir(spark, "csv")
    sinks.write_result(rows, as_json)
    sinks.write_result(rows, as_csv, "csv")
    left = spark.read.schema(rows.schema).json(as_json)
    right = spark.read.schema(rows.schema).csv(as_csv, header=True)
    return left.join(right, left.columns, "left_semi")


@query("result_rows_json", """
SELECT '{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '","o_orderpriority":"'
       || o_orderpriority || '"}' AS row_json FROM orders
""")
def result_rows_json(spark, d):
    return sinks.rows_as_json(load(spark, d, "orders").select("o_orderkey", "o_orderstatus", "o_orderpriority"))


@query("row_documents", """
SELECT substr(md5('pages_' || page_id), 1, 16) AS doc_id, 'pages' AS filename, md5(html) AS text_md5,
       '{"page_id":' || page_id || ',"url":"' || url || '"}' AS metadata FROM pages
""")
def row_documents(spark, d):
    made = tables.row_documents(spread(load(spark, d, "pages"), "page_id"), "html", ["page_id"], "pages")
    return made.select("doc_id", "filename", F.md5("text").alias("text_md5"), "metadata")


@query("page_rows", r"""
SELECT conv_id, turn, regexp_replace(text, '\A[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g') AS text FROM conversations
WHERE role <> 'system' AND regexp_matches(text, '[^ \t\n\x0B\f\r]')
UNION ALL SELECT conv_id, turn, '' FROM conversations WHERE role = 'system'
""")
def page_rows(spark, d):
    failed = F.col("role") == "system"
    pages = load(spark, d, "conversations").select(
        "conv_id", "turn", F.when(failed, "").otherwise(F.col("text")).alias("text"),
        F.when(failed, F.lit("no text layer")).alias("error"),
    )
    return fs.page_rows(pages).drop("error")


@query("text_shape", """
SELECT doc_id, length(text)::BIGINT AS chars,
       (length(text) - length(replace(text, chr(10), '')))::BIGINT + 1 AS line_count FROM documents
""")
def text_shape(spark, d):
    docs = load(spark, d, "documents")
    return docs.select(
        "doc_id", F.length("text").cast("bigint").alias("chars"),
        tx.line_count(F.col("text")).cast("bigint").alias("line_count"),
    )
