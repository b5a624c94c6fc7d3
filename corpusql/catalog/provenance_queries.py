"""H: provenance and audit. The events table stands for the query log."""

from pyspark.sql import functions as F

from corpusql.catalog.base import (
    CHUNKS_SQL, DOCS_SQL, LOG_SQL, chunks, documents, event_log, load, query, six, stamp,
)
from corpusql.operators import provenance as pv
from corpusql.session import shared_dir
from corpusql.sources.files import source_type

TYPE_SQL = """CASE extension WHEN 'pdf' THEN 'pdf' WHEN 'csv' THEN 'csv' WHEN 'tsv' THEN 'csv' WHEN 'txt' THEN 'text'
  WHEN 'md' THEN 'markdown' WHEN 'markdown' THEN 'markdown' WHEN 'json' THEN 'json' ELSE 'unknown' END"""


def typed_documents(spark, d):
    return documents(spark, d).select("doc_id", "filename", source_type(F.col("extension")).alias("source_type"))


@query("result_sources", f"""
WITH {DOCS_SQL}, {CHUNKS_SQL}, r AS (SELECT DISTINCT doc_id FROM chunks WHERE token_count = 512 AND chunk_index >= 2)
SELECT doc_id, filename, {TYPE_SQL} AS source_type FROM docs WHERE doc_id IN (SELECT doc_id FROM r)
ORDER BY doc_id LIMIT 10
""")
def result_sources(spark, d):
    made = chunks(spark, d)
    results = made.filter((F.col("token_count") == 512) & (F.col("chunk_index") >= 2)).select(
        F.lit(1).alias("value"), "chunk_id"
    )
    return pv.result_sources(results, made, typed_documents(spark, d), limit=10)


@query("result_sources_all", f"""
WITH {DOCS_SQL}, {CHUNKS_SQL}, r AS (SELECT DISTINCT doc_id FROM chunks WHERE token_count = 512)
SELECT doc_id, filename, {TYPE_SQL} AS source_type FROM docs WHERE doc_id IN (SELECT doc_id FROM r)
""")
def result_sources_all(spark, d):
    """Every document behind the full chunks."""
    made = chunks(spark, d)
    results = made.filter(F.col("token_count") == 512).select(F.lit(1).alias("value"), "chunk_id")
    return pv.result_sources(results, made, typed_documents(spark, d))


@query("log_query", r"""
WITH l AS (SELECT *, event_type || ' of user ' || user_id AS question,
  strftime(ts, '%Y-%m-%dT%H:%M:%S.') || lpad(date_part('microsecond', ts)::INTEGER % 1000000 || '', 6, '0') AS stamp,
  regexp_extract(props, '(\d+)', 1)::BIGINT AS k FROM events)
SELECT substr(md5(question || '_' || stamp), 1, 16) AS query_id, question,
  'SELECT * FROM t WHERE k = ' || k AS sql_executed,
  CASE WHEN event_type <> 'error' THEN '{"event_id":' || event_id || ',"k":' || k || '}' END AS result_json,
  k || ',' || k * 7 AS source_docs, strftime(ts, '%Y-%m-%d %H:%M:%S') AS executed_at, value AS execution_time_ms,
  CASE WHEN event_type = 'error' THEN 'execution failed' END AS error FROM l
""")
def log_query(spark, d):
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    made = pv.log_rows(
        load(spark, d, "events"),
        question=F.concat(F.col("event_type"), F.lit(" of user "), F.col("user_id").cast("string")),
        sql=F.concat(F.lit("SELECT * FROM t WHERE k = "), k.cast("string")),
        result=F.struct("event_id", k.alias("k")),
        source_docs=F.array(k.cast("string"), (k * 7).cast("string")),
        executed_at=F.col("ts"),
        ms=F.col("value"),
        error=F.when(F.col("event_type") == "error", F.lit("execution failed")),
    )
    return made.withColumns({"source_docs": F.array_join("source_docs", ","), "executed_at": stamp("executed_at")})


@query("trace_query", f"""
WITH {DOCS_SQL}, {LOG_SQL},
u AS (SELECT DISTINCT query_id, doc_id FROM uses),
hits AS (SELECT u.query_id, u.doc_id, filename FROM u JOIN docs USING (doc_id)),
n AS (SELECT query_id, count(*)::BIGINT AS document_count FROM hits GROUP BY 1)
SELECT query_id, question, sql_executed, strftime(executed_at, '%Y-%m-%d %H:%M:%S') AS executed_at,
       execution_time_ms, doc_id, filename, document_count
FROM hits JOIN log USING (query_id) JOIN n USING (query_id)
""")
def trace_query(spark, d):
    made = pv.trace_query(event_log(spark, d), documents(spark, d).select("doc_id", "filename"))
    return made.withColumn("executed_at", stamp("executed_at"))


@query("document_lineage", f"""
WITH {DOCS_SQL}, {CHUNKS_SQL}, {LOG_SQL},
r AS (SELECT doc_id, query_id, row_number() OVER (PARTITION BY doc_id ORDER BY executed_at DESC, query_id) AS rank FROM uses)
SELECT doc_id, 'chunk' AS item, chunk_index AS position, chunk_id AS item_id, token_count FROM chunks
UNION ALL SELECT doc_id, 'query', rank::BIGINT, query_id, NULL FROM r
WHERE rank <= 20 AND doc_id IN (SELECT doc_id FROM docs)
""")
def document_lineage(spark, d):
    return pv.document_lineage(documents(spark, d), chunks(spark, d), event_log(spark, d))


@query("stored_lineage", f"""
WITH {LOG_SQL},
r AS (SELECT doc_id, query_id, row_number() OVER (PARTITION BY doc_id ORDER BY executed_at DESC, query_id) AS rank,
             count(*) OVER (PARTITION BY doc_id) AS total_queries FROM uses WHERE doc_id IS NOT NULL)
SELECT doc_id, query_id, rank::INTEGER AS rank, total_queries::BIGINT AS total_queries FROM r WHERE rank <= 20
""")
def stored_lineage(spark, d):
    """Newest queries and their number per document, from uses stored with three log writes, one of them repeated."""
    log, path = event_log(spark, d), shared_dir(spark, "uses")
    for part in (0, 1, 2, 1):
        rows = log.filter(F.pmod(F.hash("query_id"), F.lit(3)) == part)
        pv.store_uses(rows, path, part, buckets=8)
    newest = pv.stored_document_queries(spark, path)
    return newest.join(pv.stored_use_counts(spark, path), "doc_id").select("doc_id", "query_id", "rank", "total_queries")


@query("lineage_counts", f"""
WITH {DOCS_SQL}, {CHUNKS_SQL}, {LOG_SQL}
SELECT doc_id, filename, (SELECT count(*) FROM chunks c WHERE c.doc_id = docs.doc_id)::BIGINT AS chunk_count,
  coalesce(n, 0)::BIGINT AS total_queries, least(coalesce(n, 0), 20)::BIGINT AS query_count
FROM docs LEFT JOIN (SELECT doc_id, count(*) AS n FROM uses GROUP BY 1) u USING (doc_id)
""")
def lineage_counts(spark, d):
    docs = documents(spark, d).select("doc_id", "filename")
    return pv.lineage_counts(docs, chunks(spark, d), event_log(spark, d))


@query("entity_provenance", f"""
WITH {DOCS_SQL}
SELECT 'o' || o_orderkey AS order_id, o_custkey::VARCHAR AS doc_id, o_totalprice, filename,
  CASE WHEN filename IS NOT NULL THEN {TYPE_SQL} END AS source_type
FROM orders LEFT JOIN docs ON doc_id = o_custkey::VARCHAR
""")
def entity_provenance(spark, d):
    """Orders as entities, whose customer number names the source document."""
    entities = load(spark, d, "orders").select(
        F.concat(F.lit("o"), F.col("o_orderkey").cast("string")).alias("order_id"),
        F.col("o_custkey").cast("string").alias("doc_id"), "o_totalprice",
    )
    return pv.entity_provenance(entities, typed_documents(spark, d), "order")


@query("audit_summary", f"""
WITH {CHUNKS_SQL}, {LOG_SQL}
SELECT count(*)::BIGINT AS total_queries, count(*) FILTER (error IS NULL)::BIGINT AS successful_queries,
  round(avg(execution_time_ms) + 1e-9, 6) AS avg_execution_time_ms,
  (SELECT count(*) FROM documents)::BIGINT AS total_documents, (SELECT count(*) FROM chunks)::BIGINT AS total_chunks
FROM log
""")
def audit_summary(spark, d):
    made = pv.audit_summary(load(spark, d, "documents"), chunks(spark, d), event_log(spark, d))
    return made.withColumn("avg_execution_time_ms", six("avg_execution_time_ms"))


@query("recent_queries", f"""
WITH {LOG_SQL}
SELECT query_id, question, strftime(executed_at, '%Y-%m-%d %H:%M:%S') AS executed_at, error IS NOT NULL AS has_error
FROM log ORDER BY log.executed_at DESC, query_id LIMIT 10
""")
def recent_queries(spark, d):
    return pv.recent_queries(event_log(spark, d)).withColumn("executed_at", stamp("executed_at"))


ENTITY_TABLES = ("customer", "supplier", "part", "orders", "lineitem")


@query("entity_table_counts", " UNION ALL ".join(
    f"SELECT '{t}' AS table_name, count(*)::BIGINT AS row_count, true AS readable FROM {t}" for t in ENTITY_TABLES
) + " UNION ALL SELECT 'missing', NULL, false")
def entity_table_counts(spark, d):
    tables = {t: load(spark, d, t) for t in ENTITY_TABLES}
    return pv.entity_table_counts({**tables, "missing": None})


@query("audit_model", f"""
WITH {LOG_SQL}
SELECT strftime(min(executed_at), '%Y-%m-%d %H:%M:%S') AS first_query,
       strftime(max(executed_at), '%Y-%m-%d %H:%M:%S') AS last_query, count(*)::BIGINT AS total_queries,
       (SELECT count(*) FROM orders)::BIGINT AS total_entities FROM log
""")
def audit_model(spark, d):
    entities = load(spark, d, "orders").select(F.count(F.lit(1))).scalar()
    made = pv.audit_period(event_log(spark, d), entities)
    return made.withColumns({"first_query": stamp("first_query"), "last_query": stamp("last_query")})


@query("frequent_queries", f"""
WITH {LOG_SQL} SELECT question, count(*)::BIGINT AS n FROM log GROUP BY 1 ORDER BY n DESC, question LIMIT 10
""")
def frequent_queries(spark, d):
    return pv.frequent_queries(event_log(spark, d))
