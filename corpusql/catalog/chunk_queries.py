"""B: text to chunks and attributes."""

from pyspark.sql import functions as F

from corpusql.catalog.base import CHUNKS_SQL, chunks, documents, joined, load, query, spread
from corpusql.functions import text as tx
from corpusql.operators import chunking as ck


@query("token_chunks", f"""
WITH {CHUNKS_SQL}
SELECT chunk_id, doc_id, chunk_index, token_count, start_token, end_token,
       length(text)::BIGINT AS char_count, md5(text) AS text_md5
FROM chunks
""")
def token_chunks(spark, d):
    return chunks(spark, d).select(
        "chunk_id", "doc_id", F.col("chunk_index").cast("bigint"), F.col("token_count").cast("bigint"),
        F.col("start_token").cast("bigint"), F.col("end_token").cast("bigint"),
        F.col("char_count").cast("bigint"), F.md5("text").alias("text_md5"),
    )


@query("token_count", r"""
SELECT doc_id, len(regexp_extract_all(text, '[^ \t\n\x0B\f\r]+'))::BIGINT AS tokens FROM documents
""")
def token_count(spark, d):
    docs = spread(load(spark, d, "documents"), "doc_id")
    return docs.select("doc_id", tx.token_count(F.col("text")).cast("bigint").alias("tokens"))


@query("sentence_split", r"""
WITH parts AS (
  SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\x0B\f\r]+',
         '\1' || chr(1), 'g'), chr(1))) AS s FROM documents),
clean AS (SELECT doc_id, regexp_replace(s, '\A[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+\z', '', 'g') AS s FROM parts)
SELECT doc_id, md5(s) AS sentence_md5, count(*)::BIGINT AS n FROM clean WHERE s <> '' GROUP BY ALL
""")
def sentence_split(spark, d):
    docs = spread(load(spark, d, "documents"), "doc_id")
    rows = docs.select("doc_id", F.explode(tx.sentences(F.col("text"))).alias("s"))
    return rows.groupBy("doc_id", F.md5("s").alias("sentence_md5")).agg(F.count(F.lit(1)).alias("n"))


# The packing is sequential: the SQL walks all documents in step, one sentence per round.
@query("sentence_chunks", rf"""
WITH RECURSIVE parts AS (
  SELECT doc_id, string_split(regexp_replace(text, '([.!?]){tx.SPACE}+', '\1' || chr(1), 'g'), chr(1)) AS p FROM documents),
clean AS (SELECT doc_id, list_filter(list_transform(p, lambda s: regexp_replace(s, '\A{tx.SPACE}+|{tx.SPACE}+\z', '', 'g')),
                                     lambda s: s <> '') AS p FROM parts),
s AS (SELECT doc_id, unnest(range(1, len(p) + 1)) AS i, unnest(p) AS s FROM clean),
n AS (SELECT doc_id, i, s, len(regexp_extract_all(s, '{tx.NON_SPACE}+')) AS n, regexp_extract_all(s, '{tx.TOKEN}', 1) AS t FROM s),
r AS (
  SELECT doc_id, 0::BIGINT AS i, []::VARCHAR[] AS o, []::BIGINT[] AS ns, []::VARCHAR[] AS made FROM (SELECT DISTINCT doc_id FROM n)
  UNION ALL
  SELECT r.doc_id, n.i,
    CASE WHEN n.n > 128 THEN [] WHEN list_sum(r.ns || [n.n]) <= 128 THEN r.o || [n.s] ELSE r.o[-2:] || [n.s] END,
    CASE WHEN n.n > 128 THEN [] WHEN list_sum(r.ns || [n.n]) <= 128 THEN r.ns || [n.n] ELSE r.ns[-2:] || [n.n] END,
    CASE WHEN n.n > 128 THEN (CASE WHEN len(r.o) > 0 THEN [array_to_string(r.o, ' ')] ELSE [] END)
           || list_transform(range(0, len(n.t), 112), lambda x: array_to_string(n.t[x + 1:x + 128], ''))
         WHEN list_sum(r.ns || [n.n]) <= 128 THEN [] ELSE [array_to_string(r.o, ' ')] END
  FROM r JOIN n ON n.doc_id = r.doc_id AND n.i = r.i + 1),
ends AS (SELECT doc_id, i + 1 AS i, 1 AS j, array_to_string(o, ' ') AS text FROM r
         WHERE len(o) > 0 AND (doc_id, i) IN (SELECT doc_id, max(i) FROM n GROUP BY 1)),
rows AS (SELECT doc_id, i, unnest(range(1, len(made) + 1)) AS j, unnest(made) AS text FROM r UNION ALL SELECT * FROM ends),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) - 1 AS chunk_index FROM rows)
SELECT doc_id || '_chunk_' || chunk_index AS chunk_id, doc_id::VARCHAR AS doc_id, chunk_index::INTEGER AS chunk_index,
  len(regexp_extract_all(text, '{tx.NON_SPACE}+'))::INTEGER AS token_count, length(text)::INTEGER AS char_count, md5(text) AS text_md5
FROM k
""")
def sentence_chunks(spark, d):
    made = ck.sentence_chunks(documents(spark, d), 128, 16)
    return made.select(
        "chunk_id", "doc_id", "chunk_index", "token_count", "char_count", F.md5("text").alias("text_md5")
    )


@query("doc_reassembly", f"""
WITH {CHUNKS_SQL}
SELECT doc_id, chunk_index // 1000 AS segment, count(*)::BIGINT AS chunks,
       md5(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index)) AS text_md5
FROM chunks GROUP BY ALL
""")
def doc_reassembly(spark, d):
    return ck.reassemble(chunks(spark, d)).select(
        "doc_id", "segment", F.col("chunks").cast("bigint"), F.md5("text").alias("text_md5")
    )


@query("doc_reassembly_dedup", r"""
SELECT doc_id::VARCHAR AS doc_id, md5(text) AS text_md5, length(text)::BIGINT AS chars FROM documents
WHERE regexp_matches(text, '[^ \t\n\x0B\f\r]')
""")
def doc_reassembly_dedup(spark, d):
    """Overlaps removed: the original text comes back."""
    whole = ck.reassemble(chunks(spark, d), dedup_overlap=True)
    return whole.select("doc_id", F.md5("text").alias("text_md5"), F.length("text").cast("bigint").alias("chars"))


# Dates and amounts do not occur in the corpus, so a text per order is read as well.
@query("regex_entities", r"""
WITH t AS (
  SELECT 'document ' || doc_id AS id, text FROM documents
  UNION ALL
  SELECT 'order ' || o_orderkey, 'Placed on ' || CASE WHEN o_orderkey % 2 = 0
           THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%m/%d/%Y') END
         || ' for $' || o_totalprice::DECIMAL(18,2)::VARCHAR || ', before $1,000 off.' FROM orders)
SELECT id,
  nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(text,
    '\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b'))), ' '), '') AS emails,
  nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(text,
    '\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b'))), ' '), '') AS dates,
  nullif(array_to_string(list_sort(list_distinct(regexp_extract_all(text,
    '\$[\d,]+(?:\.\d{2})?'))), ' '), '') AS amounts
FROM t
""")
def regex_entities(spark, d):
    placed = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise(
        F.date_format("o_orderdate", "MM/dd/yyyy")
    )
    paid = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    orders = load(spark, d, "orders").select(
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("id"),
        F.concat(F.lit("Placed on "), placed, F.lit(" for $"), paid, F.lit(", before $1,000 off.")).alias("text"),
    )
    docs = spread(load(spark, d, "documents"), "doc_id").select(
        F.concat(F.lit("document "), F.col("doc_id").cast("string")).alias("id"), "text"
    )
    kinds = [joined(tx.find_entities(F.col("text"), k), " ").alias(k) for k in tx.ENTITY_PATTERNS]
    return docs.unionByName(orders).select("id", *kinds)


PAGE_RULES = {
    "lang": r'<html lang="([a-z]+)"',
    "title": r"<title>([^<]*)</title>",
    "heading": r"<h1>([^<]*)</h1>",
    "page_no": r"page=(\d+)",
}


@query("pattern_attributes", r"""
WITH p AS (SELECT page_id, url || ' ' || html AS t FROM pages)
SELECT page_id,
  nullif(trim(regexp_extract(t, '<html lang="([a-z]+)"', 1)), '') AS lang,
  nullif(substr(trim(regexp_extract(t, '<title>([^<]*)</title>', 1), ' ' || chr(9) || chr(10) || chr(13)), 1, 50), '') AS title,
  nullif(substr(trim(regexp_extract(t, '<h1>([^<]*)</h1>', 1), ' ' || chr(9) || chr(10) || chr(13)), 1, 50), '') AS heading,
  nullif(regexp_extract(t, 'page=(\d+)', 1), '') AS page_no
FROM p
""")
def pattern_attributes(spark, d):
    pages = spread(load(spark, d, "pages"), "page_id")
    text = F.concat_ws(" ", "url", "html")
    found = [
        tx.first_match(text, rule, max_chars=50 if name in ("title", "heading") else None).alias(name)
        for name, rule in PAGE_RULES.items()
    ]
    return pages.select("page_id", *found)


@query("sample_documents", f"""
WITH {CHUNKS_SQL}
SELECT chunk_id, md5('0|' || chunk_id) AS sample_order FROM chunks ORDER BY sample_order, chunk_id LIMIT 12
""")
def sample_documents(spark, d):
    return ck.sample_documents(chunks(spark, d), 12).select("chunk_id", "sample_order")


@query("numbered_context", """
WITH r AS (SELECT lang, doc_id, text, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS n FROM documents)
SELECT lang, count(*)::BIGINT AS documents,
       md5(string_agg('--- Document ' || n || ' ---' || chr(10) || text,
           chr(10) || chr(10) ORDER BY n)) AS context_md5
FROM r WHERE n <= 12 GROUP BY lang
""")
def numbered_context(spark, d):
    """Per language, the twelve shortest documents as one prompt context."""
    made = ck.numbered_context(
        load(spark, d, "documents"), ["n_chars", "doc_id"], 12, group_cols=["lang"],
        heading="--- Document %d ---", separator="\n\n",
    )
    return made.select("lang", F.col("documents").cast("bigint"), F.md5("context").alias("context_md5"))
