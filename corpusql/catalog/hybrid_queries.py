"""I and K: narrowing a corpus before reading it, and judging answers."""

from pyspark.sql import functions as F

from corpusql.catalog.base import CHUNKS_SQL, DOCS_SQL, chunks, documents, load, orders, query, six
from corpusql.operators import evaluate as ev
from corpusql.operators import hybrid as hy


@query("filter_doc_ids", """
SELECT coalesce(nullif(CASE WHEN event_type = 'click' THEN '' ELSE user_id::VARCHAR END, ''),
                CASE WHEN event_id % 2 = 0 THEN event_id::VARCHAR END) AS doc_id
FROM events WHERE event_type <> 'click' OR event_id % 2 = 0
""")
def filter_doc_ids(spark, d):
    """Rows where the first id column is sometimes empty and the second sometimes NULL."""
    rows = load(spark, d, "events").select(
        F.when(F.col("event_type") == "click", "").otherwise(F.col("user_id").cast("string")).alias("doc_id"),
        F.when(F.col("event_id") % 2 == 0, F.col("event_id")).alias("id"),
    )
    return hy.filter_doc_ids(rows)


def good_labels(spark, d):
    labels = load(spark, d, "labels").filter((F.col("quality") == 1) & (F.col("toxic") == 0))
    return labels.select(F.col("doc_id").cast("string").alias("doc_id"))


GOOD_SQL = "good AS (SELECT doc_id::VARCHAR AS doc_id FROM labels WHERE quality = 1 AND toxic = 0)"


@query("narrow_corpus", f"""
WITH {DOCS_SQL}, {GOOD_SQL}
SELECT doc_id, filename, lang FROM docs WHERE doc_id IN (SELECT doc_id FROM good) ORDER BY doc_id LIMIT 10
""")
def narrow_corpus(spark, d):
    return hy.narrow_corpus(documents(spark, d), good_labels(spark, d)).select("doc_id", "filename", "lang")


@query("narrow_corpus_all", f"""
WITH {DOCS_SQL}, {GOOD_SQL}
SELECT doc_id, filename, lang FROM docs WHERE doc_id IN (SELECT doc_id FROM good)
""")
def narrow_corpus_all(spark, d):
    """The same filter without a limit on documents."""
    kept = hy.narrow_corpus(documents(spark, d), good_labels(spark, d), None)
    return kept.select("doc_id", "filename", "lang")


@query("hybrid_context", f"""
WITH {CHUNKS_SQL}, {GOOD_SQL},
w AS (SELECT doc_id FROM documents d JOIN good g ON g.doc_id = d.doc_id::VARCHAR),
n AS (SELECT doc_id::VARCHAR AS doc_id FROM w ORDER BY 1 LIMIT 10),
t AS (SELECT doc_id, substr(string_agg(text, chr(10) || chr(10) ORDER BY chunk_index), 1, 5000) AS text
      FROM chunks WHERE doc_id IN (SELECT doc_id FROM n) GROUP BY 1),
r AS (SELECT *, row_number() OVER (ORDER BY doc_id) AS i FROM t)
SELECT count(*)::BIGINT AS documents, substr(string_agg('[Document ' || i || ']' || chr(10) || text,
  chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY i), 1, 15000) AS context, 0.8::DOUBLE AS confidence FROM r
""".replace("SELECT doc_id FROM documents d", "SELECT d.doc_id FROM documents d"))
def hybrid_context(spark, d):
    narrowed = hy.narrow_corpus(documents(spark, d).select("doc_id"), good_labels(spark, d))
    made = hy.hybrid_context(chunks(spark, d), narrowed)
    return made.withColumn("documents", F.col("documents").cast("bigint"))


@query("hybrid_context_all", f"""
WITH {CHUNKS_SQL}, {GOOD_SQL},
s AS (SELECT doc_id, chunk_index // 2 AS segment, count(*)::BIGINT AS chunks, string_agg(text, chr(10) || chr(10) ORDER BY chunk_index) AS text
      FROM chunks WHERE doc_id IN (SELECT doc_id FROM good) AND text <> '' GROUP BY ALL),
r AS (SELECT *, dense_rank() OVER (ORDER BY doc_id) AS i, min(segment) OVER (PARTITION BY doc_id) AS first FROM s)
SELECT i::BIGINT AS document, segment::BIGINT AS segment, doc_id, chunks,
  md5(CASE WHEN segment > first THEN chr(10) || chr(10)
           ELSE CASE WHEN i > 1 THEN chr(10) || chr(10) || '---' || chr(10) || chr(10) ELSE '' END || '[Document ' || i || ']' || chr(10) END || text) AS block_md5
FROM r
""")
def hybrid_context_all(spark, d):
    """The same without any limit: the rows whose blocks, one behind the other, are the context. Small segments, so that many documents have several."""
    narrowed = hy.narrow_corpus(documents(spark, d).select("doc_id"), good_labels(spark, d), None)
    made = hy.hybrid_blocks(chunks(spark, d), narrowed, segment_chunks=2)
    return made.select("document", "segment", "doc_id", F.col("chunks").cast("bigint"), F.md5("block").alias("block_md5"))


@query("hybrid_metadata", f"""
WITH {DOCS_SQL}, {GOOD_SQL}
SELECT doc_id, filename, extension FROM docs WHERE doc_id IN (SELECT doc_id FROM good)
""")
def hybrid_metadata(spark, d):
    return hy.document_metadata(documents(spark, d), good_labels(spark, d), ["filename", "extension"])


def order_answers(spark, d):
    """Gold and judged answers about orders. The judged one differs in form, or in facts, by order."""
    rest = F.col("o_orderkey") % 4
    key, day = F.col("o_orderkey").cast("string"), F.date_format("o_orderdate", "yyyy-MM-dd")
    status = F.concat(F.lit("Order "), key, F.lit(" has status "), F.col("o_orderstatus"), F.lit("."))
    placed = F.concat(F.lit(" It was placed on "), day, F.lit("."))
    urgency = F.concat(F.lit(" Its priority is "), F.col("o_orderpriority"), F.lit("."))
    gold = F.concat(status, placed, urgency)
    judged = (
        F.when(rest == 0, gold)
        .when(rest == 1, F.upper(F.concat(status, F.lit(" "), placed, urgency)))
        .when(rest == 2, F.concat(status, urgency))
        .otherwise(F.lit("I do not know."))
    )
    return orders(spark, d).select(
        "o_orderkey", "o_orderstatus", gold.alias("gold_answer"), judged.alias("judged_answer")
    )


@query("answer_accuracy", """
SELECT o_orderstatus, count(*)::BIGINT AS answers, count(*) FILTER (o_orderkey % 4 < 2)::BIGINT AS correct,
       round(avg((o_orderkey % 4 < 2)::INTEGER) + 1e-9, 6) AS accuracy FROM orders GROUP BY 1
""")
def answer_accuracy(spark, d):
    made = ev.answer_accuracy(order_answers(spark, d), ["o_orderstatus"])
    return made.withColumn("accuracy", six("accuracy"))


@query("answer_recall", """
SELECT o_orderkey, 3::BIGINT AS total_claims, CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END::BIGINT AS covered_claims,
  round(CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END / 3.0 + 1e-9, 6)::DOUBLE AS recall FROM orders
""")
def answer_recall(spark, d):
    made = ev.answer_recall(order_answers(spark, d), "o_orderkey")
    return made.select(
        "o_orderkey", F.col("total_claims").cast("bigint"), F.col("covered_claims").cast("bigint"),
        six("recall").alias("recall"),
    )


@query("answer_recall_mean", """
SELECT sum(3)::BIGINT AS total_claims,
  sum(CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END)::BIGINT AS covered_claims,
  round(sum(CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 2 ELSE 0 END) / sum(3) + 1e-9, 6)::DOUBLE AS recall FROM orders
""")
def answer_recall_mean(spark, d):
    made = ev.mean_recall(ev.answer_recall(order_answers(spark, d), "o_orderkey"))
    return made.withColumn("recall", six("recall"))
