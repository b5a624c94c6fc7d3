"""L16, L10: the stored word index and what is ranked by it."""

from pyspark.sql import functions as F

from corpusql.catalog.base import load, query
from corpusql.operators import textindex as ix
from corpusql.operators import vectors as vc
from corpusql.session import shared_dir

WORDS_SQL = rf"""
held AS (SELECT doc_id, unnest(regexp_extract_all(lower(coalesce(text, '')), '{ix.WORD}')) AS word FROM documents),
counts AS (SELECT doc_id, word, count(*) AS times FROM held GROUP BY ALL),
lengths AS (SELECT doc_id, len(regexp_extract_all(lower(coalesce(text, '')), '{ix.WORD}')) AS length FROM documents),
weights AS (SELECT word, ln(1 + ((SELECT count(*) FROM documents) - count(*) + 0.5) / (count(*) + 0.5)) AS weight FROM counts GROUP BY 1)
"""

BM25_SQL = f"""
scores AS (
  SELECT query_id, c.doc_id, round(sum(weight * times * {ix.K1 + 1} /
    (times + {ix.K1} * ({1 - ix.B} + {ix.B} * length / (SELECT avg(length) FROM lengths)))) + 1e-9, {ix.DECIMALS}) AS score, count(*)::BIGINT AS matched
  FROM asked JOIN counts c USING (word) JOIN weights USING (word) JOIN lengths l ON l.doc_id = c.doc_id GROUP BY ALL)
"""


def indexed(spark, d, parts=2):
    """The documents in as many appends, and one more of rows that are there already."""
    docs, path = load(spark, d, "documents").select("doc_id", "text"), shared_dir(spark, "index")
    for part in range(parts):
        ix.append(docs.filter(F.col("doc_id") % parts == part), path, buckets=8, segment_docs=256)
    ix.append(docs, path, buckets=8)
    return path


@query("word_index", f"""
WITH {WORDS_SQL} SELECT word, count(*)::BIGINT AS documents, sum(times)::BIGINT AS occurrences FROM counts GROUP BY 1
""")
def word_index(spark, d):
    return ix.vocabulary(spark, indexed(spark, d))


@query("bm25_rank", f"""
WITH {WORDS_SQL},
asked AS (SELECT DISTINCT item_id AS query_id, unnest(regexp_extract_all(lower(text), '{ix.WORD}')) AS word FROM benchmark),
{BM25_SQL},
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS rank FROM scores)
SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS id, score, matched, rank::INTEGER AS rank FROM r WHERE rank <= 5
""")
def bm25_rank(spark, d):
    """The five best documents for every benchmark item's text."""
    return ix.search(spark, indexed(spark, d), load(spark, d, "benchmark"), 5, "item_id", "text")


@query("mentions_rank", rf"""
WITH spaced AS (SELECT *, ' ' || array_to_string(regexp_extract_all(lower(text), '{ix.WORD}'), ' ') || ' ' AS s FROM documents)
SELECT doc_id, n_chars FROM spaced WHERE contains(s, ' apache license ') AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 3
""")
def mentions_rank(spark, d):
    """The three longest English texts with a phrase; only texts that the index names are read for it."""
    docs = load(spark, d, "documents")
    made = ix.mentions(docs, indexed(spark, d), "Apache License", [F.desc("n_chars"), F.asc("doc_id")], 3, where=F.col("lang") == "en")
    return made.select("doc_id", "n_chars")


@query("hybrid_text_rank", f"""
WITH {WORDS_SQL},
items AS (SELECT b.item_id AS query_id, text, embedding FROM benchmark b JOIN embeddings e ON e.vec_id = b.item_id),
asked AS (SELECT DISTINCT query_id, unnest(regexp_extract_all(lower(text), '{ix.WORD}')) AS word FROM items),
{BM25_SQL},
b AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id::VARCHAR) AS place FROM scores),
t AS (SELECT query_id, doc_id, score / (score + 10) AS score FROM b WHERE place <= 50),
s AS (SELECT i.query_id, t.doc_id, t.score, round(list_cosine_similarity(e.embedding::DOUBLE[], i.embedding::DOUBLE[]), 6) AS similarity
      FROM t JOIN items i USING (query_id) JOIN embeddings e ON e.vec_id = t.doc_id),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(similarity * 0.5 + score * 0.5, 8) DESC, doc_id::VARCHAR) AS rank FROM s)
SELECT query_id::VARCHAR AS query_id, doc_id::VARCHAR AS id, rank::INTEGER AS rank FROM x WHERE rank <= 5
""")
def hybrid_text_rank(spark, d):
    """Of the 50 best texts by words, the five best by words and vectors together."""
    vectors = load(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("id"), "embedding")
    items = load(spark, d, "benchmark").withColumn("id", F.col("item_id").cast("string")).join(vectors, "id").select("id", "text", "embedding")
    hits = ix.search(spark, indexed(spark, d), items, 50, "id", "text")
    return vc.rerank(hits, vectors, items.withColumnRenamed("id", "query_id"), 5).select("query_id", "id", "rank")
