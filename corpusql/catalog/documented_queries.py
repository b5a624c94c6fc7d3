"""L: operators for redaction, duplicates, quality, relationships and vectors."""

from pyspark.sql import functions as F

from corpusql.catalog.base import CHUNKS_SQL, chunks, load, query, six, spread
from corpusql.functions import text as tx
from corpusql.operators import quality as ql
from corpusql.operators import schema as sc
from corpusql.operators import vectors as vc


@query("redact_pii", r"""
WITH t AS (SELECT doc_id, text || ' SSN ' || lpad(doc_id % 1000 || '', 3, '0') || '-12-' || lpad(doc_id % 10000 || '', 4, '0')
  || ', card ' || lpad(doc_id || '', 16, '4') AS text FROM documents)
SELECT doc_id, md5(regexp_replace(regexp_replace(text, '\d{3}-\d{2}-\d{4}', '[SSN]', 'g'), '\d{16}', '[CARD]', 'g')) AS text_md5,
  len(regexp_extract_all(text, '\d{3}-\d{2}-\d{4}'))::BIGINT AS found FROM t
""")
def redact_pii(spark, d):
    """Every document, with a number of each kind appended."""
    k = F.col("doc_id")
    extra = F.concat(
        F.lit(" SSN "), F.lpad((k % 1000).cast("string"), 3, "0"), F.lit("-12-"),
        F.lpad((k % 10000).cast("string"), 4, "0"), F.lit(", card "), F.lpad(k.cast("string"), 16, "4"),
    )
    docs = spread(load(spark, d, "documents"), "doc_id").select("doc_id", F.concat("text", extra).alias("text"))
    return docs.select(
        "doc_id", F.md5(tx.redact(F.col("text"))).alias("text_md5"),
        F.regexp_count("text", F.lit(r"\d{3}-\d{2}-\d{4}")).cast("bigint").alias("found"),
    )


@query("dedup_documents", """
SELECT min(doc_id) AS doc_id, sha256(text) AS content_hash, count(*)::BIGINT AS copies FROM documents GROUP BY text
""")
def dedup_documents(spark, d):
    return ql.dedup_documents(load(spark, d, "documents")).select("doc_id", "content_hash", "copies")


@query("dedup_seen", """
WITH old AS (SELECT sha256(text) AS h FROM documents WHERE lang <> 'en')
SELECT min(doc_id) AS doc_id, count(*)::BIGINT AS copies FROM documents
WHERE sha256(text) NOT IN (SELECT h FROM old) GROUP BY text
""")
def dedup_seen(spark, d):
    """Documents whose content was not among those of the other languages."""
    docs = load(spark, d, "documents")
    seen = docs.filter(F.col("lang") != "en").select(ql.content_hash(F.col("text")).alias("content_hash"))
    return ql.dedup_documents(docs, seen=seen.distinct()).select("doc_id", "copies")


@query("quality_flags", f"""
WITH {CHUNKS_SQL}
SELECT doc_id::VARCHAR AS id, length(text) < 100 AS flag FROM documents
UNION ALL SELECT chunk_id, token_count < 50 FROM chunks
""")
def quality_flags(spark, d):
    docs = ql.text_flags(load(spark, d, "documents")).select(
        F.col("doc_id").cast("string").alias("id"), F.col("maybe_scanned").alias("flag")
    )
    made = ql.chunk_flags(chunks(spark, d)).select(F.col("chunk_id").alias("id"), F.col("too_short").alias("flag"))
    return docs.unionByName(made)


@query("quality_review", """
SELECT event_type AS entity, count(*)::BIGINT AS rows, round(avg((value / 20 < 0.85)::INTEGER) + 1e-9, 6) AS low_share,
  avg((value / 20 < 0.85)::INTEGER) > 0.3 AS needs_review FROM events GROUP BY 1
""")
def quality_review(spark, d):
    rows = load(spark, d, "events").select(
        F.col("event_type").alias("entity"), (F.col("value") / 20).alias("confidence")
    )
    return ql.extraction_flags(rows).withColumn("low_share", six("low_share"))


def rules():
    return {
        "value not negative": F.col("c_acctbal") >= 0,
        "segment known": F.col("c_mktsegment").isin("MACHINERY", "BUILDING", "HOUSEHOLD"),
        "name given": F.col("c_name").isNotNull(),
    }


@query("validation_rules", """
SELECT 'value not negative' AS rule, count(*) FILTER (c_acctbal < 0)::BIGINT AS violations, count(*)::BIGINT AS rows FROM customer
UNION ALL SELECT 'segment known', count(*) FILTER (c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD'))::BIGINT,
  count(*)::BIGINT FROM customer
UNION ALL SELECT 'name given', count(*) FILTER (c_name IS NULL)::BIGINT, count(*)::BIGINT FROM customer
""")
def validation_rules(spark, d):
    return ql.validation_counts(load(spark, d, "customer"), rules())


@query("validation_rejects", """
SELECT c_custkey, concat_ws(',', CASE WHEN c_acctbal < 0 THEN 'value not negative' END,
  CASE WHEN c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD') THEN 'segment known' END) AS broken_rules
FROM customer WHERE c_acctbal < 0 OR c_mktsegment NOT IN ('MACHINERY', 'BUILDING', 'HOUSEHOLD')
""")
def validation_rejects(spark, d):
    _, bad = ql.validate(load(spark, d, "customer"), rules())
    return bad.select("c_custkey", "broken_rules")


RELATED = ("orders", "customer", "nation", "region", "supplier", "part")


def _related_sql():
    columns = [
        ("orders", "o_orderkey", "int"), ("orders", "o_custkey", "int"), ("orders", "o_orderstatus", "text"),
        ("orders", "o_orderpriority", "text"), ("customer", "c_custkey", "int"), ("customer", "c_name", "text"),
        ("customer", "c_nationkey", "int"), ("customer", "c_mktsegment", "text"), ("nation", "n_nationkey", "int"),
        ("nation", "n_name", "text"), ("nation", "n_regionkey", "int"), ("region", "r_regionkey", "int"),
        ("region", "r_name", "text"), ("supplier", "s_suppkey", "int"), ("supplier", "s_name", "text"),
        ("supplier", "s_nationkey", "int"), ("part", "p_partkey", "int"), ("part", "p_name", "text"),
        ("part", "p_brand", "text"), ("part", "p_type", "text"), ("part", "p_size", "int"),
    ]
    union = " UNION ".join(
        f"SELECT '{t}' AS t, '{c}' AS c, '{k}' AS kind, {c}::VARCHAR AS v FROM {t} WHERE {c} IS NOT NULL"
        for t, c, k in columns
    )
    return f"""
WITH v AS ({union}), n AS (SELECT t, c, count(*) AS n FROM v GROUP BY ALL),
p AS (SELECT a.t AS ta, a.c AS ca, b.t AS tb, b.c AS cb, count(*) AS shared FROM v a JOIN v b
      ON a.v = b.v AND a.kind = b.kind AND a.t <> b.t GROUP BY ALL)
SELECT ta AS a_table, ca AS a_column, tb AS b_table, cb AS b_column, n::BIGINT AS "distinct", shared::BIGINT AS shared,
  round(shared / n::DOUBLE + 1e-9, 6) AS containment FROM p JOIN n ON n.t = ta AND n.c = ca WHERE shared / n::DOUBLE >= 0.9 AND n >= 2
"""


@query("discover_relationships", _related_sql())
def discover_relationships(spark, d):
    made = sc.discover_relationships({t: load(spark, d, t) for t in RELATED})
    return made.withColumn("containment", six("containment"))


def attribute_rows(spark, d, part: str):
    """Attributes of a month's half: one per user, typed by the values seen."""
    half = F.col("ts") < F.lit("2024-01-16").cast("timestamp_ntz")
    rows = load(spark, d, "events").filter(half if part == "old" else ~half)
    return rows.groupBy(
        F.col("event_type").alias("entity"), F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("name")
    ).agg(F.when(F.max("value") >= 50, F.lit("REAL")).otherwise("INTEGER").alias("type"))


def _half_sql(op):
    return f"""SELECT event_type AS entity, 'user_' || user_id AS name, CASE WHEN max(value) >= 50 THEN 'REAL' ELSE 'INTEGER' END AS type
  FROM events WHERE ts {op} TIMESTAMP '2024-01-16' GROUP BY ALL"""


@query("schema_evolution", f"""
WITH o AS ({_half_sql('<')}), n AS ({_half_sql('>=')})
SELECT entity, name, o.type AS old_type, n.type AS new_type, CASE WHEN o.type IS NULL THEN 'added' WHEN n.type IS NULL THEN 'removed'
  WHEN o.type = n.type THEN 'kept' ELSE 'retyped' END AS change FROM o FULL JOIN n USING (entity, name)
""")
def schema_evolution(spark, d):
    return sc.schema_evolution(attribute_rows(spark, d, "old"), attribute_rows(spark, d, "new"))


@query("schema_backfill", """
SELECT o_orderkey AS id, o_orderstatus AS status, NULL::VARCHAR AS flag FROM orders
UNION ALL SELECT l_orderkey, NULL, l_returnflag FROM lineitem
""")
def schema_backfill(spark, d):
    old = load(spark, d, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("status"))
    new = load(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_returnflag").alias("flag"))
    return sc.backfill(old, new)


@query("custom_extractors", r"""
SELECT doc_id, nullif(regexp_extract(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}'), '') AS email,
  nullif(regexp_extract(text, '\+\d+ \(\d{3}\) \d{3}-\d{4}'), '') AS phone, length(text)::BIGINT AS chars FROM documents
""")
def custom_extractors(spark, d):
    extractors = ql.Extractors()

    @extractors.register("email")
    def email(text):
        return tx.first_match(text, r"([A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,})")

    @extractors.register("phone")
    def phone(text):
        return tx.first_match(text, r"(\+\d+ \(\d{3}\) \d{3}-\d{4})")

    @extractors.register("chars")
    def chars(text):
        return F.length(text).cast("bigint")

    docs = spread(load(spark, d, "documents"), "doc_id")
    return extractors.apply(docs).select("doc_id", "email", "phone", "chars")


def label_centres(spark, d):
    """One query vector per label: the mean of its vectors."""
    rows = load(spark, d, "embeddings").select("label", F.posexplode("embedding").alias("i", "v"))
    means = rows.groupBy("label", "i").agg(F.avg(F.col("v").cast("double")).alias("m"))
    gathered = means.groupBy("label").agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))
    return gathered.select(
        F.col("label").cast("string").alias("query_id"), F.transform("p", lambda x: x["m"]).alias("embedding")
    )


VECTOR_SQL = """
e AS (SELECT label, unnest(range(1, 65)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings),
m AS (SELECT label, i, avg(v) AS m FROM e GROUP BY ALL),
q AS (SELECT label::VARCHAR AS query_id, list(m ORDER BY i) AS c FROM m GROUP BY 1),
s AS (SELECT query_id, vec_id::VARCHAR AS id, label,
        round(list_cosine_similarity(c, embedding::DOUBLE[]), 6) AS similarity FROM embeddings, q)
"""


@query("vector_topk", f"""
WITH {VECTOR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s)
SELECT query_id, id, similarity, rank::INTEGER AS rank FROM r WHERE rank <= 10
""")
def vector_topk(spark, d):
    return vc.vector_topk(load(spark, d, "embeddings"), label_centres(spark, d), 10, id_col="vec_id")


@query("vector_topk_filtered", f"""
WITH {VECTOR_SQL}, good AS (SELECT doc_id FROM labels WHERE quality = 1),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s
      WHERE id::BIGINT IN (SELECT doc_id FROM good))
SELECT query_id, id, rank::INTEGER AS rank FROM r WHERE rank <= 10
""")
def vector_topk_filtered(spark, d):
    """Nearest vectors among the documents a structured filter keeps."""
    good = load(spark, d, "labels").filter(F.col("quality") == 1).select(F.col("doc_id").alias("vec_id"))
    rows = vc.limit_to(load(spark, d, "embeddings"), good, "vec_id")
    return vc.vector_topk(rows, label_centres(spark, d), 10, id_col="vec_id").select("query_id", "id", "rank")


@query("hybrid_rank", f"""
WITH {VECTOR_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s),
h AS (SELECT * FROM r WHERE rank <= 50),
d AS (SELECT doc_id::VARCHAR AS id, least(n_chars / 10000.0, 1.0)::DOUBLE AS score FROM documents),
t AS (SELECT query_id, id, round(similarity * 0.5 + score * 0.5, 8) AS total FROM h JOIN d USING (id)),
x AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY total DESC, id) AS rank FROM t)
SELECT query_id, id, total, rank::INTEGER AS rank FROM x WHERE rank <= 10
""")
def hybrid_rank(spark, d):
    """Similarity merged with text length as the structured score."""
    hits = vc.vector_topk(load(spark, d, "embeddings"), label_centres(spark, d), 50, id_col="vec_id")
    scored = load(spark, d, "documents").select(
        F.col("doc_id").alias("id"), F.least(F.col("n_chars") / 10000.0, F.lit(1.0)).alias("score")
    )
    made = vc.hybrid_rank(hits, scored)
    return made.select("query_id", "id", "total", "rank")


@query("keyword_rank", """
SELECT doc_id, n_chars FROM documents WHERE contains(lower(text), 'that') AND lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 3
""")
def keyword_rank(spark, d):
    made = ql.keyword_rank(
        load(spark, d, "documents"), "THAT", [F.desc("n_chars"), F.asc("doc_id")], 3, where=F.col("lang") == "en"
    )
    return made.select("doc_id", "n_chars")
