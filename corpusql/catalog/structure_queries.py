"""The two main paths from end to end: texts to stored entity tables, and a question to rows, sources and log."""

from pyspark.sql import functions as F

from corpusql.catalog.base import query
from corpusql.catalog.schema_queries import labelled_orders
from corpusql.operators import provenance as pv
from corpusql.plans import structure as st
from corpusql.session import shared_dir


def order_chunks(spark, d):
    """One chunk per order text."""
    docs = labelled_orders(spark, d).withColumn("doc_id", F.col("doc_id").cast("string"))
    return docs.withColumn("chunk_id", F.concat("doc_id", F.lit("_chunk_0")))


BUILT_SQL = """
built AS (SELECT o_orderkey, o_orderkey::VARCHAR AS doc_id, o_orderkey || '_chunk_0' AS source_chunk_id, o_orderstatus AS order_status,
    CASE WHEN o_orderkey % 10 <> 0 THEN o_totalprice::DECIMAL(18,2)::DOUBLE END AS total_price,
    CASE WHEN o_orderkey % 4 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS placed, o_orderkey % 3 = 0 AS gift,
    (2 + (o_orderkey % 10 <> 0)::INT + (o_orderkey % 4 <> 0)::INT) / 4.0 AS share FROM orders),
stored AS (SELECT * FROM built WHERE share >= 0.7)
"""


@query("build_structure", f"""
WITH {BUILT_SQL}
SELECT substr(md5('Order_' || doc_id || '_0'), 1, 16) AS order_id, doc_id, source_chunk_id, order_status, total_price, placed, gift
FROM stored
""")
def build_structure(spark, d):
    """Attributes are discovered in the texts, and every order becomes a row; the second run adds nothing."""
    out = shared_dir(spark, "structure")
    for _ in range(2):
        st.build_structure(order_chunks(spark, d), ["Order"], out)
    made = st.entity_tables(spark, out, ["Order"])["order"]
    return made.select("order_id", "doc_id", "source_chunk_id", "order_status", "total_price", "placed", "gift")


@query("query_structured", f"""
WITH {BUILT_SQL}
SELECT 'source' AS part, doc_id AS value FROM stored WHERE total_price > 300000
UNION ALL SELECT 'row', order_status || ' ' || count(*) FROM stored GROUP BY order_status
UNION ALL SELECT 'log', v FROM (VALUES ('big ok'), ('shares ok'), ('drop failed'), ('typo failed'), ('zero failed')) t(v)
""")
def query_structured(spark, d):
    """Two questions over the stored table, a forbidden statement, one that cannot be planned and one that fails while it runs; all are logged."""
    out = shared_dir(spark, "asked")
    chunks = order_chunks(spark, d)
    st.build_structure(chunks, ["Order"], out)
    tables = st.entity_tables(spark, out, ["Order"])
    asked = {
        "big": "SELECT source_chunk_id FROM order WHERE total_price > 300000".replace("order", "`order`"),
        "shares": "SELECT order_status, count(*) AS n FROM `order` GROUP BY order_status",
        "drop": "DROP TABLE `order`",
        "typo": "SELECT no_such_column FROM `order`",
        "zero": "SELECT doc_id, 1 / (length(order_status) - length(order_status)) AS r FROM `order`",
    }
    got = {
        name: st.query_structured(spark, name, sql, tables, chunks, chunks.select("doc_id"), f"{out}/log")
        for name, sql in asked.items()
    }
    sources = got["big"][1].select(F.lit("source").alias("part"), F.col("doc_id").alias("value"))
    shares = got["shares"][0].select(F.lit("row"), F.concat_ws(" ", "order_status", F.col("n").cast("string")))
    log = spark.read.schema(pv.LOG_SCHEMA).parquet(f"{out}/log")
    outcome = F.when(F.col("error").isNull(), "ok").otherwise("failed")
    return sources.union(shares).union(log.select(F.lit("log"), F.concat_ws(" ", "question", outcome)))
