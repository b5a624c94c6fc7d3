"""E: extraction and value standardisation.

Raw values are the order table's own numbers, words and dates in the many
spellings documents use; the checking SQL computes them from the columns.
"""

from pyspark.sql import functions as F

from corpusql.catalog.base import load, orders, query, six
from corpusql.catalog.model_queries import order_replies
from corpusql.functions import standardize as sd
from corpusql.operators import extract as ex
from corpusql.operators.model import rule_based_extractor


def _pick(number, *choices):
    """The choice at ``number`` modulo their count."""
    out = None
    for i, choice in enumerate(choices[:-1]):
        case = number % len(choices) == i
        out = F.when(case, choice) if out is None else out.when(case, choice)
    return out.otherwise(choices[-1])


def _null(spark, d):
    k = F.col("o_orderkey")
    words = [F.lit(w) for w in ("", "  ", "null", " None ", "N/A", "na", "-", "NaN-like", " kept ")]
    return orders(spark, d).select("o_orderkey", _pick(k, *words, F.col("o_orderpriority")).alias("raw"))


@query("std_null_tokens", """
SELECT o_orderkey, CASE WHEN o_orderkey % 10 < 7 THEN NULL WHEN o_orderkey % 10 = 7 THEN 'NaN-like'
  WHEN o_orderkey % 10 = 8 THEN 'kept' ELSE o_orderpriority END AS value FROM orders
""")
def std_null_tokens(spark, d):
    return _null(spark, d).select("o_orderkey", sd.null_token(F.col("raw")).alias("value"))


def number_texts(spark, d):
    whole = F.floor("o_totalprice").cast("bigint")
    s = whole.cast("string")
    grouped = F.format_number(whole, 0)
    cents = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    forms = (
        F.concat(F.lit("$"), grouped), F.concat(F.lit("€ "), cents), F.concat(s, F.lit("%")),
        F.concat(s, F.lit("K")), F.concat(F.lit("-"), s, F.lit("M")), F.concat(s, F.lit(" billion dollars")),
        F.concat(s, F.lit(" million")), F.concat(F.lit("USD "), s), F.concat(F.lit("-"), cents),
        F.concat(F.lit("("), s, F.lit(")")), F.concat(s, F.lit(" thousand units")), F.lit("inf"),
    )
    return orders(spark, d).select("o_orderkey", _pick(F.col("o_orderkey"), *forms).alias("raw"))


def _number_sql(as_integer: bool) -> str:
    case = """CASE o_orderkey % 12 WHEN 0 THEN w WHEN 1 THEN p WHEN 2 THEN w WHEN 3 THEN w * 1000.0
      WHEN 4 THEN -w * 1000000.0 WHEN 5 THEN w * 1000000000.0 WHEN 6 THEN w * 1000000.0 WHEN 8 THEN -p
      WHEN 10 THEN w * 1000.0 END"""
    value = f"trunc({case})::BIGINT" if as_integer else f"({case})::DOUBLE"
    return (
        "WITH o AS (SELECT o_orderkey, floor(o_totalprice)::DOUBLE AS w, "
        "o_totalprice::DECIMAL(18,2)::DOUBLE AS p FROM orders) "
        f"SELECT o_orderkey, {value} AS value FROM o"
    )


@query("std_numeric", _number_sql(False))
def std_numeric(spark, d):
    return number_texts(spark, d).select("o_orderkey", sd.real(F.col("raw")).alias("value"))


@query("std_integer", _number_sql(True))
def std_integer(spark, d):
    return number_texts(spark, d).select("o_orderkey", sd.integer(F.col("raw")).alias("value"))


@query("std_boolean", """
SELECT o_orderkey, CASE WHEN o_orderkey % 9 IN (0, 2, 4, 6) THEN true WHEN o_orderkey % 9 IN (1, 3, 5, 7) THEN false END AS value
FROM orders
""")
def std_boolean(spark, d):
    words = [F.lit(w) for w in ("Yes", "no", "ON", "Off", "available", "not included", " 1 ", "0")]
    rows = orders(spark, d).select(
        "o_orderkey", _pick(F.col("o_orderkey"), *words, F.col("o_orderpriority")).alias("raw")
    )
    return rows.select("o_orderkey", sd.boolean(F.col("raw")).alias("value"))


def date_texts(spark, d):
    day = F.col("o_orderdate")
    fmt = lambda pattern: F.date_format(day, pattern)
    forms = (
        fmt("yyyy-MM-dd"), F.concat(F.lit("Closed "), fmt("yyyy-MM-dd"), F.lit("T10:30")), fmt("MM/dd/yyyy"),
        fmt("MM-dd-yyyy"), fmt("d MMMM yyyy"), fmt("MMMM d, yyyy"), fmt("MMM d, yyyy"),
        F.concat(F.lit("13/45/"), fmt("yyyy")),
    )
    return orders(spark, d).select("o_orderkey", _pick(F.col("o_orderkey"), *forms).alias("raw"))


# May is its own abbreviation, so the short form of a May date is a full date.
DATE_SQL = """
WITH o AS (SELECT o_orderkey, o_orderkey % 8 AS f, strftime(o_orderdate, '%Y-%m-%d') AS iso,
             strftime(o_orderdate, '%b %-d, %Y') AS short, strftime(o_orderdate, '%Y') AS y,
             month(o_orderdate) = 5 AS may FROM orders)
SELECT o_orderkey, CASE WHEN f < 6 OR (f = 6 AND may) THEN iso WHEN f = 6 THEN short ELSE '13/45/' || y END AS value,
       CASE WHEN f < 6 OR (f = 6 AND may) THEN iso END AS typed FROM o
"""


@query("std_date", DATE_SQL)
def std_date(spark, d):
    raw = F.col("raw")
    return date_texts(spark, d).select(
        "o_orderkey", sd.date_text(raw).alias("value"),
        F.date_format(sd.date(raw), "yyyy-MM-dd").alias("typed"),
    )


@query("std_text", r"""
SELECT doc_id, nullif(CASE WHEN lower(v) IN ('null', 'none', 'n/a', 'na', '-') THEN '' ELSE
  regexp_replace(v, '\A["'']+|["'']+\z', '', 'g') END, '') AS value
FROM (SELECT doc_id, trim(regexp_replace(text, '[\s\x0B\x1c-\x1f\x{0085}\p{Z}]+', ' ', 'g'), ' ') AS v FROM documents)
""")
def std_text(spark, d):
    docs = load(spark, d, "documents")
    return docs.select("doc_id", F.nullif(sd.text(F.col("text")), F.lit("")).alias("value"))


def raw_entities(spark, d):
    """Orders as attribute maps with untidy values, as an extractor returns them."""
    k = F.col("o_orderkey")
    price = F.col("o_totalprice").cast("decimal(18,2)").cast("string")
    return orders(spark, d).select(
        F.col("o_orderkey").cast("string").alias("doc_id"),
        F.lit(0).alias("ordinal"),
        F.create_map(
            F.lit("status"), F.concat(F.lit('  "'), F.col("o_orderstatus"), F.lit('" ')),
            F.lit("total"), _pick(k, F.concat(F.lit("$"), price), F.lit("unknown"), price),
            F.lit("lines"), _pick(k, F.lit("3"), F.lit("3.9"), F.lit("4"), F.lit("n/a")),
            F.lit("urgent"), _pick(k, F.lit("Yes"), F.lit("no")),
            F.lit("placed"), F.date_format("o_orderdate", "MM/dd/yyyy"),
            F.lit("remark"), F.concat(F.col("o_orderpriority"), F.lit("  extra")),
        ).alias("attributes"),
        (0.7 + (k % 3) / 10).alias("confidence"),
        F.lit("source").alias("source_text"),
    )


ORDER_TYPES = {"status": "TEXT", "total": "REAL", "lines": "INTEGER", "urgent": "BOOLEAN", "placed": "DATE"}

ENTITY_SQL = """
e AS (SELECT o_orderkey::VARCHAR AS doc_id, o_orderstatus AS status,
  CASE WHEN o_orderkey % 3 <> 1 THEN o_totalprice::DECIMAL(18,2)::DOUBLE END AS total,
  CASE o_orderkey % 4 WHEN 0 THEN 3 WHEN 1 THEN 3 WHEN 2 THEN 4 END::BIGINT AS lines,
  o_orderkey % 2 = 0 AS urgent, strftime(o_orderdate, '%Y-%m-%d') AS placed,
  o_orderpriority || ' extra' AS remark, o_orderkey FROM orders)
"""


@query("standardize_entity", f"WITH {ENTITY_SQL} SELECT doc_id, status, total, lines, urgent, placed, remark FROM e")
def standardize_entity(spark, d):
    made = ex.standardize_attributes(raw_entities(spark, d), ORDER_TYPES)
    return made.select("doc_id", *ORDER_TYPES, F.col("other_attributes")["remark"].alias("remark"))


ATTRIBUTES = [
    {"name": n, "type": t, "is_nullable": n != "lines"} for n, t in ORDER_TYPES.items()
]


@query("conform_and_store", f"""
WITH {ENTITY_SQL}
SELECT substr(md5('Order_' || doc_id || '_0'), 1, 16) AS order_id, doc_id, status, total, lines, urgent, placed,
       NULL::VARCHAR AS reason FROM e WHERE o_orderkey % 3 <> 1 AND o_orderkey % 4 <> 3
UNION ALL SELECT NULL, doc_id, NULL, NULL, NULL, NULL, NULL,
  concat_ws('; ', CASE WHEN o_orderkey % 3 = 1 THEN 'total: not REAL' END,
                  CASE WHEN o_orderkey % 4 = 3 THEN 'lines: missing' END)
FROM e WHERE o_orderkey % 3 = 1 OR o_orderkey % 4 = 3
""")
def conform_and_store(spark, d):
    """Stored rows and rejects, read back from the tables."""
    from corpusql.session import shared_dir

    out = shared_dir(spark, "entities")
    for _ in range(2):  # the second run adds nothing
        ex.conform_and_store(raw_entities(spark, d), "Order", ATTRIBUTES, out)
    good = spark.read.parquet(f"{out}/order").select("order_id", "doc_id", *ORDER_TYPES)
    bad = spark.read.parquet(f"{out}/order_rejects").select("doc_id", "reason")
    return good.unionByName(bad, allowMissingColumns=True)


@query("explode_entities", """
SELECT o_orderkey, 0 AS ordinal, o_orderstatus AS status, o_totalprice::DECIMAL(18,2)::VARCHAR AS total, 0.9::DOUBLE AS confidence
FROM orders WHERE o_orderkey % 6 < 5
UNION ALL SELECT o_orderkey, 1, 'second', NULL, 0.7::DOUBLE FROM orders WHERE o_orderkey % 6 = 3
""")
def explode_entities(spark, d):
    parsed = ex.parse_replies(order_replies(spark, d))
    rows = ex.explode_entities(parsed, ["o_orderkey"])
    return rows.select(
        "o_orderkey", "ordinal", F.col("attributes")["status"].alias("status"),
        F.col("attributes")["total"].alias("total"), "confidence",
    )


def order_texts(spark, d):
    """Orders as labelled documents; the second kind lacks most labels."""
    k = F.col("o_orderkey")
    full = F.concat(
        F.lit("Status: "), F.col("o_orderstatus"), F.lit("\nTotal: $"),
        F.col("o_totalprice").cast("decimal(18,2)").cast("string"), F.lit("\nPlaced: "),
        F.date_format("o_orderdate", "MMMM d, yyyy"), F.lit("\nThanks for your order."),
    )
    thin = F.concat(F.lit("Status: "), F.col("o_orderstatus"), F.lit("\nNo more is known."))
    return orders(spark, d).select(
        F.col("o_orderkey").cast("string").alias("doc_id"), _pick(k, full, full, thin).alias("text")
    )


CORPUS_TYPES = {"status": "TEXT", "total": "REAL", "placed": "DATE"}


@query("extract_corpus", """
SELECT o_orderkey::VARCHAR AS doc_id, o_orderstatus AS status, o_totalprice::DECIMAL(18,2)::DOUBLE AS total,
       strftime(o_orderdate, '%Y-%m-%d') AS placed, 1.0::DOUBLE AS confidence FROM orders WHERE o_orderkey % 3 < 2
""")
def extract_corpus(spark, d):
    """The rule-based model over all documents; thin documents fall below the confidence bound."""
    found, _, _ = ex.extract_corpus(order_texts(spark, d), {"Order": CORPUS_TYPES}, rule_based_extractor)
    made = ex.standardize_attributes(found, CORPUS_TYPES)
    return made.select("doc_id", *CORPUS_TYPES, "confidence")


@query("extraction_summary", """
SELECT entity, count(*)::BIGINT AS entities, round(avg(c) + 1e-9, 6) AS avg_confidence FROM (
  SELECT o_orderstatus AS entity, 0.9 AS c FROM orders WHERE o_orderkey % 6 < 5
  UNION ALL SELECT o_orderstatus, 0.7 FROM orders WHERE o_orderkey % 6 = 3) GROUP BY 1
""")
def extraction_summary(spark, d):
    parsed = ex.parse_replies(order_replies(spark, d))
    rows = ex.explode_entities(parsed, ["o_orderkey", "o_orderstatus"])
    made = ex.extraction_summary(rows.withColumnRenamed("o_orderstatus", "entity"), ["entity"])
    return made.withColumn("avg_confidence", six("avg_confidence"))


@query("rejected_replies", """
SELECT o_orderkey, 'not JSON' AS reason FROM orders WHERE o_orderkey % 6 = 5
""")
def rejected_replies(spark, d):
    return ex.rejected_replies(ex.parse_replies(order_replies(spark, d)), ["o_orderkey"])

