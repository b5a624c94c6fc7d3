"""G: question classes."""

from pyspark.sql import functions as F

from corpusql.catalog.base import load, query, six, stamp
from corpusql.functions import questions as qs
from corpusql.plans import relational as rel

MONEY = "decimal(18,2)"


def money(column: str):
    return F.col(column).cast(MONEY)


def as_double(name: str):
    return F.col(name).cast("double").alias(name)


@query("q_count", "SELECT count(*)::BIGINT AS n FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 100000")
def q_count(spark, d):
    where = (F.col("o_orderstatus") == "F") & (F.col("o_totalprice") > 100000)
    return rel.count(load(spark, d, "orders"), where)


@query("q_aggregate", """
SELECT sum(l_quantity::DECIMAL(18,2))::DOUBLE AS total, round(avg(l_quantity) + 1e-9, 6) AS mean,
       min(l_extendedprice) AS lowest, max(l_extendedprice) AS highest FROM lineitem WHERE l_discount > 0.05
""")
def q_aggregate(spark, d):
    made = rel.aggregate(
        load(spark, d, "lineitem"),
        [("total", "sum", money("l_quantity")), ("mean", "avg", "l_quantity"),
         ("lowest", "min", "l_extendedprice"), ("highest", "max", "l_extendedprice")],
        F.col("l_discount") > 0.05,
    )
    return made.select(as_double("total"), six("mean").alias("mean"), "lowest", "highest")


@query("q_filter", """
SELECT p_partkey, p_name, p_retailprice FROM part
WHERE p_size >= 10 AND p_size < 30 AND p_brand = 'Brand#17' AND p_retailprice > 900
""")
def q_filter(spark, d):
    size = F.col("p_size")
    return rel.select_rows(
        load(spark, d, "part"), ["p_partkey", "p_name", "p_retailprice"],
        [(size >= 10) & (size < 30), F.col("p_brand") == "Brand#17", F.col("p_retailprice") > 900],
    )


@query("q_group_by", """
SELECT o_orderpriority, o_orderstatus, count(*)::BIGINT AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM orders GROUP BY ALL ORDER BY revenue DESC
""")
def q_group_by(spark, d):
    made = rel.group_by(
        load(spark, d, "orders"), ["o_orderpriority", "o_orderstatus"],
        [("orders", "count", "*"), ("revenue", "sum", money("o_totalprice"))], order=["-revenue"],
    )
    return made.withColumn("revenue", F.col("revenue").cast("double"))


@query("q_join", """
SELECT o_orderkey, c_name, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey
WHERE c_mktsegment = 'MACHINERY' AND o_totalprice > 400000
""")
def q_join(spark, d):
    orders, customers = load(spark, d, "orders"), load(spark, d, "customer")
    where = (F.col("c_mktsegment") == "MACHINERY") & (F.col("o_totalprice") > 400000)
    return rel.join(
        orders, customers, orders.o_custkey == customers.c_custkey, where,
        ["o_orderkey", "c_name", "o_totalprice"],
    )


@query("q_temporal", """
SELECT strftime(date_trunc('quarter', o_orderdate), '%Y-%m-%d') AS period, count(*)::BIGINT AS orders,
       sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue FROM orders GROUP BY 1
""")
def q_temporal(spark, d):
    made = rel.by_period(
        load(spark, d, "orders"), "o_orderdate", "quarter",
        [("orders", "count", "*"), ("revenue", "sum", money("o_totalprice"))],
    )
    return made.withColumn("revenue", F.col("revenue").cast("double"))


@query("q_temporal_delay", """
SELECT o_orderpriority, round(avg(date_diff('day', o_orderdate, l_shipdate)) + 1e-9, 6) AS mean_days
FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1
""")
def q_temporal_delay(spark, d):
    lines = load(spark, d, "lineitem").select("l_orderkey", "l_shipdate")
    orders = load(spark, d, "orders").select("o_orderkey", "o_orderdate", "o_orderpriority")
    both = lines.join(orders, lines.l_orderkey == orders.o_orderkey)
    made = rel.mean_delay(both, "o_orderdate", "l_shipdate", ["o_orderpriority"])
    return made.withColumn("mean_days", six("mean_days"))


@query("q_temporal_last_month", """
SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day FROM orders
WHERE o_orderdate >= TIMESTAMP '1998-02-01' AND o_orderdate < TIMESTAMP '1998-03-01'
""")
def q_temporal_last_month(spark, d):
    moment = F.to_date(F.lit("1998-03-15"))
    rows = rel.in_period_before(load(spark, d, "orders"), "o_orderdate", moment)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"))


@query("q_ranking", """
SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O' ORDER BY o_totalprice DESC, o_orderkey LIMIT 10
""")
def q_ranking(spark, d):
    made = rel.ranking(
        load(spark, d, "orders"), ["-o_totalprice", "o_orderkey"], 10, where=F.col("o_orderstatus") == "O"
    )
    return made.select("o_orderkey", "o_totalprice")


@query("q_ranking_per_group", """
SELECT * FROM (SELECT o_orderpriority, o_orderkey, o_totalprice, row_number() OVER
  (PARTITION BY o_orderpriority ORDER BY o_totalprice, o_orderkey)::INTEGER AS rank FROM orders) WHERE rank <= 3
""")
def q_ranking_per_group(spark, d):
    made = rel.ranking(load(spark, d, "orders"), ["o_totalprice", "o_orderkey"], 3, within=["o_orderpriority"])
    return made.select("o_orderpriority", "o_orderkey", "o_totalprice", "rank")


@query("q_lookup", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_name = 'Customer#000000042'")
def q_lookup(spark, d):
    return rel.lookup(load(spark, d, "customer"), c_name="Customer#000000042").select(
        "c_custkey", "c_name", "c_acctbal"
    )


@query("q_ratio", """
SELECT l_returnflag, round(avg(CASE WHEN l_extendedprice <> 0 THEN l_discount * l_quantity / l_extendedprice * 100 END) + 1e-9, 6) AS avg_pct,
       count(*)::BIGINT AS n FROM lineitem GROUP BY 1
""")
def q_ratio(spark, d):
    rows = rel.ratio(
        load(spark, d, "lineitem"), "pct", F.col("l_discount") * F.col("l_quantity"), F.col("l_extendedprice")
    )
    made = rel.group_by(rows, ["l_returnflag"], [("avg_pct", "avg", "pct"), ("n", "count", "*")])
    return made.withColumn("avg_pct", six("avg_pct"))


@query("q_multi_join", """
SELECT r_name, count(*)::BIGINT AS orders, sum(o_totalprice::DECIMAL(18,2))::DOUBLE AS revenue
FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
JOIN region ON n_regionkey = r_regionkey WHERE o_orderstatus = 'F' AND c_acctbal > 0 GROUP BY 1
""")
def q_multi_join(spark, d):
    rows = rel.multi_join(
        load(spark, d, "orders"),
        [
            (load(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")),
            (load(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")),
            (load(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")),
        ],
        (F.col("o_orderstatus") == "F") & (F.col("c_acctbal") > 0),
    )
    made = rel.group_by(rows, ["r_name"], [("orders", "count", "*"), ("revenue", "sum", money("o_totalprice"))])
    return made.withColumn("revenue", F.col("revenue").cast("double"))


@query("q_yoy_growth", """
WITH y AS (SELECT o_custkey, year(o_orderdate) AS y, sum(o_totalprice::DECIMAL(18,2)) AS v FROM orders GROUP BY ALL)
SELECT a.o_custkey, a.v::DOUBLE AS current, b.v::DOUBLE AS previous,
       round((a.v::DOUBLE - b.v::DOUBLE) / b.v::DOUBLE * 100, 6) AS growth_pct
FROM y a JOIN y b ON a.o_custkey = b.o_custkey WHERE a.y = 1998 AND b.y = 1997
""")
def q_yoy_growth(spark, d):
    yearly = load(spark, d, "orders").select(
        "o_custkey", F.year("o_orderdate").alias("year"), money("o_totalprice").alias("v")
    )
    made = rel.yoy_growth(yearly, "o_custkey", "year", "v", 1998)
    now, before = F.col("current").cast("double"), F.col("previous").cast("double")
    return made.select(
        "o_custkey", now.alias("current"), before.alias("previous"),
        F.round((now - before) / before * 100, 6).alias("growth_pct"),
    )


@query("q_semantic_range", """
SELECT o_orderkey, o_totalprice FROM orders
WHERE o_totalprice > (SELECT quantile_cont(o_totalprice, 0.95) FROM orders)
""")
def q_semantic_range(spark, d):
    return rel.above_percentile(load(spark, d, "orders"), "o_totalprice").select("o_orderkey", "o_totalprice")


@query("q_conditional_rate", """
SELECT c_mktsegment, count(*)::BIGINT AS n, count(*) FILTER (o_orderstatus = 'F')::BIGINT AS matching,
       round(avg((o_orderstatus = 'F')::INTEGER) + 1e-9, 6) AS rate
FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1
""")
def q_conditional_rate(spark, d):
    orders, customers = load(spark, d, "orders"), load(spark, d, "customer")
    rows = orders.join(customers, orders.o_custkey == customers.c_custkey)
    made = rel.conditional_rate(rows, ["c_mktsegment"], F.col("o_orderstatus") == "F")
    return made.withColumn("rate", six("rate"))


@query("q_sql", """
WITH big AS (SELECT * FROM orders WHERE o_totalprice >= 300000)
SELECT o_orderstatus, count(*)::BIGINT AS n FROM big WHERE o_orderpriority = '5-LOW' GROUP BY o_orderstatus
""")
def q_sql(spark, d):
    return rel.run_sql(
        spark,
        """WITH big AS (SELECT * FROM orders WHERE o_totalprice >= :floor)
           SELECT o_orderstatus, count(*) AS n FROM big WHERE o_orderpriority = :priority GROUP BY o_orderstatus""",
        {"orders": load(spark, d, "orders")},
        {"floor": 300000, "priority": "5-LOW"},
    )


QUESTIONS = (
    "How many orders does customer {} have?", "What is the average order value of customer {}?",
    "Which orders of customer {} are above 1000?", "Revenue of customer {} by quarter",
    "Suppliers along with the parts customer {} bought", "What did customer {} buy last month?",
    "Top 10 orders of customer {}", "Show customer {}",
    "Total revenue per region with customer {} and their top orders since 1998",
)


def customer_questions(spark, d):
    """A question per order about its customer, over all templates."""
    texts = F.array(*[F.lit(q) for q in QUESTIONS])
    pick = F.element_at(texts, (F.col("o_orderkey") % len(QUESTIONS) + 1).cast("int"))
    asked = F.replace(pick, F.lit("{}"), F.col("o_custkey").cast("string"))
    return load(spark, d, "orders").select("o_orderkey", asked.alias("question"))


QUESTIONS_SQL = (
    "q AS (SELECT o_orderkey, replace(CASE o_orderkey % " + str(len(QUESTIONS)) + " "
    + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(QUESTIONS))
    + " END, '{}', o_custkey::VARCHAR) AS question FROM orders)"
)

_HITS = [f"(CASE WHEN regexp_matches(question, '{rule}') THEN 1 ELSE 0 END)" for _, rule in qs.CLASS_RULES]
CLASSES_SQL = (
    "c AS (SELECT *, CASE "
    + " ".join(f"WHEN regexp_matches(question, '{rule}') THEN '{name}'" for name, rule in qs.CLASS_RULES)
    + f" ELSE 'simple' END AS query_type, regexp_matches(question, '{qs.JOIN_RULE}') AS requires_join, "
    + "(" + " + ".join(_HITS) + ") AS hits FROM q)"
)
CLASS_COLUMNS_SQL = """query_type, requires_join,
  CASE hits WHEN 0 THEN 'medium' WHEN 1 THEN 'simple' WHEN 2 THEN 'medium' ELSE 'complex' END AS complexity,
  CASE WHEN hits > 0 THEN 0.8 ELSE 0.5 END::DOUBLE AS confidence"""


@query("classify_questions", f"WITH {QUESTIONS_SQL}, {CLASSES_SQL} "
       f"SELECT o_orderkey, question, {CLASS_COLUMNS_SQL} FROM c")
def classify_questions(spark, d):
    return rel.classify_questions(customer_questions(spark, d))


STATEMENTS = (
    "SELECT * FROM orders WHERE o_custkey = {}", "with x as (select {} as k) select * from x",
    "DROP TABLE customer_{}", "SELECT {}; DELETE FROM orders", "SELECT updated_at FROM t{}",
    "SELECT ''please update'' AS s, {} AS k", "EXPLAIN SELECT {}", "  select {}", "TRUNCATE TABLE t{}",
)
STATEMENTS_SQL = (
    "s AS (SELECT o_orderkey, replace(CASE o_orderkey % " + str(len(STATEMENTS)) + " "
    + " ".join(f"WHEN {i} THEN '{q}'" for i, q in enumerate(STATEMENTS))
    + " END, '{}', o_custkey::VARCHAR) AS sql FROM orders)"
)
SAFE_SQL = r"""(regexp_matches(sql, '(?i)\A\s*(?:SELECT|WITH)') AND NOT regexp_matches(sql,
  '(?i)\b(?:DROP|DELETE|INSERT|UPDATE|ALTER|TRUNCATE|CREATE|GRANT|REVOKE)\b'))"""


def statements(spark, d):
    texts = F.array(*[F.lit(q.replace("''", "'")) for q in STATEMENTS])
    pick = F.element_at(texts, (F.col("o_orderkey") % len(STATEMENTS) + 1).cast("int"))
    sql = F.replace(pick, F.lit("{}"), F.col("o_custkey").cast("string"))
    return load(spark, d, "orders").select("o_orderkey", sql.alias("sql"))


@query("flag_unsafe_sql", f"WITH {STATEMENTS_SQL} SELECT o_orderkey, sql, {SAFE_SQL} AS is_safe FROM s")
def flag_unsafe_sql(spark, d):
    return rel.flag_unsafe_sql(statements(spark, d))


@query("explain_questions", f"WITH {QUESTIONS_SQL}, {CLASSES_SQL}, {STATEMENTS_SQL} "
       f"SELECT o_orderkey, question, {CLASS_COLUMNS_SQL}, sql, {SAFE_SQL} AS is_safe FROM c JOIN s USING (o_orderkey)")
def explain_questions(spark, d):
    return rel.explain_questions(customer_questions(spark, d), statements(spark, d), "o_orderkey")


@query("q_temporal_months", """
SELECT strftime(date_trunc('month', o_orderdate), '%Y-%m-%d') AS period, count(*)::BIGINT AS orders,
       strftime(min(o_orderdate), '%Y-%m-%d %H:%M:%S') AS first_order FROM orders GROUP BY 1
""")
def q_temporal_months(spark, d):
    made = rel.by_period(
        load(spark, d, "orders"), "o_orderdate", "month",
        [("orders", "count", "*"), ("first_order", "min", "o_orderdate")],
    )
    return made.withColumn("first_order", stamp("first_order"))
