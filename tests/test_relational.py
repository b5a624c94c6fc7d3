import pytest
from pyspark.sql import functions as F

from corpusql.functions import questions as qs
from corpusql.plans import relational as rel


@pytest.fixture(scope="module")
def deals(spark):
    rows = [
        ("d1", "Acme", 50000.0, 2023, "Won"), ("d2", "Beta", 20000.0, 2022, "Lost"), ("d3", "Acme", 40000.0, 2022, "Won"),
        ("d4", "Beta", None, 2023, "Open"), ("d5", "Corp", 0.0, 2023, "Won"),
    ]
    return spark.createDataFrame(rows, "deal_id string, company string, value double, year int, status string")


def test_store_and_filter_one_deal(spark, tmp_path):
    path = str(tmp_path / "deals")
    spark.createDataFrame([("deal_001", "Acme Corp", 50000.0)], "deal_id string, company string, v double").write.parquet(path)
    rows = rel.lookup(spark.read.parquet(path), deal_id="deal_001").collect()
    assert len(rows) == 1 and rows[0].v == 50000.0


def test_classes(deals):
    assert rel.count(deals, F.col("status") == "Won").collect()[0].n == 3
    row = rel.aggregate(deals, [("s", "sum", "value"), ("a", "avg", "value"), ("c", "count", "value"), ("d", "count_distinct", "company")]).collect()[0]
    assert (row.s, row.a, row.c, row.d) == (110000.0, 27500.0, 4, 3)
    grouped = rel.group_by(deals, ["company"], [("n", "count", "*")], order=["-n", "company"]).collect()
    assert [r.company for r in grouped] == ["Acme", "Beta", "Corp"]
    assert [r.deal_id for r in rel.ranking(deals, ["-value", "deal_id"], 2).collect()] == ["d1", "d3"]
    low = rel.ranking(deals, ["value", "deal_id"], 1, within=["company"], where=F.col("value").isNotNull()).collect()
    assert {r.deal_id for r in low} == {"d3", "d2", "d5"}
    rates = {r.company: r.rate for r in rel.conditional_rate(deals, ["company"], F.col("status") == "Won").collect()}
    assert rates == {"Acme": 1.0, "Beta": 0.0, "Corp": 1.0}


def test_growth(deals):
    got = {r.company: r.growth_pct for r in rel.yoy_growth(deals, "company", "year", "value", 2023).collect()}
    assert got == {"Acme": pytest.approx(25.0)}


def test_ratio_by_zero_is_null(deals):
    got = {r.deal_id: r.q for r in rel.ratio(deals, "q", F.lit(1.0), F.col("value")).collect()}
    assert got["d5"] is None and got["d1"] == pytest.approx(0.002)


def test_above_percentile(spark):
    rows = spark.range(1, 101).select(F.col("id").cast("double").alias("v"))
    assert sorted(r.v for r in rel.above_percentile(rows, "v").collect()) == [96.0, 97.0, 98.0, 99.0, 100.0]


def test_last_month_crosses_the_year(spark):
    rows = spark.createDataFrame([("2023-12-31",), ("2024-01-01",), ("2023-11-30",), ("2023-12-01",)], "d string").select(F.to_date("d").alias("d"))
    got = rel.in_period_before(rows, "d", F.to_date(F.lit("2024-01-20"))).collect()
    assert sorted(str(r.d) for r in got) == ["2023-12-01", "2023-12-31"]


def test_sql_binds_parameters_and_refuses_changes(spark, deals):
    sql = "SELECT count(*) AS n FROM deals WHERE company = :c"
    assert rel.run_sql(spark, sql, {"deals": deals}, {"c": "Acme"}).collect()[0].n == 2
    assert rel.run_sql(spark, "SELECT count(*) AS n FROM deals WHERE company = ?", {"deals": deals}, ["Beta"]).collect()[0].n == 2
    for bad in ("DROP TABLE deals", "SELECT 1; DELETE FROM deals", "EXPLAIN SELECT 1"):
        with pytest.raises(ValueError):
            rel.run_sql(spark, bad, {"deals": deals})


@pytest.mark.parametrize(
    "sql,safe",
    [
        ("SELECT * FROM t", True), ("with x as (select 1) select * from x", True), ("DROP TABLE t", False),
        ("SELECT 1; DELETE FROM t", False), ("SELECT updated_at FROM t", True), ("SELECT 'please update' AS s", False),
        ("EXPLAIN SELECT 1", False), ("  select 1", True), ("", False),
    ],
)
def test_safety(column, sql, safe):
    assert column([sql], qs.is_safe_sql) == [safe]


def test_question_classes(column):
    asked = {
        "How many deals?": "count", "Average deal value": "aggregation", "Deals above $1M": "filter", "Revenue by region": "group_by",
        "Top 10 deals": "ranking", "Deals closed last month": "temporal", "Show deal #123": "simple",
        "Products along with their makers": "join",
    }
    assert column(list(asked), qs.question_class) == list(asked.values())
    assert set(asked.values()) == set(qs.QUESTION_CLASSES)
    assert column(["Show deal #123"], qs.confidence) == [0.5]
    assert column(["Show deal #123"], qs.complexity) == ["medium"]


def test_filters_reach_the_scan(spark, sf_dir, capsys):
    rel.count(spark.read.parquet(f"{sf_dir}/orders.parquet"), F.col("o_orderstatus") == "F").explain()
    plan = capsys.readouterr().out
    assert "EqualTo(o_orderstatus,F)" in plan and "ReadSchema: struct<o_orderstatus:string>" in plan


def test_top_k_never_sorts_everything(deals, capsys):
    rel.ranking(deals, ["-value", "deal_id"], 2).explain()
    assert "TakeOrderedAndProject" in capsys.readouterr().out


def test_sql_leaves_the_callers_views_alone(spark):
    spark.range(3).createOrReplaceTempView("kept_view")
    other = spark.range(5)
    assert rel.run_sql(spark, "SELECT count(*) AS n FROM kept_view", {"kept_view": other}).first().n == 5
    assert spark.table("kept_view").count() == 3
    rel.run_sql(spark, "SELECT * FROM gone_view", {"gone_view": other})
    assert not spark.catalog.tableExists("gone_view")
    spark.catalog.dropTempView("kept_view")
