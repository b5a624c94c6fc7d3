import pytest
from pyspark.sql import functions as F

from corpusql.operators import schema as sc

ATTRS = "entity string, name string, type string, confidence double, is_primary_key boolean"


def attrs(spark, *rows):
    return spark.createDataFrame(list(rows), ATTRS)


CALLS = [
    "Company: Acme\nDeal Value: $50,000\nStatus: open\nClose Date: 2024-01-15\nWon: yes",
    "Company: Beta\nDeal Value: 1.5M\nStatus: open\nClose Date: March 3, 2024\nWon: no\nUsers: 12",
    "Company: Acme\nDeal Value: n/a\nStatus: won\nsee http://x.y: z\nUsers: 7",
]


def test_induced_attributes(spark):
    docs = spark.createDataFrame(list(enumerate(CALLS)), "doc_id int, text string")
    got = {r.name: r for r in sc.induce_attributes(sc.labelled_values(docs), docs, "Deal").collect()}
    assert {n: r.type for n, r in got.items()} == {
        "company": "TEXT", "deal_value": "INTEGER", "status": "TEXT", "close_date": "DATE", "won": "BOOLEAN", "users": "INTEGER",
    }
    assert got["company"].confidence == 1.0 and not got["company"].is_nullable
    assert got["users"].confidence == pytest.approx(2 / 3) and got["users"].is_nullable
    assert got["status"].examples == ["open", "won"]


def test_a_label_twice_in_a_document_counts_once(spark):
    docs = spark.createDataFrame([(1, "A: x\na: y\nA: x"), (2, "B: z")], "doc_id int, text string")
    got = {r.name: r.confidence for r in sc.induce_attributes(sc.labelled_values(docs), docs, "E").collect()}
    assert got == {"a": 0.5, "b": 0.5}


def test_confidence_threshold(spark):
    rows = attrs(spark, ("E", "a", "TEXT", 0.69, False), ("E", "b", "TEXT", 0.7, False), ("E", "c", "TEXT", None, False))
    assert [r.name for r in sc.confidence_filter(rows).collect()] == ["b"]


def test_primary_key_is_added_only_where_missing(spark):
    rows = attrs(
        spark, ("Deal", "v", "REAL", 0.9, False), ("Company", "company_id", "TEXT", 1.0, True), ("Company", "n", "TEXT", 1.0, None)
    )
    keys = sc.ensure_primary_key(rows).filter("is_primary_key").collect()
    assert {(r.entity, r.name, r.type, r.is_nullable) for r in keys} == {
        ("Deal", "deal_id", "TEXT", False), ("Company", "company_id", "TEXT", None),
    }


def test_primary_key_check(spark):
    rows = attrs(
        spark, ("A", "x", "TEXT", 1.0, True), ("B", "x", "TEXT", 1.0, True), ("B", "y", "TEXT", 1.0, True), ("C", "x", "TEXT", 1.0, None)
    )
    got = {r.entity: (r.valid, r.message) for r in sc.validate_primary_key(rows).collect()}
    assert got["A"] == (True, None)
    assert got["B"] == (False, "2 primary keys")
    assert got["C"][0] is False


def test_names(spark):
    rows = attrs(spark, *[("Deal 1" if n == "x" else "Deal", n, "TEXT", 1.0, False)
                          for n in ("Deal Value", "2nd_price", "price/night", "", None, "_", "x", "größe")])
    got = {r.name: (r.clean_name, r.name_ok, r.entity_ok) for r in sc.validate_names(rows).collect()}
    assert got["Deal Value"] == ("deal_value", True, True)
    assert [got[n][1] for n in ("2nd_price", "price/night", "", None, "_", "größe")] == [False] * 5 + [True]
    assert got["x"][2] is False


def test_json_properties(spark):
    docs = spark.createDataFrame(
        [('{"Key": 1, "p": 1, "t": [1], "o": {"a": 1}, "b": true, "m": 1}',),
         ('{"Key": 2, "p": 1.5, "t": [], "o": null, "b": false, "m": "x"}',), ('{"Key": null}',)],
        "j string",
    )
    props = sc.json_properties(docs, "j", "E")
    kept, dropped = sc.drop_nested(props)
    assert {r.property for r in dropped.collect()} == {"t", "o"}
    got = {r.name: (r.type, r.is_nullable) for r in sc.map_json_types(kept).collect()}
    assert got == {"key": ("INTEGER", False), "p": ("REAL", True), "b": ("BOOLEAN", True), "m": ("TEXT", True)}


def test_user_schema(spark):
    rows = attrs(
        spark, ("Deal", "Deal Value", "REAL", 0.9, False), ("Deal", "x", "VARCHAR", 0.9, False), ("Deal", "y", "TEXT", 1.2, False)
    )
    good, bad = sc.user_schema(rows)
    assert [r.name for r in good.collect()] == ["deal_value"]
    assert {r.name for r in bad.collect()} == {"x", "y"}


def test_spark_schema():
    made = sc.spark_schema([
        {"name": "deal_id", "type": "TEXT", "is_primary_key": True, "is_nullable": False},
        {"name": "deal_value", "type": "REAL"}, {"name": "n", "type": "INTEGER"},
    ])
    assert made.simpleString() == "struct<deal_id:string,deal_value:double,n:bigint>"
    assert not made["deal_id"].nullable and made["deal_id"].metadata["primary_key"]


def test_relationships(spark):
    child = spark.createDataFrame([(1,), (1,), (2,), (9,), (None,)], "fk int")
    parent = spark.createDataFrame([(1,), (2,), (3,)], "id int")
    r = sc.relationship_check(child, "fk", parent, "id").collect()[0]
    assert (r.child_rows, r.orphan_rows, r.parents_without_child, r.max_children) == (4, 1, 1, 2)
    assert r.cardinality == "many-to-one"
    one = sc.relationship_check(parent.limit(2), "id", parent, "id").collect()[0]
    assert one.cardinality == "one-to-one"


def test_registry(spark):
    schema = "table_name string, entity_type string, schema_json string, created_at int"
    old = spark.createDataFrame([("deal", "Deal", "v1", 1), ("company", "Company", "v1", 1)], schema)
    new = spark.createDataFrame([("DEAL", "Deal", "v2", 2), ("user", "User", "v1", 2)], schema)
    got = {r.table_name: r.schema_json for r in sc.registry_upsert(old, new).collect()}
    assert got == {"deal": "v2", "company": "v1", "user": "v1"}
    again = sc.registry_upsert(sc.registry_upsert(old, new), new)
    assert again.count() == 3
    both = old.unionByName(new)
    assert [r.schema_json for r in sc.latest_schema(both, "DeAl").collect()] == ["v2"]
    assert sc.latest_schema(both).count() == 3


def test_rounds(spark):
    rows = spark.createDataFrame(
        [("a", 1, "s1", 1), ("a", 2, None, 2), ("a", 3, "s3", 3), ("b", 1, None, 1), ("b", 2, "s2", 2), ("c", 1, "x", 1), ("c", 1, "y", 2)]
        + [("six", r, f"v{r}", r) for r in range(1, 7)],
        "entity string, round int, schema string, created_at int",
    )
    got = {(r.entity, r.round): (r.schema, r.status) for r in sc.refine_schema_runs(rows, ["entity"]).collect()}
    assert [got["a", r] for r in (1, 2, 3, 4)] == [("s1", "refined"), ("s1", "kept"), ("s3", "refined"), ("s3", "missing")]
    assert got["b", 2] == (None, "fatal")
    assert got["c", 1] == ("y", "refined")
    assert got["six", 6] == ("v6", "refined") and got["a", 6] == ("s3", "missing")


def test_labels_of_any_length_and_alphabet(spark):
    long = "a label of more than sixty one characters that goes on for a while"
    text = f"{long}: 1\nGröße: 2\nhttp://x.y\nGröße: 3\n1st: no\n  Name :  Ann : Bob"
    docs = spark.createDataFrame([("d", text)], "doc_id string, text string")
    got = [(r.name, r.value, r.first) for r in sc.labelled_values(docs).collect()]
    assert sorted(got) == sorted([
        (long.replace(" ", "_"), "1", True), ("größe", "2", True), ("größe", "3", False), ("name", "Ann : Bob", True),
    ])


def test_explain_schema(spark):
    deals = spark.createDataFrame([("d", 1.0)], "deal_id string, v double")
    notes = attrs(spark, ("Deal", "deal_id", "TEXT", 1.0, True), ("Deal", "v", "REAL", 0.9, False))
    got = {r.column_name: (r.column_type, r.row_count, r.note) for r in sc.explain_schema({"deal": deals}, notes).collect()}
    assert got == {"deal_id": ("string", 1, "PK"), "v": ("double", 1, "0.90")}


def test_evolution_and_backfill(spark):
    old = attrs(spark, ("D", "a", "TEXT", 1.0, False), ("D", "b", "TEXT", 1.0, False), ("D", "c", "TEXT", 1.0, False))
    new = attrs(spark, ("D", "b", "TEXT", 1.0, False), ("D", "c", "REAL", 1.0, False), ("P", "a", "TEXT", 1.0, False))
    got = {(r.entity, r.name): r.change for r in sc.schema_evolution(old, new).collect()}
    assert got == {("D", "a"): "removed", ("D", "b"): "kept", ("D", "c"): "retyped", ("P", "a"): "added"}
    rows = sc.backfill(old.select("entity", "name"), new.select("entity", "type"))
    assert rows.columns == ["entity", "name", "type"] and rows.count() == 6


def test_discovered_relationships(spark):
    deals = spark.createDataFrame([("d1", "Acme"), ("d2", "Beta"), ("d3", "Acme")], "id string, company string")
    firms = spark.createDataFrame([("Acme", 5), ("Beta", 7), ("Corp", 9)], "name string, employees int")
    got = [(r.a_table, r.a_column, r.b_table, r.b_column, r.containment)
           for r in sc.discover_relationships({"deals": deals, "firms": firms}).collect()]
    assert got == [("deals", "company", "firms", "name", 1.0)]
    loose = sc.discover_relationships({"deals": deals, "firms": firms}, 0.5)
    assert loose.filter(F.col("a_column") == "name").count() == 1


def test_relationships_over_more_columns_than_one_mask_holds(spark):
    wide = spark.range(20).select(*[(F.col("id") + i * 100).alias(f"c{i}") for i in range(70)])
    other = spark.range(20).select((F.col("id") + 6900).alias("key"))
    got = sc.discover_relationships({"wide": wide, "other": other}).collect()
    assert {(r.a_table, r.a_column, r.b_column) for r in got} == {("wide", "c69", "key"), ("other", "key", "c69")}


def test_samples_rule_out_columns_but_no_related_pair(spark):
    rows = 3000
    orders = spark.createDataFrame(
        [(i, i % 1000 if i % 11 else 5000 + i, f"only here {i}", f"c{i % 1000}") for i in range(rows)],
        "order_id long, firm long, note string, code string",
    )
    firms = spark.createDataFrame([(i, f"c{i}", f"text {i}") for i in range(4000)], "firm_id long, firm_code string, text string")
    tables = {"orders": orders, "firms": firms, "none": spark.createDataFrame([], "x long, y string")}
    columns = sc._key_columns(tables)
    kept = {c for n, _, c, _ in columns if n in sc._possible_columns(tables, columns, 0.75, 2)}
    assert kept == {"order_id", "firm", "firm_id", "code", "firm_code"}
    got = {(r.a_column, r.b_column): (r["distinct"], r.shared) for r in sc.discover_relationships(tables, 0.75).collect()}
    ids = {i % 1000 if i % 11 else 5000 + i for i in range(rows)}
    assert got == {
        ("order_id", "firm_id"): (3000, 3000), ("firm", "firm_id"): (len(ids), sum(i < 4000 for i in ids)),
        ("code", "firm_code"): (1000, 1000), ("firm_id", "order_id"): (4000, 3000),
    }
    nothing = {"notes": orders.select("note"), "texts": firms.select("text")}
    assert sc.discover_relationships(nothing).count() == 0
    assert sc._at_most(200, 256, 0.9) > 1e-12 > sc._at_most(170, 256, 0.9)


def test_texts_are_read_once_for_the_attributes(spark, tmp_path):
    """Types and examples come from stored counts: a text that is gone afterwards is not asked for again."""
    path = str(tmp_path / "docs")
    spark.createDataFrame(list(enumerate(CALLS)), "doc_id int, text string").write.parquet(path)
    docs = spark.read.parquet(path)
    made = sc.induce_attributes(sc.labelled_values(docs), docs, "Deal")
    assert "regexp_extract_all" not in made._jdf.queryExecution().optimizedPlan().toString()
    assert {r.name: r.type for r in made.collect()}["deal_value"] == "INTEGER"
