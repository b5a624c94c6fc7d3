"""D: schema induction and registry.

Attributes are induced from texts and JSON made of the orders and events, so
every later rule works on rows that come from the whole tables.
"""

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusql.catalog.base import joined, load, orders, query, six, stamp
from corpusql.operators import schema as sc


def labelled_orders(spark, d):
    """Orders as labelled text; some labels occur in every document, some in a share of them."""
    k = F.col("o_orderkey")
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("Order Status: "), F.col("o_orderstatus")),
        F.when(k % 10 != 0, F.concat(F.lit("Total Price: $"), F.col("o_totalprice").cast("decimal(18,2)").cast("string"))),
        F.when(k % 4 != 0, F.concat(F.lit("Placed: "), F.date_format("o_orderdate", "MM/dd/yyyy"))),
        F.when(k % 2 == 0, F.concat(F.lit("Customer: "), F.col("o_custkey").cast("string"))),
        F.concat(F.lit("Gift: "), F.when(k % 3 == 0, "yes").otherwise("no")),
        F.lit("Thank you for your order."),
    )
    return orders(spark, d).select(k.alias("doc_id"), lines.alias("text"))


def induced(spark, d):
    docs = labelled_orders(spark, d)
    return sc.induce_attributes(sc.labelled_values(docs), docs, "Order")


ATTR_SQL = """
vals AS (
  SELECT o_orderkey, 'order_status' AS name, o_orderstatus AS v FROM orders
  UNION ALL SELECT o_orderkey, 'total_price', '$' || o_totalprice::DECIMAL(18,2)::VARCHAR FROM orders WHERE o_orderkey % 10 <> 0
  UNION ALL SELECT o_orderkey, 'placed', strftime(o_orderdate, '%m/%d/%Y') FROM orders WHERE o_orderkey % 4 <> 0
  UNION ALL SELECT o_orderkey, 'customer', o_custkey::VARCHAR FROM orders WHERE o_orderkey % 2 = 0
  UNION ALL SELECT o_orderkey, 'gift', CASE WHEN o_orderkey % 3 = 0 THEN 'yes' ELSE 'no' END FROM orders),
tops AS (SELECT name, string_agg(v, '|' ORDER BY n DESC, v) AS examples FROM (
  SELECT name, v, count(*) AS n, row_number() OVER (PARTITION BY name ORDER BY count(*) DESC, v) AS r
  FROM vals GROUP BY name, v) WHERE r <= 5 GROUP BY 1),
attrs AS (SELECT 'Order' AS entity, name, CASE name WHEN 'order_status' THEN 'TEXT' WHEN 'total_price' THEN 'REAL'
    WHEN 'placed' THEN 'DATE' WHEN 'customer' THEN 'INTEGER' ELSE 'BOOLEAN' END AS type,
  count(DISTINCT o_orderkey) / (SELECT count(*) FROM orders)::DOUBLE AS confidence,
  count(DISTINCT o_orderkey)::BIGINT AS documents, any_value(examples) AS examples
  FROM vals JOIN tops USING (name) GROUP BY name)
"""


@query("induce_attributes", f"""
WITH {ATTR_SQL} SELECT entity, name, type, round(confidence + 1e-9, 6) AS confidence, documents, examples,
  documents < (SELECT count(*) FROM orders) AS is_nullable FROM attrs
""")
def induce_attributes(spark, d):
    return induced(spark, d).select(
        "entity", "name", "type", six("confidence").alias("confidence"), "documents",
        joined("examples", "|").alias("examples"), "is_nullable",
    )


@query("induce_json_attributes", r"""
SELECT event_type AS entity, 'k' AS name, 'INTEGER' AS type, 1.0::DOUBLE AS confidence, count(*)::BIGINT AS documents
FROM events GROUP BY 1
""")
def induce_json_attributes(spark, d):
    """Keys of the JSON column; every event type is an entity."""
    events = load(spark, d, "events").withColumnRenamed("event_type", "entity")
    values = sc.json_values(events, "event_id", "props", ["entity"])
    made = sc.induce_attributes(values, events)
    return made.select("entity", "name", "type", "confidence", "documents")


@query("confidence_filter", f"""
WITH {ATTR_SQL} SELECT entity, name, round(confidence + 1e-9, 6) AS confidence FROM attrs WHERE confidence >= 0.7
""")
def confidence_filter(spark, d):
    kept = sc.confidence_filter(induced(spark, d))
    return kept.select("entity", "name", six("confidence").alias("confidence"))


@query("ensure_primary_key", f"""
WITH {ATTR_SQL} SELECT entity, name, type, false AS is_primary_key FROM attrs
UNION ALL SELECT 'Order', 'order_id', 'TEXT', true
""")
def ensure_primary_key(spark, d):
    return sc.ensure_primary_key(induced(spark, d)).select("entity", "name", "type", "is_primary_key")


def order_json(spark, d):
    """Orders as JSON objects with scalars, a list, an object and an optional key."""
    k = F.col("o_orderkey")
    body = F.struct(
        k.alias("Order Key"), F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"),
        (k % 2 == 0).alias("even"), F.array("o_orderstatus", "o_orderpriority").alias("tags"),
        F.struct("o_custkey").alias("customer"),
        F.when(k % 5 != 0, F.col("o_orderpriority")).alias("priority"),
        # Texts that look like something else.
        F.lpad((k % 1000).cast("string"), 5, "0").alias("zip"), F.when(k % 2 == 0, "true").otherwise("null").alias("flag"),
        F.concat(F.lit("[draft] "), "o_orderpriority").alias("note"), F.concat(F.lit("{"), "o_orderstatus", F.lit("}")).alias("mark"),
    )
    return orders(spark, d).select(k.alias("doc_id"), F.to_json(body).alias("j"))


PROP_SQL = """
n AS (SELECT count(*) AS n, count(*) FILTER (o_orderkey % 5 <> 0) AS p FROM orders),
props AS (SELECT 'Order' AS entity, * FROM (VALUES ('Order Key', 'integer'), ('price', 'number'), ('status', 'string'),
  ('even', 'boolean'), ('tags', 'array'), ('customer', 'object'), ('priority', 'string'),
  ('zip', 'string'), ('flag', 'string'), ('note', 'string'), ('mark', 'string')) v(property, json_type)),
required AS (SELECT props.*, CASE WHEN property = 'priority' THEN p = n ELSE n > 0 END AS required FROM props, n)
"""


@query("drop_nested_attributes", f"""
WITH {PROP_SQL} SELECT property, json_type, required, json_type IN ('array', 'object') AS excluded FROM required
""")
def drop_nested_attributes(spark, d):
    kept, dropped = sc.drop_nested(sc.json_properties(order_json(spark, d), "j", "Order"))
    both = kept.withColumn("excluded", F.lit(False)).unionByName(dropped.withColumn("excluded", F.lit(True)))
    return both.select("property", "json_type", "required", "excluded")


@query("map_json_types", f"""
WITH {PROP_SQL} SELECT entity, lower(replace(property, ' ', '_')) AS name, CASE json_type WHEN 'integer' THEN 'INTEGER'
  WHEN 'number' THEN 'REAL' WHEN 'boolean' THEN 'BOOLEAN' ELSE 'TEXT' END AS type, 0.9::DOUBLE AS confidence,
  NOT required AS is_nullable FROM required WHERE json_type NOT IN ('array', 'object')
""")
def map_json_types(spark, d):
    kept, _ = sc.drop_nested(sc.json_properties(order_json(spark, d), "j", "Order"))
    return sc.map_json_types(kept).drop("is_primary_key")


def part_names(spark, d):
    """Part names as attribute names, made valid or invalid by the part number."""
    k = F.col("p_partkey")
    name = (
        F.when(k % 4 == 0, F.initcap("p_name"))
        .when(k % 4 == 1, F.concat(k.cast("string"), F.lit("nd price")))
        .when(k % 4 == 2, F.concat(F.col("p_name"), F.lit("/unit")))
        .otherwise(F.col("p_type"))
    )
    entity = F.when(k % 3 == 0, F.col("p_brand")).otherwise(F.col("p_type"))
    return load(spark, d, "part").select("p_partkey", name.alias("name"), entity.alias("entity"))


@query("validate_names", """
WITH p AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_partkey || 'nd price'
    WHEN 2 THEN p_name || '/unit' ELSE p_type END AS name,
  CASE WHEN p_partkey % 3 = 0 THEN p_brand ELSE p_type END AS entity FROM part)
SELECT p_partkey, lower(replace(name, ' ', '_')) AS clean_name,
  regexp_full_match(lower(replace(name, ' ', '_')), '[a-z_][a-z0-9_]*') AS name_ok,
  regexp_full_match(entity, '[A-Za-z0-9_]+') AS entity_ok FROM p
""")
def validate_names(spark, d):
    return sc.validate_names(part_names(spark, d)).select("p_partkey", "clean_name", "name_ok", "entity_ok")


def user_attributes(spark, d):
    """One attribute row per event: an entity per user, event types as names."""
    return load(spark, d, "events").select(
        F.concat(F.lit("user_"), F.col("user_id").cast("string")).alias("entity"),
        F.concat(F.col("event_type"), F.lit("_"), F.col("event_id").cast("string")).alias("name"),
        F.when(F.col("event_type") == "error", "VARCHAR").otherwise("TEXT").alias("type"),
        F.when(F.col("event_type") != "view", F.col("value") / 100).alias("confidence"),
        (F.col("event_id") % 97 == 0).alias("is_primary_key"),
    )


@query("validate_primary_key", """
SELECT 'user_' || user_id AS entity, count(*) FILTER (event_id % 97 = 0)::BIGINT AS primary_keys,
  count(*) FILTER (event_id % 97 = 0) = 1 AS valid,
  CASE count(*) FILTER (event_id % 97 = 0) WHEN 0 THEN 'no primary key' WHEN 1 THEN NULL
  ELSE count(*) FILTER (event_id % 97 = 0) || ' primary keys' END AS message
FROM events GROUP BY user_id
""")
def validate_primary_key(spark, d):
    return sc.validate_primary_key(user_attributes(spark, d))


@query("user_schema", """
SELECT 'user_' || user_id AS entity, event_type || '_' || event_id AS name,
  event_type <> 'error' AND event_type <> 'view' AND value / 100 BETWEEN 0 AND 1 AS accepted FROM events
""")
def user_schema(spark, d):
    good, bad = sc.user_schema(user_attributes(spark, d))
    yes = good.select("entity", "name", F.lit(True).alias("accepted"))
    return yes.unionByName(bad.select("entity", "name", F.lit(False).alias("accepted")))


LINKS = (
    ("lineitem", "l_orderkey", "orders", "o_orderkey"),
    ("orders", "o_custkey", "customer", "c_custkey"),
    ("orders", "o_orderkey", "lineitem", "l_orderkey"),
    ("labels", "doc_id", "documents", "doc_id"),
    ("nation", "n_regionkey", "region", "r_regionkey"),
)


def _link_sql(child, fk, parent, key):
    return f"""
SELECT '{child}.{fk}' AS link, sum(coalesce(a, 0))::BIGINT AS child_rows,
  coalesce(sum(a) FILTER (b IS NULL), 0)::BIGINT AS orphan_rows, count(*) FILTER (a IS NULL)::BIGINT AS parents_without_child,
  max(a)::BIGINT AS max_children, CASE WHEN max(a) > 1 AND max(b) > 1 THEN 'many-to-many' WHEN max(a) > 1 THEN 'many-to-one'
    WHEN max(b) > 1 THEN 'one-to-many' ELSE 'one-to-one' END AS cardinality
FROM (SELECT {fk} AS k, count(*) AS a FROM {child} GROUP BY 1) x
FULL JOIN (SELECT {key} AS k, count(*) AS b FROM {parent} GROUP BY 1) y ON x.k = y.k"""


@query("relationship_check", " UNION ALL ".join(_link_sql(*link) for link in LINKS))
def relationship_check(spark, d):
    parts = [
        sc.relationship_check(load(spark, d, child), fk, load(spark, d, parent), key)
        .withColumn("link", F.lit(f"{child}.{fk}"))
        for child, fk, parent, key in LINKS
    ]
    return reduce(DataFrame.unionByName, parts)


def registry(spark, d):
    """Schema versions: one per event, named by event type and user in mixed case."""
    name = F.concat_ws("_", "event_type", F.col("user_id").cast("string"))
    mixed = F.when(F.col("event_id") % 2 == 0, F.upper(name)).otherwise(name)
    return load(spark, d, "events").select(
        mixed.alias("table_name"), F.initcap("event_type").alias("entity_type"),
        F.col("props").alias("schema_json"), F.col("ts").alias("created_at"), "event_id",
    )


@query("registry_upsert", """
SELECT table_name, schema_json, strftime(ts, '%Y-%m-%d %H:%M:%S') AS created_at FROM (
  SELECT lower(event_type || '_' || user_id) AS table_name, props AS schema_json, ts,
    row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1
""")
def registry_upsert(spark, d):
    """The first half of the month is stored, the second half is the update."""
    rows = registry(spark, d)
    early = F.col("created_at") < F.lit("2024-01-16").cast("timestamp_ntz")
    made = sc.registry_upsert(rows.filter(early), rows.filter(~early), order=["created_at", "event_id"])
    return made.select("table_name", "schema_json", stamp("created_at").alias("created_at"))


@query("latest_schema", """
SELECT entity_type, arg_max(props, (ts, event_id)) AS schema_json FROM (
  SELECT event_type AS entity_type, * FROM events) GROUP BY 1
""")
def latest_schema(spark, d):
    made = sc.latest_schema(registry(spark, d), order=["created_at", "event_id"])
    return made.select("entity_type", "schema_json")


def rounds(spark, d):
    """Four induction rounds per user and event type; a click count divisible by three fails."""
    k = F.regexp_extract("props", r"(\d+)", 1).cast("bigint")
    return load(spark, d, "events").select(
        F.col("user_id").alias("corpus"), F.col("event_type").alias("entity"),
        (F.col("event_id") % 4 + 1).cast("int").alias("round"),
        F.when(k % 3 != 0, F.col("props")).alias("schema"), F.struct("ts", "event_id").alias("created_at"),
    )


@query("refine_schema_runs", r"""
WITH t AS (SELECT user_id AS corpus, event_type AS entity, (event_id % 4 + 1)::INTEGER AS round,
    CASE WHEN regexp_extract(props, '(\d+)', 1)::BIGINT % 3 <> 0 THEN props END AS schema,
    row_number() OVER (PARTITION BY user_id, event_type, event_id % 4 ORDER BY ts DESC, event_id DESC) AS r FROM events),
g AS (SELECT DISTINCT corpus, entity, x.round FROM t, (VALUES (1), (2), (3), (4)) x(round)),
j AS (SELECT g.corpus, g.entity, g.round, schema, r IS NULL AS absent FROM g LEFT JOIN (SELECT * FROM t WHERE r = 1) u
      ON g.corpus = u.corpus AND g.entity = u.entity AND g.round = u.round),
w AS (SELECT *, last_value(schema IGNORE NULLS) OVER (PARTITION BY corpus, entity ORDER BY round) AS in_force,
        first_value(schema) OVER (PARTITION BY corpus, entity ORDER BY round) AS first_schema FROM j)
SELECT corpus, entity, round, CASE WHEN first_schema IS NOT NULL THEN in_force END AS schema,
  CASE WHEN first_schema IS NULL THEN 'fatal' WHEN absent THEN 'missing' WHEN schema IS NULL THEN 'kept' ELSE 'refined' END AS status
FROM w
""")
def refine_schema_runs(spark, d):
    return sc.refine_schema_runs(rounds(spark, d), ["corpus", "entity"])


SHOWN = ("customer", "orders", "lineitem", "events", "labels")


@query("explain_schema", " UNION ALL ".join(
    f"""SELECT table_name, ordinal_position::INTEGER AS position, column_name,
  CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double'
    WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE 'string' END AS column_type,
  true AS is_nullable, (SELECT count(*) FROM {t})::BIGINT AS row_count, '' AS note
FROM information_schema.columns WHERE table_name = '{t}'""" for t in SHOWN))
def explain_schema(spark, d):
    return sc.explain_schema({t: load(spark, d, t) for t in SHOWN})


@query("schema_samples", """
SELECT c_custkey, '{"c_custkey":' || c_custkey || ',"c_name":"' || c_name || '"}' AS row_json FROM customer
ORDER BY c_custkey LIMIT 5
""")
def schema_samples(spark, d):
    return sc.schema_samples(load(spark, d, "customer").select("c_custkey", "c_name"), ["c_custkey"])


@query("completeness", """
SELECT 'orders' AS table_name, 'o_orderkey' AS column_name, 1.0::DOUBLE AS completeness
UNION ALL SELECT 'orders', 'status', round(count(*) FILTER (o_orderkey % 7 <> 0) / count(*)::DOUBLE + 1e-9, 6) FROM orders
""")
def completeness(spark, d):
    rows = orders(spark, d).select(
        "o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status")
    )
    made = sc.completeness(rows, "orders")
    return made.withColumn("completeness", six("completeness"))
