"""Schema discovery, checks and the schema registry, on attribute rows."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.functions import standardize as sd
from corpusql.functions import text as tx
from corpusql.functions.binding import let
from corpusql.session import materialize

MIN_CONFIDENCE = 0.7
ITERATION_CONFIDENCE = 0.9
MAX_EXAMPLES = 5
MASK_BITS = 62
SAMPLE_VALUES = 256
DOUBT = 1e-12


# ---------------------------------------------------------------- discovery


def _observed(names: Column, values: Column) -> Column:
    """Structs (name, value, first): ``first`` marks one use of each name in its document.

    Uses are sorted by name and place, so a use is the first of its name if the one before it
    has another name.
    """
    pairs = F.arrays_zip(F.transform(names, clean_name).alias("n"), values.alias("v"))
    placed = F.transform(pairs, lambda p, i: F.struct(p["n"].alias("n"), i.alias("i"), p["v"].alias("v")))

    def rows(ordered: Column) -> Column:
        return F.transform(
            ordered,
            lambda p, i: F.struct(
                p["n"].alias("name"),
                p["v"].alias("value"),
                ((i == 0) | (F.get(ordered, i - 1)["n"] != p["n"])).alias("first"),
            ),
        )

    return let(F.sort_array(placed), rows)


def labelled_values(
    docs: DataFrame, doc_col: str = "doc_id", text_col: str = "text", keep: Sequence[str] = ()
) -> DataFrame:
    """(doc, name, value, first) from ``Label: value`` lines; one input row per document."""
    lines = F.regexp_extract_all(text_col, F.lit(f"(?Um){tx.LABEL_LINE}"), 0)
    cut = F.transform(lines, lambda line: F.split(line, ":", 2))
    both = docs.withColumn("_cut", cut).select(
        doc_col, *keep,
        F.transform("_cut", lambda p: tx.strip(p[0])).alias("_labels"),
        F.transform("_cut", lambda p: tx.strip(p[1])).alias("_values"),
    )
    return both.select(doc_col, *keep, F.inline(_observed(F.col("_labels"), F.col("_values"))))


def json_values(
    docs: DataFrame, doc_col: str, json_col: str, keep: Sequence[str] = ()
) -> DataFrame:
    """(doc, name, value, first) from the keys of a JSON object per row."""
    entries = F.from_json(json_col, "map<string,string>")
    return docs.select(
        doc_col, *keep, F.inline(_observed(F.map_keys(entries), F.map_values(entries)))
    )


def clean_name(name: Column) -> Column:
    return F.replace(F.lower(name), F.lit(" "), F.lit("_"))


def induce_attributes(
    values: DataFrame,
    documents: DataFrame,
    entity: str | None = None,
    max_examples: int = MAX_EXAMPLES,
) -> DataFrame:
    """Attribute rows for the recurring labels of a corpus.

    Without ``entity`` both frames carry an ``entity`` column, and all entities
    are described by the same plan. Confidence is the share of the entity's
    documents that hold the label. The type is the narrowest one that every
    present value parses to. One shuffle, on (name, value) with counting inside
    each task before it, feeds shares, types and examples: types are tried once
    per distinct value, and a label found in every document does not meet in
    one task as raw rows. The counted values are written to the shared folder, so the texts are read once.
    """
    if entity is not None:
        values = values.withColumn("entity", F.lit(entity))
    keys = ["entity", "name"]
    named = values.filter(F.col("entity").isNotNull() & F.col("name").isNotNull())
    counted = named.groupBy(*keys, "value").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("first").alias("documents")
    )
    distinct = materialize(counted, "label-values")
    value = F.col("value")
    tried = distinct.select(
        *keys,
        "n",
        "documents",
        sd.null_token(value).isNotNull().alias("filled"),
        sd.real(value).alias("real"),
        sd.boolean(value).isNotNull().alias("boolean"),
        sd.date(value).isNotNull().alias("date"),
    )

    def all_fit(parsed: Column) -> Column:
        return F.every(F.coalesce(parsed, F.lit(False)) | ~F.col("filled"))

    types = tried.groupBy(*keys).agg(
        F.sum("n").alias("uses"),
        F.sum("documents").alias("documents"),
        F.count_if("filled").alias("n_filled"),
        all_fit(F.col("real") == F.floor("real")).alias("is_integer"),
        all_fit(F.col("real").isNotNull()).alias("is_real"),
        all_fit(F.col("date")).alias("is_date"),
        all_fit(F.col("boolean")).alias("is_boolean"),
    )
    described = types.join(top_examples(distinct, max_examples), keys, "left")
    if entity is not None:
        described = described.withColumn("total", documents.select(F.count(F.lit(1))).scalar())
    else:
        totals = documents.groupBy("entity").agg(F.count(F.lit(1)).alias("total"))
        described = described.join(totals, "entity")
    kind = (
        F.when(F.col("n_filled") == 0, "TEXT")
        .when(F.col("is_integer"), "INTEGER")
        .when(F.col("is_real"), "REAL")
        .when(F.col("is_date"), "DATE")
        .when(F.col("is_boolean"), "BOOLEAN")
        .otherwise("TEXT")
    )
    return described.select(
        *keys,
        kind.alias("type"),
        (F.col("documents") / F.col("total")).alias("confidence"),
        F.lit(False).alias("is_primary_key"),
        (F.col("documents") < F.col("total")).alias("is_nullable"),
        F.lit(None).cast("string").alias("description"),
        "examples",
        "documents",
        "uses",
    )


def top_examples(distinct: DataFrame, n: int) -> DataFrame:
    """Most frequent values per attribute (uses, then documents, then text), at most ``n``."""
    order = W.partitionBy("entity", "name").orderBy(F.desc("n"), F.desc("documents"), "value")
    first = distinct.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= n)
    return first.groupBy("entity", "name").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("rank", "value"))), lambda x: x["value"]
        ).alias("examples")
    )


# ------------------------------------------------------------ attribute rules


def confidence_filter(attributes: DataFrame, threshold: float = MIN_CONFIDENCE) -> DataFrame:
    return attributes.filter(F.coalesce("confidence", F.lit(0.0)) >= threshold)


def ensure_primary_key(attributes: DataFrame) -> DataFrame:
    """Adds ``<entity>_id`` for every entity without a primary key.

    One aggregate per entity says whether a key exists; no join is needed to
    add the missing rows.
    """
    keyed = attributes.groupBy("entity").agg(F.bool_or("is_primary_key").alias("has_key"))
    added = keyed.filter(~F.coalesce("has_key", F.lit(False))).select(
        "entity",
        F.concat(F.lower("entity"), F.lit("_id")).alias("name"),
        F.lit("TEXT").alias("type"),
        F.lit(1.0).alias("confidence"),
        F.lit(True).alias("is_primary_key"),
        F.lit(False).alias("is_nullable"),
        F.lit("generated key").alias("description"),
    )
    return attributes.unionByName(added, allowMissingColumns=True)


def json_properties(docs: DataFrame, json_col: str, entity: str) -> DataFrame:
    """Property rows (name, JSON type, required) seen in a column of JSON objects.

    A property with several types becomes a string; integers widen to numbers.
    """
    # As text a quoted "01234" or "[x]" looks like a number or a list; the variant keeps what it is.
    value, made = F.col("value"), F.coalesce(F.schema_of_variant("variant"), F.lit("VOID"))
    kind = (
        F.when(made == "VOID", "null")
        .when(made.startswith("ARRAY"), "array")
        .when(made.startswith("OBJECT"), "object")
        .when(made == "BOOLEAN", "boolean")
        .when(made == "STRING", "string")
        .when(value.rlike(r"\A-?\d+\z"), "integer")
        .otherwise("number")
    )
    both = docs.select(
        F.from_json(json_col, "map<string,string>").alias("_text"), F.from_json(json_col, "map<string,variant>").alias("_kind")
    )
    entries = both.select(F.explode("_text").alias("key", "value"), "_kind").withColumn("variant", F.col("_kind")[F.col("key")])
    total = docs.select(F.count(F.lit(1))).scalar()
    seen = entries.groupBy("key", kind.alias("kind")).agg(
        F.count(F.lit(1)).alias("n")
    )
    typed = F.col("kind") != "null"
    per_key = seen.groupBy("key").agg(
        F.sum("n").alias("n"),
        F.array_sort(F.collect_set(F.when(typed, F.col("kind")))).alias("kinds"),
    )
    json_type = (
        F.when(F.size("kinds") == 1, F.col("kinds")[0])
        .when(F.array_join("kinds", ",") == "integer,number", F.lit("number"))
        .otherwise(F.lit("string"))
    )
    return per_key.select(
        F.lit(entity).alias("entity"),
        F.col("key").alias("property"),
        json_type.alias("json_type"),
        (F.col("n") == total).alias("required"),
    )


def drop_nested(properties: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Properties kept, and the list and object properties that are left out."""
    nested = F.coalesce(F.col("json_type").isin("array", "object"), F.lit(False))
    return properties.filter(~nested), properties.filter(nested)


def map_json_types(properties: DataFrame) -> DataFrame:
    """JSON-Schema properties as attribute rows."""
    kind = (
        F.when(F.col("json_type") == "integer", "INTEGER")
        .when(F.col("json_type") == "number", "REAL")
        .when(F.col("json_type") == "boolean", "BOOLEAN")
        .otherwise("TEXT")
    )
    return properties.select(
        "entity",
        clean_name(F.col("property")).alias("name"),
        kind.alias("type"),
        F.lit(ITERATION_CONFIDENCE).alias("confidence"),
        F.lit(False).alias("is_primary_key"),
        (~F.coalesce("required", F.lit(False))).alias("is_nullable"),
    )


def validate_names(attributes: DataFrame) -> DataFrame:
    """Adds ``clean_name``, ``name_ok`` and ``entity_ok``.

    Field names: letters, digits, underscores, not starting with a digit.
    Entity names: the same without the last rule.
    """
    cleaned = clean_name(F.col("name"))
    letters = r"\A[\p{L}\p{N}_]*[\p{L}\p{N}][\p{L}\p{N}_]*\z"
    return attributes.withColumns(
        {
            "clean_name": cleaned,
            "name_ok": F.coalesce(cleaned.rlike(letters) & ~cleaned.rlike(r"\A\p{Nd}"), F.lit(False)),
            "entity_ok": F.coalesce(F.col("entity").rlike(letters), F.lit(False)),
        }
    )


def validate_primary_key(attributes: DataFrame) -> DataFrame:
    keys = F.count_if(F.coalesce("is_primary_key", F.lit(False)))
    return (
        attributes.groupBy("entity")
        .agg(keys.alias("primary_keys"))
        .withColumn("valid", F.col("primary_keys") == 1)
        .withColumn(
            "message",
            F.when(F.col("primary_keys") == 0, "no primary key").when(
                F.col("primary_keys") > 1, F.format_string("%d primary keys", F.col("primary_keys"))
            ),
        )
    )


def user_schema(attributes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Accepted and rejected rows of a schema given by the caller."""
    checked = validate_names(attributes).withColumn(
        "type_ok", F.coalesce(F.col("type").isin(*sd.FIELD_TYPES), F.lit(False))
    )
    share_ok = F.coalesce(F.col("confidence").between(0.0, 1.0), F.lit(False))
    good = F.col("name_ok") & F.col("entity_ok") & F.col("type_ok") & share_ok
    named = checked.filter(good).withColumn("name", F.col("clean_name"))
    extra = ("clean_name", "name_ok", "entity_ok", "type_ok")
    return named.drop(*extra), checked.filter(~good)


def spark_schema(attributes: Sequence[Mapping[str, object]]) -> T.StructType:
    """Column types of an entity table. Integers and reals are 64 bits wide."""
    types = {
        "TEXT": T.StringType(), "JSON": T.StringType(), "DATE": T.StringType(),
        "INTEGER": T.LongType(), "REAL": T.DoubleType(), "BOOLEAN": T.BooleanType(),
    }
    return T.StructType(
        [
            T.StructField(
                str(a["name"]), types[str(a["type"])], bool(a.get("is_nullable", True)),
                {"confidence": a.get("confidence"), "primary_key": bool(a.get("is_primary_key"))},
            )
            for a in attributes
        ]
    )


# -------------------------------------------------------------- relationships


def relationship_check(
    child: DataFrame, fk: str, parent: DataFrame, key: str
) -> DataFrame:
    """One row: orphan child rows and the cardinality the data shows.

    Both sides are counted per key before they meet, so a key that holds a
    large share of the child rows joins as one row.
    """
    children = (
        child.filter(F.col(fk).isNotNull()).groupBy(F.col(fk).alias("key")).agg(
            F.count(F.lit(1)).alias("children")
        )
    )
    parents = parent.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("parents"))
    both = children.join(parents, "key", "full_outer")
    many_children = F.max("children") > 1
    many_parents = F.max("parents") > 1
    kind = (
        F.when(many_children & many_parents, "many-to-many")
        .when(many_children, "many-to-one")
        .when(many_parents, "one-to-many")
        .otherwise("one-to-one")
    )
    none = F.lit(0).cast("bigint")
    return both.agg(
        F.coalesce(F.sum("children"), none).alias("child_rows"),
        F.coalesce(F.sum(F.when(F.col("parents").isNull(), F.col("children"))), none).alias(
            "orphan_rows"
        ),
        F.count_if(F.col("children").isNull()).alias("parents_without_child"),
        F.coalesce(F.max("children"), none).alias("max_children"),
        kind.alias("cardinality"),
    )


# ------------------------------------------------------------------- registry


def registry_upsert(
    registry: DataFrame, updates: DataFrame, key: str = "table_name", order: Sequence[str] = ("created_at",)
) -> DataFrame:
    """Registry with the newest row per (lower-cased) name.

    ``max_by`` merges candidates inside each task; a name with very many
    versions never becomes one sorted group.
    """
    both = registry.unionByName(updates).withColumn(key, F.lower(key))
    rest = [c for c in both.columns if c != key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return both.groupBy(key).agg(newest).select(key, *[f"r.{c}" for c in rest])


def latest_schema(
    registry: DataFrame,
    entity: str | None = None,
    entity_col: str = "entity_type",
    order: Sequence[str] = ("created_at",),
) -> DataFrame:
    """Newest registry row per entity, or of one entity, whatever the case of its name."""
    if entity is not None:
        registry = registry.filter(F.lower(entity_col) == entity.lower())
    rest = [c for c in registry.columns if c != entity_col]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("r")
    return registry.groupBy(F.lower(entity_col).alias(entity_col)).agg(newest).select(
        entity_col, *[f"r.{c}" for c in rest]
    )


def refine_schema_runs(
    runs: DataFrame,
    keys: Sequence[str],
    round_col: str = "round",
    schema_col: str = "schema",
    order_col: str = "created_at",
) -> DataFrame:
    """Schema in force after each round; a failed round keeps the one before.

    A NULL schema is a failed round. If the first round failed the run is
    fatal and has no schema. The rounds are those of the data: every run has a
    row for each round up to the last that any run made. Of several attempts at a round the
    newest counts, and attempts are merged inside each task, so a key's window holds one row per round.
    """
    number = F.col(round_col).cast("int")
    top = runs.select(F.max(number)).scalar()
    newest = runs.groupBy(*keys, number.alias("round")).agg(
        F.max_by(F.struct(F.col(schema_col).alias("s")), F.col(order_col)).alias("t")
    )
    every = runs.select(*keys).distinct().withColumn("top", top).select(
        *keys, F.explode(F.sequence(F.lit(1), F.greatest("top", F.lit(1)))).alias("round")
    )
    made = every.join(newest, [*keys, "round"], "left")
    line = W.partitionBy(*keys).orderBy("round")
    first = F.first("t.s").over(line.rowsBetween(W.unboundedPreceding, W.unboundedFollowing))
    in_force = F.last("t.s", ignorenulls=True).over(line.rowsBetween(W.unboundedPreceding, 0))
    status = (
        F.when(first.isNull(), "fatal")
        .when(F.col("t").isNull(), "missing")
        .when(F.col("t.s").isNotNull(), "refined")
        .otherwise("kept")
    )
    return made.select(*keys, "round", F.when(first.isNotNull(), in_force).alias("schema"), status.alias("status"))


def explain_schema(tables: Mapping[str, DataFrame], attributes: DataFrame | None = None) -> DataFrame:
    """Per table and column: rows, type, nullable, note. Counts read no column data."""
    parts = []
    for name, df in tables.items():
        columns = [
            F.struct(
                F.lit(name).alias("table_name"),
                F.lit(i + 1).alias("position"),
                F.lit(f.name).alias("column_name"),
                F.lit(f.dataType.simpleString()).alias("column_type"),
                F.lit(f.nullable).alias("is_nullable"),
                F.col("n").alias("row_count"),
            )
            for i, f in enumerate(df.schema.fields)
        ]
        parts.append(
            df.agg(F.count(F.lit(1)).alias("n")).select(F.inline(F.array(*columns)))
        )
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    if attributes is None:
        return out.withColumn("note", F.lit(""))
    notes = attributes.select(
        F.lower("entity").alias("table_name"),
        F.col("name").alias("column_name"),
        F.when(F.col("is_primary_key"), F.lit("PK"))
        .otherwise(F.format_string("%.2f", "confidence"))
        .alias("note"),
    )
    return out.join(notes, ["table_name", "column_name"], "left").withColumn(
        "note", F.coalesce("note", F.lit(""))
    )


def schema_samples(df: DataFrame, order_by: Sequence[str], n: int = 5) -> DataFrame:
    """First rows of a table as JSON."""
    return df.orderBy(*order_by).limit(n).select(
        *order_by, F.to_json(F.struct("*")).alias("row_json")
    )


def completeness(df: DataFrame, table_name: str) -> DataFrame:
    """Share of filled values per column, one scan."""
    aggs = [F.count(f"`{c}`").alias(f"c{i}") for i, c in enumerate(df.columns)]
    rows = [
        F.struct(
            F.lit(table_name).alias("table_name"),
            F.lit(c).alias("column_name"),
            F.try_divide(F.col(f"c{i}"), F.col("n")).alias("completeness"),
        )
        for i, c in enumerate(df.columns)
    ]
    return df.agg(F.count(F.lit(1)).alias("n"), *aggs).select(F.inline(F.array(*rows)))


def schema_evolution(old: DataFrame, new: DataFrame) -> DataFrame:
    """Attribute rows of two schema versions, each marked added, removed, kept or retyped."""
    keys = ["entity", "name"]
    before = old.select(*keys, F.col("type").alias("old_type"))
    after = new.select(*keys, F.col("type").alias("new_type"))
    change = (
        F.when(F.col("old_type").isNull(), "added")
        .when(F.col("new_type").isNull(), "removed")
        .when(F.col("old_type") == F.col("new_type"), "kept")
        .otherwise("retyped")
    )
    return before.join(after, keys, "full_outer").withColumn("change", change)


def backfill(old_rows: DataFrame, new_rows: DataFrame) -> DataFrame:
    """Rows of both versions in one table; columns a version lacks are NULL."""
    return old_rows.unionByName(new_rows, allowMissingColumns=True)


RELATED = (
    "a_table string, a_column string, b_table string, b_column string, `distinct` long, shared long, containment double"
)


def _key_columns(tables: Mapping[str, DataFrame]) -> list[tuple[int, str, str, str]]:
    """(number, table, column, kind) of the integer and string columns."""
    found = []
    for name, df in tables.items():
        for f in df.schema.fields:
            kind = "int" if isinstance(f.dataType, T.IntegralType) else "text" if isinstance(f.dataType, T.StringType) else None
            if kind:
                found.append((len(found), name, f.name, kind))
    return found


def _possible_columns(
    tables: Mapping[str, DataFrame], columns: list[tuple[int, str, str, str]], min_containment: float, min_distinct: int
) -> set[int]:
    """Columns of the pairs that samples do not rule out. The driver holds ``SAMPLE_VALUES`` hashes a column and one number a pair."""
    spark = next(iter(tables.values())).sparkSession

    def hashed(name: str) -> tuple[DataFrame, list[int]]:
        own = [(n, c, k) for n, t, c, k in columns if t == name]
        values = [F.when(F.col(f"`{c}`").isNotNull(), F.xxhash64(F.lit(k), F.col(f"`{c}`").cast("string"))).alias(f"c{n}") for n, c, k in own]
        return tables[name].select(*values), [n for n, _, _ in own]

    def everywhere(per_task: Callable[[list[int]], Callable]) -> DataFrame:
        out = None
        for name in dict.fromkeys(t for _, t, _, _ in columns):
            frame, numbers = hashed(name)
            made = frame.mapInArrow(per_task(numbers), "col int, hash long")
            out = made if out is None else out.union(made)
        return out.distinct()

    def rows_of(numbers: list[int], held: list[np.ndarray]) -> pa.RecordBatch:
        cols = np.repeat(np.array(numbers, np.int32), [len(h) for h in held])
        return pa.RecordBatch.from_pydict({"col": cols, "hash": np.concatenate(held)})

    def least(numbers: list[int]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held = [np.zeros(0, np.int64) for _ in numbers]
            for batch in batches:
                for i in range(len(numbers)):
                    new = batch.column(i).drop_null().to_numpy()
                    if len(held[i]) == SAMPLE_VALUES:
                        new = new[new < held[i][-1]]
                    if len(new):
                        held[i] = np.unique(np.concatenate([held[i], new]))[:SAMPLE_VALUES]
            yield rows_of(numbers, held)

        return run

    order = W.partitionBy("col").orderBy("hash")
    least_of_all = everywhere(least).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= SAMPLE_VALUES)
    samples: dict[int, set[int]] = {n: set() for n, _, _, _ in columns}
    for row in least_of_all.select("col", "hash").collect():
        samples[row["col"]].add(row["hash"])
    wanted = np.array(sorted(set().union(*samples.values())), np.int64)
    if not len(wanted):
        return set()

    def look_up(numbers: list[int]) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen = np.zeros((len(numbers), len(wanted)), bool)
            for batch in batches:
                for i in range(len(numbers)):
                    new = batch.column(i).drop_null().to_numpy()
                    at = np.minimum(np.searchsorted(wanted, new), len(wanted) - 1)
                    seen[i, at[wanted[at] == new]] = True
            yield rows_of(numbers, [wanted[s] for s in seen])

        return run

    sampled = spark.createDataFrame([(n, h) for n, s in samples.items() for h in s], "a int, hash long")
    met = everywhere(look_up).withColumnRenamed("col", "b").join(sampled, "hash").groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    hits = {(r["a"], r["b"]): r["n"] for r in met.collect()}
    table_of = {n: t for n, t, _, _ in columns}
    kept: set[int] = set()
    for (a, b), n in hits.items():
        size = len(samples[a])
        if table_of[a] == table_of[b] or size < min_distinct:
            continue
        short = n < size * min_containment * (1 - 1e-9) if size < SAMPLE_VALUES else _at_most(n, size, min_containment) < DOUBT
        if not short:
            kept |= {a, b}
    return kept


def _at_most(hits: int, draws: int, share: float) -> float:
    """Chance of at most so many hits in draws that each hit with the given share."""
    if share <= 0 or hits >= draws:
        return 1.0
    if share >= 1:
        return 0.0
    return sum(math.comb(draws, i) * share**i * (1 - share) ** (draws - i) for i in range(hits + 1))


def discover_relationships(
    tables: Mapping[str, DataFrame], min_containment: float = 0.9, min_distinct: int = 2
) -> DataFrame:
    """Column pairs of different tables where one column's values lie in the other's.

    Only integer and string columns can be keys. First the ``SAMPLE_VALUES`` distinct values with the least
    hashes of each column, a sample that tasks find without a shuffle, are looked up in all columns: a pair goes if a column of fewer values
    misses the containment, or if a column that reaches it would show so few hits once in 1 / ``DOUBT`` draws.
    Only the columns of pairs that are left take part in the exact comparison, which decides alone.

    There every value is reduced to the
    set of columns that hold it in one shuffle. The set is a bit mask (a few
    longs, folded inside each task first), so neither hot values nor many
    distinct ones need object buffers; pairs are formed from the distinct sets.
    """
    found = _key_columns(tables)
    if not found:
        raise ValueError("no integer or string column")
    kept = _possible_columns(tables, found, min_containment, min_distinct)
    columns: list[tuple[int, str, str]] = []
    stacked = None
    for name, df in tables.items():
        picked = []
        for number, kind, column in ((n, k, c) for n, t, c, k in found if t == name and n in kept):
            place = len(columns)
            columns.append((place, name, column))
            picked.append(
                F.struct(
                    F.lit(kind).alias("kind"),
                    F.col(f"`{column}`").cast("string").alias("value"),
                    F.lit(place // MASK_BITS).alias("word"),
                    F.lit(1 << place % MASK_BITS).cast("bigint").alias("bit"),
                )
            )
        if picked:
            rows = df.select(F.inline(F.array(*picked))).filter(F.col("value").isNotNull())
            stacked = rows if stacked is None else stacked.unionByName(rows)
    spark = next(iter(tables.values())).sparkSession
    if stacked is None:
        return spark.createDataFrame([], RELATED)
    # Texts are compared by digest: long documents must not travel as keys.
    long = F.length("value") > 64
    digest = F.when(long, F.concat(F.lit("#"), F.sha2("value", 256))).otherwise(F.concat(F.lit("="), "value"))
    masks = [f"mask{w}" for w in range(len(columns) // MASK_BITS + 1)]
    holders = stacked.groupBy("kind", digest.alias("value")).agg(
        *[
            F.bit_or(F.when(F.col("word") == w, F.col("bit")).otherwise(F.lit(0).cast("bigint"))).alias(m)
            for w, m in enumerate(masks)
        ]
    )
    held = [
        F.when(F.getbit(masks[number // MASK_BITS], F.lit(number % MASK_BITS)) == 1, F.lit(number))
        for number, _, _ in columns
    ]
    shapes = holders.groupBy(*masks).agg(F.count(F.lit(1)).alias("n")).select(
        "n", F.array_compact(F.array(*held)).alias("cols")
    )
    sizes = shapes.select(F.explode("cols").alias("col"), "n").groupBy("col").agg(
        F.sum("n").alias("distinct")
    )
    pairs = (
        shapes.select("n", "cols", F.explode("cols").alias("a"))
        .select("n", "a", F.explode("cols").alias("b"))
        .filter(F.col("a") != F.col("b"))
        .groupBy("a", "b")
        .agg(F.sum("n").alias("shared"))
    )
    names = spark.createDataFrame(columns, "col int, table_name string, column_name string")

    def named(side: str) -> DataFrame:
        return names.select(
            F.col("col").alias(side),
            F.col("table_name").alias(f"{side}_table"),
            F.col("column_name").alias(f"{side}_column"),
        )

    counted = sizes.select(F.col("col").alias("a"), "distinct")
    return (
        pairs.join(counted, "a").join(named("a"), "a").join(named("b"), "b")
        .withColumn("containment", F.col("shared") / F.col("distinct"))
        .filter(
            (F.col("a_table") != F.col("b_table"))
            & (F.col("containment") >= min_containment)
            & (F.col("distinct") >= min_distinct)
        )
        .select("a_table", "a_column", "b_table", "b_column", "distinct", "shared", "containment")
    )
