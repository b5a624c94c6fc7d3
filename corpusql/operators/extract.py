"""Model replies to typed entity rows with lineage, and the rejects."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.functions import ids
from corpusql.functions import modeljson as mj
from corpusql.functions import standardize as sd
from corpusql.operators.model import Complete, batch_complete, extraction_prompt
from corpusql.session import materialize
from corpusql.sources.tables import read_if_present

MIN_CONFIDENCE = 0.7
LINEAGE = ("doc_id", "chunk_id", "source_chunk_id", "confidence", "source_text")


def parse_replies(replies: DataFrame, content_col: str = "content") -> DataFrame:
    """Adds ``json`` and ``repair_level``; both are NULL when no JSON can be found."""
    bare = replies.withColumn("_b", mj.strip_fences(F.col(content_col)))
    parsed = bare.withColumn("_p", mj.parse_body(F.col("_b")))
    return parsed.withColumns({"json": F.col("_p.json"), "repair_level": F.col("_p.repair_level")}).drop("_b", "_p")


def explode_entities(
    parsed: DataFrame, keep: Sequence[str] = ("doc_id",), min_confidence: float = MIN_CONFIDENCE
) -> DataFrame:
    """One row per entity of a reply; a missing confidence counts as zero."""
    rows = parsed.select(*keep, F.posexplode(mj.entity_list(F.col("json"))).alias("ordinal", "e"))
    sure = F.coalesce("e.confidence", F.lit(0.0)) >= min_confidence
    return rows.filter(sure).select(
        *keep,
        "ordinal",
        F.col("e.attributes").alias("attributes"),
        F.col("e.confidence").alias("confidence"),
        F.col("e.source_text").alias("source_text"),
    )


def rejected_replies(parsed: DataFrame, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Replies without usable JSON, and calls that failed."""
    error = F.col("error") if "error" in parsed.columns else F.lit(None).cast("string")
    bad = error.isNotNull() | F.col("json").isNull()
    reason = F.coalesce(error, F.lit("not JSON"))
    return parsed.filter(bad).select(*keep, reason.alias("reason"))


def standardize_attributes(
    rows: DataFrame, types: Mapping[str, str], map_col: str = "attributes"
) -> DataFrame:
    """Replaces the attribute map by one typed column per declared attribute.

    Built once from the declaration, so the whole table is standardised by one
    projection. Keys that are not declared stay in ``other_attributes``, as
    standardised text.
    """
    declared = F.array(*[F.lit(name) for name in types])
    typed = [sd.standardize(F.col(map_col)[name], t).alias(name) for name, t in types.items()]
    other = F.transform_values(
        F.map_filter(map_col, lambda k, _: ~F.array_contains(declared, k)),
        lambda _, v: sd.text(v),
    )
    rest = [c for c in rows.columns if c != map_col]
    return rows.select(*rest, *typed, other.alias("other_attributes"))


def check_rows(
    rows: DataFrame,
    entity: str,
    attributes: Sequence[Mapping[str, object]],
    map_col: str = "attributes",
    key_cols: Sequence[str] = ("doc_id", "ordinal"),
) -> DataFrame:
    """Entity rows in the declared shape, with ``reason`` (empty when the row fits).

    A value that is present but does not parse to its type, or a missing value
    in a column that must be filled, is a reason. The key is a digest of the
    source, so running again gives the same keys. Document and chunk ids always
    travel along.
    """
    pk = primary_key(entity, attributes)
    fields = [a for a in attributes if a["name"] != pk]
    own_key = any(a["name"] == pk for a in attributes)
    raw = {str(a["name"]): F.col(map_col)[str(a["name"])] for a in fields}
    typed = {n: sd.standardize(raw[n], str(a["type"])) for n, a in zip(raw, fields)}
    generated = ids.entity_id(F.lit(entity), *[F.col(c) for c in key_cols])
    key = F.coalesce(sd.text(F.col(map_col)[pk]), generated) if own_key else generated

    reasons = []
    for field, name in zip(fields, typed):
        present = sd.null_token(raw[name]).isNotNull()
        if field["type"] not in ("DATE", "TEXT", "JSON"):
            reasons.append(F.when(F.col(name).isNull() & present, F.lit(f"{name}: not {field['type']}")))
        if not field.get("is_nullable", True):
            reasons.append(F.when(F.col(name).isNull() & ~present, F.lit(f"{name}: missing")))
    reason = F.concat_ws("; ", *reasons) if reasons else F.lit("")
    lineage = [c for c in LINEAGE if c in rows.columns]
    kept = list(dict.fromkeys([*lineage, *key_cols, map_col]))
    return rows.withColumns({pk: key, **typed}).select(pk, *typed, *kept, reason.alias("reason"))


def primary_key(entity: str, attributes: Sequence[Mapping[str, object]]) -> str:
    return next((str(a["name"]) for a in attributes if a.get("is_primary_key")), f"{entity.lower()}_id")


def split_rows(
    checked: DataFrame,
    entity: str,
    attributes: Sequence[Mapping[str, object]],
    map_col: str = "attributes",
    key_cols: Sequence[str] = ("doc_id", "ordinal"),
) -> tuple[DataFrame, DataFrame]:
    """Fitting rows, and the others with what was read and why it does not fit."""
    pk = primary_key(entity, attributes)
    names = [str(a["name"]) for a in attributes if a["name"] != pk]
    lineage = [c for c in LINEAGE if c in checked.columns]
    good = checked.filter(F.col("reason") == "").select(pk, *names, *lineage)
    bad = checked.filter(F.col("reason") != "")
    return good, bad.select(*key_cols, F.to_json(map_col).alias("attributes"), "reason")


def conform(
    rows: DataFrame, entity: str, attributes: Sequence[Mapping[str, object]]
) -> tuple[DataFrame, DataFrame]:
    """Rows that fit the declared columns, and the rejects."""
    return split_rows(check_rows(rows, entity, attributes), entity, attributes)


def conform_and_store(
    rows: DataFrame, entity: str, attributes: Sequence[Mapping[str, object]], path: str
) -> None:
    """Append fitting rows to ``<path>/<entity>`` and the others to its rejects.

    Values are standardised once: the checked rows are written to the shared
    folder and both tables are filters on them. Keys come from the source, so rows that are
    stored already are left out, by one join, and a second run adds nothing.
    """
    checked = materialize(check_rows(rows, entity, attributes), "entities")
    good, bad = split_rows(checked, entity, attributes)
    spark, name, key = rows.sparkSession, entity.lower(), primary_key(entity, attributes)
    stored = read_if_present(spark, f"{path}/{name}")
    if stored is not None:
        good = good.join(stored.select(key), key, "left_anti")
    stored = read_if_present(spark, f"{path}/{name}_rejects")
    if stored is not None:
        bad = bad.join(stored.select("doc_id", "ordinal"), ["doc_id", "ordinal"], "left_anti").select(*bad.columns)
    good.withColumn("extracted_at", F.current_timestamp()).write.mode("append").parquet(
        f"{path}/{entity.lower()}"
    )
    bad.write.mode("append").parquet(f"{path}/{entity.lower()}_rejects")


def extract_corpus(
    docs: DataFrame,
    entities: Mapping[str, Mapping[str, str]],
    complete: Complete,
    doc_col: str = "doc_id",
    text_col: str = "text",
    min_confidence: float = MIN_CONFIDENCE,
    keep: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every document times every entity: (entity rows, rejects, usage rows).

    ``docs`` may be chunks; ``keep`` names columns, such as the chunk id, that travel
    with each entity. The whole text of a document goes into its prompt. Replies are written to
    the shared folder before they are parsed: a lost executor must not lead to
    a second round of calls. ``entities`` maps an entity to its attribute types.
    """
    def prompt_row(entity: str, types: Mapping[str, str]) -> Column:
        return F.struct(
            F.md5(F.concat_ws("|", F.lit(entity), *[F.col(c).cast("string") for c in (doc_col, *keep)])).alias("prompt_id"),
            F.lit(entity).alias("entity"),
            extraction_prompt(entity, list(types), F.col(text_col)).alias("prompt"),
        )

    # One pass over the documents, whatever the number of entities.
    rows = F.array(*[prompt_row(e, t) for e, t in entities.items()])
    all_prompts = docs.select(doc_col, *keep, F.inline(rows))
    keep = ["prompt_id", doc_col, *keep, "entity"]
    replies = materialize(batch_complete(all_prompts, complete, keep=keep), "replies")
    parsed = parse_replies(replies)
    found = explode_entities(parsed, keep, min_confidence)
    rejects = rejected_replies(parsed, keep)
    usage = replies.withColumn("stage", F.lit("extraction"))
    return found, rejects, usage


def extraction_summary(entities: DataFrame, keys: Sequence[str] = ("doc_id", "entity")) -> DataFrame:
    return entities.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("entities"), F.avg("confidence").alias("avg_confidence")
    )
