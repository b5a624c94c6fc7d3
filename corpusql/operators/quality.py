"""Duplicates, quality flags, validation rules and custom extractors."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SHORT_TEXT, SHORT_CHUNK = 100, 50
REVIEW_CONFIDENCE, REVIEW_SHARE = 0.85, 0.3

Extractor = Callable[[Column], Column]


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def distinct_documents(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", seen: DataFrame | None = None
) -> DataFrame:
    """(content_hash, key, copies): the smallest key of each content, with the number of copies.

    Only the hash and the key are shuffled, and copies are folded inside each
    task first, so a text that fills a third of the corpus is no hot spot. ``seen`` holds hashes of
    earlier runs.
    """
    hashed = docs.select(key, content_hash(F.col(text_col)).alias("content_hash"))
    kept = hashed.groupBy("content_hash").agg(
        F.min(key).alias(key), F.count(F.lit(1)).alias("copies")
    )
    if seen is not None:
        kept = kept.join(seen.select("content_hash"), "content_hash", "left_anti")
    return kept


def dedup_documents(
    docs: DataFrame, key: str = "doc_id", text_col: str = "text", seen: DataFrame | None = None
) -> DataFrame:
    """The documents of ``distinct_documents`` with all their columns.

    The join back shuffles whole rows by key unless one side is small; who needs ids
    only takes ``distinct_documents``.
    """
    return docs.join(distinct_documents(docs, key, text_col, seen), key, "inner")


def text_flags(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """A very short text may be a scan without a text layer."""
    return docs.withColumn("maybe_scanned", F.length(text_col) < SHORT_TEXT)


def chunk_flags(chunks: DataFrame) -> DataFrame:
    return chunks.withColumn("too_short", F.col("token_count") < SHORT_CHUNK)


def extraction_flags(entities: DataFrame, keys: Sequence[str] = ("entity",)) -> DataFrame:
    low = F.coalesce("confidence", F.lit(0.0)) < REVIEW_CONFIDENCE
    return entities.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg(low.cast("double")).alias("low_share"),
    ).withColumn("needs_review", F.col("low_share") > REVIEW_SHARE)


def broken_rules(rules: Mapping[str, Column]) -> Column:
    """Names of the rules a row breaks. A rule that is NULL is not broken."""
    broken = [
        F.when(~F.coalesce(rule, F.lit(True)), F.lit(name)) for name, rule in rules.items()
    ]
    return F.concat_ws(",", *broken)


def validation_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Violations per rule, in one scan for all rules."""
    aggs = [
        F.count_if(~F.coalesce(rule, F.lit(True))).alias(f"r{i}")
        for i, rule in enumerate(rules.values())
    ]
    rows = [
        F.struct(
            F.lit(name).alias("rule"), F.col(f"r{i}").alias("violations"), F.col("n").alias("rows")
        )
        for i, name in enumerate(rules)
    ]
    return df.agg(F.count(F.lit(1)).alias("n"), *aggs).select(F.inline(F.array(*rows)))


def validate(df: DataFrame, rules: Mapping[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and the others with the names of the broken ones."""
    checked = df.withColumn("broken_rules", broken_rules(rules))
    good = checked.filter(F.col("broken_rules") == "").drop("broken_rules")
    return good, checked.filter(F.col("broken_rules") != "")


class Extractors:
    """Named functions from a text column to a value column.

    Built-in expressions keep the work in generated code; a Pandas UDF is a
    valid extractor too.
    """

    def __init__(self) -> None:
        self._by_name: dict[str, Extractor] = {}

    def register(self, name: str) -> Callable[[Extractor], Extractor]:
        def add(extractor: Extractor) -> Extractor:
            self._by_name[name] = extractor
            return extractor

        return add

    def apply(self, docs: DataFrame, text_col: str = "text", names: Sequence[str] | None = None) -> DataFrame:
        chosen = list(self._by_name) if names is None else list(names)
        return docs.withColumns({n: self._by_name[n](F.col(text_col)) for n in chosen})


def keyword_rank(
    docs: DataFrame,
    phrase: str,
    order: Sequence[Column],
    n: int,
    text_col: str = "text",
    where: Column | None = None,
) -> DataFrame:
    """Top ``n`` of the rows whose text mentions the phrase, whatever its case."""
    words = F.lower(F.lit(phrase))
    rows = docs if where is None else docs.filter(where)
    return rows.filter(F.contains(F.lower(text_col), words)).orderBy(*order).limit(n)


