"""Exact copies: local winners, salted digest groups, one winner of all salts, full texts compared throughout."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.session import materialize

HOT_SHARE = 2000
SALTS = 64
BROADCAST_ROWS = 200_000
RESULT = ("keep_id", "group_size", "kept", "text_sha256")


def copies(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    normalise: Callable[[Column], Column] | None = None,
    keep: Sequence[str] = (),
    hot_share: int = HOT_SHARE,
    salts: int = SALTS,
    broadcast_rows: int = BROADCAST_ROWS,
    digest_bytes: int = 32,
) -> DataFrame:
    """(id, keep_id, group_size, kept, text_sha256, kept columns): one row per row of ``docs``, dropped ones too.

    Texts are equal if they are identical after ``normalise`` (none: as they are). Of equal texts
    the row with the largest id stays. Null texts are empty, and all empty texts are one group. Rows without an
    id rank below all others; a group without any id keeps one of them, with a null ``keep_id``. Of
    rows that repeat the largest id and its text exactly one is ``kept``. ``keep`` names columns to return as well, the
    text included if it is wanted.

    1. One pass writes (id, digest, row number); counts by digest give those that occur again, so a text whose
       digest is its own is never moved.
    2. The texts of the others are grouped by digest, salt and *full text*. Each task first combines its own
       rows (partial aggregation), then only its winners travel. A digest with more than one
       ``hot_share``-th of all rows is hot, of which there are less than ``hot_share``: each task is
       given one of ``salts`` salts there, all other digests have one salt.
    3. The salt winners of hot digests, ``hot_share * salts`` rows at most, are combined by full text.

    Results are joined back by digest, hot ones by broadcast. Should different texts share a digest (counted
    exactly; ``digest_bytes`` shortens digests for tests), their rows are grouped and joined by the texts themselves.
    """
    if clash := set(RESULT).intersection([id_col, *keep]):
        raise ValueError(f"columns with the names of result columns: {sorted(clash)}")
    names = [f"column_{i}" for i in range(len(keep))]
    plain = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(plain) if normalise else plain
    rows = docs.select(
        F.col(id_col).cast("long").alias("id"), text.alias("text"), *[F.col(c).alias(n) for c, n in zip(keep, names)]
    ).withColumn("sha", F.sha2("text", 256))
    rows = rows.withColumn("digest", F.substring(F.unhex("sha"), 1, digest_bytes))
    # (id, row) as one number, so that the row that stays comes from a plain maximum
    least = F.coalesce(F.col("id"), F.lit(-(2**63))).cast("decimal(19,0)")
    place = (least * F.lit(str(2**63)).cast("decimal(19,0)") + F.monotonically_increasing_id().cast("decimal(19,0)")).cast("decimal(38,0)")
    listed = materialize(rows.withColumn("place", place).drop("text"), "rows")

    again = materialize(
        listed.groupBy("digest").agg(F.count("*").alias("n"), F.max("place").alias("top")).filter("n > 1"), "again"
    )
    total, digests = listed.count(), again.count()
    again = again.withColumn("hot", F.col("n") * hot_share > total)
    hot = F.broadcast(again.filter("hot").select("digest", "hot"))

    moved = rows.select("id", "digest", "text")
    if digests <= broadcast_rows:
        moved = moved.join(F.broadcast(again.select("digest")), "digest", "left_semi")
    salt = F.when(F.col("hot"), F.pmod(F.spark_partition_id(), F.lit(salts))).otherwise(0)
    salted = moved.join(hot, "digest", "left").withColumn("salt", salt)
    first = salted.groupBy("digest", "salt", "text", "hot").agg(F.max("id").alias("keep_id"), F.count("*").alias("group_size"))
    merged = materialize(
        first.select("digest", "hot", "keep_id", "group_size", F.when(F.col("hot"), F.col("text")).alias("text")), "merged"
    )
    winners = merged.filter("hot").groupBy("digest", "text").agg(F.max("keep_id").alias("keep_id"), F.sum("group_size").alias("group_size"))
    found = merged.filter("hot IS NULL AND group_size > 1").select("digest", "keep_id", "group_size")
    groups = materialize(found.union(winners.drop("text")).join(again, "digest"), "groups")

    whole = groups.filter("group_size = n")  # one text has all rows of its digest
    result = _back(listed, whole, names)
    if whole.count() < digests:
        mixed = again.join(whole, "digest", "left_anti").select("digest")
        result = _back(listed.join(mixed, "digest", "left_anti"), whole, names)
        result = result.union(_by_text(rows.withColumn("place", place).join(mixed, "digest"), names))
    kind = docs.schema[id_col].dataType
    return result.select(
        F.col("id").cast(kind).alias(id_col), F.col("keep_id").cast(kind).alias("keep_id"), "group_size", "kept",
        F.col("sha").alias("text_sha256"), *[F.col(n).alias(c) for n, c in zip(names, keep)],
    )


def _back(listed: DataFrame, groups: DataFrame, names: list[str]) -> DataFrame:
    """Each row with what is known of its digest's group; rows of hot digests take no part in the shuffle by digest."""
    hot = groups.filter("hot").select(
        "digest", F.col("keep_id").alias("h_keep"), F.col("group_size").alias("h_size"), F.col("top").alias("h_top")
    )
    cold = groups.filter("NOT hot").select(F.col("digest").alias("key"), "keep_id", "group_size", "top")
    key = F.when(F.col("h_size").isNull(), F.col("digest")).otherwise(F.concat("digest", F.col("place").cast("string").cast("binary")))
    both = listed.join(F.broadcast(hot), "digest", "left").withColumn("key", key).join(cold, "key", "left")
    size = F.coalesce("h_size", "group_size", F.lit(1))
    keep_id = F.when(F.col("h_size").isNotNull(), F.col("h_keep")).when(F.col("group_size").isNotNull(), F.col("keep_id")).otherwise(F.col("id"))
    kept = F.coalesce(F.col("place") == F.coalesce("h_top", "top"), F.lit(True))
    return both.select("id", keep_id.alias("keep_id"), size.cast("long").alias("group_size"), kept.alias("kept"), "sha", *names)


def _by_text(rows: DataFrame, names: list[str]) -> DataFrame:
    """The same for rows whose digest stands for several texts: grouped and joined by digest and text."""
    stored = materialize(rows, "mixed")
    groups = stored.groupBy("digest", "text").agg(
        F.max("id").alias("keep_id"), F.count("*").alias("group_size"), F.max("place").alias("top")
    )
    both = stored.join(groups, ["digest", "text"])
    return both.select("id", "keep_id", "group_size", (F.col("place") == F.col("top")).alias("kept"), "sha", *names)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns: one of each group of equal texts."""
    inner = [f"in_{i}" for i in range(len(docs.columns))]
    own = dict(zip(docs.columns, inner))
    marked = copies(docs.toDF(*inner), own[id_col], own[text_col], keep=[c for c in inner if c != own[id_col]], **options)
    stay = marked.filter("kept")
    return stay.select(*[F.col(own[c]).alias(c) for c in docs.columns])
