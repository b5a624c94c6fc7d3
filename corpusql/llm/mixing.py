"""Mixing sources to target weights: budgets down a tree of groups, then a token-prefix of seeded epochs per leaf."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.session import materialize

SMALL_TREE = 50_000
WHOLE = "decimal(38,0)"


def token_count(text: str = "text") -> Column:
    """Runs of characters but blanks, tabs and line ends; null texts have none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit("[^ \\t\\n\\r]+")), F.lit(0)).cast("long")


def group(level: Column | str) -> Column:
    return F.expr(level) if isinstance(level, str) else level


def order_key(seed: int, epoch: Column, key: Column) -> Column:
    """Place of a document in an epoch: a hash of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(key.cast("string"), F.lit(""))))


def _weight(levels: Sequence[str], weights: Mapping[tuple[str, ...], int]) -> Column:
    """Weight of the node that the level columns name: that of its path, else of its own name at that level (("*", name)), else 1."""
    out = F.lit(None).cast("long")
    last = F.col(levels[-1])
    for path, weight in weights.items():
        if path[0] == "*" and len(path) == len(levels) + 1:
            out = F.coalesce(out, F.when(last == path[-1], F.lit(weight).cast("long")))
    for path, weight in weights.items():
        if path[0] != "*" and len(path) == len(levels):
            same = F.lit(True)
            for column, name in zip(levels, path):
                same = same & (F.col(column) == name)
            out = F.when(same, F.lit(weight).cast("long")).otherwise(out)
    return F.coalesce(out, F.lit(1).cast("long"))


def share_out(nodes: DataFrame, parents: Sequence[str], name: str) -> DataFrame:
    """Add ``budget``: the parent's budget (column ``above``) over its children by weight, none above its ``capacity``.

    Children that cannot take their share take what they have, and the
    others share the rest by their weights: in order of capacity per weight, a child is full if it is at the share
    that is due once all before it are full. Whole numbers throughout; what division leaves goes one each to the first
    names that have room.
    """
    ratio = F.col("capacity").cast("double") / F.col("weight")
    line = W.partitionBy(*parents).orderBy(ratio, name) if parents else W.orderBy(ratio, name)
    before, after = line.rowsBetween(W.unboundedPreceding, -1), line.rowsBetween(0, W.unboundedFollowing)
    every = W.partitionBy(*parents) if parents else W.partitionBy(F.lit(0))
    whole = {c: F.col(c).cast(WHOLE) for c in ("capacity", "weight", "above")}
    step = nodes.withColumn("taken", F.coalesce(F.sum("capacity").over(before), F.lit(0))).withColumn(
        "rest", F.sum("weight").over(after)
    )
    full = whole["capacity"] * F.col("rest").cast(WHOLE) <= whole["weight"] * (F.col("above") - F.col("taken")).cast(WHOLE)
    step = step.withColumn("full", full)
    step = step.withColumn("open_weight", F.sum(F.when(~F.col("full"), F.col("weight"))).over(every)).withColumn(
        "open_budget", F.col("above") - F.coalesce(F.sum(F.when(F.col("full"), F.col("capacity"))).over(every), F.lit(0))
    )
    part = F.expr(f"cast(weight as {WHOLE}) * cast(open_budget as {WHOLE}) div cast(open_weight as {WHOLE})").cast("long")
    step = step.withColumn("part", F.when(F.col("full"), F.col("capacity")).otherwise(part))
    left = F.col("above") - F.sum("part").over(every)
    turn = F.row_number().over(W.partitionBy(*parents, "full").orderBy(name))
    more = (~F.col("full") & (turn <= left)).cast("long")
    return step.withColumn("budget", F.col("part") + more).drop("taken", "rest", "full", "open_weight", "open_budget", "part")


def plan(
    docs: DataFrame,
    levels: Sequence[str],
    weights: Mapping[tuple[str, ...], int],
    budget_share: tuple[int, int],
    max_epochs: int = 1,
    seed: int = 0,
    key_col: str = "doc_id",
    tokens_col: str = "n_tokens",
    buckets: int = 3,
) -> DataFrame:
    """One row per leaf: its levels, tokens, budget, full epochs, and the last order key of the epoch begun (``last``).

    ``docs`` is a stored table of key, levels (never null) and tokens. The budget of the whole is
    the given fraction of all tokens; it goes down level by level (``share_out``). A node's
    capacity is ``max_epochs`` times the tokens below it, and siblings take over what a node cannot use, so a
    shortage reaches the next level up only if all siblings are full. Nodes of weight zero get nothing.

    The epoch that is not taken whole is ordered by ``order_key`` and its documents are taken while their tokens
    fit; equal keys go together. Sums by the first ``buckets`` hex digits of the key come first, so only the
    documents of one bucket per leaf are sorted.
    """
    tree = docs.groupBy(*levels).agg(F.sum(tokens_col).alias("tokens"))
    for depth in range(1, len(levels) + 1):
        tree = tree.withColumn(f"weight_{depth}", _weight(levels[:depth], weights)).filter(F.col(f"weight_{depth}") > 0)
    tree = materialize(tree, "leaves")
    up, down = budget_share
    total = docs.agg(F.expr(f"coalesce(sum({tokens_col}), 0) * {up} div {down}").cast("long").alias("asked"))
    room = tree.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("room"))
    above = total.crossJoin(room).select(F.least("asked", F.col("room") * max_epochs).alias("above"))  # one row each
    known = None
    for depth in range(1, len(levels) + 1):
        own, parents = list(levels[:depth]), list(levels[: depth - 1])
        nodes = tree.groupBy(*own).agg(
            (F.sum("tokens") * max_epochs).alias("capacity"), F.max(f"weight_{depth}").alias("weight")
        )
        nodes = nodes.crossJoin(above) if known is None else nodes.join(known, parents)
        known = share_out(nodes, parents, own[-1]).select(*own, F.col("budget").alias("above"))
    leaves = tree.select(*levels, "tokens").join(known.withColumnRenamed("above", "budget"), list(levels))
    whole = F.when(F.col("tokens") > 0, F.expr("budget div tokens")).otherwise(F.lit(0)).cast("long")
    leaves = leaves.withColumn("full_epochs", whole).withColumn("rest", F.col("budget") - F.col("full_epochs") * F.col("tokens"))
    leaves = materialize(leaves, "budgets")

    small = leaves.count() <= SMALL_TREE  # checked size: one row per leaf
    rows = docs.join(F.broadcast(leaves) if small else leaves, list(levels)).filter(F.col("full_epochs") < max_epochs)
    rows = rows.withColumn("place", order_key(seed, F.col("full_epochs") + 1, F.col(key_col)))
    rows = rows.withColumn("bucket", F.substring("place", 1, buckets))
    sums = rows.groupBy(*levels, "bucket").agg(F.sum(tokens_col).alias("s"), F.max("rest").alias("rest"), F.max("place").alias("high"))
    line = W.partitionBy(*levels).orderBy("bucket")
    sums = materialize(sums.withColumn("upto", F.sum("s").over(line)), "bucket-sums")
    inside = sums.filter(F.col("upto") <= F.col("rest")).groupBy(*levels).agg(F.max("high").alias("low_last"))
    edge = sums.filter((F.col("upto") > F.col("rest")) & (F.col("upto") - F.col("s") <= F.col("rest"))).select(
        *levels, "bucket", (F.col("upto") - F.col("s")).alias("base")
    )
    fine = rows.join(edge, [*levels, "bucket"]).withColumn(
        "sum", F.col("base") + F.sum(tokens_col).over(W.partitionBy(*levels, "bucket").orderBy("place"))
    )
    border = fine.filter(F.col("sum") <= F.col("rest")).groupBy(*levels).agg(F.max("place").alias("high_last"))
    found = leaves.join(inside, list(levels), "left").join(border, list(levels), "left")
    return found.select(
        *levels, "tokens", "budget", "full_epochs", F.greatest("low_last", "high_last").alias("last")
    )


def take(
    docs: DataFrame, leaves: DataFrame, levels: Sequence[str], seed: int = 0, key_col: str = "doc_id", small: bool | None = None
) -> DataFrame:
    """The rows of ``docs`` that the plan selects, once per epoch (column ``epoch`` from 1). Texts are not shuffled for a small tree."""
    leaves = materialize(leaves.select(*levels, "full_epochs", "last"), "mix")
    small = leaves.count() <= SMALL_TREE if small is None else small
    rows = docs.join(F.broadcast(leaves) if small else leaves, list(levels))
    begun = order_key(seed, F.col("full_epochs") + 1, F.col(key_col)) <= F.col("last")
    epochs = (F.col("full_epochs") + F.coalesce(begun, F.lit(False)).cast("long")).cast("int")
    return rows.withColumn("epoch", F.explode(F.when(epochs > 0, F.sequence(F.lit(1), epochs)))).drop("full_epochs", "last")


def mix(
    docs: DataFrame,
    levels: Mapping[str, Column | str],
    weights: Mapping[tuple[str, ...], int],
    budget_share: tuple[int, int],
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(id, levels, n_tokens, epoch): the mixture, one row per selected document and epoch.

    ``levels`` names the groups from the top down (a column or an SQL expression each); null values form a group named by the empty text. Null and empty
    texts have no tokens: they come along where their place lies before the last token taken. An empty table gives an empty mixture. Repeated rows have one place and
    are taken together. Native: DataFrame operations alone.
    """
    names = list(levels)
    rows = docs.select(
        F.col(id_col), *[F.coalesce(group(c).cast("string"), F.lit("")).alias(n) for n, c in levels.items()],
        token_count(text_col).alias("n_tokens"),
    )
    rows = materialize(rows, "tokens")
    leaves = plan(rows, names, weights, budget_share, max_epochs, seed, id_col)
    return take(rows, leaves, names, seed, id_col)


def select(
    docs: DataFrame,
    levels: Mapping[str, Column | str],
    weights: Mapping[tuple[str, ...], int],
    budget_share: tuple[int, int],
    max_epochs: int = 1,
    seed: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """The rows of the mixture with the columns of ``docs`` alone, a row once per epoch; see ``mix``."""
    prefix = "_level"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix = "_" + prefix
    names = [f"{prefix}_{n}" for n in levels]
    named = docs.select("*", *[F.coalesce(group(c).cast("string"), F.lit("")).alias(n) for n, c in zip(names, levels.values())])
    rows = materialize(named.select(F.col(id_col), *names, token_count(text_col).alias("n_tokens")), "tokens")
    leaves = plan(rows, names, weights, budget_share, max_epochs, seed, id_col)
    return take(named, leaves, names, seed, id_col).select(*docs.columns)
