"""Exact percentiles without gathering or sorting a column."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.session import materialize

# The sketch is off by one rank in ACCURACY at most. The bracket is MARGIN wide on either
# side, which is more than that and, from SMALL values on, than the two ranks next to the wanted one.
ACCURACY = 100_000
MARGIN = 0.001
SMALL = 3000
# So many counted values of one key are walked in one task; more are cut into CELLS first.
WALK_ROWS = 200_000
CELLS = 256


def exact_percentiles(
    df: DataFrame, value_col: str, fraction: float, keys: Sequence[str] = (), walk_rows: int = WALK_ROWS
) -> DataFrame:
    """Interpolated percentile of ``value_col`` per key; NULLs are ignored.

    The built-in exact percentile keeps all distinct values of a group in one
    aggregation buffer. Here a sketch of bounded size gives two values that are sure to have the
    wanted ranks between them; a second scan counts the values below the lower one and keeps,
    counted, those inside, a five-hundredth of the column. Groups of
    fewer than SMALL values are inside as a whole. Both passes aggregate inside each task first.

    Where a key may have more than ``walk_rows`` values inside, the counted values are written, and each round cuts them at CELLS quantiles
    of their own, counts the cells, and keeps those the wanted ranks fall into, until
    no key has more left. So what one task walks does not grow with the column. A rank that no value
    holds, which a broken sketch would cause, is an error.
    """
    keys = list(keys)
    values = df.filter(F.col(value_col).isNotNull()).select(*keys, F.col(value_col).cast("double").alias("value"))
    cuts = [max(0.0, fraction - MARGIN), min(1.0, fraction + MARGIN)]
    sketch = F.percentile_approx("value", F.array(*[F.lit(c) for c in cuts]), F.lit(ACCURACY))
    found = values.groupBy(*keys).agg(
        F.count("*").alias("total"), F.min("value").alias("least"), F.max("value").alias("most"), sketch.alias("s")
    )
    few = F.col("total") < SMALL
    bracket = found.select(
        *keys,
        "total",
        F.when(few | F.lit(cuts[0] == 0.0), F.col("least")).otherwise(F.col("s")[0]).alias("low"),
        F.when(few | F.lit(cuts[1] == 1.0), F.col("most")).otherwise(F.col("s")[1]).alias("high"),
    )
    bracket = materialize(bracket, "brackets")
    largest = bracket.agg(F.max("total")).first()[0] or 0
    if keys:
        marked = _with(values, bracket, keys)
    else:
        one = bracket.select(F.struct("total", "low", "high")).scalar()
        marked = values.withColumn("_b", one).select("value", "_b.*")
    # Everything below the bracket is one row, under NULL.
    inside = F.when(F.col("value") >= F.col("low"), F.col("value"))
    counted = marked.filter(F.col("value") <= F.col("high")).groupBy(*keys, inside.alias("value")).agg(
        F.count("*").alias("n"), F.first("total").alias("total")
    )
    # Ranks inside the bracket and off by the sketch's error; at most SMALL for small groups.
    if max(SMALL, largest * (2 * MARGIN + 2 / ACCURACY)) > walk_rows:
        counted = _narrowed(counted, fraction, keys, walk_rows)
    walk = W.partitionBy(*keys).orderBy(F.col("value").asc_nulls_first())
    rank = (F.col("total") - 1) * F.lit(fraction)
    placed = counted.withColumn("last", F.sum("n").over(walk) - 1).withColumn("first", F.col("last") - F.col("n") + 1)

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("first") <= place) & (F.col("last") >= place), F.col("value")))

    lost = F.raise_error(F.lit("a wanted rank lies outside the bracket of its percentile")).cast("double")
    low, high, share = F.coalesce("low", lost), F.coalesce("high", lost), F.col("share")
    ends = placed.groupBy(*keys).agg(
        F.count("*").alias("rows"), at(F.floor(rank)).alias("low"), at(F.ceil(rank)).alias("high"),
        F.max(rank - F.floor(rank)).alias("share"),
    )
    # Without keys an empty column has one row, and no percentile.
    return ends.select(*keys, F.when(F.col("rows") > 0, low + (high - low) * share).alias("percentile"))


def _with(rows: DataFrame, few: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Inner join by the keys, of which any may be null."""
    other = few.withColumnsRenamed({k: f"_key{i}" for i, k in enumerate(keys)})
    same = F.lit(True)
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_key{i}"))
    return rows.join(other, same).drop(*[f"_key{i}" for i in range(len(keys))])


def _narrowed(counted: DataFrame, fraction: float, keys: list[str], walk_rows: int) -> DataFrame:
    """The counted values with only ``walk_rows`` values of a key left; what goes is added to the row under NULL, or lies above.

    Distinct values are cut at quantiles of themselves, so a cell has about one ``CELLS``-th of them. Counts per cell are at most ``CELLS`` + 1
    rows of a key.
    """
    now = materialize(counted, "counted")
    grid = F.array(*[F.lit(i / CELLS) for i in range(1, CELLS)])
    while (now.groupBy(*keys).agg(F.count("value").alias("rows")).agg(F.max("rows")).first()[0] or 0) > walk_rows:
        borders = now.filter("value IS NOT NULL").groupBy(*keys).agg(F.percentile_approx("value", grid, F.lit(20 * CELLS)).alias("borders"))
        if keys:
            cut = _with(now, borders, keys)
        else:
            cut = now.withColumn("borders", borders.scalar())
        cell = F.when(F.col("value").isNotNull(), F.size(F.filter("borders", lambda b: b < F.col("value"))))
        celled = cut.withColumn("cell", cell).drop("borders")
        sums = celled.groupBy(*keys, "cell").agg(F.sum("n").alias("cell_n"), F.first("total").alias("cell_total"))
        order = W.partitionBy(*keys).orderBy(F.col("cell").asc_nulls_first())
        last = F.sum("cell_n").over(order) - 1
        rank = (F.col("cell_total") - 1) * F.lit(fraction)
        ranked = sums.withColumn("cell_last", last).withColumn("cell_first", F.col("cell_last") - F.col("cell_n") + 1)
        wanted = (F.col("cell_first") <= F.ceil(rank)) & (F.col("cell_last") >= F.floor(rank)) & F.col("cell").isNotNull()
        kept = _with(celled, ranked.filter(wanted).select(*keys, "cell"), [*keys, "cell"])
        below = ranked.filter((F.col("cell_last") < F.floor(rank)) | F.col("cell").isNull()).groupBy(*keys).agg(
            F.lit(None).cast("double").alias("value"), F.sum("cell_n").alias("n"), F.first("cell_total").alias("total")
        )
        now = materialize(kept.select(*keys, "value", "n", "total").unionByName(below), "narrowed")
    return now
