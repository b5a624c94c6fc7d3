"""Embedding near-duplicates: random projections decoded to E8 lattice points in several tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import components
from corpusql.session import materialize

TABLES = 16
BLOCKS = 2
SCALE = 4.0
PROBES = 3
MIN_COSINE = 0.93
CELL_ROWS = 128
BLOCK_ROWS = 1024
MARKS = 512


def decode_e8(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nearest, second) points of E8 for rows of 8 numbers, both doubled so that they are whole.

    E8 is the integer points with an even sum together with the same shifted
    by one half. In either part the nearest point comes from rounding; if the sum is odd, the
    coordinate nearest to its rounding border goes the other way. ``second`` is the
    nearest neighbouring cell among the other part and the next cheapest flips of the same part.
    """
    found = []
    for shift in (0.0, 0.5):
        moved = points - shift
        base = np.rint(moved)
        rest = moved - base
        toward = np.where(rest >= 0, 1.0, -1.0)
        cost = 1.0 - 2.0 * np.abs(rest)  # what going the other way adds to the squared distance
        order = np.argsort(cost, axis=1, kind="stable")
        odd = (base.sum(axis=1) % 2) != 0
        rows = np.arange(len(points))
        distance = (rest**2).sum(axis=1)
        first, second = base.copy(), base.copy()
        a, b = order[:, 0], order[:, 1]
        first[rows[odd], a[odd]] += toward[rows[odd], a[odd]]
        d_first = distance + np.where(odd, cost[rows, a], 0.0)
        # Next best of this part: one other flip if the sum was odd, two flips if it was even.
        second[rows[odd], b[odd]] += toward[rows[odd], b[odd]]
        even = ~odd
        for at in (a, b):
            second[rows[even], at[even]] += toward[rows[even], at[even]]
        d_second = distance + np.where(odd, cost[rows, b], cost[rows, a] + cost[rows, b])
        found += [(d_first, first + shift), (d_second, second + shift)]
    distances = np.stack([d for d, _ in found])
    order = np.argsort(distances, axis=0, kind="stable")
    every = np.stack([p for _, p in found])
    rows = np.arange(len(points))
    return tuple((2 * every[order[k], rows]).astype(np.int64) for k in (0, 1))


def _mix(parts: np.ndarray, seed: int) -> np.ndarray:
    """64-bit keys of rows of integers."""
    state = np.full(len(parts), np.uint64((0x9E3779B97F4A7C15 * (seed + 1)) % 2**64))
    for column in parts.T:
        state ^= column.astype(np.int64).view(np.uint64)
        state *= np.uint64(0xBF58476D1CE4E5B9)
        state ^= state >> np.uint64(29)
    return state.view(np.int64)


class Lattice:
    """Keys of unit vectors of one dimension: per table, the own cell and neighbouring cells.

    A table projects to ``blocks`` times 8 random orthonormal directions (plain random ones where the
    dimension is smaller) and joins the lattice points of the blocks to one cell. A probe replaces the
    point of one block by its second nearest.
    """

    def __init__(self, dimension: int, tables: int, blocks: int, scale: float, seed: int = 7) -> None:
        rng = np.random.default_rng([seed, dimension])
        self.blocks, self.maps, self.offsets = blocks, [], []
        for _ in range(tables):
            wide = rng.standard_normal((max(dimension, 8 * blocks), 8 * blocks))
            basis = np.linalg.qr(wide)[0][:dimension] if dimension >= 8 * blocks else wide[:dimension] / np.sqrt(8 * blocks)
            self.maps.append(basis * scale * np.sqrt(dimension / 64))
            self.offsets.append(rng.uniform(0, 2, 8 * blocks))

    def keys(self, unit: np.ndarray, probes: int) -> Iterator[tuple[int, int, np.ndarray]]:
        """(table, probe number, keys); number 0 is the own cell."""
        for table, (basis, offset) in enumerate(zip(self.maps, self.offsets)):
            points = (unit @ basis + offset).reshape(-1, 8)
            near, second = (x.reshape(len(unit), -1) for x in decode_e8(points))
            yield table, 0, _mix(near, table)
            for k in range(1, min(probes, 2**self.blocks - 1) + 1):
                swap = np.repeat([(k >> b) & 1 for b in range(self.blocks)], 8).astype(bool)
                yield table, k, _mix(np.where(swap, second, near), table)


def usable(vector: Column) -> Column:
    """Not null, no null or non-finite component, not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < F.lit(float("inf"))) & ~F.isnan(x))
    return vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0)


def matrix(column: pa.Array, dimension: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dimension)


def unit_rows(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def near_duplicates(
    vectors: DataFrame,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    within: str | None = "label",
    min_cosine: float = MIN_COSINE,
    tables: int = TABLES,
    blocks: int = BLOCKS,
    scale: float = SCALE,
    probes: int = PROBES,
    cell_rows: int = CELL_ROWS,
    block_rows: int = BLOCK_ROWS,
) -> DataFrame:
    """(id, n_links, component_id, kept): one row per row of ``vectors``.

    Vectors are compared if their ``within`` values are equal and not null. Equal
    vectors become one class with a count first, so copies are never expanded. Class
    representatives that meet in a lattice cell of any table, one's own cell against the
    other's own or probed cells, are candidates; their cosine is computed in double
    precision and links are those with at least ``min_cosine``. n_links counts other rows,
    copies included. Vectors of different length never meet.

    Null and zero vectors, those with null or non-finite components and those
    without a ``within`` value have no links and are kept. Rows that repeat an id are
    copies of it: each is returned, and links count rows. Null ids are like any
    other row without links.

    Cells of up to ``cell_rows`` entries become pairs of ids, so a row has a bounded number of them. Larger
    ones never do: their rows are dealt over pairs of blocks of about ``block_rows``, the cosines are one matrix
    product in a task, and only counts per row and a spanning forest leave it. A pair that meets in several
    large cells is counted in the one with the least key, and no longer among the small ones.
    """
    key = F.col(within) if within else F.lit(0)
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), key.cast("string").alias("part"), F.col(vector_col).alias("v"))
    fine = F.col("id").isNotNull() & F.col("part").isNotNull() & usable(F.col("v"))
    good = rows.filter(fine).withColumn("v", F.transform("v", lambda x: x.cast("double") + F.lit(0.0)))
    named = good.select("id", "part", "v", F.xxhash64("part", "v").alias("h1"), F.xxhash64("v", "part", F.lit(1)).alias("h2"))
    classes = named.groupBy("h1", "h2").agg(
        F.min("id").alias("rep"), F.count("*").alias("n"), F.first("part").alias("part"), F.first("v").alias("v")
    )
    classes = materialize(classes, "classes")
    members = named.select("id", "h1", "h2")

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[int, Lattice] = {}
        for batch in batches:
            part = batch.column(1).to_pylist()
            sizes = batch.column(3).to_numpy()
            salt = np.array([hash_text(x) for x in part], np.int64)
            for dimension in np.unique(sizes).tolist():
                at = np.flatnonzero(sizes == dimension)
                if dimension not in made:
                    made[dimension] = Lattice(dimension, tables, blocks, scale)
                unit = unit_rows(matrix(batch.column(2).take(pa.array(at)), dimension))
                ids = batch.column(0).to_numpy()[at]
                for _, probe, keys in made[dimension].keys(unit, probes):
                    both = np.stack([keys, salt[at], np.full(len(at), dimension)], axis=1)
                    yield pa.RecordBatch.from_pydict({"key": _mix(both, 0), "id": ids, "own": np.full(len(at), probe == 0)})

    reps = classes.select("rep", "part", "v", F.size("v").cast("long").alias("d"))
    found = materialize(reps.mapInArrow(cells, "key long, id long, own boolean"), "cells")
    sizes = found.groupBy("key").agg(F.count_if("own").alias("owners"), F.count("*").alias("n")).filter("owners > 0")
    large = materialize(sizes.filter(F.col("n") > cell_rows).select("key", "n"), "large-cells")
    some_large = not large.isEmpty()
    small = found.join(large, "key", "left_anti") if some_large else found
    own = small.filter("own").select("key", F.col("id").alias("x"))
    other = small.select("key", F.col("id").alias("y"))
    met = own.join(other, "key").filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
    pairs = met.distinct()

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, more = batch.column(4).to_numpy(), batch.column(5).to_numpy()
            for dimension in np.unique(sizes[sizes == more]).tolist():
                at = pa.array(np.flatnonzero((sizes == dimension) & (more == dimension)))
                x, y = (unit_rows(matrix(batch.column(k).take(at), dimension)) for k in (2, 3))
                close = pa.array(np.einsum("ij,ij->i", x, y) >= min_cosine)
                picked = batch.take(at).filter(close)
                yield pa.RecordBatch.from_arrays([picked.column(0), picked.column(1)], names=["a", "b"])

    left = classes.select(F.col("rep").alias("a"), F.col("part").alias("pa"), F.col("v").alias("va"))
    right = classes.select(F.col("rep").alias("b"), F.col("part").alias("pb"), F.col("v").alias("vb"))
    sized = [F.size(c).cast("long") for c in ("va", "vb")]
    both = pairs.join(left, "a").join(right, "b").filter("pa = pb").select("a", "b", "va", "vb", *sized)
    links = materialize(both.mapInArrow(verify, "a long, b long"), "links")

    partial, edges = None, links
    if some_large:
        inside = found.join(large, "key")
        named_cells = materialize(
            inside.groupBy("id").agg(F.collect_set(F.when(F.col("own"), F.col("key"))).alias("owns"), F.collect_set("key").alias("cells")),
            "cells-of-rows",
        )
        counted = materialize(_in_blocks(inside, named_cells, classes, min_cosine, block_rows), "block-links")
        partial = counted.filter("count > 0").select(F.col("id").alias("rep"), F.col("count").alias("n"))
        forest = counted.filter("root <> id").select(F.least("id", "root").alias("a"), F.greatest("id", "root").alias("b"))
        edges = links.union(forest)
        links = _met_nowhere_large(links, named_cells)

    count = classes.select(F.col("rep").alias("y"), "n")
    ways = links.select(F.col("a").alias("rep"), F.col("b").alias("y")).union(links.select("b", "a"))
    counts = ways.join(count, "y").select("rep", "n")
    counts = counts if partial is None else counts.union(partial)
    outside = counts.groupBy("rep").agg(F.sum("n").alias("outside"))
    groups = components(edges).select(F.col("id").alias("rep"), "component")
    per_class = (
        classes.select("h1", "h2", "rep", "n").join(outside, "rep", "left").join(groups, "rep", "left")
        .select(
            "h1", "h2",
            (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"),
            F.coalesce("component", "rep").alias("component_id"),
        )
    )
    linked = members.join(per_class, ["h1", "h2"]).select("id", "n_links", "component_id")
    alone = rows.filter(~fine).select("id", F.lit(0).cast("long").alias("n_links"), F.col("id").alias("component_id"))
    every = linked.union(alone)
    return every.select(
        F.col("id").alias(id_col), "n_links", "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _met_nowhere_large(links: DataFrame, cells: DataFrame) -> DataFrame:
    """Links whose two rows share no large cell that one of them owns; the others are counted in blocks."""
    left = cells.select(F.col("id").alias("a"), F.col("owns").alias("owns_a"), F.col("cells").alias("cells_a"))
    right = cells.select(F.col("id").alias("b"), F.col("owns").alias("owns_b"), F.col("cells").alias("cells_b"))
    meets = F.arrays_overlap("owns_a", "cells_b") | F.arrays_overlap("owns_b", "cells_a")
    return links.join(left, "a", "left").join(right, "b", "left").filter(~F.coalesce(meets, F.lit(False))).select("a", "b")


def _in_blocks(inside: DataFrame, cells: DataFrame, classes: DataFrame, min_cosine: float, block_rows: int) -> DataFrame:
    """(id, count, root) of large cells: rows linked to ``id`` counted once over all cells, and a linked row of its block pair.

    ``inside`` has (key, id, own, n). A row goes to every pair of blocks that holds its own block.
    """
    blocks = F.ceil(F.col("n") / block_rows)
    # A row that is in one cell by several probes is one row of it.
    rows = inside.groupBy("key", "id").agg(F.max("own").alias("own"), F.first("n").alias("n"))
    dealt = rows.withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id", "key"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    vectors = classes.select(F.col("rep").alias("id"), "part", "v", F.col("n").alias("weight"))
    placed = dealt.join(vectors, "id").join(cells, "id").select(
        "key", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "part", F.size("v").alias("d"),
        "block", "id", "own", "weight", "v", "owns", "cells",
    )

    def compare(table: pa.Table) -> pa.Table:
        table = table.combine_chunks()
        key, low, high, d = (table.column(c)[0].as_py() for c in ("key", "low", "high", "d"))
        block = table.column("block").to_numpy()
        ids, weight = table.column("id").to_numpy(), table.column("weight").to_numpy()
        first, second = np.flatnonzero(block == low), np.flatnonzero(block == high)
        unit = unit_rows(matrix(table.column("v").combine_chunks(), d))
        linked = unit[first] @ unit[second].T
        edge = np.nonzero(np.abs(linked - min_cosine) < 1e-9)
        exact = np.einsum("ij,ij->i", unit[first[edge[0]]], unit[second[edge[1]]]) >= min_cosine
        linked = linked >= min_cosine
        linked[edge] = exact
        own = table.column("own").to_numpy(zero_copy_only=False).astype(bool)
        linked &= own[first][:, None] | own[second][None]
        if low == high:
            np.fill_diagonal(linked, False)
        roots = _roots(linked, first, second, len(ids))
        counted = linked & ~_met_before(table, key, first, second) if linked.any() else linked
        count = np.zeros(len(ids), np.int64)
        count[first] += counted @ weight[second]
        if low != high:
            count[second] += counted.T @ weight[first]
        kept = (count > 0) | (roots != np.arange(len(ids)))
        return pa.table({"id": ids[kept], "count": count[kept], "root": ids[roots[kept]]})

    return placed.groupBy("key", "low", "high", "part", "d").applyInArrow(compare, "id long, count long, root long")


def _met_before(table: pa.Table, key: int, first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """Which pairs of rows already share a large cell with a smaller key that one of them owns."""
    marks = []
    for name in ("owns", "cells"):
        column = table.column(name).combine_chunks()
        values = column.flatten().to_numpy()
        rows = np.repeat(np.arange(len(column)), pc.list_value_length(column).to_numpy())
        marks.append((rows[values < key], values[values < key]))
    (own_rows, own_keys), (cell_rows, cell_keys) = marks
    keys = np.unique(own_keys)
    met = np.zeros((len(first), len(second)), bool)
    for start in range(0, len(keys), MARKS):
        some = keys[start : start + MARKS]
        held = []
        for rows, values in ((own_rows, own_keys), (cell_rows, cell_keys)):
            at = np.minimum(np.searchsorted(some, values), len(some) - 1)
            fits = some[at] == values
            m = np.zeros((table.num_rows, len(some)), np.float32)
            m[rows[fits], at[fits]] = 1
            held.append(m)
        owns, cells = held
        met |= (owns[first] @ cells[second].T + cells[first] @ owns[second].T) > 0
    return met


def _roots(linked: np.ndarray, first: np.ndarray, second: np.ndarray, rows: int) -> np.ndarray:
    """For every row of a block pair the first row of its connected part; each row is looked at once."""
    root = np.full(rows, -1)
    side = np.full(rows, -1), np.full(rows, -1)
    side[0][first], side[1][second] = np.arange(len(first)), np.arange(len(second))
    for start in range(rows):
        if root[start] >= 0:
            continue
        root[start] = start
        waiting = [start]
        while waiting:
            now = waiting.pop()
            near = [second[linked[side[0][now]]]] if side[0][now] >= 0 else []
            near += [first[linked[:, side[1][now]]]] if side[1][now] >= 0 else []
            for found in near:
                new = found[root[found] < 0]
                root[new] = start
                waiting.extend(new.tolist())
    return root


def hash_text(text: str) -> int:
    import xxhash

    return xxhash.xxh64_intdigest(text) - 2**63
