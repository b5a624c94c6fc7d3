"""N-gram Jaccard join by chosen paths: sets are split on sampled shared tokens until buckets are small."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusql.llm.common import components, map_texts, runs_of
from corpusql.session import materialize

WORDS = 5
MIN_SIMILARITY = 0.8
TOKENS = 64
BUCKET = 512
DEPTH = 4
TARGET_RECALL = 0.999
SLACK = 3.5

_WORD_HASHES: dict[str, int] = {}


def _word_hashes(words: list[str]) -> np.ndarray:
    known = _WORD_HASHES
    if len(known) > 1_000_000:
        known.clear()
    for word in set(words).difference(known):
        known[word] = xxhash.xxh64_intdigest(word)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``n`` lower-cased words; a shorter text is one run, no word is none."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    hashed = _word_hashes(words)
    size = max(1, len(words) - n + 1)
    state = np.full(size, np.uint64(len(words) if len(words) < n else n))
    for k in range(min(n, len(words))):
        state = (state ^ hashed[k : k + size]) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(32)
    return np.unique(state)


def _factors(count: int) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(20)
    return rng.integers(0, 2**63, count, np.uint64) * np.uint64(2) + np.uint64(1), rng.integers(0, 2**63, count, np.uint64)


def sampled_tokens(hashes: np.ndarray, count: int = TOKENS) -> np.ndarray:
    """One token per random order of all tokens: the least. Two sets share one with the chance of their similarity."""
    a, b = _factors(count)
    out = np.full(count, np.iinfo(np.uint64).max, np.uint64)
    for start in range(0, len(hashes), 4096):
        part = hashes[start : start + 4096, None] * a + b
        part ^= part >> np.uint64(31)
        out = np.minimum(out, (part * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0))
    return (out >> np.uint64(32)).astype("<u4")


def runs_for(recall: float, similarity: float, depth: int) -> int:
    """Runs until a pair at the threshold is found with the target chance.

    A node follows one token, and a second one in a share 1/similarity - 1 of nodes, so a pair at the
    threshold keeps one shared path per level on average; the chance that one is left after ``depth``
    levels follows from the chances of one level.
    """
    extra, lost = 1 / similarity - 1, 0.0
    for _ in range(depth):
        miss = 1 - similarity * (1 - lost)
        lost = (1 - extra) * miss + extra * miss * miss
    return max(1, math.ceil(math.log(1 - recall) / math.log(lost)))


def _mixed(*parts: np.ndarray | int) -> np.ndarray:
    state = np.uint64(0x243F6A8885A308D3)
    for part in parts:
        state = (state ^ np.asarray(part).astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
    return state


def children(node: np.ndarray, tokens: np.ndarray, similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """(row, child node): which tokens a node follows depends on the node alone, so its members agree."""
    count = tokens.shape[1]
    rows = np.arange(len(node))
    first = (_mixed(node, 1) % np.uint64(count)).astype(np.int64)
    second = ((first + 1 + (_mixed(node, 2) % np.uint64(count - 1)).astype(np.int64))) % count
    more = (_mixed(node, 3) >> np.uint64(11)).astype(np.float64) / 2**53 < 1 / similarity - 1
    row = np.concatenate([rows, rows[more]])
    at = np.concatenate([first, second[more]])
    return row, _mixed(node[row], at, tokens[row, at]).view(np.int64)


def _tokens_of(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<u4").reshape(len(column), -1)


def forest(near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(member, root) edges that connect what a symmetric matrix of links connects."""
    count = len(near)
    left = np.ones(count, bool)
    members, roots = [], []
    for seed in range(count):
        if not left[seed]:
            continue
        left[seed] = False
        frontier = np.array([seed])
        while len(frontier):
            reached = near[frontier].any(axis=0) & left
            left &= ~reached
            frontier = np.flatnonzero(reached)
            members.append(frontier)
            roots.append(np.full(len(frontier), seed))
    none = np.zeros(0, np.int64)
    return np.concatenate(members or [none]), np.concatenate(roots or [none])


def cells_of(members: DataFrame, key: str, size: str, block: int) -> DataFrame:
    """Members of a group dealt over pairs of blocks, so that each pair of members meets in just one cell.

    A group of at most ``block`` members is one cell. In a larger one each member is in one block and goes to
    the cells of that block with every other and with itself. ``side`` says which block of the cell a row is from.
    """
    blocks = F.ceil(F.col(size) / F.lit(block)).cast("int")
    own = F.pmod(F.xxhash64("c", F.lit(5)), F.col("_blocks")).cast("int")
    dealt = members.withColumn("_blocks", blocks).withColumn("_own", own)
    dealt = dealt.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    low, high = F.least("_own", "_other"), F.greatest("_own", "_other")
    return dealt.withColumn("cell", F.xxhash64(key, low, high)).withColumn(
        "side", F.when(F.col("_own") == F.col("_other"), 2).when(F.col("_own") == low, 0).otherwise(1)
    ).drop("_blocks", "_own", "_other")


def allowed_pairs(side: np.ndarray) -> np.ndarray:
    """Which members of a cell may meet: all in a block's own cell, else those of different blocks."""
    return (side[:, None] == 2) | (side[:, None] != side[None])


def _groups(table: pa.Table) -> Iterator[np.ndarray]:
    cells = table.column("cell").to_numpy()
    borders = np.flatnonzero(np.diff(cells)) + 1
    for a, b in zip([0, *borders.tolist()], [*borders.tolist(), len(cells)]):
        if b - a > 1:
            yield np.arange(a, b)


def _by_cell(rows: DataFrame) -> DataFrame:
    count = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(count, "cell").sortWithinPartitions("cell")


def similar(sets: list[np.ndarray], minimum: float, columns: int = 2048) -> np.ndarray:
    """Which pairs of sets have a Jaccard similarity of at least ``minimum``: exact, from counts of shared elements."""
    count = len(sets)
    sizes = np.array([len(s) for s in sets])
    _, where, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(count), sizes)
    used = np.flatnonzero(seen > 1)
    place = np.full(len(seen), -1)
    place[used] = np.arange(len(used))
    column = place[where]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    shared = np.zeros((count, count))
    for start in range(0, len(used), columns):
        a, b = np.searchsorted(column, [start, start + columns])
        dense = np.zeros((count, min(columns, len(used) - start)), np.float32)
        dense[owner[a:b], column[a:b] - start] = 1
        shared += dense @ dense.T
    union = sizes[:, None] + sizes - shared
    return shared >= minimum * union - 1e-9


def join(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_similarity: float = MIN_SIMILARITY,
    words: int = WORDS,
    target_recall: float = TARGET_RECALL,
    bucket: int = BUCKET,
    depth: int = DEPTH,
) -> DataFrame:
    """(id, class_id, n_links, group_id, kept): one row per document id.

    Documents are sets of ``words``-word runs of lower-cased words. Equal sets form a class named by its
    smallest id; classes, not copies, are joined. In each of several runs every class follows a path:
    at each node one or two of its sampled tokens, the same for all members of the node, name the child nodes. Nodes
    with one class end, nodes with at most ``bucket`` classes are compared by their tokens, larger ones are split again; what
    is still large after ``depth`` splits is compared in blocks. Classes that look similar enough are tied
    into candidate groups, by spanning edges rather than pairs. Inside a candidate group every pair of
    sets is compared exactly, in blocks, and counted where it meets. No step emits pairs.

    n_links counts the other documents with a similarity of at least ``min_similarity``, copies included;
    group_id is the smallest id reachable over links; kept marks that document. Null and empty texts and texts
    without words have no links and are kept. A repeated id is one document with the text whose set
    hashes least; rows without an id are left out.
    """

    def sets():
        def apply(texts: list[str]) -> list:
            found = [shingles(text, words) for text in texts]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            return [
                [len(s) for s in found],
                [int.from_bytes(d[:8], "little", signed=True) for d in digest],
                [int.from_bytes(d[8:], "little", signed=True) for d in digest],
                [sampled_tokens(s).tobytes() if len(s) else b"" for s in found],
            ]

        return apply

    fields = [("size", T.LongType()), ("h1", T.LongType()), ("h2", T.LongType()), ("tokens", T.BinaryType())]
    plain = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).filter("id IS NOT NULL")
    one = map_texts(plain, "id", "text", fields, sets).groupBy("id").agg(
        F.min(F.struct("h1", "h2", "size", "tokens")).alias("s")
    )
    rows = materialize(one.select("id", "s.*"), "sets")
    full = rows.filter("size > 0")
    classes = materialize(
        full.groupBy("h1", "h2").agg(F.min("id").alias("c"), F.count("*").alias("n"), F.first("tokens").alias("tokens")), "set-classes"
    )

    runs = runs_for(target_recall, min_similarity, depth)
    roots = _mixed(np.arange(runs), 77)

    def start(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            tokens, c = _tokens_of(batch.column(1)), batch.column(0).to_numpy()
            for root in roots:
                row, child = children(np.full(len(c), root), tokens, min_similarity)
                yield pa.RecordBatch.from_pydict({"node": child, "c": c[row]})

    def deeper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                row, child = children(batch.column(1).to_numpy().view(np.uint64), _tokens_of(batch.column(2)), min_similarity)
                yield pa.RecordBatch.from_pydict({"node": child, "c": batch.column(0).to_numpy()[row]})

    reps = classes.select("c", "tokens")
    level = reps.mapInArrow(start, "node long, c long")
    leaves = None
    for step in range(1, depth + 1):
        level = materialize(level, "paths")
        sizes = level.groupBy("node").agg(F.count("*").alias("m")).filter("m > 1")
        known = materialize(level.join(sizes, "node"), "nodes")
        done = known if step == depth else known.filter(F.col("m") <= bucket)
        leaves = done if leaves is None else leaves.union(done)
        large = known.filter(F.col("m") > bucket)
        if step == depth or large.isEmpty():
            break
        level = large.join(reps, "c").select("c", "node", "tokens").mapInArrow(deeper, "node long, c long")

    few = min_similarity - SLACK * math.sqrt(min_similarity * (1 - min_similarity) / TOKENS)

    def tie(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, "cell", 4096):
            c, side = table.column("c").to_numpy(), table.column("side").to_numpy()
            tokens = _tokens_of(table.column("tokens").combine_chunks())
            a, b = [], []
            for at in _groups(table):
                own = tokens[at]
                same = np.zeros((len(at), len(at)), np.uint8)
                for k in range(own.shape[1]):
                    same += own[:, k, None] == own[None, :, k]
                near = (same >= few * own.shape[1]) & allowed_pairs(side[at])
                member, root = forest(near)
                a.append(c[at[root]])
                b.append(c[at[member]])
            if a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b)})

    met = cells_of(leaves, "node", "m", bucket).select("cell", "side", "c").join(reps, "c")
    candidates = components(_by_cell(met).mapInArrow(tie, "a long, b long"))
    groups = candidates.withColumnRenamed("id", "c")
    grouped = materialize(groups.join(groups.groupBy("component").agg(F.count("*").alias("m")), "component"), "candidates")

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in runs_of(batches, "cell", 256):
            c, side, n = (table.column(x).to_numpy() for x in ("c", "side", "n"))
            found = [np.frombuffer(x, np.uint64) for x in table.column("hashes").to_pylist()]
            a, b, links = [], [], []
            for at in _groups(table):
                near = similar([found[i] for i in at], min_similarity) & allowed_pairs(side[at])
                np.fill_diagonal(near, False)
                member, root = forest(near)
                counts = near @ n[at]
                linked = np.flatnonzero(counts)
                a += [c[at[root]], c[at[linked]]]
                b += [c[at[member]], c[at[linked]]]
                links += [np.zeros(len(root), np.int64), counts[linked]]
            if a:
                yield pa.RecordBatch.from_pydict({"a": np.concatenate(a), "b": np.concatenate(b), "links": np.concatenate(links)})

    wanted = plain.join(grouped.select(F.col("c").alias("id")), "id", "left_semi")
    digests = [("h1", T.LongType()), ("h2", T.LongType()), ("hashes", T.BinaryType())]

    def whole():
        def apply(texts: list[str]) -> list:
            found = [shingles(text, words) for text in texts]
            digest = [xxhash.xxh3_128_digest(s.tobytes()) for s in found]
            return [
                [int.from_bytes(d[:8], "little", signed=True) for d in digest],
                [int.from_bytes(d[8:], "little", signed=True) for d in digest],
                [s.tobytes() for s in found],
            ]

        return apply

    members = cells_of(grouped.join(classes.select("c", "n", "h1", "h2"), "c"), "component", "m", bucket)
    texts = map_texts(wanted, "id", "text", digests, whole).withColumnRenamed("id", "c").dropDuplicates(["c", "h1", "h2"])
    ready = _by_cell(members.join(texts, ["c", "h1", "h2"]).select("cell", "side", "c", "n", "hashes"))
    found = materialize(ready.mapInArrow(exact, "a long, b long, links long"), "links")

    linked = found.filter("links > 0").groupBy(F.col("a").alias("c")).agg(F.sum("links").alias("outside"))
    final = components(found.filter("a <> b").select("a", "b")).select(F.col("id").alias("c"), F.col("component").alias("g"))
    per_class = classes.select("h1", "h2", "c", "n").join(linked, "c", "left").join(final, "c", "left").select(
        "h1", "h2", F.col("c").alias("class_id"),
        (F.col("n") - 1 + F.coalesce("outside", F.lit(0))).alias("n_links"),
        F.coalesce("g", "c").alias("group_id"),
    )
    inside = full.select("id", "h1", "h2").join(per_class, ["h1", "h2"]).select("id", "class_id", "n_links", "group_id")
    zero = F.lit(0).cast("long").alias("n_links")
    alone = rows.filter("size = 0").select("id", F.col("id").alias("class_id"), zero, F.col("id").alias("group_id"))
    every = inside.union(alone)
    return every.select(
        F.col("id").alias(id_col), "class_id", "n_links", "group_id", (F.col("id") == F.col("group_id")).alias("kept")
    )
