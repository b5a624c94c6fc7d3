"""Dataset manifest: a hash tree whose parents keep the SHA-256 state before each child."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import cache
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.operators.ranks import numbered
from corpusql.session import materialize

FANOUT = 2
SEGMENT = 4096
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "array<struct<before: binary, left: int, others: binary>>"


# SHA-256 on columns: a state is 8 rows of 32-bit words, one column per hash, so that it can be copied,
# kept and resumed. A child's digest as hex text is one block of 64 bytes.


@cache
def constants() -> tuple[np.ndarray, list[int]]:
    """Start state and round constants: fractions of the square and cube roots of the first primes."""
    primes = [p for p in range(2, 312) if all(p % d for d in range(2, isqrt(p) + 1))]

    def cube_root(n: int) -> int:
        x = 1 << -(-n.bit_length() // 3)
        while (y := (2 * x + n // (x * x)) // 3) < x:
            x = y
        return x

    start = np.array([isqrt(p << 64) & 0xFFFFFFFF for p in primes[:8]], np.uint32)
    return start, [cube_root(p << 96) & 0xFFFFFFFF for p in primes]


def turn(x: np.ndarray, n: int) -> np.ndarray:
    return (x >> np.uint32(n)) | (x << np.uint32(32 - n))


def schedule(block: np.ndarray) -> list[np.ndarray]:
    """The 64 words of a block (16 rows), round constants added."""
    w = list(block)
    for t in range(16, 64):
        a, b = w[t - 15], w[t - 2]
        w.append(w[t - 16] + (turn(a, 7) ^ turn(a, 18) ^ (a >> np.uint32(3))) + w[t - 7] + (turn(b, 17) ^ turn(b, 19) ^ (b >> np.uint32(10))))
    return [x + np.uint32(k) for x, k in zip(w, constants()[1])]


def absorb(state: np.ndarray, words: list[np.ndarray]) -> np.ndarray:
    """The states after one more block; one scheduled block may serve all columns."""
    a, b, c, d, e, f, g, h = state
    for w in words:
        first = h + (turn(e, 6) ^ turn(e, 11) ^ turn(e, 25)) + ((e & f) ^ (~e & g)) + w
        second = (turn(a, 2) ^ turn(a, 13) ^ turn(a, 22)) + ((a & b) ^ (a & c) ^ (b & c))
        h, g, f, e, d, c, b, a = g, f, e, d + first, c, b, a, first + second
    return state + np.stack([a, b, c, d, e, f, g, h])


@cache
def ending(blocks: int) -> list[np.ndarray]:
    """The scheduled last block of a message of so many whole blocks."""
    block = np.zeros((16, 1), np.uint32)
    block[0], block[14], block[15] = 1 << 31, blocks * 512 >> 32, blocks * 512 & 0xFFFFFFFF
    return schedule(block)


@cache
def hex_pairs() -> np.ndarray:
    """16 bits to their four hex characters."""
    return np.array([int.from_bytes(b"%04x" % v) for v in range(1 << 16)], np.uint32)


def as_hex(digest: np.ndarray) -> list[np.ndarray]:
    """Scheduled blocks of digests written as hex text."""
    block = np.empty((16, digest.shape[1]), np.uint32)
    block[::2], block[1::2] = hex_pairs()[digest >> np.uint32(16)], hex_pairs()[digest & np.uint32(0xFFFF)]
    return schedule(block)


def start_states(n: int) -> np.ndarray:
    return np.repeat(constants()[0][:, None], n, axis=1)


def words_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, ">u4").astype(np.uint32).reshape(-1, 8).T


def bytes_of(words: np.ndarray) -> bytes:
    return np.ascontiguousarray(words.T).astype(">u4").tobytes()


def binary_column(words: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(32), words.shape[1], [None, pa.py_buffer(bytes_of(words))]).cast(pa.binary())


def from_column(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return words_of(b"".join(column.to_pylist()))


def heights(n: int, fanout: int) -> int:
    """Levels until one node is left of ``n``."""
    levels = 0
    while n > 1:
        n, levels = -(-n // fanout), levels + 1
    return levels


class Subtree:
    """Up to ``levels`` levels over neighbouring nodes: per level the nodes' digests and, for each, the parent's state before it."""

    def __init__(self, nodes: np.ndarray, fanout: int, levels: int) -> None:
        self.fanout, self.digests, self.before = fanout, [nodes], []
        for _ in range(levels):
            below = self.digests[-1]
            n = below.shape[1]
            state, before = start_states(-(-n // fanout)), np.empty_like(below)
            for slot in range(fanout):
                own = np.arange(slot, n, fanout)
                before[:, own] = state[:, : len(own)]
                if len(own):
                    state[:, : len(own)] = absorb(state[:, : len(own)], as_hex(below[:, own]))
            self.before.append(before)
            self.digests.append(self._finish(state, np.full(state.shape[1], n)))

    def _finish(self, state: np.ndarray, n: np.ndarray, parent: np.ndarray | None = None) -> np.ndarray:
        parent = np.arange(state.shape[1]) if parent is None else parent
        run = np.minimum(self.fanout, n - parent * self.fanout)
        out = np.empty_like(state)
        for size in np.unique(run):
            out[:, run == size] = absorb(state[:, run == size], ending(int(size)))
        return out

    def pack(self) -> tuple[bytes, bytes]:
        return b"".join(map(bytes_of, self.digests)), b"".join(map(bytes_of, self.before))

    @classmethod
    def unpack(cls, digests: bytes, before: bytes, n: int, fanout: int) -> Subtree:
        self = cls.__new__(cls)
        self.fanout, self.digests, self.before = fanout, [], []
        every, states, at = words_of(digests), words_of(before), 0
        while at < every.shape[1]:
            self.digests.append(every[:, at : at + n])
            if at + n < every.shape[1]:
                self.before.append(states[:, at : at + n])
            at, n = at + n, -(-n // fanout)
        return self

    def steps(self, i: int) -> list[dict]:
        """For the ``i``-th node, level by level: the parent's state before it, how many siblings are left of it, and all siblings' digests."""
        out = []
        for digests, before in zip(self.digests, self.before):
            first = i - i % self.fanout
            others = [j for j in range(first, min(first + self.fanout, digests.shape[1])) if j != i]
            out.append({"before": bytes_of(before[:, i : i + 1]), "left": i - first, "others": bytes_of(digests[:, others])})
            i //= self.fanout
        return out

    def fold(self, nodes: np.ndarray, at: np.ndarray, proof: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(digests of the top, proof states, blocks in them) if each of ``nodes`` alone stood at its place ``at``."""
        for digests, before in zip(self.digests, self.before):
            n, parent = digests.shape[1], at // self.fanout
            state = absorb(before[:, at], as_hex(nodes))
            for slot in range(self.fanout):
                sibling = parent * self.fanout + slot
                real = np.flatnonzero((sibling < n) & (sibling != at))
                if len(real):
                    block = as_hex(digests[:, sibling[real]])
                    proof[:, real] = absorb(proof[:, real], block)
                    taken[real] += 1
                    right = sibling[real] > at[real]
                    if right.any():
                        chosen = [w[right] for w in block]
                        state[:, real[right]] = absorb(state[:, real[right]], chosen)
            nodes, at = self._finish(state, np.full(len(at), n), parent), parent
        return nodes, proof, taken


def fold_path(nodes: np.ndarray, path: list[dict], proof: np.ndarray, taken: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same along one path that all nodes share."""
    for step in path:
        state = absorb(np.repeat(words_of(step["before"]), nodes.shape[1], axis=1), as_hex(nodes))
        others = words_of(step["others"])
        for k in range(others.shape[1]):
            block = as_hex(others[:, k : k + 1])
            proof = absorb(proof, block)
            if k >= step["left"]:
                state = absorb(state, block)
        taken = taken + others.shape[1]
        nodes = absorb(state, ending(others.shape[1] + 1))
    return nodes, proof, taken


def finish_proofs(proof: np.ndarray, taken: np.ndarray) -> np.ndarray:
    out = np.empty_like(proof)
    for blocks in np.unique(taken):
        out[:, taken == blocks] = absorb(proof[:, taken == blocks], ending(int(blocks)))
    return out


@dataclass
class Manifest:
    """A stored hash tree. ``leaves``: the rows with ``key`` (null first), ``at`` and ``digest``; ``tops``: key and top digest of each
    key's tree; ``bottom``: the lowest segments with their kept states and the path from their top to the root."""

    leaves: DataFrame
    tops: DataFrame
    bottom: DataFrame
    root: str | None
    width: int
    fanout: int


def text_field(c: str) -> Column:
    """``-`` if null, else bytes in UTF-8, a colon, the value as text."""
    value = F.col(c).cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf(fields: Sequence[str | Column]) -> Column:
    """SHA-256 of the fields after another, as hex."""
    return F.sha2(F.concat(*[text_field(c) if isinstance(c, str) else c for c in fields]), 256)


def _width(fanout: int) -> tuple[int, int]:
    levels = 1
    while fanout ** (levels + 1) <= SEGMENT:
        levels += 1
    return levels, fanout**levels


def _trees(nodes: DataFrame, fanout: int, label: str) -> tuple[list[DataFrame], DataFrame]:
    """Segments of each level band, bottom first, and (key, digest) of the top of each key's nodes (key, at, n, digest).

    A segment has ``width`` neighbouring nodes at most and closes as many levels as fit or are
    left, so a band is ``width`` times smaller than the one below.
    """
    levels, width = _width(fanout)

    def close(table: pa.Table) -> pa.Table:
        order = np.argsort(table.column("at").to_numpy())
        n = table.column("n")[0].as_py()
        tree = Subtree(from_column(table.column("digest"))[:, order], fanout, min(levels, heights(n, fanout)))
        digests, before = tree.pack()
        return pa.table({
            "key": table.column("key").slice(0, 1), "seg": table.column("seg").slice(0, 1), "n": table.column("n").slice(0, 1),
            "size": pa.array([len(order)], pa.int64()), "digests": pa.array([digests], pa.binary()),
            "before": pa.array([before], pa.binary()), "digest": pa.array([bytes_of(tree.digests[-1])], pa.binary()),
        })

    bands, done = [], nodes.filter("n = 1").select("key", "digest")
    most = nodes.agg(F.max("n")).first()[0] or 0
    now = nodes
    while most > 1:
        cut = now.filter("n > 1").withColumn("seg", F.expr(f"at div {width}"))
        band = materialize(
            cut.groupBy("key", "seg").applyInArrow(close, "key string, seg long, n long, size long, digests binary, before binary, digest binary"), label
        )
        bands.append(band)
        now = band.select("key", F.col("seg").alias("at"), F.ceil(F.col("n") / width).alias("n"), "digest")
        done = done.union(now.filter("n = 1").select("key", "digest"))
        most = -(-most // width)
    return bands, done


def _paths(bands: list[DataFrame], tops: DataFrame, fanout: int) -> DataFrame | None:
    """The bottom band's segments with ``path``: all steps from their top to the root. ``tops`` (key, path): those of each key's top."""
    _, width = _width(fanout)
    above = None
    for depth in range(len(bands) - 1, -1, -1):
        band = bands[depth]
        known = band.filter(F.col("n") <= width).join(tops, "key")
        if above is not None:
            known = known.unionByName(band.filter(F.col("n") > width).join(above, ["key", "seg"]))
        if not depth:
            return known
        above = materialize(_spread(known, width, fanout), "paths")
    return None


def _spread(known: DataFrame, width: int, fanout: int) -> DataFrame:
    """(key, seg, path): the path of each node of the segments, which is that of the segment one band below."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                tree = Subtree.unpack(row["digests"], row["before"], row["size"], fanout)
                rows = [{"key": row["key"], "seg": row["seg"] * width + i, "path": tree.steps(i) + row["path"]} for i in range(row["size"])]
                yield pa.RecordBatch.from_pylist(rows, schema=PATHS)

    return known.select("key", "seg", "size", "digests", "before", "path").mapInArrow(each, f"key string, seg long, path {STEP}")


PATHS = pa.schema([
    ("key", pa.string()), ("seg", pa.int64()),
    ("path", pa.list_(pa.struct([("before", pa.binary()), ("left", pa.int32()), ("others", pa.binary())]))),
])


def build(docs: DataFrame, fields: Sequence[str] = FIELDS, key: str = "lang", order: str = "doc_id", fanout: int = FANOUT, **extra: Column) -> Manifest:
    """The hash tree of all rows, stored in the shared folder.

    A row's leaf is the SHA-256 of its fields. Per value of ``key`` (null is one) leaves ascend by ``order``,
    nulls first, rows that tie by leaf; while several nodes remain, every ``fanout`` consecutive
    ones become the hash of their digests, the last run with fewer. The tops of all keys, null first, then by
    bytes, become the root likewise. Empty and very long texts are fields like all others. Without rows
    there is no root. ``extra`` are more columns to compute from each row.

    Rows are numbered by range partitions, so a key with a third of all rows is many
    segments of 4,096 neighbours. Each segment is one small group.
    """
    _, width = _width(fanout)
    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(key).cast("string")), F.lit("")).alias("key"), F.col(order).alias("_order"),
        F.unhex(leaf(fields)).alias("digest"), *[c.alias(n) for n, c in extra.items()],
    )
    leaves = numbered(materialize(rows, "leaves"), "key", [F.col("_order").asc_nulls_first(), F.col("digest")], "at", "n")
    leaves = materialize(leaves.withColumn("seg", F.expr(f"at div {width}")), "numbered")
    bands, tops = _trees(leaves.select("key", "at", "n", "digest"), fanout, "band")
    tops = materialize(tops, "tops")

    ordered = materialize(numbered(tops.withColumn("all", F.lit("")), "all", [F.col("key")], "at", "n"), "ordered")
    crown, root = _trees(ordered.select(F.col("all").alias("key"), "at", "n", "digest"), fanout, "crown")
    found = root.first()
    empty = F.expr(f"CAST(array() AS {STEP})")
    steps = _paths(crown, root.select("key", empty.alias("path")), fanout)
    if steps is None:  # one key: its top is the root
        by_key = ordered.select("key", empty.alias("path"))
    else:
        spread = _spread(steps, width, fanout)
        by_key = ordered.join(spread.select(F.col("seg").alias("at"), "path"), "at").select("key", "path")
    by_key = materialize(by_key, "key-paths")
    single = leaves.filter("n = 1").select(
        "key", F.lit(0).cast("long").alias("seg"), F.lit(1).cast("long").alias("size"), F.col("digest").alias("digests"), F.lit(b"").alias("before")
    ).join(by_key, "key")
    bottom = _paths(bands, by_key, fanout)
    names = ["key", "seg", "size", "digests", "before", "path"]
    bottom = single.select(*names) if bottom is None else bottom.select(*names).union(single.select(*names))
    return Manifest(leaves, tops, materialize(bottom, "bottom"), found["digest"].hex() if found else None, width, fanout)


def fold(manifest: Manifest, nodes: DataFrame) -> DataFrame:
    """``nodes`` (key, seg, at, node and other columns) with ``folded``, the root if this one leaf were ``node``, and ``proof``.

    No other leaf is read again: the parent's state before the leaf's slot is resumed with the
    replacement and the siblings to its right, level by level. ``proof`` is the hash of all siblings'
    digests, from the leaf to the root, left to right.
    """
    fanout, width = manifest.fanout, manifest.width
    schema = nodes.drop("seg").schema.add("folded", "binary").add("proof", "binary")
    names = schema.fieldNames()

    def work(asked: pa.Table, stored: pa.Table) -> pa.Table:
        asked = asked.drop(["seg"])
        if not asked.num_rows:
            return asked.append_column("folded", pa.array([], pa.binary())).append_column("proof", pa.array([], pa.binary()))
        row = stored.to_pylist()[0]
        tree = Subtree.unpack(row["digests"], row["before"], row["size"], fanout)
        count = asked.num_rows
        at = asked.column("at").to_numpy() % width
        top, proof, taken = tree.fold(from_column(asked.column("node")), at, start_states(count), np.zeros(count, np.int64))
        top, proof, taken = fold_path(top, row["path"], proof, taken)
        out = asked.append_column("folded", binary_column(top)).append_column("proof", binary_column(finish_proofs(proof, taken)))
        return out.select(names)

    kind = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema)
    return nodes.groupBy("key", "seg").cogroup(manifest.bottom.groupBy("key", "seg")).applyInArrow(work, kind)


def verify(docs: DataFrame, changed: Sequence[str | Column] | None = None, id_col: str = "doc_id", fields: Sequence[str] = FIELDS, key: str = "lang", fanout: int = FANOUT) -> DataFrame:
    """(id, leaf, subroot, root, proof_sha256, folded_root, verified): every row's place in the tree, and whether its leaf still leads to the root.

    ``changed`` are the fields as they are found later (none: unchanged); ``folded_root`` is the root with
    the leaf of these in place of the stored one, ``verified`` whether it is the stored root.
    Null ids come first in their key. Repeated rows are leaves of their own. An empty table has no rows here.
    """
    node = F.unhex(leaf(changed if changed is not None else fields))
    manifest = build(docs, fields, key, id_col, fanout, node=node)
    subroots = manifest.tops.select("key", F.lower(F.hex("digest")).alias("subroot"))
    asked = manifest.leaves.select("key", "seg", "at", "node", "digest", F.col("_order").alias("id"))
    folded = fold(manifest, asked).join(subroots, "key")
    root = F.lit(manifest.root).cast("string")
    late = F.lower(F.hex("folded"))
    return folded.select(
        F.col("id").alias(id_col), F.lower(F.hex("digest")).alias("leaf"), "subroot", root.alias("root"),
        F.lower(F.hex("proof")).alias("proof_sha256"), late.alias("folded_root"), (late == root).alias("verified"),
    )
