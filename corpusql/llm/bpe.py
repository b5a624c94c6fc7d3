"""Byte-level BPE: encoding with a segment tree over byte positions, and decoding."""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterable

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from corpusql.llm.common import map_texts

NONE = np.int64(2**62)
CACHE_ENTRIES = 700_000
BATCH_BYTES = 64

# White space as the split patterns of public tokenizers know it.
SPACE = "\t\n\x0b\x0c\r \x85\xa0  -     　"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank from lines of base64 and a number."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Encoder:
    """Encodes and decodes with one rank file.

    Every single byte must have a rank. Ids are ranks. ``pattern`` cuts a text
    into pieces that are merged separately.

    A piece has a segment tree over its byte positions. A leaf holds the rank of
    the pair that starts there, an inner node the leftmost least of its leaves
    (rank and position are one number), so the root names the next merge. A
    merge changes three leaves: the merged position, its right neighbour, which
    dies, and its live left neighbour; each change climbs the tree once.
    """

    def __init__(self, ranks: dict[bytes, int], pattern: str) -> None:
        self.pieces = regex.compile(pattern)
        self.runs = re.compile(f"[{SPACE}]*[^{SPACE}]+|[{SPACE}]+")
        self.unsafe = re.compile(rf"[{SPACE}] (?:[{SPACE}]|\Z)|^ \Z")
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.base = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int64)
        pairs = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                left, right = ranks.get(token[:cut]), ranks.get(token[cut:])
                if left is not None and right is not None:
                    pairs[left << 32 | right] = rank
        self.pairs = pairs
        self.keys = np.array(sorted(pairs), dtype=np.int64)
        self.values = np.array([pairs[k] for k in self.keys.tolist()], dtype=np.int64)
        self.by_word: dict[str, bytes] = {}
        self.by_run: dict[str, bytes] = {}
        self.by_piece: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1) if len(self.keys) else None
        if at is None:
            return np.full(len(key), NONE)
        return np.where(self.keys[at] == key, self.values[at], NONE)

    def encode_piece(self, piece: bytes) -> list[int]:
        """One piece of any length, one tree."""
        n = len(piece)
        size = 1 << max(1, (n - 1).bit_length())
        none = 1 << 62
        ids = self.base[np.frombuffer(piece, np.uint8)].tolist()
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        get = self.pairs.get
        tree = [none] * (2 * size)
        for i in range(n - 1):
            rank = get(ids[i] << 32 | ids[i + 1])
            if rank is not None:
                tree[size + i] = rank * size + i
        for k in range(size - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])

        def put(i: int, value: int) -> None:
            k = size + i
            tree[k] = value
            while k > 1:
                k >>= 1
                least = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == least:
                    return
                tree[k] = least

        def pair(i: int) -> int:
            rank = get(ids[i] << 32 | ids[after[i]]) if after[i] < n else None
            return none if rank is None else rank * size + i

        while tree[1] < none:
            rank, i = divmod(tree[1], size)
            j = after[i]
            ids[i] = rank
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            put(j, none)
            put(i, pair(i))
            if before[i] >= 0:
                put(before[i], pair(before[i]))
        out, i = [], 0
        while i < n:
            out.append(ids[i])
            i = after[i]
        return out

    def _encode_many(self, pieces: list[bytes], size: int) -> list[bytes]:
        """Pieces of at most ``size`` bytes, one tree each, all trees one array; every pass does one merge in each live tree."""
        count = len(pieces)
        lengths = np.array([len(p) for p in pieces])
        raw = np.zeros((count, size), np.uint8)
        raw[np.arange(size) < lengths[:, None]] = np.frombuffer(b"".join(pieces), np.uint8)
        ids = self.base[raw]
        after = np.tile(np.arange(1, size + 1), (count, 1))
        before = np.tile(np.arange(-1, size - 1), (count, 1))
        tree = np.full((count, 2 * size), NONE)
        ranks = self._rank(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(count, size - 1)
        place = np.arange(size - 1)
        ok = (ranks < NONE) & (place < lengths[:, None] - 1)
        tree[:, size : 2 * size - 1] = np.where(ok, ranks * size + place, NONE)
        for k in range(size - 1, 0, -1):
            np.minimum(tree[:, 2 * k], tree[:, 2 * k + 1], out=tree[:, k])
        alive = np.ones((count, size), bool)
        flat_ids, flat_after, flat_before, flat_tree = ids.ravel(), after.ravel(), before.ravel(), tree.ravel()

        def put(rows: np.ndarray, at: np.ndarray, value: np.ndarray) -> None:
            top = rows * (2 * size)
            k = size + at
            flat_tree[top + k] = value
            for _ in range(size.bit_length() - 1):
                k >>= 1
                low = top + 2 * k
                flat_tree[top + k] = np.minimum(flat_tree[low], flat_tree[low + 1])

        def pair(rows: np.ndarray, at: np.ndarray) -> np.ndarray:
            here = rows * size
            right = flat_after[here + at]
            inside = right < lengths[rows]
            found = self._rank(flat_ids[here + at], flat_ids[here + np.where(inside, right, 0)])
            return np.where(inside & (found < NONE), found * size + at, NONE)

        rows = np.flatnonzero(tree[:, 1] < NONE)
        while len(rows):
            here = rows * size
            best = tree[rows, 1]
            i = best & (size - 1)
            j = flat_after[here + i]
            flat_ids[here + i] = best >> (size.bit_length() - 1)
            alive[rows, j] = False
            then = flat_after[here + j]
            flat_after[here + i] = then
            linked = then < lengths[rows]
            flat_before[(here + then)[linked]] = i[linked]
            put(rows, j, NONE)
            put(rows, i, pair(rows, i))
            left = flat_before[here + i]
            has = left >= 0
            if has.any():
                put(rows[has], left[has], pair(rows[has], left[has]))
            rows = rows[tree[rows, 1] < NONE]
        alive &= np.arange(size) < lengths[:, None]
        flat = ids[alive].astype("<u4").tobytes()
        ends = np.cumsum(alive.sum(axis=1)) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def _learn(self, pieces: set[str]) -> None:
        """Put the ids of pieces into the piece cache."""
        if len(self.by_piece) > CACHE_ENTRIES // 2:
            self.by_piece.clear()
        by_size: dict[int, list[tuple[str, bytes]]] = {}
        for piece in pieces.difference(self.by_piece):
            raw = piece.encode("utf-8")
            if len(raw) > BATCH_BYTES:
                self.by_piece[piece] = np.array(self.encode_piece(raw), "<u4").tobytes()
            else:
                by_size.setdefault(max(1, (len(raw) - 1).bit_length()), []).append((piece, raw))
        for bits, items in by_size.items():
            for start in range(0, len(items), 1 << 15):
                part = items[start : start + (1 << 15)]
                ids = self._encode_many([raw for _, raw in part], 1 << bits)
                self.by_piece.update(zip([piece for piece, _ in part], ids))

    def _chunk_ids(self, chunks: list[str]) -> list[bytes]:
        """Ids of chunks that are cut into pieces on their own."""
        split = [self.pieces.findall(chunk) for chunk in chunks]
        self._learn({piece for pieces in split for piece in pieces})
        get = self.by_piece.__getitem__
        return [get(pieces[0]) if len(pieces) == 1 else b"".join(map(get, pieces)) for pieces in split]

    def _cached(self, cache: dict[str, bytes], cut: list[list[str]], before: str) -> list[bytes]:
        """Ids of chunk lists. ``before`` is what each chunk has in front of it and its key lacks."""
        if len(cache) > CACHE_ENTRIES:
            cache.clear()
        fresh = list(set().union(*cut).difference(cache))
        cache.update(zip(fresh, self._chunk_ids([before + c for c in fresh])))
        get = cache.__getitem__
        return [b"".join(map(get, chunks)) for chunks in cut]

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers.

        No match of the pattern goes on from a visible character into white
        space, so a text can be cut there and equal chunks have equal ids. A cut
        before every space does, unless a space stands between white space or
        ends the text after some; such texts are cut before each run instead.
        """
        out = [b""] * len(texts)
        odd = [i for i, text in enumerate(texts) if self.unsafe.search(text)]
        plain = sorted(set(range(len(texts))).difference(odd))
        for i, ids in zip(odd, self._cached(self.by_run, [self.runs.findall(texts[i]) for i in odd], "")):
            out[i] = ids
        cut = [texts[i].split(" ") for i in plain]
        heads = self._chunk_ids([parts[0] for parts in cut])
        for i, head, ids in zip(plain, heads, self._cached(self.by_word, [parts[1:] for parts in cut], " ")):
            out[i] = head + ids
        return out

    def decode(self, ids: bytes) -> bytes:
        get = self.tokens.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist()))


_ENCODERS: dict[tuple[str, str], Encoder] = {}


def encoder(path: str, pattern: str) -> Encoder:
    """The encoder of a rank file; a worker process builds it once."""
    key = (path, pattern)
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(read_ranks(path), pattern)
    return _ENCODERS[key]


def encode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): token ids of every whole text as an array. Null texts are empty and have no ids."""

    def work():
        own = encoder(path, pattern)
        return lambda texts: [[np.frombuffer(x, "<u4").astype(np.int32) for x in own.encode_batch(texts)]]

    return map_texts(df, id_col, text_col, [("ids", T.ArrayType(T.IntegerType()))], work)


def decode(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, decoded): the bytes behind the ids of each row. A null list is empty; an unknown id is an error."""
    import pyarrow as pa
    from pyspark.sql import functions as F

    from corpusql.llm.common import schema_with_id

    schema = schema_with_id(df, id_col, [("decoded", T.BinaryType())])

    def run(batches):
        own = encoder(path, pattern)
        for batch in batches:
            rows = [own.decode(np.array(x or [], "<u4").tobytes()) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, pa.binary())], names=schema.names)

    return df.select(F.col(id_col), F.col(ids_col)).mapInArrow(run, schema)


def round_trip(df: DataFrame, path: str, pattern: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256): encode every whole text, decode the ids, digest both.

    One pass without a shuffle. A task's memory is one slice of texts, the rank
    table and a cache of at most CACHE_ENTRIES chunks plus those of a slice.
    Null and empty texts have no ids; the digests are then those of nothing.
    Repeated rows give repeated rows; other columns are left behind.
    """

    def work():
        own = encoder(path, pattern)

        def apply(texts: list[str]) -> list:
            ids = own.encode_batch(texts)
            return [
                [len(x) // 4 for x in ids],
                [hashlib.sha256(x).hexdigest() for x in ids],
                [hashlib.sha256(own.decode(x)).hexdigest() for x in ids],
            ]

        return apply

    fields = [("n_tokens", T.LongType()), ("ids_sha256", T.StringType()), ("decoded_sha256", T.StringType())]
    return map_texts(df, id_col, text_col, fields, work)
