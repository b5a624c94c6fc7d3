"""Suffix-array de-duplication: maximal repeats from the common-prefix interval tree of enhanced suffix arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusql.llm.common import runs_of, slices
from corpusql.session import materialize

MIN_BYTES = 400
GRAM = 64
LONGEST_RUN = 1024
HOT_BYTES = 3 << 20
ARRAY_BYTES = 1 << 20
CUT_BYTES = 1 << 20
FILTER_BITS = 1 << 24
ODD = np.uint64(0x9E3779B97F4A7C15)


def words8(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position as one big-endian number; positions past the end count as zero bytes."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    out = np.empty(len(data), np.uint64)
    for shift in range(8):
        count = len(range(shift, len(data), 8))
        out[shift::8] = np.frombuffer(padded[shift : shift + 8 * count].tobytes(), ">u8")
    return out


def _join(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    state = (a ^ (b >> np.uint64(32)) ^ (b << np.uint64(32))) * ODD
    state ^= state >> np.uint64(29)
    state += b
    state *= np.uint64(0xBF58476D1CE4E5B9)
    state ^= state >> np.uint64(32)
    return state


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (a multiple of 8) from each position that has them."""
    if len(data) < size:
        return np.zeros(0, np.uint64)
    # Hashes of 8, 16, 32, ... bytes; those that add up to the size are joined from left to right.
    level, width, parts, at = words8(data), 8, None, 0
    count = len(data) - size + 1
    while True:
        if size & width:
            piece = level[at : at + count]
            parts = piece if parts is None else _join(parts, piece)
            at += width
        if at == size:
            return parts
        level = _join(level[: len(level) - width], level[width:])
        width *= 2


def window_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of the ``width`` values from each position."""
    done, least = 1, values
    while 2 * done <= width:
        least = np.minimum(least[: len(least) - done], least[done:])
        done *= 2
    if done < width:
        least = np.minimum(least[: len(least) - (width - done)], least[width - done :])
    return least


def segments(data: np.ndarray, ends: np.ndarray, size: int, gram: int) -> tuple[np.ndarray, ...]:
    """(document number, first start, last start, anchor, repeats inside) of the runs of windows with one anchor.

    A window is ``size`` bytes of one document; its anchor is the least hash of
    its ``gram``-byte pieces. Equal windows have equal anchors, wherever they stand.
    ``repeats inside`` says that the anchor occurs in the run more than once, without which no window of the run
    equals another of it.
    """
    none = np.zeros(0, np.int64)
    hashes = gram_hashes(data, gram)
    width = size - gram + 1
    if len(data) < size:
        return none, none, none, none, none.astype(bool)
    least = window_least(hashes, width)
    document = np.searchsorted(ends, np.arange(len(least)), side="right")
    valid = np.arange(len(least)) + size <= ends[document]
    change = np.ones(len(least), bool)
    change[1:] = (least[1:] != least[:-1]) | (document[1:] != document[:-1])
    start = np.flatnonzero(change & valid)
    stop = np.flatnonzero(valid & np.append((change | ~valid)[1:], True))
    length = stop - start + 1
    parts = -(-length // LONGEST_RUN)
    if (parts > 1).any():
        rank = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        start, last = np.repeat(start, parts) + rank * LONGEST_RUN, np.repeat(stop, parts)
        stop = np.minimum(start + LONGEST_RUN - 1, last)
    anchor = least[start]
    repeats = stop - start + 1 > width
    padded = np.concatenate([hashes, np.zeros(2 * width, np.uint64)])
    reach = np.arange(2 * width)
    for a in range(0, len(start), 1024):
        b = slice(a, a + 1024)
        seen = padded[start[b, None] + reach] == anchor[b, None]
        seen &= reach < (stop[b] - start[b] + width)[:, None]
        repeats[b] |= seen.sum(axis=1) > 1
    return document[start], start, stop, anchor.view(np.int64), repeats


def prefix_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """A hash of the ``size`` bytes (8 at least) from each position that has them."""
    whole = gram_hashes(data, size // 8 * 8)[: max(0, len(data) - size + 1)]
    if size % 8 and len(whole):  # the last eight bytes overlap the ones before
        whole = _join(whole, words8(data)[size - 8 : size - 8 + len(whole)])
    return whole


class SuffixArray:
    """Suffixes of several strings whose first ``least`` bytes occur again, in order, with the common prefix of neighbours.

    Only such suffixes can be in an interval of ``least`` bytes or more. They are
    gathered by a hash of these bytes, so one class is one stretch of the suffix array (classes stand in the order of
    their hashes); inside a class suffixes are sorted eight bytes at a time, only where they are
    still equal. Suffixes end with their string. Classes in which ``before`` has one value throughout are
    left out: the repeat is part of one that starts further left.
    """

    def __init__(self, data: np.ndarray, ends: np.ndarray, least: int, before: np.ndarray) -> None:
        left = ends[np.searchsorted(ends, np.arange(len(data)), side="right")] - np.arange(len(data))
        words = words8(data)
        starts = np.flatnonzero(left >= least)
        hashes = prefix_hashes(data, least)[starts] if len(starts) else np.zeros(0, np.uint64)
        sorted_ = np.argsort(hashes, kind="stable")
        first = np.flatnonzero(np.append(True, np.diff(hashes[sorted_]) != 0)) if len(starts) else starts
        sizes = np.diff(np.append(first, len(starts)))
        suffix = starts[sorted_]
        if len(first):
            code = before[suffix]
            several = np.minimum.reduceat(code, first) != np.maximum.reduceat(code, first)
            keep = np.repeat((sizes > 1) & several, sizes)
            group = np.repeat(first, sizes)[keep]
            suffix = suffix[keep]
            group = np.unique(group, return_index=True)[1][np.unique(group, return_inverse=True)[1]] if len(group) else group
        else:
            group = suffix
        classes = group.copy()
        # Equal hashes of different bytes are all but impossible; then the sort starts at the first byte.
        offset = least // 8 * 8
        same = np.flatnonzero(classes[1:] == classes[:-1])
        for at in range(0, offset, 8):
            if (words[suffix[same] + at] != words[suffix[same + 1] + at]).any():
                offset = 0
                break
        alive = np.arange(len(suffix))
        while len(alive):
            room = np.clip(left[suffix[alive]] - offset, 0, 8)
            word = words[np.minimum(suffix[alive] + offset, len(data) - 1)]
            # Bytes past the end of the string count as nothing.
            word = np.where(room > 0, word & (~np.uint64(0) << (np.uint64(8) * (np.uint64(8) - np.maximum(room, 1).astype(np.uint64)))), np.uint64(0))
            order = np.lexsort((room, word, group[alive]))
            suffix[alive] = suffix[alive[order]]
            room, word, old = room[order], word[order], group[alive]
            new = np.append(True, (old[1:] != old[:-1]) | (word[1:] != word[:-1]) | (room[1:] != room[:-1]))
            heads = np.flatnonzero(new)
            group[alive] = alive[heads][np.cumsum(new) - 1]
            count = np.diff(np.append(heads, len(alive)))
            alive = alive[(np.repeat(count, count) > 1) & (room == 8)]
            offset += 8
        self.order = suffix
        a, b = suffix[:-1], suffix[1:]
        self.common = np.zeros(len(a), np.int64)
        limit = np.minimum(left[a], left[b]) if len(a) else self.common
        alive = np.flatnonzero(classes[1:] == classes[:-1])
        while len(alive):
            alive = alive[limit[alive] - self.common[alive] >= 8]
            alive = alive[words[a[alive] + self.common[alive]] == words[b[alive] + self.common[alive]]]
            self.common[alive] += 8
        alive = np.flatnonzero(classes[1:] == classes[:-1])
        for _ in range(7):
            alive = alive[self.common[alive] < limit[alive]]
            alive = alive[data[a[alive] + self.common[alive]] == data[b[alive] + self.common[alive]]]
            self.common[alive] += 1


def repeat_tree(array: SuffixArray, before: np.ndarray, least: int) -> Iterator[tuple[int, int, int, np.ndarray]]:
    """(node, parent, length, suffixes) of the maximal repeats of at least ``least`` bytes.

    A scan with a stack over the common prefixes yields the interval tree. A node is
    maximal to the right by being an interval, and to the left if ``before`` differs
    among its suffixes. Stretches that have one ``before`` throughout are repeats of something longer that
    starts further left, and are left out at once. A node comes with the suffixes that are in
    no maximal node below it; all its occurrences are those and the ones of its descendants (-1: no parent).
    """
    close = array.common >= least
    edge = np.flatnonzero(np.diff(np.concatenate([[False], close, [False]]).astype(np.int8)))
    code = before[array.order]
    number = 0
    if not len(edge):
        return
    low, high = edge[::2], edge[1::2]  # suffixes low..high of the order
    sizes = high - low + 1
    starts = np.cumsum(sizes) - sizes
    every = code[np.arange(sizes.sum()) + np.repeat(low - starts, sizes)]
    same = np.minimum.reduceat(every, starts) == np.maximum.reduceat(every, starts)
    for a, b in zip(low[~same].tolist(), high[~same].tolist()):
        common = array.common[a:b].tolist()
        codes = code[a : b + 1].tolist()
        # Frame: length, code or None if several, own suffixes, children.
        stack = [[common[0], codes[0], [a], []]]
        pending: list[tuple[int, int, list[int], list[int]]] = []

        def close_frame(frame: list) -> tuple:
            """What the frame hands to its parent: suffixes and children not yet under a maximal node."""
            nonlocal number
            length, one, own, below = frame
            if one is None:
                pending.append((number, length, own, below))
                number += 1
                return [], [number - 1]
            return own, below

        for at in range(1, b - a + 1):
            length = common[at] if at < b - a else -1
            top = stack[-1]
            if length > top[0]:
                stack.append([length, codes[at], [a + at], []])
                continue
            if top[1] is not None and top[1] != codes[at]:
                top[1] = None
            top[2].append(a + at)
            while stack and stack[-1][0] > length:
                frame = stack.pop()
                own, below = close_frame(frame)
                if stack and stack[-1][0] >= length:
                    up = stack[-1]
                elif length >= 0:
                    stack.append([length, frame[1], [], []])
                    up = stack[-1]
                else:
                    break
                up[2] += own
                up[3] += below
                if up[1] is not None and up[1] != frame[1]:
                    up[1] = None
        parent = {child: node for node, _, _, below in pending for child in below}
        for node, length, own, _ in pending:
            yield node, parent.get(node, -1), length, array.order[np.array(own, np.int64)]


def _marks(batches: Iterator[pa.RecordBatch], least: int, whole: bool) -> Iterator[pa.RecordBatch]:
    """Maximal repeats among the segments of whole anchor groups, numbered within the array.

    A maximal repeat has one anchor and an anchor is in one array, so anchor and number name it anywhere. With ``whole``, a segment
    that stands for several equal ones is a repeat too: a node below the one that has its start, unless that one is as long.
    """
    for table in runs_of(batches, "f", ARRAY_BYTES, "raw"):
        # A repeated row is fetched as often as it is there; its segments count once.
        keys = list(zip(*(table.column(c).to_pylist() for c in ("f", "d1", "d2"))))
        first = sorted({key: i for i, key in reversed(list(enumerate(keys)))}.values())
        table = table.take(pa.array(first, pa.int64())) if len(first) < len(keys) else table
        raw = table.column("raw").to_pylist()
        data = np.frombuffer(b"".join(raw), np.uint8)
        ends = np.cumsum([len(x) for x in raw])
        begins = ends - [len(x) for x in raw]
        before = np.empty(len(data), np.int64)
        before[1:] = data[:-1]
        before[begins] = 256 + np.arange(len(begins))
        array = SuffixArray(data, ends, least, before)
        n = table.column("n").to_pylist()
        owners: list[int] = []
        rows: dict[str, list] = {"off": [], "length": [], "node": [], "parent": []}

        def add(owner: int, *values: int | None) -> None:
            owners.append(owner)
            for column, value in zip(rows.values(), values):
                column.append(value)

        found = list(repeat_tree(array, before, least))
        above = {i: -1 for i, copies in enumerate(n) if whole and copies > 1}
        some: dict[int, int] = {}  # a segment of each node, from its places or those below it
        for node, parent, length, places in found:
            count = len(owners)
            owner = np.searchsorted(ends, places, side="right")
            for off, o in zip((places - begins[owner]).tolist(), owner.tolist()):
                if off == 0 and o in above:
                    if length < len(raw[o]):
                        above[o] = node
                        continue
                    del above[o]
                add(o, off, length, node, parent)
            if whole:
                o = int(owner[0]) if len(owner) else some[node]
                some.setdefault(parent, o)
                if len(owners) == count:  # no place but those below: a row without place tells length and parent
                    add(o, None, length, node, parent)
        for number, (o, parent) in enumerate(above.items(), len(found)):
            add(o, 0, len(raw[o]), number, parent)
        at = pa.array(owners, pa.int64())
        own = [pa.array(table.column(c).take(at).combine_chunks()) for c in OWN]
        yield pa.RecordBatch.from_arrays([*own, *(pa.array(v, pa.int64()) for v in rows.values())], names=[*OWN, *rows])


# Of a class of equal segments: its key, its number of segments, and where one of them stands.
OWN = ("f", "d1", "d2", "n", "h", "id", "lo")
MARKS = "f long, d1 long, d2 long, n long, h long, id long, lo int, off long, length long, node long, parent long"


def _note(rows: DataFrame, hash_col: str) -> DataFrame:
    """(word, bits): a bit for each hash, by its remainder. The table has FILTER_BITS / 64 rows of 16 bytes at most, so it can be broadcast for any input."""
    place = F.pmod(hash_col, F.lit(FILTER_BITS))
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), (place % 64).cast("int"))
    return materialize(rows.groupBy(F.shiftright(place, 6).alias("word")).agg(F.bit_or(bit).alias("bits")), "hash-bits")


def _noted(docs: DataFrame, hashed: Column, notes: DataFrame) -> DataFrame:
    """Adds ``noted``: false for rows whose hash is none of those noted, true for these and for a few others.

    Texts that a join would find nothing for need not be shuffled for it.
    """
    place = F.pmod(hashed, F.lit(FILTER_BITS))
    both = docs.join(F.broadcast(notes), F.shiftright(place, 6) == F.col("word"), "left")
    return both.select(*docs.columns, F.coalesce(F.getbit("bits", (place % 64).cast("int")) == 1, F.lit(False)).alias("noted"))


def _compare(docs: DataFrame, id_col: str, text_col: str, min_bytes: int, hot_bytes: int, groups: bool) -> tuple[DataFrame, ...]:
    """(segments, classes, marks): all segments; classes of equal ones; repeats that one segment of each class has in others or inside.

    With ``groups``, marks name every group; without, repeats that classes of several segments cover anyway are left out.
    """
    size, gram = min_bytes, min(GRAM, min_bytes // 8 * 8)
    if gram < 8:
        raise ValueError("repeats of fewer than 8 bytes")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    plain = docs.select(F.col(id_col).cast("long").alias("id"), raw.alias("raw")).withColumn("h", F.xxhash64("id", "raw"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 1, CUT_BYTES)):
            texts = batch.column(1).to_pylist()
            buffer = b"".join(texts)
            ends = np.cumsum([len(x) for x in texts])
            doc, start, stop, anchor, inner = segments(np.frombuffer(buffer, np.uint8), ends, size, gram)
            view = memoryview(buffer)
            digests = b"".join([xxhash.xxh3_128_digest(view[a : b + size]) for a, b in zip(start.tolist(), stop.tolist())])
            two = np.frombuffer(digests, np.int64).reshape(-1, 2)
            base = (ends - [len(x) for x in texts])[doc] if len(doc) else doc
            at = pa.array(doc)
            yield pa.RecordBatch.from_pydict({
                "f": anchor, "d1": two[:, 0], "d2": two[:, 1], "inner": inner, "h": batch.column(2).take(at),
                "id": batch.column(0).take(at), "lo": (start - base).astype(np.int32), "hi": (stop - base).astype(np.int32),
            })

    pieces = materialize(
        plain.select("id", "raw", "h").mapInArrow(cut, "f long, d1 long, d2 long, inner boolean, h long, id long, lo int, hi int"),
        "segments",
    )
    equal = pieces.groupBy("f", "d1", "d2").agg(
        F.count("*").alias("n"), F.min(F.struct("h", "id", "lo", "hi", "inner")).alias("one")
    )
    classes = materialize(equal, "segment-classes")
    length = (F.col("one.hi") - F.col("one.lo") + size).cast("long")
    kinds = classes.groupBy("f").agg(F.count("*").alias("k"), F.sum(length).alias("m")).filter("k > 1").drop("k")

    several = classes.join(kinds, "f").select("f", "d1", "d2", "n", "one.*", "m")
    alone = classes.join(kinds, "f", "left_anti").select("f", "d1", "d2", "n", "one.*", F.lit(1).cast("long").alias("m"))
    inside = alone.filter(F.col("inner") & (F.lit(groups) | (F.col("n") == 1)))
    wanted = materialize(several.union(inside).groupBy("h", "id").agg(
        F.collect_list(F.struct("f", "m", "d1", "d2", "n", "lo", "hi")).alias("want")
    ), "segments-wanted")

    def fetch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole)):
            out: dict[str, list] = {c: [] for c in ("m", *OWN, "raw")}
            for h, id_, raw_, want in zip(*(batch.column(c).to_pylist() for c in ("h", "id", "raw", "want"))):
                for w in want:
                    values = (w["m"], w["f"], w["d1"], w["d2"], w["n"], h, id_, w["lo"], raw_[w["lo"] : w["hi"] + size])
                    for column, value in zip(out.values(), values):
                        column.append(value)
            kinds_ = [pa.int64()] * 7 + [pa.int32(), pa.binary()]
            yield pa.RecordBatch.from_pydict({c: pa.array(v, t) for (c, v), t in zip(out.items(), kinds_)})

    asked = _noted(plain, F.col("h"), _note(wanted, "h")).filter("noted").drop("noted")
    fetched = asked.withColumnRenamed("id", "_id").withColumnRenamed("h", "_h").join(
        wanted, (F.col("_h") == F.col("h")) & F.col("_id").eqNullSafe(F.col("id"))
    )
    bytes_of = fetched.select("h", "raw", "id", "want").mapInArrow(
        fetch, "m long, f long, d1 long, d2 long, n long, h long, id long, lo int, raw binary"
    )
    texts = materialize(bytes_of, "segment-bytes")
    count = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    sorted_ = texts.filter(F.col("m") <= hot_bytes).select(*OWN, "raw").repartition(count, "f").sortWithinPartitions("f")
    repeats = sorted_.mapInArrow(lambda batches: _marks(batches, size, groups), MARKS)

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, len(OWN), 1 << 20)):
            if not batch.num_rows:
                continue
            raw_ = batch.column(len(OWN)).to_pylist()
            hashes = [prefix_hashes(np.frombuffer(x, np.uint8), size) for x in raw_]
            at = pa.array(np.repeat(np.arange(len(raw_)), [len(x) for x in hashes]))
            offset = np.concatenate([np.arange(len(x)) for x in hashes])
            columns = [*(batch.column(k).take(at) for k in range(len(OWN))), offset, np.concatenate(hashes).view(np.int64)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=[*OWN, "off", "w"])

    busy = texts.filter(F.col("m") > hot_bytes).select(*OWN, "raw")
    if groups:
        busy = busy.dropDuplicates(["f", "d1", "d2"])
    each = busy.mapInArrow(windows, "f long, d1 long, d2 long, n long, h long, id long, lo int, off long, w long")
    places = F.sum("n") if groups else F.count("*")
    twice = each.groupBy("f", "w").agg(places.alias("places")).filter("places > 1").select("f", "w")
    hit = each.join(twice, ["f", "w"]).select(
        *OWN, "off", F.lit(size).cast("long").alias("length"), F.col("w").alias("node"), F.lit(-1).cast("long").alias("parent")
    )
    marks = repeats.union(hit)
    if groups:  # an anchor with one class whose segments have no repeat inside: the class is its only group
        length = (F.col("hi") - F.col("lo") + size).cast("long")
        marks = marks.union(alone.filter(~F.col("inner") & (F.col("n") > 1)).select(
            *OWN, F.lit(0).cast("long").alias("off"), length.alias("length"), F.lit(0).cast("long").alias("node"), F.lit(-1).cast("long").alias("parent")
        ))
    return pieces, classes, marks


def _copies(pieces: DataFrame, classes: DataFrame) -> DataFrame:
    """The segments that have equal ones."""
    return pieces.join(classes.filter("n > 1").select("f", "d1", "d2"), ["f", "d1", "d2"])


def find_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_bytes: int = MIN_BYTES, hot_bytes: int = HOT_BYTES
) -> DataFrame:
    """(f, node, parent, length, h, id, start, stop): groups of equal strings of at least ``min_bytes`` bytes; h is a hash of id and text.

    Windows of ``min_bytes`` bytes are cut into segments with one anchor (see ``segments``), so
    equal windows come together by their anchor f. Of equal segments one goes on; its places count for all of
    them. Different segments with one anchor, and segments that repeat inside, go to suffix
    arrays, whole anchor groups at a time: none of their suffixes agrees with
    one of another group for ``min_bytes`` bytes.

    f and node together name a group, over all arrays, and ``length`` is the group's. A row is one occurrence; occurrences that are in a longer
    group as well stand there alone, and ``parent`` is the node of the shorter group (same f; null: none). So all occurrences
    of a group are its own rows and those of its descendants, ``start`` onwards for ``length`` bytes; a group without rows of its
    own has one with null h, id, start and stop. Groups are maximal inside segments: a repeat
    that goes on past the end of its segments goes on as another group.

    An anchor whose different segments have more than ``hot_bytes`` bytes (the border of a passage in very many texts)
    is too large for one task; its windows are compared by hash over all tasks. Each of its windows that occurs again is a group of
    its own, with all its places, ``min_bytes`` long and without parent.
    """
    pieces, classes, marks = _compare(docs, id_col, text_col, min_bytes, hot_bytes, True)
    other = _copies(pieces, classes).select("f", "d1", "d2", *[F.col(c).alias(f"_{c}") for c in ("h", "id", "lo")])
    empty = F.col("off").isNull()
    every = marks.withColumn("d1", F.when(~empty, F.col("d1"))).join(other, ["f", "d1", "d2"], "left")

    def place(column: str) -> Column:
        return F.when(~empty, F.when(F.col("_h").isNull(), F.col(column)).otherwise(F.col(f"_{column}")))

    start = place("lo").cast("long") + F.col("off")
    return every.select(
        "f", "node", F.when(F.col("parent") >= 0, F.col("parent")).alias("parent"), "length", place("h").alias("h"), place("id").alias("id"),
        start.alias("start"), (start + F.col("length")).alias("stop"),
    )


def _merged(spans: list[dict]) -> tuple[np.ndarray, np.ndarray]:
    start = np.array([s["start"] for s in spans], np.int64)
    stop = np.array([s["stop"] for s in spans], np.int64)
    order = np.argsort(start, kind="stable")
    start, stop = start[order], np.maximum.accumulate(stop[order])
    new = np.append(True, start[1:] > stop[:-1])
    return start[new], stop[np.append(np.flatnonzero(new)[1:] - 1, len(start) - 1)]


def remove_repeats(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    min_bytes: int = MIN_BYTES,
    hot_bytes: int = HOT_BYTES,
    keep: Sequence[str] = (),
    as_text: bool = False,
) -> DataFrame:
    """(id, kept columns, n_bytes, n_removed, n_spans, kept): every document without the bytes of its repeats.

    A byte goes if it is in a string of ``min_bytes`` bytes that starts anywhere else too, in
    the same document or another; overlaps count, and all strings are judged on the input. ``kept`` is
    what is left, as bytes, and may cut a character in two; ``as_text`` drops such halves and gives text. Null texts are empty; texts under ``min_bytes``
    bytes stay. Repeated rows are documents of their own, so both lose what they share.
    """
    if clash := {"n_bytes", "n_removed", "n_spans", "kept", "spans"}.intersection([id_col, *keep]):
        raise ValueError(f"columns with the names of result columns: {sorted(clash)}")
    pieces, classes, found = _compare(docs, id_col, text_col, min_bytes, hot_bytes, False)
    start = F.col("lo").cast("long")
    copies = _copies(pieces, classes).select("h", "id", start.alias("start"), (F.col("hi") + min_bytes).cast("long").alias("stop"))
    begin = start + F.col("off")
    repeats = found.select("h", "id", begin.alias("start"), (begin + F.col("length")).alias("stop"))
    marks = materialize(copies.union(repeats).groupBy("h", "id").agg(
        F.collect_set(F.struct("start", "stop")).alias("spans")
    ), "spans")
    raw = F.coalesce(F.col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        raw.alias("_raw"), F.col(id_col), *[c for c in keep if c != id_col], F.col(id_col).cast("long").alias("_key")
    ).withColumn("_hash", F.xxhash64("_key", "_raw"))
    names = [id_col, *[c for c in keep if c != id_col]]
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*names).schema)

    def strip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in slices(whole, 0)):
            kept, removed, spans_ = [], [], []
            for text, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if spans:
                    start, stop = _merged(spans)
                    edges = [0, *np.stack([start, stop], axis=1).ravel().tolist(), len(text)]
                    kept.append(b"".join([text[a:b] for a, b in zip(edges[::2], edges[1::2])]))
                else:
                    start = ()
                    kept.append(text)
                removed.append(len(text) - len(kept[-1]))
                spans_.append(len(start))
            sizes = [len(x) + r for x, r in zip(kept, removed)]
            left = pa.array([x.decode("utf-8", "ignore") for x in kept], pa.string()) if as_text else pa.array(kept, pa.binary())
            columns = [*batch.columns[2:], *(pa.array(c, pa.int64()) for c in (sizes, removed, spans_)), left]
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_bytes", "n_removed", "n_spans", "kept"])

    # Texts without a span stay where they are.
    own = {c: f"_own{i}" for i, c in enumerate(names)}
    rows = rows.select("_raw", "_key", "_hash", *[F.col(f"`{c}`").alias(o) for c, o in own.items()])
    rows = _noted(rows, F.col("_hash"), _note(marks, "h"))
    on = (F.col("_hash") == F.col("h")) & F.col("_key").eqNullSafe(F.col("id"))
    hit = rows.filter("noted").join(marks, on, "left").select("_raw", "spans", *own.values())
    rest = rows.filter(~F.col("noted")).select("_raw", F.lit(None).cast(marks.schema["spans"].dataType).alias("spans"), *own.values())
    return hit.union(rest).toDF("_raw", "spans", *names).mapInArrow(
        strip, f"{kinds}, n_bytes long, n_removed long, n_spans long, kept {'string' if as_text else 'binary'}"
    )
