"""Token ids in binary files: frequency-ranked, variable-length, control bytes apart from data bytes."""

from __future__ import annotations

import os
import re
import struct
import unicodedata
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusql.llm.common import schema_with_id, slices
from corpusql.session import file_store, materialize, shared_dir

MAGIC = b"TOKFREQ1"
FILE_IDS = 4 << 20
CACHE_ENTRIES = 800_000

# Length of the four values behind a control byte, and of all four together.
LENGTHS = (np.arange(256)[:, None] >> np.array([0, 2, 4, 6]) & 3) + 1
TOTALS = LENGTHS.sum(axis=1)
# For each control byte, where value v takes its byte b from among the data bytes; 16 is a zero.
GATHER = np.full((256, 4, 4), 16, np.uint8)
for _control in range(256):
    _at = 0
    for _value in range(4):
        for _byte in range(LENGTHS[_control, _value]):
            GATHER[_control, _value, _byte] = _at
            _at += 1
GATHER = GATHER.reshape(256, 16)


def pack(values: np.ndarray) -> tuple[bytes, bytes]:
    """(control bytes, data bytes) of unsigned 32-bit values: two bits say how many bytes a value has."""
    count = len(values)
    padded = np.zeros(-(-count // 4) * 4, np.uint32)
    padded[:count] = values
    size = 1 + (padded > 0xFF).astype(np.uint8) + (padded > 0xFFFF) + (padded > 0xFFFFFF)
    size = size.astype(np.uint8)
    codes = (size - 1).reshape(-1, 4)
    control = codes[:, 0] | codes[:, 1] << 2 | codes[:, 2] << 4 | codes[:, 3] << 6
    raw = padded.astype("<u4").view(np.uint8).reshape(-1, 4)
    data = raw[np.arange(4) < size[:, None]]
    return control.astype(np.uint8).tobytes(), data.tobytes()


def unpack(control: bytes, data: bytes, count: int, step: int = 1 << 16) -> np.ndarray:
    """The values again, by table: a control byte names the place of each of its 16 result bytes."""
    codes = np.frombuffer(control, np.uint8)
    raw = np.frombuffer(data + b"\0" * 17, np.uint8)
    out = np.empty(len(codes) * 4, "<u4")
    starts = np.concatenate([[0], np.cumsum(TOTALS[codes])]).astype(np.int32 if len(data) < 2**31 - 64 else np.int64)
    for a in range(0, len(codes), step):
        part = codes[a : a + step]
        table = GATHER[part]
        places = starts[a : a + len(part), None] + table
        values = raw[np.minimum(places, len(raw) - 1)]
        values[table == 16] = 0
        out[4 * a : 4 * (a + len(part))] = values.reshape(-1).view("<u4")
    return out[:count]


def file_bytes(doc_ids: list[int | None], lists: list[np.ndarray], by_rank: np.ndarray, rank_of: np.ndarray) -> bytes:
    """One file: magic, counts, the ids by rank, document ids and lengths, control bytes, data bytes, crc32.

    A file carries the ids by rank that it uses itself, so it can be read alone.
    """
    values = np.concatenate([rank_of[x] for x in lists]) if lists else np.zeros(0, np.int64)
    top = int(values.max()) + 1 if len(values) else 0
    control, data = pack(values.astype(np.uint32))
    known = np.array([x is not None for x in doc_ids], np.uint8)
    names = np.array([x or 0 for x in doc_ids], "<i8")
    sizes = np.array([len(x) for x in lists], "<i8")
    head = struct.pack("<QQQQQ", len(lists), len(values), top, len(control), len(data))
    parts = [MAGIC, head, by_rank[:top].astype("<u4").tobytes(), names.tobytes(), known.tobytes(), sizes.tobytes(), control, data]
    body = b"".join(parts)
    return body + struct.pack("<I", zlib.crc32(body))


def read_bytes(raw: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    """(document ids, id arrays) of one file; a damaged file is an error."""
    if raw[:8] != MAGIC or zlib.crc32(raw[:-4]) != struct.unpack("<I", raw[-4:])[0]:
        raise ValueError("not a token file, or a damaged one")
    docs, count, top, n_control, n_data = struct.unpack("<QQQQQ", raw[8:48])
    at = 48

    def take(size: int) -> bytes:
        nonlocal at
        at += size
        return raw[at - size : at]

    by_rank = np.frombuffer(take(4 * top), "<u4")
    names = np.frombuffer(take(8 * docs), "<i8").tolist()
    known = np.frombuffer(take(docs), np.uint8)
    sizes = np.frombuffer(take(8 * docs), "<i8")
    values = unpack(take(n_control), take(n_data), count)
    ids = by_rank[values] if count else np.zeros(0, "<u4")
    ends = np.cumsum(sizes)
    lists = [ids[a:b] for a, b in zip(ends - sizes, ends)]
    return [x if k else None for x, k in zip(names, known)], lists


class WordTokenizer:
    """Ids of the ``tokenizers`` library, with a cache by white-space-free part.

    For tokenizers that lower the case, drop white space and never merge across
    it or between a letter and a sign: ids of a text are the ids of its parts in
    order, and a full stop or comma between a letter and a space is a part of its
    own. ``whole`` switches the cache off for others. Texts that hold the content of an added token (a literal
    <|endoftext|>) go to the library whole, which gives them that token's id as its plain call does. ``letter`` is the
    struct code of an id: ``H`` for two bytes, ``I`` for four.
    """

    def __init__(self, path: str, whole: bool = False, letter: str = "I") -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.whole = whole
        self.known: dict[str, bytes] = {}
        # The byte-level step of such tokenizers shows each byte as one printable letter.
        hidden = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174)]
        self.byte_letters = {b: 256 + k for k, b in enumerate(hidden)}
        # A sign before the stop or comma belongs to one run with it; some letters change with what stands by.
        self.signs = re.compile(r"[!-/:-@\[-`{-~\x00-\x08\x0e-\x1f\x7f][.,][ \n]")
        self.others = re.compile("[^0-9A-Za-zÀ-ÖØ-öø-ÿ \n\t\r][.,][ \n]|[\u0300-\u036f\u0130\u03a3]")
        added = self.library.get_added_tokens_decoder().values()
        # A normalized token is looked for after the normalizer, so letter case and white space may differ in the text.
        self.added = re.compile("|".join(re.escape(t.content) for t in added if not t.normalized) or r"(?!)")
        if any(t.normalized for t in added):
            self.whole = True
        self.letter = letter
        self.packers = [struct.Struct(f"<{n}{letter}").pack for n in range(16)]
        # Letters, then nothing but signs: the tokenizer splits between them, unless lowering the letter adds a mark.
        self.ending = re.compile(r"([^\W\d_]+)([!-/:-@\[-`{-~]+)")

    def _fresh(self, parts: list[str], plain: bool = True) -> list[bytes]:
        """Ids by the library. Lowered parts of texts without an added token may look like one, so ``plain`` is off for them."""
        self.library.encode_special_tokens = not plain
        found = self.library.encode_batch_fast(parts, add_special_tokens=False)
        return [struct.pack(f"<{len(ids)}{self.letter}", *ids) for ids in (x.ids for x in found)]

    def _learn(self, parts: list[str]) -> None:
        """Cache the ids of parts. Lower-cased composed words are one piece each, so the library's model takes them as they are."""
        known, ending = self.known, self.ending.fullmatch
        words, pairs, others = [], [], []
        for part in parts:
            if part.isalpha():
                words.append(part)
            elif part.islower() and (cut := ending(part)) and cut[1].isalpha() and unicodedata.is_normalized("NFC", part):
                pairs.append((part, *cut.groups()))
            else:
                others.append(part)
        words += [word for _, word, _ in pairs if word not in known]
        merge, packers = self.library.model.tokenize, self.packers
        for word in words:
            raw = word
            if not word.islower():
                others.append(word)
                continue
            if not word.isascii():
                if not unicodedata.is_normalized("NFC", word):
                    others.append(word)
                    continue
                raw = word.encode("utf-8").decode("latin-1").translate(self.byte_letters)
            ids = [token.id for token in merge(raw)]
            known[word] = packers[len(ids)](*ids) if len(ids) < 16 else struct.pack(f"<{len(ids)}{self.letter}", *ids)
        others += {signs for _, _, signs in pairs if signs not in known}
        known.update(zip(others, self._fresh(others, plain=False)))
        for part, word, signs in pairs:
            known[part] = known[word] + known[signs]

    def _parts(self, text: str) -> list[str]:
        if (self.signs if text.isascii() else self.others).search(text):
            return text.split(" ")
        plain = text.lower().replace("\n", " ").replace(", ", " , ").replace(". ", " . ")
        return plain.split(" ")

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.whole:
            return self._fresh(texts)
        known = self.known
        if len(known) > CACHE_ENTRIES:
            known.clear()
        special = [i for i, text in enumerate(texts) if self.added.search(text)]
        apart = dict(zip(special, self._fresh([texts[i] for i in special]))) if special else {}
        cut = [[] if i in apart else self._parts(text) for i, text in enumerate(texts)]
        fresh = list(set().union(*cut).difference(known))
        for start in range(0, len(fresh), 10_000):
            self._learn(fresh[start : start + 10_000])
        get = known.__getitem__
        return [apart[i] if i in apart else b"".join(map(get, parts)) for i, parts in enumerate(cut)]


_TOKENIZERS: dict[tuple[str, bool], WordTokenizer] = {}


def encode(
    docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text", whole: bool = False
) -> DataFrame:
    """(id, n, ids, counts): ids of every whole text, the end id last, in two bytes each where the vocabulary allows it, else four.

    Each task ends with one row that has no ``n`` and no ``ids``, but ``counts``: the ids it has met and how often.
    """
    schema = schema_with_id(docs, id_col, [("n", T.LongType()), ("ids", T.BinaryType()), ("counts", T.BinaryType())])
    kinds = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = (path, whole)
        if key not in _TOKENIZERS:
            _TOKENIZERS[key] = WordTokenizer(path, whole)
            short = max(_TOKENIZERS[key].library.get_vocab_size(), end_id or 0) < 1 << 16
            if short:
                _TOKENIZERS[key] = WordTokenizer(path, whole, "H")
        own = _TOKENIZERS[key]
        kind = "<u2" if own.letter == "H" else "<u4"
        end = b"" if end_id is None else np.array([end_id], kind).tobytes()
        total = np.zeros(1, np.int64)
        for batch in (part for held in batches for part in slices(held)):
            found = [ids + end for ids in own(pc.fill_null(batch.column(1), "").to_pylist())]
            one = np.bincount(np.frombuffer(b"".join(found), kind), minlength=len(total))
            one[: len(total)] += total
            total = one
            sizes = pa.array([len(x) // np.dtype(kind).itemsize for x in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), sizes, pa.array(found, pa.binary()), pa.nulls(len(found), pa.binary())], schema=kinds)
        used = np.flatnonzero(total)
        counts = used.astype("<i8").tobytes() + total[used].astype("<i8").tobytes()
        yield pa.RecordBatch.from_arrays([pa.nulls(1, kinds.field(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts])], schema=kinds)

    return docs.select(F.col(id_col), F.col(text_col).cast("string")).mapInArrow(run, schema)


def id_arrays(batch: pa.RecordBatch) -> list[np.ndarray]:
    """The id arrays of rows whose last columns are n and ids."""
    sizes, raw = (batch.column(k).to_pylist() for k in (-2, -1))
    return [np.frombuffer(x, f"<u{len(x) // n}") if n else np.zeros(0, "<u2") for n, x in zip(sizes, raw)]


def frequency_order(encoded: DataFrame) -> np.ndarray:
    """All ids that occur, most frequent first, ties to the smaller id.

    Summed by id from the counts of the encoding tasks, so no ids are read again. The result is bounded by the vocabulary.
    """

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                ids, n = np.frombuffer(raw, "<i8").reshape(2, -1)
                yield pa.RecordBatch.from_pydict({"id": ids, "n": n})

    counts = encoded.select("counts").filter("counts IS NOT NULL").mapInArrow(spread, "id long, n long")
    rows = counts.groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = rows.column("id").to_numpy(), rows.column("n").to_numpy()
    return ids[np.lexsort((ids, -n))]


def write(encoded: DataFrame, path: str, id_col: str = "doc_id", file_ids: int = FILE_IDS) -> DataFrame:
    """Write the ids in ascending document order, and return the manifest: (file, docs, n_tokens, n_bytes).

    ``encoded`` should be a stored table: it is read for the counts, for the order and for the files.
    Ranges of (id, content) go to tasks, so equal ids spread too; null ids come first. A task cuts its
    range into files of about ``file_ids`` ids, so it holds one file at a time.
    File names ascend with the ranges. A file is written under a name of
    its own and then renamed, so a repeated task leaves the same files.
    """
    spark = encoded.sparkSession
    order = frequency_order(encoded)
    rank_of = np.zeros(int(order.max()) + 1 if len(order) else 1, np.uint32)
    rank_of[order] = np.arange(len(order))
    shipped = spark.sparkContext.broadcast((order, rank_of))
    total = encoded.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    tasks = int(max(1, -(-total // (4 * file_ids)), min(total // 200_000, 2 * spark.sparkContext.defaultParallelism)))

    def save(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        by_rank, ranks = shipped.value
        store, folder = file_store(path)
        store.create_dir(folder, recursive=True)
        part = TaskContext.get().partitionId()
        names: list[int | None] = []
        lists: list[np.ndarray] = []
        held = number = 0

        def flush() -> pa.RecordBatch:
            nonlocal names, lists, held, number
            file = f"part-{part:06d}-{number:06d}.tok"
            raw = file_bytes(names, lists, by_rank, ranks)
            own = f"{folder}/_{file}.{uuid.uuid4().hex}"
            with store.open_output_stream(own) as out:
                out.write(raw)
            store.move(own, f"{folder}/{file}")
            row = {"file": [file], "docs": [len(names)], "n_tokens": [sum(map(len, lists))], "n_bytes": [len(raw)]}
            names, lists, held, number = [], [], 0, number + 1
            return pa.RecordBatch.from_pydict(row)

        for batch in (part for whole in batches for part in slices(whole, 2)):
            for name, ids in zip(batch.column(0).to_pylist(), id_arrays(batch)):
                lists.append(ids)
                names.append(name)
                held += len(lists[-1])
                if held >= file_ids:
                    yield flush()
        if names:
            yield flush()

    rows = encoded.filter("n IS NOT NULL").select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64("ids").alias("h"), "n", "ids")
    ranged = rows.repartitionByRange(tasks, "doc_id", "h").sortWithinPartitions("doc_id", "h", "ids")
    manifest = ranged.select("doc_id", "n", "ids").mapInArrow(save, "file string, docs long, n_tokens long, n_bytes long")
    return materialize(manifest, "token-manifest")


def read(spark: SparkSession, path: str, manifest: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32), from the files alone but for the number of ids before each file.

    Spark reads the files whole (they have a bounded size); ``start`` adds up the manifest, one
    row per file, and the lengths inside the file.
    """

    def load(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, raw in zip(batch.column(0).to_pylist(), batch.column(1)):
                names, lists = read_bytes(raw.as_py())
                sizes = np.array([len(x) for x in lists], np.int64)
                yield pa.RecordBatch.from_pydict({
                    "file": [file] * len(names),
                    "doc_id": pa.array(names, pa.int64()),
                    "inside": np.cumsum(sizes) - sizes,
                    "n_tokens": sizes,
                    "ids_crc32": pa.array([zlib.crc32(x.tobytes()) for x in lists], pa.int64()),
                })

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*.tok").load(path)
    decoded = files.select(F.element_at(F.split("path", "/"), -1).alias("file"), "content").mapInArrow(
        load, "file string, doc_id long, inside long, n_tokens long, ids_crc32 long"
    )
    before = W.orderBy("file").rowsBetween(W.unboundedPreceding, -1)
    bases = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("base"))
    return decoded.join(bases, "file").select(
        "doc_id", (F.col("base") + F.col("inside")).alias("start"), "n_tokens", "ids_crc32"
    )


def round_trip(
    docs: DataFrame, path: str, end_id: int | None, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Encode, write in the file format to the shared folder, and read back: see ``read``.

    Null and empty texts have the end id alone. Repeated rows stay apart;
    equal ids are ordered by content. An empty table gives no files and no rows.
    """
    spark = docs.sparkSession
    encoded = materialize(encode(docs, path, end_id, id_col, text_col), "token-ids")
    folder = shared_dir(spark, "token-files")
    manifest = write(encoded, folder, id_col)
    if manifest.isEmpty():
        return spark.createDataFrame([], "doc_id long, start long, n_tokens long, ids_crc32 long")
    return read(spark, folder, manifest)
