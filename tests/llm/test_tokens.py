"""Byte-level BPE and token files against the libraries."""

import base64
import hashlib
import random
import zlib

import numpy as np
import pytest

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")

from corpusql.llm import bpe, tokenfile  # noqa: E402

ALPHABET = "ab AB é'sßñ \n\t\r  \x1c\x85　​09Ⅷ$!_,.中文😀́ΣİtTlL"
RANKS = public.path("byte_bpe_multi_50k.tiktoken")
WORDS = public.path("word_bpe_49k.json")


def odd_texts(count, size=50):
    rng = random.Random(4)
    made = ["".join(rng.choice(ALPHABET) for _ in range(rng.randint(0, size))) for _ in range(count)]
    return [*made, "", " ", "a  b", "a \n b ", "a" * 3000, "é" * 999, " " * 700, "!?" * 900, "<|endoftext|> <|startoftext|>", "Hi!, you. No?. e.\nf,\n"]


def test_bpe_equals_the_library():
    ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in open(RANKS, "rb"))}
    library = tiktoken.Encoding("own", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})
    own = bpe.encoder(RANKS, public.PATTERN)
    texts = odd_texts(3000)
    for text, ids in zip(texts, own.encode_batch(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(text), repr(text)
        assert own.decode(ids) == text.encode()


def test_batch_and_single_trees_agree():
    own = bpe.encoder(RANKS, public.PATTERN)
    pieces = [p.encode() for text in odd_texts(300) for p in own.pieces.findall(text) if len(p.encode()) <= 32]
    assert [np.frombuffer(x, "<u4").tolist() for x in own._encode_many(pieces, 32)] == [own.encode_piece(p) for p in pieces]


def test_caches_may_be_cleared(monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_ENTRIES", 3)
    own = bpe.Encoder(bpe.read_ranks(RANKS), public.PATTERN)
    texts = odd_texts(60)
    assert own.encode_batch(texts) == bpe.encoder(RANKS, public.PATTERN).encode_batch(texts)


def test_round_trip_frame(spark):
    rows = [(1, None, "x"), (2, "", "y"), (3, "Hello wörld", None), (3, "Hello wörld", None), (None, "no id", "z"), (5, "long " * 50_000, "q")]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = bpe.round_trip(df, RANKS, public.PATTERN).collect()
    empty = hashlib.sha256(b"").hexdigest()
    assert len(got) == 6
    for row in got:
        text = {r[0]: r[1] for r in rows}[row.doc_id] or ""
        assert row.decoded_sha256 == hashlib.sha256(text.encode()).hexdigest()
        assert (row.n_tokens == 0) == (row.ids_sha256 == empty) == (text == "")
    ids = bpe.encode(df, RANKS, public.PATTERN)
    back = {r.doc_id: bytes(r.decoded) for r in bpe.decode(ids, RANKS, public.PATTERN).collect()}
    assert back[3] == "Hello wörld".encode() and back[1] == b""
    assert bpe.round_trip(df.limit(0), RANKS, public.PATTERN).count() == 0
    with pytest.raises(ValueError):
        bpe.round_trip(df.withColumnRenamed("doc_id", "ids_sha256").drop("n_tokens"), RANKS, public.PATTERN, "ids_sha256")


def test_packing_any_numbers():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 70_001):
        values = (rng.integers(0, 2**32, n, dtype=np.uint64) >> rng.integers(0, 32, n).astype(np.uint64)).astype(np.uint32)
        control, data = tokenfile.pack(values)
        assert (tokenfile.unpack(control, data, n) == values).all()


def test_parts_equal_whole_texts():
    texts = odd_texts(4000)
    assert tokenfile.WordTokenizer(WORDS)(texts) == tokenfile.WordTokenizer(WORDS, whole=True)(texts)


def test_words_with_signs_and_lines():
    texts = [f"{w}{s}{e}" for w in ("word", "été", "Über", "e\u0301a", "ŉ", "x_y", "it's", "ﬁn", "ß", "ab1") for s in ("!", "%%%", "'", "'s", "_", "...", "<|", "") for e in ("", " end", "\nnext, line.\n", ",\nof. it")]
    assert tokenfile.WordTokenizer(WORDS)(texts) == tokenfile.WordTokenizer(WORDS, whole=True)(texts)
    for one, two in zip(tokenfile.WordTokenizer(WORDS)(texts), tokenfile.WordTokenizer(WORDS, letter="H")(texts)):
        assert np.frombuffer(one, "<u4").tolist() == np.frombuffer(two, "<u2").tolist()


def test_added_tokens_as_the_plain_call_gives_them():
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = ["hello <|endoftext|> there", "Hello,<|startoftext|>World. <|endoftext|>", "HELLO <|ENDOFTEXT|> x", "<|endoftext |>", "<|endoftext|>", "no sign, here."]
    texts += [f"{a}<|endoftext|>{b}" for a, b in zip(odd_texts(200), odd_texts(200)[::-1])] + odd_texts(200)
    want = [library.encode(text, add_special_tokens=False).ids for text in texts]
    assert want[0] == [3306, 49407, 997]
    for whole in (False, True):
        assert [np.frombuffer(ids, "<u4").tolist() for ids in tokenfile.WordTokenizer(WORDS, whole)(texts)] == want


def test_damaged_file():
    raw = tokenfile.file_bytes([1, None], [np.array([5, 5, 7]), np.array([], int)], np.array([5, 7]), np.array([0] * 5 + [0, 0, 1]))
    names, lists = tokenfile.read_bytes(raw)
    assert names == [1, None] and [x.tolist() for x in lists] == [[5, 5, 7], []]
    with pytest.raises(ValueError):
        tokenfile.read_bytes(raw[:60] + b"\xff" + raw[61:])


def test_files_hold_documents_in_order(spark, tmp_path):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    rng = random.Random(1)
    rows = [(i, rng.choice(["", None, "A few words, and more. Of them!"]) if i % 3 else f"text {i} " * (i % 40)) for i in range(300)]
    rows += [(7, "again seven"), (None, "no id"), (700, "end <|endoftext|> of"), (701, "Word!! word%%% a's, it's$ x_y_ été!? ŉ! ÅB! ﬁ. ǆ?")]
    rng.shuffle(rows)
    df = spark.createDataFrame([(a, b, 1) for a, b in rows], "doc_id long, text string, start int")
    packed = tokenfile.encode(df, WORDS, 2)
    manifest = tokenfile.write(packed, str(tmp_path / "files"), file_ids=500)
    assert manifest.count() > 3
    got = tokenfile.read(spark, str(tmp_path / "files"), manifest).orderBy("start").collect()
    assert len(got) == len(rows) and got[0].doc_id is None
    assert [r.doc_id for r in got[1:]] == sorted(r[0] for r in rows if r[0] is not None)
    at, texts = 0, {}
    for i, text in rows:
        texts.setdefault(i, []).append(text)
    for row in got:
        found = [np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4") for t in texts[row.doc_id]]
        assert row.start == at and (row.n_tokens, row.ids_crc32) in [(len(x), zlib.crc32(x.tobytes())) for x in found]
        at += row.n_tokens
    assert tokenfile.round_trip(df.limit(0), WORDS, 2).count() == 0
