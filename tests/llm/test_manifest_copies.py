"""Exact copies and the hash tree against plain Python."""

import hashlib

import pytest
from pyspark.sql import functions as F

from corpusql.llm import exactcopies, merkle
from corpusql.operators.ranks import numbered

LONG = "word " * 60_000


def copies_rows():
    rows = [(i, f"text {i % 7}", "x") for i in range(60)] + [(100 + i, "hot", "y") for i in range(40)]
    rows += [(200, None, None), (201, "", "a"), (202, LONG, "b"), (203, LONG, "c"), (204, LONG + ".", "d")]
    rows += [(None, "no id", "e"), (None, "no id", "f"), (None, "hot", "g"), (139, "hot", "repeated"), (300, "Text 1", "h")]
    return rows


@pytest.mark.parametrize("options", [{}, {"hot_share": 1, "broadcast_rows": 0}, {"digest_bytes": 1, "hot_share": 5}, {"digest_bytes": 0}])
def test_copies_against_groups(spark, options):
    rows = copies_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, digest string").repartition(5)
    got = exactcopies.copies(df, keep=["text"], **options).collect()
    assert len(got) == len(rows)
    groups = {}
    for i, text, _ in rows:
        groups.setdefault(text or "", []).append(i)
    kept = {}
    for r in got:
        ids = groups[r.text or ""]
        assert r.group_size == len(ids) and r.text_sha256 == hashlib.sha256((r.text or "").encode()).hexdigest()
        assert r.keep_id == max((i for i in ids if i is not None), default=None)
        if r.kept:
            assert r.doc_id == r.keep_id
            kept[r.text or ""] = kept.get(r.text or "", 0) + 1
    assert kept == dict.fromkeys(groups, 1)


def test_deduplicated_rows_keep_their_columns(spark):
    df = spark.createDataFrame(copies_rows(), "doc_id long, text string, kept string")
    out = exactcopies.deduplicate(df, normalise=F.lower)
    assert out.columns == df.columns
    texts = [(r.text or "").lower() for r in out.collect()]
    assert len(texts) == len(set(texts)) == len({(t or "").lower() for _, t, _ in copies_rows()})
    assert exactcopies.deduplicate(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        exactcopies.copies(df, keep=["kept"])


def plain_tree(leaves, fanout):
    """(root, siblings of each leaf, change(i, leaf) -> root) by the definition alone."""
    levels = [list(leaves)]
    while len(levels[-1]) > 1:
        below = levels[-1]
        levels.append([hash_of("".join(below[i : i + fanout])) for i in range(0, len(below), fanout)])

    def walk(i, late):
        others = []
        for nodes in levels[:-1]:
            first = i - i % fanout
            run = nodes[first : first + fanout]
            others += run[: i - first] + run[i - first + 1 :]
            late, i = hash_of("".join(run[: i - first] + [late] + run[i - first + 1 :])), i // fanout
        return others, late

    return levels[-1][0], walk


def hash_of(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


@pytest.mark.parametrize("fanout, segment, keys", [(2, 4, 3), (3, 9, 30), (5, 4096, 1)])
def test_tree_against_plain_hashes(spark, monkeypatch, fanout, segment, keys):
    monkeypatch.setattr(merkle, "SEGMENT", segment)
    rows = [(i, f"s{i % 3}", f"l{i * i % keys:03}" if i % 5 else None, i if i % 4 else None, "é" * (i % 6) or None) for i in range(90)]
    rows += [(None, None, "single", None, ""), (7, "s", "l000", 1, LONG), (7, "s", "l000", 1, LONG), (None, "a", "l000", 2, "x"), (None, "b", "l000", 2, "x")]
    df = spark.createDataFrame([(*r, "extra") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, at string").repartition(4)
    changed = F.when(F.col("doc_id") % 3 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars")).cast("string")
    count = F.coalesce(F.concat(F.octet_length(changed).cast("string"), F.lit(":"), changed), F.lit("-"))
    got = merkle.verify(df, ["doc_id", "source", "lang", count, "text"], fanout=fanout)
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]

    def leaf(r, later=False):
        n = r[3] + 1 if later and r[3] is not None and r[0] is not None and r[0] % 3 == 0 else r[3]
        return hash_of("".join(map(field, (r[0], r[1], r[2], n, r[4]))))

    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda k: (k is not None, (k or "").encode()))
    trees = {}
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
        trees[lang] = plain_tree([leaf(r) for r in by_lang[lang]], fanout)
    root, up = plain_tree([trees[lang][0] for lang in langs], fanout)
    want = []
    for place, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            others, top = trees[lang][1](i, leaf(r, True))
            more, late = up(place, top)
            want.append((r[0], leaf(r), trees[lang][0], root, hash_of("".join(others + more)), late, late == root))
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert {r[6] for r in want} == {True, False}


def test_tree_of_nothing_and_of_one(spark):
    df = spark.createDataFrame([(1, None, "en", 3, "abc")], "doc_id long, source string, lang string, n_chars long, text string")
    assert merkle.verify(df.limit(0)).count() == 0 and merkle.build(df.limit(0)).root is None
    row = merkle.verify(df).first()
    leaf = hash_of("1:1-2:en1:33:abc")
    assert tuple(row) == (1, leaf, leaf, leaf, hash_of(""), leaf, True)


def test_numbers_within_keys(spark):
    rows = [(f"k{i % 3 if i % 2 else 0}", i % 11) for i in range(500)]
    stored = spark.createDataFrame(rows, "key string, v int").repartition(7)
    got = {}
    for r in numbered(stored, "key", [F.col("v")], "at", "n").collect():
        got.setdefault((r.key, r.n), []).append((r.at, r.v))
    for (key, n), found in got.items():
        assert [v for _, v in sorted(found)] == sorted(v for k, v in rows if k == key)
        assert sorted(at for at, _ in found) == list(range(n))
