"""Chosen-path join, suffix arrays, license scans, mixing and the pipeline on small fixtures against brute force."""

import hashlib
import itertools
import random
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusql.llm import chosenpath, license, mixing, suffixes
from corpusql.llm.queries import LEVELS, ORACLES, QUERIES, WEIGHTS

WORDS = [a + b for a in "bcdfglmnprst" for b in ("a", "ento", "iga", "oru", "ube", "ym")]


def invented(rng, count):
    return " ".join(rng.choice(WORDS) for _ in range(count))


def near_copies(rng):
    texts = []
    for _ in range(6):
        base = invented(rng, 120).split()
        texts.append(" ".join(base))
        for _ in range(9):
            other = list(base)
            for at in rng.sample(range(120), rng.choice([1, 2, 4, 6])):
                other[at] = rng.choice(WORDS)
            texts.append(" ".join(other))
    texts += [texts[0]] * 25 + [texts[0].upper()] + [invented(rng, 60) for _ in range(40)]
    texts += ["", None, "  \n ", "one two", "one  Two", "one two three"]
    return texts


@pytest.mark.parametrize("bucket", [512, 8])
def test_chosen_path_join(spark, bucket):
    texts = near_copies(random.Random(8))
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(3, texts[3], 1), (None, texts[0], 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, class_id int")
    got = {r.doc_id: r for r in chosenpath.join(df, bucket=bucket).collect()}
    assert sorted(got) == list(range(len(texts)))

    def grams(text):
        words = (text or "").lower().split()
        return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()

    sets = [grams(t) for t in texts]
    links, root = Counter(), list(range(len(texts)))
    find = lambda x: x if root[x] == x else find(root[x])
    for a, b in itertools.combinations(range(len(texts)), 2):
        both = len(sets[a] & sets[b])
        if both and both >= 0.8 * len(sets[a] | sets[b]):
            links.update([a, b])
            low, high = sorted((find(a), find(b)))
            root[high] = low
    for i, row in got.items():
        assert (row.n_links, row.group_id, row.kept) == (links[i], find(i), find(i) == i)
        assert row.class_id == min(j for j in range(len(texts)) if sets[j] == sets[i]) or not sets[i] and row.class_id == i
    assert chosenpath.join(df.limit(0)).count() == 0


def test_runs_reach_the_recall():
    assert chosenpath.runs_for(0.999, 0.8, 1) < chosenpath.runs_for(0.999, 0.8, 4) < 15


def test_interval_tree():
    rng = random.Random(3)
    for _ in range(120):
        strings = [bytes(rng.choice(b"ab") for _ in range(rng.randint(1, 60))) for _ in range(rng.randint(1, 5))]
        strings += [strings[0] * 3] * rng.randint(0, 1)
        data, ends = np.frombuffer(b"".join(strings), np.uint8), np.cumsum([len(x) for x in strings])
        begins = ends - [len(x) for x in strings]
        least = rng.choice([8, 9, 12, 16, 24])
        before = np.empty(len(data), np.int64)
        before[1:] = data[:-1]
        before[begins] = 256 + np.arange(len(strings))
        nodes = list(suffixes.repeat_tree(suffixes.SuffixArray(data, ends, least, before), before, least))
        places = {}
        for begin, end in zip(begins, ends):
            for p in range(begin, end - least + 1):
                places.setdefault(bytes(data[p : p + least]), []).append(p)
        want, got = np.zeros(len(data), bool), np.zeros(len(data), bool)
        for found in places.values():
            for p in found if len(found) > 1 else ():
                want[p : p + least] = True
        every = {node: list(own) for node, _, _, own in nodes}
        for node, parent, length, own in sorted(nodes, key=lambda n: -n[2]):
            if parent >= 0:
                every[parent] += every[node]
        for node, _, length, _ in nodes:
            words = {bytes(data[p : p + length]) for p in every[node]}
            assert len(every[node]) > 1 and len(words) == 1
            word = words.pop()
            # All occurrences, none of them extensible to the left for all.
            assert sorted(every[node]) == [p for b, e in zip(begins, ends) for p in range(b, e - length + 1) if bytes(data[p : p + length]) == word]
            assert len({int(before[p]) for p in every[node]}) > 1
            for p in every[node]:
                got[p : p + length] = True
        assert (got == want).all()


@pytest.mark.parametrize("size, hot", [(400, 1 << 20), (40, 1 << 20), (40, 200), (43, 200)])
def test_repeats_are_cut(spark, size, hot):
    rng = random.Random(size + hot % 97)
    passage, other = invented(rng, 40), "é" * 120 + invented(rng, 90)
    texts = [invented(rng, rng.randint(5, 90)) for _ in range(25)]
    texts += [invented(rng, 20) + passage + invented(rng, 15) for _ in range(9)]
    texts += [other, other, other[7:] + "x", "ab" * 700, "q" * 450, "q" * 45, "", None, passage[:39], passage + passage]
    rows = [(i, t, 2) for i, t in enumerate(texts)] + [(2, texts[2], 2), (None, invented(rng, 30), 2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_removed int")
    got = suffixes.remove_repeats(df.drop("n_removed"), min_bytes=size, hot_bytes=hot).collect()
    raw = [(i, (t or "").encode()) for i, t, _ in rows]
    seen = Counter(x[p : p + size] for _, x in raw for p in range(len(x) - size + 1))
    want = []
    for i, x in raw:
        gone = np.zeros(len(x) + 2, np.int8)
        for p in range(len(x) - size + 1):
            if seen[x[p : p + size]] > 1:
                gone[p + 1 : p + size + 1] = 1
        spans = int((np.diff(gone) == 1).sum())
        kept = bytes(b for b, g in zip(x, gone[1:]) if not g)
        want.append((i, len(x), len(x) - len(kept), spans, kept))
    key = lambda r: (r[0] is None, r[0] or 0, r[4])
    assert sorted([(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept)) for r in got], key=key) == sorted(want, key=key)
    assert suffixes.remove_repeats(df.limit(0).drop("n_removed"), min_bytes=size).count() == 0
    cut = suffixes.remove_repeats(df.drop("n_removed"), min_bytes=size, hot_bytes=hot, as_text=True)
    assert all(isinstance(r.kept, str) for r in cut.collect())


@pytest.mark.parametrize("hot", [1 << 20, 200])
def test_groups_have_all_places(spark, hot):
    rng, size = random.Random(hot), 120
    passage, other, line = invented(rng, 60), invented(rng, 120), invented(rng, 45)[:130]
    texts = [invented(rng, rng.randint(5, 60)) for _ in range(15)]
    texts += [invented(rng, 9) + passage + invented(rng, 9) for _ in range(6)] * 2
    texts += [other] * 4 + [other[7:] + "x", line, line, "x " + line, "y " + line + " z", "ab" * 70, "ab" * 70, "q" * 135, "", None]
    for _ in range(6):  # a group whose places are all in longer groups
        start = invented(rng, 50)[:125]
        texts += [invented(rng, 4) + start + end + invented(rng, 4) for end in ("qqqq", "qqqq", "zzzz", "zzzz")]
    rows = [(i, t) for i, t in enumerate(texts)] + [(16, texts[16]), (None, invented(rng, 30) + passage)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = suffixes.find_repeats(df, min_bytes=size, hot_bytes=hot).collect()
    raw = {(i, (t or "").encode()) for i, t in rows}
    by_hash = {(r.h, r.doc_id): bytes(r.raw) for r in df.selectExpr(
        "xxhash64(doc_id, cast(coalesce(text, '') AS binary)) AS h", "doc_id", "cast(coalesce(text, '') AS binary) AS raw").collect()}
    assert {(i, x) for (_, i), x in by_hash.items()} == raw
    every, length, above = {}, {}, {}
    for r in found:
        key = r.f, r.node
        every.setdefault(key, []).extend([(r.h, r.id, r.start)] if r.start is not None else [])
        assert r.start is None or r.stop - r.start == r.length >= size
        assert (length.setdefault(key, r.length), above.setdefault(key, r.parent)) == (r.length, r.parent)
    own = {key: list(places) for key, places in every.items()}
    for key, places in own.items():
        f, up = key[0], above.get(key)
        while up is not None:
            every[f, up] += places
            up = above.get((f, up))
    strings = {}
    for key, places in every.items():
        words = {by_hash[h, i][a : a + length[key]] for h, i, a in places}
        assert len(words) == 1 and len(places) > 1
        word = words.pop()
        assert word not in strings
        strings[word] = key
        want = [(h, i, p) for (h, i), x in by_hash.items() for p in range(len(x) - len(word) + 1) if x[p : p + len(word)] == word
                for _ in range(sum((a, (b or "").encode()) == (i, x) for a, b in rows))]
        assert sorted(places, key=str) == sorted(want, key=str)
    seen = Counter(x[p : p + size] for i, t in rows for x in [(t or "").encode()] for p in range(len(x) - size + 1))
    assert all(any(w in s for s in strings) for w, n in seen.items() if n > 1)
    assert len({f for f, _ in strings.values()}) > 3 and (hot == 200 or any(not own[key] for key in own))


def test_rising_subsequence():
    rng = random.Random(0)
    for _ in range(200):
        values = rng.sample(range(12), rng.randint(0, 9))
        best = max((len(c) for n in range(len(values) + 1) for c in itertools.combinations(values, n) if list(c) == sorted(c)), default=0)
        kept = [values[i] for i in license.rising(values)]
        assert kept == sorted(kept) and len(kept) == best


def test_alignment():
    template = "a b c d e f g".split()
    assert license.align(template, template) == [(i, i) for i in range(7)]
    found = license.align("x a b y c e d f g z".split(), template)
    assert len(found) == 6 and found == sorted(found) and all(p < q for (_, p), (_, q) in zip(found, found[1:]))
    assert license.align([], template) == [] and license.align(template, []) == []


def test_license_scan(spark):
    rng = random.Random(1)
    rows = [(1, None, 0), (2, "", 0), (None, "Released under the MIT License.", 0), (3, invented(rng, 50_000), 0), (4, "license permission software", 0)]
    planted = {}
    for number, (name, text) in enumerate(license.TEMPLATES.items(), 10):
        words = text.split()
        if len(words) > 12:
            words[5] = "zzz"
            words.insert(9, "extra")
        rows.append((number, f"{invented(rng, 40)}\n{' '.join(words)} {invented(rng, 30)}. {text.upper()}", 0))
        planted[number] = name
    df = spark.createDataFrame(rows * 2, "doc_id long, text string, coverage_of int")
    got = license.scan(df).collect()
    texts = {r[0]: r[1] for r in rows}
    for number, name in planted.items():
        hits = [r for r in got if r.doc_id == number and r.license == name]
        assert len(hits) == 4 and max(h.coverage for h in hits) == 1.0 and min(h.coverage for h in hits) >= 0.8
        assert all(texts[number][h.start : h.stop].lower().split()[0].strip('"') == license.TEMPLATES[name].lower().split()[0] for h in hits)
    assert sum(r.doc_id is None for r in got) == 2 and not [r for r in got if r.doc_id in (1, 2, 3, 4)]
    assert license.scan(df.limit(0)).count() == 0


PROBES = {
    "Released under the BSD License": "BSD", "Released under the ISC License": "ISC", "Licensed under CC BY 4.0": "CC-BY-4.0",
    "Licensed under CC BY-NC-SA 4.0": "CC-BY-NC-SA-4.0", "Licensed under the Apache License, Version 1.0": None,
    "This work is licensed under the GNU Lesser General Public License, version 3": "LGPL-3.0",
    "This work is licensed under the GNU General Public License, version 2": None, "Released under the Boost License": None,
    "Released under the MIT BSD License": None, "Released under a license that is not the MIT License": None,
    license.TEMPLATES["ISC-permission"]: "ISC-permission", license.TEMPLATES["MPL-2.0-notice"]: "MPL-2.0-notice",
    license.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 2"): "GPL-2.0-header",
    license.TEMPLATES["GPL-3.0-header"].replace("version 3", "version 1"): None,
    license.TEMPLATES["BSD-2-Clause-text"].replace("INCIDENTAL", "x").replace("2. Redistributions", "* Redistributions"): "BSD-2-Clause-text",
    license.TEMPLATES["BSD-3-Clause-text"].replace("copyright holder nor", "University nor"): "BSD-3-Clause-text",
    license.TEMPLATES["MIT-permission"].replace("this software", "this library"): "MIT-permission",
}


@pytest.mark.parametrize("text", PROBES)
def test_near_names_are_told_apart(text):
    found = license.Scanner(license.TEMPLATES, 0.8)(f"Some words. {text}. Other words.")
    assert [r[0] for r in found] == ([PROBES[text]] if PROBES[text] else [])


def every_start(scanner, text):
    """All places with enough agreeing words of all templates tried, best first; counted plainly, no stretches, no word filters."""
    words = license.WORD.findall(text.lower())
    found = []
    for name, template in scanner.templates.items():
        size, slack = len(template), max(2, len(template) // 4)
        agree = Counter(at - j for at, w in enumerate(words) for j, x in enumerate(template) if w == x)
        near = [s for s in agree if sum(agree[s + d] for d in range(-slack, slack + 1)) >= 0.8 * size - 1e-9]
        found += scanner.candidates(words, name, sorted(near, key=lambda s: (-agree[s], s)))
    return sorted((name, m) for name, _, _, m in scanner.best(found))


def test_license_scan_against_every_start(monkeypatch):
    rng = random.Random(7)
    monkeypatch.setattr(license, "STRETCH", 64)
    names = ["Apache-2.0", "Apache-2.0-header", "CC-BY-4.0", "CC-BY-NC-4.0", "GPL-3.0-header", "ISC", "ISC-permission", "LGPL-3.0", "MIT", "MIT-permission"]
    scanner = license.Scanner({n: license.TEMPLATES[n] for n in names}, 0.8)
    hits = 0
    for _ in range(40):
        parts = []
        for name in rng.choices(names, k=3):
            words = license.TEMPLATES[name].split()
            for _ in range(rng.randrange(len(words) // 4 + 1)):
                at = rng.randrange(len(words))
                words[at : at + 1] = rng.choice([[], ["zzz"], [words[at], "the"], [words[at], rng.choice(["lesser", "nc", "mit"])]])
            parts += [invented(rng, rng.randrange(30)), " ".join(words)]
        text = " ".join(parts)
        got = sorted((r[0], r[3]) for r in scanner(text))
        assert got == every_start(scanner, text)
        hits += len(got)
    assert hits > 40


def test_lines_of_the_tables_are_found(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {(r.doc_id, r.license) for r in QUERIES["op3_license_scan"](spark, sf_dir).collect()}
    lines = {"Apache-2.0": "Licensed under the Apache License, Version 2.0.", "MIT": "Released under the MIT License."}
    for name, line in lines.items():
        assert {i for i, t in texts.items() if line in t} == {i for i, n in got if n == name}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_queries_equal_their_sql(spark, sf_dir, name):
    con = duckdb.connect()
    for table in ("documents", "embeddings", "labels"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    df = QUERIES[name](spark, sf_dir)
    result = con.execute(ORACLES[name])
    names = [x[0] for x in result.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(tuple(r) for r in df.select(*names).collect()) == Counter(map(tuple, result.fetchall()))


def test_shares_among_siblings(spark):
    nodes = [("a", 10, 1, 100), ("b", 1000, 1, 100), ("c", 1000, 2, 100), ("d", 5, 6, 100)]
    df = spark.createDataFrame([("p", *n) for n in nodes], "p string, name string, capacity long, weight long, above long")
    got = {r.name: r.budget for r in mixing.share_out(df, ["p"], "name").collect()}
    assert got["a"] == 10 and got["d"] == 5 and got["b"] + got["c"] == 85 and got["b"] in (28, 29)


def test_mixture_of_odd_rows(spark):
    rows = [(i, "w " * (i % 7), "en" if i % 3 else None, f"src{i % 4}", "x") for i in range(90)]
    rows += [(5, "w " * 5, "en", "src1", "x"), (None, "w w", None, None, "x"), (91, None, "en", "src0", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_tokens string").drop("n_tokens")
    total = sum((r[1] or "").count("w") for r in rows)
    got = mixing.mix(df, LEVELS, WEIGHTS, (1, 2), max_epochs=3, seed=1).collect()
    taken = sum(r.n_tokens for r in got)
    assert taken <= total // 2 and taken >= total // 2 - 7 * len({(r.domain, r.lang, r.source) for r in got})
    assert max(r.epoch for r in got) <= 3
    every = mixing.select(df, LEVELS, {}, (1, 1)).collect()
    assert Counter(map(tuple, every)) == Counter(map(tuple, df.collect()))
    assert mixing.mix(df.limit(0), LEVELS, WEIGHTS, (1, 2)).count() == 0


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.selectExpr("*", "'x' AS kept", "1 AS score").union(docs.selectExpr("NULL", "NULL", "NULL", "NULL", "NULL", "'y'", "2"))
    now, counts = extra, []
    for name, stage in corpus_pipeline.STAGES:
        now = stage(spark, now, sf_dir).cache()
        counts.append(now.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert now.columns == extra.columns
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0.5 * counts[0] and counts[0] > 150
    assert all(r.n_tokens >= 0 and len(r.decoded_sha256) == 64 for r in now.collect())


def without_repeats(texts, length):
    """Each text without the bytes of strings of ``length`` bytes that start twice anywhere, by counting all of them."""
    raw = {i: (text or "").encode() for i, text in texts.items()}
    starts = Counter(hash(b[k : k + length]) for b in raw.values() for k in range(len(b) - length + 1))
    out = {}
    for i, b in raw.items():
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - length + 1):
            if starts[hash(b[k : k + length])] > 1:
                gone[k] += 1
                gone[k + length] -= 1
        left = np.frombuffer(b, np.uint8)[np.cumsum(gone)[:-1] == 0] if b else b""
        out[i] = bytes(left).decode("utf-8", "ignore")
    return out


def test_query_counts_bytes_of_passages(spark, tmp_path):
    """Passages of over 50 words that repeat stay in ``op9`` at 399 bytes and go at 400; n_bytes is the size of the input either way."""
    rng = random.Random(43)
    passages = {}
    for size in (399, 400):
        words = [rng.choice(WORDS) for _ in range(60)]
        words += ["é" * ((size - len(" ".join(words))) // 2 - 1)]
        text = " ".join(words)
        passages[size] = text + "." * (size - len(text.encode()))
    assert all(len(p.encode()) == size and len(p.split()) > 50 for size, p in passages.items())
    sizes = [None, 399, 400]
    texts = [f"{invented(rng, 40)} {i}{passages.get(sizes[i % 3], '')}{i} {invented(rng, 20)}" for i in range(9)]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in QUERIES["op9_suffix_array_dedup"](spark, str(tmp_path)).collect()}
    for i, text in enumerate(texts):
        gone = sizes[i % 3] == 400
        kept = text.replace(passages[400], "") if gone else text
        want = (len(text.encode()), 400 * gone, int(gone), hashlib.sha256(kept.encode()).hexdigest())
        assert tuple(rows[i])[1:] == want


def test_passages_of_over_50_words_go(spark, sf_dir):
    """A passage of 51 to 60 words in several documents is cut from all of them; documents without one stay as they are."""
    rng = random.Random(31)
    rows, planted = [], {}
    for i in range(60):
        text = invented(rng, 150)
        if i % 3 == 0:
            # words of five letters on average, as in the test tables
            planted.setdefault(i % 9, " ".join(rng.choice(WORDS) + rng.choice(["", "", "lo", "nar"]) for _ in range(rng.randint(51, 60))))
            text = f"{text} {planted[i % 9]} {invented(rng, 40)}"
        rows.append((i, text, "en", "s1", len(text)))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = {r.doc_id: r.text for r in corpus_pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    for i, text, *_ in rows:
        if i % 3 == 0:
            assert planted[i % 9] not in cut[i] and len(cut[i]) <= len(text) - len(planted[i % 9]) + 12
        else:
            assert cut[i] == text


def test_pipeline_stages_agree_with_operators(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    kept = {r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, sf_dir).collect()}
    assert kept == {r.doc_id for r in chosenpath.join(docs).collect() if r.kept}
    cut = {r.doc_id: r for r in corpus_pipeline.cut_repeats(spark, docs, sf_dir).collect()}
    for doc_id, kept in without_repeats({r.doc_id: r.text for r in docs.collect()}, corpus_pipeline.PASSAGE_BYTES).items():
        assert cut[doc_id].text == kept and cut[doc_id].n_chars == len(kept)
    rest = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        rest = stage(spark, rest, sf_dir)
        assert rest.count() == 0


@pytest.mark.parametrize("bits", [64, 1 << 24])
def test_texts_without_repeats_are_not_shuffled(spark, monkeypatch, bits):
    """With a full bit table every text is asked, with a wide one few are; the rows are the same."""
    monkeypatch.setattr(suffixes, "FILTER_BITS", bits)
    same = "the passage that stands in two of the texts"
    texts = [f"{i} begins like no other {i * 7919} " for i in range(300)] + [f"a {same} b", f"c {same} d", None, ""]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r.doc_id: r for r in suffixes.remove_repeats(df, min_bytes=40).collect()}
    assert len(rows) == 304 and [i for i, r in rows.items() if r.n_removed] == [300, 301]
    assert rows[300].n_removed == len(same) + 2 and rows[300].n_spans == 1 and bytes(rows[302].kept) == b""
    keys = df.withColumn("h", F.xxhash64("doc_id"))
    noted = suffixes._noted(keys, F.col("h"), suffixes._note(keys.filter("doc_id >= 300"), "h"))
    assert noted.filter("noted and doc_id >= 300").count() == 4
    assert noted.filter("noted").count() == 4 or bits == 64
