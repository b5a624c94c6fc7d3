import math
import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from corpusql.functions import text as tx
from corpusql.operators import chunking as ck


def docs(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "doc_id string, text string")


def sizes(spark, n, size=512, overlap=50):
    text = " ".join(f"w{i}" for i in range(n))
    rows = ck.token_chunks(docs(spark, text), size, overlap).orderBy("chunk_index").collect()
    return [r.token_count for r in rows]


@pytest.mark.parametrize(
    "n,expected",
    [
        (1, [1]), (462, [462]), (463, [463, 1]), (512, [512, 50]), (924, [512, 462]),
        (925, [512, 463, 1]), (3000, [512] * 6 + [228]),
    ],
)
def test_window_sizes(spark, n, expected):
    assert sizes(spark, n) == expected


def test_blank_text_gives_no_chunk(spark):
    assert ck.token_chunks(docs(spark, "", "  \n\t ", None)).count() == 0


def test_overlap_must_be_smaller_than_size(spark):
    for overlap in (10, 11, -1):
        with pytest.raises(ValueError):
            ck.token_chunks(docs(spark, "a"), 10, overlap)


def test_short_text_is_one_identical_chunk(spark):
    rows = ck.token_chunks(docs(spark, "Short text"), 1000, 50).collect()
    assert [(r.text, r.chunk_index, r.chunk_id) for r in rows] == [("Short text", 0, "0_chunk_0")]


def test_sentences_repeated_make_bounded_chunks(spark):
    rows = ck.token_chunks(docs(spark, "This is a test sentence. " * 20), 50, 10).collect()
    assert len(rows) > 1
    assert all(r.token_count <= 50 for r in rows)


def brute_windows(text, size, overlap):
    ws = r"[ \t\n\x0b\f\r]"
    tokens = re.findall(rf"{ws}*[^ \t\n\x0b\f\r]+(?:{ws}+\Z)?", text)
    return ["".join(tokens[s : s + size]) for s in range(0, len(tokens), size - overlap)]


TEXTS = [
    "a  b\n\nc\td e ", "  lead and trail \n", "é à ü x y", "one", "x\x0by\fz", "\n\n\n", "a" * 300 + " b " * 40,
]


@pytest.mark.parametrize("size,overlap", [(1, 0), (3, 1), (5, 4), (7, 2)])
def test_windows_against_brute_force(spark, size, overlap):
    rows = ck.token_chunks(docs(spark, *TEXTS), size, overlap).collect()
    for i, text in enumerate(TEXTS):
        got = [r.text for r in sorted((r for r in rows if r.doc_id == str(i)), key=lambda r: r.chunk_index)]
        assert got == brute_windows(text, size, overlap)


@settings(max_examples=15, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(alphabet="ab .\n", max_size=60), min_size=1, max_size=5), st.integers(2, 6))
def test_chunk_count_and_cover(spark, texts, size):
    overlap = size // 2
    rows = ck.token_chunks(docs(spark, *texts), size, overlap)
    whole = {r.doc_id: r.text for r in ck.reassemble(rows, dedup_overlap=True, overlap=overlap).collect()}
    counts = {r.doc_id: r["count"] for r in rows.groupBy("doc_id").count().collect()}
    for i, text in enumerate(texts):
        n = len(text.split())
        assert counts.get(str(i), 0) == math.ceil(n / (size - overlap))
        if n:
            assert whole[str(i)] == text


def test_sentence_packing_golden(spark):
    rows = ck.sentence_chunks(docs(spark, "A b c. D e f. G h i. J."), 6, 2).orderBy("chunk_index").collect()
    assert [r.text for r in rows] == ["A b c. D e f.", "A b c. D e f. G h i.", "D e f. G h i. J."]
    assert [r.token_count for r in rows] == [6, 9, 7]


def brute_sentences(text, size, overlap):
    done, opened = [], []
    count = lambda s: len(s.split())
    total = 0
    for s in [x.strip() for x in re.split(r"(?<=[.!?])\s+", text) if x.strip()]:
        if count(s) > size:
            if opened:
                done.append(" ".join(opened))
            done += brute_windows(s, size, overlap)
            opened, total = [], 0
        elif total + count(s) <= size:
            opened.append(s)
            total += count(s)
        else:
            done.append(" ".join(opened))
            opened = opened[-2:] + [s]
            total = sum(map(count, opened))
    return done + ([" ".join(opened)] if opened else [])


@pytest.mark.parametrize("size,overlap", [(3, 1), (6, 2), (10, 3)])
def test_sentence_packing_against_brute_force(spark, size, overlap):
    texts = [
        "One two three. Four! Five six? Seven eight nine ten eleven twelve thirteen. End.",
        "A. B. C. D. E. F. G. H. I. J. K. L.",
        "No stop at all in this text which is rather long indeed",
        "",
        "Long one that has far too many words to fit. Short. Tiny. Another long one with many more words inside it. X.",
    ]
    rows = ck.sentence_chunks(docs(spark, *texts), size, overlap).collect()
    for i, text in enumerate(texts):
        mine = sorted((r for r in rows if r.doc_id == str(i)), key=lambda r: r.chunk_index)
        assert [r.text for r in mine] == brute_sentences(text, size, overlap)
        assert [r.chunk_index for r in mine] == list(range(len(mine)))


def test_reassembly_in_segments(spark):
    text = " ".join(f"w{i}" for i in range(100))
    chunks = ck.token_chunks(docs(spark, text), 10, 2)
    parts = ck.reassemble(chunks, segment_chunks=4).orderBy("segment").collect()
    assert [p.chunks for p in parts] == [4, 4, 4, 1]
    whole = ck.reassemble(chunks).collect()[0].text
    assert "\n\n".join(p.text for p in parts) == whole


@pytest.mark.parametrize("cap", [1, 7, 50, 10_000])
def test_capped_reassembly_is_a_prefix(spark, cap):
    chunks = ck.token_chunks(docs(spark, "abc def ghi jkl mno pqr stu " * 20, "x"), 4, 1)
    whole = {r.doc_id: r.text for r in ck.reassemble(chunks).collect()}
    capped = {r.doc_id: r.text for r in ck.reassemble(chunks, max_chars=cap).collect()}
    assert capped == {k: v[:cap] for k, v in whole.items()}


def test_sample_is_repeatable_and_moves_with_the_seed(spark):
    chunks = ck.token_chunks(docs(spark, *[f"text {i}" for i in range(200)]))
    one = [r.chunk_id for r in ck.sample_documents(chunks, 20, "a").collect()]
    assert one == [r.chunk_id for r in ck.sample_documents(chunks.repartition(3), 20, "a").collect()]
    assert one != [r.chunk_id for r in ck.sample_documents(chunks, 20, "b").collect()]


def test_numbered_context(spark):
    rows = docs(spark, "alpha", "beta", "gamma")
    made = ck.numbered_context(rows, ["doc_id"], 2, doc_chars=3).collect()[0]
    assert made.context == "[Document 1]\nalp\n\n---\n\n[Document 2]\nbet"
    assert made.documents == 2


def test_entities_are_distinct_sorted_and_limited(spark, column):
    text = "b@x.org a@x.org b@x.org on 2024-01-15 and 01/15/2024 for $1,200.50 and $7 " + " ".join(
        f"u{i:02d}@y.org" for i in range(20)
    )
    emails, = column([text], lambda c: tx.find_entities(c, "emails", limit=10))
    assert len(column([text], lambda c: tx.find_entities(c, "emails"))[0]) > 10
    assert emails[:2] == ["a@x.org", "b@x.org"] and len(emails) == 10
    assert column([text], lambda c: tx.find_entities(c, "dates")) == [["01/15/2024", "2024-01-15"]]
    assert column([text], lambda c: tx.find_entities(c, "amounts")) == [["$1,200.50", "$7"]]
    assert column(["nothing"], lambda c: tx.find_entities(c, "emails")) == [None]


def test_labelled_patterns(column):
    page = "# Grand Hotel with a name that is much longer than fifty characters in all\n⭐⭐ 8.7/10 (1234 reviews)\nestablishment on March 3, 1999"
    rules = {
        r"(?m)^# (.*)$": "Grand Hotel with a name that is much longer than f",
        r"⭐+.*?(\d+\.\d+)/10": "8.7",
        r"\((\d+)\s*reviews\)": "1234",
        r"establishment on (\w+ \d+, \d{4})": "March 3, 1999",
        r"missing (\d+)": None,
    }
    for rule, want in rules.items():
        assert column([page], lambda c, r=rule: tx.first_match(c, r, max_chars=50)) == [want]


def test_redaction(column):
    got = column(["SSN 123-45-6789 card 1234567812345678."], tx.redact)
    assert got == ["SSN [SSN] card [CARD]."]


def test_token_count_of_null_and_blank(column):
    assert column([None, "", " a  b\n"], tx.token_count) == [0, 0, 2]


def test_chunk_plan_has_no_shuffle_and_reads_two_columns(spark, sf_dir, capsys):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    ck.token_chunks(rows).explain()
    plan = capsys.readouterr().out
    assert "Exchange" not in plan
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


def test_custom_tokenizer(spark):
    letters = ck.token_chunks(docs(spark, "abcdef"), 4, 2, tokenizer=lambda c: F.split(c, ""))
    assert [r.text for r in letters.orderBy("chunk_index").collect()] == ["abcd", "cdef", "ef"]
