import io
import os

import pytest
from pyspark.sql import functions as F

from corpusql.catalog import source_queries
from corpusql.sources import files as fs
from corpusql.sources import listing, sinks

NAMES = [
    "a.txt", "b c.txt", "é%20+.txt", "deep/er/d.txt", "deep/x=1/e.json", "_hidden/f.txt", ".dot/g.txt", "_k=1/h.txt", "_metadata/i.txt",
    "_j.txt", ".k.txt", "_l=2.txt", "m.txt._COPYING_", "_metadata", "n.TXT", "noext", "o.csv", "dir.csv/p", "deep/q.md",
]


@pytest.fixture
def odd(tmp_path):
    for number, name in enumerate(NAMES):
        at = tmp_path / "in" / (f"{name}.file" if name == "_metadata" else name)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"text {number}\n")
        os.utime(at, ns=(10**18 + number * 1_234_567_891,) * 2)
    (tmp_path / "in" / "empty.txt").write_text("")
    (tmp_path / "in" / "deep" / "none").mkdir()
    (tmp_path / "in" / "gone.txt").symlink_to(tmp_path / "nothing")
    (tmp_path / "in" / "link.txt").symlink_to(tmp_path / "in" / "a.txt")
    return str(tmp_path / "in")


def spark_files(spark, path):
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)


def plain(df, *columns):
    return sorted(map(tuple, df.select("path", "modificationTime", "length", *columns).collect()))


@pytest.mark.parametrize("entries", [50_000, 3, 1])
def test_a_listing_has_the_files_spark_sees(spark, odd, monkeypatch, entries):
    """The same rows, in one round and in many."""
    monkeypatch.setattr(listing, "ENTRIES_IN_A_TASK", entries)
    for path in (odd, f"file://{odd}", f"{odd}/deep", f"{odd}/a.txt", f"{odd}/d*"):
        found = listing.list_files(spark, path)
        assert found.store and plain(found.rows) == plain(spark_files(spark, path)), path


def test_whole_files_are_those_spark_reads(spark, odd):
    found = listing.read_whole(listing.list_files(spark, odd), ["txt"], 1 << 30)
    files = spark_files(spark, odd).filter("lower(path) LIKE '%.txt'")
    assert plain(found, "content") == plain(files, "content") and found.dtypes == files.dtypes


def test_a_path_that_is_not_there_is_an_error(spark, tmp_path):
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        listing.list_files(spark, f"{tmp_path}/none")


def test_a_store_only_spark_reads(spark, odd, monkeypatch):
    """Rows are the same where Spark has to list."""
    (lambda p: open(p, "w").write("a,b\n1,x\n2,y\n"))(f"{odd}/more.csv")

    def made():
        texts = fs.text_documents(fs.read_files(spark, odd, "Text")).select("file_path", "text")
        tables = fs.csv_documents(spark, odd).select("file_path", "text")
        return sorted(map(tuple, fs.corpus_scan(spark, odd).collect())), sorted(map(tuple, texts.union(tables).collect()))

    own = made()
    monkeypatch.setattr(listing, "_roots", lambda *_: None)
    assert listing.list_files(spark, odd).store is None and made() == own


TEXTS = [b"", b"\n", b"\n\n\n", b"one", b"one\n", b"one\ntwo", b"\n\none\n\ntwo\n", b"a\r\nb\r\n", b"x" * 40 + b"\n" + b"y" * 3, b"\xef\xbb\xbfa\nb", b"\xef\xbb\xbf", b"ab\n" * 9]


@pytest.mark.parametrize("chunk", [1, 3, 4 << 20])
def test_each_line_is_in_one_block(monkeypatch, chunk):
    monkeypatch.setattr(listing, "READ_BYTES", chunk)
    for text in TEXTS:
        plain_text = text.removeprefix(b"\xef\xbb\xbf")
        want = plain_text.split(b"\n")[: -1 if not plain_text or plain_text.endswith(b"\n") else None]
        for block in range(1, len(text) + 2):
            got = [line for at in range(0, len(text), block) for line in listing.block_lines(io.BytesIO(text), at, min(at + block, len(text)))]
            assert got == want, (text, block)


@pytest.mark.parametrize("block", [None, 7])
def test_lines_are_those_spark_reads(spark, tmp_path, block):
    for number, text in enumerate([*TEXTS, b"ok\n\xff\xfe\nno", "é ü\nç".encode() * 9]):
        (tmp_path / f"{number}.txt").write_bytes(text)
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block) if block else keep)
    try:
        files = listing.list_files(spark, str(tmp_path))
        got = listing.read_lines(files, ["txt"])
        want = listing.read_lines(files._replace(store=None), ["txt"])
        name = F.regexp_extract("location", r"[^/]*\z", 0)
        rows = [sorted(map(str, f.select(name, "text").collect())) for f in (got, want)]
        few = got.filter("location LIKE '%/5.txt'").select("location").distinct()
        only = listing.read_lines(files, ["txt"], only=few).select("block", "text").collect()
        longer = listing.read_lines(files, ["txt"], larger_than=20).select("location").distinct().count()
        assert rows[0] == rows[1]
        assert sorted(only) == sorted(got.filter("location LIKE '%/5.txt'").select("block", "text").collect()) and len(only) == 2
        assert longer == 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", keep)


@pytest.fixture
def many(tmp_path):
    """Files of three kinds, 150 of each."""
    for number in range(150):
        for ext, text in (("txt", f"text {number}"), ("json", f'{{"a": {number}}}'), ("csv", f"a,b\n{number},x\n")):
            (tmp_path / ext / str(number % 5)).mkdir(parents=True, exist_ok=True)
            (tmp_path / ext / str(number % 5) / f"{number}.{ext}").write_text(text)
    return str(tmp_path)


def held(df):
    """Files whose names the driver keeps for a frame."""
    return sum(name.endswith((".txt", ".json", ".csv")) for name in df.inputFiles())


@pytest.fixture
def parsed(monkeypatch):
    """The frames that ingest runs parse."""
    frames, parse = [], sinks.parse_corpus
    monkeypatch.setattr(sinks, "parse_corpus", lambda *args: frames.append(parse(*args)) or frames[-1])
    return frames


def test_the_driver_does_not_keep_the_names_of_a_second_ingest(spark, many, tmp_path_factory, parsed):
    out = str(tmp_path_factory.mktemp("out"))
    sinks.ingest(spark, many, out)
    again = sinks.ingest(spark, many, out).collect()[0]
    assert (again.files_processed, again.files_skipped, again.total_files) == (0, 450, 450)
    assert [held(f) for f in parsed] == [0, 0]


def test_the_driver_does_not_keep_the_names_of_an_ingest(spark, many, tmp_path_factory, parsed):
    summary = sinks.ingest(spark, many, str(tmp_path_factory.mktemp("out"))).collect()[0]
    assert (summary.files_processed, summary.files_failed, summary.total_chunks) == (450, 0, 450)
    assert [held(f) for f in parsed] == [0]


def test_the_driver_does_not_keep_the_names_of_a_scan(spark, many):
    scan = fs.corpus_scan(spark, many)
    assert held(scan) == 0 and scan.count() == 450


def test_the_driver_does_not_keep_the_names_of_texts(spark, many):
    texts = fs.text_documents(fs.read_files(spark, f"{many}/txt", "Text"))
    assert held(texts) == 0 and sorted(r.text for r in texts.collect()) == sorted(f"text {i}" for i in range(150))


def test_the_driver_does_not_keep_the_names_of_file_metadata(spark, sf_dir):
    rows = source_queries.file_metadata(spark, sf_dir)
    assert held(rows) == 0 and rows.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
