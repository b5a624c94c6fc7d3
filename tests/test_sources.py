import json

import pytest
from pyspark.sql import functions as F

from corpusql.catalog import source_queries
from corpusql.session import load, many_files
from corpusql.sources import files as fs
from corpusql.sources import sinks, tables

CALL = """Sales Call Notes
Company: Acme Corp
Contact: Jo Doe
Deal Value: $50,000
Status: Negotiation
Close Date: 2024-01-15
"""


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "deep").mkdir()
    (tmp_path / "two.txt").write_text("This is a test document.\nWith multiple lines.")
    (tmp_path / "deep" / "CALL.MD").write_text(CALL)
    (tmp_path / "long.markdown").write_text("# Title")
    (tmp_path / "people.csv").write_text("name,age,city\nAlice,30,NYC\nBob,25,SF\n")
    (tmp_path / "many.tsv").write_text("a\tb\n" + "".join(f"{i}\tx{i}\n" for i in range(12)))
    (tmp_path / "good.json").write_text('{"b": 1, "a": [1, 2], "é": null}')
    (tmp_path / "bad.json").write_text("{not json")
    (tmp_path / "latin.txt").write_bytes("caf\xe9".encode("latin-1"))
    (tmp_path / "broken.csv").write_text("\n")
    (tmp_path / "scan.pdf").write_bytes(b"not really a pdf")
    (tmp_path / "photo.png").write_bytes(b"\x00\x01")
    (tmp_path / "noext").write_text("x")
    return str(tmp_path)


def by_name(df):
    return {r["filename"]: r for r in df.collect()}


def test_scan_lists_everything_and_picks_parsers(spark, folder):
    rows = by_name(fs.corpus_scan(spark, folder))
    assert len(rows) == 12
    assert rows["CALL.MD"].parser == "Text" and rows["CALL.MD"].source_type == "markdown"
    assert rows["many.tsv"].parser == "CSV" and rows["many.tsv"].source_type == "csv"
    assert rows["scan.pdf"].parser == "PDF"
    assert rows["photo.png"].parser is None and rows["photo.png"].source_type == "unknown"
    assert rows["noext"].extension == ""
    assert rows["two.txt"].file_size == 45
    assert all(len(r.doc_id) == 16 for r in rows.values())


def test_scan_does_not_open_files(spark, folder, capsys):
    fs.corpus_scan(spark, folder).explain()
    assert "content" not in capsys.readouterr().out


def test_text_documents(spark, folder):
    rows = by_name(fs.text_documents(fs.read_files(spark, folder, "Text")))
    assert rows["two.txt"].text.startswith("This is a test") and rows["two.txt"].line_count == 2
    assert rows["two.txt"].char_count == 45
    assert rows["long.markdown"].format == "md"
    assert "Acme Corp" in rows["CALL.MD"].text and "50,000" in rows["CALL.MD"].text
    assert rows["latin.txt"].text is None and "UTF-8" in rows["latin.txt"].error
    good = {"b": 1, "a": [1, 2], "é": None}
    assert rows["good.json"].text == json.dumps(good, indent=2) and rows["good.json"].warning is None
    assert rows["bad.json"].text == "{not json" and rows["bad.json"].warning


def test_csv_documents(spark, folder):
    rows = by_name(fs.csv_documents(spark, folder))
    people = rows["people.csv"]
    assert people.row_count == 2 and "Alice" in people.text
    assert people.text.splitlines()[:3] == ["CSV Data: people.csv", "Columns: name, age, city", "Rows: 2"]
    assert "Row 1: {'name': 'Alice', 'age': 30, 'city': 'NYC'}" in people.text
    assert json.loads(people.dtypes)["age"] == "int64"
    assert rows["many.tsv"].text.endswith("... (2 more rows)")
    assert rows["broken.csv"].text is None and rows["broken.csv"].error


def test_csv_as_a_table_gives_the_same_text(spark, folder):
    rows = tables.csv_rows(spark, f"{folder}/people.csv")
    made = tables.table_to_document(rows, "people.csv", tables.LINE_ORDER).collect()[0]
    same = by_name(fs.csv_documents(spark, folder))["people.csv"]
    assert made.text == same.text and made.row_count == 2 and made.column_count == 3


def test_profile(spark, folder):
    rows = tables.csv_rows(spark, f"{folder}/people.csv")
    made = tables.table_profile(rows, "people").orderBy("position").collect()
    assert [(r.column_name, r.dtype) for r in made] == [("name", "object"), ("age", "int64"), ("city", "object")]


def test_pages(spark):
    pages = spark.createDataFrame(
        [("d", 2, " two ", None), ("d", 1, "one", None), ("d", 3, "", "cannot read"), ("d", 4, "", None), ("e", 1, "", "x")],
        "doc_id string, page int, text string, error string",
    )
    rows = {r.doc_id: r for r in fs.page_assembly(pages).collect()}
    assert rows["d"].text == "one\n\n two " and rows["d"].page_count == 4
    assert (rows["d"].text_pages, rows["d"].failed_pages) == (2, 1)
    assert rows["e"].text == ""
    kept = {(r.doc_id, r.page): r.text for r in fs.page_rows(pages).collect()}
    assert kept == {("d", 1): "one", ("d", 2): "two", ("d", 3): "", ("e", 1): ""}


def test_metadata_merge(spark):
    row = spark.createDataFrame([(".TXT",)], "ext string")
    empty = F.create_map().cast("map<string,string>")
    fields = F.create_map(F.lit("ingested_at"), F.lit("then"), F.lit("file_name"), F.lit("a"))
    doc = F.create_map(F.lit("author"), F.lit("Jo"), F.lit("pages"), F.lit("3"))
    made = row.select(fs.merge_metadata(fields, doc, empty, F.col("ext"), F.lit("now")).alias("m")).collect()[0].m
    assert made.base == {"source_type": "text", "ingested_at": "then", "file_name": "a"}
    assert made.doc_metadata.author == "Jo" and made.doc_metadata.raw == {"author": "Jo", "pages": "3"}
    assert made.doc_metadata.title is None and made.custom is None


def test_ingest_counts_and_is_idempotent(spark, folder, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    first = sinks.ingest(spark, folder, out, 50, 10).collect()[0]
    assert first.total_files == 12
    assert first.files_processed == 7
    assert first.files_failed == 3
    assert first.parsers_used == "CSV=2,Text=5"
    assert first.total_chunks == spark.read.parquet(f"{out}/chunks").count()
    assert len(first.errors.splitlines()) == 3
    docs = spark.read.parquet(f"{out}/documents")
    counts = {r.filename: r.chunk_count for r in docs.collect()}
    assert len(counts) == 7 and counts["two.txt"] == 1
    chunk_rows = spark.read.parquet(f"{out}/chunks").count()
    sinks.ingest(spark, folder, out, 50, 10).collect()
    assert spark.read.parquet(f"{out}/documents").count() == 7
    assert spark.read.parquet(f"{out}/chunks").count() == chunk_rows


def test_new_files_are_added(spark, tmp_path, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("out"))
    (tmp_path / "a.txt").write_text("one")
    sinks.ingest(spark, str(tmp_path), out).collect()
    (tmp_path / "b.txt").write_text("two")
    summary = sinks.ingest(spark, str(tmp_path), out).collect()[0]
    assert summary.total_files == 2
    assert {r.filename for r in spark.read.parquet(f"{out}/documents").collect()} == {"a.txt", "b.txt"}


def test_chunk_counts_are_zero_without_chunks(spark):
    docs = spark.createDataFrame([("a",), ("b",)], "doc_id string")
    chunks = spark.createDataFrame([("a", "x"), ("a", "y")], "doc_id string, t string")
    got = {r.doc_id: r.chunk_count for r in sinks.chunk_counts(docs, chunks).collect()}
    assert got == {"a": 2, "b": 0}


def test_results_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([(1, 'a"b,c'), (2, None)], "k int, v string")
    for fmt in ("json", "csv"):
        path = str(tmp_path / fmt)
        sinks.write_result(rows, path, fmt)
        reader = spark.read.schema(rows.schema)
        back = reader.json(path) if fmt == "json" else reader.csv(path, header=True)
        assert sorted(back.collect()) == sorted(rows.collect())
    with pytest.raises(ValueError):
        sinks.write_result(rows, str(tmp_path / "x"), "xml")
    assert json.loads(sinks.rows_as_json(rows).collect()[0].row_json) == {"k": 1, "v": 'a"b,c'}


def test_jsonl(spark, tmp_path):
    (tmp_path / "c.jsonl").write_text('{"document_content": "a"}\n{"document_content": "b"}\n')
    rows = tables.jsonl_corpus(spark, str(tmp_path)).collect()
    assert sorted(r.text for r in rows) == ["a", "b"] and len({r.doc_id for r in rows}) == 2
    (tmp_path / "q").mkdir()
    (tmp_path / "q" / "q.jsonl").write_text('{"question": "How many?"}\n')
    assert tables.jsonl_questions(spark, str(tmp_path / "q")).collect()[0].question == "How many?"


def test_row_documents(spark):
    rows = spark.createDataFrame([(1, "text", 5)], "id int, body string, stars int")
    made = tables.row_documents(rows, "body", ["id"], "reviews").collect()[0]
    assert made.text == "text" and json.loads(made.metadata) == {"id": 1, "stars": 5}


def test_a_run_that_stopped_between_the_two_writes_is_repaired(spark, tmp_path, tmp_path_factory):
    out, half = (str(tmp_path_factory.mktemp(n)) for n in ("out", "half"))
    for i in range(5):
        (tmp_path / f"{i}.txt").write_text(f"text number {i} " * 30)
    sinks.ingest(spark, str(tmp_path), out, 20, 5).collect()
    spark.read.parquet(f"{out}/chunks").write.parquet(f"{half}/chunks")
    (tmp_path / "new.txt").write_text("more")
    sinks.ingest(spark, str(tmp_path), half, 20, 5).collect()
    assert spark.read.parquet(f"{half}/documents").count() == 6
    chunks = spark.read.parquet(f"{half}/chunks")
    assert chunks.count() == chunks.select("chunk_id").distinct().count()
    assert chunks.count() == spark.read.parquet(f"{out}/chunks").count() + 1


class Session:
    """Just what ``shared_dir`` asks of a session."""

    def __init__(self, named, master):
        settings = {"spark.checkpoint.dir": named} if named else {}
        self.conf = self
        self.sparkContext = self
        self.get = lambda key, default=None: settings.get(key, default)
        self.getConf = lambda: self
        self.master, self.applicationId = master, f"app-{named}-{master}"


def test_shared_folder_is_the_one_the_cluster_names():
    from corpusql.session import shared_dir

    assert shared_dir(Session("/shared/place/", "yarn"), "x").startswith("/shared/place/x-")
    assert shared_dir(Session("/shared/place", "local[2]"), "x").startswith("/shared/place/x-")
    local = Session(None, "local[2]")
    assert shared_dir(local, "x") != shared_dir(local, "x")
    with pytest.raises(ValueError):
        shared_dir(Session(None, "yarn"), "x")
    with pytest.raises(ValueError):
        shared_dir(Session(None, "local-cluster[2,1,1024]"), "x")


def test_session_defaults_do_not_override(spark):
    from corpusql.session import build_session

    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "77")
    try:
        assert build_session().conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "77"
        assert build_session().conf.get("spark.sql.session.timeZone") == "UTC"
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2000")


CSV_TEXTS = [
    "a,b\n1,2,3\n4,5,6\n", "a,b\n1\n2,3\n", "a,a,\n1,2,3\n", "a,b\n", "a,b", 'a,b\n1,"x\n y"\n2,"p""q\n\n,r"\n', "a,b\n \n1,2\n\n3,x\n",
    "a\nTrue\n\nFalse\n", "a,b\nTrue,\nFalse,x\n,y\n", "a,b\n1,inf\n2,1e5\n", "a,b\n1_0,+5\n 2 ,3\n", 'a,b\n"1","NA"\n', "\ufeffa,b\n1,2\n",
    "a,b\n1,2\n3,4,5\n", 'a,b\n1,"x', "\n", 'a,b\n1,5" x\n2,y"\n3,"z"\n', "a,b\r\n1,x\r\n2,y\r\n", 'n,t\n1,"a"\n2,"b" \n', "x\n" + "1.5\n" * 15,
    "a,b,c\n" + "".join(f'{i},"line {i}\nnext ""{i}""",{i / 4}\n' for i in range(60)), "a,b\nnull,1\nNone,2.5\n", "a,b\ntrue,1\n1,2\n",
]


def csv_by_pandas(name, content, sep):
    import io

    import pandas as pd

    try:
        table = pd.read_csv(io.BytesIO(content), delimiter=sep)
    except Exception:
        return None
    head = table.head(10).to_dict("records")
    lines = [f"CSV Data: {name}", "Columns: " + ", ".join(map(str, table.columns)), f"Rows: {len(table)}", "", "Data:"]
    lines += [f"Row {i}: {row}" for i, row in enumerate(head, 1)]
    lines += [f"... ({len(table) - len(head)} more rows)"] if len(table) > len(head) else []
    return "\n".join(lines), len(table), table.shape[1], table.dtypes.astype(str).to_dict()


@pytest.mark.parametrize("block", [None, 300, 40])
def test_csv_files_of_many_blocks(spark, tmp_path, block):
    """Records are the same however few bytes a task reads, and the same as by a reader of whole files."""
    want = {}
    for i, text in enumerate(CSV_TEXTS):
        for sep, ext in ((",", "csv"), ("\t", "TSV")):
            name, content = f"f {i}.{ext}", text.replace(",", sep).encode()
            (tmp_path / name).write_bytes(content)
            want[name] = csv_by_pandas(name, content, sep)
    (tmp_path / "latin.csv").write_bytes("a,b\nx,caf\xe9\n".encode("latin-1"))
    want["latin.csv"] = None
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    if block:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
        spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        got = by_name(fs.csv_documents(spark, str(tmp_path)))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
        spark.conf.unset("spark.sql.files.openCostInBytes")
    assert set(got) == set(want)
    for name, made in want.items():
        row = got[name]
        if made is None:
            assert row.text is None and row.error, name
        else:
            assert row.error is None and (row.text, row.row_count, row.column_count, json.loads(row.dtypes)) == made, name


LONG_TEXTS = [
    "one two three four five six seven", "a\n\n\n  b c  \n d\t\n", "\n\n x", "word\n", "  lead and trail  \n \n", "é ü\r\nç\n" * 9, "\n \n", "x" * 50,
    "".join(f"line {i} " + "w " * (i % 7) + ("\n" if i % 3 else "\n\n \n") for i in range(30)),
]


@pytest.mark.parametrize("block", [None, 150])
def test_long_texts_have_the_chunks_of_short_ones(spark, tmp_path, tmp_path_factory, block):
    """Read by lines over many tasks, files give the very rows of texts that are one value."""
    for i, text in enumerate(LONG_TEXTS):
        (tmp_path / f"t {i}.txt").write_bytes(text.encode())
    (tmp_path / "bad.md").write_bytes(b"ok\n\xff\xfe not text\n")
    (tmp_path / "t.csv").write_text("a\n1\n")
    keep = spark.conf.get("spark.sql.files.maxPartitionBytes")
    results = []
    for limit in (fs.MAX_FILE_BYTES, 3):
        out = str(tmp_path_factory.mktemp("out"))
        if block:
            spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
            spark.conf.set("spark.sql.files.openCostInBytes", "1")
        try:
            summary = sinks.ingest(spark, str(tmp_path), out, 5, 2, max_bytes=limit).collect()[0].asDict()
            again = sinks.ingest(spark, str(tmp_path), out, 5, 2, max_bytes=limit).collect()[0]
        finally:
            spark.conf.set("spark.sql.files.maxPartitionBytes", keep)
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert again.files_skipped == len(LONG_TEXTS) + 1 and again.total_chunks == 0
        rows = sorted(map(tuple, spark.read.parquet(f"{out}/chunks").collect()))
        docs = spark.read.parquet(f"{out}/documents").select("filename", "chunk_count")
        results.append((summary, rows, sorted(map(tuple, docs.collect()))))
    assert results[0] == results[1] and len(results[0][1]) > 60
    assert results[0][0]["files_failed"] == 1 and "bad.md" in results[0][0]["errors"]


def test_of_rows_with_one_id_the_same_one_stays(spark, tmp_path):
    rows = [("a", "x", 1), ("a", "y", None), ("b", "z", 2), (None, "n", 3), (None, "m", 4), ("c", None, None)] + [("hot", f"t{i % 50}", i) for i in range(300)]
    kept = set()
    for number in range(3):
        docs = spark.createDataFrame(rows[number:] + rows[:number], "doc_id string, text string, n int").repartition(number + 2)
        fresh = sinks.new_documents(docs, None).collect()
        assert sorted(str(r.doc_id) for r in fresh) == ["None", "a", "b", "c", "hot"]
        kept.add(tuple(sorted(map(str, fresh))))
    assert len(kept) == 1
    stored = spark.createDataFrame([("a", "other")], "doc_id string, text string")
    assert {r.doc_id for r in sinks.new_documents(docs, stored).collect()} == {None, "b", "c", "hot"}


def test_a_table_written_again_is_read_with_its_new_columns(spark, tmp_path):
    spark.range(3).write.parquet(f"{tmp_path}/t.parquet")
    assert load(spark, str(tmp_path), "t").columns == ["id"]
    spark.range(3).selectExpr("id", "id * 2 AS twice").write.mode("overwrite").parquet(f"{tmp_path}/t.parquet")
    assert load(spark, str(tmp_path), "t").columns == ["id", "twice"]


def test_one_file_per_row_is_written_by_its_task(spark, tmp_path, monkeypatch):
    """Each row is one file whose folder counts when it is complete; an attempt that comes second leaves no file twice."""
    monkeypatch.setattr(sinks, "FOLDER_FILES", 3)
    texts = [f"text {i}\nsecond line, ü" for i in range(20)] + [None, "", "text 0\nsecond line, ü"]
    rows = spark.createDataFrame([(t,) for t in texts], "text string").repartition(2)
    for _ in range(2):
        assert sinks.write_files(rows, F.col("text"), str(tmp_path / "notes"), "txt") == 23
    files = [p for p in (tmp_path / "notes").rglob("*.txt")]
    assert sorted(p.read_text() for p in files) == sorted((t or "") + "\n" for t in texts)
    assert max(len(list(p.parent.iterdir())) for p in files) == 3
    assert fs.corpus_scan(spark, str(tmp_path)).count() == 23
    assert fs.text_documents(fs.read_files(spark, str(tmp_path), "Text")).filter("error IS NULL").count() == 23


def test_corpus_files_are_not_written_one_by_one_by_the_spark_writer(spark, sf_dir, monkeypatch):
    made = []
    write = sinks.write_files
    monkeypatch.setattr(sinks, "write_files", lambda rows, *rest: made.append(write(rows, *rest)) or made[-1])
    monkeypatch.setattr(source_queries, "_FOLDERS", {})
    folder = source_queries.corpus_folder(spark, sf_dir)
    tables = [spark.read.parquet(f"{sf_dir}/{t}.parquet").count() for t in ("documents", "labels", "supplier")]
    assert made == tables
    got = {r.extension: r["count"] for r in fs.corpus_scan(spark, folder).groupBy("extension").count().collect()}
    assert [got["txt"], got["json"], got["csv"]] == tables


def test_many_small_files_share_tasks_during_a_parse(spark):
    key = "spark.sql.files.openCostInBytes"
    before = spark.conf.get(key)
    with many_files(spark):
        assert spark.conf.get(key) == str(64 << 10)
    assert spark.conf.get(key) == before
