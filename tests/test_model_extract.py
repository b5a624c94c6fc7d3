import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from corpusql.operators import extract as ex
from corpusql.operators import model
from corpusql.operators.model import RateLimited


def prompts(spark, *texts):
    return spark.createDataFrame([(str(i), t) for i, t in enumerate(texts)], "prompt_id string, prompt string")


def test_replies_errors_and_retries(spark, tmp_path):
    folder = str(tmp_path)

    def complete(prompt):
        with open(f"{folder}/{prompt}", "a") as log:
            log.write("x")
        with open(f"{folder}/{prompt}") as log:
            tries = len(log.read())
        if prompt == "busy" and tries < 3:
            raise RateLimited("slow down")
        if prompt == "never":
            raise RateLimited("slow down")
        if prompt == "bad":
            raise ValueError("no")
        return prompt.upper() + " ok"

    rows = model.batch_complete(prompts(spark, "fine", "busy", "never", "bad"), complete, first_delay=0.01).collect()
    got = {r.prompt_id: r for r in rows}
    assert got["0"].content == "FINE ok" and got["0"].error is None
    assert (got["0"].prompt_tokens, got["0"].completion_tokens, got["0"].total_tokens) == (1, 2, 3)
    assert got["1"].content == "BUSY ok"
    assert got["2"].error == "slow down" and got["2"].content == ""
    assert got["3"].error == "no"
    assert {n: len((tmp_path / n).read_text()) for n in ("fine", "busy", "never", "bad")} == {"fine": 1, "busy": 3, "never": 3, "bad": 1}


def test_calls_side_by_side_keep_their_rows(spark):
    def complete(prompt):
        time.sleep(0.2)
        return prompt + "!"

    rows = prompts(spark, *[f"p{i}" for i in range(20)]).coalesce(1)
    model.batch_complete(rows, complete, at_once=10).count()
    started = time.monotonic()
    got = {r.prompt_id: r.content for r in model.batch_complete(rows, complete, at_once=10).collect()}
    assert got == {str(i): f"p{i}!" for i in range(20)} and time.monotonic() - started < 3
    with pytest.raises(ValueError):
        model.batch_complete(rows, complete, at_once=0)


def test_pace_spaces_calls_and_a_pause_holds_all():
    pace, moments = model.Pace(0.05), []

    def call():
        pace.wait()
        moments.append(time.monotonic())

    threads = [threading.Thread(target=call) for _ in range(6)]
    started = time.monotonic()
    for t in threads:
        t.start()
    time.sleep(0.02)
    pace.pause(0.4)
    for t in threads:
        t.join()
    moments.sort()
    assert all(b - a > 0.045 for a, b in zip(moments, moments[1:]))
    assert sum(m - started < 0.4 for m in moments) == 1


def test_stored_replies_are_not_asked_again(spark, tmp_path):
    log, path = tmp_path / "calls", str(tmp_path / "stored")

    def complete(prompt):
        with open(str(log), "a") as out:
            out.write(prompt + "\n")
        if prompt == "bad" or prompt == "stop":
            raise ValueError("no")
        return prompt + "!"

    def run(*texts, **more):
        log.write_text("")
        rows = model.complete_stored(prompts(spark, *texts), complete, path, slices=3, **more).collect()
        return {r.prompt_id: (r.content, r.error) for r in rows}, sorted(log.read_text().split())

    assert run() == ({}, [])
    first = {"0": ("a!", None), "1": ("b!", None), "2": ("", "no")}
    assert run("a", "b", "bad") == (first, ["a", "b", "bad"])
    assert run("a", "b", "bad") == (first, ["bad"])
    # A changed prompt and a new one; other models have replies of their own.
    assert run("a", "c", "bad", None, at_once=2)[1] == ["bad", "c"]
    assert run("a", "b", model="other") == ({"0": ("a!", None), "1": ("b!", None)}, ["a", "b"])
    assert run("a", "b") == ({"0": ("a!", None), "1": ("b!", None)}, [])


def test_usage(spark):
    rows = spark.createDataFrame(
        [("s", "m", 1, 2, 3, 10.0, None), ("s", "m", 4, 5, 9, 30.0, None), ("t", "m", 0, 0, 0, 5.0, "x")],
        "stage string, model string, prompt_tokens long, completion_tokens long, total_tokens long, latency_ms double, error string",
    )
    got = {r.stage: r for r in model.model_usage(rows).collect()}
    assert (got["s"].calls, got["s"].errors, got["s"].total_tokens, got["s"].avg_latency_ms) == (2, 0, 12, 20.0)
    assert got["t"].errors == 1


def test_one_call_per_distinct_text(spark, tmp_path):
    log = str(tmp_path / "calls")

    def complete(prompt):
        with open(log, "a") as out:
            out.write(prompt + "\n")
        return prompt + "!"

    rows = spark.createDataFrame([(f"c{i}", "same" if i % 3 else f"t{i}") for i in range(30)], "chunk_id string, text string")
    got = {r.chunk_id: r.content for r in model.complete_distinct(rows, complete).collect()}
    assert len(got) == 30 and got["c1"] == "same!" and got["c0"] == "t0!"
    assert sorted((tmp_path / "calls").read_text().split()) == sorted({"same"} | {f"t{i}" for i in range(0, 30, 3)})


def test_batches_of_chunks(spark):
    rows = spark.createDataFrame([("d", i, f"t{i}") for i in range(25)], "doc_id string, chunk_index int, text string")
    got = model.batch_prompts(rows).orderBy("prompt_index").collect()
    assert [r.chunks for r in got] == [10, 10, 5]
    assert got[2].prompt == "\n\n".join(f"t{i}" for i in range(20, 25))


CALL = "Company: Acme Corp\nDeal Value: $50,000\nStatus: Negotiation\nClose Date: January 15, 2024\nNotes: nice"
TYPES = {"company": "TEXT", "deal_value": "REAL", "close_date": "DATE"}


def test_rule_based_extractor():
    prompt = f"Entity: Deal\nAttributes: company, deal_value, missing\nDocument:\n{CALL}"
    entity = json.loads(model.rule_based_extractor(prompt))["entities"][0]
    assert entity["attributes"] == {"company": "Acme Corp", "deal_value": "$50,000", "missing": None}
    assert entity["confidence"] == 0.6667
    assert json.loads(model.rule_based_extractor("Document:\n"))["entities"] == []


def test_corpus_to_typed_rows(spark):
    docs = spark.createDataFrame([("a", CALL), ("b", "nothing here"), ("c", CALL.replace("$50,000", "lots"))], "doc_id string, text string")
    found, rejects, usage = ex.extract_corpus(docs, {"Deal": TYPES, "Firm": {"company": "TEXT"}}, model.rule_based_extractor)
    deals = found.filter(F.col("entity") == "Deal")
    good, bad = ex.conform(deals, "Deal", [{"name": n, "type": t} for n, t in TYPES.items()])
    row, = good.collect()
    assert (row.company, row.deal_value, row.close_date, row.doc_id) == ("Acme Corp", 50000.0, "2024-01-15", "a")
    assert len(row.deal_id) == 16
    assert [(r.doc_id, r.reason) for r in bad.collect()] == [("c", "deal_value: not REAL")]
    assert rejects.count() == 0 and usage.count() == 6
    assert found.filter(F.col("entity") == "Firm").count() == 2
    again, _ = ex.conform(deals, "Deal", [{"name": n, "type": t} for n, t in TYPES.items()])
    assert again.collect()[0].deal_id == row.deal_id


def test_failed_calls_and_bad_replies_are_rejects(spark):
    def complete(prompt):
        if "boom" in prompt:
            raise RuntimeError("boom")
        return "I cannot" if "odd" in prompt else '{"entities":[{"attributes":{"a":"1"},"confidence":0.6}]}'

    docs = spark.createDataFrame([("a", "boom"), ("b", "odd"), ("c", "fine")], "doc_id string, text string")
    found, rejects, _ = ex.extract_corpus(docs, {"E": {"a": "TEXT"}}, complete)
    assert found.count() == 0
    assert {(r.doc_id, r.reason) for r in rejects.collect()} == {("a", "boom"), ("b", "not JSON")}


def test_missing_required_and_own_key(spark):
    rows = spark.createDataFrame(
        [("d", 0, {"deal_id": "k1", "v": "1"}, 0.9, None), ("d", 1, {"deal_id": None, "v": None}, 0.9, None)],
        "doc_id string, ordinal int, attributes map<string,string>, confidence double, source_text string",
    )
    attributes = [
        {"name": "deal_id", "type": "TEXT", "is_primary_key": True, "is_nullable": False}, {"name": "v", "type": "INTEGER", "is_nullable": False},
    ]
    good, bad = ex.conform(rows, "Deal", attributes)
    assert [(r.deal_id, r.v) for r in good.collect()] == [("k1", 1)]
    assert [r.reason for r in bad.collect()] == ["v: missing"]


def test_undeclared_keys_stay_as_text(spark):
    rows = spark.createDataFrame([("d", {"v": "5M", "x": " '  a  b' "})], "doc_id string, attributes map<string,string>")
    row, = ex.standardize_attributes(rows, {"v": "INTEGER"}).collect()
    assert row.v == 5000000 and row.other_attributes == {"x": " a b"}


@pytest.mark.parametrize("confidence,kept", [(0.69, 0), (0.7, 1), (None, 0)])
def test_confidence_bound(spark, confidence, kept):
    body = {"attributes": {"a": "1"}}
    if confidence is not None:
        body["confidence"] = confidence
    rows = spark.createDataFrame([("d", json.dumps({"entities": [body]}))], "doc_id string, content string")
    assert ex.explode_entities(ex.parse_replies(rows)).count() == kept


def test_a_label_that_comes_again_starts_an_entity():
    prompt = "Entity: D\nAttributes: company, größe\nDocument:\nCompany: A\nGröße: 1\nCompany: B\nother: x"
    made = json.loads(model.rule_based_extractor(prompt))["entities"]
    assert [e["attributes"] for e in made] == [{"company": "A", "größe": "1"}, {"company": "B", "größe": None}]
