"""Batch model calls: a text-to-text function over a table of prompts."""

from __future__ import annotations

import json
import re
import threading
import time
from collections.abc import Callable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusql.functions.text import LABEL_LINE
from corpusql.session import materialize, shared_dir
from corpusql.sources.tables import read_if_present

Complete = Callable[[str], str]

RESPONSE_FIELDS = (
    "content string, model string, prompt_tokens bigint, completion_tokens bigint, "
    "total_tokens bigint, latency_ms double, error string"
)
MAX_TRIES, FIRST_DELAY = 3, 1.0
PROMPT_CHUNKS = 10
SLICES = 16
LONGEST_HEAD, KNOWN_HEADS = 4096, 64
LABEL_LINES = re.compile(f"(?m){LABEL_LINE}")


class RateLimited(Exception):
    """Raised by a completion function that should be tried again later."""


def _token_count(text: str) -> int:
    return len(text.split())


class Pace:
    """When the calls of one task may start: ``interval`` seconds apart, and none while a rate error is waited out."""

    def __init__(self, interval: float = 0.0) -> None:
        self.interval, self.next, self.lock = interval, 0.0, threading.Lock()

    def wait(self) -> None:
        """Take a moment once it has come. While it is not there nobody holds it, so a pause moves all who wait."""
        while True:
            with self.lock:
                left = self.next - time.monotonic()
                if left <= 0:
                    self.next = time.monotonic() + self.interval
                    return
            time.sleep(left)

    def pause(self, seconds: float) -> None:
        with self.lock:
            self.next = max(self.next, time.monotonic() + seconds)


def _call(complete: Complete, prompt: str, model: str, tries: int, delay: float, pace: Pace) -> tuple:
    started, error = time.monotonic(), None
    for attempt in range(tries):
        pace.wait()
        try:
            content = complete(prompt)
            used = _token_count(prompt), _token_count(content)
            ms = (time.monotonic() - started) * 1000
            return content, model, *used, sum(used), ms, None
        except RateLimited as problem:
            error = str(problem)
            if attempt + 1 < tries:
                pace.pause(delay * 2**attempt)
        except Exception as problem:
            error = str(problem)
            break
    return "", model, 0, 0, 0, (time.monotonic() - started) * 1000, error or "failed"


def batch_complete(
    prompts: DataFrame,
    complete: Complete,
    model: str = "rules",
    prompt_col: str = "prompt",
    keep: Sequence[str] = ("prompt_id",),
    tries: int = MAX_TRIES,
    first_delay: float = FIRST_DELAY,
    at_once: int = 1,
    per_second: float | None = None,
) -> DataFrame:
    """One reply per prompt row. A prompt that fails keeps its row, with the error.

    Rate errors are tried again after 1, 2, ... times ``first_delay``; others are
    not. Prompts stream through Arrow batches; nothing is held across batches.

    ``at_once`` calls of a task run side by side (``complete`` must then be safe to call from threads): a provider is
    waited for, not computed on. ``per_second`` bounds the calls a task starts, and a rate error holds back all calls of
    the task, not only its own, so a provider that is busy is not asked ``at_once`` times more. The whole job starts at most
    ``per_second`` times the number of tasks that run.
    """
    if at_once < 1 or (per_second is not None and per_second <= 0):
        raise ValueError("at_once is 1 or more, per_second above 0")
    keep = list(keep)
    kept = [prompts.schema[c] for c in keep]
    answer = T.StructType.fromDDL(RESPONSE_FIELDS)
    schema, kinds = T.StructType(kept + answer.fields), to_arrow_schema(answer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pace = Pace(1 / per_second if per_second else 0.0)

        def one(prompt: str) -> tuple:
            return _call(complete, prompt, model, tries, first_delay, pace)

        with ThreadPoolExecutor(at_once) as pool:
            ask = map if at_once == 1 else pool.map
            for batch in batches:
                if not batch.num_rows:
                    continue
                replies = zip(*ask(one, batch.column(len(keep)).to_pylist()))
                columns = [pa.array(values, field.type) for values, field in zip(replies, kinds)]
                # Kept columns pass as they are.
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], *columns], names=schema.names)

    return prompts.select(*keep, prompt_col).mapInArrow(run, schema)


def complete_stored(
    prompts: DataFrame,
    complete: Complete,
    path: str,
    model: str = "rules",
    prompt_col: str = "prompt",
    id_col: str = "prompt_id",
    slices: int = SLICES,
    **options: float,
) -> DataFrame:
    """``batch_complete`` whose replies stay at ``path``: what was answered once is not asked again.

    Prompts without a stored reply are dealt to ``slices`` by hash, and each slice's replies are appended when all of it
    is answered. A run that stops, or loses executors, repeats calls of one slice at most; the next run asks for
    what is missing and for what failed. A reply belongs to an id, a prompt and a model: a changed prompt is asked again.
    Ids must not be null, and each stands for one prompt.

    Returns (id, prompt_hash, reply columns, run) of these prompts, failures of this run included.
    """
    spark = prompts.sparkSession
    hashed = F.sha2(F.coalesce(F.col(prompt_col), F.lit("")), 256)
    keyed = prompts.select(id_col, F.col(prompt_col).alias("prompt"), hashed.alias("prompt_hash"))
    keys, replies = [id_col, "prompt_hash"], f"{path}/replies"
    stored, run = read_if_present(spark, replies), 0
    missing = keyed
    if stored is not None:
        run = stored.agg(F.max("run")).first()[0] + 1
        answered = stored.filter(F.col("error").isNull() & (F.col("model") == model))
        missing = keyed.join(answered.select(*keys), keys, "left_anti")
    place = shared_dir(spark, "prompts")
    part = F.pmod(F.xxhash64(*keys), F.lit(slices)).cast("int")
    missing.withColumn("slice", part).write.partitionBy("slice").parquet(place)
    waiting = read_if_present(spark, place)
    for row in waiting.select("slice").distinct().orderBy("slice").collect() if waiting is not None else ():
        asked = waiting.filter(F.col("slice") == row.slice)
        made = batch_complete(asked, complete, model, "prompt", keys, **options)
        made.withColumn("run", F.lit(run)).write.mode("append").parquet(replies)
    found = read_if_present(spark, replies)
    if found is None:
        empty = batch_complete(keyed.limit(0), complete, model, "prompt", keys)
        return empty.withColumn("run", F.lit(run))
    valid = found.filter((F.col("model") == model) & (F.col("error").isNull() | (F.col("run") == run)))
    return valid.join(keyed.select(*keys), keys, "left_semi")


def extraction_prompt(entity: str, attributes: Sequence[str], text: Column) -> Column:
    """Prompt whose layout the rule-based default understands."""
    head = f"Entity: {entity}\nAttributes: {', '.join(attributes)}\nDocument:\n"
    return F.concat(F.lit(head), text)


_WANTED: dict[str, list[str]] = {}


def _wanted(head: str) -> list[str]:
    """The attributes a prompt asks for; a few short heads are remembered."""
    wanted = _WANTED.get(head)
    if wanted is None:
        names = re.search(r"^Attributes: (.*)$", head, re.M)
        wanted = [n.strip() for n in names.group(1).split(",")] if names else []
        if len(head) <= LONGEST_HEAD and len(_WANTED) < KNOWN_HEADS:
            _WANTED[head] = wanted
    return wanted


def rule_based_extractor(prompt: str) -> str:
    """Default completion function: reads ``Label: value`` lines.

    A value is taken for an attribute when its label, in lower case with
    underscores, is the attribute's name. A label that comes again starts the next
    entity. Confidence is the share found.
    """
    head, _, body = prompt.partition("\nDocument:\n")
    wanted = _wanted(head)
    found: list[dict[str, str]] = []
    for line in LABEL_LINES.findall(body):
        label, _, value = line.partition(":")
        name = label.strip().lower().replace(" ", "_")
        if name not in wanted:
            continue
        if not found or name in found[-1]:
            found.append({})
        found[-1][name] = value.strip()
    first_line = body.strip().split("\n", 1)[0]
    entities = [
        {
            "attributes": {name: one.get(name) for name in wanted},
            "confidence": round(len(one) / len(wanted), 4),
            "source_text": first_line,
        }
        for one in found
    ]
    return json.dumps({"entities": entities})


def model_usage(responses: DataFrame, keys: Sequence[str] = ("stage", "model")) -> DataFrame:
    failed = F.col("error").isNotNull()
    return responses.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("calls"),
        F.count_if(failed).alias("errors"),
        F.sum("prompt_tokens").alias("prompt_tokens"),
        F.sum("completion_tokens").alias("completion_tokens"),
        F.sum("total_tokens").alias("total_tokens"),
        F.avg("latency_ms").alias("avg_latency_ms"),
    )


def batch_prompts(
    chunks: DataFrame,
    per_prompt: int = PROMPT_CHUNKS,
    doc_col: str = "doc_id",
    index_col: str = "chunk_index",
    text_col: str = "text",
) -> DataFrame:
    """Up to ``per_prompt`` consecutive chunks of a document in one prompt."""
    number = F.floor(F.col(index_col) / per_prompt).alias("prompt_index")
    gathered = chunks.groupBy(doc_col, number).agg(
        F.array_sort(
            F.collect_list(F.struct(F.col(index_col).alias("i"), F.col(text_col).alias("t")))
        ).alias("parts")
    )
    return gathered.select(
        doc_col,
        "prompt_index",
        F.size("parts").alias("chunks"),
        F.array_join(F.transform("parts", lambda p: p["t"]), "\n\n").alias("prompt"),
    )


def complete_distinct(
    rows: DataFrame,
    complete: Complete,
    text_col: str = "text",
    keep: Sequence[str] = ("chunk_id",),
    model: str = "rules",
) -> DataFrame:
    """Call the model once per distinct text and give the reply to every copy.

    Distinct texts are found by hash, so only one copy of a text that fills the
    corpus is ever sent. Replies are written to the shared folder: a repeated
    stage must not call the model again.
    """
    keyed = rows.withColumn("text_hash", F.sha2(text_col, 256))
    once = keyed.groupBy("text_hash").agg(F.first(text_col).alias(text_col))
    replies = materialize(
        batch_complete(once, complete, model, text_col, ["text_hash"]), "replies"
    )
    return keyed.select(*keep, "text_hash").join(replies, "text_hash", "inner")
