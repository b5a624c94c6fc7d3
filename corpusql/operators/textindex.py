"""A stored inverted index over texts: appended in batches, ranked by BM25, read only where a question's words lie."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from corpusql.session import materialize
from corpusql.sources.tables import leave_out, read_if_present

WORD = r"[\p{L}\p{N}]+"
# Buckets are folders of the postings; a question opens the folders of its words.
BUCKETS = 64
# Neighbouring documents of a batch whose places of a word are one row; a power of two.
SEGMENT_DOCS = 4096
# Above this many different words in all questions the words are joined instead of named in the filter.
NAMED_WORDS = 2000
# (question, word) pairs that are sent to every task at once.
SENT_PAIRS = 500_000
K1, B = 1.2, 0.75
DECIMALS = 6


def words(text: Column) -> Column:
    """Runs of letters and digits in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


_PLACES = T.ArrayType(T.IntegerType())
SEGMENT_ROWS = T.StructType([
    T.StructField(name, kind) for name, kind in [
        ("id", T.StringType()), ("length", T.IntegerType()), ("place", T.IntegerType()), ("word", T.StringType()),
        ("documents", T.IntegerType()), ("occurrences", T.LongType()), ("places", _PLACES), ("times", _PLACES), ("segment", T.LongType()),
    ]
])


def _segments(batches: Iterator[pa.RecordBatch], segment_docs: int) -> Iterator[pa.RecordBatch]:
    """SEGMENT_ROWS of (id, words): a row for each document, and one for each word of a segment with all its places there.

    A task's documents are numbered as they come, with the task's number in the upper bits, so no segment spans two tasks.
    """
    from pyspark import TaskContext

    schema = to_arrow_schema(SEGMENT_ROWS)
    base, number = TaskContext.get().partitionId() << 33, 0
    held: list[pa.RecordBatch] = []

    def rows(count: int, **values: np.ndarray | pa.Array) -> pa.RecordBatch:
        columns = [pa.array(values[f.name]).cast(f.type) if f.name in values else pa.nulls(count, f.type) for f in schema]
        return pa.RecordBatch.from_arrays(columns, schema=schema)

    def segment() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held)
        own, n = (base + number - 1) // segment_docs, table.num_rows
        lists = pa.concat_arrays(table.column("words").chunks)
        length = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        yield rows(n, id=pa.concat_arrays(table.column("id").chunks), length=length, place=np.arange(n), segment=np.full(n, own))
        words_ = lists.flatten().dictionary_encode()
        # (word, place) as one number: sorted, with how often it is there.
        pairs = words_.indices.to_numpy().astype(np.int64) * n + np.repeat(np.arange(n), length)
        pairs, times = np.unique(pairs, return_counts=True)
        first = np.flatnonzero(np.diff(pairs // n, prepend=-1))
        ends = pa.array(np.append(first, len(pairs)), pa.int32())
        yield rows(
            len(first), word=words_.dictionary.take(pa.array(pairs[first] // n)), documents=np.diff(np.append(first, len(pairs))),
            occurrences=np.add.reduceat(times, first) if len(first) else times, segment=np.full(len(first), own),
            places=pa.ListArray.from_arrays(ends, pa.array(pairs % n, pa.int32())),
            times=pa.ListArray.from_arrays(ends, pa.array(times, pa.int32())),
        )

    for batch in batches:
        at = 0
        while at < batch.num_rows:
            held.append(batch.slice(at, segment_docs - number % segment_docs))
            at, number = at + held[-1].num_rows, number + held[-1].num_rows
            if number % segment_docs == 0:
                yield from segment()
                held.clear()
    if held:
        yield from segment()


def bucket(word: Column, buckets: int = BUCKETS) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(buckets)).cast("int")


def _batches(spark: SparkSession, path: str) -> DataFrame | None:
    return read_if_present(spark, f"{path}/batches")


def append(
    docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", buckets: int = BUCKETS, segment_docs: int = SEGMENT_DOCS
) -> int:
    """Add the documents whose id the index does not hold; returns how many that were.

    Null texts count as empty: such documents are known and count for the mean length, but hold no word. Of rows
    that share an id the one with the least text counts. Rows without an id are left out.

    Documents that lie next to each other are a segment. The places of a word in a segment are one row, so a word that every
    text holds is many rows and no large group, and each row is complete before anything is shuffled. A batch is written under its own number and counts once its last small file,
    ``batches``, is there: a run that stopped in between is overwritten by the next.
    """
    spark = docs.sparkSession
    done = _batches(spark, path)
    number = 0 if done is None else done.agg(F.max("batch")).first()[0] + 1
    stored = None if done is None else _committed(spark, path, "documents", number)
    given = docs.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    fresh = leave_out(given.filter("id IS NOT NULL"), stored, "id")
    if fresh.select("id").isEmpty():
        return 0  # found by ids alone: no text is shuffled
    counted = fresh
    twice = fresh.groupBy("id").count().filter("count > 1").select("id")
    if not twice.isEmpty():
        double = counted.join(twice, "id", "left_semi").groupBy("id").agg(F.min("text").alias("text"))
        counted = counted.join(twice, "id", "left_anti").unionByName(double)
    if segment_docs < 1 or segment_docs & (segment_docs - 1):
        raise ValueError("segment_docs is a power of two")
    made = materialize(counted.select("id", words(F.col("text")).alias("words")).mapInArrow(
        lambda batches: _segments(batches, segment_docs), SEGMENT_ROWS
    ), "index-words")
    entries = made.filter("word IS NULL").select("id", "length", "segment", "place")
    sums = entries.agg(F.count("*"), F.sum("length")).first()
    if not sums[0]:
        return 0
    places = made.filter("word IS NOT NULL").select(
        "word", "segment", "documents", "occurrences", "places", "times", bucket(F.col("word"), buckets).alias("bucket")
    )
    # One file per bucket unless it is large; sorted by word, so that a file's statistics leave most row groups out.
    parts = max(1, sums[0] // (256 * segment_docs))
    rows = places.repartition(F.col("bucket"), F.pmod(F.xxhash64("segment"), F.lit(parts))).sortWithinPartitions("bucket", "word", "segment")
    rows.write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings/batch={number}")
    entries.write.mode("overwrite").parquet(f"{path}/documents/batch={number}")
    end = spark.createDataFrame([(number, sums[0], sums[1], buckets)], "batch int, documents long, words long, buckets int")
    end.coalesce(1).write.mode("append").parquet(f"{path}/batches")
    return sums[0]


def _committed(spark: SparkSession, path: str, table: str, batches: int) -> DataFrame:
    return spark.read.parquet(f"{path}/{table}").filter(F.col("batch") < batches)


def totals(spark: SparkSession, path: str) -> tuple[int, int, int, int]:
    """(batches, documents, words, buckets) of the index."""
    done = _batches(spark, path)
    if done is None:
        raise ValueError(f"no index at {path}")
    n, docs, total, buckets, others = done.agg(F.max("batch") + 1, F.sum("documents"), F.sum("words"), F.max("buckets"), F.min("buckets")).first()
    if buckets != others:
        raise ValueError("batches with different numbers of buckets")
    return n, docs, total, buckets


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(word, documents, occurrences) over all batches, from the counts of the rows; places are not read."""
    n = totals(spark, path)[0]
    return _committed(spark, path, "postings", n).groupBy("word").agg(F.sum("documents").alias("documents"), F.sum("occurrences").alias("occurrences"))


def postings(spark: SparkSession, path: str, asked: DataFrame) -> DataFrame:
    """The postings of the words in ``asked`` (word), from the folders of these words only."""
    n, _, _, buckets = totals(spark, path)
    rows = _committed(spark, path, "postings", n)
    wanted = asked.select("word").distinct()
    named = [r.word for r in wanted.limit(NAMED_WORDS + 1).collect()]
    if len(named) > NAMED_WORDS:
        return rows.join(wanted.withColumn("bucket", bucket(F.col("word"), buckets)), ["bucket", "word"], "left_semi")
    if not named:
        return rows.limit(0)
    places = [r[0] for r in spark.createDataFrame([(w,) for w in named], "word string").select(bucket(F.col("word"), buckets)).distinct().collect()]
    return rows.filter(F.col("bucket").isin(places) & F.col("word").isin(named))


def search(
    spark: SparkSession, path: str, questions: DataFrame, k: int, query_id_col: str = "query_id", question_col: str = "question",
    k1: float = K1, b: float = B,
) -> DataFrame:
    """(query_id, id, score, matched, rank): the ``k`` best documents per question by BM25, ties to the smaller id (as text).

    A word counts once per question. The weight of a word is ``ln(1 + (N - n + 0.5) / (n + 0.5))`` over the ``N`` documents of
    the index. Scores are rounded to six digits. Questions without a word of the index give no row.

    Each task scores whole segments: their postings meet there, all questions are summed up in turn, and at most ``k`` rows a
    question and segment go on to the ranking. Neither (question, document) nor (word, document) pairs become rows. The
    questions go to every task, ``SENT_PAIRS`` words at a time.
    """
    _, docs, total, _ = totals(spark, path)
    asked = questions.select(F.col(query_id_col).cast("string").alias("query_id"), F.explode(F.array_distinct(words(F.col(question_col)))).alias("word"))
    asked = materialize(asked.distinct(), "question-words")
    blocks = max(1, -(-asked.count() // SENT_PAIRS))
    part = F.pmod(F.xxhash64("query_id"), F.lit(blocks))
    found = [_scored(spark, path, asked.filter(part == i), k, docs, max(total / docs, 1e-9), k1, b) for i in range(blocks)]
    hits = found[0]
    for more in found[1:]:
        hits = hits.unionByName(more)
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _scored(spark: SparkSession, path: str, asked: DataFrame, k: int, docs: int, mean: float, k1: float, b: float) -> DataFrame:
    """(query_id, id, score, matched): the best ``k`` of each segment for the questions in ``asked``."""
    rows = postings(spark, path, asked)
    weight = F.log1p((F.lit(float(docs)) - F.col("n") + 0.5) / (F.col("n") + 0.5))
    weights = dict(rows.groupBy("word").agg(F.sum("documents").alias("n")).select("word", weight).toPandas().itertuples(index=False, name=None))
    of: dict[str, list[str]] = {}
    for query_id, word in asked.select("query_id", "word").toPandas().itertuples(index=False, name=None):
        if word in weights:
            of.setdefault(query_id, []).append(word)

    def score(places: pd.DataFrame, held: pd.DataFrame) -> pd.DataFrame:
        out: list[tuple] = []
        if len(places) and len(held):
            at = held["place"].to_numpy()
            names = np.empty(at.max() + 1, object)
            norm = np.zeros(at.max() + 1)
            names[at] = held["id"].to_numpy()
            norm[at] = k1 * (1 - b + b * held["length"].to_numpy() / mean)
            parts = {}
            for word, where, times in zip(places["word"], places["places"], places["times"]):
                where, times = np.asarray(where, np.int64), np.asarray(times, np.float64)
                parts[word] = where, weights[word] * times * (k1 + 1) / (times + norm[where])
            for query_id, mine in of.items():
                total, matched = np.zeros(len(norm)), np.zeros(len(norm), np.int64)
                for where, part in (parts[w] for w in mine if w in parts):
                    total[where] += part
                    matched[where] += 1
                total = np.round(total + 1e-9, DECIMALS)
                hit = np.flatnonzero(matched)
                if len(hit) > k:
                    hit = hit[total[hit] >= np.partition(total[hit], len(hit) - k)[len(hit) - k]]
                    hit = hit[np.lexsort((names[hit].astype(str), -total[hit]))[:k]]
                out += zip([query_id] * len(hit), names[hit], total[hit], matched[hit])
        return pd.DataFrame(out, columns=["query_id", "id", "score", "matched"])

    n = totals(spark, path)[0]
    keys = ["batch", "segment"]
    left = rows.select(*keys, "word", "places", "times").groupBy(*keys)
    right = _committed(spark, path, "documents", n).select(*keys, "id", "length", "place").groupBy(*keys)
    found = left.cogroup(right).applyInPandas(score, "query_id string, id string, score double, matched long")
    return found.withColumn("score", F.round("score", DECIMALS))


def holding_all(spark: SparkSession, path: str, phrase: str) -> DataFrame:
    """(id) of the documents that hold every word of the phrase, found in the index alone."""
    asked = materialize(spark.range(1).select(F.explode(F.array_distinct(words(F.lit(phrase)))).alias("word")), "phrase")
    need = asked.count()
    keys = ["batch", "segment", "place"]
    found = postings(spark, path, asked).select("batch", "segment", F.explode("places").alias("place"))
    all_words = found.groupBy(*keys).count().filter(F.col("count") == need)
    documents = _committed(spark, path, "documents", totals(spark, path)[0])
    return documents.join(all_words, keys, "left_semi").select("id")


def mentions(
    docs: DataFrame, path: str, phrase: str, order: Sequence[Column], n: int, id_col: str = "doc_id", text_col: str = "text",
    where: Column | None = None,
) -> DataFrame:
    """Top ``n`` of the rows that hold the phrase's words one behind the other, whatever is between them that is no word.

    Only texts which the index names are looked at. The index must hold the rows of ``docs``.
    """
    own = holding_all(docs.sparkSession, path, phrase).withColumnRenamed("id", "_indexed")
    rows = docs if where is None else docs.filter(where)
    near = rows.join(own, rows[id_col].cast("string") == own["_indexed"], "left_semi")
    spaced = F.concat(F.lit(" "), F.array_join(words(F.col(text_col)), " "), F.lit(" "))
    wanted = F.concat(F.lit(" "), F.array_join(words(F.lit(phrase)), " "), F.lit(" "))
    return near.filter(F.contains(spaced, wanted)).orderBy(*order).limit(n)
