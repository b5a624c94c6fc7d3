"""CSV and TSV files of any size as documents: shape, types and first rows of each file."""

from __future__ import annotations

import csv
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusql.sources.lines import runs
from corpusql.sources.listing import Listing, read_lines
from corpusql.sources.tables import SAMPLE_ROWS, TABLE_HEAD, TABLE_MORE, TABLE_ROW

# Texts that stand for a missing value, and for a truth value.
MISSING = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN",
    "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
)
TRUE, FALSE = ("True", "TRUE", "true"), ("False", "FALSE", "false")

WHOLE = re.compile(r"\s*[-+]?[0-9]+\s*")
REAL = re.compile(r"\s*[-+]?(?:(?:[0-9]+\.?[0-9]*|\.[0-9]+)(?:[eE][-+]?[0-9]+)?|inf|infinity)\s*", re.IGNORECASE)
KINDS = ("whole", "real", "truth", "other")

STATES = "location string, block long, text string, at long, in0 boolean, in1 boolean, out0 boolean, out1 boolean, n0 long, n1 long"
FOUND = "location string, record long, cells array<string>, counts array<array<long>>, rows long, widest int"


def _quote_patterns(sep: str) -> tuple[re.Pattern, re.Pattern]:
    """Lines that end outside quotes, if they start outside and if they start inside. A quote counts at the start of a field only."""
    other = re.escape(sep)
    field = rf'(?:"(?:[^"]|"")*+"[^{other}]*|[^"{other}][^{other}]*|)'
    rest = rf"(?:{other}{field})*"
    return re.compile(field + rest, re.DOTALL), re.compile(rf'(?:[^"]|"")*+"[^{other}]*{rest}', re.DOTALL)


def quote_states(lines: DataFrame, sep: str) -> DataFrame:
    """For each line whether it starts and ends inside quotes, and how many records have started in the block, if the block starts outside (0) or inside (1).

    A block cannot know what came before it, so both cases are carried along.
    """

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        outside, inside = _quote_patterns(sep)
        last, states, counts, held = None, [False, True], [0, 0], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            text = batch.column("text")
            quoted = np.flatnonzero(pc.fill_null(pc.match_substring(text, '"'), False).to_numpy(zero_copy_only=False))
            columns = [np.zeros(batch.num_rows, bool) for _ in range(4)] + [np.zeros(batch.num_rows, np.int64) for _ in range(2)]
            number = np.empty(batch.num_rows, np.int64)
            for a, b in zip(*runs(batch)):
                key = (batch.column("location")[a].as_py(), batch.column("block")[a].as_py())
                if key != last:
                    last, states, counts, held = key, [False, True], [0, 0], 0
                number[a:b] = np.arange(held, held + b - a)
                held += b - a
                # Between lines with quotes nothing changes.
                marks = quoted[(quoted >= a) & (quoted < b)].tolist()
                for h in (0, 1):
                    state, at = states[h], a
                    starts, ends = columns[h], columns[2 + h]
                    for m in marks:
                        starts[at : m + 1], ends[at:m] = state, state
                        state = not (inside if state else outside).fullmatch(text[m].as_py())
                        ends[m], at = state, m + 1
                    starts[at:b], ends[at:b] = state, state
                    states[h] = state
                    columns[4 + h][a:b] = counts[h] + np.cumsum(~starts[a:b])
                    counts[h] = int(columns[4 + h][b - 1])
            names = ["at", "in0", "in1", "out0", "out1", "n0", "n1"]
            for name, column in zip(names, [number, *columns]):
                batch = batch.append_column(name, pa.array(column))
            yield batch

    return lines.mapInArrow(walk, STATES)


def _strung(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For files with their blocks in order: the state each block starts in, and the records that started before it."""
    names = ["location", "block", "inside", "before", "open", "invalid"]
    kinds = [pa.string(), pa.int64(), pa.bool_(), pa.int64(), pa.bool_(), pa.bool_()]
    for batch in batches:
        out: list[tuple] = []
        for location, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            inside, before, rows = False, 0, []
            for b in blocks:
                rows.append((b["block"], inside, before))
                before += b["n1"] if inside else b["n0"]
                inside = b["out1"] if inside else b["out0"]
            bad = any(b["invalid"] for b in blocks)
            out += [(location, *row, inside, bad) for row in rows]
        columns = list(zip(*out)) if out else [[]] * 6
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)


def csv_records(lines: DataFrame, sep: str) -> tuple[DataFrame, DataFrame]:
    """(location, record, text) of CSV lines, a record that spans lines whole, and (location, error) of files that cannot be read.

    Blocks are strung together per file from one row each. A file whose last quote is never closed, or that is not
    UTF-8, has no records.
    """
    stated = quote_states(lines, sep)
    ends = stated.groupBy("location", "block").agg(
        F.max_by("out0", "at").alias("out0"), F.max_by("out1", "at").alias("out1"), F.max("n0").alias("n0"),
        F.max("n1").alias("n1"), F.count_if(F.col("text").isNull()).cast("boolean").alias("invalid"),
    )
    ordered = F.array_sort(F.collect_list(F.struct("block", "out0", "out1", "n0", "n1", "invalid")))
    blocks = ends.groupBy("location").agg(ordered.alias("blocks")).mapInArrow(
        _strung, "location string, block long, inside boolean, before long, open boolean, invalid boolean"
    )
    error = F.when(F.col("invalid"), F.lit("not valid UTF-8")).when(F.col("open"), F.lit("the file ends inside quotes"))
    failed = blocks.groupBy("location").agg(F.first(error).alias("error"))

    def real(zero: str, one: str) -> Column:
        return F.when(F.col("inside"), F.col(one)).otherwise(F.col(zero))

    placed = stated.join(blocks.filter(error.isNull()).drop("open", "invalid"), ["location", "block"]).select(
        "location", "block", "at", "text", (F.col("before") + real("n0", "n1") - 1).alias("record"),
        (real("in0", "in1") | real("out0", "out1")).alias("part"),
    )
    joined = placed.filter("part").groupBy("location", "record").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("block", "at", "text"))), lambda x: x["text"]), "\n").alias("text")
    )
    return placed.filter("NOT part").select("location", "record", "text").union(joined), failed.filter("error IS NOT NULL")


def value_kind(value: str) -> int:
    """Place in KINDS, or -1 for a missing value. Whole numbers beyond 64 bits are texts."""
    if value in MISSING:
        return -1
    if WHOLE.fullmatch(value):
        return 0 if -(2**63) <= int(value) < 2**63 else 3
    if REAL.fullmatch(value):
        return 1
    return 2 if value in TRUE or value in FALSE else 3


def parse_records(records: DataFrame, sep: str, first: int = SAMPLE_ROWS + 1) -> DataFrame:
    """FOUND rows: per batch and file the counts of value kinds by column, and its ``first`` records with their cells."""

    def cells_of(text: str) -> list[str]:
        try:
            return next(csv.reader([text], delimiter=sep))
        except csv.Error:  # a lone carriage return outside quotes, say
            return text.split(sep)

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        csv.field_size_limit(2**31 - 1)
        known: dict[str, int] = {}
        for batch in batches:
            out: list[tuple] = []
            by_file: dict[str, list[tuple[int, list[str]]]] = {}
            for location, record, text in zip(*(batch.column(c).to_pylist() for c in range(3))):
                text = text.removesuffix("\r")
                if text.strip(" " if sep == "\t" else " \t"):
                    by_file.setdefault(location, []).append((record, cells_of(text)))
            for location, rows in by_file.items():
                widest = max(len(cells) for _, cells in rows)
                counts = np.zeros((widest, len(KINDS)), np.int64)
                for _, cells in rows:
                    for i, cell in enumerate(cells):
                        kind = known.get(cell)
                        if kind is None:
                            kind = value_kind(cell)
                            if len(known) < 100_000 and len(cell) < 100:
                                known[cell] = kind
                        if kind >= 0:
                            counts[i, kind] += 1
                out.append((location, None, None, counts.tolist(), len(rows), widest))
                out += [(location, record, cells, None, None, None) for record, cells in sorted(rows)[:first]]
            names = ["location", "record", "cells", "counts", "rows", "widest"]
            kinds = [pa.string(), pa.int64(), pa.list_(pa.string()), pa.list_(pa.list_(pa.int64())), pa.int64(), pa.int32()]
            columns = list(zip(*out)) if out else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=names)

    return records.mapInArrow(parse, FOUND)


def column_type(counts: list[int], rows: int) -> str:
    """Type of a column from how many of its values are whole, real, truth values and other texts."""
    whole, real, truth, other = counts
    missing = rows - sum(counts)
    if other or truth and (whole or real) or rows == 0:
        return "object"
    if truth:
        return "object" if missing else "bool"
    return "int64" if whole and not real and not missing else "float64"


def shown(value: str | None, kind: str, truth: bool):
    """A cell as the row's text shows it."""
    if value is None or value in MISSING:
        return math.nan
    if kind == "int64":
        return int(value)
    if kind == "float64":
        return float(value)
    return value in TRUE if truth else value


def describe(name: str, first: list[list[str]], counts: list[list[int]], rows: int, widest: int) -> tuple:
    """(text, row_count, column_count, columns, dtypes, error) of one file."""
    head, sample, n = list(first[0]), first[1:], rows - 1
    head[0] = head[0].removeprefix("\ufeff")
    # Rows with more cells than the header: the leading ones name the row, if the first row has them.
    extra = max(0, len(sample[0]) - len(head)) if sample else 0
    if widest > len(head) + extra:
        return None, None, None, None, None, f"expected {len(head) + extra} fields, saw {widest}"
    seen: dict[str, int] = {}
    names = []
    for i, title in enumerate(head):
        title = title or f"Unnamed: {i}"
        seen[title] = seen.get(title, -1) + 1
        names.append(f"{title}.{seen[title]}" if seen[title] else title)
    own = [list(c) for c in counts] + [[0] * len(KINDS) for _ in range(len(head) + extra - len(counts))]
    for i, cell in enumerate(first[0]):
        if (kind := value_kind(cell)) >= 0:
            own[i][kind] -= 1
    own = own[extra : extra + len(head)]
    kinds = [column_type(c, n) for c in own]
    truths = [c[2] > 0 and not (c[0] or c[1] or c[3]) for c in own]
    lines = [TABLE_HEAD % (name, ", ".join(names), n)]
    for number, cells in enumerate(sample, 1):
        cells = (cells + [None] * (len(head) + extra - len(cells)))[extra:]
        lines.append(TABLE_ROW % (number, {t: shown(v, k, b) for t, v, k, b in zip(names, cells, kinds, truths)}))
    if n > len(sample):
        lines.append(TABLE_MORE % (n - len(sample)))
    return "\n".join(lines), n, len(head), json.dumps(names), json.dumps(dict(zip(names, kinds))), None


def csv_summaries(files: Listing, extension: str, sep: str) -> DataFrame:
    """(location, first, counts, rows, widest, error) of each file that has records or cannot be read."""
    lines = read_lines(files, [extension])
    records, failed = csv_records(lines, sep)
    found = parse_records(records, sep)
    size = found.filter("rows IS NOT NULL").groupBy("location").agg(F.sum("rows").alias("rows"), F.max("widest").alias("widest"))
    cells = found.filter("rows IS NOT NULL").select("location", F.posexplode("counts").alias("column", "c"))
    sums = cells.groupBy("location", "column").agg(*[F.sum(F.col("c")[k]).alias(f"k{k}") for k in range(len(KINDS))])
    kinds = sums.groupBy("location").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("column", F.array(*[f"k{k}" for k in range(len(KINDS))]).alias("c")))), lambda x: x["c"]).alias("counts")
    )
    order = W.partitionBy("location").orderBy("record")
    few = found.filter("record IS NOT NULL").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= SAMPLE_ROWS + 1)
    first = few.groupBy("location").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "cells"))), lambda x: x["cells"]).alias("first"))
    whole = size.join(kinds, "location").join(first, "location").withColumn("error", F.lit(None).cast("string"))
    return whole.unionByName(failed, allowMissingColumns=True)
