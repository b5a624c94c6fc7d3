"""The files below a path, listed and opened by tasks.

Spark's own file sources keep every file's name and status in the driver, and again for each frame. Here names are rows
of a table in the shared folder, so the driver's memory does not grow with their number.
"""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusql.session import file_store, shared_dir

FILES = "path string, modificationTime timestamp, length long"

# Entries a task lists before it hands folders back, rows and bytes of a batch, and files that share a task.
ENTRIES_IN_A_TASK = 50_000
BATCH_ROWS, BATCH_BYTES = 2000, 2 << 20
FILES_IN_A_TASK = 4000
READ_BYTES = 1 << 20
# Blocks that all files together have at least, where these are not smaller than the cost of opening a file.
BLOCKS = 256


class Store(NamedTuple):
    """A store that tasks open by themselves; ``prefix`` stands before its own paths in the names Spark gives them."""

    uri: str
    prefix: str


class Listing(NamedTuple):
    """``rows`` (path, modificationTime, length, location) of the files below ``path``; ``store`` is None where only Spark can read."""

    spark: SparkSession
    path: str
    store: Store | None
    rows: DataFrame


def ext_pattern(*extensions: str) -> str:
    """File names with one of the extensions, in any case, as the file source understands it."""
    either = ["".join(f"[{c}{c.upper()}]" for c in ext) for ext in extensions]
    return f"*.{{{','.join(either)}}}"


def has_extension(*extensions: str) -> Column:
    return F.lower(F.substring_index("path", ".", -1)).isin(*extensions)


def is_listed(name: str, folder: bool) -> bool:
    """Whether Spark's file sources see a file or folder of this name below a path."""
    hidden = name.startswith(".") or name.startswith("_") and "=" not in name or name.endswith("._COPYING_")
    return not hidden or folder and name.startswith(("_metadata", "_common_metadata"))


def _opened(store, path: str):
    from pyarrow import fs

    return open(path, "rb", buffering=0) if isinstance(store, fs.LocalFileSystem) else store.open_input_file(path)


def _entries(store, path: str) -> Iterator[tuple[str, bool, int, int]]:
    """(name, is a folder, milliseconds of the last change, bytes) of what a folder holds; a local one is never held whole."""
    from pyarrow import fs

    if isinstance(store, fs.LocalFileSystem):
        with os.scandir(path) as found:
            for entry in found:
                try:
                    status, folder = entry.stat(), entry.is_dir()
                except FileNotFoundError:  # a link to nowhere, or gone meanwhile
                    continue
                yield entry.name, folder, status.st_mtime_ns // 10**6, 0 if folder else status.st_size
    else:
        for info in store.get_file_info(fs.FileSelector(path)):
            yield info.base_name, info.type == fs.FileType.Directory, (info.mtime_ns or 0) // 10**6, info.size or 0


def _roots(spark: SparkSession, path: str) -> tuple[Store, list[str], list[tuple[str, int, int]]] | None:
    """The store, the folders and the files that ``path``, which may be a pattern, stands for."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = place.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(place)
    if not found:
        return None
    first = found[0].getPath()
    uri = first.toUri()
    try:
        # The file system of a local path takes it as it is, any other one takes the encoded form.
        local = uri.getScheme() == "file"
        store, own = file_store(uri.getPath() if local else uri.toString())
        if not first.toString().endswith(own) or store.get_file_info(own).type.name == "NotFound":
            return None
    except Exception:  # a store pyarrow does not know, or has no library for
        return None
    folders = [s.getPath().toString() for s in found if s.isDirectory()]
    files = [
        (s.getPath().toString(), s.getModificationTime(), s.getLen())
        for s in found
        if not s.isDirectory() and s.getLen() and is_listed(s.getPath().getName(), False)
    ]
    return Store("/" if local else uri.toString(), first.toString().removesuffix(own)), folders, files


def list_files(spark: SparkSession, path: str) -> Listing:
    """The files below ``path`` that Spark's file sources would list: none of zero bytes, none hidden.

    Tasks look into folders, and folders one has no time for are dealt out again, so a few rounds list trees of any shape. A store
    that pyarrow cannot open is listed by Spark, whose driver then holds all names.
    """
    found = _roots(spark, path)
    if found is None:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        return Listing(spark, path, None, files.select("path", "modificationTime", "length", F.col("_metadata.file_path").alias("location")))
    place, folders, files = found

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, seen = file_store(place.uri)[0], 0
        rows: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            columns = list(zip(*rows)) or [(), (), ()]
            rows.clear()
            kinds = [pa.string(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["path", "modified", "length"])

        for batch in batches:
            queue = deque(batch.column(0).to_pylist())
            while queue and seen < ENTRIES_IN_A_TASK:
                folder = queue.popleft()
                for name, is_folder, modified, length in _entries(store, folder.removeprefix(place.prefix)):
                    seen += 1
                    if not is_listed(name, is_folder) or not is_folder and not length:
                        continue
                    if is_folder and seen < ENTRIES_IN_A_TASK:
                        queue.append(f"{folder.rstrip('/')}/{name}")
                        continue
                    rows.append((f"{folder.rstrip('/')}/{name}", modified, None if is_folder else length))
                    if len(rows) >= BATCH_ROWS:
                        yield batch_of()
            rows += [(folder, None, None) for folder in queue]
            yield batch_of()

    done: list[str] = []
    queue = spark.createDataFrame([(f,) for f in folders], "path string")
    while folders:
        done.append(shared_dir(spark, "listing"))
        listed = queue.mapInArrow(walk, "path string, modified long, length long")
        listed.select("path", F.timestamp_millis("modified").alias("modificationTime"), "length").write.parquet(done[-1])
        waiting = spark.read.schema(FILES).parquet(done[-1]).filter("length IS NULL").select("path")
        if not (left := waiting.count()):
            break
        queue = waiting.repartition(max(min(left, 4 * spark.sparkContext.defaultParallelism), left // 32))
    rows = spark.read.schema(FILES).parquet(*done).filter("length IS NOT NULL") if done else spark.createDataFrame([], FILES)
    if files:
        own = spark.createDataFrame(files, "path string, modified long, length long")
        rows = rows.union(own.select("path", F.timestamp_millis("modified"), "length"))
    return Listing(spark, path, place, rows.withColumn("location", F.col("path")))


def _bytes(spark: SparkSession, key: str, default: str) -> int:
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(key, default))


def _dealt(spark: SparkSession, rows: DataFrame) -> tuple[int, int]:
    """How many tasks read files, and the bytes of a block, which are the same however many cores there are."""
    number, total = rows.agg(F.count("*"), F.coalesce(F.sum("length"), F.lit(0))).first()
    most = _bytes(spark, "spark.sql.files.maxPartitionBytes", "128m")
    least = _bytes(spark, "spark.sql.files.openCostInBytes", "4m")
    tasks = max(2 * spark.sparkContext.defaultParallelism, -(-number // FILES_IN_A_TASK), -(-total // max(most, 1 << 20)))
    return tasks, max(1, min(most, max(least, total // BLOCKS)))


def read_whole(files: Listing, extensions: Sequence[str], max_bytes: int) -> DataFrame:
    """(path, modificationTime, length, content) of the files with one of the extensions and at most ``max_bytes``; no other is opened."""
    spark, store = files.spark, files.store
    if store is None:
        reader = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return reader.option("pathGlobFilter", ext_pattern(*extensions)).load(files.path).filter(F.col("length") <= max_bytes)
    rows = files.rows.filter(has_extension(*extensions) & (F.col("length") <= max_bytes))
    tasks, _ = _dealt(spark, rows)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener, names = file_store(store.uri)[0], ["path", "modified", "length", "content"]
        for batch in batches:
            first, held, size = 0, [], 0
            for number, path in enumerate(batch.column(0).to_pylist(), 1):
                with _opened(opener, path.removeprefix(store.prefix)) as file:
                    held.append(file.read())
                size += len(held[-1])
                if size >= BATCH_BYTES or len(held) >= BATCH_ROWS or number == batch.num_rows:
                    own = [c.slice(first, len(held)) for c in batch.columns]
                    yield pa.RecordBatch.from_arrays([*own, pa.array(held, pa.binary())], names=names)
                    first, held, size = number, [], 0

    named = rows.select("path", F.unix_millis("modificationTime").alias("modified"), "length").repartition(tasks)
    made = named.mapInArrow(read, "path string, modified long, length long, content binary")
    return made.select("path", F.timestamp_millis("modified").alias("modificationTime"), "length", "content")


def block_lines(file, start: int, stop: int) -> Iterator[bytes]:
    """Lines of an open file whose first byte lies in [start, stop), without their line feeds and a mark of the byte order."""
    at = max(start - 1, 0)
    file.seek(at)
    skipping, parts = start > 0, []
    while data := file.read(READ_BYTES):
        if skipping:
            # The line that holds the byte before the block belongs to a block before.
            cut = data.find(b"\n") + 1
            at += cut or len(data)
            if at >= stop:
                return
            if not cut:
                continue
            data, skipping = data[cut:], False
        # ``at`` is where the line in ``parts`` and ``data`` starts.
        lines = data.split(b"\n")
        if len(lines) == 1:
            parts.append(data)
            continue
        lines[0] = b"".join([*parts, lines[0]])
        parts = [lines.pop()]
        for line in lines:
            yield line if at else line.removeprefix(b"\xef\xbb\xbf")
            at += len(line) + 1
            if at >= stop:
                return
    last = b"".join(parts)
    if last := last if at else last.removeprefix(b"\xef\xbb\xbf"):
        yield last


def read_lines(files: Listing, extensions: Sequence[str], larger_than: int = 0, only: DataFrame | None = None) -> DataFrame:
    """(location, block, text) of every line of the files with one of the extensions. A carriage return before the line feed stays in the text.

    ``block`` is the byte the reading task started from. A line belongs to the block its
    first byte lies in; the rows of a block come from one task, in the order of the file. Text that is not UTF-8 is NULL.
    Files of ``larger_than`` bytes and less, and those whose ``location`` is not in ``only``, are left out before any is opened.
    """
    spark, store = files.spark, files.store
    text = F.when(F.is_valid_utf8("value"), F.col("value")).alias("text")
    if store is None:
        reader = spark.read.option("recursiveFileLookup", "true").option("lineSep", "\n")
        lines = reader.option("pathGlobFilter", ext_pattern(*extensions)).text(files.path)
        lines = lines.filter(F.col("_metadata.file_size") > larger_than)
        found = lines.select(F.col("_metadata.file_path").alias("location"), F.col("_metadata.file_block_start").alias("block"), text)
        return found if only is None else found.join(only.select("location"), "location", "left_semi")
    rows = files.rows.filter(has_extension(*extensions) & (F.col("length") > larger_than))
    # Before files are left out: blocks are the same for all frames over the same listing.
    tasks, block = _dealt(spark, rows)
    if only is not None:
        rows = rows.join(only.select("location"), "location", "left_semi")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        opener = file_store(store.uri)[0]
        for batch in batches:
            places, blocks, held, size = [], [], [], 0
            for location, start, stop in zip(*(c.to_pylist() for c in batch.columns)):
                with _opened(opener, location.removeprefix(store.prefix)) as file:
                    for line in block_lines(file, start, stop):
                        places.append(location)
                        blocks.append(start)
                        held.append(line)
                        size += len(line)
                        if size >= BATCH_BYTES or len(held) >= BATCH_ROWS:
                            yield lines_of(places, blocks, held)
                            places, blocks, held, size = [], [], [], 0
            yield lines_of(places, blocks, held)

    def lines_of(places: list[str], blocks: list[int], held: list[bytes]) -> pa.RecordBatch:
        columns = [pa.array(places, pa.string()), pa.array(blocks, pa.int64()), pa.array(held, pa.binary())]
        return pa.RecordBatch.from_arrays(columns, names=["location", "block", "value"])

    start = F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, F.lit(block).cast("long")))
    starts = rows.select("location", "length", start.alias("start"))
    named = starts.select("location", "start", F.least(F.col("start") + block, F.col("length")).alias("stop")).repartition(tasks)
    made = named.mapInArrow(read, "location string, block long, value binary")
    return made.select("location", "block", F.col("value").cast("string").alias("value")).select("location", "block", text)
