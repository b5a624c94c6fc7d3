"""Session settings, shared scratch space and table loading."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

TABLES = (
    "region nation customer supplier part orders lineitem events documents "
    "embeddings pages benchmark labels conversations"
).split()


INITIAL_PARTITIONS = "2000"


def build_session(app_name: str = "corpusql", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators expect.

    Shuffle partitions start high and are merged by adaptive execution, so one
    setting serves small and very large inputs. Only what ``conf`` passes overrides
    a setting made elsewhere; each default is applied where nothing was set.
    """
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # Rows with long texts cross to Python: keep a batch within memory.
        "spark.sql.execution.arrow.maxRecordsPerBatch": "2000",
    }
    # Recording the Python call site of every column expression costs more than planning
    # the query. The setting can only be made at the start.
    for key, value in {"spark.python.sql.dataFrameDebugging.enabled": "false", **conf}.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    known = {**dict(spark.sparkContext.getConf().getAll()), **spark.conf.getAll}
    partitions = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    if "spark.sql.shuffle.partitions" not in known:
        defaults[partitions] = INITIAL_PARTITIONS
    for key, value in defaults.items():
        if key not in known:
            spark.conf.set(key, value)
    return spark


_SCHEMAS: dict[tuple[str, int, int], T.StructType] = {}


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table by name. Its schema is read once per process, and again when the path has changed."""
    path = f"{sf_dir}/{name}.parquet"
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    status = place.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(place)
    key = (path, status.getModificationTime(), status.getLen())
    if key not in _SCHEMAS:
        _SCHEMAS[key] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[key]).parquet(path)


_OWN_FOLDERS: dict[str, str] = {}


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh folder every executor can reach.

    The cluster names the shared folder in ``spark.checkpoint.dir``. Only a
    session in local mode, where driver and executors are one process (``local-cluster`` is not), may
    fall back to a temporary folder of its own, which goes when the process ends.
    """
    context = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or context.getConf().get(
        "spark.checkpoint.dir"
    )
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder shared by all executors")
        if context.applicationId not in _OWN_FOLDERS:
            own = _OWN_FOLDERS[context.applicationId] = tempfile.mkdtemp(prefix="corpusql-")
            atexit.register(shutil.rmtree, own, ignore_errors=True)
        root = _OWN_FOLDERS[context.applicationId]
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


SMALL_FILE_COST = 64 << 10


@contextmanager
def many_files(spark: SparkSession) -> Iterator[None]:
    """Frames over very many small files that are run inside read some thousand of them in a task, not 32.

    Spark counts a file as 4 MB more than it has, unless told otherwise; a setting made elsewhere wins.
    """
    key = "spark.sql.files.openCostInBytes"
    if key in {**dict(spark.sparkContext.getConf().getAll()), **spark.conf.getAll}:
        yield
        return
    spark.conf.set(key, str(SMALL_FILE_COST))
    try:
        yield
    finally:
        spark.conf.unset(key)


def file_store(path: str):
    """(file system, path) of a folder in any store pyarrow knows; a path without a scheme is local."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        plain = "file://" + path[5:] if path.startswith("file:/") and not path.startswith("file://") else path
        return fs.FileSystem.from_uri(plain)
    return fs.LocalFileSystem(), path


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write a frame to the shared folder and read it back.

    Cuts lineage and keeps a reused or expensive result safe when executors
    are lost.
    """
    path = shared_dir(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Use all cores for CPU-heavy text work on a *small* scan.

    A scan that already has enough input splits is returned as it is, so a
    large corpus is never shuffled for this. Only call it on a plain scan.
    """
    want = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() >= 2 * want:
        return df
    return df.repartition(want, *keys)
