"""The folder that driver and executors share, and tables written there to cut lineage."""

from __future__ import annotations

import atexit
import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names in spark.checkpoint.dir; a folder of our own only where none is named and all runs in one process (tests)."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    context = spark.sparkContext
    if not named:
        named = getattr(context, "_orrery_dir", None)
        if named is None:
            if not re.fullmatch(r"local(\[.*\])?", context.master):
                raise RuntimeError("name a folder that driver and executors share in spark.checkpoint.dir")
            named = "file://" + tempfile.mkdtemp(prefix="orrery_shared")
            context._orrery_dir = named
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named


@contextlib.contextmanager
def tidy(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of what runs within are removed when it has run, not when the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def cut(df: DataFrame) -> DataFrame:
    """The same rows, computed now, written to the shared folder and read from there."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def landed(df: DataFrame, uri: str, name: str) -> DataFrame:
    """The same rows, written now as a table of a folder of ours; the shuffles behind it are removed."""
    with tidy(df.sparkSession):
        df.write.parquet(f"{uri}/{name}")
    return df.sparkSession.read.schema(df.schema).parquet(f"{uri}/{name}")


def fresh_dir(spark: SparkSession, what: str) -> str:
    """A new folder in the shared one, as a URI; it is removed when the driver ends, if not before."""
    base = shared_dir(spark).rstrip("/")
    base = base if "://" in base else f"file://{base}" if base.startswith("/") else base.replace("file:/", "file:///", 1)
    uri = f"{base}/orrery_{what}_{uuid.uuid4().hex}"
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.create_dir(path, recursive=True)
    atexit.register(_forget, uri)
    return uri


def _forget(uri: str) -> None:
    """The folder may be gone by the end of the driver."""
    try:
        remove_dir(uri)
    except OSError:
        pass


def remove_dir(uri: str) -> None:
    fs, path = pafs.FileSystem.from_uri(uri)
    fs.delete_dir(path)


def put(uri: str, name: str, data: bytes | memoryview) -> None:
    """Write a whole file under a name of its own first, so that a task run twice leaves one whole file."""
    fs, path = pafs.FileSystem.from_uri(uri)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    with fs.open_output_stream(own, compression=None) as out:
        out.write(data)
    fs.move(own, f"{path}/{name}")


@contextlib.contextmanager
def put_stream(uri: str, name: str) -> Iterator[pa.NativeFile]:
    """As `put`, for a file that is written piece by piece; one that is broken off is removed."""
    fs, path = pafs.FileSystem.from_uri(uri)
    own = f"{path}/.{name}.{uuid.uuid4().hex}"
    try:
        with fs.open_output_stream(own, compression=None) as out:
            yield out
    except BaseException:
        with contextlib.suppress(OSError):
            fs.delete_file(own)
        raise
    fs.move(own, f"{path}/{name}")


#: Parts of a plan that give the same rows in the same order each time they are read.
_STEADY = ("Project", "Filter", "SubqueryAlias", "LogicalRelation", "Relation", "LogicalRDD", "LocalRelation", "Range")


def steady(df: DataFrame) -> DataFrame:
    """The same rows, in an order that a second read repeats: as they are if they come straight from a table, else written first."""
    todo = [df._jdf.queryExecution().optimizedPlan()]
    while todo:
        node = todo.pop()
        if not str(node.nodeName()).startswith(_STEADY):
            return cut(df)
        children = node.children()
        todo += [children.apply(i) for i in range(children.size())]
    return df


def small_batches(spark: SparkSession, rows: int = 1000) -> None:
    """Arrow batches of texts: Spark's default of 10,000 rows can be hundreds of megabytes of them."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if int(spark.conf.get(key)) > rows:
        spark.conf.set(key, str(rows))
