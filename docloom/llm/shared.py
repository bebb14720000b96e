"""Folders and files that the driver and all executors can reach.

The folder comes from spark.checkpoint.dir; only where that is unset (tests,
a single machine) does the engine choose its own. Workers open files through
pyarrow's file systems, so the folder may be a local mount, HDFS or S3.
"""

from __future__ import annotations

import re
import uuid
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from docloom.functions.batches import BATCH_BYTES, bound_batches, tidy  # noqa: F401

#: Folder where spark.checkpoint.dir is unset; only for a session on one machine.
FALLBACK = "file:///tmp/checkpoints"

_scopes: list[list[str]] = []


def shared_root(spark: SparkSession) -> str:
    """URI of the shared folder, without a slash at its end; a bare path belongs to the cluster's default file system."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        found = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = found.get() if found.isDefined() else None
    if not root:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = FALLBACK
    fs, path = _hadoop(spark, root)
    return fs.makeQualified(path).toString().rstrip("/")


def _hadoop(spark: SparkSession, uri: str):
    path = spark._jvm.org.apache.hadoop.fs.Path(uri)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder in the shared one; it goes when the innermost scope() or else the session's JVM ends."""
    uri = f"{shared_root(spark)}/docloom-{name}-{uuid.uuid4().hex}"
    fs, path = _hadoop(spark, uri)
    fs.mkdirs(path)
    fs.deleteOnExit(path)
    if _scopes:
        _scopes[-1].append(uri)
    return uri


@contextmanager
def scope(spark: SparkSession):
    """Scratch folders made inside go at the end: results must be written inside, as they may read them."""
    _scopes.append([])
    try:
        yield
    finally:
        for uri in _scopes.pop():
            remove(spark, uri)


def make(spark: SparkSession, uri: str) -> str:
    fs, path = _hadoop(spark, uri)
    fs.mkdirs(path)
    return uri


def remove(spark: SparkSession, uri: str) -> None:
    fs, path = _hadoop(spark, uri)
    fs.delete(path, True)


def column(name: str) -> Column:
    """A column by its name, whatever signs are in it."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that the table does not have, in any case of letters."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def map_texts(df: DataFrame, keep: list[str], text_name: str, worker, **added: str) -> DataFrame:
    """Columns ``keep`` and the added ones (name=type) that a worker makes from a text.

    ``worker(columns, text)`` gives the function over Arrow batches. Inside, the
    kept columns have plain names of their own, so no name can clash.
    """
    inner = [f"c{i}" for i in range(len(keep))]
    lean = df.select(*(column(c).alias(n) for c, n in zip(keep, inner, strict=True)), column(text_name).alias("text"))
    schema = T.StructType([*lean.schema.fields[:-1], *(T.StructField(f"out{i}", T._parse_datatype_string(t)) for i, t in enumerate(added.values()))])
    return lean.mapInArrow(tidy(worker(inner, "text")), schema).toDF(*keep, *added)


def written(df: DataFrame, uri: str) -> DataFrame:
    """Cut lineage: write to the shared folder and read back."""
    df.write.mode("overwrite").option("compression", "zstd").parquet(uri)
    return df.sparkSession.read.parquet(uri)


def open_fs(uri: str):
    """(pyarrow file system, path) for a URI; runs on workers."""
    from pyarrow import fs

    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(uri)


def parts_for(n_bytes: int, per_part: int, least: int) -> int:
    """Number of parts that keeps each under per_part bytes; grows with the data."""
    return max(int(least), -(-int(n_bytes) // int(per_part)), 1)
