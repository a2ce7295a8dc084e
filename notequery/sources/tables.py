"""Tables and small files in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; where that is unset, a local folder for a local session, and an error on a cluster."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not (spark.sparkContext.master == "local" or spark.sparkContext.master.startswith("local[")):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def fresh(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """A frame written as a table in the shared folder and read again, for plans that use it more than once."""
    path = fresh(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._stored_at = path
    return out


def size(df: DataFrame) -> int:
    """Bytes of the table of a frame that ``stored`` gave."""
    return sum(n for _, n, _ in state(df.sparkSession, df._stored_at))


def remove(df: DataFrame) -> None:
    """Delete the table of a frame that ``stored`` gave."""
    delete(df.sparkSession, df._stored_at)


def _at(spark: SparkSession, path: str) -> tuple:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    store, where = _at(spark, folder)
    return [f.getPath().getName() for f in store.listStatus(where)] if store.exists(where) else []


def state(spark: SparkSession, path: str) -> tuple:
    """Lengths and times of a file, or of the files of a folder: what changes when a table is written again."""
    store, where = _at(spark, path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in store.listStatus(where)))


def read_text(spark: SparkSession, path: str) -> str:
    """A small text file."""
    store, where = _at(spark, path)
    stream = store.open(where)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small text file unless there is one already, in one step for readers; whether it was written."""
    store, where = _at(spark, path)
    _, part = _at(spark, f"{path.rpartition('/')[0]}/.{uuid.uuid4().hex}")
    stream = store.create(part, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()
    fs = spark._jvm.org.apache.hadoop.fs
    context = fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
    try:
        context.rename(part, where, spark.sparkContext._gateway.new_array(getattr(fs, "Options$Rename"), 0))
    except Py4JJavaError as e:
        store.delete(part, False)
        if "AlreadyExists" in e.java_exception.getClass().getName():
            return False
        raise
    return True


def delete(spark: SparkSession, path: str) -> None:
    """Delete a file or folder."""
    store, where = _at(spark, path)
    store.delete(where, True)
