"""Folders that all executors share, and small files in them that the driver reads and writes."""

from __future__ import annotations

import os
import tempfile
import time
import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path below spark.checkpoint.dir; a local session without one gets a temporary folder, a cluster an error."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.conf.get("spark.master", "local").startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-checkpoint-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/placeloom-{name}-{uuid.uuid4().hex}"


def kept(df: DataFrame, name: str) -> DataFrame:
    """df written into the shared folder and read back, so that what is used twice isn't worked out again."""
    path = shared_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _located(spark: SparkSession, path: str):
    """(file system, path) as Hadoop has them, so any store that Spark's session is set up for."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def names_in(spark: SparkSession, folder: str) -> list[str]:
    """Names of what lies in a folder, sorted; none if there is no such folder."""
    store, at = _located(spark, folder)
    return sorted(x.getPath().getName() for x in store.listStatus(at)) if store.exists(at) else []


def read_text(spark: SparkSession, path: str) -> str:
    """A small file's text."""
    store, at = _located(spark, path)
    stream = store.open(at)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of a new name."""
    store, at = _located(spark, path)
    stream = store.create(at, False)
    try:
        stream.write(bytearray(text.encode()))
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create a small file unless it is there already: of several writers one gets True, and no reader sees half a file.

    The text is written beside it and then given the name: by a hard link on a local or mounted disk, else by a
    rename that doesn't replace, which HDFS does as one step. An object store without such a rename can't be used.
    """
    beside = f"{path}.{uuid.uuid4().hex}.tmp"
    write_text(spark, beside, text)
    store, at = _located(spark, beside)
    try:
        if store.getScheme() == "file":
            try:
                os.link(at.toUri().getPath(), _located(spark, path)[1].toUri().getPath())
            except FileExistsError:
                return False
            return True
        jvm = spark._jvm
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(store.getUri(), spark._jsc.hadoopConfiguration())
        options = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(at, _located(spark, path)[1], options)
        except Py4JJavaError as e:
            if "FileAlreadyExistsException" in e.java_exception.getClass().getName():
                return False
            raise
        return True
    finally:
        store.delete(at, False)


def delete_folder(spark: SparkSession, path: str) -> None:
    store, at = _located(spark, path)
    store.delete(at, True)


def age_hours(spark: SparkSession, path: str) -> float:
    """Hours since a file or folder was last changed."""
    store, at = _located(spark, path)
    return time.time() / 3600 - store.getFileStatus(at).getModificationTime() / 3.6e6
