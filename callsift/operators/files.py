"""Small control files in the shared folder: list, read, and create exactly once.

PySpark has no public call for an atomic create, so these go through the session's Hadoop file
system; everything larger than a few kilobytes is read and written by DataFrames.
"""

from __future__ import annotations

import os
import uuid

from pyspark.sql import SparkSession


def _path(spark: SparkSession, path: str):
    """(Hadoop path, its file system)."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    p, fs = _path(spark, path)
    return fs.exists(p)


def names(spark: SparkSession, folder: str) -> list[str]:
    """Names in a folder, sorted; a folder that is not there is empty."""
    p, fs = _path(spark, folder)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def read_text(spark: SparkSession, path: str) -> str:
    p, fs = _path(spark, path)
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def create_once(spark: SparkSession, path: str, text: str) -> bool:
    """Create the file whole, or return False if it is there already: of several writers one succeeds.

    The text goes to a hidden file beside it, which then gets the name: by a hard link on a
    local file system, elsewhere by a rename that does not overwrite (atomic on a distributed one).
    """
    p, fs = _path(spark, path)
    hidden, _ = _path(spark, f"{p.getParent()}/.{p.getName()}.{uuid.uuid4().hex}")
    fs.mkdirs(p.getParent())
    out = fs.create(hidden, False)
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()
    try:
        return _link(hidden, p) if fs.getUri().getScheme() == "file" else _rename(spark, hidden, p)
    finally:
        fs.delete(hidden, False)


def _link(hidden, p) -> bool:
    try:
        os.link(hidden.toUri().getPath(), p.toUri().getPath())
    except FileExistsError:
        return False
    return True


def _rename(spark: SparkSession, hidden, p) -> bool:
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs
    context = hadoop.FileContext.getFileContext(p.toUri(), spark.sparkContext._jsc.hadoopConfiguration())
    plain = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        context.rename(hidden, p, plain)
    except Exception as e:
        if "FileAlreadyExists" in str(e):
            return False
        raise
    return True
