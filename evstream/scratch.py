"""The folder that all machines share for tables and captures written on the way."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid

from pyspark.sql import SparkSession

_written: list[tuple[SparkSession, str]] = []


def scratch_root(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a session on one machine (tests) gets a folder of its own; on a cluster that is an error."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="evstream-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in it, deleted when the driver ends."""
    path = f"{scratch_root(spark)}/evstream/{name}-{uuid.uuid4().hex}"
    _written.append((spark, path))
    return path


def store(spark: SparkSession, path: str):
    """The file system of a path, and the path as it takes it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = store(spark, path)
    return fs.exists(where)


def names(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds; none if it is not there."""
    fs, where = store(spark, path)
    return [f.getPath().getName() for f in fs.listStatus(where)] if fs.exists(where) else []


def make_folder(spark: SparkSession, path: str) -> None:
    fs, where = store(spark, path)
    fs.mkdirs(where)


def delete(spark: SparkSession, path: str) -> None:
    fs, where = store(spark, path)
    fs.delete(where, True)
    if (spark, path) in _written:
        _written.remove((spark, path))


@atexit.register
def _clean() -> None:
    for spark, path in list(_written):
        try:
            delete(spark, path)
        except Exception:
            return  # the session has ended; its folder goes with the cluster's own cleaning
