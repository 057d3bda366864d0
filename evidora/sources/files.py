"""Files of any file system that Spark reaches."""

from __future__ import annotations

import hashlib
import os
import uuid

from pyspark.sql import SparkSession

from evidora.session import checkpoint_dir


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def exists(spark: SparkSession, path: str) -> bool:
    fs, where = _at(spark, path)
    return fs.exists(where)


def mark(spark: SparkSession, path: str) -> str:
    """A digest of the names, sizes and times of the files under a path."""
    fs, where = _at(spark, path)
    seen, files = [], fs.listFiles(where, True)
    while files.hasNext():
        f = files.next()
        seen.append(f"{f.getPath().toString()}|{f.getLen()}|{f.getModificationTime()}")
    return hashlib.sha256("\n".join(sorted(seen)).encode()).hexdigest()[:24]


def shared_folder(spark: SparkSession) -> str:
    """``spark.evidora.index.dir``, else a folder beside the checkpoints."""
    return spark.conf.get("spark.evidora.index.dir", None) or os.path.join(checkpoint_dir(spark), "evidora-index")


def once_written(spark: SparkSession, target: str, write) -> str:
    """``target``, written by ``write(folder)`` if it isn't there. It is written
    beside and renamed when whole, so a reader never meets half of it, and of
    two writers the first stays."""
    if not exists(spark, target):
        beside = f"{target}.{uuid.uuid4().hex}"
        write(beside)
        fs, where = _at(spark, beside)
        _, there = _at(spark, target)
        if exists(spark, target) or not fs.rename(where, there):
            fs.delete(where, True)
    return target
