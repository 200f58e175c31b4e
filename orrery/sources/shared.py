"""The folder that driver and executors share, and what tells one state of a table folder from another."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def hadoop_path(spark: SparkSession, path: str):
    """A Hadoop path and its file system."""
    jpath = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return jpath, jpath.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session; a temporary folder only where that is unset and all runs on this machine."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not folder:
        if not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="orrery-"))
        folder = sc.getCheckpointDir()
    return folder


def fingerprint(spark: SparkSession, paths: list[str]) -> tuple:
    """Names, sizes and times of the files of some tables: another value once a file is added, removed or changed."""
    out = []
    for path in paths:
        jpath, fs = hadoop_path(spark, path)
        if not fs.exists(jpath):
            continue
        todo = [jpath]
        while todo:
            for status in fs.listStatus(todo.pop()):
                if status.isDirectory():
                    todo.append(status.getPath())
                else:
                    out.append((status.getPath().toString(), status.getLen(), status.getModificationTime()))
    return tuple(sorted(out))
