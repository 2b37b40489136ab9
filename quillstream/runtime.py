"""Session helpers shared by all operators."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

_ROOT = str(Path(__file__).resolve().parent.parent)


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever the driver was started from."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if _ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([_ROOT, *paths])


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where that is unset, as in tests, a temporary one of this machine, which only a local master may use."""
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if named is None:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        named = tempfile.mkdtemp(prefix="quillstream-")
        atexit.register(shutil.rmtree, named, ignore_errors=True)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named)
    return named


def _at(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _at(spark, path)
    return files.exists(at)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder that one of the operators has written."""
    at, files = _at(spark, path)
    files.delete(at, True)


def rename(spark: SparkSession, old: str, new: str) -> bool:
    """Put a finished folder in its place; False if there is one."""
    at, files = _at(spark, old)
    to, _ = _at(spark, new)
    return not files.exists(to) and files.rename(at, to)


def file_states(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """Names, sizes and times of the files at a path."""
    at, files = _at(spark, path)
    return sorted((s.getPath().getName(), s.getLen(), s.getModificationTime()) for s in files.listStatus(at))


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` reliably, so that a lost executor costs no recomputation of its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """Read one table of a folder of Parquet tables."""
    return spark.read.parquet(f"{folder}/{name}.parquet")
