"""Files of records: strict and lenient readers, checked data sets, appends without repeats, reports."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quillstream.operators.runs import compacted


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def exists(spark: SparkSession, path: str) -> bool:
    at, files = _path(spark, path)
    return files.exists(at)


def read_jsonl(spark: SparkSession, path: str, schema: StructType | str, missing_ok: bool = False) -> DataFrame:
    """Records of JSON lines with a given schema; blank lines are skipped, and a malformed line fails the read.

    A missing path is an error, or with ``missing_ok`` an empty table. Fields that a line lacks are null.
    """
    if missing_ok and not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_examples(spark: SparkSession, path: str, schema: str, key: str = "question_id", limit: int | None = None, **equal: str | None) -> DataFrame:
    """A checked data set: keys must be unique and not null in the whole file, whatever is filtered after; then rows that equal the given values, at most ``limit`` by key.

    A filter value of None does not filter, nor does a limit of 0 or less. An empty result is an error.
    """
    rows = read_jsonl(spark, path, schema)
    bad = rows.groupBy(key).agg(F.count("*").alias("n")).where((F.col("n") > 1) | F.col(key).isNull()).limit(5)
    if found := [r[key] for r in bad.collect()]:
        raise ValueError(f"repeated or missing {key}: {found}")
    for name, value in equal.items():
        if value is not None:
            rows = rows.where(F.col(name) == value)
    if limit and limit > 0:
        rows = rows.orderBy(key).limit(limit)
    if rows.isEmpty():
        raise ValueError("no example is left")
    return rows


def write_jsonl(df: DataFrame, path: str) -> None:
    """Replace what is at ``path``; readers see the old files or the new ones, as the output is committed at the end. The table must not be read from ``path`` itself."""
    df.write.mode("overwrite").json(path)


def append_new(df: DataFrame, path: str, keys: list[str]) -> int:
    """Append rows whose keys are not yet at ``path``, and return their number; run again after a failure it adds only what is missing. Of rows that share a key one is taken, by the smallest row as JSON."""
    spark = df.sparkSession
    one = df.groupBy(*keys).agg(F.min(F.to_json(F.struct(*df.columns))).alias("row"))
    if exists(spark, path):
        done = spark.read.schema(df.schema).json(path).select(*keys).distinct()
        same = [one[k].eqNullSafe(done[k]) for k in keys]
        one = one.join(done, same, "left_anti")
    fresh = one.select(F.from_json("row", df.schema).alias("r")).select("r.*").persist()
    try:
        n = fresh.count()
        if n:
            fresh.write.mode("append").json(path)
        return n
    finally:
        fresh.unpersist()


def write_report(df: DataFrame, path: str) -> dict:
    """Write a table of one row as one indented JSON object, put in place in one step, and return it."""
    rows = df.limit(2).toJSON().collect()
    if len(rows) != 1:
        raise ValueError("a report is one row")
    report = json.loads(rows[0])
    spark = df.sparkSession
    at, files = _path(spark, path)
    part, _ = _path(spark, f"{path}.part")
    stream = files.create(part, True)
    try:
        stream.write(bytearray(json.dumps(report, indent=2, ensure_ascii=False).encode()))
    finally:
        stream.close()
    files.delete(at, False)
    if not files.rename(part, at):
        raise OSError(f"could not put {path} in place")
    return report


def read_report(spark: SparkSession, path: str) -> dict:
    """The object that ``write_report`` wrote."""
    rows = spark.read.text(path, wholetext=True).collect()
    return json.loads(rows[0][0])


def write_split(df: DataFrame, path: str, by: str) -> None:
    """Replace what is at ``path`` by JSON lines, a folder for each value of ``by``; the values of a null one lie in the default folder."""
    df.write.mode("overwrite").partitionBy(by).json(path)


def compact(spark: SparkSession, path: str, schema: StructType | str, keys: list[str], place: str) -> int:
    """Keep only the newest record of each key at ``path`` (by ``place``), and return how many there are.

    The new files are written beside the old ones and take their place at the end; a job that is lost before leaves the old ones as they are.
    """
    part = f"{path}.{uuid.uuid4().hex}"
    compacted(read_jsonl(spark, path, schema), keys, place).drop("first_place").write.json(part)
    kept = spark.read.schema(schema).json(part).count()
    old, files = _path(spark, path)
    aside, _ = _path(spark, f"{part}.old")
    new, _ = _path(spark, part)
    if not files.rename(old, aside) or not files.rename(new, old):
        raise OSError(f"could not put {path} in place")
    files.delete(aside, True)
    return kept
