"""Files that arrive over time: read once each, bad lines apart, late revisions replacing earlier ones."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.operators.dedup import pick
from quillstream.sources.json_lines import is_json_object


def ingest_lines(spark: SparkSession, source: str, schema: str, target: str, checkpoint: str) -> DataFrame:
    """Append the lines of all files not read before in the folder ``source`` (or of this one file) to ``target``, marked valid or not, and return what is there.

    Files are read as a stream whose checkpoint holds the place, so a job that is lost or repeated neither skips nor repeats a file.
    """
    at = spark._jvm.org.apache.hadoop.fs.Path(source)
    single = at.getFileSystem(spark._jsc.hadoopConfiguration()).getFileStatus(at).isFile()
    reader = spark.readStream.schema(schema)
    stream = reader.option("pathGlobFilter", at.getName()).parquet(at.getParent().toString()) if single else reader.parquet(source)
    lines = stream.withColumn("valid", is_json_object(F.col("payload")))
    query = lines.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(f"{schema}, valid boolean").parquet(target)


def latest(rows: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The last row of each key by time, then by the greatest ``tie``; a null time is the earliest."""
    return pick(rows, keys, [F.desc_nulls_last(at), F.desc(tie)])


def remaining(rows: DataFrame, done: DataFrame, keys: list[str]) -> DataFrame:
    """Rows whose key has not been done; null keys always remain."""
    return rows.join(done.select(*keys).distinct(), keys, "left_anti")


def windowed_counts(events: DataFrame, at: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts per window and kind with a watermark for late rows, on a stream or a table."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), kind).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), kind, "n")
