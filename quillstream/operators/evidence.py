"""Evidence behind answers: documents from search results and web pages, grades by repaired ids, citations in order."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.functions import ids
from quillstream.functions.text import shortened
from quillstream.operators.joins import repaired_ids


def as_evidence(results: DataFrame, source: str, paper: str, address: str) -> DataFrame:
    """``results`` with ``source_id`` and ``url``: ``address`` and the paper's id where that begins with W, else null."""
    return results.withColumn("source_id", F.col(source)).withColumn("url", F.when(F.startswith(paper, F.lit("W")), F.concat(F.lit(address), F.col(paper))))


def web_evidence(results: DataFrame, url: str, title: str, content: str, order: list[str], most: int = 4000) -> DataFrame:
    """``source_id, url, title, text``: web results with a web address and some text, the first in ``order`` of each address, at most ``most`` characters of it and three dots where it was cut.

    The first of an address is found by a minimum that combines in the map tasks, so an address may have any number of results.
    """
    if most <= 0:
        raise ValueError("most must be positive")
    rows = results.select(F.trim(url).alias("url"), F.struct(*order).alias("at"), F.trim(title).alias("title"), F.trim(content).alias("text"))
    kept = rows.where(ids.is_web_url(F.col("url")) & (F.col("text") != ""))
    first = kept.groupBy("url").agg(F.min(F.struct("at", "title", "text")).alias("r"))
    named = F.coalesce(F.nullif(F.col("r.title"), F.lit("")), F.lit("Untitled web source"))
    return first.select(ids.web_source_id(F.col("url")).alias("source_id"), "url", named.alias("title"), shortened(F.col("r.text"), most).alias("text"))


def graded(documents: DataFrame, grades: DataFrame, by: Sequence[str], doc: str, given: str, order: str, value: str, default: str) -> DataFrame:
    """``documents`` with ``value``: the first grade in ``order`` whose id means the document within its group (see ``repaired_ids``), ``default`` for those without one.

    Grades whose id means no document are left out; of grades with the same ``order`` the smallest counts.
    """
    by = list(by)
    meant = repaired_ids(grades, documents.select(*by, F.col(doc).alias("__doc")), given, "__doc", by=by)
    rows = grades.select(*by, F.col(given).alias("__given"), F.col(order).alias("__order"), F.col(value).alias("__value"))
    led = rows.join(meant.withColumnRenamed(given, "__given").where("__doc is not null"), [*by, "__given"])
    first = led.groupBy(*by, F.col("__doc").alias(doc)).agg(F.min(F.struct("__order", "__value")).alias("__first"))
    return documents.join(first, [*by, doc], "left").withColumn(value, F.coalesce("__first.__value", F.lit(default))).drop("__first")


def citations(answers: DataFrame, evidence: DataFrame, key: str, sources: str, source: str, order: str, fields: Sequence[str]) -> DataFrame:
    """``key, citations, missing``: the evidence of each declared source in the order of citation, and the sources without any. Of several documents of one source the last in ``order`` counts.

    ``key`` must be unique in ``answers``; an answer without sources has two empty arrays.
    """
    last = evidence.groupBy(key, F.col(source).alias("__source")).agg(F.max(F.struct(F.col(order).alias("__order"), *fields)).alias("__doc"))
    cited = answers.select(key, F.posexplode_outer(sources).alias("__at", "__source")).join(last, [key, "__source"], "left")
    found = F.struct(F.col("__at").alias("at"), F.col("__source").alias("source_id"), *(F.col(f"__doc.{f}").alias(f) for f in fields))
    held, lost = F.col("__doc").isNotNull(), F.col("__doc").isNull() & F.col("__at").isNotNull()
    rows = cited.groupBy(key).agg(F.array_sort(F.collect_list(F.when(held, found))).alias("c"), F.array_sort(F.collect_list(F.when(lost, F.struct("__at", F.col("__source").alias("source"))))).alias("m"))
    return rows.select(key, F.transform("c", lambda x: x.dropFields("at")).alias("citations"), F.transform("m", lambda x: x["source"]).alias("missing"))
