"""JSON lines whose values do not keep to one type."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_json_object(payload: Column) -> Column:
    """True for text that is one whole JSON object; cut-off lines, other text and null are not."""
    return F.coalesce(F.schema_of_variant(F.try_parse_json(payload)).startswith("OBJECT"), F.lit(False))


def field_texts(df: DataFrame, payload: str, names: list[str], keep: list[str]) -> DataFrame:
    """The named top-level fields of every valid line as text: scalars as written, objects and arrays as JSON, absent ones null."""
    schema = ", ".join(f"`{n}` string" for n in names)
    lines = df.where(is_json_object(F.col(payload)))
    return lines.select(*keep, F.from_json(payload, schema).alias("v")).select(*keep, *(F.col(f"v.{n}").alias(n) for n in names))


def elements(text: Column) -> Column:
    """A JSON value as an array of JSON texts: of an array its elements, of anything else the value itself; null stays null."""
    t = F.ltrim(text)
    return F.when(t.isNull(), None).when(t.startswith("["), F.from_json(t, "array<string>")).otherwise(F.array(t))
