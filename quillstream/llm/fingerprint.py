"""Records that differ only in writing: multiset fingerprints over normalised fields."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.runtime import cut

_LANE = 2**61  # two of these add up without overflow


def _letters_and_digits(text: str | None, start: str | None) -> str | None:
    if text is None:
        return None
    text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    text = "".join(c for c in text if unicodedata.category(c) != "Cf")
    if start and start in text:
        text = text[text.index(start) :]
    return "".join(c for c in text if unicodedata.category(c)[0] in "LNM")


def _unicode_form(value: Column, start: str | None) -> Column:
    @F.pandas_udf("string")
    def form(values: pd.Series) -> pd.Series:
        return values.map(lambda v: _letters_and_digits(v, start), na_action="ignore")

    return form(value)


def plain_form(value: Column, start: str | None = None) -> Column:
    """Letters (with their accents) and digits of ``value`` after NFKC, without case; null and what has none become ''.

    What stands before the first ``start`` is left out. ASCII values, the bulk, stay in the JVM; only the others go through Python.
    """
    text = value.cast("string")
    ascii_only = ~text.rlike(r"[^\x00-\x7F]")
    plain = F.lower(text)
    if start:
        at = F.instr(plain, start)
        plain = F.when(at > 0, F.substring(plain, at, F.length(plain))).otherwise(plain)
    plain = F.regexp_replace(plain, "[^a-z0-9]", "")
    return F.coalesce(F.when(ascii_only, plain).otherwise(_unicode_form(F.when(~ascii_only, text), start)), F.lit(""))


def work_form(value: Column) -> Column:
    """The plain form of a paper id from its W on, whatever address stands before."""
    whole = plain_form(value)
    return F.coalesce(F.nullif(F.regexp_extract(whole, "^.*(w[0-9].*)$", 1), F.lit("")), whole)


def multiset_hash(fields: dict[str, Column], lane: int) -> Column:
    """Commutative hash of the (name, value) pairs: the sum of their hashes, whatever the order of the fields."""
    total = F.lit(0).cast("bigint")
    for name, value in fields.items():
        one = F.shiftrightunsigned(F.xxhash64(F.lit(lane), F.lit(name), value), 3)
        total = F.pmod(total + one, F.lit(_LANE))
    return total


def with_fingerprint(df: DataFrame, key: str, forms: dict[str, Column]) -> DataFrame:
    """``key``, one normalised column per field (``f_<name>``) and the two lanes ``h1, h2`` of the fingerprint."""
    fields = df.select(F.col(key).alias("id"), *(c.alias(f"f_{n}") for n, c in forms.items())).where(F.col("id").isNotNull())
    values = {n: F.col(f"f_{n}") for n in forms}
    return fields.select("*", multiset_hash(values, 1).alias("h1"), multiset_hash(values, 2).alias("h2"))


def duplicate_links(df: DataFrame, key: str, forms: dict[str, Column]) -> DataFrame:
    """``kept, copy``: one row per record whose fields all equal those of a record with a smaller ``key``.

    Records are normalised once. Groups form on the fingerprint alone, counted map-side first, so that a group that holds a third of all rows costs one row
    per map task. Members then meet the record of their group's smallest key in hash joins (adaptive execution splits a hot key, as the other
    side has one row per group), and every field is compared; records that only share a hash are grouped again by their fields. Nothing is sorted.

    Null, empty and blank values are one value. Rows with a null key give none. A key that repeats counts once.
    """
    rows = cut(with_fingerprint(df, key, forms))
    names = [c for c in rows.columns if c.startswith("f_")]
    hashed = lambda d: d.hint("shuffle_hash")
    groups = rows.groupBy("h1", "h2").agg(F.min("id").alias("kept"), F.max("id").alias("last")).where("kept < last").drop("last")
    members = cut(rows.join(hashed(groups), ["h1", "h2"]).drop("h1", "h2"))
    first = members.where("id = kept").select("kept", *(F.col(n).alias(f"of_{n}") for n in names)).dropDuplicates(["kept", *(f"of_{n}" for n in names)])
    same = F.lit(True)
    for n in names:
        same = same & (F.col(n) == F.col(f"of_{n}"))
    compared = members.where("id != kept").join(hashed(first), "kept").withColumn("same", same)
    sure = compared.where("same").select("kept", F.col("id").alias("copy"))
    clashed = compared.where("not same").drop("kept")
    again = clashed.groupBy(*names).agg(F.min("id").alias("kept"), F.max("id").alias("last")).where("kept < last").drop("last")
    rest = clashed.join(hashed(again), names).where("id != kept").select("kept", F.col("id").alias("copy"))
    return sure.unionByName(rest).distinct()


def collapse(df: DataFrame, key: str, forms: dict[str, Column]) -> DataFrame:
    """One row per distinct record: ``kept`` (its smallest key) and ``copies``, the number of records it stands for."""
    links = cut(duplicate_links(df, key, forms))
    more = links.groupBy("kept").agg(F.count("*").alias("more"))
    alone = df.select(F.col(key).alias("kept")).where(F.col("kept").isNotNull()).distinct().join(links.select(F.col("copy").alias("kept")).hint("shuffle_hash"), "kept", "left_anti")
    return alone.join(more.hint("shuffle_hash"), "kept", "left").select("kept", (F.lit(1) + F.coalesce("more", F.lit(0))).cast("bigint").alias("copies"))
