"""Joins that the relational ones only lead to: coverage of key sets, repaired ids, budgeted merges."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.runtime import cut


def key_coverage(sides: dict[str, DataFrame], key: str) -> DataFrame:
    """``present_in, keys``: for each combination of the named sides how many distinct keys are in exactly these; null keys are left out.

    One pass: keys of all sides are grouped once instead of joined pair by pair.
    """
    both = None
    for name, side in sides.items():
        rows = side.select(F.col(key).alias("k"), F.lit(name).alias("side")).where("k is not null").distinct()
        both = rows if both is None else both.unionByName(rows)
    where = both.groupBy("k").agg(F.array_join(F.array_sort(F.collect_set("side")), "+").alias("present_in"))
    return where.groupBy("present_in").agg(F.count("*").alias("keys"))


def repaired_ids(given: DataFrame, known: DataFrame, left: str, right: str, least: int = 8, by: Sequence[str] = ()) -> DataFrame:
    """``by, left, right``: each given id with the id it means: itself, else the only known one of which it is the beginning or that is its beginning; else null.

    Given ids shorter than ``least`` can only mean themselves. With ``by`` only known ids of the same group count; a null group has none. No pairs are formed: the
    beginnings of known ids, of each length that given ids have, are counted per beginning before they are joined, and the other way round. What comes to the driver is
    the set of lengths.
    """
    by = list(by)
    a = given.select(*by, F.col(left).alias("__a")).where("__a is not null").distinct()
    b = known.select(*by, F.col(right).alias("__b")).where("__b is not null").distinct()
    exact = cut(a.join(b.select(*by, F.col("__b").alias("__a"), F.col("__b").alias("__same")), [*by, "__a"], "left"))
    open_ = exact.where("__same is null").select(*by, "__a").where(F.length("__a") >= least)
    lengths = lambda d, c: [r[0] for r in d.select(F.length(c)).distinct().collect()]
    starts = lambda c, sizes: F.explode(F.filter(F.array(*map(F.lit, sizes)).cast("array<int>"), lambda n: n < F.length(c)))
    heads = b.select(*by, "__b", starts("__b", lengths(open_, "__a")).alias("__n")).groupBy(*by, F.left("__b", F.col("__n")).alias("__a")).agg(F.min("__b").alias("__b"), F.count("*").alias("__m"))
    longer = open_.join(heads, [*by, "__a"])
    tails = open_.select(*by, "__a", starts("__a", lengths(b, "__b")).alias("__n")).select(*by, "__a", F.left("__a", F.col("__n")).alias("__b"))
    shorter = tails.join(b, [*by, "__b"]).select(*by, "__a", "__b", F.lit(1).cast("bigint").alias("__m"))
    one = longer.unionByName(shorter).groupBy(*by, "__a").agg(F.min("__b").alias("__b"), F.sum("__m").alias("__m")).where("__m = 1").drop("__m")
    return exact.join(one, [*by, "__a"], "left").select(*by, F.col("__a").alias(left), F.coalesce("__same", "__b").alias(right))


def overlaid(stale: DataFrame, fresh: DataFrame, key: str, fields: Sequence[str], present: str) -> DataFrame:
    """``stale`` with the ``fields`` that its row of ``fresh`` names in the array ``present``, their nulls too, and ``refreshed``: was there such a row. ``fresh`` has one row per key; null keys meet none."""
    new = fresh.select(key, F.struct(F.coalesce(present, F.expr("cast(array() as array<string>)")).alias("names"), *fields).alias("__new"))
    both = stale.join(new, key, "left")
    value = lambda c: F.when(F.array_contains("__new.names", F.lit(c)), F.col(f"__new.{c}")).otherwise(F.col(c)).alias(c)
    return both.select(*(value(c) if c in fields else F.col(c) for c in stale.columns), F.col("__new").isNotNull().alias("refreshed"))


def budget_merge(first: DataFrame, second: DataFrame, group: str, item: str, most: int) -> DataFrame:
    """``group, item, rank``: at most ``most`` distinct items per group from two ranked lists: half (rounded down) from the first, the rest from the second, then what is left of both in order."""
    if most <= 0:
        raise ValueError("most must be positive")
    half = most // 2
    over = lambda d, side, budget: d.select(group, item, F.lit(side).alias("side"), "rank", (F.col("rank") > budget).cast("int").alias("tier"))
    both = over(first, 0, half).unionByName(over(second, 1, most - half))
    order = [F.asc("tier"), F.asc("side"), F.asc("rank")]
    once = both.withColumn("r", F.row_number().over(Window.partitionBy(group, item).orderBy(*order))).where("r = 1").drop("r")
    return once.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("place") <= most).select(group, item, F.col("place").alias("rank"))
