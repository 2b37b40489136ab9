"""First, last and multi-key duplicates, where order decides."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.runtime import cut


def pick(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in ``order``, which must be total. Null keys are one key."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("__rank", rank).where("__rank = 1").drop("__rank")


def ordered_union(first: DataFrame, second: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows of both sides, distinct by ``keys``: those of the first side win, then ``order``; column ``side`` is 0 or 1."""
    both = first.withColumn("side", F.lit(0)).unionByName(second.withColumn("side", F.lit(1)))
    return pick(both, keys, [F.col("side"), *order])


def merged_lists(df: DataFrame, key: str, values: str, order: str) -> DataFrame:
    """Per key the distinct list values in order of first sight (row order, then place in the list): ``key, values, first``; null keys are left out."""
    seen = df.where(F.col(key).isNotNull()).select(key, F.col(order).alias("row"), F.posexplode(values).alias("place", "value"))
    first = seen.groupBy(key, "value").agg(F.min(F.struct("row", "place")).alias("at"))
    lists = first.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias(values))
    rows = df.where(F.col(key).isNotNull()).groupBy(key).agg(F.min(order).alias("first"))
    return rows.join(lists, key, "left").select(key, F.coalesce(values, F.expr("cast(array() as array<string>)")).alias(values), "first")


def greedy_first(df: DataFrame, order: str, keys: list[str]) -> DataFrame:
    """``order, kept, reason, holder``: rows in order of the unique column ``order``; a row is dropped if one of its keys was seen in a row that was kept.

    ``reason`` is the first such key and ``holder`` the kept row that has it, null for kept rows; null and '' keys never match. This does not carry over: a row
    that only matches a dropped row stays. Each round settles every row all of whose earlier rivals are settled: the first open row of each of its keys is
    kept, and rows that share a key with a kept row are dropped. At least the first open row is settled in each round, and rounds go on until none is open; a chain of rivals ends at its first kept row, so they are
    few. Each is two aggregations and joins by key, counted map-side, so that a key of any frequency is no burden.
    """
    long = df.select(F.col(order).alias("row"), F.explode(F.array(*(F.struct(F.lit(j).alias("rank"), F.col(k).cast("string").alias("key")) for j, k in enumerate(keys)))).alias("k"))
    edges = cut(long.select("row", "k.rank", F.col("k.key").alias("key")).where("key is not null and key != ''").distinct())
    open_ = edges
    winners: DataFrame | None = None
    while not open_.isEmpty():
        first = open_.groupBy("rank", "key").agg(F.min("row").alias("first"))
        led = open_.join(first, ["rank", "key"])
        leaders = led.groupBy("row").agg(F.every(F.col("row") == F.col("first")).alias("leads")).where("leads").select("row")
        taken = cut(open_.join(leaders, "row").select("row", "rank", "key"))
        winners = taken if winners is None else winners.unionByName(taken)
        settled = open_.join(taken.select("rank", "key"), ["rank", "key"], "left_semi").select("row").distinct()
        open_ = cut(open_.join(settled, "row", "left_anti"))
    # a key is held by at most one kept row; it counts against the rows after it
    held = (edges.limit(0) if winners is None else winners).select("rank", "key", F.col("row").alias("holder"))
    why = edges.join(held, ["rank", "key"]).where("holder < row").groupBy("row").agg(F.min(F.struct("rank", "holder")).alias("why"))
    names = F.array(*(F.lit(k) for k in keys))
    out = df.select(F.col(order).alias("row")).join(why, "row", "left")
    return out.select(F.col("row").alias(order), F.col("why").isNull().alias("kept"), F.when(F.col("why").isNotNull(), F.get(names, F.col("why.rank"))).alias("reason"), F.col("why.holder").alias("holder"))


def accepted_records(df: DataFrame, order: str, keys: list[str], value: str) -> DataFrame:
    """``order, values, matches``: the rows that ``greedy_first`` keeps, each with the distinct ``value``s of itself and of the rows it stands for, in order, and their number. Null values are left out."""
    found = greedy_first(df, order, keys).select(F.col(order).alias("row"), F.coalesce("holder", order).alias("kept_as"))
    seen = df.select(F.col(order).alias("row"), F.col(value).alias("value")).where("value is not null").join(found, "row")
    first = seen.groupBy("kept_as", "value").agg(F.min("row").alias("at"))
    lists = first.groupBy("kept_as").agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "value"))), lambda x: x["value"]).alias("values"))
    out = found.select("kept_as").distinct().join(lists, "kept_as", "left")
    return out.select(F.col("kept_as").alias(order), F.coalesce("values", F.expr("cast(array() as array<string>)")).alias("values"), F.coalesce(F.size("values"), F.lit(0)).alias("matches"))


def numbered(df: DataFrame, order: list[str], name: str = "number", rows_a_part: int = 500_000) -> DataFrame:
    """Consecutive numbers from 0 in ``order``, without gathering all rows in one task: ranges of about ``rows_a_part`` rows are sorted apart and start where the counts before them end."""
    parts = max(1, -(-df.count() // rows_a_part))
    ranged = cut(df.repartitionByRange(parts, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy("__part").agg(F.count("*").alias("n"))
    starts = counts.select("__part", F.coalesce(F.sum("n").over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(*order))
    return ranged.join(starts, "__part").withColumn(name, F.col("__start") + inside - 1).drop("__part", "__start")


def numbered_within(df: DataFrame, group: str, order: list[str], name: str = "number", rows_a_part: int = 500_000) -> DataFrame:
    """Consecutive numbers from 1 in ``order`` within each group, null being one, where a group of any size is spread over several tasks.

    Ranges of (group, order) are sorted apart, and those of a group start where its counts in earlier ranges end. Ties of ``order`` get numbers in no certain order.
    """
    parts = max(1, -(-df.count() // rows_a_part))
    ranged = cut(df.repartitionByRange(parts, group, *order).withColumn("__part", F.spark_partition_id()))
    counts = ranged.groupBy(F.col(group).alias("__group"), F.col("__part").alias("__of")).agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("__group").orderBy("__of").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("__group", "__of", F.coalesce(before, F.lit(0)).alias("__start"))
    inside = F.row_number().over(Window.partitionBy("__part", group).orderBy(*order))
    placed = ranged.withColumn("__inside", inside).join(starts, (F.col("__part") == F.col("__of")) & F.col(group).eqNullSafe(F.col("__group")))
    return placed.withColumn(name, F.col("__start") + F.col("__inside")).drop("__part", "__of", "__group", "__start", "__inside")
