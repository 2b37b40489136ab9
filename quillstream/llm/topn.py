"""The N best items of every group, found in descending score bands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.runtime import cut

FEW = 100_000  # names of groups that are broadcast at most


def _usable(score: Column) -> Column:
    return score.isNotNull() & ~F.isnan(score)


def band_edges(rows: DataFrame, score: str, shares: tuple[float, ...]) -> list[float]:
    """Lower bounds of all bands but the last, highest first; a few numbers, whatever the input."""
    found = rows.agg(F.percentile_approx(score, [1 - s for s in shares], 1000).alias("q")).first()["q"]
    return sorted(set(found or []), reverse=True)


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, tie: str | None = None, n: int = 3, shares: tuple[float, ...] = (0.02, 0.2)) -> DataFrame:
    """The ``n`` items of each group with the highest ``score``, then highest ``tie``, then smallest ``item``.

    The score range is cut into bands that hold the given ``shares`` of the rows from the top. Groups that the bands above have filled are left out of a band (anti-join, against
    a broadcast table while they are at most ``FEW``), so that the rows of a large group are mostly dropped where they are read. Of the rest only the ``2 n`` first rows of each group leave their map task, and what lies in
    the band that fills a group is ranked exactly, so a group of any size is never gathered. Where so few items
    have so many rows that ``2 n`` rows don't hold ``n`` items, the group's items of the band are reduced to their best rows first.

    Result: ``group, item, score, tie, rank`` with ranks from 1. Rows with null group, null item or null or NaN score do not
    count. A null or NaN ``tie`` ranks below every number. An item that occurs more than once in a group counts once, with its best row.
    Equal scores and ties fall to the smaller item. An empty table gives an empty result. Other columns are not looked at.
    """
    if n <= 0:
        raise ValueError("n must be positive")
    second = F.col(tie).cast("double") if tie else F.lit(None).cast("double")
    rows = df.where(F.col(group).isNotNull() & F.col(item).isNotNull() & _usable(F.col(score).cast("double"))).select(
        F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), F.when(_usable(second), second).alias("t")
    )
    order = [F.desc("s"), F.desc_nulls_last("t"), F.asc("i")]
    single = lambda d: d.groupBy("g", "i").agg(F.max(F.struct("s", "t")).alias("best")).select("g", "i", "best.s", "best.t")
    best = lambda d, most: d.withColumn("r", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("r") <= most).drop("r")
    edges = band_edges(rows, "s", shares)
    kept: DataFrame | None = None
    upper = None
    for lower in [*edges, None]:
        band = rows
        if lower is not None:
            band = band.where(F.col("s") >= lower)
        if upper is not None:
            band = band.where(F.col("s") < upper)
        filled, few = None, True
        if kept is not None:
            filled = cut(kept.groupBy("g").agg(F.count_distinct("i").alias("n")).where(F.col("n") >= n).select("g"))
            few = filled.count() <= FEW
            if few:
                band = band.join(F.broadcast(filled), "g", "left_anti")
        near = best(band, 2 * n)
        found = cut(near if few else near.join(filled, "g", "left_anti"))
        # at most n - 1 items are kept from above, so n items surely hold those that fill the group; fewer do if these are all rows there are
        short = cut(found.groupBy("g").agg(F.count("*").alias("rows"), F.count_distinct("i").alias("n")).where((F.col("rows") == 2 * n) & (F.col("n") < n)).select("g"))
        if not short.isEmpty():
            found = found.join(short, "g", "left_anti").unionByName(cut(best(single(band.join(short, "g", "left_semi")), n)))
        kept = found if kept is None else kept.unionByName(found)
        upper = lower
    once = kept.withColumn("k", F.row_number().over(Window.partitionBy("g", "i").orderBy(F.desc("s"), F.desc_nulls_last("t")))).where("k = 1")
    ranked = once.withColumn("rank", F.row_number().over(Window.partitionBy("g").orderBy(*order))).where(F.col("rank") <= n)
    out = [F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score)]
    return ranked.select(*out, *([F.col("t").alias(tie)] if tie else []), "rank")
