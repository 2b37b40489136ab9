"""Records of runs that can be resumed: the newest of each key, what is done, what is still open."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def compacted(records: DataFrame, keys: Sequence[str], place: str) -> DataFrame:
    """The last record of each key by the unique column ``place``, null keys being keys, with ``first_place``: where its key was first seen. One aggregation that combines in the map tasks."""
    others = [c for c in records.columns if c not in keys]
    rows = records.groupBy(*keys).agg(F.max_by(F.struct(*others), F.col(place)).alias("__last"), F.min(place).alias("first_place"))
    return rows.select(*keys, *(F.col(f"__last.{c}").alias(c) for c in others), "first_place")


def _answered(error: Column, answer: Column) -> Column:
    return (F.coalesce(error, F.lit("")) == "") & (F.trim(F.coalesce(answer, F.lit(""))) != "")


def needs_scores(error: Column, answer: Column, scores: Column, errors: Column) -> Column:
    """Whether an answer without error has no usable score: no scores at all, or errors and nothing but null scores. ``scores`` and ``errors`` are maps by name."""
    failed = (F.coalesce(F.cardinality(errors), F.lit(0)) > 0) & F.forall(F.map_values(scores), lambda v: v.isNull())
    return _answered(error, answer) & (scores.isNull() | F.coalesce(failed, F.lit(False)))


def missing_scores(error: Column, answer: Column, scores: Column, errors: Column, names: Sequence[str]) -> Column:
    """The named scores that an answer still needs: all without scores, else those with an error; none for no answer or one with an error."""
    wanted = F.array(*map(F.lit, names))
    failed = F.array_intersect(wanted, F.coalesce(F.map_keys(errors), F.expr("cast(array() as array<string>)")))
    return F.when(~_answered(error, answer), F.slice(wanted, 1, 0)).when(scores.isNull(), wanted).otherwise(failed)


def completed(error: Column, answer: Column, scores: Column, errors: Column, judged: bool = True) -> Column:
    """Whether a record needs no further run: no error and, where scores are wanted (``judged``), usable ones."""
    fine = F.coalesce(error, F.lit("")) == ""
    return fine & ~needs_scores(error, answer, scores, errors) if judged else fine


def open_pairs(examples: DataFrame, key: str, runs: Sequence[str], done: DataFrame, run: str) -> DataFrame:
    """``run, key``: every example with every named run, without the pairs in ``done``."""
    pairs = examples.select(F.explode(F.array(*map(F.lit, runs))).alias(run), key).distinct()
    return pairs.join(done.select(run, key).distinct(), [run, key], "left_anti")
