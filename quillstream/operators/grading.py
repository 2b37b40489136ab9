"""Evidence graded by an exchangeable scorer, routed per query, and rendered as context."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import search_terms, shortened, words

# a scorer gets the queries and texts of a batch and gives a score from 0 to 1 for each
Scorer = Callable[[pd.Series, pd.Series], pd.Series]
CORRECT, AMBIGUOUS = 0.8, 0.4


def overlap_score(query: Column, text: Column) -> Column:
    """The scorer that needs no model: the share of the query's content words that stand in the text; 0 for a query without words or a null text."""
    terms = F.coalesce(search_terms(query), F.expr("cast(array() as array<string>)"))
    met = F.size(F.array_intersect(terms, F.coalesce(words(text), F.expr("cast(array() as array<string>)"))))
    return F.when(F.size(terms) > 0, met / F.size(terms)).otherwise(0.0)


def scored_by(df: DataFrame, query: str, text: str, scorer: Scorer, attempts: int = 2) -> DataFrame:
    """``df`` with ``score`` and ``error`` from any scorer, batch by batch in Arrow; a batch that fails ``attempts`` times keeps its rows, with null scores and the reason.

    Scores that are no number from 0 to 1 are null, with the reason ``invalid``. The scorer is sent to the workers once per task, so a model is loaded in it on first use.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            out, why = None, None
            for _ in range(attempts):
                try:
                    out, why = pd.to_numeric(pd.Series(list(scorer(frame[query], frame[text])), index=frame.index, dtype=object), errors="coerce").astype(float), None
                    break
                except Exception as problem:  # noqa: BLE001  whatever the scorer raises is a value here
                    why = f"{type(problem).__name__}: {problem}"[:200]
            if out is None:
                yield frame.assign(score=None, error=why)
            else:
                valid = out.between(0, 1)
                yield frame.assign(score=out.where(valid), error=valid.map({True: None, False: "invalid"}))

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInPandas(run, f"{types}, score double, error string")


def grade(score: Column) -> Column:
    """correct, ambiguous or incorrect by the bands of the score; a null score is ambiguous, so that a failed scorer drops nothing."""
    return F.when(score >= CORRECT, "correct").when(score.isNull() | (score >= AMBIGUOUS), "ambiguous").otherwise("incorrect")


def consistent(label: Column, score: Column) -> Column:
    """Whether a label fits its score: relevant from 0.8 on, irrelevant below 0.4, ambiguous between; nulls and other labels do not fit."""
    fits = F.when(label == "relevant", score >= CORRECT).when(label == "ambiguous", (score >= AMBIGUOUS) & (score < CORRECT)).when(label == "irrelevant", score < AMBIGUOUS)
    return F.coalesce(fits, F.lit(False))


def review_route(label: Column, score: Column, accepted: float = 0.8, rejected: float = 0.39) -> Column:
    """accepted, rejected, or needs_review for all else, nulls among it."""
    return F.when((label == "relevant") & (score >= accepted), "accepted").when((label == "irrelevant") & (score <= rejected), "rejected").otherwise("needs_review")


def resolution(ambiguous: DataFrame, graded: DataFrame, screened: DataFrame, shortlist: DataFrame, key: str, deferred_allowed: bool = True) -> DataFrame:
    """One row of counts of distinct keys and what follows from them: is every ambiguous key graded or screened, every one of the shortlist graded, and the ``status``. Null keys are left out.

    Keys of all four sides are grouped once.
    """
    sides = {"ambiguous": ambiguous, "graded": graded, "screened": screened, "shortlist": shortlist}
    rows = None
    for name, side in sides.items():
        one = side.select(F.col(key).alias("k"), F.lit(name).alias("side")).where("k is not null").distinct()
        rows = one if rows is None else rows.unionByName(one)
    has = rows.groupBy("k").agg(*(F.bool_or(F.col("side") == n).alias(n) for n in sides))
    a, g, s, h = (F.col(n) for n in sides)
    counts = has.agg(
        F.count_if(a).alias("ambiguous_candidates"), F.count_if(a & g).alias("ambiguous_graded"), F.count_if(a & s).alias("ambiguous_screened"), F.count_if(h).alias("screening_shortlist"),
        F.count_if(h & g).alias("shortlist_graded"), F.count_if(h & ~g).alias("deferred_review"), (F.count_if(a & ~g & ~s) == 0).alias("screening_complete"),
    )
    whole = F.col("deferred_review") == 0
    status = F.when(F.col("screening_complete") & whole, "complete").when(F.col("screening_complete") & F.lit(deferred_allowed), "complete_with_deferred_review").otherwise("provisional")
    return counts.select("*", whole.alias("shortlist_grading_complete"), status.alias("status"))


def routes(graded: DataFrame, key: str, grade_: str = "grade") -> DataFrame:
    """``key, route, documents, useful``: the best grade among a query's documents, and how many are not incorrect (null grades among them)."""
    has = lambda g: F.coalesce(F.bool_or(F.col(grade_) == g), F.lit(False))
    useful = F.count_if(~F.col(grade_).eqNullSafe(F.lit("incorrect")))
    route = F.when(has("correct"), "correct").when(useful > 0, "ambiguous").otherwise("incorrect")
    return graded.groupBy(key).agg(route.alias("route"), F.count("*").alias("documents"), useful.alias("useful"))


def contexts(evidence: DataFrame, key: str, rank: str, title: str, heading: str, text: str, most: int = 2400) -> DataFrame:
    """``key, context``: a query's documents in order of rank, each with its labels and at most ``most`` characters of text, a line of dashes between them."""
    some = lambda label, c: F.when(F.trim(F.col(c)) != "", F.concat(F.lit(label), F.trim(F.col(c))))
    shown = F.concat_ws("\n", F.concat(F.lit("Document "), F.col(rank).cast("string")), some("Title: ", title), some("Section: ", heading), shortened(F.trim(F.col(text)), most))
    ordered = F.array_sort(F.collect_list(F.struct(F.col(rank).alias("rank"), shown.alias("shown"))))
    return evidence.groupBy(key).agg(F.array_join(F.transform(ordered, lambda s: s["shown"]), "\n---\n").alias("context"))


def merged_scores(old: Column, new: Column, old_errors: Column, new_errors: Column) -> Column:
    """Two sets of scores (map of name to value) and of errors as one struct: new values replace old ones and clear their errors, new errors are added."""
    empty = lambda kind: F.expr(f"cast(map() as map<string,{kind}>)")
    fresh = F.map_filter(F.coalesce(new, empty("double")), lambda _, v: v.isNotNull())
    kept = F.map_filter(F.coalesce(old, empty("double")), lambda k, _: ~F.map_contains_key(fresh, k))
    bad = F.coalesce(new_errors, empty("string"))
    past = F.map_filter(F.coalesce(old_errors, empty("string")), lambda k, _: ~F.map_contains_key(fresh, k) & ~F.map_contains_key(bad, k))
    return F.struct(F.map_concat(kept, fresh).alias("scores"), F.map_concat(past, bad).alias("errors"))


def route_counts(rows: DataFrame, route: str, target: int) -> DataFrame:
    """One row: how many rows are accepted, rejected or need review (all else, nulls among it), and how many accepted ones the target still lacks."""
    accepted, rejected = F.count_if(F.col(route) == "accepted"), F.count_if(F.col(route) == "rejected")
    return rows.agg(
        accepted.alias("accepted"), rejected.alias("rejected"), (F.count("*") - accepted - rejected).alias("needs_review"),
        F.greatest(F.lit(target) - accepted, F.lit(0)).alias("lacking"),
    )
