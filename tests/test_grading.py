import pandas as pd
from pyspark.sql import functions as F

from quillstream.operators import grading, search


def rows(spark):
    data = [("q1", "dense index", "A dense index.", 1), ("q1", "dense index", "Only dense.", 2), ("q2", "sparse", "nothing", 1), ("q3", None, None, 1)]
    return spark.createDataFrame(data, "qid string, query string, text string, rank int")


def test_overlap_bands_and_routes(spark):
    graded = rows(spark).withColumn("score", grading.overlap_score(F.col("query"), F.col("text"))).withColumn("grade", grading.grade(F.col("score")))
    assert {(r["qid"], r["rank"]): (r["score"], r["grade"]) for r in graded.collect()} == {("q1", 1): (1.0, "correct"), ("q1", 2): (0.5, "ambiguous"), ("q2", 1): (0.0, "incorrect"), ("q3", 1): (0.0, "incorrect")}
    assert {tuple(r) for r in grading.routes(graded, "qid").collect()} == {("q1", "correct", 2, 2), ("q2", "incorrect", 1, 0), ("q3", "incorrect", 1, 0)}
    unknown = rows(spark).withColumn("grade", F.lit(None).cast("string"))
    assert {r["route"] for r in grading.routes(unknown, "qid").collect()} == {"ambiguous"}


def test_a_scorer_that_fails_drops_nothing(spark):
    def broken(queries: pd.Series, texts: pd.Series) -> pd.Series:
        raise OSError("no model")

    def odd(queries: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series([0.5 if t == "nothing" else 7 for t in texts])

    assert {(r["score"], r["error"]) for r in grading.scored_by(rows(spark), "query", "text", broken).collect()} == {(None, "OSError: no model")}
    got = {r["text"]: (r["score"], r["error"]) for r in grading.scored_by(rows(spark), "query", "text", odd).collect()}
    assert got["nothing"] == (0.5, None) and got["Only dense."] == (None, "invalid")
    assert grading.scored_by(rows(spark).limit(0), "query", "text", odd).collect() == []


def test_contexts_keep_the_order(spark):
    df = rows(spark).withColumn("title", F.lit(" T ")).withColumn("heading", F.lit(None).cast("string"))
    got = {r["qid"]: r["context"] for r in grading.contexts(df, "qid", "rank", "title", "heading", "text", 6).collect()}
    assert got["q1"] == "Document 1\nTitle: T\nA dens...\n---\nDocument 2\nTitle: T\nOnly d..." and got["q3"] == "Document 1\nTitle: T"


def test_new_scores_clear_old_errors(spark):
    df = spark.createDataFrame([({"a": 0.1, "b": 0.2}, {"b": 0.9, "c": None}, {"b": "x", "d": "y"}, {"c": "z"}), (None, None, None, None)], "o map<string,double>, n map<string,double>, oe map<string,string>, ne map<string,string>")
    got = [r[0] for r in df.select(grading.merged_scores(*(F.col(c) for c in ("o", "n", "oe", "ne")))).collect()]
    assert (got[0]["scores"], got[0]["errors"]) == ({"a": 0.1, "b": 0.9}, {"d": "y", "c": "z"}) and (got[1]["scores"], got[1]["errors"]) == ({}, {})


def test_a_weak_query_is_asked_again(spark):
    docs = spark.createDataFrame([(1, "alpha here", "gamma delta"), (2, "gamma delta text", "other"), (3, "unrelated", "none"), (4, "more", "none"), (5, "filler", "none")], "d long, text string, title string")
    asked = spark.createDataFrame([("weak", "alpha beta"), ("strong", "unrelated"), ("none", "zzz")], "q string, query string")
    got = [(r["q"], r["d"], r["round"], r["rank"]) for r in search.corrective(asked, docs, "q", "query", "d", "text", "title").orderBy("q", "rank").collect()]
    assert got == [("strong", 3, 1, 1), ("weak", 2, 2, 1), ("weak", 1, 2, 2)]


def test_labels_fit_their_scores_and_lead_somewhere(spark):
    rows = [("relevant", 0.8), ("relevant", 0.79), ("ambiguous", 0.4), ("ambiguous", 0.8), ("irrelevant", 0.39), ("irrelevant", 0.395), ("irrelevant", 0.4), ("odd", 0.9), (None, 0.9), ("relevant", None)]
    got = spark.createDataFrame(rows, "label string, score double").select(grading.consistent(F.col("label"), F.col("score")), grading.review_route(F.col("label"), F.col("score"))).collect()
    review = "needs_review"
    assert [tuple(r) for r in got] == [
        (True, "accepted"), (False, review), (True, review), (False, review), (True, "rejected"), (True, review), (False, review), (False, review), (False, review), (False, review),
    ]


def test_status_follows_from_key_sets(spark):
    side = lambda *keys: spark.createDataFrame([(k,) for k in keys], "k string")
    row = grading.resolution(side("a", "b", "b", None), side("a", "c"), side("b"), side("c", "a"), "k").first()
    assert (row["ambiguous_candidates"], row["ambiguous_graded"], row["ambiguous_screened"], row["shortlist_graded"], row["status"]) == (2, 1, 1, 2, "complete")
    late = grading.resolution(side("a"), side("a"), side(), side("z"), "k")
    assert late.first()["status"] == "complete_with_deferred_review" and grading.resolution(side("a"), side("a"), side(), side("z"), "k", False).first()["status"] == "provisional"
    assert grading.resolution(side("a"), side(), side(), side(), "k").first()["status"] == "provisional"
