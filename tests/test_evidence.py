from pyspark.sql import functions as F

from quillstream.functions import ids, nested
from quillstream.operators import dedup, evidence, grading, joins, search


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def test_ids_are_repaired_both_ways_and_within_groups(spark):
    known = spark.createDataFrame([("g", "W1-chunk-abcdef"), ("g", "W1-chunk-abcxyz"), ("g", "W2-chunk-1"), ("h", "W1-chunk-abcdef"), (None, "W9-chunk-1")], "grp string, k string")
    given = [("g", "W1-chunk-abcd"), ("g", "W1-chunk-abc"), ("g", "W2-chunk-1-more"), ("g", "W2-chunk-1"), ("g", "W2"), ("h", "W1-chunk-abc"), ("h", "W2-chunk-1"), (None, "W9-chunk-1"), ("g", None), ("g", "W2")]
    found = joins.repaired_ids(spark.createDataFrame(given, "grp string, k string"), known.withColumnRenamed("k", "real"), "k", "real", by=["grp"])
    assert set(rows_of(found)) == {
        ("g", "W1-chunk-abcd", "W1-chunk-abcdef"), ("g", "W1-chunk-abc", None), ("g", "W2-chunk-1-more", "W2-chunk-1"), ("g", "W2-chunk-1", "W2-chunk-1"), ("g", "W2", None), ("h", "W1-chunk-abc", "W1-chunk-abcdef"),
        ("h", "W2-chunk-1", None), (None, "W9-chunk-1", None),
    }
    assert joins.repaired_ids(known.limit(0), known.withColumnRenamed("k", "real"), "k", "real").collect() == []
    nothing = joins.repaired_ids(known, known.withColumnRenamed("k", "real").limit(0), "k", "real", by=["grp"])
    assert nothing.count() == 5 and nothing.where("real is not null").isEmpty()


def test_a_beginning_of_many_ids_means_none_of_them(spark):
    known = spark.range(2000).select(F.concat(F.lit("hot-paper-chunk-"), F.lpad(F.col("id").cast("string"), 4, "0")).alias("real"))
    given = spark.createDataFrame([("hot-paper-chunk-",), ("hot-paper-chunk-000",), ("hot-paper-chunk-0007",), ("hot-paper-chunk-0007x",)], "g string")
    assert dict(rows_of(joins.repaired_ids(given, known, "g", "real"))) == {"hot-paper-chunk-": None, "hot-paper-chunk-000": None, "hot-paper-chunk-0007": "hot-paper-chunk-0007", "hot-paper-chunk-0007x": "hot-paper-chunk-0007"}


def test_the_first_grade_counts_and_ungraded_documents_are_kept(spark):
    docs = spark.createDataFrame([("q", "doc-aaaa-1", 7), ("q", "doc-bbbb-1", 8), ("r", "doc-aaaa-1", 9)], "q string, d string, grade_of int")
    grades = spark.createDataFrame([("q", "doc-aaaa", 2, "correct"), ("q", "doc-aaaa-1", 1, "incorrect"), ("q", "doc-zzzz", 0, "correct"), ("q", None, 0, "correct")], "q string, given string, at int, grade string")
    found = evidence.graded(docs, grades, ["q"], "d", "given", "at", "grade", "ambiguous")
    assert set(rows_of(found.select("q", "d", "grade_of", "grade"))) == {("q", "doc-aaaa-1", 7, "incorrect"), ("q", "doc-bbbb-1", 8, "ambiguous"), ("r", "doc-aaaa-1", 9, "ambiguous")}
    same = evidence.graded(docs, grades.withColumnRenamed("given", "d"), ["q"], "d", "d", "at", "grade", "ambiguous")
    assert same.where("grade = 'incorrect'").count() == 1
    assert evidence.graded(docs, grades.limit(0), ["q"], "d", "given", "at", "grade", "ambiguous").where("grade = 'ambiguous'").count() == 3


def test_citations_keep_their_order_and_the_last_document_counts(spark):
    answers = spark.createDataFrame([(1, ["b", "a", "x", "b", None]), (2, []), (3, None)], "k int, s array<string>")
    docs = spark.createDataFrame([(1, "a", 1, "old"), (1, "a", 2, "new"), (1, "b", 1, None), (2, "x", 1, "other")], "k int, id string, at int, title string")
    got = {r["k"]: ([tuple(c) for c in r["citations"]], r["missing"]) for r in evidence.citations(answers, docs, "k", "s", "id", "at", ["title"]).collect()}
    assert got == {1: ([("b", None), ("a", "new"), ("b", None)], ["x", None]), 2: ([], []), 3: ([], [])}


def test_web_results_count_once_by_address(spark):
    data = [(2, "https://a.example/x", " T ", "later"), (1, " https://a.example/x ", None, " first text "), (3, "ftp://a.example", "T", "t"), (4, "https://b.example", "T", "  "), (5, None, "T", "t"), (6, "http://c.example", "", "x" * 30), (7, "https://", "T", "t")]
    got = evidence.web_evidence(spark.createDataFrame(data, "n int, u string, t string, c string"), "u", "t", "c", ["n"], 10)
    assert {(r["url"], r["title"], r["text"]) for r in got.collect()} == {("https://a.example/x", "Untitled web source", "first text"), ("http://c.example", "Untitled web source", "x" * 10 + "...")}
    assert all(r["source_id"].startswith("web-") and len(r["source_id"]) == 16 for r in got.collect())
    named = evidence.as_evidence(spark.createDataFrame([("c", "W1"), ("d", "x"), ("e", None)], "c string, p string"), "c", "p", "https://w/")
    assert [r["url"] for r in named.orderBy("c").collect()] == ["https://w/W1", None, None]


def test_a_second_score_orders_results(spark):
    data = [("q", "a", 0.1, 1, None), ("q", "b", 0.09, 2, 0.5), ("q", "c", 0.08, 3, float("nan")), ("q", "d", 0.07, 4, 0.5), ("r", "a", 0.1, 1, -1.0)]
    found = search.reranked(spark.createDataFrame(data, "q string, d string, score double, rank int, rerank_score double"), "q")
    assert [(r["q"], r["d"]) for r in found.orderBy("q", "rank").collect()] == [("q", "b"), ("q", "d"), ("q", "a"), ("q", "c"), ("r", "a")]


def test_hybrid_search_takes_any_second_scorer(spark):
    docs = spark.createDataFrame([(k, f"p{k}", f"alpha {'beta ' * k}", [1.0, float(k)] + [0.0] * 62) for k in range(1, 8)], "d long, p string, t string, v array<double>")
    asked = spark.createDataFrame([("q", "alpha")], "q string, query string")
    plain = search.hybrid(asked, docs, "q", "query", "d", "p", "t", "v")
    again = search.hybrid(asked, docs, "q", "query", "d", "p", "t", "v", rerank=lambda rows: rows.withColumn("rerank_score", F.col("d").cast("double")))
    assert plain.columns == again.columns and {r["d"] for r in plain.collect()} == {r["d"] for r in again.collect()}
    assert [r["d"] for r in again.orderBy("rank").collect()] == list(range(7, 0, -1))


def test_fields_of_newer_records_replace_older_ones(spark):
    old = spark.createDataFrame([("a", "t1", "d1"), ("a", "t2", "d2"), ("b", "t3", "d3"), (None, "t4", "d4")], "k string, title string, doi string")
    new = spark.createDataFrame([("a", None, "n", ["title"]), ("c", "x", "y", ["title", "doi"])], "k string, title string, doi string, has array<string>")
    assert set(rows_of(joins.overlaid(old, new, "k", ["title", "doi"], "has"))) == {("a", None, "d1", True), ("a", None, "d2", True), ("b", "t3", "d3", False), (None, "t4", "d4", False)}


def test_numbers_within_groups_whatever_their_size(spark):
    df = spark.range(1000).select(F.when(F.col("id") % 10 < 6, "hot").when(F.col("id") % 10 < 8, "warm").alias("g"), (F.lit(1000) - F.col("id")).alias("o"), F.lit(0).alias("n"))
    got = dedup.numbered_within(df, "g", ["o"], "place", 70).collect()
    for g in ("hot", "warm", None):
        rows = sorted((r["o"], r["place"]) for r in got if r["g"] == g)
        assert rows and [p for _, p in rows] == list(range(1, len(rows) + 1))
    assert len(got) == 1000 and dedup.numbered_within(df.limit(0), "g", ["o"], "place").collect() == []


def test_addresses(spark):
    data = [("https://a.example/p?x=1&api_key=old&y=#top",), ("https://a.example/p",), (None,), ("https://b.example/?q",)]
    df = spark.createDataFrame(data, "u string")
    assert [r[0] for r in df.select(ids.with_parameter(F.col("u"), "api_key", F.lit("k 1"))).collect()] == ["https://a.example/p?x=1&y=&api_key=k+1#top", "https://a.example/p?api_key=k+1", None, "https://b.example/?q&api_key=k+1"]
    keyed = lambda has, key: [r[0] for r in df.select(ids.keyed_url(F.lit(has), F.col("u"), "a.example", "api_key", F.lit(key))).collect()]
    assert keyed(True, "k")[1:] == ["https://a.example/p?api_key=k", None, None] and keyed(False, "k") == [None] * 4 and keyed(True, " ") == [None] * 4 and keyed(None, "k") == [None] * 4
    heads = spark.createDataFrame([({"n": " 1.5 "},), ({"n": "x"},), ({},), (None,)], "h map<string,string>")
    assert [r[0] for r in heads.select(ids.header_number(F.col("h"), "n")).collect()] == [1.5, None, None, None]
    asks = spark.createDataFrame([("Events after the local corpus?",), ("Any RETRACTIONS?",), ("detraction",), (None,)], "q string")
    assert [r[0] for r in asks.select(ids.asks_for_fresh(F.col("q"))).collect()] == [True, True, False, False]
    assert spark.range(1).select(ids.first_work_id(F.lit(None).cast("string"), F.lit("x"), F.lit("http://w/w12"), F.lit("W3"))).first()[0] == "W12"


def test_labels_answers_and_limits(spark):
    data = [("see [a] [b]", ["a", "b"], ["a", "b"]), ("see [a]", ["a", "b"], ["b", "a"]), ("[z]", ["z"], ["a"]), ("x", [], ["a"]), (None, ["a"], ["a"]), ("[a]", ["a"], None)]
    df = spark.createDataFrame(data, "t string, s array<string>, e array<string>")
    assert [r[0] for r in df.select(nested.answer_problem(F.col("t"), F.col("s"), F.col("e"))).collect()] == [None, "not cited", "unknown source", "no source", "not cited", "unknown source"]
    lists = spark.createDataFrame([(["a"], ["b", "a"]), (["a", "a"], []), (None, ["b"]), (None, None)], "o array<string>, n array<string>")
    assert [r[0] for r in lists.select(nested.united(F.col("o"), F.col("n"))).collect()] == [["a", "b"], ["a", "a"], ["b"], None]
    cut = spark.createDataFrame([(("ab   cd", "x"),), ((None, "y"),), (None,)], "v struct<t:string,u:string>").select(nested.limited(F.col("v"), {"t": 4}).alias("v")).collect()
    assert [r[0] and tuple(r[0]) for r in cut] == [("ab", "x"), (None, "y"), None]
    one = spark.range(1).select(nested.output_budget(F.lit(3)), nested.output_budget(F.lit(0)), nested.known(F.lit(float("nan"))), nested.first_shortened(F.array(F.lit("abc"), F.lit("d"), F.lit("e")), 2, 2)).first()
    assert tuple(one) == (544, None, None, ["ab", "d"])


def test_route_counts(spark):
    routes = spark.createDataFrame([("accepted",), ("accepted",), ("rejected",), ("odd",), (None,)], "r string")
    assert tuple(grading.route_counts(routes, "r", 5).first()) == (2, 1, 2, 3) and tuple(grading.route_counts(routes.limit(0), "r", 1).first()) == (0, 0, 0, 1)


def test_articles_of_journals(spark):
    urls = ["https://WWW.j.example/1234-567X/17/2/133/pdf?v=1", "https://j.example/1234-5678/17/2/133", "https://j.example/1234-5678/17/2", "https://j.example/12-5678/1/2/3", "https://j.example/1234-5678/x/2/3", None]
    df = spark.createDataFrame([(u,) for u in urls], "u string")
    got = [r[0] and tuple(r[0]) for r in df.select(ids.article_parts(F.col("u"), ["www.j.example"])).collect()]
    assert got == [("1234-567X", 17, 133), None, None, None, None, None]
    names = spark.createDataFrame([(" Applied Things ", "https://doi.example/10.55/ABC123"), ("The A-B", None), (None, "10.55/1"), ("", None)], "j string, d string")
    assert [r[0] for r in names.select(ids.slug_candidates(F.col("j"), F.col("d"), {"applied things": "abc"}, "10[.]55")).collect()] == [["abc", "appliedthings"], ["theab"], [], []]
    at = spark.createDataFrame([("ai", 6, 226), ("ai", 123, 1234567), (None, 1, 2)], "s string, v int, a int")
    assert [r[0] for r in at.select(ids.deployed_address("https://c.example/d/", F.col("s"), F.col("v"), F.col("a"))).collect()] == [
        "https://c.example/d/ai/ai-06-00226/article_deploy/ai-06-00226.pdf", "https://c.example/d/ai/ai-123-1234567/article_deploy/ai-123-1234567.pdf", None,
    ]
