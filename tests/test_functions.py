import math
import re

import pytest
from pyspark.sql import functions as F

from quillstream.functions import ids, nested, text


def one(spark, value, kind, expr):
    return spark.createDataFrame([(value,)], f"v {kind}").select(expr(F.col("v"))).first()[0]


TEXTS = [None, "", "  ", "a  b c\n\td", "naïve_x é́ 名前1.5!?", " x​y", "a" * 20000, "\x1cx\x85y"]


def test_tokens_equal_python(spark):
    rows = spark.createDataFrame([(t,) for t in TEXTS], "t string").select("t", text.token_count(F.col("t")), text.squeeze(F.col("t")), text.words(F.col("t")), text.last_tokens(F.col("t"), 2)).collect()
    for t, n, squeezed, words, tail in rows:
        if t is None:
            assert n is None and squeezed is None
            continue
        found = [m.start() for m in re.finditer(r"\w+|[^\w\s]", t)]
        assert n == len(found) and squeezed == " ".join(t.split()) and words == re.findall(r"\w+", t.lower())
        assert tail == ("" if not found else t[found[-2] if len(found) > 2 else found[0] :].strip(" ") if len(found) > 2 else tail)


def test_search_terms(spark):
    terms = lambda q: one(spark, q, "string", text.search_terms)
    assert terms('What is a "dense-retriever" vs. Dense index?') == ["dense", "retriever", "vs", "index"]
    assert terms("what is it") == ["what", "is", "it"] and terms("") == [] and terms(None) is None


def test_phrases_are_whole_words(spark):
    rows = [("The  Index holds C++ (and) a.b", p) for p in ("index", "ndex", "INDEX HOLDS", "c++", "", None, "a.b", "(and)", r"\E")]
    got = spark.createDataFrame(rows, "t string, p string").select(text.has_phrase(F.col("t"), F.col("p"))).collect()
    assert [r[0] for r in got] == [True, False, True, True, False, False, True, True, False]


def test_section_types(spark):
    kinds = [one(spark, h, "string", text.section_type) for h in ("2.1 Methodology", "Experimental Setup", "Results and Discussion", "Related Work", "", None)]
    assert kinds == ["methods", "methods", "results", "related_work", "body", "body"]


def test_identifiers(spark):
    assert [one(spark, v, "string", ids.work_id) for v in ("https://x.example/w12", " W3 ", "W3/x", "V3", None)] == ["W12", "W3", "", "", ""]
    assert [one(spark, v, "string", ids.plain_doi) for v in ("https://doi.org/10.1/A", "DOI: 10.1/a ", None)] == ["10.1/a", "10.1/a", ""]
    assert [one(spark, v, "string", ids.identifier) for v in ("https://x/A/", "b", None)] == ["a", "b", ""]
    assert one(spark, "Ａ résumé – of X2", "string", ids.title_key) == "a r sum of x2"


def test_addresses(spark):
    safe = ["https://a.example/x.pdf", "http://8.8.8.8/", " HTTPS://B.example ", "http://10.example.com/", "http://[2606:4700::1]/x", "http://192.0.0.9/", "http://100.128.0.1:80/", "http://mylocal/"]
    unsafe = ["ftp://a.example", "http://localhost/x", "http://x.local/", "http://127.0.0.1/", "http://192.168.1.2/", "http://172.20.0.1", "no url", "", None]
    unsafe += ["http://localhost.localdomain/", "http://100.64.0.1/", "http://192.0.2.7/", "http://224.0.0.1/", "http://[::1]/", "http://[fe80::1]/", "http://[::ffff:10.0.0.1]/", "http://0.1.2.3", "http://255.255.255.255", "http://198.18.0.1"]
    got = [r[0] for r in spark.createDataFrame([(u,) for u in safe + unsafe], "u string").select(ids.is_safe_url(F.col("u"))).collect()]
    assert got == [True] * len(safe) + [False] * len(unsafe)


def test_answers_are_scored(spark):
    rows = [
        ("The Dense\n index works", ["dense index", "missing"], ["index", "dex w"], 0.5), ("x", [], [], None), (None, ["a"], None, 0.0), ("a+b", ["A+B"], None, 1.0),
    ]
    df = spark.createDataFrame(rows, "answer string, must array<string>, must_not array<string>, want double")
    assert all(r[0] == r[1] for r in df.select(nested.keyword_coverage(F.col("answer"), F.col("must"), F.col("must_not")), "want").collect())
    routes = spark.createDataFrame([(True, False, True, False, 1.0), (True, True, True, False, 0.5), (None, True, True, False, 0.0)], "a boolean, b boolean, c boolean, d boolean, want double")
    assert all(r[0] == r[1] for r in routes.select(nested.route_accuracy(*(F.col(c) for c in "abcd")), "want").collect())
    outcomes = [
        ("x", None, "accepted", False, False, 1.0), (" ", None, "accepted", False, False, 0.0), ("x", "boom", "accepted", False, False, 0.0), ("x", "", "insufficient_evidence", False, False, 0.0),
        ("x", None, "insufficient_evidence", False, True, 1.0), ("x", None, "accepted", True, True, 0.0), ("x", None, "insufficient_evidence", True, False, 1.0), ("x", None, None, None, None, 0.0),
    ]
    df = spark.createDataFrame(outcomes, "answer string, error string, status string, expects boolean, accepts boolean, want double")
    assert all(r[0] == r[1] for r in df.select(nested.success(*(F.col(c) for c in ("answer", "error", "status", "expects", "accepts"))), "want").collect())


def test_abstracts_from_inverted_indexes(spark):
    rows = [({"b": [3], "a": [1, 3], "z": [-1], "c": [6]}, "a  b   c"), ({}, ""), (None, ""), ({"x": None, "y": []}, ""), ({"w": [5]}, "w"), ({"p": list(range(0, 6000, 2)), "q": list(range(1, 6000, 2))}, " ".join(["p q"] * 3000))]
    df = spark.createDataFrame(rows, "idx map<string,array<int>>, want string")
    assert all(r[0] == r[1] for r in df.select(nested.abstract_text(F.col("idx")), "want").collect())


def test_open_urls_keep_their_order(spark):
    place = "struct<is_oa:boolean,pdf_url:string>"
    rows = [((None, "b"), [(True, "a"), (False, "x"), (True, "b"), (True, None), None]), ((False, "z"), None), (None, [])]
    got = spark.createDataFrame(rows, f"best {place}, places array<{place}>").select(ids.open_pdf_urls(F.col("best"), F.col("places"))).collect()
    assert [r[0] for r in got] == [["b", "a"], [], []]


def test_dates_and_windows(spark):
    assert [str(one(spark, v, "string", ids.iso_date)) for v in ("2024-02-29T10", "2023-02-29", "2024", None)] == ["2024-02-29", "None", "None", "None"]
    rows = [("2024-01-05", 2024), ("2022-01-05", 2024), (None, 2024), (None, None)]
    df = spark.createDataFrame(rows, "d string, y int")
    long, short = (ids.in_window(ids.iso_date(F.col("d")), F.col("y"), "2023-06-01", "2024-06-01", n) for n in (366, 30))
    assert [tuple(r) for r in df.select(long, short).collect()] == [(True, True), (False, False), (True, False), (False, False)]
    assert [one(spark, q, "string", ids.asks_for_recent) for q in ("papers of the last 8 days", "within 3 weeks", "Does it help?", None)] == [True, True, False, False]


def test_abstracts_from_inverted_indexes(spark):
    cases = [({"b": [1], "a": [0, 3]}, "a b  a"), ({"x": [0], "y": [0]}, "y"), ({"x": [2, -1]}, "x"), ({"x": []}, ""), ({}, ""), (None, ""), ({"x": None, "z": [0]}, "z")]
    got = spark.createDataFrame([(c,) for c, _ in cases], "m map<string,array<int>>").select(nested.abstract_text(F.col("m"))).collect()
    assert [r[0] for r in got] == [w for _, w in cases]


def test_ranking_measures(spark):
    rows = [(["x/A", "b", "B ", "c"], ["b", "d"]), ([], ["a"]), (["a", "a"], ["a"]), (["a"], []), (None, None)]
    df = spark.createDataFrame(rows, "got array<string>, gold array<string>")
    got, gold = F.col("got"), F.col("gold")
    out = df.select(nested.precision_at(got, gold, 2), nested.recall_at(got, gold, 2), nested.reciprocal_rank(got, gold), nested.ndcg_at(got, gold, 3)).collect()
    ideal = 1 + 1 / math.log2(3)
    assert [round(x, 6) for x in out[0]] == [0.5, 0.5, 0.5, round(1 / math.log2(3) / ideal, 6)]
    assert [tuple(r) for r in out[1:]] == [(0.0, 0.0, 0.0, 0.0), (1.0, 1.0, 1.0, 1.0), (None,) * 4, (None,) * 4]
    with pytest.raises(ValueError):
        nested.precision_at(got, gold, 0)


def test_citations(spark):
    df = spark.createDataFrame([(["a", "a", "z"], ["a", "b"]), ([], ["a"]), (None, [])], "cited array<string>, other array<string>")
    got = df.select(nested.citation_validity(F.col("cited"), F.col("other")), nested.citation_recall(F.col("cited"), F.col("other"))).collect()
    assert [tuple(r) for r in got] == [(2 / 3, 0.5), (0.0, 0.0), (0.0, None)]


def test_small_helpers(spark):
    assert [one(spark, v, "string", ids.pmc_id) for v in (" pmc12 ", "PMC", "x", None)] == ["PMC12", None, None, None]
    assert one(spark, "u?api_key=secret&x=1", "string", text.redacted) == "u?api_key=REDACTED&x=1"
    df = spark.createDataFrame([([3, 0, -1, 3, None, 9], "See [a].", ["a", "b", "b"], ["b"]), (None, "x", None, None)], "i array<int>, answer string, s array<string>, e array<string>")
    got = df.select(nested.valid_indexes(F.col("i"), F.lit(5)), nested.with_citations(F.col("answer"), F.col("s")), nested.unknown_citations(F.col("s"), F.col("e"))).collect()
    assert tuple(got[0]) == ([3, 0], "See [a]. [b]", ["a"]) and tuple(got[1]) == (None, "x", [])
