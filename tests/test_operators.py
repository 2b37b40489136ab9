import math
import random
import re
from collections import Counter

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillstream.functions.stem import stem
from quillstream.operators import chunking, dedup, joins, search, selection

TOKEN = re.compile(r"\w+|[^\w\s]")


def greedy_first_plain(frame: pd.DataFrame, order: str, keys: list[str]) -> pd.DataFrame:
    """The same row by row, for tests."""
    seen: dict[str, set] = {k: set() for k in keys}
    out = []
    for row in frame.sort_values(order).to_dict("records"):
        has = [k for k in keys if row[k] is not None and row[k] != ""]
        why = next((k for k in has if row[k] in seen[k]), None)
        if why is None:
            for k in has:
                seen[k].add(row[k])
        out.append((row[order], why is None, why))
    return pd.DataFrame(out, columns=[order, "kept", "reason"])


def plain_windows(text, most, overlap):
    spans = [m.span() for m in TOKEN.finditer(text)]
    out, at = [], 0
    while spans:
        end = min(at + most, len(spans))
        out.append(text[spans[at][0] : spans[end - 1][1]])
        if end == len(spans):
            break
        at += most - overlap
    return out


def plain_sentence_chunks(text, most, overlap):
    n = lambda t: len(TOKEN.findall(t))
    clean = " ".join(text.split())
    if n(clean) <= most:
        return [clean] if n(clean) else []
    out, now = [], []
    for s in re.split(r"(?<=[.!?])\s+", clean):
        if n(s) > most:
            out += [" ".join(now)] if now else []
            now = []
            out += plain_windows(s, most, overlap)
        elif n(" ".join([*now, s])) <= most:
            now.append(s)
        else:
            done = " ".join(now)
            if now:
                out.append(done)
            spans = [m.start() for m in TOKEN.finditer(done)]
            tail = done[spans[-overlap] :] if overlap and len(spans) > overlap else done if overlap else ""
            now = [tail, s] if tail and n(tail) + n(s) <= most else [s]
    return out + ([" ".join(now)] if now else [])


@pytest.mark.parametrize("most,overlap", [(12, 3), (30, 0), (300, 50)])
def test_chunks_equal_the_plain_form(spark, most, overlap):
    rnd = random.Random(most)
    words = ["alpha", "beta.", "gamma!", "x-1", "é́", "a.b", "?", "名前"]
    texts = ["".join(rnd.choice(words) + rnd.choice([" ", "  ", "\n", ""]) for _ in range(rnd.choice([0, 3, 40, 400]))) for _ in range(60)] + [" ", ""]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = df.select("t", chunking.sentence_chunks(F.col("t"), most, overlap), chunking.windows(F.col("t"), most, overlap)).collect()
    for t, packed, windows in got:
        assert windows == plain_windows(t, most, overlap)
        assert packed == plain_sentence_chunks(t, most, overlap)


def test_chunk_arguments():
    for bad in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            chunking.windows(F.lit("x"), *bad)


def test_paper_chunks_keep_to_their_section(spark):
    section = "struct<section_id:string,heading:string,text:string,section_type:string,section_order:int>"
    rows = [(1, "W1", "T", 2020, "jats_xml", "An abstract.", [("s1", "H", "One. Two.", "body", 1), ("s2", "H", None, "body", 2)]), (2, None, None, None, None, " ", None)]
    df = spark.createDataFrame(rows, f"record_id long, paper_id string, title string, publication_year int, source_format string, abstract string, sections array<{section}>")
    got = chunking.paper_chunks(df).orderBy("section_order").collect()
    assert [(r["section_order"], r["chunk_index"], r["text"], r["token_count"]) for r in got] == [(0, 0, "An abstract.", 3), (1, 0, "One. Two.", 4)]
    assert got[1]["chunk_id"].startswith("W1-chunk-") and chunking.chunk_report(chunking.paper_chunks(df)).first()["chunks"] == 2


@pytest.mark.parametrize("seed", range(3))
def test_greedy_first_equals_row_by_row(spark, seed):
    rnd = random.Random(seed)
    pick = lambda n: rnd.choice([None, "", *(f"k{j}" for j in range(n))])
    rows = [(k, pick(25), pick(40), "hot" if rnd.random() < 0.1 else pick(60)) for k in range(150)]
    df = spark.createDataFrame(rows, "at long, a string, b string, c string")
    got = sorted(tuple(r) for r in dedup.greedy_first(df, "at", ["a", "b", "c"]).drop("holder").collect())
    want = [(int(a), bool(k), w if isinstance(w, str) else None) for a, k, w in greedy_first_plain(df.toPandas(), "at", ["a", "b", "c"]).itertuples(index=False)]
    assert got == want


def test_a_match_with_a_dropped_row_does_not_count(spark):
    rows = [(1, "x", None), (2, "x", "t"), (3, None, "t")]
    got = dedup.greedy_first(spark.createDataFrame(rows, "at long, a string, b string"), "at", ["a", "b"]).orderBy("at").collect()
    assert [(r["kept"], r["reason"]) for r in got] == [(True, None), (False, "a"), (True, None)]
    assert dedup.greedy_first(spark.createDataFrame([], "at long, a string, b string"), "at", ["a", "b"]).collect() == []


def test_numbers_are_consecutive(spark):
    df = spark.createDataFrame([(f"k{j:03d}", j % 3) for j in range(200)], "k string, part int").repartition(7)
    got = dedup.numbered(df, ["k"], rows_a_part=40).orderBy("k").collect()
    assert [r["number"] for r in got] == list(range(200))
    assert dedup.numbered(spark.createDataFrame([], "k string"), ["k"]).collect() == []


def test_unions_and_lists_keep_order(spark):
    a, b = (spark.createDataFrame(r, "k string, at int") for r in ([("x", 2), ("x", 1)], [("x", 0), ("y", 5), (None, 1)]))
    got = {(r["k"], r["at"], r["side"]) for r in dedup.ordered_union(a, b, ["k"], [F.col("at")]).collect()}
    assert got == {("x", 1, 0), ("y", 5, 1), (None, 1, 1)}
    lists = spark.createDataFrame([("a", ["q", "p"], 2), ("a", ["p", "r"], 1), ("b", None, 3), (None, ["z"], 4)], "k string, v array<string>, at int")
    assert {(r["k"], tuple(r["v"]), r["first"]) for r in dedup.merged_lists(lists, "k", "v", "at").collect()} == {("a", ("p", "r", "q"), 1), ("b", (), 3)}


def test_bm25_equals_the_formula(spark):
    import math

    docs = {1: "dense index of dense chunks", 2: "sparse index", 3: "", 4: None, 5: "nothing here"}
    d = spark.createDataFrame(list(docs.items()), "id long, text string")
    q = spark.createDataFrame([("a", "dense index"), ("b", ""), ("c", "absent")], "q string, query string")
    got = {(r["q"], r["id"]): r["score"] for r in search.bm25(q, d, "q", "query", "id", "text").collect()}
    mean = (5 + 2 + 0 + 0 + 2) / 5
    part = lambda df, tf, n: max(math.log((5 - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / mean))
    assert got == {("a", 1): round(part(1, 2, 5) + part(2, 1, 5), 6), ("a", 2): round(part(2, 1, 2), 6)}
    assert search.bm25(q, d.limit(0), "q", "query", "id", "text").collect() == []


def test_nearest_is_exact_with_ties_by_id(spark):
    import numpy as np

    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 8))
    x[50:60] = x[49]
    rows = [(k, [float(v) for v in r]) for k, r in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [float("nan")] * 8), (903, [1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = search.nearest(df.where("id % 50 = 49").select(F.col("id").alias("q"), F.col("v").alias("w")), df, "q", "w", "id", "v", 5, 8, block=64, others_only=True)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    for r in got.groupBy("q").agg(F.sort_array(F.collect_list(F.struct("rank", "id"))).alias("l")).collect():
        sims = np.round(u @ u[r["q"]], 9)
        sims[r["q"]] = -9
        assert [s["id"] for s in r["l"]] == np.lexsort((np.arange(300), -sims))[:5].tolist()


def test_fusion_and_cap(spark):
    lists = lambda ids: spark.createDataFrame([("q", i, k) for k, i in enumerate(ids, 1)], "q string, d string, rank int")
    fused = search.fuse(lists("abc"), lists("xbz"), "q", "d", k=4)
    assert [r["d"] for r in fused.orderBy("rank").collect()] == ["b", "a", "x", "c"]
    grouped = fused.withColumn("g", F.when(F.col("d").isin("b", "a", "x"), "one"))
    assert [(r["d"], r["rank"]) for r in search.capped(grouped, "q", "g", 2, 10).orderBy("rank").collect()] == [("b", 1), ("a", 2), ("c", 3)]
    with pytest.raises(ValueError):
        search.fuse(lists("a"), lists("b"), "q", "d", rrf_k=0)


def test_budget_merge_fills_up(spark):
    lists = lambda ids: spark.createDataFrame([("q", i, k) for k, i in enumerate(ids, 1)], "q string, d string, rank int")
    order = lambda a, b, n: [r["d"] for r in joins.budget_merge(lists(a), lists(b), "q", "d", n).orderBy("rank").collect()]
    assert order("abcdef", "xyz", 6) == ["a", "b", "c", "x", "y", "z"]
    assert order("abcdef", "x", 5) == ["a", "b", "x", "c", "d"]
    assert order("ab", "bcd", 4) == ["a", "b", "c", "d"]


def test_ids_are_repaired_only_when_one_fits(spark):
    known = spark.createDataFrame([("abcdefgh-1",), ("abcdefgh-22",), ("zzzzzzzz",), (None,)], "k string")
    given = spark.createDataFrame([("abcdefgh-2",), ("abcdefgh-",), ("zzzzzzzz-tail",), ("zzz",), ("abcdefgh-1",), (None,)], "g string")
    got = dict(map(tuple, joins.repaired_ids(given, known, "g", "k").collect()))
    assert got == {"abcdefgh-2": "abcdefgh-22", "abcdefgh-": None, "zzzzzzzz-tail": "zzzzzzzz", "zzz": None, "abcdefgh-1": "abcdefgh-1"}


def test_coverage_counts_each_key_once(spark):
    side = lambda ids: spark.createDataFrame([(i,) for i in ids], "k string")
    got = {r["present_in"]: r["keys"] for r in joins.key_coverage({"a": side(["1", "1", "2", None]), "b": side(["2", "3"])}, "k").collect()}
    assert got == {"a": 1, "a+b": 1, "b": 1}


RULES = selection.Rules({"search": 3, "index": 2, "grounding": 5}, ["forest"], ["saved"], ["search", "saved"])
WORKS = "title string, idx map<string,array<int>>, main struct<display_name:string>, topics array<struct<display_name:string>>, q array<string>, n int, bad boolean"


def test_scores_and_failures(spark):
    rows = [
        ("Dense Search", {"index": [0]}, ("Search",), [("Search",), None], ["grounding", None], 9, True), (None, None, None, None, None, None, None),
        ("Forest search", None, None, None, None, -1, False), ("Saved forest search", None, None, None, None, 0, False), ("Grounding index", {"grounding": [0], "index": [1]}, None, [], [], 2, None),
    ]
    df = spark.createDataFrame(rows, WORKS)
    found = selection.relevance(*(F.col(c) for c in ("title", "idx", "main", "topics", "q", "n")), RULES)
    got = df.select(found.alias("f"), selection.failures(bad=F.col("bad"), untitled=F.col("title").isNull()).alias("fails")).select("f.score", "f.title_terms", "f.metadata_terms", "f.penalty_terms", "fails", selection.decision(F.col("f.score"), F.col("fails"), RULES)).collect()
    assert [tuple(r) for r in got] == [
        (3 * 2 + 2 + 2 + 3, ["search"], ["grounding"], [], ["bad"], "rejected"), (0, [], [], [], ["untitled"], "rejected"),
        (0, ["search"], [], ["forest"], [], "rejected"), (6, ["search"], [], [], [], "ambiguous"), (7, ["index", "grounding"], [], [], [], "ambiguous"),
    ]
    order = df.select(F.col("n").alias("s"), "bad").orderBy(*selection.candidate_order(F.col("s"), F.col("bad"), F.lit(None).cast("int"), F.lit(None).cast("int"))).collect()
    assert [r["s"] for r in order] == [9, 2, 0, -1, None]


def test_accepted_records_gather_the_queries_of_their_duplicates(spark):
    rows = [(1, "W1", "d1", "a"), (2, "W2", "d1", "b"), (3, "W2", "", "c"), (4, "W1", "d9", "a"), (5, "W5", "d9", None), (6, "W6", "d9", "x"), (7, "W6", None, "y")]
    got = dedup.accepted_records(spark.createDataFrame(rows, "at long, id string, doi string, q string"), "at", ["id", "doi"], "q").orderBy("at").collect()
    # 2 has the DOI of 1 and is no record, so 3 is a new one; 4 is 1 again, so d9 is not known until 5
    assert [tuple(r) for r in got] == [(1, ["a", "b"], 2), (3, ["c"], 1), (5, ["x"], 1), (7, ["y"], 1)]
    assert dedup.accepted_records(spark.createDataFrame([], "at long, id string, doi string, q string"), "at", ["id", "doi"], "q").collect() == []


def test_long_chains_of_rivals_end(spark):
    rows = [(k, f"k{k}", f"k{k - 1}") for k in range(30)]
    got = dedup.greedy_first(spark.createDataFrame([(k, f"x{k // 2}", f"y{(k + 1) // 2}") for k, *_ in rows], "at long, a string, b string"), "at", ["a", "b"]).orderBy("at").collect()
    assert [r["kept"] for r in got] == [k % 2 == 0 for k in range(30)]


def test_stems_follow_the_published_rules():
    pairs = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sized": "size", "hopping": "hop", "filing": "file", "happy": "happi", "relational": "relat"}
    pairs |= {"conditional": "condit", "vietnamization": "vietnam", "triplicate": "triplic", "replacement": "replac", "adoption": "adopt", "probate": "probat", "controll": "control", "is": "is", "naïve": "naïve", "x9s": "x9s"}
    assert {w: stem(w) for w in pairs} == pairs


def plain_bm25(queries, docs, form):
    from quillstream.functions.text import STOPWORDS

    bags = {d: Counter(form(w) for w in re.findall(r"\w+", (t or "").lower())) for d, t in docs}
    mean = sum(sum(b.values()) for b in bags.values()) / len(bags)
    out = {}
    for q, text_ in queries:
        words = re.findall(r"\w+", (text_ or "").lower())
        for term in {form(w) for w in [w for w in words if w not in STOPWORDS] or words}:
            df = sum(term in b for b in bags.values())
            idf = max(math.log((len(bags) - df + 0.5) / (df + 0.5)), 1e-6) if df else 0
            for d, b in bags.items():
                if b[term]:
                    out[q, d] = out.get((q, d), 0) + idf * b[term] * 2.2 / (b[term] + 1.2 * (0.25 + 0.75 * sum(b.values()) / mean))
    return out


@pytest.mark.parametrize("stems", [False, True])
def test_bm25_from_stored_postings(spark, tmp_path, stems):
    rnd = random.Random(4)
    words = ["index", "indexes", "indexing", "ranked", "rank", "the", "of", "naïve", "x_1"]
    docs = [(k, " ".join(rnd.choice(words) for _ in range(rnd.randint(1, 30)))) for k in range(40)] + [(100, None), (101, "")]
    queries = [("a", "the indexed ranking"), ("b", "index"), ("c", "of the"), ("d", None), ("e", "?")]
    d, q = spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(queries, "q string, x string")
    want = plain_bm25(queries, docs, stem if stems else str)
    got = {(r["q"], r["id"]): r["score"] for r in search.bm25(q, d, "q", "x", "id", "t", 1000, stems).collect()}
    assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 2e-6 for k in want)
    d.write.parquet(str(tmp_path / "docs.parquet"))
    made = []
    make = lambda: made.append(1) or d
    for _ in range(2):
        index = search.stored_index(spark, str(tmp_path / "docs.parquet"), make, "id", "t", stems)
        again = {(r["q"], r["id"]): r["score"] for r in search.bm25_of(index, q, "q", "x", "id", 1000).collect()}
        assert again == got
    assert made == [1], "built once while the files stay as they are"
    d.limit(3).write.mode("append").parquet(str(tmp_path / "docs.parquet"))
    search.stored_index(spark, str(tmp_path / "docs.parquet"), make, "id", "t", stems)
    assert made == [1, 1]
    assert search.bm25(q, d.limit(0), "q", "x", "id", "t", 5, stems).collect() == []
