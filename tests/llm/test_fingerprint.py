from pyspark.sql import functions as F

from quillstream.llm import fingerprint
from quillstream.llm.fingerprint import collapse, duplicate_links, multiset_hash, plain_form, work_form

SCHEMA = "id long, paper_id string, title string, doi string, h1 int, kept int, copy int"


def forms():
    return {"paper_id": work_form(F.col("paper_id")), "title": plain_form(F.col("title")), "doi": plain_form(F.col("doi"), "10.")}


def table(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, 0) for r in rows], SCHEMA)


ROWS = [
    (1, "W41", "A résumé: of X", "10.9/ab.1"),
    (2, "https://works.example/works/w41/", "A  RÉSUMÉ of-x", "DOI: 10.9/AB-1"),
    (3, " W41 ", "Ａ résumé o­f x", "<10.9/ab/1>"),
    (4, "W41", "A resume of X", "10.9/ab.1"),  # accents are part of the letter
    (5, "W42", None, None),
    (6, "w42", "", "  "),
    (7, "W42", "x" * 50000, None),
    (8, "W42", "X" * 50000, ""),
    (None, "W42", None, None),
    (9, None, None, None),
    (10, "", " ", None),
    (11, "W43", "ﬁne straße", "10.1"),
    (12, "W43", "FINE STRASSE", "10.1"),
]


def test_links_and_counts(spark):
    links = {(r["kept"], r["copy"]) for r in duplicate_links(table(spark, ROWS), "id", forms()).collect()}
    assert links == {(1, 2), (1, 3), (5, 6), (7, 8), (9, 10), (11, 12)}
    counts = {r["kept"]: r["copies"] for r in collapse(table(spark, ROWS), "id", forms()).collect()}
    assert counts == {1: 3, 4: 1, 5: 2, 7: 2, 9: 2, 11: 2}


def test_empty_table_and_repeated_rows(spark):
    assert duplicate_links(table(spark, []), "id", forms()).collect() == []
    twice = table(spark, [ROWS[0], ROWS[0], ROWS[1], ROWS[1]])
    assert [tuple(r) for r in duplicate_links(twice, "id", forms()).collect()] == [(1, 2)]


def test_hash_ignores_the_order_of_fields(spark):
    a, b = F.lit("x"), F.lit("y")
    row = spark.range(1).select(multiset_hash({"p": a, "q": b}, 1) == multiset_hash({"q": b, "p": a}, 1), multiset_hash({"p": a, "q": b}, 1) == multiset_hash({"p": b, "q": a}, 1)).first()
    assert tuple(row) == (True, False)


def test_records_that_only_share_a_hash_stay_apart(spark, monkeypatch):
    monkeypatch.setattr(fingerprint, "multiset_hash", lambda fields, lane: F.lit(7).cast("bigint"))
    links = {(r["kept"], r["copy"]) for r in duplicate_links(table(spark, ROWS), "id", forms()).collect()}
    assert links == {(1, 2), (1, 3), (5, 6), (7, 8), (9, 10), (11, 12)}


def test_a_group_of_a_third_of_all_rows(spark):
    rows = [(k, "W1" if k % 3 == 0 else f"W9{k}", "same", None) for k in range(3000)]
    links = duplicate_links(table(spark, rows), "id", forms())
    assert links.count() == 999 and links.select("kept").distinct().collect() == [(0,)]


def test_nothing_is_sorted(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for found in (duplicate_links(table(spark, ROWS), "id", forms()), collapse(table(spark, ROWS), "id", forms())):
            found.collect()
            plan = found._jdf.queryExecution().executedPlan().toString()
            assert "ShuffledHashJoin" in plan and "Sort" not in plan
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
