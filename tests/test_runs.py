from pyspark.sql import functions as F

from quillstream.operators import runs
from quillstream.sources import files, xml_papers

RECORD = "run string, q string, at int, answer string, error string, scores map<string,double>, errors map<string,string>"


def records(spark):
    data = [
        ("a", "q1", 1, "x", "down", None, None), ("a", "q1", 5, "x", None, {"s": 0.5}, {}), ("a", "q2", 2, "x", "", None, None), ("b", "q1", 3, "x", None, {"s": None, "t": None}, {"s": "cut off"}), ("b", "q2", 4, " ", None, None, None),
        ("b", "q3", 6, "x", None, {"s": 1.0, "t": None}, {"t": "cut off"}), ("b", "q4", 7, "x", "down", None, None), (None, "q1", 8, None, None, None, None),
    ]
    return spark.createDataFrame(data, RECORD)


def test_the_newest_record_stands_in_first_place(spark):
    got = {(r["run"], r["q"]): (r["at"], r["first_place"], r["error"]) for r in runs.compacted(records(spark), ["run", "q"], "at").collect()}
    assert got[("a", "q1")] == (5, 1, None) and got[(None, "q1")] == (8, 8, None) and len(got) == 7
    assert runs.compacted(records(spark).limit(0), ["run", "q"], "at").collect() == []


def test_what_is_done_and_what_is_missing(spark):
    last = runs.compacted(records(spark), ["run", "q"], "at")
    of = [F.col(c) for c in ("error", "answer", "scores", "errors")]
    got = {(r["run"], r["q"]): (r["m"], r["c"], r["plain"]) for r in last.select("run", "q", runs.missing_scores(*of, ["s", "t"]).alias("m"), runs.completed(*of).alias("c"), runs.completed(*of, judged=False).alias("plain")).collect()}
    assert got == {
        ("a", "q1"): ([], True, True), ("a", "q2"): (["s", "t"], False, True), ("b", "q1"): (["s"], False, True), ("b", "q2"): ([], True, True), ("b", "q3"): (["t"], True, True), ("b", "q4"): ([], False, False), (None, "q1"): ([], True, True),
    }
    asked = spark.createDataFrame([("q1",), ("q2",), ("q2",)], "q string")
    left = runs.open_pairs(asked, "q", ["a", "b"], last.where(runs.completed(*of)), "run")
    assert {tuple(r) for r in left.collect()} == {("a", "q2"), ("b", "q1")}


def test_files_of_records_are_compacted_and_split(spark, tmp_path):
    path = f"{tmp_path}/records"
    records(spark).write.json(path)
    assert files.compact(spark, path, RECORD, ["run", "q"], "at") == 7
    again = files.read_jsonl(spark, path, RECORD)
    assert again.count() == 7 and again.where("run = 'a' and q = 'q1'").first()["at"] == 5 and [p.name for p in tmp_path.iterdir()] == ["records"]
    files.write_split(again, f"{tmp_path}/split", "run")
    assert {p.name for p in (tmp_path / "split").iterdir() if p.is_dir()} == {"run=a", "run=b", "run=__HIVE_DEFAULT_PARTITION__"}


def test_the_best_file_of_each_record(spark):
    xmls = spark.createDataFrame(
        [("W1", "b.xml", "jats", False, "empty"), ("W1", "b.xml", "jats", True, "valid"), ("W1", "a.xml", "tei", True, "valid"), ("W2", "d.xml", "tei", True, "valid"), ("W2", "c.xml", "jats", False, "empty"), ("W3", "f.xml", None, None, "odd"),
         ("W3", "e.xml", "jats", False, "empty"), ("W9", "g.xml", "jats", True, "valid"), (None, "h.xml", "jats", True, "valid")], "work string, path string, kind string, valid boolean, reason string",
    )
    got = {r["work"]: (r["path"], r["kind"], r["valid"], r["reason"]) for r in xml_papers.chosen_file(xmls, "work", ["jats", "tei"]).collect()}
    assert got == {"W1": ("b.xml", "jats", True, "valid"), "W2": ("d.xml", "tei", True, "valid"), "W3": ("e.xml", "jats", False, "empty"), "W9": ("g.xml", "jats", True, "valid")}
    pdfs = spark.createDataFrame([("W1", "p.pdf", "pdf", True, "valid"), ("W4", "q.pdf", "pdf", True, "valid")], xmls.schema)
    works = spark.createDataFrame([(1, "W1"), (2, "W2"), (3, "W3"), (4, "W4"), (5, None), (6, "W1")], "n int, work string")
    rows = {r["n"]: (r["content"], r["xml_reason"]) for r in xml_papers.local_inventory(works, "work", pdfs, xmls).collect()}
    assert rows == {1: ("pdf and xml", "valid"), 2: ("tei", "valid"), 3: ("missing", "empty"), 4: ("pdf", "missing"), 5: ("missing", "missing"), 6: ("pdf and xml", "valid")}
    assert {r[0] for r in xml_papers.orphans(works, "work", pdfs, xmls).collect()} == {"g.xml", "h.xml"}
