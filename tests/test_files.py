import pytest
from pyspark.sql import functions as F

from quillstream.sources import files

SCHEMA = "question_id string, split string, n int"


def put(tmp_path, *lines):
    path = tmp_path / "in.jsonl"
    path.write_text("\n".join(lines) + "\n")
    return str(path)


def test_strict_and_lenient_readers(spark, tmp_path):
    path = put(tmp_path, '{"question_id": "a", "n": 1}', "", '{"question_id": "b", "more": []}')
    assert sorted(map(tuple, files.read_jsonl(spark, path, SCHEMA).collect())) == [("a", None, 1), ("b", None, None)]
    assert files.read_jsonl(spark, str(tmp_path / "none"), SCHEMA, missing_ok=True).collect() == []
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        files.read_jsonl(spark, str(tmp_path / "none"), SCHEMA).collect()
    with pytest.raises(Exception):
        files.read_jsonl(spark, put(tmp_path, '{"question_id": '), SCHEMA).collect()


def test_examples_are_checked_before_they_are_filtered(spark, tmp_path):
    path = put(tmp_path, '{"question_id": "b", "split": "x"}', '{"question_id": "a", "split": "x"}', '{"question_id": "c", "split": "y"}')
    ids = lambda **how: sorted(r["question_id"] for r in files.read_examples(spark, path, SCHEMA, **how).collect())
    assert ids() == ["a", "b", "c"] and ids(split="x", limit=1) == ["a"] and ids(split=None, limit=0) == ["a", "b", "c"]
    with pytest.raises(ValueError, match="left"):
        ids(split="z")
    for bad in ('{"question_id": "b"}', '{"split": "x"}'):
        with pytest.raises(ValueError, match="repeated or missing"):
            files.read_examples(spark, put(tmp_path, '{"question_id": "b"}', '{"question_id": "c"}', bad), SCHEMA, split="none")


def test_appends_add_each_key_once(spark, tmp_path):
    path = str(tmp_path / "out")
    rows = spark.createDataFrame([("a", "x", 2), ("a", "x", 1), (None, "y", 3)], SCHEMA)
    assert files.append_new(rows, path, ["question_id"]) == 2 and files.append_new(rows, path, ["question_id"]) == 0
    more = rows.unionByName(spark.createDataFrame([("b", None, None)], SCHEMA))
    assert files.append_new(more, path, ["question_id"]) == 1
    assert sorted(map(tuple, files.read_jsonl(spark, path, SCHEMA).where("question_id is not null").collect())) == [("a", "x", 1), ("b", None, None)]


def test_reports_are_one_object(spark, tmp_path):
    path = str(tmp_path / "report.json")
    df = spark.range(3).agg(F.count("*").alias("n"), F.lit("é").alias("name"))
    assert files.write_report(df, path) == {"n": 3, "name": "é"} == files.write_report(df, path) == files.read_report(spark, path)
    with pytest.raises(ValueError):
        files.write_report(spark.range(2), path)
    files.write_jsonl(spark.range(2), str(tmp_path / "o"))
    files.write_jsonl(spark.range(1), str(tmp_path / "o"))
    assert files.read_jsonl(spark, str(tmp_path / "o"), "id long").count() == 1
