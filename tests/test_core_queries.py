import hashlib

from quillstream.plans.queries import queries

CHUNK = "vector_id long, chunk_id string, title string, section_heading string, text string"


def test_an_encoder_reads_the_whole_text(spark, tmp_path):
    long = "word " * 400 + "end"
    spark.createDataFrame([(1, "c1", "T", "H", long), (2, "c2", "T", "H", long[:-3] + "other")], CHUNK).write.parquet(f"{tmp_path}/chunks.parquet")
    got = {r["vector_id"]: r["encoded"] for r in queries()["encoder_texts"](spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.md5(f"Paper: T\nSection: H\n{t}".encode()).hexdigest() for k, t in ((1, long), (2, long[:-3] + "other"))}


def test_a_context_shows_up_to_2400_characters_of_a_document(spark, tmp_path):
    texts = {"c1": "a" * 2000, "c2": "b" * 3000}
    spark.createDataFrame([(k, c, "T", "H", t) for k, (c, t) in enumerate(texts.items())], CHUNK).write.parquet(f"{tmp_path}/chunks.parquet")
    spark.createDataFrame([(1, "c1", 0.9, 0.9), (1, "c2", 0.8, 0.8)], "question_id long, chunk_id string, dense_score double, sparse_score double").write.parquet(f"{tmp_path}/candidates.parquet")
    want = f"Document 1\nTitle: T\nSection: H\n{'a' * 2000}\n---\nDocument 2\nTitle: T\nSection: H\n{'b' * 2400}..."
    row = queries()["evidence_contexts"](spark, str(tmp_path)).first()
    assert (row["context"], row["characters"]) == (hashlib.md5(want.encode()).hexdigest(), len(want))
