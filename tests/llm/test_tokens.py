from quillstream.llm.tokens import _count, _encoding, token_sizes


def test_sizes_of_whole_texts(spark):
    rows = [(1, "Hello world, hello.", 9), (2, "", 9), (3, None, 9), (4, "naïve 名前 <|endoftext|>", 9), (5, "word " * 60_000, 9)]
    df = spark.createDataFrame(rows, "id long, body string, tokens int")
    got = {r["id"]: r["tokens"] for r in token_sizes(df, ["id"], "body").collect()}
    encoding = _encoding(None)
    assert got == {k: len(encoding.encode_ordinary(t)) if t else 0 for k, t, _ in rows}
    assert token_sizes(df.limit(0), ["id"], "body").collect() == []


def test_stretches_count_like_the_whole():
    encoding = _encoding(None)
    for text in ("a b  c\n\n d1 2,3 " * 500, "one two\n" * 400, "名前 は " * 300, "no " + "x" * 3000):
        assert _count(encoding, text, 200) == len(encoding.encode_ordinary(text))
