import random

import numpy as np
import pytest

from quillstream.llm.splitting import TOKEN, Planner, boundary_table, plan_items, split_files, split_items, token_offsets

SCHEMA = "id int, text string, t string, k0 string, range_no int"


def split(spark, texts, **how):
    rows = [(k, t, "x", "y", 0) for k, t in enumerate(texts)]
    out = split_items(spark.createDataFrame(rows, SCHEMA), ["id"], "text", **how).orderBy("id", "chunk_index").collect()
    return {k: [r for r in out if r["id"] == k] for k in range(len(texts))}


def check(text, pieces, most, overlap):
    spans = [m.span() for m in TOKEN.finditer(text)]
    starts, ends = {a: k for k, (a, _) in enumerate(spans)}, {b: k + 1 for k, (_, b) in enumerate(spans)}
    assert [p["chunk_index"] for p in pieces] == list(range(len(pieces)))
    before = None
    for p in pieces:
        a, b = starts[p["start"]], ends[p["stop"]]
        assert b - a == p["token_count"] <= most and text[p["start"] : p["stop"]] == p["piece"]
        if before is None:
            assert a == 0
        else:
            assert before - a == overlap
        before = b
    assert before == len(spans)


def prose(n, seed):
    rnd = random.Random(seed)
    parts = ["alpha", "beta.", "gamma!", "x_1", "d-e", "é́t", "名前", "a.b", "1.5", "?"]
    return "".join(rnd.choice(parts) + rnd.choice([" ", " ", "\n", "\n\n", ""]) for _ in range(n))


AWKWARD = ["a" * 5000 + " b." + "c" * 9000 + " d" * 400 + "e" * 7000, "a b" + " " * 5000 + "c.\n\nd" + " \n" * 1500 + "e" + " f." * 300, "\r\n".join("x. y" * 30 for _ in range(20)), " " * 3000 + "q" * 10 + "\u2003" * 2000 + "w! " * 500]


def same(a, b):
    return {k: [tuple(r) for r in v] for k, v in a.items()} == {k: [tuple(r) for r in v] for k, v in b.items()}


def test_pieces_are_the_same_for_every_size_of_range_and_block(spark):
    texts = [prose(3000, seed) for seed in range(3)] + AWKWARD
    whole = split(spark, texts, max_tokens=60, overlap=10, range_chars=1 << 20)
    for k, text in enumerate(texts):
        check(text, whole[k], 60, 10)
    for size, block in [(1000, 1 << 20), (7, 1 << 20), (100, 60), (333, 500), (1 << 20, 61)]:
        assert same(split(spark, texts, max_tokens=60, overlap=10, range_chars=size, block=block), whole), (size, block)


def test_boundary_tables_against_the_pattern():
    for text in [prose(500, 9), *AWKWARD, "", "  ", "a"]:
        spans = [m.span() for m in TOKEN.finditer(text)]
        starts, ends = token_offsets(text)
        assert list(zip(starts.tolist(), ends.tolist())) == spans
        n, cuts = boundary_table(text, 0)
        found = np.frombuffer(cuts, np.int32)
        want = []
        for k in range(1, len(spans)):
            gap = text[spans[k - 1][1] : spans[k][0]]
            lines = gap.count("\n") or gap.count("\r")
            kind = 0 if not gap else 3 if lines > 1 else 2 if lines else 1 if text[spans[k - 1][1] - 1] in ".!?" else 0
            if kind:
                want.append(4 * k + kind)
        assert n == len(spans) and found.tolist() == want


def test_exits_lead_where_the_chain_does():
    rng = np.random.default_rng(3)
    at = np.unique(rng.integers(1, 2000, 150))
    p = Planner(at, rng.integers(1, 4, len(at)), 2000, 60, 10)
    ends, pieces = p.exits(500, 1000)
    for k in range(60):
        chain = p.chain(500 + k, 1000)
        assert (chain[-1][1], len(chain)) == (ends[k], pieces[k])


def test_repeated_rows_and_null_keys(spark):
    text = prose(400, 5)
    rows = spark.createDataFrame([(1, text, "x", "y", 0)] * 3 + [(None, text, "x", "y", 0)], SCHEMA)
    got = split_items(rows, ["id", "range_no"], "text", 60, 10, 100).orderBy("id", "chunk_index").collect()
    check(text, [r for r in got if r["id"] == 1], 60, 10)
    check(text, [r for r in got if r["id"] is None], 60, 10)
    assert plan_items(rows, ["id", "range_no"], "text", 60, 10, 100).count() == len(got)


def test_pieces_end_at_sentences_where_they_can(spark):
    text = " ".join(f"Word{k} goes on here." for k in range(100))
    pieces = split(spark, [text], max_tokens=50, overlap=5)[0]
    assert all(p["piece"].endswith(".") for p in pieces) and {p["ends_at"] for p in pieces[:-1]} == {1}
    hard = split(spark, ["w " * 200], max_tokens=50, overlap=5)[0]
    assert {p["ends_at"] for p in hard[:-1]} == {0}


def test_null_empty_blank_and_limit(spark):
    got = split(spark, [None, "", "  \n ", "one", "w " * 300, "w " * 301])
    assert [len(got[k]) for k in range(6)] == [0, 0, 0, 1, 1, 2]
    assert split_items(spark.createDataFrame([], SCHEMA), ["id"], "text").collect() == []
    with pytest.raises(ValueError):
        split(spark, ["x"], max_tokens=5, overlap=5)


def test_files_are_cut_by_byte_ranges(spark, tmp_path):
    texts = {"a b.txt": prose(2500, 1) + "x" * 3000 + " " + prose(200, 1), "c.txt": AWKWARD[1] + "\U0001f600 ü" * 50, "empty.txt": "", "blank.txt": " \n" * 400}
    for name, text in texts.items():
        (tmp_path / name).write_bytes(text.encode())
    for size, block in [(700, 1 << 20), (61, 100), (1 << 20, 1 << 20)]:
        rows = split_files(spark, str(tmp_path), 60, 10, size, block).orderBy("path", "chunk_index").collect()
        assert len({r["path"] for r in rows}) == 2
        for name in ("a b.txt", "c.txt"):
            raw, mine = texts[name].encode(), [r for r in rows if r["path"].replace("%20", " ").endswith(name)]
            assert all(raw[r["start"] : r["stop"]].decode() == r["piece"] for r in mine)
            at = [len(raw[: r["start"]].decode()) for r in mine]
            check(texts[name], [{"chunk_index": r["chunk_index"], "start": a, "stop": a + len(r["piece"]), "token_count": r["token_count"], "piece": r["piece"]} for r, a in zip(mine, at)], 60, 10)
            (whole,) = split(spark, [texts[name]], max_tokens=60, overlap=10).values()
            assert [r["piece"] for r in mine] == [r["piece"] for r in whole]


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"one \xff\xfe two. " * 200 + b"\x80" * 50)
    one, other = ([tuple(r)[1:] for r in split_files(spark, str(tmp_path), 60, 10, size).orderBy("chunk_index").collect()] for size in (301, 1 << 20))
    assert one == other and one and "\ufffd" in one[0][-1]


def test_long_texts_of_few_tokens_are_one_piece(spark):
    texts = ["a b" + " " * 5000 + "c.\n\nd" + " " * 3000 + "e", " " * 4000, "w " * 60 + " " * 4000, "w " * 61 + " " * 4000, "x" * 5000]
    got = split(spark, texts, max_tokens=60, overlap=10, range_chars=1000)
    assert [(p["start"], p["stop"], p["token_count"], p["chunk_index"]) for p in got[0]] == [(0, len(texts[0]), 6, 0)]
    assert [len(got[k]) for k in range(1, 5)] == [0, 1, 2, 1]
