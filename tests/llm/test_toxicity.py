import numpy as np
from pyspark.sql import functions as F

from quillstream.llm import kneser_ney, toxicity
from quillstream.llm.toxicity import Units, Vocabulary, best_threshold, rates, score_documents, tokens, train

DOCS = "doc_id long, text string, source string, score double, flagged boolean"
MARKS = {"\x00": "|", "\x01": "(", "\x02": ")"}


def shown(text):
    return [MARKS.get(t, "." if t.strip() in "\n.!?" and t not in "!?" else t) for t in tokens([text])]
LABELS = "label_id long, doc_id long, label string, annotator string"


def corpus():
    plain = ["The index holds {} chunks.", "Latency stays under {} ms.", "We study {} queries in this work.", "Table {} lists the scores."]
    bad = ["You are a filthy idiot number {}.", "Get lost you stupid idiot and die {} times.", "All strangers are filthy vermin {}."]
    docs, labels = [], []
    for k in range(240):
        lines = [plain[(k + j) % 4].format(k * j + 1) for j in range(5)]
        wrong = k % 4 == 0
        if wrong:
            lines.insert(k % 5, bad[k // 4 % 3].format(k))
        docs.append((k, " ".join(lines), f"s{k % 3}", 0.0, False))
        if k < 160:
            kind = ["abusive", " Hateful", "SEXUAL"][k % 3] if wrong else "none"
            labels.append((k, k, "none" if k == 8 else kind, "a"))
    docs += [(1000, None, None, 0.0, False), (1001, "", "s1", 0.0, False), (1002, "?", "s1", 0.0, False), (1003, "The index holds 5 chunks. " * 30000 + "You are a filthy idiot number 7.", "s1", 0.0, False)]
    docs += [(1004, 'Raters saw "You are a filthy idiot number 3." in the index.', "s2", 0.0, False), (1005, "You are a f i l t h y 1d10t number 9.", "s2", 0.0, False), (1006, "You are a flithy idiot number 9.", "s2", 0.0, False)]
    labels += [(2000, None, "none", "a"), (2001, 12, None, "b"), (2002, 99999, "none", "b"), (2003, 5, "none", "b"), (2004, 5, "none", "c"), (2005, 5, "abusive", "d")]
    return docs, labels


def test_held_out_documents(spark):
    docs, labels = corpus()
    d, lab = spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)
    got = {r["doc_id"]: r for r in score_documents(d, train(d, lab)).collect()}
    assert len(got) == len(docs)
    held = {k: got[k]["flagged"] for k in range(160, 240)}
    assert sum(f == (k % 4 == 0) for k, f in held.items()) >= 78
    assert got[8]["flagged"], "a wrong label does not hide a document"
    assert [got[k]["flagged"] for k in range(1000, 1007)] == [False, False, False, True, False, True, True]
    assert got[1000]["score"] is None and got[1001]["score"] is None and got[1002]["score"] is None
    by = {r["source"]: r for r in rates(spark.createDataFrame(list(got.values()))).collect()}
    assert by[None]["documents"] == 1 and sum(r["documents"] for r in by.values()) == len(docs)


def test_no_labels_or_no_documents(spark):
    docs, labels = corpus()
    d, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    assert train(d, none) is None
    assert {r["flagged"] for r in score_documents(d, None).collect()} == {False}
    model = train(d, spark.createDataFrame(labels, LABELS))
    assert score_documents(spark.createDataFrame([], DOCS), model).collect() == []
    assert toxicity.train(spark.createDataFrame([], DOCS), spark.createDataFrame(labels, LABELS)) is None


def test_words_in_disguise():
    v = Vocabulary(["idiot", "filthy", "nakеd", "naked", "horny"])
    assert v["1d10t"] == v["idiot"] == v["idoit"] and v["h_o_r_n_y"] == v["horny"]
    assert v["nаkеd"] in (v["naked"], v.number["nakеd"])
    assert v["zzz"] == toxicity.UNKNOWN and v["50"] == 3
    assert shown('He said "you fool." and left.\nI d i o t s\n\nbad-\nly cut') == ["he", "said", "(", "you", "fool", ")", "and", "left", ".", "idiots", ".", "badly", "cut", "|"]
    assert tokens([None]) == tokens([""]) == ["\x00"] and tokens([]) == []
    assert v.stream(tokens(["no\x00t a mark", "b"])).tolist().count(toxicity.END_OF_TEXT) == 2


def units(text, v, quoted=False):
    u = Units.of(v.stream(tokens([text])), quoted)
    return [int(n) for n in np.bincount(u.unit)] if len(u) else [], u


def test_no_word_of_a_long_stretch_is_lost_and_no_trigram_is_cut():
    v = Vocabulary([f"w{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(100)])
    names = [w for w in v.number if w.startswith("w")]
    for n in (1, 40, 41, 60, 61, 100):
        words = names[:n]
        sizes, u = units(" ".join(words), v)
        assert sum(sizes) == n + 1 and len(sizes) == (1 if n <= 40 else -(-n // 20))
        numbers = [0, 0, *(v[w] for w in words), 1]
        assert list(zip(u.a.tolist(), u.b.tolist(), u.c.tolist())) == list(zip(numbers, numbers[1:], numbers[2:]))


def test_sentences_of_one_word_count_and_bare_signs_do_not():
    v = Vocabulary(["we", "met", "scumbag", "then", "he", "left"])
    assert units("We met. Scumbag! Then he left.", v)[0] == [3, 2, 4]
    assert units("?", v)[0] == units("! ! ", v)[0] == units('"Quoted words." ', v)[0] == []


def test_quotations_of_any_length_are_scored_apart():
    v = Vocabulary(["fool"])
    for n in (1, 599, 601, 5000):
        text = 'It says "' + "fool " * n + '" here.'
        own, quoted = units(text, v)[1], units(text, v, True)[1]
        assert own.c.tolist() == [2, 2, toxicity.QUOTE, 2, 1] and (quoted.c == v["fool"]).sum() == n
    assert (units('He is 6" tall, a fool.\nAnd 5" wide.', v)[1].c == v["fool"]).sum() == 1, "a sign that isn't closed in its paragraph quotes nothing"


def test_a_quoted_document_has_a_score_but_no_flag(spark):
    docs, labels = corpus()
    model = train(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS))
    (row,) = score_documents(spark.createDataFrame([(1, '"You are a filthy idiot number 3."', "s", 0.0, False)], DOCS), model).collect()
    assert row["score"] is None and row["quoted_score"] > model.threshold and not row["flagged"]


def test_probabilities_sum_to_one():
    rng = np.random.default_rng(0)
    n = 12
    keys = [np.unique(rng.integers(0, n**3, size)) for size in (200, 40)]
    model = kneser_ney.fit(n, keys, [rng.integers(1, 5, len(k)) for k in keys])
    words = np.arange(n)
    for a, b in [(0, 0), (3, 4), *((int(k[0] // n // n), int(k[0] // n % n)) for k in keys)]:
        total = np.exp(model.log_prob(np.full(n, a), np.full(n, b), words)).sum(1)
        assert np.abs(total - 1).max() < 1e-9
        assert abs(model.shared(np.full(n, b), words).sum() - 1) < 1e-9


def test_what_neither_class_has_seen_speaks_for_neither():
    keys = [np.array([5 * 144 + 6 * 12 + 7]), np.array([5 * 144 + 6 * 12 + 8])]
    model = kneser_ney.fit(12, keys, [np.array([3]), np.array([3])])
    toxic, ordinary = model.log_prob(np.array([9, 5, 5]), np.array([10, 6, 6]), np.array([11, 7, 8]))
    assert abs(toxic[0] - ordinary[0]) < 1e-9 and toxic[1] > ordinary[1] and toxic[2] < ordinary[2]


def test_threshold_parts_the_classes():
    score, toxic = np.array([0.1, 0.2, 3.0, 4.0]), np.array([0.0, 0.0, 1.0, 1.0])
    assert 0.2 < best_threshold(score, toxic, np.ones(4)) < 3.0


def test_labels_in_other_spellings(spark):
    rows = spark.createDataFrame([("Abusive ",), ("hate",), ("NONE",), ("maybe",), (None,)], "label string")
    assert [r[0] for r in rows.select(toxicity.label_class(F.col("label"))).collect()] == ["toxic", "toxic", "ordinary", None, None]
