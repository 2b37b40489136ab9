import math
import random

import pytest

from quillstream.llm import topn
from quillstream.llm.topn import top_n_per_group

SCHEMA = "grp string, item long, score double, tie double, g int, i int, s int"


def brute(rows, n):
    best = {}
    for grp, item, score, tie, *_ in rows:
        if grp is None or item is None or score is None or math.isnan(score):
            continue
        key = (-score, -(tie if tie is not None and not math.isnan(tie) else -math.inf), item)
        held = best.setdefault(grp, {})
        held[item] = min(held.get(item, key), key)
    return {(g, i) for g, held in best.items() for i in sorted(held, key=held.get)[:n]}


@pytest.mark.parametrize("seed", [1, 2])
def test_equals_brute_force_with_dirt_ties_and_a_hot_group(spark, seed, monkeypatch):
    rnd = random.Random(seed)
    rows = []
    for k in range(3000):
        grp = rnd.choice([None, "hot", "hot", *(f"g{j}" for j in range(60))])
        score = rnd.choice([None, float("nan"), float(rnd.randint(0, 9)), rnd.random() * 10])
        rows.append((grp, rnd.choice([None, k, k, k // 2]), score, rnd.choice([None, float("nan"), 1.0, 2.0]), 0, 0, 0))
    rows += rows[:200]
    got = top_n_per_group(spark.createDataFrame(rows, SCHEMA), "grp", "item", "score", "tie", 3)
    assert {(r["grp"], r["item"]) for r in got.collect()} == brute(rows, 3)
    monkeypatch.setattr(topn, "FEW", 0)  # without a broadcast
    got = top_n_per_group(spark.createDataFrame(rows, SCHEMA), "grp", "item", "score", "tie", 3)
    assert {(r["grp"], r["item"]) for r in got.collect()} == brute(rows, 3)


def test_an_item_scored_more_often_than_a_band_keeps(spark):
    rows = [("hot", 1, 100.0 - k, 1.0, 0, 0, 0) for k in range(20)]
    rows += [("hot", 2, 100.5, None, 0, 0, 0), ("hot", 2, 100.5, 2.0, 0, 0, 0), ("hot", 3, 80.5, 1.0, 0, 0, 0), ("hot", 4, 80.0, 1.0, 0, 0, 0)]
    rows += [("cold", k, float(k % 50), 1.0, 0, 0, 0) for k in range(400)]
    got = top_n_per_group(spark.createDataFrame(rows, SCHEMA), "grp", "item", "score", "tie", 3)
    assert {(r["grp"], r["item"]) for r in got.collect()} == brute(rows, 3)
    assert [(r["item"], r["score"], r["tie"]) for r in got.where("grp = 'hot'").orderBy("rank").collect()] == [(2, 100.5, 2.0), (1, 100.0, 1.0), (3, 80.5, 1.0)]


def test_empty_table_infinite_scores_and_no_tie(spark):
    assert top_n_per_group(spark.createDataFrame([], SCHEMA), "grp", "item", "score", "tie").collect() == []
    rows = [("a", 1, math.inf, None, 0, 0, 0), ("a", 2, -math.inf, None, 0, 0, 0), ("a", 3, 0.0, None, 0, 0, 0)]
    got = top_n_per_group(spark.createDataFrame(rows, SCHEMA), "grp", "item", "score", n=2).orderBy("rank").collect()
    assert [(r["item"], r["rank"]) for r in got] == [(1, 1), (3, 2)]


def test_n_must_be_positive(spark):
    with pytest.raises(ValueError):
        top_n_per_group(spark.createDataFrame([], SCHEMA), "grp", "item", "score", n=0)
