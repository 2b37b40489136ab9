import numpy as np
import pytest

from quillstream.llm.mixing import flight, landing, mix, share_report

SIZES = "source string, item long, tokens long, level int, base int, chance string"
TARGETS = "source string, target_share double, max_repeats int"


def sized(spark, rows):
    return spark.createDataFrame([(*r, 0, 0, "x") for r in rows], SIZES)


def corpus(seed=0):
    rng = np.random.default_rng(seed)
    rows = [("big", k, int(rng.integers(10, 900))) for k in range(6000)]
    rows += [("small", 10_000 + k, int(rng.integers(10, 900))) for k in range(150)]
    rows += [("unlisted", 20_000, 50), (None, 20_001, 60), ("big", 20_002, 0), ("big", 20_003, None), ("big", None, 7)]
    return rows


GOAL = [("big", 0.7, 1), ("small", 0.2, 3), ("absent", 0.1, 2), (None, 0.3, 1), ("zero", 0.0, 1)]


@pytest.mark.parametrize("block", [128, 10_000])
def test_shares_are_met_without_too_many_repeats(spark, block):
    mixed = mix(sized(spark, corpus()), spark.createDataFrame(GOAL, TARGETS), block)
    report = {r["source"]: r for r in share_report(mixed, spark.createDataFrame(GOAL, TARGETS)).collect()}
    assert abs(report["big"]["actual_share"] - 7 / 9) < 0.005 and abs(report["small"]["actual_share"] - 2 / 9) < 0.005
    assert report["absent"]["uses"] == 0 and report["small"]["most_uses"] <= 3 and report["big"]["most_uses"] == 1
    items = [r["item"] for r in mixed.collect()]
    assert len(items) == len(set(items)) and not {20_000, 20_001, 20_002, 20_003} & set(items)


def test_empty_tables(spark):
    none, goal = sized(spark, []), spark.createDataFrame(GOAL, TARGETS)
    assert mix(none, goal).collect() == []
    assert mix(sized(spark, corpus()[:50]), spark.createDataFrame([], TARGETS)).collect() == []
    assert {r["tokens"] for r in share_report(mix(none, goal), goal).collect()} == {0}


def test_repeated_rows_count_once(spark):
    goal = spark.createDataFrame([("a", 1.0, 2)], TARGETS)
    assert [tuple(r) for r in mix(sized(spark, [("a", 1, 5), ("a", 1, 5)]), goal).collect()] == [("a", 1, 5, 2)]


def test_flight_keeps_both_sums_and_leaves_two_open():
    rng = np.random.default_rng(0)
    tokens = rng.integers(1, 1000, 500)
    p = flight(np.random.default_rng(1), np.full(500, 0.3), tokens)
    assert ((p > 0) & (p < 1)).sum() <= 2
    assert abs(p.sum() - 150) < 1e-6 and abs((p * tokens).sum() - 0.3 * tokens.sum()) < 1e-3
    settled = landing(p, tokens, 0.3 * tokens.sum())
    assert set(np.unique(settled)) <= {0.0, 1.0} and abs((settled * tokens).sum() - 0.3 * tokens.sum()) < 10


def test_each_unit_keeps_its_probability():
    tokens = np.arange(1, 21)
    drawn = np.mean([landing(flight(np.random.default_rng(s), np.full(20, 0.4), tokens), tokens, 84.0, swaps=0) for s in range(400)], axis=0)
    assert np.abs(drawn - 0.4).max() < 0.12
