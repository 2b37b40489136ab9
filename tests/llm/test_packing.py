import numpy as np

from quillstream.llm.packing import compact, crossover, decreasing, evolve, fewest, fill_report, fitness, pack, refill, soundness

SCHEMA = "doc long, size long, shard int, tokens int, item int"


def packed(spark, sizes, **how):
    return pack(spark.createDataFrame([(k, s, 0, 0, 0) for k, s in enumerate(sizes)], SCHEMA), "doc", "size", **how)


def test_every_item_once_and_no_bin_over(spark):
    rng = np.random.default_rng(3)
    sizes = [int(s) for s in rng.integers(0, 900, 700)] + [None, -5, 0, 1000, 1001, 3456]
    rows = packed(spark, sizes, capacity=1000, shard=200).collect()
    total, load = {}, {}
    for r in rows:
        total[r["doc"]] = total.get(r["doc"], 0) + r["tokens"]
        load[r["container"]] = load.get(r["container"], 0) + r["tokens"]
    assert total == {k: max(s or 0, 0) for k, s in enumerate(sizes)}
    assert max(load.values()) <= 1000
    assert sorted(r["part"] for r in rows if r["doc"] == len(sizes) - 1) == [0, 1, 2, 3]
    assert all(sum(1 for r in rows if r["doc"] == k) == 1 for k, s in enumerate(sizes) if (s or 0) <= 1000)
    least = sum(total.values()) / 1000
    assert len(load) <= 1.05 * least + 4


def test_empty_table_and_report(spark):
    empty = packed(spark, [])
    assert empty.collect() == []
    assert tuple(fill_report(empty, 1000).first()) == (0, 0, 0, 0.0, 0)
    assert tuple(fill_report(packed(spark, [600, 400, 500], capacity=1000), 1000).first()) == (2, 1500, 2, 0.75, 0)


def test_evolution_keeps_items_and_does_not_get_worse():
    rng = np.random.default_rng(1)
    sizes = rng.integers(100, 600, 200)
    first = evolve(np.random.default_rng(0), sizes, [], 1000, 6, 0)
    last = evolve(np.random.default_rng(0), sizes, [p.copy() for p in first], 1000, 6, 15)
    assert fitness(sizes, last[0], 1000) >= fitness(sizes, first[0], 1000)
    for p in last:
        assert len(p) == 200 and np.bincount(p, weights=sizes).max() <= 1000 and np.bincount(p, weights=sizes).min() > 0
    child = crossover(np.random.default_rng(2), sizes, last[0], first[-1], 1000)
    assert np.bincount(child, weights=sizes).max() <= 1000 and (compact(child) == child).all()


def test_crossover_beats_best_fit_on_items_of_a_quarter_to_half(spark):
    for seed in range(3):
        sizes = np.random.default_rng(seed).integers(533, 1024, 600)
        fitted = int(decreasing(sizes, 2048).max()) + 1
        best = evolve(np.random.default_rng(0), sizes, [], 2048, 8, 12)[0]
        assert fewest(sizes, 2048) <= best.max() + 1 <= fitted - 5
    rows = [int(s) for s in np.random.default_rng(9).integers(533, 1024, 900)]
    counts = [packed(spark, rows, shard=300, rounds=r, fan=2).select("container").distinct().count() for r in (0, 2)]
    assert counts[1] < counts[0]


def test_pools_fill_what_shards_leave(spark):
    rng = np.random.default_rng(4)
    sizes = [int(s) for s in rng.integers(1, 120, 2000)]
    got = packed(spark, sizes, capacity=1000, shard=100, fan=3)
    report = fill_report(got, 1000).first()
    assert report["containers"] <= report["least_containers"] + 1 and report["over"] == 0
    assert fill_report(packed(spark, sizes, capacity=1000, shard=100, rounds=0), 1000).first()["containers"] > report["least_containers"] + 5
    assert tuple(soundness(got, "doc", 1000).first()) == (2000, 0, 0)


def test_refill_keeps_items_and_capacity():
    rng = np.random.default_rng(7)
    sizes = rng.integers(100, 500, 120)
    bins = decreasing(sizes, 1000)
    lost = np.flatnonzero(bins < 8).tolist()
    held = {}
    for i in np.flatnonzero(bins >= 8).tolist():
        held.setdefault(int(bins[i]), []).append(i)
    room = {b: 1000 - int(sizes[v].sum()) for b, v in held.items()}
    before = sum(room.values())
    rest = refill(sizes, held, room, lost, 1000)
    assert sorted([*rest, *(i for v in held.values() for i in v)]) == list(range(120)) and sum(room.values()) <= before
    assert all(room[b] == 1000 - sizes[v].sum() >= 0 for b, v in held.items())
