"""Items into containers of fixed capacity: a grouping genetic algorithm on islands."""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillstream.runtime import cut

ELITE = "shard long, island int, rank int, bins_used int, fitness double, bins array<int>"
PAIRED = 60  # displaced items that are tried two for two, the largest; the others are tried one for one and best-fitted


def best_fit(sizes: np.ndarray, items: list[int], bins: np.ndarray, free: dict[int, int], capacity: int) -> None:
    """Put ``items`` one by one into the fullest bin of ``free`` (bin to room) that takes them, else into a new one."""
    rooms = sorted((room, b) for b, room in free.items())
    new = max(free, default=-1) + 1
    for i in items:
        size = int(sizes[i])
        at = bisect_left(rooms, (size, -1))
        if at < len(rooms):
            room, b = rooms.pop(at)
        else:
            room, b, new = capacity, new, new + 1
        bins[i] = b
        insort(rooms, (room - size, b))


def compact(bins: np.ndarray) -> np.ndarray:
    return np.unique(bins, return_inverse=True)[1].astype(np.int32)


def fitness(sizes: np.ndarray, bins: np.ndarray, capacity: int) -> float:
    """Mean over the bins of the squared fill: a few full and some empty bins are better than many half full ones."""
    load = np.bincount(bins, weights=sizes)
    return float(np.mean((load / capacity) ** 2)) if len(load) else 1.0


def refill(sizes: np.ndarray, inside: dict[int, list[int]], room: dict[int, int], lost: list[int], capacity: int) -> list[int]:
    """Exchange what lies in bins for displaced items that fill them better, one for one, then two for two, the fullest bins first; what is displaced in the end."""
    lost = sorted(lost, key=lambda i: sizes[i])
    for b in sorted(room, key=room.get):
        if room[b] <= 0 or not lost:
            continue
        best, out, at = 0, -1, -1
        for i in inside[b]:
            k = bisect_right(lost, sizes[i] + room[b], key=lambda j: sizes[j]) - 1
            if k >= 0 and sizes[lost[k]] - sizes[i] > best:
                best, out, at = int(sizes[lost[k]] - sizes[i]), i, k
        if best:
            inside[b].remove(out)
            inside[b].append(lost.pop(at))
            room[b] -= best
            insort(lost, out, key=lambda j: sizes[j])
    some, rest = np.array(lost[-PAIRED:], np.int64), lost[:-PAIRED]
    if len(some) < 2:
        return lost
    x, y = np.triu_indices(len(some), 1)
    order = np.argsort(sizes[some[x]] + sizes[some[y]], kind="stable")
    x, y = x[order], y[order]
    pair = sizes[some[x]] + sizes[some[y]]
    free, back = np.ones(len(some), bool), []
    for b in sorted(room, key=room.get):
        if room[b] <= 0:
            continue
        best, out, at = 0, (), -1
        for i, j in combinations(inside[b][-PAIRED:], 2):
            base = int(sizes[i] + sizes[j])
            k = int(np.searchsorted(pair, base + room[b], "right")) - 1
            while k >= 0 and pair[k] > base + best and not (free[x[k]] and free[y[k]]):
                k -= 1
            if k >= 0 and pair[k] > base + best:
                best, out, at = int(pair[k] - base), (i, j), k
        if best:
            free[[x[at], y[at]]] = False
            inside[b] = [i for i in inside[b] if i not in out] + some[[x[at], y[at]]].tolist()
            room[b] -= best
            back += out
    return [*rest, *some[free].tolist(), *back]


def crossover(rng: np.random.Generator, sizes: np.ndarray, to: np.ndarray, source: np.ndarray, capacity: int) -> np.ndarray:
    """Well-filled bins of ``source`` enter ``to`` whole; bins of ``to`` that share an item with them are emptied, and what is displaced takes the place of what fills other bins less well, or is best-fitted, largest first."""
    load = np.bincount(source, weights=sizes)
    weight = (load / capacity) ** 8 + 1e-9
    chosen = rng.choice(len(load), max(1, len(load) // (3 if rng.random() < 0.5 else 8)), replace=False, p=weight / weight.sum())
    inside = np.isin(source, chosen)
    broken = np.unique(to[inside])
    # a few of the emptiest bins are emptied too, as a mutation
    own = np.bincount(to, weights=sizes)
    broken = np.union1d(broken, np.argsort(own)[: max(2, len(own) // 20)])
    lost = np.isin(to, broken) & ~inside
    child = to.astype(np.int64)
    child[inside] = source[inside] + len(own)
    held: dict[int, list[int]] = {}
    for i in np.flatnonzero(~lost).tolist():
        held.setdefault(int(child[i]), []).append(i)
    room = {b: capacity - int(sizes[items].sum()) for b, items in held.items()}
    rest = np.array(refill(sizes, held, room, np.flatnonzero(lost).tolist(), capacity), np.int64)
    for b, items in held.items():
        child[items] = b
    best_fit(sizes, rest[np.lexsort((rng.random(len(rest)), -sizes[rest]))].tolist(), child, room, capacity)
    return compact(child)


def decreasing(sizes: np.ndarray, capacity: int, noise: np.ndarray | None = None) -> np.ndarray:
    """Best-fit, the largest first."""
    bins = np.zeros(len(sizes), np.int64)
    best_fit(sizes, np.argsort(-(sizes if noise is None else sizes * (1 + noise)), kind="stable").tolist(), bins, {}, capacity)
    return compact(bins)


def fewest(sizes: np.ndarray, capacity: int) -> int:
    """Bins that no packing can do without: enough for the sum, and one for each item above half the capacity."""
    return max(-(-int(sizes.sum()) // capacity), int((sizes * 2 > capacity).sum()), int(len(sizes) > 0))


def evolve(rng: np.random.Generator, sizes: np.ndarray, population: list[np.ndarray], capacity: int, size: int, generations: int) -> list[np.ndarray]:
    """A population after some generations, best first."""
    while len(population) < size:
        population.append(decreasing(sizes, capacity, rng.normal(0, 0.1 * len(population), len(sizes)) if population else None))
    scored = sorted(((fitness(sizes, p, capacity), k, p) for k, p in enumerate(population)), key=lambda x: (-x[0], x[1]))
    least = fewest(sizes, capacity)
    serial = len(population)
    for _ in range(generations):
        if min(p.max(initial=-1) for *_, p in scored) + 1 <= least:  # no packing has fewer bins
            break
        for _ in range(max(1, size // 2)):
            a, b = rng.choice(len(scored), 2, replace=len(scored) < 2)
            child = crossover(rng, sizes, scored[min(a, b)][2], scored[max(a, b)][2], capacity)
            scored.append((fitness(sizes, child, capacity), serial, child))
            serial += 1
        scored = sorted(scored, key=lambda x: (-x[0], x[1]))[:size]
    return sorted((p for *_, p in scored), key=lambda p: int(p.max(initial=-1)))


PLACED = "shard long, item long, part int, tokens long, bin int, done boolean"


def _sorted_items(table: pa.Table) -> tuple[pa.Table, np.ndarray]:
    table = table.sort_by([("item", "ascending"), ("part", "ascending"), ("tokens", "ascending")])
    return table, table.column("tokens").to_numpy()


def _placed(table: pa.Table, bins: np.ndarray, capacity: int) -> pa.Table:
    done = int(bins.max(initial=-1)) + 1 <= fewest(table.column("tokens").to_numpy(), capacity)
    kinds = [("shard", pa.int64()), ("item", pa.int64()), ("part", pa.int32()), ("tokens", pa.int64()), ("bin", pa.int32()), ("done", pa.bool_())]
    table = table.select(["shard", "item", "part", "tokens"]).append_column("bin", pa.array(bins, pa.int32())).append_column("done", pa.array([done] * len(bins), pa.bool_()))
    return table.cast(pa.schema(kinds))


def _evolved(placed: DataFrame, capacity: int, islands: int, rounds: int, population: int, generations: int, elite: int) -> DataFrame:
    """The items of shards, with the bins they lie in, after islands have evolved packings of each shard that could have fewer bins; the others stay as they are."""
    spark = placed.sparkSession
    open_ = placed.where("not done").drop("done")
    shards = open_.select("shard").distinct().count()
    if not shards or not rounds:
        return placed
    spread = open_.withColumn("island", F.explode(F.sequence(F.lit(0), F.lit(islands - 1)))).repartition(int(min(shards * islands, 4096)), "shard", "island")
    names = pa.schema([("shard", pa.int64()), ("island", pa.int32()), ("rank", pa.int32()), ("bins_used", pa.int32()), ("fitness", pa.float64()), ("bins", pa.list_(pa.int32()))])

    def live(step: int):
        def run(held: pa.Table, came: pa.Table) -> pa.Table:
            if not held.num_rows:
                return names.empty_table()
            where, island = held.column("shard")[0].as_py(), held.column("island")[0].as_py()
            held, sizes = _sorted_items(held)
            rng = np.random.default_rng([where, island, step])
            came = came.sort_by([("fitness", "descending"), ("rank", "ascending")])
            before = [np.array(b, np.int64) for b in came.column("bins").to_pylist()] if came.num_rows else [compact(held.column("bin").to_numpy())]
            best = evolve(rng, sizes, before, capacity, population, generations)[: population if step + 1 < rounds else 1]
            n = len(best)
            return pa.table([[where] * n, [island] * n, list(range(n)), [int(p.max()) + 1 for p in best], [fitness(sizes, p, capacity) for p in best], [p.astype(np.int32) for p in best]], schema=names)

        return run

    state = spark.createDataFrame([], ELITE)
    for step in range(rounds):
        if step:  # all stay, the elite goes to the next island as well
            moved = state.where(F.col("rank") < elite).withColumn("island", F.pmod(F.col("island") + 1, F.lit(islands)).cast("int"))
            state = state.where(F.col("rank") < population - elite).unionByName(moved)
        state = cut(spread.groupBy("shard", "island").cogroup(state.groupBy("shard", "island")).applyInArrow(live(step), ELITE))
    order = Window.partitionBy("shard").orderBy("bins_used", F.desc("fitness"), "island", "rank")
    best = state.withColumn("r", F.row_number().over(order)).where("r = 1").select("shard", "bins")

    def place(held: pa.Table, found: pa.Table) -> pa.Table:
        if not held.num_rows:
            return _placed(held.append_column("done", pa.array([], pa.bool_())), np.zeros(0, np.int32), capacity)
        held, _ = _sorted_items(held)
        return _placed(held, np.array(found.column("bins")[0].as_py(), np.int32), capacity)

    return placed.where("done").unionByName(open_.groupBy("shard").cogroup(best.groupBy("shard")).applyInArrow(place, PLACED))


def _emptiest(placed: DataFrame, most: int) -> DataFrame:
    """The emptiest bins of each shard, with at most about ``most`` items, two bins at least."""
    bins = placed.groupBy("shard", "bin").agg(F.sum("tokens").alias("load"), F.count("*").alias("n"))
    order = Window.partitionBy("shard").orderBy("load", "bin")
    running = bins.select("shard", "bin", F.row_number().over(order).alias("r"), F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("items"))
    return running.where((F.col("r") <= 2) | (F.col("items") <= most)).select("shard", "bin")


def pack(
    df: DataFrame, key: str, size: str, capacity: int = 2048, shard: int = 1500, islands: int = 2, rounds: int = 2, population: int = 8, generations: int = 12, elite: int = 2, fan: int = 16
) -> DataFrame:
    """``container, key, part, tokens``: every item in one container of at most ``capacity``, as few as the search finds.

    An item larger than the capacity is cut into parts of exactly the capacity and a rest (``part`` counts from 0), the only case of a cut; the full parts
    take containers of their own. All others are spread over shards of about ``shard`` items by hash and best-fitted there. For each shard that this leaves with more containers than
    the least there can be, several islands evolve packings of its items, apart from each other; after each round every island's ``elite`` moves on to the next island, and the best packing
    of the shard is taken at the end. Then the emptiest containers of ``fan`` shards each, about as many items as a shard has, are pooled and evolved again in the same way, those of ``fan`` pools after that, and so
    on until one pool is left, as each shard alone leaves containers that no island can fill. ``rounds`` of 0 leaves what best-fit gives each shard.

    A null or negative size counts as 0, and such items are packed too. Rows with a null key are left out. Repeated keys are items of their own only if
    they differ in size. An empty table gives an empty result. Other columns are not looked at.
    """
    if fan < 2 or islands < 1:
        raise ValueError("fan must be at least 2, islands at least 1")
    raw = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("item"), F.greatest(F.coalesce(F.col(size).cast("long"), F.lit(0)), F.lit(0)).alias("tokens")).distinct()
    rest = F.when(F.col("tokens") > capacity, F.pmod(F.col("tokens"), F.lit(capacity))).otherwise(F.col("tokens"))
    whole = F.when(F.col("tokens") > capacity, F.floor(F.col("tokens") / capacity)).otherwise(F.lit(0)).cast("int")
    parts = cut(raw.select("item", "tokens", whole.alias("whole"), rest.alias("rest")))
    full = parts.where("whole > 0").select("item", F.explode(F.sequence(F.lit(0), F.col("whole") - 1)).alias("part"))
    shards = max(1, -(-parts.count() // shard))
    items = parts.where("rest > 0 or whole = 0").select(
        F.pmod(F.xxhash64("item", "tokens"), F.lit(shards)).alias("shard"), "item", F.col("whole").alias("part"), F.col("rest").alias("tokens")
    )

    def fit(table: pa.Table) -> pa.Table:
        table, sizes = _sorted_items(table)
        return _placed(table, decreasing(sizes, capacity), capacity)

    def evolved(d: DataFrame) -> DataFrame:
        return cut(_evolved(d, capacity, islands, rounds, population, generations, elite))

    named = lambda d, level: d.select(F.concat_ws("-", F.lit(f"s{level}"), "shard", "bin").alias("container"), F.col("item").alias(key), "part", "tokens")
    own = full.select(F.concat_ws("-", F.lit("w"), "item", "part").alias("container"), F.col("item").alias(key), "part", F.lit(capacity).cast("long").alias("tokens"))
    placed = evolved(cut(items.groupBy("shard").applyInArrow(fit, PLACED)))
    out, level = own, 0
    while shards > 1 and rounds:
        picked = cut(_emptiest(placed, shard // fan))
        out = out.unionByName(named(placed.join(picked, ["shard", "bin"], "left_anti"), level))
        # in a pool all bins need numbers of their own; a pool is open to better packings again
        pooled = placed.join(picked, ["shard", "bin"]).withColumn("bin", (F.pmod("shard", F.lit(fan)) * shard + F.col("bin")).cast("int"))
        pooled = pooled.withColumn("shard", F.floor(F.col("shard") / fan)).groupBy("shard").applyInArrow(lambda t: _placed(t, compact(t.column("bin").to_numpy()), capacity), PLACED)
        shards, level = -(-shards // fan), level + 1
        placed = evolved(cut(pooled))
    return out.unionByName(named(placed, level))


def fill_report(packed: DataFrame, capacity: int) -> DataFrame:
    """``containers, tokens, least_containers, fill, over``: how full the containers are, the fewest there can be, and how many break the limit."""
    each = packed.groupBy("container").agg(F.sum("tokens").alias("tokens"))
    total = each.agg(F.count("*").alias("containers"), F.coalesce(F.sum("tokens"), F.lit(0)).alias("tokens"), F.count_if(F.col("tokens") > capacity).alias("over"))
    return total.select(
        "containers", "tokens", F.ceil(F.col("tokens") / capacity).alias("least_containers"), (F.col("tokens") / F.greatest(F.col("containers") * capacity, F.lit(1))).alias("fill"), "over"
    )


def soundness(packed: DataFrame, key: str, capacity: int) -> DataFrame:
    """``documents, cut_small, over``: packed keys, those in several parts whose tokens would fit one container, and containers over the limit."""
    keys = packed.groupBy(key).agg(F.count("*").alias("parts"), F.sum("tokens").alias("tokens"))
    small = keys.agg(F.count("*").alias("documents"), F.count_if((F.col("parts") > 1) & (F.col("tokens") <= capacity)).alias("cut_small"), F.lit(0).cast("long").alias("over"))
    over = packed.groupBy("container").agg(F.sum("tokens").alias("tokens")).agg(F.count_if(F.col("tokens") > capacity).alias("over"))
    both = small.unionByName(over, allowMissingColumns=True)
    return both.agg(*(F.sum(c).alias(c) for c in ("documents", "cut_small", "over")))
