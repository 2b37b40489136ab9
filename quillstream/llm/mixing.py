"""Sources mixed to target shares: balanced sampling by the cube method, in blocks and levels."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstream.runtime import cut

_EPS = 1e-9
STATE = "source string, item long, tokens long, base int, chance double, level int"


def flight(rng: np.random.Generator, chance: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Move inclusion probabilities along the null space of the two balancing constraints, documents and tokens, until at most two stay fractional.

    Three open units always leave a direction in which neither sum changes; a step along it, up or down at random so that every
    probability keeps its expectation, ends when one of the three reaches 0 or 1.
    """
    p = chance.copy()
    scale = max(float(tokens.max(initial=1)), 1.0)
    size = tokens / scale
    held: list[int] = []
    for i in np.flatnonzero((p > _EPS) & (p < 1 - _EPS)).tolist():
        held.append(i)
        if len(held) < 3:
            continue
        a, b, c = held
        u = (size[c] - size[b], size[a] - size[c], size[b] - size[a])  # orthogonal to (1, 1, 1) and to the sizes
        if abs(u[0]) + abs(u[1]) + abs(u[2]) < 1e-12:
            u = (1.0, -1.0, 0.0)
        up = down = np.inf
        for k, x in zip(held, u):
            if x > 0:
                up, down = min(up, (1 - p[k]) / x), min(down, p[k] / x)
            elif x < 0:
                up, down = min(up, p[k] / -x), min(down, (1 - p[k]) / -x)
        step = up if rng.random() * (up + down) < down else -down
        for k, x in zip(held, u):
            p[k] += step * x
            if p[k] < _EPS:
                p[k] = 0.0
            elif p[k] > 1 - _EPS:
                p[k] = 1.0
        held = [k for k in held if 0 < p[k] < 1]
    return p


def landing(chance: np.ndarray, tokens: np.ndarray, want: float, swaps: int = 4) -> np.ndarray:
    """Settle the few units that are left: the choice nearest to ``want`` tokens, then to the expected number.

    A large unit often stays open longest, as its size leaves it little room to move. What error its landing makes is taken back by
    exchanging a drawn unit for another whose size differs by as much.
    """
    p = chance.copy()
    left = np.flatnonzero((p > 0) & (p < 1))
    number = p[left].sum()
    rest = want - (p[(p == 1)] * tokens[p == 1]).sum()
    best = min(range(1 << len(left)), key=lambda m: (abs(m.bit_count() - number) > 1, abs(sum(int(tokens[k]) for j, k in enumerate(left) if m >> j & 1) - rest), m))
    for j, k in enumerate(left):
        p[k] = best >> j & 1
    for _ in range(swaps):
        error = (p * tokens).sum() - want
        ins, outs = np.flatnonzero(p == 1), np.flatnonzero(p == 0)
        if abs(error) < 1 or not len(ins) or not len(outs):
            break
        outs = outs[np.argsort(tokens[outs], kind="stable")]
        goal = tokens[ins] - error  # the size to take in for each unit given up
        at = np.searchsorted(tokens[outs], goal)
        near = np.stack([np.clip(at - 1, 0, len(outs) - 1), np.clip(at, 0, len(outs) - 1)], 1)
        miss = np.abs(tokens[outs][near] - goal[:, None])
        i, j = np.unravel_index(np.argmin(miss), miss.shape)
        if miss[i, j] >= abs(error):
            break
        p[ins[i]], p[outs[near[i, j]]] = 0.0, 1.0
    return p


def _block(seed: int, level: int, last: bool):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([("item", "ascending"), ("tokens", "ascending")])
        chance, tokens = table.column("chance").to_numpy(), table.column("tokens").to_numpy()
        name = table.column("source")[0].as_py() or ""
        rng = np.random.default_rng([seed, level, len(tokens), int(tokens.sum()) % 2**31, *name.encode()])
        order = rng.permutation(len(tokens))
        p = np.empty(len(tokens))
        p[order] = flight(rng, chance[order], tokens[order])
        if last:
            p = landing(p, tokens, float((chance * tokens).sum()))
        done = (p == 0) | (p == 1)
        return pa.table(
            {
                "source": table.column("source"), "item": table.column("item"), "tokens": table.column("tokens"), "base": table.column("base"),
                "chance": pa.array(p), "level": pa.array(np.where(done, -1, level + 1).astype(np.int32)),
            }
        )

    return run


def source_plan(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, documents, tokens, target_share, max_repeats, uses``: the mean number of uses of each document of a source.

    The mix is as large as it can be without any document used more than ``max_repeats`` times: the source that is smallest for its share sets the
    size. Targets of sources without tokens can't be met; the others keep their proportions. Sources without a target, or with none above 0, are not used.
    """
    have = sizes.groupBy("source").agg(F.count("*").alias("documents"), F.sum("tokens").alias("tokens"))
    goal = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.sum("target_share").alias("target_share"), F.min("max_repeats").alias("max_repeats"))
    met = have.join(goal, "source").where("tokens > 0")
    unit = met.agg(F.min(F.col("tokens") * F.col("max_repeats") / F.col("target_share")).alias("unit")).first()["unit"] or 0.0
    uses = F.least(unit * F.col("target_share") / F.col("tokens"), F.col("max_repeats").cast("double"))
    return met.select("source", "documents", "tokens", "target_share", "max_repeats", uses.alias("uses"))


def mix(sizes: DataFrame, targets: DataFrame, block: int = 4096, seed: int = 11) -> DataFrame:
    """``source, item, tokens, copies``: every document of the mix and how often it is used, from ``sizes`` (source, item, tokens).

    A document of a source with ``uses`` of 2.3 is used twice, and a third time with probability 0.3. These third uses are drawn by the cube
    method, balanced on the number of documents and of tokens: blocks of about ``block`` documents of one source (of any size; blocks are cut by hash) each
    move their probabilities until at most two documents stay open, and the open ones form the blocks of the next level, until a source has one block, which lands. So the sums
    of a source miss their targets by less than two documents, mostly by far less, and no task ever holds more than a block.

    Documents without tokens, with a null source or of a source without target are not used. Items repeated with the same size count once. An empty table, or no target that
    can be met, gives an empty result. Other columns are not looked at.
    """
    named = sizes.where("source is not null and item is not null and tokens > 0").select("source", F.col("item").cast("long").alias("item"), F.col("tokens").cast("long").alias("tokens")).distinct()
    rows = cut(named)
    plan = cut(source_plan(rows, targets).select("source", "documents", F.when(F.abs(F.col("uses") - F.round("uses")) < 1e-9, F.round("uses")).otherwise(F.col("uses")).alias("uses")))
    largest = plan.agg(F.max("documents").alias("n")).first()["n"] or 0
    open_ = rows.join(plan, "source").select(
        "source", "item", "tokens", F.floor("uses").cast("int").alias("base"), (F.col("uses") - F.floor("uses")).alias("chance"), F.lit(0).alias("level")
    )
    sure = open_.where("chance = 0")
    open_ = open_.where("chance > 0")
    done = []
    level, left = 0, largest
    while True:
        blocks = max(1, -(-left // block))
        cell = F.pmod(F.xxhash64("item", "tokens", F.lit(level)), F.lit(blocks))
        state = cut(open_.withColumn("cell", cell).groupBy("source", "cell").applyInArrow(_block(seed, level, blocks == 1), STATE))
        done.append(state.where("level < 0"))
        if blocks == 1:
            break
        open_, left, level = state.where("level >= 0"), 2 * blocks, level + 1
    drawn = done[0]
    for d in done[1:]:
        drawn = drawn.unionByName(d)
    all_ = sure.unionByName(drawn).select("source", "item", "tokens", (F.col("base") + F.col("chance").cast("int")).alias("copies"))
    return all_.where("copies > 0")


def share_report(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """``source, target_share, actual_share, documents, uses, most_uses, tokens`` of every source with a target, 0 where it gave nothing."""
    got = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.sum("copies").alias("uses"), F.max("copies").alias("most_uses"), F.sum(F.col("copies") * F.col("tokens")).alias("tokens")
    )
    goal = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    joined = goal.join(got, "source", "left")
    number = lambda c: F.coalesce(c, F.lit(0))
    total = mixed.agg(F.sum(F.col("copies") * F.col("tokens")).alias("total")).first()["total"] or 1
    return joined.select(
        "source", "target_share", (number("tokens") / total).alias("actual_share"), *(number(c).alias(c) for c in ("documents", "uses", "most_uses", "tokens"))
    )
