"""The most similar vectors of every vector: small-world graphs per shard, results merged."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillstream.llm.hnsw import build, search
from quillstream.runtime import cut

ROUTED = "slot int, home boolean, asked boolean, vector_id long, vector binary"
FEW = 20_000
FLAT = 1024  # so many cells are fitted at once; more of them below about the square root of as many
FOUND = "vector_id long, neighbour_id long, cosine double"


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and vectors of the usable rows: ``dim`` finite entries, not all zero."""
    sizes = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == dim)
    values = column.take(pa.array(rows)).flatten().cast(pa.float32()).fill_null(np.nan)
    vectors = values.to_numpy(zero_copy_only=False).reshape(-1, dim)
    good = np.isfinite(vectors).all(1) & (vectors != 0).any(1)
    return rows[good], vectors[good]


def _unit(vectors: np.ndarray) -> np.ndarray:
    wide = vectors.astype(np.float64)
    wide /= np.abs(wide).max(1, keepdims=True)
    return wide / np.linalg.norm(wide, axis=1, keepdims=True)


def _parallel(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether unit vectors have a cosine of 1 at 12 places."""
    return np.round(np.einsum("ij,ij->i", a, b), 12) >= 1


def _key(unit: np.ndarray) -> np.ndarray:
    """A number for the direction of each unit vector, hashed from its entries at 4 places; scaled copies differ in it only where an entry lies at the edge of rounding."""
    weights = np.random.default_rng(11).integers(-(2**63), 2**63 - 1, unit.shape[1], np.int64) | 1
    return (np.rint(unit * 1e4).astype(np.int64) * weights).sum(1)


def _leaders(unit: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """For each unit vector the number of the one of smallest id among those of cosine 1 to it: only vectors next to each other on a random line are compared."""
    lead = np.arange(len(unit))
    line = np.random.default_rng(5).normal(size=unit.shape[1])
    on = unit @ (line / np.linalg.norm(line))
    order = np.argsort(on)
    ends = np.append(np.flatnonzero(np.diff(on[order]) > 2e-6) + 1, len(order))
    begins = np.append(0, ends[:-1])
    for begin, end in zip(begins[ends - begins > 1], ends[ends - begins > 1]):
        rest = order[begin:end]
        rest = rest[np.argsort(ids[rest], kind="stable")]
        while len(rest):
            same = np.round(unit[rest] @ unit[rest[0]], 12) >= 1
            same[0] = True
            lead[rest[same]] = rest[0]
            rest = rest[~same]
    return lead


@dataclass
class Crowds:
    """Directions that more than ``k + 1`` vectors share: sorted keys, a unit vector and its id for each, and the largest id that is indexed."""

    key: np.ndarray
    unit: np.ndarray
    first: np.ndarray
    last: np.ndarray

    def of(self, unit: np.ndarray) -> np.ndarray:
        """The number of the crowd each unit vector belongs to, or -1."""
        out = np.full(len(unit), -1)
        if len(self.key) and len(unit):
            key = _key(unit)
            at = np.minimum(np.searchsorted(self.key, key), len(self.key) - 1)
            hit = np.flatnonzero(self.key[at] == key)
            hit = hit[_parallel(unit[hit], self.unit[at[hit]])]
            out[hit] = at[hit]
        return out


def _blocks(n: int, width: int) -> Iterator[slice]:
    """Slices of ``n`` rows that have about four million numbers at ``width`` each."""
    step = max(1, (1 << 22) // max(width, 1))
    return (slice(at, at + step) for at in range(0, n, step))


def nearest_cells(unit: np.ndarray, centres: np.ndarray, most: int, margin: float) -> tuple[np.ndarray, np.ndarray]:
    """For each unit vector its ``most`` most similar centres, the best first, and whether it lies close to them: the best one always, the others if they are less similar by no more than ``margin`` times the distance of the two centres."""
    most = min(most, len(centres))
    top, close = np.empty((len(unit), most), np.int64), np.empty((len(unit), most), bool)
    for rows in _blocks(len(unit), len(centres)):
        sims = unit[rows].astype(np.float32) @ centres.T
        some = np.argpartition(-sims, most - 1, axis=1)[:, :most]
        value = np.take_along_axis(sims, some, 1)
        order = np.argsort(-value, axis=1, kind="stable")
        some, value = np.take_along_axis(some, order, 1), np.take_along_axis(value, order, 1)
        apart = np.sqrt(np.maximum(0, 2 - 2 * np.einsum("ij,ikj->ik", centres[some[:, 0]], centres[some])))
        top[rows], close[rows] = some, value[:, :1] - value <= margin * apart
    close[:, 0] = True
    return top, close


def fit_cells(sample: np.ndarray, cells: int, rounds: int = 10) -> tuple[np.ndarray, np.ndarray]:
    """Unit centres of ``cells`` cells and each cell's share of the sample, block by block."""
    rng = np.random.default_rng(7)
    centres = sample[rng.permutation(len(sample))[:cells]]

    def homes() -> np.ndarray:
        return np.concatenate([(sample[rows] @ centres.T).argmax(1) for rows in _blocks(len(sample), len(centres))])

    for _ in range(rounds):
        home = homes()
        order = np.argsort(home, kind="stable")
        first = np.flatnonzero(np.diff(home[order], prepend=-1))
        total = np.zeros_like(centres)
        total[home[order][first]] = np.add.reduceat(sample[order], first, axis=0)
        length = np.linalg.norm(total, axis=1, keepdims=True)
        centres = np.where(length > 1e-6, total / np.maximum(length, 1e-6), centres).astype(np.float32)
    return centres, np.bincount(homes(), minlength=len(centres)) / len(sample)


def _fit_below(rows: DataFrame, dim: int, total: int, top: np.ndarray, cells: int) -> tuple[np.ndarray, np.ndarray]:
    """About ``cells`` centres, each cell of ``top`` divided on the cluster by its share of a sample of about 64 vectors a cell."""
    step = max(1, total // (64 * cells))
    some = rows.where(F.pmod(F.xxhash64("vector_id", F.lit(3)), F.lit(step)) == 0)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, vectors in _each_batch(batches, dim):
            unit = _unit(vectors).astype(np.float32)
            yield pa.RecordBatch.from_arrays([pa.array(nearest_cells(unit, top, 1, 0)[0][:, 0]), pa.array([u.tobytes() for u in unit], pa.binary())], names=["cell", "vector"])

    def fit(table: pa.Table) -> pa.Table:
        unit = _vectors(table.column("vector"), dim)
        centres, share = fit_cells(unit, max(1, round(len(unit) / 64)))
        return pa.table({"centre": pa.array([c.tobytes() for c in centres], pa.binary()), "n": share * len(unit)})

    found = some.select("vector_id", "embedding").mapInArrow(assign, "cell long, vector binary").groupBy("cell").applyInArrow(fit, "centre binary, n double").toArrow()
    n = found.column("n").to_numpy()
    return _vectors(found.column("centre"), dim), n / n.sum()


def _sample(rows: DataFrame, dim: int, total: int, size: int) -> np.ndarray:
    """About ``size`` vectors chosen by the hash of their id, at most twice as many."""
    step = max(1, total // size)
    some = rows.where(F.pmod(F.xxhash64("vector_id"), F.lit(step)) == 0).dropDuplicates(["vector_id"]).limit(2 * size)
    column = some.select("embedding").toArrow().column(0).combine_chunks()
    return _unit(_matrix(column, dim)[1]).astype(np.float32) if len(column) else np.zeros((0, dim), np.float32)


def _each_batch(batches: Iterator[pa.RecordBatch], dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Ids and vectors of the usable rows."""
    for batch in batches:
        at, vectors = _matrix(batch.column("embedding"), dim)
        if len(at):
            yield batch.column("vector_id").to_numpy(zero_copy_only=False)[at].astype(np.int64), vectors


def _crowds(rows: DataFrame, dim: int, k: int) -> tuple[Broadcast, DataFrame] | None:
    """The at most ``FEW`` largest crowds, and ``crowd, vector_id`` of their members beyond the ``k + 1`` smallest ids; None if there is no crowd.

    Smaller crowds beyond that number are left to the shards, which are exact for any crowd.
    """

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _each_batch(batches, dim):
            yield pa.RecordBatch.from_arrays([pa.array(_key(_unit(vectors))), pa.array(ids)], names=["h", "vector_id"])

    keyed = rows.select("vector_id", "embedding").mapInArrow(keys, "h long, vector_id long").distinct()
    many = keyed.groupBy("h").agg(F.count("*").alias("n"), F.min("vector_id").alias("first")).where(F.col("n") > k + 1).orderBy(F.desc("n"), "h").limit(FEW).toArrow()
    if not many.num_rows:
        return None
    order = np.argsort(many.column("h").to_numpy())
    key, first = (many.column(c).to_numpy()[order] for c in ("h", "first"))

    def firsts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _each_batch(batches, dim):
            some = np.flatnonzero(np.isin(ids, first))
            h = _key(_unit(vectors[some]))
            at = np.minimum(np.searchsorted(key, h), len(key) - 1)
            good = (key[at] == h) & (first[at] == ids[some])
            yield pa.RecordBatch.from_arrays([pa.array(at[good]), pa.array([v.tobytes() for v in vectors[some[good]]], pa.binary())], names=["crowd", "vector"])

    found = rows.select("vector_id", "embedding").mapInArrow(firsts, "crowd long, vector binary").dropDuplicates(["crowd"]).orderBy("crowd").toArrow()
    sc = rows.sparkSession.sparkContext
    whole = Crowds(key, _unit(_vectors(found.column("vector"), dim)), first, np.full(len(key), np.iinfo(np.int64).max))
    held = sc.broadcast(whole)

    def members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _each_batch(batches, dim):
            crowd = held.value.of(_unit(vectors))
            yield pa.RecordBatch.from_arrays([pa.array(crowd[crowd >= 0]), pa.array(ids[crowd >= 0])], names=["crowd", "vector_id"])

    inside = cut(rows.select("vector_id", "embedding").mapInArrow(members, "crowd long, vector_id long").distinct())
    ranked = inside.withColumn("r", F.row_number().over(Window.partitionBy("crowd").orderBy("vector_id"))).where(F.col("r") <= k + 1)
    last = ranked.where(F.col("r") == k + 1).select("crowd", F.col("vector_id").alias("last"))
    limits = last.toArrow()
    bound = whole.last.copy()
    bound[limits.column("crowd").to_numpy()] = limits.column("last").to_numpy()
    schema = "crowd long, first long, last long"
    table = rows.sparkSession.createDataFrame(list(zip(range(len(key)), first.tolist(), bound.tolist())), schema)
    beyond = inside.join(F.broadcast(table), "crowd").where(F.col("vector_id") > F.col("last")).select("vector_id", "first")
    return sc.broadcast(Crowds(key, whole.unit, first, bound)), beyond


@dataclass
class Layout:
    """Where vectors go: cells around ``centres``; shards, ``parts`` of each cell, that hold an equal number of its vectors; and slots, ``copies`` of each shard, that share its guests. Every slot is one task."""

    centres: np.ndarray
    parts: np.ndarray
    copies: np.ndarray
    most: int
    margin: float

    @property
    def slots(self) -> int:
        return int((self.parts * self.copies).sum())

    @staticmethod
    def of(centres: np.ndarray, share: np.ndarray, sample: np.ndarray, total: int, shard: int, most: int, margin: float, asked: float) -> Layout:
        """``share``: of the vectors at home in each cell; ``asked``: of the vectors that are queries. A shard has at most about twice ``shard`` vectors, and a slot as many guests."""
        parts = np.maximum(1, np.ceil(share * total / (2 * shard))).astype(np.int64)
        top, close = nearest_cells(sample, centres, most, margin)
        guests = np.bincount(top[:, 1:][close[:, 1:]], minlength=len(centres)) / len(sample)
        guests = np.maximum(guests, share * guests.sum()) if len(sample) < 32 * len(centres) else guests
        return Layout(centres, parts, np.maximum(1, np.ceil(guests * total * asked / (2 * shard))).astype(np.int64), most, margin)


def _mixed(ids: np.ndarray, seed: int) -> np.ndarray:
    return ((ids.astype(np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64)


def _route(rows: DataFrame, dim: int, layout: Layout, every: int, crowds: Broadcast | None = None) -> DataFrame:
    """A row for each slot of the shard that indexes the vector, and one for one slot of every shard that it is a query to; none for members of ``crowds`` beyond the last that is indexed.

    A vector is a query to all shards of its own cell and of the cells it lies close to, at most ``layout.most`` cells.
    """
    per_cell = layout.parts * layout.copies
    first = np.cumsum(per_cell) - per_cell

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, vectors in _each_batch(batches, dim):
            unit = _unit(vectors)
            wanted = ids % every == 0
            if crowds is not None:
                crowd = crowds.value.of(unit)
                stays = (crowd < 0) | (ids <= crowds.value.last[crowd])
                wanted |= (crowd >= 0) & (ids == crowds.value.first[crowd])
                ids, vectors, unit, wanted = ids[stays], vectors[stays], unit[stays], wanted[stays]
                if not len(ids):
                    continue
            top, near = nearest_cells(unit, layout.centres, layout.most, layout.margin)
            near[~wanted, 1:] = False
            row, rank = np.nonzero(near)
            cell = top[row, rank]
            many = layout.parts[cell]
            row, cell, rank = (np.repeat(x, many) for x in (row, cell, rank))
            part = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)
            is_home = (rank == 0) & (part == (_mixed(ids, 0) % layout.parts[top[:, 0]])[row])
            query = wanted[row]
            used = is_home | query
            row, cell, part, is_home, query = row[used], cell[used], part[used], is_home[used], query[used]
            # a vector at home is in every copy of its shard, but asks only in one; a guest is in one
            copies = layout.copies[cell]
            mine = (_mixed(ids, 1)[row]) % copies
            times = np.where(is_home, copies, 1)
            row, cell, part, is_home, query, mine, copies = (np.repeat(x, times) for x in (row, cell, part, is_home, query, mine, copies))
            copy = np.where(is_home, np.arange(len(row)) - np.repeat(np.cumsum(times) - times, times), mine)
            query &= copy == mine
            slot = first[cell] + part * copies + copy
            packed = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(vectors), [None, pa.py_buffer(np.ascontiguousarray(vectors))])
            yield pa.RecordBatch.from_arrays(
                [pa.array(slot, pa.int32()), pa.array(is_home), pa.array(query), pa.array(ids[row]), packed.take(pa.array(row)).cast(pa.binary())],
                names=["slot", "home", "asked", "vector_id", "vector"],
            )

    return rows.select("vector_id", "embedding").mapInArrow(run, ROUTED).repartitionById(layout.slots, "slot")


def _vectors(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float32).reshape(-1, dim)


def _search_slots(dim: int, k: int, m: int, ef: int, ef_search: int, least: float):
    """For a partition, which holds whole slots, mostly one: the graph of each slot's vectors at home, and what its queries find in it."""

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        whole = list(batches)
        if whole:
            table = pa.Table.from_batches(whole)
            slot = table.column("slot").to_numpy()
            for one in np.unique(slot):
                yield from run(table.filter(pa.array(slot == one)) if (slot != one).any() else table).combine_chunks().to_batches()

    def run(table: pa.Table) -> pa.Table:
        ids = table.column("vector_id").to_numpy()
        home, asked = (table.column(c).to_numpy() for c in ("home", "asked"))
        vectors = _unit(_vectors(table.column("vector"), dim))
        points, first = np.unique(ids[home], return_index=True)
        index = np.flatnonzero(home)[first]
        mixed = np.random.default_rng(len(index)).permutation(len(index))
        points, index = points[mixed], index[mixed]
        out = []
        if len(index):
            exact = vectors[index]
            # the graph holds one point for each direction; the k + 1 smallest ids of a direction stand for it in the results
            leaders, group = np.unique(_leaders(exact, points), return_inverse=True)
            order = np.lexsort((points, group))
            begin = np.searchsorted(group[order], np.arange(len(leaders)))
            size = np.minimum(np.bincount(group), k + 1)
            graph = build(exact[leaders].astype(np.float32), m, ef)
            guests, where = np.unique(ids[~home], return_index=True)
            where = np.flatnonzero(~home)[where]
            own = np.flatnonzero(asked[index])
            for who, vec, mine in ((points[own], exact[own], group[own]), (guests, vectors[where], None)):
                if not len(who):
                    continue
                if mine is None:
                    near, _ = search(graph, vec.astype(np.float32), k + 6, ef_search)
                else:
                    once, back = np.unique(mine, return_inverse=True)
                    near, _ = search(graph, graph.points[once], k + 6, ef_search, once)
                    near = np.concatenate([once[:, None], near], 1)[back]
                row, col = np.nonzero(near >= 0)
                met = near[row, col]
                many = size[met]
                row = np.repeat(row, many)
                other = order[np.repeat(begin[met] - (np.cumsum(many) - many), many) + np.arange(len(row))]
                cos = np.round(np.einsum("ij,ij->i", vec[row], exact[other]), 12)
                good = (cos >= least) & (points[other] != who[row])
                row, other, cos = row[good], other[good], cos[good]
                by = np.lexsort((points[other], -cos, row))
                row, other, cos = row[by], other[by], cos[by]
                rank = np.arange(len(row)) - np.searchsorted(row, row)
                best = rank < k
                out.append(pa.table({"vector_id": who[row[best]], "neighbour_id": points[other[best]], "cosine": cos[best]}))
        empty = pa.table({"vector_id": pa.array([], pa.int64()), "neighbour_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        return pa.concat_tables([empty, *out])

    return slots


def _usable(embedding: Column, dim: int) -> Column:
    finite = F.forall(embedding, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return (F.size(embedding) == dim) & finite & F.exists(embedding, lambda x: x != 0)


def most_similar(
    df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, least: float = -1.0, margin: float = 0.25, most: int = 12, every: int = 1, shard: int = 16_000, sample: int = 65_536, m: int = 16, ef: int = 32, ef_search: int = 48
) -> DataFrame:
    """``vector_id, neighbour_id, cosine, rank``: the ``k`` most similar other vectors of every vector, equal cosines by smaller id.

    Vectors go to the cell of the most similar of some centres (k-means on at most 2 x ``sample`` vectors, of many cells on about 64 vectors each in two levels, the only part that is fitted on a sample); cells hold about
    ``shard`` vectors, larger ones are split, and each shard's graph holds every vector of it. A vector is searched for in the
    shards of its own cell and of the cells it lies close to (``margin``), at most ``most`` cells whatever their number, and the results are merged. A shard that many other vectors ask has
    several tasks, each with the graph and some of the guests. ``least`` drops less similar
    pairs before they are shuffled, which loses none above it. A smaller ``margin`` than the default is enough for high ``least``.

    Every vector is indexed; ``every`` restricts the vectors that neighbours are asked for to ids divisible by it.

    Of vectors of one direction (cosine 1 at 12 places, whatever their lengths), any number of them, the ``k + 1`` smallest ids are indexed; the others take these for their neighbours.

    A vector counts if it has ``dim`` finite entries, not all zero; others, null vectors and null ids give no row. Repeated rows of an id count once.
    An empty table gives an empty result. Other columns are not looked at.
    """
    rows = df.select(F.col(key).cast("long").alias("vector_id"), F.col(vector).cast("array<float>").alias("embedding")).where("vector_id is not null and embedding is not null")
    total = rows.count()
    cells = int(max(1, -(-total // shard)))
    points = _sample(rows, dim, total, min(sample, max(4096, 64 * cells)))
    if not len(points):
        points = np.eye(1, dim, dtype=np.float32)
    centres, share = fit_cells(points, min(cells if cells <= FLAT else math.isqrt(cells), len(points)))
    if cells > FLAT:
        centres, share = _fit_below(rows, dim, total, centres, cells)
    layout = Layout.of(centres, share, points, total, shard, most, margin, 1 / every)

    crowds, beyond = _crowds(rows, dim, k) or (None, None)
    found = _route(rows, dim, layout, every, crowds).mapInArrow(_search_slots(dim, k, m, ef, ef_search, least), FOUND)
    order = Window.partitionBy("vector_id").orderBy(F.desc("cosine"), "neighbour_id")
    best = lambda d: d.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    if beyond is None:
        return best(found)
    found = cut(found)
    firsts = rows.sparkSession.createDataFrame([(int(i),) for i in np.unique(crowds.value.first)], "first long")
    near = best(found.join(F.broadcast(firsts), F.col("vector_id") == F.col("first")).where("cosine >= 1")).select("first", "neighbour_id")
    near = near.unionByName(firsts.select("first", F.col("first").alias("neighbour_id")))
    spare = beyond.where(F.col("vector_id") % every == 0).join(F.broadcast(near), "first").select("vector_id", "neighbour_id").distinct().withColumn("cosine", F.lit(1.0))
    return best(found.where(F.col("vector_id") % every == 0).unionByName(spare))


# settings for neighbours of a cosine of 0.9 or more: such a vector rarely lies in a cell whose centre is so much less similar, and stands out among its graph neighbours
CLOSE = {"least": 0.9, "margin": 0.1, "most": 6, "shard": 8000, "m": 14, "ef": 28, "ef_search": 20}


def near_pairs(df: DataFrame, key: str, vector: str, k: int = 5, dim: int = 64, **how) -> DataFrame:
    """``vector_id_a, vector_id_b``, a < b: pairs of cosine ``least`` or more of which one is among the other's ``k`` nearest."""
    pairs = most_similar(df, key, vector, k, dim, **CLOSE | how)
    return pairs.select(F.least("vector_id", "neighbour_id").alias("vector_id_a"), F.greatest("vector_id", "neighbour_id").alias("vector_id_b")).distinct()


def recall(df: DataFrame, key: str, vector: str, found: DataFrame, k: int = 5, dim: int = 64, every: int = 100, block: int = 65_536, least: float = -1.0) -> DataFrame:
    """``k, queries, expected, met, wrong, recall`` of ``found`` against brute force, for all vectors whose id is divisible by ``every`` against all vectors, as far as their cosine is ``least`` or more.

    ``wrong``: what was found though it is less similar than the k-th nearest. Blocks of at most about ``block`` queries meet blocks of about ``block`` vectors. What is as similar as the k-th nearest counts as met.
    """
    rows = df.select(F.col(key).cast("long").alias("vector_id"), F.col(vector).cast("array<float>").alias("embedding")).where(_usable(F.col("embedding"), dim)).dropDuplicates(["vector_id"])
    parts = max(1, -(-df.count() // block))
    blocks = max(1, -(-parts // every))
    hashed = lambda n: F.pmod(F.xxhash64("vector_id"), F.lit(n)).cast("int")
    held = rows.withColumn("part", hashed(parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    asked = rows.where(F.col("vector_id") % every == 0).withColumn("block", hashed(blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def nearest(queries: pa.Table, points: pa.Table) -> pa.Table:
        out = [pa.table({"vector_id": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})]
        if queries.num_rows and points.num_rows:
            q, x = (_unit(_matrix(t.column("embedding").combine_chunks(), dim)[1]).astype(np.float32) for t in (queries, points))
            qi, xi = (t.column("vector_id").to_numpy() for t in (queries, points))
            for at in range(0, len(q), 256):
                ids = qi[at : at + 256]
                sims = q[at : at + 256] @ x.T
                sims[ids[:, None] == xi[None, :]] = -2
                top = np.argpartition(-sims, min(k, len(xi)) - 1, axis=1)[:, :k]
                out.append(pa.table({"vector_id": np.repeat(ids, top.shape[1]), "cosine": np.take_along_axis(sims, top, 1).ravel().astype(np.float64)}))
        return pa.concat_tables(out)

    exact = asked.groupBy("part", "block").cogroup(held.groupBy("part", "block")).applyInArrow(nearest, "vector_id long, cosine double").where(F.col("cosine") > max(-1.5, least - 1e-9))
    order = Window.partitionBy("vector_id").orderBy(F.desc("cosine"))
    kth = exact.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k).groupBy("vector_id").agg(F.min("cosine").alias("kth"), F.count("*").alias("n"))
    near = (F.col("cosine") >= F.col("kth") - 1e-5).cast("int")
    met = found.where(F.col("vector_id") % every == 0).join(kth, "vector_id").groupBy("vector_id").agg(F.sum(near).alias("met"), F.sum(1 - near).alias("wrong"))
    each = kth.join(met, "vector_id", "left").select("n", F.least("n", F.coalesce("met", F.lit(0))).alias("met"), F.coalesce("wrong", F.lit(0)).alias("wrong"))
    total = each.agg(F.lit(k).alias("k"), F.count("*").alias("queries"), F.sum("n").alias("expected"), F.sum("met").alias("met"), F.sum("wrong").alias("wrong"))
    return total.withColumn("recall", F.col("met") / F.col("expected"))
