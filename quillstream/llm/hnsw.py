"""A navigable small-world graph over the vectors of one shard, as flat neighbour arrays.

Points are in random order and level ``l`` holds the first ``sizes[l]`` of them, so a point has the same number on every level. Points
are inserted and queries answered in blocks: every step of the beam search is one array operation over the whole block.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_NONE = np.float32(-2)


@dataclass
class Graph:
    """``links[l]``: (sizes[l], width) neighbour numbers, -1 where there is none; ``near``: their cosines."""

    points: np.ndarray
    sizes: list[int]
    links: list[np.ndarray]
    near: list[np.ndarray]


def beam(points: np.ndarray, links: np.ndarray, queries: np.ndarray, entry: np.ndarray, ef: int, wide: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The ``ef`` nearest points that a best-first search from ``entry`` meets for each query, nearest first; -1 fills up."""
    n, b = len(links), len(queries)
    seen = np.zeros((b, n + 1), bool)  # the last column takes the -1s
    rows = np.arange(b)[:, None]
    near = np.matmul(points[entry], queries[:, :, None])[:, :, 0]
    near[entry < 0] = _NONE
    seen[rows, entry] = True
    order = np.argsort(-near, axis=1)[:, :ef]
    ids, sims = np.full((b, ef), -1, np.int32), np.full((b, ef), _NONE, np.float32)
    ids[:, : order.shape[1]] = np.take_along_axis(entry, order, 1)
    sims[:, : order.shape[1]] = np.take_along_axis(near, order, 1)
    open_ = ids >= 0
    live = np.arange(b)
    while len(live):
        waiting = np.where(open_[live], sims[live], _NONE)
        pick = np.argpartition(-waiting, min(wide, ef) - 1, axis=1)[:, :wide]
        good = np.take_along_axis(waiting, pick, 1) > _NONE
        some = good.any(1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        sub = live[:, None]
        open_[sub, pick] = False
        nb = np.where(good[:, :, None], links[np.where(good, ids[sub, pick], 0)], -1).reshape(len(live), -1)
        nb = np.sort(nb, axis=1)
        fresh = ~seen[sub, nb] & (nb >= 0)
        fresh[:, 1:] &= nb[:, 1:] != nb[:, :-1]
        seen[sub, nb] = True
        r, c = np.nonzero(fresh)
        got = np.einsum("ij,ij->i", points[nb[r, c]], queries[live[r]])
        worst = sims[live].min(1)
        keep = got > worst[r]
        r, c, got = r[keep], c[keep], got[keep]
        if not len(r):
            continue
        count = np.bincount(r, minlength=len(live))
        most = count.max()
        spot = np.arange(len(r)) - np.repeat(np.cumsum(count) - count, count)
        more, more_s = np.full((len(live), most), -1, np.int32), np.full((len(live), most), _NONE, np.float32)
        more[r, spot], more_s[r, spot] = nb[r, c], got
        touched = np.flatnonzero(count)
        at = live[touched]
        all_s = np.concatenate([sims[at], more_s[touched]], 1)
        best = np.argpartition(-all_s, ef - 1, axis=1)[:, :ef]
        ids[at] = np.take_along_axis(np.concatenate([ids[at], more[touched]], 1), best, 1)
        open_[at] = np.take_along_axis(np.concatenate([open_[at], more[touched] >= 0], 1), best, 1)
        sims[at] = np.take_along_axis(all_s, best, 1)
    order = np.argsort(-sims, axis=1)
    return np.take_along_axis(ids, order, 1), np.take_along_axis(sims, order, 1)


def _spread(points: np.ndarray, cand: np.ndarray, near: np.ndarray, m: int) -> tuple[np.ndarray, np.ndarray]:
    """``m`` neighbours out of candidates, nearest first: first those nearer to the point than to any taken before, then the nearest of the rest."""
    order = np.argsort(-near, axis=1)
    cand, near = np.take_along_axis(cand, order, 1), np.take_along_axis(near, order, 1)
    b, c = cand.shape
    vec = points[cand]
    mutual = np.matmul(vec, vec.transpose(0, 2, 1))
    taken = np.zeros((b, c), bool)
    closest = np.full((b, c), _NONE, np.float32)
    for j in range(c):
        ok = (cand[:, j] >= 0) & (near[:, j] > closest[:, j]) & (taken.sum(1) < m)
        taken[:, j] = ok
        closest = np.where(ok[:, None], np.maximum(closest, mutual[:, j]), closest)
    rank = np.where(cand < 0, 2 * c, np.where(taken, 0, c) + np.arange(c))
    first = np.argsort(rank, axis=1)[:, :m]
    return np.take_along_axis(cand, first, 1), np.take_along_axis(near, first, 1)


def _link_back(links: np.ndarray, near: np.ndarray, begin: int, sel: np.ndarray, sims: np.ndarray) -> None:
    """Enter the new points as neighbours of their neighbours; of too many the nearest stay."""
    u = np.repeat(np.arange(begin, begin + len(sel)), sel.shape[1])
    v, s = sel.ravel(), sims.ravel()
    ok = v >= 0
    u, v, s = u[ok], v[ok], s[ok]
    new = ~(links[v] == u[:, None]).any(1)
    u, v, s = u[new], v[new], s[new]
    width = links.shape[1]
    who = np.unique(v)
    old_v, old_k = np.nonzero(links[who] >= 0)
    owner = np.concatenate([who[old_v], v])
    other = np.concatenate([links[who[old_v], old_k], u])
    sim = np.concatenate([near[who[old_v], old_k], s])
    order = np.lexsort((-sim, owner))
    owner, other, sim = owner[order], other[order], sim[order]
    first = np.searchsorted(owner, who)
    rank = np.arange(len(owner)) - first[np.searchsorted(who, owner)]
    keep = rank < width
    links[owner[keep], rank[keep]] = other[keep]
    near[owner[keep], rank[keep]] = sim[keep]


def _descend(graph: Graph, queries: np.ndarray, to: int) -> np.ndarray:
    """Entry points on level ``to``: exact on the small top level, then the best few of each level below."""
    top = graph.sizes[-1]
    sims = queries @ graph.points[:top].T
    entry = np.argsort(-sims, axis=1)[:, :4].astype(np.int32)
    for level in range(len(graph.sizes) - 2, to, -1):
        entry, _ = beam(graph.points, graph.links[level], queries, entry, 4, 2)
    return entry


def build(points: np.ndarray, m: int = 12, ef: int = 24, block: int = 512) -> Graph:
    """The graph over unit vectors in random order, inserted in blocks of at most ``block`` and at most doubling."""
    n = len(points)
    sizes = [n]
    while sizes[-1] > 48:
        sizes.append(max(sizes[-1] // m, 16))
    graph = Graph(points, sizes, [np.full((s, 2 * m if not k else m + m // 2), -1, np.int32) for k, s in enumerate(sizes)], [])
    graph.near = [np.full(x.shape, _NONE, np.float32) for x in graph.links]
    top = sizes[-1]
    begin = 0
    while begin < n:
        level = max(k for k, s in enumerate(sizes) if s > begin)
        end = top if begin == 0 else min(begin + block, sizes[level], 2 * begin)
        queries = points[begin:end]
        own = queries @ queries.T
        np.fill_diagonal(own, _NONE)
        take = min(m, own.shape[0])
        mates = np.argpartition(-own, take - 1, axis=1)[:, :take]
        mate_s = np.take_along_axis(own, mates, 1)
        mates = np.where(mate_s > _NONE, mates + begin, -1).astype(np.int32)
        entry = _descend(graph, queries, level) if begin else None
        for at in range(level, -1, -1):
            cand, near = mates, mate_s
            if begin:
                ids, sims = beam(points, graph.links[at], queries, entry, ef)
                entry = ids[:, :4]
                cand, near = np.concatenate([ids, mates], 1), np.concatenate([sims, mate_s], 1)
            sel, s = _spread(points, cand, near, m)
            graph.links[at][begin:end, : sel.shape[1]] = sel
            graph.near[at][begin:end, : sel.shape[1]] = s
            _link_back(graph.links[at], graph.near[at], begin, sel, s)
        begin = end
    return graph


def search(graph: Graph, queries: np.ndarray, k: int, ef: int = 24, own: np.ndarray | None = None, block: int = 512) -> tuple[np.ndarray, np.ndarray]:
    """The ``k`` nearest points of every query and their cosines. ``own``: numbers of the queries that are points, which begin at themselves and don't find themselves."""
    ids, sims = [], []
    for at in range(0, len(queries), block):
        q = queries[at : at + block]
        entry = own[at : at + block, None].astype(np.int32) if own is not None else _descend(graph, q, 0)
        i, s = beam(graph.points, graph.links[0], q, entry, max(ef, k + 1))
        if own is not None:
            self_ = i == entry
            s = np.where(self_, _NONE, s)
            i = np.where(self_, -1, i)
            order = np.argsort(-s, axis=1)
            i, s = np.take_along_axis(i, order, 1), np.take_along_axis(s, order, 1)
        ids.append(i[:, :k])
        sims.append(s[:, :k])
    return np.concatenate(ids), np.concatenate(sims)
