"""Interpolated Kneser-Ney trigram models of two classes on word numbers, as sorted arrays that both classes share."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

DISCOUNT = np.float64(0.75)  # counts are kept in single precision, probabilities are not


def _at(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The place of each wanted number among the sorted keys, their length where it is not there."""
    if not len(keys):
        return np.zeros(len(wanted), np.int64)
    at = np.searchsorted(keys, wanted)
    return np.where(keys[np.minimum(at, len(keys) - 1)] == wanted, at, len(keys))


def _share(wide: np.ndarray, fine: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of ``values`` over the fine keys of each wide key, for each class, and a 0 at the end for what is not there."""
    at = np.searchsorted(wide, fine)
    return np.stack([np.append(np.bincount(at, weights=v, minlength=len(wide)), 0.0) for v in values]).astype(np.float32)


@dataclass
class Models:
    """Counts of two classes under one set of keys: row 0 and row 1 of each table.

    A trigram that a class has not seen often enough falls back to the class's pairs, these to its single words, and those to ``both``: how words follow
    each other in the two classes together, with the words of the two classes together below it. So a rare expression, which neither class has
    counted well, gets the same probability from both and speaks for neither.
    """

    words: int
    tri: np.ndarray
    tri_n: np.ndarray
    pair: np.ndarray
    pair_n: np.ndarray
    pair_kinds: np.ndarray
    follow: np.ndarray
    follow_n: np.ndarray
    one_n: np.ndarray
    one_kinds: np.ndarray
    single: np.ndarray
    both_n: np.ndarray
    both_one: np.ndarray
    both_kinds: np.ndarray
    base: np.ndarray

    def shared(self, b: np.ndarray, c: np.ndarray, at: np.ndarray | None = None) -> np.ndarray:
        """The probability of ``c`` after ``b`` in both classes together."""
        at = _at(self.follow, b * self.words + c) if at is None else at
        n = self.both_one[b]
        return np.where(n > 0, (np.maximum(self.both_n[at] - DISCOUNT, 0) + DISCOUNT * self.both_kinds[b] * self.base[c]) / np.maximum(n, 1), self.base[c])

    def log_prob(self, a: np.ndarray, b: np.ndarray, c: np.ndarray) -> np.ndarray:
        """Log probability of each word ``c`` after ``a b``, a row for each class."""
        v = self.words
        pair = a * v + b
        follow_at, pair_at = _at(self.follow, b * v + c), _at(self.pair, pair)
        tri_at = np.full(len(c), len(self.tri))
        some = np.flatnonzero((pair_at < len(self.pair)) & (follow_at < len(self.follow)))  # else no class has seen the three
        tri_at[some] = _at(self.tri, pair[some] * v + c[some])
        shared = self.shared(b, c, follow_at)
        out = np.empty((2, len(c)))
        for k in (0, 1):
            kinds, total = np.count_nonzero(self.single[k]), max(self.single[k].sum(), 1)
            p = (np.maximum(self.single[k][c] - DISCOUNT, 0) + DISCOUNT * kinds * shared) / total if kinds else shared
            n = self.one_n[k][b]
            p = np.where(n > 0, (np.maximum(self.follow_n[k][follow_at] - DISCOUNT, 0) + DISCOUNT * self.one_kinds[k][b] * p) / np.maximum(n, 1), p)
            n = self.pair_n[k][pair_at]
            p = np.where(n > 0, (np.maximum(self.tri_n[k][tri_at] - DISCOUNT, 0) + DISCOUNT * self.pair_kinds[k][pair_at] * p) / np.maximum(n, 1), p)
            out[k] = np.log(p)
        return out


def fit(words: int, keys: list[np.ndarray], counts: list[np.ndarray]) -> Models:
    """``keys`` of each class: (first * words + second) * words + third, unique; ``counts`` of each."""
    tri = np.unique(np.concatenate(keys)).astype(np.int64)
    tri_n = np.zeros((2, len(tri) + 1), np.float32)
    for k in (0, 1):
        tri_n[k][np.searchsorted(tri, keys[k])] = counts[k]
    has = (tri_n[:, :-1] > 0).astype(float)
    pair, follow = np.unique(tri // words), np.unique(tri % (words * words))
    pair_n, pair_kinds = _share(pair, tri // words, tri_n[:, :-1]), _share(pair, tri // words, has)
    follow_n = _share(follow, tri % (words * words), has)
    both_n = _share(follow, tri % (words * words), [np.ones(len(tri))])[0]
    seen = (follow_n[:, :-1] > 0).astype(float)
    by = lambda at, values: np.bincount(at, weights=values, minlength=words)
    first, second = follow // words, follow % words
    one_n = np.stack([by(first, f[:-1]) for f in follow_n])
    one_kinds, single = (np.stack([by(at, s) for s in seen]) for at in (first, second))
    n = by(second, np.ones(len(follow)))  # in how many different contexts a word is seen at all, with a little for every other
    kinds, total = np.count_nonzero(n), max(n.sum(), 1)
    base = (np.maximum(n - DISCOUNT, 0) + (DISCOUNT * kinds if kinds else 1) / words) / total
    return Models(words, tri, tri_n, pair, pair_n, pair_kinds, follow, follow_n, one_n, one_kinds, single, both_n, by(first, both_n[:-1]), by(first, np.ones(len(follow))), base)
