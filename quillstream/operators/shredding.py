"""Nested columns to flat tables: shredding by repetition and definition levels, and rebuilding per repeated ancestor.

Every leaf path of a nested column becomes one sequence of entries, each with a repetition level (which list went on), a definition
level (how deep the path is present) and a value. Positions of a parent's children are then counted from the levels alone.
Both steps are done batch by batch on Arrow arrays, so no row moves to another task.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame


@dataclass
class Levels:
    """Entries of one leaf path. ``present``: the definition level from which an element of the n-th list exists; ``full``: that of a value."""

    row: np.ndarray
    rep: np.ndarray
    dfn: np.ndarray
    values: pa.Array
    present: tuple[int, ...]
    full: int

    def elements(self, depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For lists of ``depth``: which entries lie in an element, the index of the element in its list, and a number of that element in the batch."""
        inside = self.dfn >= self.present[depth - 1]
        starts = inside & (self.rep <= depth)
        number = np.cumsum(starts) - 1
        opens = self.rep < depth  # a new parent of this list
        before = np.cumsum(starts) - starts
        parent = np.maximum.accumulate(np.where(opens, np.arange(len(opens)), 0)) if len(opens) else np.zeros(0, int)
        return inside, number - before[parent] if len(opens) else number, number


def shred(column: pa.Array) -> dict[tuple[str, ...], Levels]:
    """All leaf paths of a struct, list or map column. Names in a path are field names; lists and maps add none, a map's leaves are ``key`` and ``value``."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    out: dict[tuple[str, ...], Levels] = {}
    n = len(column)

    def walk(values: pa.Array, at: np.ndarray, row: np.ndarray, rep: np.ndarray, dfn: np.ndarray, path: tuple, depth: int, level: int, present: tuple) -> None:
        """at: index in values of each entry, -1 where the path ended before; level: the definition level reached so far."""
        valid = np.zeros(len(at), bool)
        live = at >= 0
        known = values.is_valid().to_numpy(zero_copy_only=False)
        valid[live] = known[at[live]]
        dfn = dfn + valid
        at = np.where(valid, at, -1)
        kind = values.type
        if pa.types.is_struct(kind):
            for k, field in enumerate(kind):
                # flatten() would copy the parent's nulls into each field; they're in ``at`` already
                child = values.field(k)
                walk(child, at, row, rep, dfn, (*path, field.name), depth, level + 1, present)
        elif pa.types.is_list(kind) or pa.types.is_large_list(kind) or pa.types.is_map(kind):
            offsets = values.offsets.to_numpy()
            items = pa.StructArray.from_arrays([values.keys, values.items], ["key", "value"]) if pa.types.is_map(kind) else values.values
            first, size = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            first[valid] = offsets[at[valid]]
            size[valid] = offsets[at[valid] + 1] - first[valid]
            times = np.maximum(size, 1)
            source = np.repeat(np.arange(len(at)), times)
            inner = np.arange(len(source)) - np.repeat(np.cumsum(times) - times, times)
            some = size[source] > 0
            walk(items, np.where(some, first[source] + inner, -1), row[source], np.where(inner == 0, rep[source], depth + 1), dfn[source] + some, path, depth + 1, level + 2, (*present, level + 2))
        else:
            taken = values.take(pa.array(np.maximum(at, 0), mask=at < 0)) if len(values) else pa.nulls(len(at), kind)
            out[path] = Levels(row, rep, dfn, taken, present, level + 1)

    zero = np.zeros(n, np.int64)
    walk(column, np.arange(n), np.arange(n), zero, zero, (), 0, 0, ())
    return out


@dataclass
class Rows:
    """Rows of one flat table: the record each belongs to, its index in the outer and in the inner list, and its columns by name."""

    record: np.ndarray
    outer: np.ndarray
    inner: np.ndarray
    columns: dict[str, pa.Array]


def rebuild(levels: dict[tuple[str, ...], Levels], under: tuple[str, ...], depth: int, told: bool = True) -> Rows:
    """Rows of the ancestor ``under``, an element of a list of ``depth`` (0: no list, the record itself).

    An element counts if any leaf below it, however deep, has a value; indexes count all elements. Columns are the leaves that repeat no further. Every leaf below an ancestor
    numbers its elements alike, so a column is one take of the leaf's values at the entries of the elements that count. ``told``: whether columns are wanted.
    """
    below = {path: lv for path, lv in levels.items() if path[: len(under)] == under}
    size, found, at = 0, [], {}
    for path, lv in below.items():
        if depth:
            inside, index, number = lv.elements(depth)
        else:
            inside, index, number = np.ones(len(lv.row), bool), np.full(len(lv.row), -1), lv.row
        if not found:
            # the first entry of each element tells its place
            first = np.flatnonzero(inside & (np.diff(number, prepend=-1) > 0)) if depth else np.flatnonzero(np.diff(number, prepend=-1) > 0)
            record = lv.row[first]
            outer = lv.elements(1)[1][first] if depth == 2 else index[first]
            inner = index[first] if depth == 2 else np.full(len(first), -1)
            size = len(first)
            present = np.zeros(size, bool)
        where = np.flatnonzero(inside & (lv.dfn >= lv.full))
        present[number[where]] = True
        found.append(path)
        if told and len(lv.present) == depth:
            entry = np.full(size, -1)
            entry[number[where]] = where
            at[path] = entry
    if not found:
        none = np.zeros(0, np.int64)
        return Rows(none, none, none, {})
    keep = np.flatnonzero(present)
    names = {path: ".".join(path[len(under) :]) or path[-1] for path in at}
    columns = {names[p]: below[p].values.take(pa.array(e[keep], mask=e[keep] < 0)) if len(below[p].values) else pa.nulls(len(keep), below[p].values.type) for p, e in at.items()}
    return Rows(record[keep], outer[keep], inner[keep], columns)


@dataclass(frozen=True)
class Child:
    """One flat table: its name, the column it comes from, the path of its ancestor, and how many lists lie above its rows.

    ``placed``: the value itself, a number, is the position; each position from 0 on gives one row with the smallest text of the
    leaf ``told`` of the outer element.
    """

    name: str
    column: str
    under: tuple[str, ...] = ()
    depth: int = 0
    placed: bool = False
    told: tuple[str, ...] = ()


def place_by_value(levels: dict[tuple[str, ...], Levels], child: Child) -> Rows:
    """Rows of a child whose values are positions: one for each position of a record, told the smallest text."""
    lv, told = levels[child.under], levels[child.told]
    inside, entry, _ = lv.elements(1)
    where = np.flatnonzero(inside & (lv.dfn >= lv.full))
    texts = lv.values.take(pa.array(where))
    good = pc.fill_null(pc.match_substring_regex(texts, r"^\s*\+?[0-9]{1,18}\s*$"), False).to_numpy(zero_copy_only=False)
    where = where[good]
    spot = pc.utf8_ltrim(pc.utf8_trim_whitespace(texts.filter(pa.array(good))), "+").cast(pa.int64()).to_numpy()
    where, spot = where[spot < 2**31], spot[spot < 2**31]
    record, entry = lv.row[where], entry[where]
    # the text of the outer element that each position stands in: both leaves number the outer elements alike
    _, _, number = lv.elements(1)
    inside, _, told_number = told.elements(1)
    text_at = np.full(int(max(number.max(initial=-1), told_number.max(initial=-1))) + 1, -1)
    have = np.flatnonzero(inside & (told.dfn >= told.full))
    text_at[told_number[have]] = have
    held = text_at[number[where]]
    words = told.values.dictionary_encode()
    order = pc.array_sort_indices(words.dictionary).to_numpy()
    rank = np.empty(len(order) + 1, np.int64)
    rank[order] = np.arange(len(order))
    rank[-1] = -1  # no text, which comes first
    codes = np.append(pc.fill_null(words.indices, len(order)).to_numpy(zero_copy_only=False).astype(np.int64), len(order))
    by = np.lexsort((rank[codes[held]], spot, record))
    record, spot, held = record[by], spot[by], held[by]
    first = np.ones(len(by), bool)
    first[1:] = (record[1:] != record[:-1]) | (spot[1:] != spot[:-1])
    record, spot, held = record[first], spot[first], held[first]
    column = told.values.take(pa.array(held, mask=held < 0)) if len(told.values) else pa.nulls(len(held), told.values.type)
    return Rows(record, spot, np.full(len(record), -1), {child.told[-1]: column})


def _rows_of(levels: dict[tuple[str, ...], Levels], child: Child, told: bool) -> Rows:
    if child.placed:
        return place_by_value(levels, child)
    rows = rebuild(levels, child.under, child.depth, told)
    if not child.depth:
        rows.outer = np.zeros(len(rows.record), np.int64)
    return rows


def child_rows(df: DataFrame, key: str, children: list[Child]) -> DataFrame:
    """``key, child, pos, sub_pos``: one row per element of each repeated ancestor, linked to its record and its place in it.

    ``pos`` is the index in the outer list, ``sub_pos`` that in the inner one; with no list above they are 0 and -1. Leaves must be
    strings. Null and empty columns, lists and objects give no row, and neither does an object without any non-null value, though
    indexes count it. A null key is kept as it is; repeated records give repeated rows. Other columns are not looked at.
    """
    columns = list(dict.fromkeys(c.column for c in children))
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            levels = {c: shred(batch.column(c)) for c in columns}
            for child in children:
                rows = _rows_of(levels[child.column], child, False)
                name = pa.DictionaryArray.from_arrays(pa.array(np.zeros(len(rows.record), np.int32)), [child.name]).cast(pa.string())
                data = [batch.column(key).take(pa.array(rows.record)), name, pa.array(rows.outer, pa.int32()), pa.array(rows.inner, pa.int32())]
                yield pa.RecordBatch.from_arrays(data, names=[key, "child", "pos", "sub_pos"])

    return df.select(key, *columns).mapInArrow(run, f"`{key}` {kind}, child string, pos int, sub_pos int")


def child_table(df: DataFrame, key: str, child: Child, columns: dict[str, str]) -> DataFrame:
    """``key, pos, sub_pos`` and the named leaves of one child as columns of their own, as texts; ``columns``: leaf (below the ancestor, with dots) to column. See ``child_rows``."""
    kind = df.select(key).schema[0].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = _rows_of(shred(batch.column(child.column)), child, True)
            n = len(rows.record)
            data = [batch.column(key).take(pa.array(rows.record)), pa.array(rows.outer, pa.int32()), pa.array(rows.inner, pa.int32())]
            data += [rows.columns[leaf].cast(pa.string()) if leaf in rows.columns else pa.nulls(n, pa.string()) for leaf in columns]
            yield pa.RecordBatch.from_arrays(data, names=[key, "pos", "sub_pos", *columns.values()])

    types = "".join(f", `{c}` string" for c in columns.values())
    return df.select(key, child.column).mapInArrow(run, f"`{key}` {kind}, pos int, sub_pos int{types}")
