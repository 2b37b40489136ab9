"""Oversized texts cut into overlapping pieces at natural boundaries, range by range.

Workers read ranges, each with a halo that reaches back to the last character that is no white space, and give a boundary table per range: how many tokens begin in it and
where among them natural boundaries lie. Prefix sums of the token counts stitch the tables of an item together, pieces are planned from the stitched
table alone, block by block, and are emitted by offset. So the pieces of an item are the same for every size of range and block.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from urllib.parse import quote

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.runtime import cut

TOKEN = re.compile(r"\w+|[^\w\s]")
PARAGRAPH, LINE, SENTENCE, LIMIT = 3, 2, 1, 0
_ENDERS = ".!?…。！？"
_SPACE, _WORD, _SIGN = 0, 1, 2
TABLE = "range_no long, tokens long, cuts binary, whole boolean"
PLAN = "piece int, begin long, size int, ends_at int, range_no long"
_held: dict[str, np.ndarray] = {}


def _classes() -> np.ndarray:
    """For every code point whether it is white space, part of a word or a sign; made once per worker."""
    if "classes" not in _held:
        every = "".join(map(chr, range(0x110000)))
        kinds = np.full(0x110000, _SIGN, np.uint8)
        for pattern, kind in ((r"\s+", _SPACE), (r"\w+", _WORD)):
            for m in re.finditer(pattern, every):
                kinds[m.start() : m.end()] = kind
        _held["classes"] = kinds
    return _held["classes"]


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def token_starts(points: np.ndarray, fresh: np.ndarray | None = None) -> np.ndarray:
    """Where tokens begin. ``fresh``: places at which another text begins, so that no word goes on across them."""
    kind = _classes()[points]
    starts = kind == _SIGN
    word = kind == _WORD
    starts[1:] |= word[1:] & ~word[:-1]
    if len(word):
        starts[0] |= word[0]
    if fresh is not None:
        fresh = fresh[fresh < len(points)]
        starts[fresh] |= word[fresh]
    return np.flatnonzero(starts)


def strengths(points: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """How natural a cut before each token is, from the white space before it and the character before that: the end of a paragraph (two line ends), of a line, of a sentence, or none."""
    kind = _classes()[points]
    solid = np.where(kind != _SPACE, np.arange(len(points)), -1)
    last = np.maximum.accumulate(solid) if len(points) else solid
    feeds, returns = (np.concatenate([[0], np.cumsum(points == c)]) for c in (10, 13))
    inner = starts[starts > 0]
    left = last[inner - 1]  # the last character of the token before, -1 at the beginning of the text
    lines = feeds[inner] - feeds[left + 1]
    lines = np.where(lines, lines, returns[inner] - returns[left + 1])
    ends = np.isin(points[np.maximum(left, 0)], [ord(c) for c in _ENDERS])
    gap = (left >= 0) & (left < inner - 1)
    out = np.zeros(len(starts), np.int64)
    out[len(starts) - len(inner) :] = np.where(~gap, LIMIT, np.where(lines > 1, PARAGRAPH, np.where(lines == 1, LINE, np.where(ends, SENTENCE, LIMIT))))
    return out


def _pack(at: np.ndarray, kind: np.ndarray) -> bytes:
    return (at * 4 + kind).astype(np.int32).tobytes()


def boundary_table(text: str, left: int) -> tuple[int, bytes]:
    """Tokens that begin in a range, and its natural boundaries as (tokens of the range before it, strength). ``left``: characters of halo before the range, that reach back to one that is no white space or to the beginning of the item."""
    points = codes(text)
    starts = token_starts(points)
    kind = strengths(points, starts)[starts >= left]
    at = np.flatnonzero(kind)
    return len(kind), _pack(at, kind[at])


def _unpack(cuts: bytes) -> tuple[np.ndarray, np.ndarray]:
    packed = np.frombuffer(cuts, np.int32).astype(np.int64)
    return packed >> 2, packed & 3


class Planner:
    """Pieces over ``total`` tokens from the natural boundaries (sorted) around some stretch of them.

    A piece shares ``overlap`` tokens with the one before it and has at most ``most``. It ends at the last boundary of the strongest kind in its second half, else
    at the last boundary it has, else at the limit; the last piece ends where the item does. So where a piece ends follows from where the one before it ends.
    """

    def __init__(self, at: np.ndarray, kind: np.ndarray, total: int, most: int, overlap: int):
        self.at, self.kind, self.total, self.most, self.overlap = at, kind, total, most, overlap

    def step(self, new: int) -> tuple[int, int, int]:
        """The piece after one that ends at ``new`` (0: the first) as (first token, token after the last, kind of its end)."""
        start = max(0, new - self.overlap)
        if self.total - start <= self.most:
            return start, self.total, PARAGRAPH
        low, high = np.searchsorted(self.at, [max(new, start + self.overlap), start + self.most], "right")
        if low == high:
            return start, start + self.most, LIMIT
        half = max(low, int(np.searchsorted(self.at, start + self.most // 2, "right")))
        some = self.kind[half if half < high else low : high][::-1]
        k = high - 1 - int(some.argmax())
        return start, int(self.at[k]), int(self.kind[k])

    def chain(self, new: int, stop: int) -> list[tuple[int, int, int]]:
        """The pieces that follow on one that ends at ``new``, as long as the one before ends before ``stop``."""
        out = []
        while new < min(stop, self.total):
            out.append(self.step(new))
            new = out[-1][1]
        return out

    def exits(self, begin: int, stop: int) -> tuple[np.ndarray, np.ndarray]:
        """For each of the ``most`` places from ``begin`` on at which a piece may end: where the chain from it first ends at ``stop`` or later, and after how many pieces. Chains soon run into each other, and each stretch is gone along once."""
        known: dict[int, tuple[int, int]] = {}
        out = []
        for first in range(begin, begin + self.most):
            path, new = [], first
            while new < min(stop, self.total) and new not in known:
                path.append(new)
                new = self.step(new)[1]
            end, n = known.get(new, (new, 0))
            for k, place in enumerate(reversed(path), 1):
                known[place] = (end, n + k)
            out.append((end, n + len(path)))
        return tuple(np.array(out, np.int64).T)


def _table_ranges(df: DataFrame, keys: list[str], text: str, size: int) -> DataFrame:
    """``keys, range_no, tokens, cuts, whole``: the boundary table of each range of ``size`` characters of each text, cut where the text lies.

    Ranges of many short texts are worked on together, as arrays; of a long text no more than some ranges and their halos are held as code points at a time.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)
    step = 1 << 20

    def some_ranges(texts: list[str]) -> Iterator[tuple[int, int, str, int]]:
        """(row, number of the range, its text with the halo, characters of halo)."""
        for row, text in enumerate(texts):
            for number, at in enumerate(range(0, max(len(text), 1), size)):
                base = at - len(text[max(0, at - 1) : at])
                while base > 0 and text[base].isspace():
                    base = max(0, base - 64)
                yield row, number, text[base : at + size], at - base

    def tables(held: list[tuple[int, int, str, int]]) -> tuple[list, ...]:
        points = codes("".join(t for _, _, t, _ in held))
        length = np.array([len(t) for _, _, t, _ in held])
        begin = np.cumsum(length) - length
        starts = token_starts(points, begin)
        owner = np.searchsorted(begin, starts, "right") - 1
        # a range's strengths look back no further than its halo: what stands before it belongs to another
        kind = strengths(points, starts)
        counted = starts >= (begin + np.array([left for *_, left in held]))[owner]
        first_seen = np.append(-1, owner[:-1]) != owner
        kind[first_seen & counted] = 0  # no token before it in its range and halo: the beginning of the text
        starts, owner, kind = starts[counted], owner[counted], kind[counted]
        n = np.bincount(owner, minlength=len(held))
        local = np.arange(len(owner)) - (np.cumsum(n) - n)[owner]
        ends = np.searchsorted(owner, np.arange(len(held) + 1))
        cut_at = [np.flatnonzero(kind[a:b]) for a, b in zip(ends, ends[1:])]
        return n, [_pack(local[a:b][k], kind[a:b][k]) for a, b, k in zip(ends, ends[1:], cut_at)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(text).to_pylist()
            held, many = [], 0

            def out() -> pa.RecordBatch:
                n, cuts = tables(held)
                rows = pa.array([h[0] for h in held])
                whole = [len(texts[h[0]]) <= size for h in held]
                data = [*(batch.column(c).take(rows) for c in keys), pa.array([h[1] for h in held], pa.int64()), pa.array(n, pa.int64()), pa.array(cuts, pa.binary()), pa.array(whole, pa.bool_())]
                return pa.RecordBatch.from_arrays(data, names=[*keys, *(c.split()[0] for c in TABLE.split(", "))])

            for one in some_ranges(texts):
                held.append(one)
                many += len(one[2])
                if many > step:
                    yield out()
                    held, many = [], 0
            if held:
                yield out()

    return df.select(*keys, text).mapInArrow(run, f"{types}, {TABLE}")


def _stitched(tables: DataFrame, keys: list[str]) -> DataFrame:
    """The tables with ``before``, the tokens of the item before the range, and ``total``, those of the item. Only items of several ranges take part in the prefix sums, and only numbers do."""
    alone = tables.where("whole").withColumn("before", F.lit(0).cast("long")).withColumn("total", F.col("tokens"))
    many = tables.where("not whole").dropDuplicates([*keys, "range_no"])
    item = Window.partitionBy(*keys)
    running = item.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    numbers = many.select(*keys, "range_no", "tokens").select(
        *(F.col(k).alias(f"s_{k}") for k in keys), F.col("range_no").alias("s_range"), F.coalesce(F.sum("tokens").over(running), F.lit(0)).alias("before"), F.sum("tokens").over(item).alias("total")
    )
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys] + [F.col("range_no") == F.col("s_range")]
    return alone.unionByName(many.join(numbers, same).select(*tables.columns, "before", "total"))


def _blocks(stitched: DataFrame, keys: list[str], most: int, overlap: int, block: int) -> DataFrame:
    """A row per item and block of ``block`` tokens with the boundary tables of all ranges in reach of it."""
    first = F.greatest(F.floor((F.col("before") - most) / block), F.lit(0))
    last = F.floor((F.col("before") + F.col("tokens") + overlap) / block)
    last = F.least(last, F.greatest(F.floor((F.col("total") - 1) / block), F.lit(0)))
    rows = stitched.where("total > 0").withColumn("block", F.explode(F.sequence(F.least(first, last), last)))
    packed = F.struct("before", "tokens", "range_no", "cuts")
    return rows.groupBy(*keys, "block").agg(F.first("total").alias("total"), F.array_sort(F.collect_set(packed)).alias("tables"))  # a repeated row counts once


def _planner(tables: list[dict], total: int, most: int, overlap: int) -> Planner:
    at, kind = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for t in tables:
        a, k = _unpack(t["cuts"])
        at.append(a + t["before"])
        kind.append(k)
    return Planner(np.concatenate(at), np.concatenate(kind), total, most, overlap)


def _planned(stitched: DataFrame, keys: list[str], most: int, overlap: int, block: int) -> DataFrame:
    """``keys, total, piece, begin, size, ends_at, range_no``: every piece of every item; ``begin`` counts tokens of the item, and ``range_no`` is the range that holds that token.

    The first block of an item is planned at once. In each later block the piece that comes over from the block before may end at any of the first ``most`` places, so it gives
    a table of where each of these leads; following these tables from block to block, a few numbers each, tells where each block begins, and then all are planned at the same time.
    """
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in stitched.select(*keys).schema)

    def exits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            to, n = [], []
            for b, total, tables in zip(*(batch.column(c).to_pylist() for c in ("block", "total", "tables"))):
                p = _planner(tables, total, most, overlap)
                if b:
                    ends, pieces = p.exits(b * block, (b + 1) * block)
                else:
                    chain = p.chain(0, block)
                    ends, pieces = np.array([chain[-1][1]]), [len(chain)]
                to.append(ends - b * block)
                n.append(pieces)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in (*keys, "block")), pa.array(to, pa.list_(pa.int32())), pa.array(n, pa.list_(pa.int32()))], names=[*keys, "block", "ends", "pieces"])

    def follow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, cols = [], ([], [], [])
            for k, steps in enumerate(batch.column("steps").to_pylist()):
                new, count = 0, 0
                for s in steps:
                    source.append(k)
                    for col, v in zip(cols, (s["block"], new, count)):
                        col.append(v)
                    base = s["block"] * block
                    place = new - base
                    new, count = base + s["ends"][place], count + s["pieces"][place]
            at = pa.array(source, pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in keys), *(pa.array(c, pa.int64()) for c in cols)], names=[*keys, "block", "entry", "before_it"])

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, cols = [], ([], [], [], [], [])
            for k, (b, total, tables, entry, count) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("block", "total", "tables", "entry", "before_it")))):
                chain = _planner(tables, total, most, overlap).chain(entry, (b + 1) * block) if total > most else [(0, total, PARAGRAPH)]
                held = np.searchsorted([t["before"] for t in tables if t["tokens"]], [a for a, *_ in chain], "right") - 1
                full = [t["range_no"] for t in tables if t["tokens"]]
                for j, ((a, z, kind), h) in enumerate(zip(chain, held)):
                    source.append(k)
                    for col, v in zip(cols, (count + j, a, z - a, kind, full[h])):
                        col.append(v)
            at = pa.array(source, pa.int64())
            kinds = [pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
            data = [*(batch.column(c).take(at) for c in (*keys, "total")), *(pa.array(c, t) for c, t in zip(cols, kinds))]
            yield pa.RecordBatch.from_arrays(data, names=[*keys, "total", *(c.split()[0] for c in PLAN.split(", "))])

    at_start = {"entry": F.lit(0).cast("long"), "before_it": F.lit(0).cast("long")}
    single = _blocks(stitched.where(F.col("total") <= block), keys, most, overlap, block).withColumns(at_start)
    later = _blocks(stitched.where(F.col("total") > block), keys, most, overlap, block)
    steps = later.mapInArrow(exits, f"{types}, block long, ends array<int>, pieces array<int>")
    steps = steps.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("block", "ends", "pieces"))).alias("steps"))
    entries = steps.mapInArrow(follow, f"{types}, block long, entry long, before_it long").select(*(F.col(k).alias(f"s_{k}") for k in keys), F.col("block").alias("s_block"), "entry", "before_it")
    same = [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in keys] + [F.col("block") == F.col("s_block")]
    entered = later.join(entries, same).select(*single.columns)
    return single.unionByName(entered).mapInArrow(pieces, f"{types}, total long, {PLAN}")


def _check(most: int, overlap: int, size: int, block: int) -> None:
    if not 0 <= overlap < most:
        raise ValueError("overlap must be at least 0 and less than max_tokens")
    if not 1 <= size <= 1 << 28 or block < most:
        raise ValueError("ranges must hold 1 to 2^28 characters or bytes, and blocks at least max_tokens")


def _plan(rows: DataFrame, plain: list[str], max_tokens: int, overlap: int, range_chars: int, block: int) -> DataFrame:
    _check(max_tokens, overlap, range_chars, block)
    tables = cut(_table_ranges(rows, plain, "t", range_chars))
    return _planned(cut(_stitched(tables, plain)), plain, max_tokens, overlap, block)


def _plain(df: DataFrame, keys: list[str], text: str) -> tuple[DataFrame, list[str]]:
    plain = [f"k{j}" for j in range(len(keys))]
    return df.select(*(F.col(k).alias(p) for k, p in zip(keys, plain)), F.col(text).alias("t")).where("t is not null"), plain


def plan_items(df: DataFrame, keys: list[str], text: str, max_tokens: int = 300, overlap: int = 50, range_chars: int = 1024, block: int = 1 << 20) -> DataFrame:
    """``keys, chunk_index, first_token, token_count, ends_at``: the pieces of ``split_items`` in tokens, without any text being moved."""
    rows, plain = _plain(df, keys, text)
    plans = _plan(rows, plain, max_tokens, overlap, range_chars, block)
    return plans.select(*(F.col(p).alias(k) for k, p in zip(keys, plain)), F.col("piece").alias("chunk_index"), F.col("begin").alias("first_token"), F.col("size").alias("token_count"), "ends_at")


def split_items(df: DataFrame, keys: list[str], text: str, max_tokens: int = 300, overlap: int = 50, range_chars: int = 1024, block: int = 1 << 20) -> DataFrame:
    """Pieces of at most ``max_tokens`` tokens: ``keys, chunk_index, start, stop, token_count, ends_at, piece``.

    A token is a run of letters, digits and underscores or any other single non-space character. Pieces end at the end of a paragraph, line or
    sentence (``ends_at`` 3, 2, 1) where one lies in reach, else at the limit (0), and consecutive pieces share ``overlap`` tokens, always.
    ``start`` and ``stop`` are character offsets into the item. Items within the limit give one piece, however long the white space or words in them.

    Each text is cut into ranges of ``range_chars`` characters where it lies. What is shuffled is a boundary table per range, some numbers; an item's tables are stitched by prefix sums and planned
    in blocks of ``block`` tokens, so that no task holds more than a block of any item. Neither size changes a piece. The plan then meets the texts again, which are cut by offset.

    ``keys`` must name an item; rows that repeat count once. Null, empty and blank texts give no piece. Other columns are not looked at, whatever their names.
    """
    rows, plain = _plain(df, keys, text)
    plans = _plan(rows, plain, max_tokens, overlap, range_chars, block)
    plans = plans.groupBy(*(F.col(p).alias(f"s_{p}") for p in plain)).agg(F.array_sort(F.collect_list(F.struct("piece", "begin", "size", "ends_at"))).alias("pieces"))
    both = rows.dropDuplicates(plain).join(plans, [F.col(p).eqNullSafe(F.col(f"s_{p}")) for p in plain]).select(*plain, "t", "pieces")
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*plain).schema)
    names = ["chunk_index", "start", "stop", "token_count", "ends_at", "piece"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for some in range(0, batch.num_rows, 256):
                source, cols = [], [[] for _ in names]
                for k in range(some, min(some + 256, batch.num_rows)):
                    whole = batch.column("t")[k].as_py()
                    places = token_offsets(whole)
                    for p in batch.column("pieces")[k].as_py():
                        a, b = int(places[0][p["begin"]]), int(places[1][p["begin"] + p["size"] - 1])
                        source.append(k)
                        for col, v in zip(cols, (p["piece"], a, b, p["size"], p["ends_at"], whole[a:b])):
                            col.append(v)
                at = pa.array(source, pa.int64())
                yield pa.RecordBatch.from_arrays([*(batch.column(c).take(at) for c in plain), *(pa.array(c, t) for c, t in zip(cols, kinds))], names=[*plain, *names])

    out = both.mapInArrow(emit, f"{types}, chunk_index int, start long, stop long, token_count int, ends_at int, piece string")
    return out.select(*(F.col(p).alias(k) for k, p in zip(keys, plain)), *names)


def token_offsets(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Where each token begins and ends."""
    points = codes(text)
    kind = _classes()[points]
    starts = token_starts(points)
    going = np.append(kind, _SPACE)
    last = np.flatnonzero((going[:-1] == _WORD) & (going[1:] != _WORD))  # last characters of words
    ends = starts + 1
    words = kind[starts] == _WORD
    ends[words] = last + 1
    return starts, ends


# files


def _open(path: str):
    found, name = fs.FileSystem.from_uri(quote(re.sub("^file:/+", "file:///", path), safe=":/@"))
    return found.open_input_file(name)


def _char_edge(file, at: int, length: int) -> int:
    """The first byte from ``at`` on that begins a character, at most three further."""
    if at >= length:
        return length
    head = file.read_at(4, at)
    k = 0
    while at and k < min(3, len(head)) and head[k] & 0xC0 == 0x80:
        k += 1
    return at + k


def _text(raw: bytes) -> str:
    return raw.decode("utf-8", "surrogateescape")


def _halo(file, begin: int) -> str:
    """The text before byte ``begin`` back to a character that is no white space, or to the beginning."""
    size = 64
    while True:
        base = max(0, begin - size)
        raw = file.read_at(begin - base, base)
        k = 0
        while base and k < min(3, len(raw)) and raw[k] & 0xC0 == 0x80:
            k += 1
        text = _text(raw[k:])
        if base == 0 or text.strip():
            return text
        size *= 8


def file_table(path: str, number: int, size: int, length: int) -> tuple[int, bytes]:
    """The boundary table of one byte range of a UTF-8 file, from the range and its halo alone."""
    with _open(path) as file:
        begin, end = _char_edge(file, number * size, length), _char_edge(file, (number + 1) * size, length)
        if begin >= end:
            return 0, b""
        halo = _halo(file, begin) if begin else ""
        return boundary_table(halo + _text(file.read_at(end - begin, begin)), len(halo))


def file_pieces(path: str, number: int, size: int, length: int, wanted: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """(first byte, byte after, text) of the pieces given as (first token within the range, tokens), in order; what lies beyond the range is read on as far as the pieces reach."""
    with _open(path) as file:
        begin, end = _char_edge(file, number * size, length), _char_edge(file, (number + 1) * size, length)
        halo = _halo(file, begin) if begin else ""
        need = max(a + n for a, n in wanted) + 1  # one token more, so that the last wanted one is whole
        raw, more = file.read_at(end - begin, begin), 1 << 16
        while True:
            text = halo + _text(raw)
            starts, ends = token_offsets(text)
            own = np.searchsorted(starts, len(halo))
            if len(starts) - own >= need or end >= length:
                break
            to = _char_edge(file, end + more, length)
            raw, end, more = raw + file.read_at(to - end, end), to, more * 2
        points = codes(text)
        wide = 1 + (points >= 0x80).astype(np.int64) + (points >= 0x800) + (points >= 0x10000)
        wide[(points >= 0xDC80) & (points < 0xDD00)] = 1  # a byte that is no UTF-8
        byte = np.concatenate([[0], np.cumsum(wide)])
        byte += begin - byte[len(halo)]
        for a, n in wanted:
            x, y = int(starts[own + a]), int(ends[own + a + n - 1])
            yield int(byte[x]), int(byte[y]), text[x:y].encode("utf-8", "surrogateescape").decode("utf-8", "replace")


def _per_range(rows: DataFrame) -> DataFrame:
    """Rows of ranges spread over all tasks, whichever files they belong to."""
    return rows.repartition("path", "range_no")


def split_files(spark: SparkSession, paths: str | list[str], max_tokens: int = 300, overlap: int = 50, range_bytes: int = 8 << 20, block: int = 1 << 20) -> DataFrame:
    """``path, chunk_index, start, stop, token_count, ends_at, piece`` of UTF-8 text files of any size; ``start`` and ``stop`` are byte offsets.

    Only names and lengths of the files are listed. Workers seek to byte ranges and read them with their halo for the boundary tables, which are stitched and planned as
    ``split_items`` does; then they seek to the ranges again and emit the pieces that begin in them, reading on as far as these reach. So a file is never held whole, its text is never
    shuffled, and the pieces don't depend on ``range_bytes``. Files must lie in a file system that all executors reach (any that Arrow can open). Empty and blank files give no piece; bytes
    that are no UTF-8 become the replacement character.
    """
    _check(max_tokens, overlap, range_bytes, block)
    files = spark.read.format("binaryFile").load(paths).select("path", "length").where("length > 0")
    last = F.floor((F.col("length") - 1) / range_bytes)
    ranges = files.select("path", "length", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("range_no"))

    def tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [file_table(p, n, range_bytes, length) for p, length, n in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "range_no")))]
            data = [batch.column("path"), batch.column("range_no"), pa.array([n for n, _ in found], pa.int64()), pa.array([c for _, c in found], pa.binary()), pa.array([False] * len(found), pa.bool_())]
            yield pa.RecordBatch.from_arrays(data, names=["path", *(c.split()[0] for c in TABLE.split(", "))])

    stitched = cut(_stitched(cut(_per_range(ranges).mapInArrow(tables, f"path string, {TABLE}")), ["path"]))
    plans = _planned(stitched, ["path"], max_tokens, overlap, block)
    where = stitched.select("path", "range_no", "before").join(files, "path")
    local = plans.join(where, ["path", "range_no"]).withColumn("local", F.col("begin") - F.col("before"))
    wanted = local.groupBy("path", "length", "range_no").agg(F.array_sort(F.collect_list(F.struct("piece", "local", "size", "ends_at"))).alias("pieces"))
    names = ["path", "chunk_index", "start", "stop", "token_count", "ends_at", "piece"]
    kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string()]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, length, number, pieces in zip(*(batch.column(c).to_pylist() for c in ("path", "length", "range_no", "pieces"))):
                found = file_pieces(path, number, range_bytes, length, [(p["local"], p["size"]) for p in pieces])
                rows = [(path, p["piece"], a, b, p["size"], p["ends_at"], t) for p, (a, b, t) in zip(pieces, found)]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return _per_range(wanted).mapInArrow(emit, "path string, chunk_index int, start long, stop long, token_count int, ends_at int, piece string")
