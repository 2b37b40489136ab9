"""Sizes of texts in tokens of a public tokenizer."""

from __future__ import annotations

import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_BETWEEN = re.compile(r"\S \S")
DEFAULT = "byte_bpe_50k.tiktoken"


def _encoding(path: str | None):
    """The tokenizer of a rank file, loaded once per Python worker."""
    held = sys.modules[__name__].__dict__.setdefault("_held", {})
    if path not in held:
        import base64

        import public_tokenizers
        import tiktoken

        with open(path or public_tokenizers.path(DEFAULT), "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        held[path] = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return held[path]


def _count(encoding, text: str, step: int = 200_000) -> int:
    """Tokens of one text; very long ones are counted in stretches cut before a single space between two words, which no token reaches across."""
    total, at = 0, 0
    while len(text) - at > step:
        to = text.rfind(" ", at + 1, at + step)
        while to > 0 and (text[to - 1].isspace() or text[to + 1].isspace()):
            to = text.rfind(" ", at + 1, to)
        if to < 0:  # no such place: the stretch grows up to the next one
            found = _BETWEEN.search(text, at + step)
            to = found.start() + 1 if found else len(text)
        total += len(encoding.encode_ordinary(text[at:to]))
        at = to
    return total + len(encoding.encode_ordinary(text[at:]))


def token_sizes(df: DataFrame, keys: list[str], text: str, path: str | None = None) -> DataFrame:
    """``keys, tokens``: tokens of each whole text, 0 for null and empty ones. ``path``: a tiktoken rank file; unset, the installed byte-level BPE."""
    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keys).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(path)
        for batch in batches:
            sizes = [_count(encoding, t) if t else 0 for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in keys), pa.array(sizes, pa.int64())], names=[*keys, "tokens"])

    return df.select(*keys, F.col(text).alias("text")).mapInArrow(run, f"{types}, tokens long")
