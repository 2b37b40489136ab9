"""Sentence-packed and window chunks as folds over token counts, all in the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.nested import let
from quillstream.functions.text import SPACE, TOKEN, squeeze, stem_free_key, token_count


def _check(most: int, overlap: int) -> None:
    if most <= 0 or not 0 <= overlap < most:
        raise ValueError("most must be positive, and overlap at least 0 and less than most")


def windows(text: Column, most: int, overlap: int) -> Column:
    """Windows of ``most`` tokens of the text as it stands, each ``most - overlap`` tokens on; the last ends with the text."""
    _check(most, overlap)
    step = most - overlap
    parts = F.regexp_extract_all(text, F.lit(rf"(?:{TOKEN})[{SPACE}]*"), F.lit(0))
    n = F.size(parts)
    count = F.greatest(F.ceil((n - most) / F.lit(float(step))), F.lit(0)).cast("int")
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), count), lambda w: F.regexp_replace(F.array_join(F.slice(parts, w * step + 1, most), ""), f"[{SPACE}]+$", ""))).otherwise(
        F.expr("cast(array() as array<string>)")
    )


def sentence_chunks(text: Column, most: int, overlap: int) -> Column:
    """Chunks of whole sentences with at most ``most`` tokens.

    A chunk that is full passes its last ``overlap`` tokens on to the next if they fit with the next sentence. A sentence beyond ``most``
    ends the chunk before it and is cut into windows, after which nothing is passed on. Blank text gives no chunk.
    """
    _check(most, overlap)
    none = F.expr("cast(array() as array<string>)")

    def packed(clean: Column) -> Column:
        parts = F.filter(F.split(F.regexp_replace(clean, r"([.!?]) ", "$1\u0001"), "\u0001"), lambda s: s != "")
        counted = F.transform(parts, lambda s: F.struct(s.alias("s"), token_count(s).alias("n")))
        start = F.struct(none.alias("out"), F.lit("").alias("now"), F.lit(0).alias("n"))
        return F.aggregate(counted, start, step, flushed)

    def flushed(acc: Column) -> Column:
        return F.when(acc["now"] != "", F.array_append(acc["out"], acc["now"])).otherwise(acc["out"])

    def state(out: Column, now: Column, n: Column) -> Column:
        return F.struct(out.alias("out"), now.alias("now"), n.cast("int").alias("n"))

    def passed_on(acc: Column) -> Column:
        """The last tokens of a full chunk and their number."""
        if not overlap:
            return F.struct(F.lit("").alias("s"), F.lit(0).alias("n"))
        spaced = F.regexp_extract_all(acc["now"], F.lit(rf"(?:{TOKEN})[{SPACE}]*"), F.lit(0))
        tail = F.slice(spaced, F.greatest(F.size(spaced) - overlap + 1, F.lit(1)), overlap)
        return F.struct(F.trim(F.array_join(tail, "")).alias("s"), F.least(F.size(spaced), F.lit(overlap)).alias("n"))

    def step(acc: Column, x: Column) -> Column:
        glued = F.when(acc["now"] == "", x["s"]).otherwise(F.concat(acc["now"], F.lit(" "), x["s"]))
        next_ = let(
            passed_on(acc),
            lambda over: F.when((over["s"] != "") & (over["n"] + x["n"] <= most), state(flushed(acc), F.concat(over["s"], F.lit(" "), x["s"]), over["n"] + x["n"])).otherwise(state(flushed(acc), x["s"], x["n"])),
        )
        return (
            F.when(x["n"] > most, state(F.concat(flushed(acc), windows(x["s"], most, overlap)), F.lit(""), F.lit(0)))
            .when(acc["n"] + x["n"] <= most, state(acc["out"], glued, acc["n"] + x["n"]))
            .otherwise(next_)
        )

    clean = squeeze(text)
    whole = let(F.struct(clean.alias("t"), token_count(clean).alias("n")), lambda c: F.when(c["n"] <= most, F.when(c["n"] > 0, F.array(c["t"])).otherwise(none)).otherwise(packed(c["t"])))
    return F.when(text.isNull(), none).otherwise(whole)


def paper_chunks(papers: DataFrame, most: int = 300, overlap: int = 50, abstracts: bool = True) -> DataFrame:
    """One row per chunk of each paper, the abstract as a section of order 0; chunks never cross sections and keep their paper's columns.

    Null and blank abstracts and sections give none. ``chunk_id`` is built from paper, section, index and text.
    """
    head = F.struct(
        F.concat(F.col("paper_id"), F.lit("-abstract")).alias("section_id"), F.lit("Abstract").alias("heading"), F.col("abstract").alias("text"), F.lit("abstract").alias("section_type"), F.lit(0).alias("section_order")
    )
    rest = F.transform(F.col("sections"), lambda s: F.struct(*(s[n].alias(n) for n in ("section_id", "heading", "text", "section_type", "section_order"))))
    none = F.slice(F.array(head), 1, 0)
    all_ = F.concat(F.array(head) if abstracts else none, F.coalesce(rest, none))
    rows = papers.select("record_id", "paper_id", "title", "publication_year", "source_format", F.explode(all_).alias("s"))
    cut = rows.select("*", F.posexplode(sentence_chunks(F.col("s.text"), most, overlap)).alias("chunk_index", "text"))
    key = stem_free_key(F.coalesce("paper_id", F.lit("")), F.coalesce("s.section_id", F.lit("")), F.col("chunk_index").cast("string"), F.col("text"))
    return cut.select(
        "record_id", F.concat(F.coalesce("paper_id", F.lit("")), F.lit("-chunk-"), key).alias("chunk_id"), "paper_id", "title", "publication_year", "source_format",
        F.col("s.section_id").alias("section_id"), F.col("s.heading").alias("section_heading"), F.col("s.section_type").alias("section_type"), F.col("s.section_order").alias("section_order"),
        "chunk_index", "text", token_count(F.col("text")).alias("token_count"), F.length("text").alias("character_count"),
    )


def chunk_report(chunks: DataFrame, small: int = 40) -> DataFrame:
    """One row: counts, token sums and extremes, abstract and body chunks, small chunks, papers and repeated ids."""
    return chunks.agg(
        F.count("*").alias("chunks"),
        F.sum("token_count").cast("bigint").alias("tokens"),
        F.min("token_count").cast("bigint").alias("least"),
        F.max("token_count").cast("bigint").alias("most"),
        F.round(F.avg("token_count"), 6).alias("mean"),
        F.count_if(F.col("section_type") == "abstract").alias("abstract_chunks"),
        F.count_if(~F.col("section_type").eqNullSafe(F.lit("abstract"))).alias("body_chunks"),
        F.count_if(F.col("token_count") < small).alias("small_chunks"),
        F.count_distinct("paper_id").alias("papers"),
        (F.count("chunk_id") - F.count_distinct("chunk_id")).alias("repeated_ids"),
    )
