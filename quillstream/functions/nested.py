"""Array and map expressions: abstracts from inverted indexes, ranking metrics."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.ids import identifier
from quillstream.functions.text import has_phrase


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once per row, however often it occurs in the result."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def abstract_text(index: Column) -> Column:
    """The words of an inverted index at their positions, a blank per gap; of two words at one position the greater. Null or empty gives ''.

    Negative and null positions are left out. Each word is written once, with the blanks between it and the one before.
    """
    pairs = F.flatten(
        F.transform(
            F.map_entries(index),
            lambda e: F.transform(F.filter(F.coalesce(e["value"], F.expr("cast(array() as array<int>)")), lambda p: p.isNotNull() & (p >= 0)), lambda p: F.struct(p.alias("at"), e["key"].alias("word"))),
        )
    )

    def last_of_each(all_: Column) -> Column:
        return F.filter(all_, lambda x, i: ~F.coalesce(F.get(all_, i + 1)["at"] == x["at"], F.lit(False)))

    def joined(words: Column) -> Column:
        gap = lambda x, i: F.coalesce(F.repeat(F.lit(" "), x["at"] - F.get(words, i - 1)["at"]), F.lit(""))
        return F.array_join(F.transform(words, lambda x, i: F.concat(F.when(i > 0, gap(x, i)).otherwise(""), x["word"])), "")

    return F.trim(F.coalesce(let(F.array_sort(pairs), lambda all_: let(last_of_each(all_), joined)), F.lit("")))


def ranked_ids(values: Column) -> Column:
    """Identifiers in one form, blanks dropped, each at its first rank."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.expr("cast(array() as array<string>)")), identifier), lambda v: v != ""))


def precision_at(got: Column, gold: Column, k: int) -> Column:
    """Share of the first ``k`` that are in the gold set, over those there are; null without gold, 0 if nothing was retrieved."""
    if k <= 0:
        raise ValueError("k must be positive")
    first, want = F.slice(ranked_ids(got), 1, k), ranked_ids(gold)
    return F.when(F.size(want) == 0, None).when(F.size(first) == 0, 0.0).otherwise(F.size(F.array_intersect(first, want)) / F.size(first))


def recall_at(got: Column, gold: Column, k: int) -> Column:
    """Share of the gold set in the first ``k``; null without gold."""
    first, want = F.slice(ranked_ids(got), 1, k), ranked_ids(gold)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(first, want)) / F.size(want))


def reciprocal_rank(got: Column, gold: Column) -> Column:
    """1 / the rank of the first hit anywhere in the list, 0 without one; null without gold."""
    want = ranked_ids(gold)
    hit = F.array_position(F.transform(ranked_ids(got), lambda v: F.array_contains(want, v)), True)
    return F.when(F.size(want) == 0, None).when(hit > 0, 1.0 / hit).otherwise(0.0)


def ndcg_at(got: Column, gold: Column, k: int) -> Column:
    """Binary nDCG: gains 1 / log2(rank + 1), against the gold set ranked first; null without gold."""
    want = ranked_ids(gold)
    hits = F.transform(F.slice(ranked_ids(got), 1, k), lambda v, i: F.when(F.array_contains(want, v), 1.0 / F.log2(i + F.lit(2.0))).otherwise(0.0))
    add = lambda a, x: a + x
    ideal = F.transform(F.sequence(F.lit(1), F.least(F.size(want), F.lit(k))), lambda i: 1.0 / F.log2(i + F.lit(1.0)))
    return F.when(F.size(want) > 0, F.aggregate(hits, F.lit(0.0), add) / F.aggregate(ideal, F.lit(0.0), add))


def citation_validity(cited: Column, retrieved: Column) -> Column:
    """Share of the citations, repeats counted, that were retrieved; 0 without citations."""
    have, all_ = ranked_ids(retrieved), F.transform(F.coalesce(cited, F.expr("cast(array() as array<string>)")), identifier)
    return F.when(F.size(all_) == 0, 0.0).otherwise(F.size(F.filter(all_, lambda c: F.array_contains(have, c))) / F.size(all_))


def citation_recall(cited: Column, gold: Column) -> Column:
    """Share of the gold set that is cited; null without gold."""
    want = ranked_ids(gold)
    return F.when(F.size(want) > 0, F.size(F.array_intersect(ranked_ids(cited), want)) / F.size(want))


def keyword_coverage(answer: Column, required: Column, forbidden: Column) -> Column:
    """Share of the required phrases that stand in the answer and of the forbidden ones that don't, as whole words; null if there are none of either."""
    none = F.expr("cast(array() as array<string>)")
    must, not_ = F.coalesce(required, none), F.coalesce(forbidden, none)
    text = F.coalesce(answer, F.lit(""))
    good = F.size(F.filter(must, lambda p: has_phrase(text, p))) + F.size(F.filter(not_, lambda p: ~has_phrase(text, p)))
    total = F.size(must) + F.size(not_)
    return F.when(total > 0, good / total)


def route_accuracy(retrieved: Column, searched_web: Column, needs_retrieval: Column, needs_web: Column) -> Column:
    """1, 0.5 or 0: how many of the two decisions were as expected; a null decision or expectation is none."""
    same = lambda a, b: F.coalesce((a == b).cast("double"), F.lit(0.0))
    return (same(retrieved, needs_retrieval) + same(searched_web, needs_web)) / 2


SUCCESSFUL = ("accepted", "direct_answer", "complete")
ABSTAINED = "insufficient_evidence"


def success(answer: Column, error: Column, status: Column, expects_abstention: Column, accepts_abstention: Column) -> Column:
    """1.0 for an answer without error and with a status that counts, else 0.0: where abstaining is expected only that counts, where it is accepted that counts as well."""
    no = F.lit(False)
    counts = F.when(F.coalesce(expects_abstention, no), status == ABSTAINED).otherwise(status.isin(*SUCCESSFUL) | (F.coalesce(accepts_abstention, no) & (status == ABSTAINED)))
    given = (F.trim(F.coalesce(answer, F.lit(""))) != "") & (F.coalesce(error, F.lit("")) == "")
    return F.when(F.coalesce(given & counts, no), 1.0).otherwise(0.0)


def valid_indexes(values: Column, size: Column) -> Column:
    """Distinct whole numbers from 0 below ``size``, in order of first sight."""
    return F.array_distinct(F.filter(values, lambda i: i.isNotNull() & (i >= 0) & (i < size)))


def with_citations(answer: Column, sources: Column) -> Column:
    """The answer with ``[id]`` of every declared source that it does not cite yet put at its end, in order."""
    missing = F.filter(F.array_distinct(F.coalesce(sources, F.expr("cast(array() as array<string>)"))), lambda s: ~F.contains(answer, F.concat(F.lit("["), s, F.lit("]"))))
    return F.concat_ws(" ", answer, *[F.nullif(F.array_join(F.transform(missing, lambda s: F.concat(F.lit("["), s, F.lit("]"))), " "), F.lit(""))])


def unknown_citations(sources: Column, evidence: Column) -> Column:
    """Declared sources that are not among the evidence."""
    none = F.expr("cast(array() as array<string>)")
    return F.array_except(F.coalesce(sources, none), F.coalesce(evidence, none))


def answer_problem(answer: Column, sources: Column, evidence: Column) -> Column:
    """Why the declared sources do not carry an answer, by the first source at fault: ``unknown source`` or ``not cited``, ``no source`` if none is declared; null if all is well."""
    none = F.expr("cast(array() as array<string>)")
    declared, have = F.coalesce(sources, none), F.coalesce(evidence, none)
    mark = lambda s: F.concat(F.lit("["), s, F.lit("]"))
    each = F.transform(declared, lambda s: F.when(~F.coalesce(F.array_contains(have, s), F.lit(False)), "unknown source").when(~F.contains(F.coalesce(answer, F.lit("")), mark(s)), "not cited"))
    return F.coalesce(F.get(F.filter(each, lambda p: p.isNotNull()), F.lit(0)), F.when(F.size(declared) == 0, "no source"))


def united(existing: Column, new: Column) -> Column:
    """Labels with new ones at their end, each once; without new ones they stay as they are, null too."""
    none = F.expr("cast(array() as array<string>)")
    return F.when(F.size(F.coalesce(new, none)) > 0, F.array_union(F.coalesce(existing, none), new)).otherwise(existing)


def known(score: Column) -> Column:
    """A score that is a number; NaN is null."""
    return F.when(~F.isnan(score), score)


def first_shortened(contexts: Column, k: int, most: int) -> Column:
    """The first ``k`` texts, each cut to ``most`` characters."""
    return F.transform(F.slice(contexts, 1, k), lambda c: F.left(c, F.lit(most)))


def limited(value: Column, most: dict[str, int]) -> Column:
    """A struct whose named text fields keep at most so many characters, without white space at the cut; nulls stay."""
    for name, n in most.items():
        value = value.withField(name, F.when(F.length(value[name]) > n, F.rtrim(F.left(value[name], F.lit(n)))).otherwise(value[name]))
    return value


def output_budget(documents: Column, base: int = 64, each: int = 160) -> Column:
    """Tokens to allow for a reply about so many documents; null for none or fewer."""
    return F.when(documents > 0, base + each * documents)
