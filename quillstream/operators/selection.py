"""Scores of records against a lexicon, what speaks against a record, and what follows for it."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.nested import abstract_text, let


@dataclass(frozen=True)
class Rules:
    """``lexicon``: terms and their weights. A title with a term of ``off_topic`` and none of ``saving`` loses ``penalty``; one without any of ``on_topic`` holds the score below ``retain``, the score
    from which a record is retained; from ``ambiguous`` on it is ambiguous. Matching queries add one each, ``cap`` at most."""

    lexicon: dict[str, int] = field(default_factory=dict)
    off_topic: list[str] = field(default_factory=list)
    saving: list[str] = field(default_factory=list)
    on_topic: list[str] | None = None
    penalty: int = 12
    cap: int = 3
    retain: int = 8
    ambiguous: int = 4


def metadata_text(primary: Column, topics: Column, queries: Column) -> Column:
    """Names of the primary topic and of the topics, and matched queries, in lower case, nulls left out."""
    none = F.expr("cast(array() as array<string>)")
    names = F.coalesce(F.transform(topics, lambda t: t["display_name"]), none)
    return F.lower(F.array_join(F.concat(F.array(primary["display_name"]), names, F.coalesce(queries, none)), " "))


def hits(text: Column, terms: list[str]) -> Column:
    """The terms that occur in the text anywhere, in their order."""
    return F.filter(F.array(*(F.lit(t) for t in terms)) if terms else F.expr("cast(array() as array<string>)"), lambda t: F.contains(text, t))


def relevance(title: Column, index: Column, primary: Column, topics: Column, queries: Column, matches: Column, rules: Rules) -> Column:
    """``score, title_terms, abstract_terms, metadata_terms, penalty_terms`` of a work, as one struct; nulls count as empty.

    Each term of the lexicon counts where it occurs first: twice its weight in the title, once in the abstract, half of it (at least 1) in the metadata. Every text is built once.
    """
    weight = F.create_map(*(F.lit(x) for pair in rules.lexicon.items() for x in pair)) if rules.lexicon else F.expr("cast(map() as map<string,int>)")
    total = lambda terms, worth: F.aggregate(terms, F.lit(0), lambda a, t: a + worth(weight[t]))

    def scored(x: Column) -> Column:
        in_title = hits(x["title"], list(rules.lexicon))
        return let(in_title, lambda first: let(F.array_except(hits(x["abstract"], list(rules.lexicon)), first), lambda second: summed(x, first, second)))

    def summed(x: Column, first: Column, second: Column) -> Column:
        third = F.array_except(F.array_except(hits(x["meta"], list(rules.lexicon)), first), second)
        return let(third, lambda last: finished(x, first, second, last))

    def finished(x: Column, first: Column, second: Column, last: Column) -> Column:
        raw = total(first, lambda w: 2 * w) + total(second, lambda w: w) + total(last, lambda w: F.greatest(F.lit(1), F.floor(w / 2).cast("int"))) + F.least(F.greatest(F.coalesce(matches, F.lit(0)), F.lit(0)), F.lit(rules.cap))
        bad = F.when(F.size(hits(x["title"], rules.saving)) > 0, F.slice(first, 1, 0)).otherwise(hits(x["title"], rules.off_topic))
        return let(F.struct(raw.alias("raw"), bad.alias("bad")), lambda y: F.struct(held(x, y).alias("score"), first.alias("title_terms"), second.alias("abstract_terms"), last.alias("metadata_terms"), y["bad"].alias("penalty_terms")))

    def held(x: Column, y: Column) -> Column:
        score = y["raw"] - F.when(F.size(y["bad"]) > 0, rules.penalty).otherwise(0)
        if rules.on_topic is not None:
            score = F.when(F.size(hits(x["title"], rules.on_topic)) == 0, F.least(score, F.lit(rules.retain - 1))).otherwise(score)
        return F.greatest(score, F.lit(0))

    texts = F.struct(F.lower(F.coalesce(title, F.lit(""))).alias("title"), F.lower(abstract_text(index)).alias("abstract"), F.coalesce(metadata_text(primary, topics, queries), F.lit("")).alias("meta"))
    return let(texts, scored)


def failures(**tests: Column) -> Column:
    """The names of the tests that are true, in order; a null test is not."""
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in tests.items())))


def decision(score: Column, failed: Column, rules: Rules) -> Column:
    """retained, ambiguous or rejected by the score; rejected if any test failed."""
    return F.when(F.size(failed) > 0, "rejected").when(score >= rules.retain, "retained").when(score >= rules.ambiguous, "ambiguous").otherwise("rejected")


def candidate_order(score: Column, has_xml: Column, cited: Column, year: Column) -> list[Column]:
    """Best candidates first: by score, then those with parsed text, then by citations and year; nulls count as 0."""
    return [F.desc(score), F.desc(F.coalesce(has_xml, F.lit(False))), F.desc(F.coalesce(cited, F.lit(0))), F.desc(F.coalesce(year, F.lit(0)))]
