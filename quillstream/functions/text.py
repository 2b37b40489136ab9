"""String expressions on the JVM side: white space, tokens, phrases, rendered text."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# white space as Unicode has it, and tokens: runs of letters, digits and underscores, or single other characters
SPACE = r"\s\x0B\x1C-\x1F\x85\p{Z}"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = rf"{WORD}|[^\p{{L}}\p{{N}}_{SPACE}]"

# fixed values: question words that carry no content
STOPWORDS = (
    "a about above after again against all also am an and any are as at be because been before being below between both but by can could "
    "did do does doing down during each either few for from further had has have having he her here hers him his how i if in into is it its itself "
    "just me more most my no nor not now of off on once only or other our ours out over own same she should so some such than that the their theirs them "
    "then there these they this those through to too under until up very was we were what when where which while who whom why will with would you your "
    "yours explain describe compare discuss list give tell show"
).split()

# fixed values: what in a heading tells the type of its section, first match wins
SECTION_TYPES = [
    ("abstract", "abstract"),
    ("introduction", "introduction"),
    ("background", "background"),
    ("related work", "related_work"),
    ("literature review", "related_work"),
    ("method", "methods"),
    ("experimental setup", "methods"),
    ("result", "results"),
    ("discussion", "discussion"),
    ("conclusion", "conclusion"),
    ("limitation", "limitations"),
]


def squeeze(text: Column) -> Column:
    """White-space runs as one space, none at the ends; null stays null."""
    return F.trim(F.regexp_replace(text, f"[{SPACE}]+", " "))


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN))


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(TOKEN), F.lit(0))


def words(text: Column) -> Column:
    """Lower-case runs of letters, digits and underscores, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0))


def last_tokens(text: Column, n: int) -> Column:
    """The text from its n-th last token on; the trimmed text if it has no more than ``n``, and '' for n <= 0 or no token."""
    if n <= 0:
        return F.when(text.isNotNull(), F.lit(""))
    spaced = F.regexp_extract_all(text, F.lit(rf"(?:{TOKEN})[{SPACE}]*"), F.lit(0))
    tail = F.array_join(F.slice(spaced, F.greatest(F.size(spaced) - n + 1, F.lit(1)), n), "")
    return F.when(F.size(spaced) == 0, "").otherwise(F.trim(tail))


def search_terms(query: Column) -> Column:
    """Distinct content words of a query in order; all of its words if none is a content word."""
    all_words = words(query)
    content = F.filter(all_words, lambda w: ~w.isin(STOPWORDS))
    return F.array_distinct(F.when(F.size(content) > 0, content).otherwise(all_words))


def first_label(text: Column, cases: list[tuple[str, str]], default: str) -> Column:
    """The label of the first part that occurs in the text, whatever case; ``default`` if none does, or for null."""
    low = F.lower(F.coalesce(text, F.lit("")))
    out = F.when(low.contains(cases[0][0]), cases[0][1])
    for part, label in cases[1:]:
        out = out.when(low.contains(part), label)
    return out.otherwise(default)


def section_type(heading: Column) -> Column:
    return first_label(heading, SECTION_TYPES, "body")


def redacted(text: Column, parameter: str = "api_key") -> Column:
    """The text with the value of an address parameter blotted out."""
    return F.regexp_replace(text, rf"({parameter}=)[^&\s'\"]+", "$1REDACTED")


def has_phrase(text: Column, phrase: Column) -> Column:
    """Whether the phrase stands in the text as whole words, whatever case and white space."""
    pattern = F.concat(F.lit(r"(?<![\p{L}\p{N}_])\Q"), F.regexp_replace(squeeze(F.lower(phrase)), r"\\E", ""), F.lit(r"\E(?![\p{L}\p{N}_])"))
    return F.when(F.length(squeeze(phrase)) > 0, F.regexp_like(squeeze(F.lower(text)), pattern)).otherwise(False)


def joined_text(title: Column, abstract: Column, sections: Column) -> Column:
    """Title, abstract, then heading and text of each section, blank lines between, empty parts left out."""
    clean = lambda c: F.trim(F.coalesce(c, F.lit("")))
    parts = F.flatten(F.transform(F.coalesce(sections, F.array()), lambda s: F.array(clean(s["heading"]), clean(s["text"]))))
    return F.array_join(F.filter(F.concat(F.array(clean(title), clean(abstract)), parts), lambda p: p != ""), "\n\n")


def embedding_text(title: Column, heading: Column, text: Column) -> Column:
    """What an encoder reads of a chunk: labelled title and heading where there are any, then its text."""
    some = lambda label, c: F.when(F.trim(c) != "", F.concat(F.lit(label), F.trim(c)))
    return F.concat_ws("\n", some("Paper: ", title), some("Section: ", heading), F.trim(text))


def shortened(text: Column, most: int) -> Column:
    """At most ``most`` characters, and three dots where something was cut."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.left(text, F.lit(most))), F.lit("..."))).otherwise(text)


def compatible(text: Column) -> Column:
    """NFKC, which Spark has no function for; batches through Arrow."""

    @F.pandas_udf("string")
    def nfkc(values: pd.Series) -> pd.Series:
        return values.map(lambda v: v if v.isascii() else unicodedata.normalize("NFKC", v), na_action="ignore")

    return nfkc(text)


def stem_free_key(*parts: Column) -> Column:
    """First 12 hexadecimal digits of SHA-256 over the parts joined by '|'; for never-null parts."""
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12)
