"""Identifiers, addresses and dates in one form."""

from __future__ import annotations

import ipaddress

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstream.functions.text import compatible

# fixed values: IPv4 blocks that are not global, as first and last number; multicast is left out too, though some count it as global
_NOT_GLOBAL = [
    "0.0.0.0/8", "10.0.0.0/8", "100.64.0.0/10", "127.0.0.0/8", "169.254.0.0/16", "172.16.0.0/12", "192.0.0.0/24", "192.0.2.0/24", "192.168.0.0/16", "198.18.0.0/15", "198.51.100.0/24", "203.0.113.0/24",
    "224.0.0.0/4", "240.0.0.0/4",
]
_GLOBAL_AGAIN = ["192.0.0.9/32", "192.0.0.10/32"]
_OCTET = r"(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# fixed values: wording that asks for recent evidence
RECENCY = (
    r"(?i)\b(last|past|this|recent|recently|latest|newest|today|yesterday|current|currently)\b|\b\d+\s*(day|days|week|weeks|month|months|year|years)\b"
)

# fixed values: wording that asks for what came after the corpus
FRESH = r"(?i)after the (local )?corpus|corpus cutoff|\bretractions?\b"


def _blank(c: Column) -> Column:
    return F.nullif(F.trim(c), F.lit(""))


def work_id(value: Column) -> Column:
    """The last path segment in upper case if it is W and digits, else ''."""
    last = F.substring_index(F.trim(F.coalesce(value, F.lit(""))), "/", -1)
    return F.regexp_extract(F.upper(last), r"^W\d+$", 0)


def work_id_anywhere(value: Column) -> Column:
    """The first W and digits in the value, in upper case; null if there is none."""
    return F.nullif(F.upper(F.regexp_extract(value, r"(?i)W\d+", 0)), F.lit(""))


def pmc_id(value: Column) -> Column:
    """PMC and digits in upper case, else null."""
    plain = F.upper(F.trim(value))
    return F.when(plain.rlike(r"^PMC\d+$"), plain)


def plain_doi(value: Column) -> Column:
    """Lower case, without the address or label before it; '' for null."""
    return F.trim(F.regexp_replace(F.lower(F.trim(F.coalesce(value, F.lit("")))), r"^(https?://(dx\.)?doi\.[a-z]+/|doi:)", ""))


def title_key(value: Column) -> Column:
    """Letters a-z and digits of the NFKC title in lower case, other runs as one space."""
    return F.trim(F.regexp_replace(F.lower(compatible(F.coalesce(value, F.lit("")))), "[^a-z0-9]+", " "))


def identifier(value: Column) -> Column:
    """The last non-empty path segment in lower case."""
    return F.lower(F.substring_index(F.regexp_replace(F.trim(F.coalesce(value, F.lit(""))), "/+$", ""), "/", -1))


def identity(id_: Column, paper_id: Column, doi: Column, title: Column) -> Column:
    """The first of id, paper id, DOI and title that isn't blank."""
    return F.coalesce(_blank(id_), _blank(paper_id), F.nullif(plain_doi(doi), F.lit("")), F.concat(F.lit("title:"), F.regexp_replace(F.lower(_blank(title)), r"\s+", " ")))


def _in_blocks(number: Column, blocks: list[str]) -> Column:
    found = F.lit(False)
    for block in map(ipaddress.ip_network, blocks):
        found = found | number.between(int(block.network_address), int(block.broadcast_address))
    return found


def _global_v6(host: Column) -> Column:
    """Whether an address in brackets is global; Spark has no function for these, and only they reach Python."""

    @F.pandas_udf("boolean")
    def check(hosts: pd.Series) -> pd.Series:
        def one(h: str) -> bool:
            try:
                address = ipaddress.IPv6Address(h.strip("[]"))
            except ValueError:
                return False
            return address.is_global and not address.is_multicast

        return hosts.map(one, na_action="ignore")

    return check(host)


def is_safe_url(value: Column) -> Column:
    """http or https to a public host: no name of this machine or of a local network, and no address outside the global unicast blocks. What only looks like an address is a name. Null and what is no address are not safe."""
    url = F.trim(value)
    scheme, host = (F.lower(F.try_parse_url(url, F.lit(p))) for p in ("PROTOCOL", "HOST"))
    v6 = host.startswith("[")
    octets = [F.regexp_extract(host, rf"^{_OCTET}\.{_OCTET}\.{_OCTET}\.{_OCTET}$", k).try_cast("bigint") for k in range(1, 5)]
    number = ((octets[0] * 256 + octets[1]) * 256 + octets[2]) * 256 + octets[3]
    inside = number.isNotNull() & _in_blocks(number, _NOT_GLOBAL) & ~_in_blocks(number, _GLOBAL_AGAIN)
    named = ~host.isin("localhost", "localhost.localdomain") & ~host.endswith(".local")
    open_ = F.when(v6, _global_v6(F.when(v6, host))).otherwise(named & ~F.coalesce(inside, F.lit(False)))
    return F.coalesce(scheme.isin("http", "https") & open_, F.lit(False))


def open_pdf_urls(best: Column, locations: Column) -> Column:
    """Distinct PDF addresses in order: the best location's unless it is not open, then those of open locations."""
    first = F.filter(F.array(F.when(~best["is_oa"].eqNullSafe(F.lit(False)), best["pdf_url"])), lambda u: u.isNotNull())
    rest = F.transform(F.filter(locations, lambda x: x["is_oa"] & x["pdf_url"].isNotNull()), lambda x: x["pdf_url"])
    rest = F.coalesce(rest, F.expr("cast(array() as array<string>)"))
    return F.array_distinct(F.filter(F.concat(first, rest), lambda u: F.trim(u) != ""))


def iso_date(value: Column) -> Column:
    """The date a text begins with, null if there is none or it doesn't exist."""
    return F.try_to_date(F.nullif(F.regexp_extract(value, r"^\d{4}-\d{2}-\d{2}", 0), F.lit("")), "yyyy-MM-dd")


def year(value: Column) -> Column:
    """A year from 1900 to 2100, else null."""
    y = value.try_cast("int")
    return F.when(y.between(1900, 2100), y)


def in_window(date: Column, only_year: Column, start: str, end: str, days: int) -> Column:
    """Whether evidence falls in a window of dates; a mere year counts only in windows of 365 days or more."""
    by_year = F.lit(days >= 365) & only_year.between(int(start[:4]), int(end[:4]))
    return F.coalesce(F.when(date.isNotNull(), date.between(F.lit(start).cast("date"), F.lit(end).cast("date"))).otherwise(by_year), F.lit(False))


def asks_for_recent(question: Column) -> Column:
    return F.coalesce(question.rlike(RECENCY), F.lit(False))


def asks_for_fresh(question: Column) -> Column:
    """Whether a question asks for events after the corpus or for retractions; null asks for nothing."""
    return F.coalesce(question.rlike(FRESH), F.lit(False))


def first_work_id(*values: Column) -> Column:
    """The id in the first value that holds one, in upper case; null if none does."""
    return F.coalesce(*(work_id_anywhere(v) for v in values))


def web_source_id(url: Column) -> Column:
    """A stable id of a web page: ``web-`` and the first 12 hexadecimal digits of SHA-256 over its address."""
    return F.concat(F.lit("web-"), F.substring(F.sha2(url, 256), 1, 12))


def is_web_url(value: Column) -> Column:
    """http or https with some host; null is none."""
    return F.coalesce(F.trim(value).rlike(r"(?i)^https?://[^/?#\s]+"), F.lit(False))


def with_parameter(url: Column, name: str, value: Column) -> Column:
    """The address with one parameter set: earlier ones of that name go, the others stay as they are, the new one comes last, before any ``#`` part."""
    plain, mark = F.substring_index(url, "#", 1), F.regexp_extract(url, "#.*$", 0)
    query = F.regexp_extract(plain, r"\?(.*)$", 1)
    others = F.filter(F.split(query, "&"), lambda p: (p != "") & (F.substring_index(p, "=", 1) != name))
    pairs = F.concat(others, F.array(F.concat(F.lit(f"{name}="), F.url_encode(value))))
    return F.concat(F.substring_index(plain, "?", 1), F.lit("?"), F.array_join(pairs, "&"), mark)


def keyed_url(available: Column, url: Column, host: str, name: str, key: Column) -> Column:
    """The address with its key where the content is available at the stated host and the key is not blank; else null."""
    fits = F.coalesce(available, F.lit(False)) & (F.lower(F.try_parse_url(url, F.lit("HOST"))) == host) & _blank(key).isNotNull()
    return F.when(fits, with_parameter(url, name, key))


def header_number(headers: Column, name: str) -> Column:
    """The number in one entry of a map of texts; null if it is absent or no number."""
    return F.trim(F.try_element_at(headers, F.lit(name))).try_cast("double")


def host_in(url: Column, hosts: list[str]) -> Column:
    """Whether an address is at one of the hosts, whatever case; null is at none."""
    return F.coalesce(F.lower(F.try_parse_url(url, F.lit("HOST"))).isin(*hosts), F.lit(False))


def article_parts(url: Column, hosts: list[str]) -> Column:
    """``issn, volume, article`` of an address ``/issn/volume/issue/article`` at one of the hosts; null for any other."""
    parts = F.filter(F.split(F.try_parse_url(url, F.lit("PATH")), "/"), lambda s: s != "")
    number = lambda k: F.get(parts, F.lit(k)).try_cast("bigint")
    digits = lambda k: F.get(parts, F.lit(k)).rlike(r"^[0-9]+$")
    fits = host_in(url, hosts) & F.get(parts, F.lit(0)).rlike(r"^[0-9]{4}-[0-9]{3}[0-9Xx]$") & digits(1) & digits(3)
    return F.when(fits, F.struct(F.get(parts, F.lit(0)).alias("issn"), number(1).alias("volume"), number(3).alias("article")))


def doi_code(doi: Column, prefix: str) -> Column:
    """The letters after a DOI's prefix (a pattern) that come before a digit, in lower case; '' if there are none."""
    return F.regexp_extract(F.lower(F.coalesce(doi, F.lit(""))), rf"{prefix}/([a-z]+)[0-9]", 1)


def slug_candidates(journal: Column, doi: Column, known: dict[str, str], prefix: str) -> Column:
    """Guesses at the short name of a journal in order, each once: the known one of its name, the name's letters and digits, the code in the DOI."""
    name = F.lower(F.trim(F.coalesce(journal, F.lit(""))))
    table = F.create_map(*(F.lit(v) for pair in known.items() for v in pair)) if known else F.expr("cast(map() as map<string,string>)")
    return F.array_distinct(F.filter(F.array(F.try_element_at(table, name), F.regexp_replace(name, "[^a-z0-9]+", ""), doi_code(doi, prefix)), lambda s: s.isNotNull() & (s != "")))


def deployed_address(base: str, slug: Column, volume: Column, article: Column) -> Column:
    """The address of an article's file below ``base``: the volume in at least two digits, the article in at least five."""
    padded = lambda c, n: F.lpad(c.cast("string"), F.greatest(F.lit(n), F.length(c.cast("string"))), F.lit("0"))
    stem = F.concat_ws("-", slug, padded(volume, 2), padded(article, 5))
    return F.when(slug.isNotNull() & volume.isNotNull() & article.isNotNull(), F.concat(F.lit(base.rstrip("/") + "/"), slug, F.lit("/"), stem, F.lit("/article_deploy/"), stem, F.lit(".pdf")))
