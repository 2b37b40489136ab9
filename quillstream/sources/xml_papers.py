"""Papers from JATS and TEI XML, and valid files among a folder's."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.functions.text import SECTION_TYPES

SECTION = "struct<section_id:string,heading:string,text:string,section_type:string,section_order:int,level:int>"
PARSED = f"format string, title string, abstract string, doi string, publication_year int, sections array<{SECTION}>, problem string"
# how the two formats name the same things
FORMATS = {
    "jats_xml": {"root": {"article"}, "section": "sec", "heading": "title", "block": {"p", "list", "disp-quote", "boxed-text", "table-wrap", "fig"}, "title": "article-title"},
    "grobid_tei": {"root": {"tei"}, "section": "div", "heading": "head", "block": {"p", "list", "quote", "figure", "formula", "note"}, "title": "title"},
}
_YEAR = re.compile(r"(?:19|20)\d\d")


def _name(element: ET.Element) -> str:
    return element.tag.rpartition("}")[2].lower() if isinstance(element.tag, str) else ""


def _text(element: ET.Element | None) -> str:
    return " ".join("".join(element.itertext()).split()) if element is not None else ""


def _all(root: ET.Element | None, name: str) -> Iterator[ET.Element]:
    return (e for e in root.iter() if _name(e) == name) if root is not None else iter(())


def _first(root: ET.Element | None, name: str) -> ET.Element | None:
    return next(_all(root, name), None)


def _attribute(element: ET.Element, name: str) -> str:
    return next((v for k, v in element.attrib.items() if k.rpartition("}")[2].lower() == name), "")


def _kind(heading: str) -> str:
    return next((kind for part, kind in SECTION_TYPES if part in heading.lower()), "body")


def _sections(body: ET.Element | None, how: dict, prefix: str) -> list[dict]:
    """Sections in document order with their own text; one without text of its own gives none and takes no number."""
    out: list[dict] = []

    def add(heading: str, text: str, level: int) -> None:
        if text:
            n = len(out) + 1
            out.append({"section_id": f"{prefix}-section-{n}", "heading": heading, "text": text, "section_type": _kind(heading), "section_order": n, "level": level})

    def own(element: ET.Element) -> str:
        return " ".join(t for child in element if _name(child) in how["block"] and (t := _text(child)))

    def walk(element: ET.Element, level: int) -> None:
        heading = _text(next((c for c in element if _name(c) == how["heading"]), None)) or "Untitled section"
        add(heading, own(element), level)
        for child in element:
            if _name(child) == how["section"]:
                walk(child, level + 1)

    if body is not None:
        add("Body", own(body), 1)
        for child in body:
            if _name(child) == how["section"]:
                walk(child, 1)
        if not out:
            add("Body", _text(body), 1)
    return out


def parse_paper(xml: str | bytes | None, prefix: str) -> dict:
    """One paper of either format; ``problem`` says why there is none."""
    empty = {"format": None, "title": None, "abstract": None, "doi": None, "publication_year": None, "sections": [], "problem": None}
    if not xml:
        return empty | {"problem": "empty"}
    try:
        root = ET.fromstring(xml)
    except ET.ParseError:
        return empty | {"problem": "malformed"}
    for name, how in FORMATS.items():
        paper = root if _name(root) in how["root"] else next((e for e in root.iter() if _name(e) in how["root"]), None)
        if paper is None:
            continue
        tei = name == "grobid_tei"
        head = _first(paper, "teiheader") if tei else paper
        abstract = _first(head, "abstract")
        paragraphs = " ".join(t for p in _all(abstract, "p") if (t := _text(p)))
        ids = [e for e in _all(head, "idno" if tei else "article-id") if _attribute(e, "type" if tei else "pub-id-type").lower() == "doi"]
        dates = [_attribute(e, "when") or _text(e) for e in _all(head, "date" if tei else "year")]
        years = [int(m[0]) for d in dates if (m := _YEAR.search(d))]
        return {
            "format": name,
            "title": _text(_first(head, how["title"])) or None,
            "abstract": paragraphs or _text(abstract) or None,
            "doi": _text(ids[0]) or None if ids else None,
            "publication_year": years[0] if years else None,
            "sections": _sections(_first(paper, "body"), how, prefix),
            "problem": None,
        }
    return empty | {"problem": "unknown root"}


def parse_papers(df: DataFrame, key: str, paper_id: str, xml: str) -> DataFrame:
    """``key, paper`` with one parsed paper per row; what cannot be read keeps its row, with the reason in ``paper.problem``."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            yield pd.DataFrame({key: frame[key], "paper": [parse_paper(x, p or "") for p, x in zip(frame["p"], frame["x"])]})

    kind = df.schema[key].dataType.simpleString()
    inner = ", ".join(p.replace(" ", ":", 1) for p in PARSED.split(", "))
    return df.select(key, F.col(paper_id).alias("p"), F.col(xml).alias("x")).mapInPandas(run, f"`{key}` {kind}, paper struct<{inner}>")


def merged_metadata(parsed: DataFrame, records: DataFrame, key: str) -> DataFrame:
    """Parsed papers with the gaps filled from metadata: the XML's title and abstract count first, the metadata's DOI and year do."""
    both = parsed.join(records.select(key, "title", "abstract", "doi", "publication_year"), key, "left")
    some = lambda c: F.nullif(F.trim(c), F.lit(""))
    return both.select(
        key,
        F.coalesce(some(F.col("paper.title")), some(F.col("title"))).alias("title"),
        F.coalesce(some(F.col("paper.abstract")), some(F.col("abstract"))).alias("abstract"),
        F.coalesce(some(F.col("doi")), some(F.col("paper.doi"))).alias("doi"),
        F.coalesce(F.col("publication_year"), F.col("paper.publication_year")).alias("publication_year"),
        F.col("paper.sections").alias("sections"),
        F.col("paper.problem").alias("problem"),
    )


def _escaped(text: Column) -> Column:
    """Text as XML content, without the characters XML 1.0 does not have."""
    plain = F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x00-\x08\x0B\x0C\x0E-\x1F\x{FFFE}\x{FFFF}]", " ")
    return F.replace(F.replace(F.replace(plain, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def as_jats(papers: DataFrame) -> DataFrame:
    """``record_id, paper_id, xml``: papers written as JATS with flat sections."""
    tag = lambda name, c: F.concat(F.lit(f"<{name}>"), _escaped(c), F.lit(f"</{name.split()[0]}>"))
    body = F.array_join(
        F.transform(F.coalesce(F.col("sections"), F.slice(F.col("sections"), 1, 0)), lambda s: F.concat(F.lit("<sec>"), tag("title", s["heading"]), tag("p", s["text"]), F.lit("</sec>"))), ""
    )
    xml = F.concat(
        F.lit("<article><front>"), tag("article-title", F.col("title")), tag("article-id pub-id-type='doi'", F.col("doi")), tag("year", F.col("publication_year").cast("string")),
        F.lit("<abstract>"), tag("p", F.col("abstract")), F.lit("</abstract></front><body>"), F.coalesce(body, F.lit("")), F.lit("</body></article>"),
    )
    return papers.select("record_id", "paper_id", xml.alias("xml"))


def pdf_problem(content: Column, length: Column, least: int = 10_000) -> Column:
    """Why bytes are no usable PDF, in order: empty, too small, no PDF; null if they are one."""
    return F.when(length.isNull() | (length == 0), "empty").when(length < least, "too small").when(F.substring(content, 1, 5) != F.lit(b"%PDF-"), "no PDF")


def file_index(files: DataFrame, suffix: str) -> DataFrame:
    """``work_id, paths``: sorted paths of the files with a suffix, any case, by the work id in their name; each of the others has a row with a null id."""
    name = F.regexp_extract("path", r"[^/]*$", 0)
    rows = files.where(F.lower("path").endswith(suffix.lower()))
    named = rows.select(F.nullif(F.upper(F.regexp_extract(name, r"(?i)W\d+", 0)), F.lit("")).alias("work_id"), "path")
    found = named.where("work_id is not null").groupBy("work_id").agg(F.sort_array(F.collect_list("path")).alias("paths"))
    return found.unionByName(named.where("work_id is null").select("work_id", F.array("path").alias("paths")))


def chosen_file(files: DataFrame, key: str, kinds: list[str]) -> DataFrame:
    """``key, path, kind, valid, reason``: of each key's files the first valid one by path of the first of ``kinds`` that has any, else the first path as it is. Files that are listed repeatedly count once, as valid if one listing is.

    Two aggregations that combine in the map tasks; null keys are left out.
    """
    known = files.where(F.col(key).isNotNull())
    once = known.groupBy(key, "path").agg(F.min(F.struct((~F.coalesce("valid", F.lit(False))).alias("bad"), "kind", "reason")).alias("f"))
    ok = ~F.col("f.bad")
    place = F.coalesce(F.when(ok, F.nullif(F.array_position(F.array(*map(F.lit, kinds)), F.col("f.kind")), F.lit(0))), F.lit(len(kinds) + 1))
    best = once.groupBy(key).agg(F.min(F.struct(place.alias("place"), "path", F.col("f.kind").alias("kind"), ok.alias("valid"), F.col("f.reason").alias("reason"))).alias("c"))
    return best.select(key, "c.path", "c.kind", "c.valid", "c.reason")


def local_inventory(records: DataFrame, key: str, pdfs: DataFrame, papers: DataFrame) -> DataFrame:
    """``records`` with the chosen PDF and XML file of each, why it is so, and ``content``: which valid ones there are (``pdf and xml``, ``pdf``, the kind of XML, or ``missing``). Files as in ``chosen_file``."""
    sides = {"pdf": chosen_file(pdfs, key, ["pdf"]), "xml": chosen_file(papers, key, ["jats", "tei"])}
    for name, side in sides.items():
        records = records.join(side.select(key, *(F.col(c).alias(f"{name}_{c}") for c in ("path", "kind", "valid", "reason"))), key, "left")
        records = records.withColumn(f"{name}_valid", F.coalesce(f"{name}_valid", F.lit(False))).withColumn(f"{name}_reason", F.coalesce(f"{name}_reason", F.lit("missing")))
    content = F.when(F.col("pdf_valid") & F.col("xml_valid"), "pdf and xml").when(F.col("pdf_valid"), "pdf").when(F.col("xml_valid"), F.col("xml_kind")).otherwise("missing")
    return records.drop("pdf_kind").withColumn("content", content)


def orphans(records: DataFrame, key: str, *files: DataFrame) -> DataFrame:
    """``path``: the files, each once, whose key no record has, or that have none."""
    known = records.select(key).where(F.col(key).isNotNull()).distinct()
    rows = [f.select(key, "path").distinct().join(known, key, "left_anti").select("path") for f in files]
    out = rows[0]
    for more in rows[1:]:
        out = out.unionByName(more)
    return out.distinct()
