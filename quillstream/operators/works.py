"""Metadata records of works, from columns or from JSON lines, and the flat tables below them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillstream.operators.shredding import Child, child_rows, child_table
from quillstream.sources.json_lines import elements, field_texts

HOST = "struct<name:string,lineage:array<string>>"
SOURCE = f"struct<id:string,display_name:string,type:string,issn:array<string>,host:{HOST}>"
PLACE = f"struct<is_oa:string,landing_page_url:string,pdf_url:string,license:string,version:string,source:{SOURCE}>"
ACCESS = "struct<is_oa:string,oa_status:string,oa_url:string,any_repository_has_fulltext:string>"
NESTED = ["locations", "best_oa_location", "open_access", "abstract_inverted_index"]

CHILDREN = [
    Child("locations", "locations", (), 1),
    Child("locations_issn", "locations", ("source", "issn"), 2),
    Child("locations_lineage", "locations", ("source", "host", "lineage"), 2),
    Child("best_oa_location", "best_oa_location"),
    Child("open_access", "open_access"),
    Child("abstract_word", "abstract_inverted_index", ("value",), placed=True, told=("key",)),
]
PLACE_LEAVES = {n: n.replace(".", "_") for n in ("is_oa", "landing_page_url", "pdf_url", "license", "version", "source.id", "source.display_name", "source.type", "source.host.name")}
LEAVES = {
    "locations": PLACE_LEAVES, "best_oa_location": PLACE_LEAVES, "open_access": {n: n for n in ("is_oa", "oa_status", "oa_url", "any_repository_has_fulltext")},
    "locations_issn": {"issn": "issn"}, "locations_lineage": {"lineage": "lineage"}, "abstract_word": {"key": "word"},
}
TRUTH = {"is_oa", "any_repository_has_fulltext"}


def _object(text: Column, schema: str) -> Column:
    return F.from_json(F.when(F.ltrim(text).startswith("{"), text), schema)


def _place(text: Column) -> Column:
    flat = _object(text, "is_oa string, landing_page_url string, pdf_url string, license string, version string, source string")
    source = _object(flat["source"], "id string, display_name string, type string, issn string, host string")
    host = _object(source["host"], "name string, lineage string")
    whole_host = F.when(host.isNotNull(), F.struct(host["name"].alias("name"), elements(host["lineage"]).alias("lineage")))
    whole_source = F.when(
        source.isNotNull(),
        F.struct(*(source[n].alias(n) for n in ("id", "display_name", "type")), elements(source["issn"]).alias("issn"), whole_host.alias("host")),
    )
    return F.when(flat.isNotNull(), F.struct(*(flat[n].alias(n) for n in ("is_oa", "landing_page_url", "pdf_url", "license", "version")), whole_source.alias("source")))


def works_of_lines(lines: DataFrame, payload: str, key: str) -> DataFrame:
    """The nested columns of every valid JSON line with all leaves as text; one bare object counts as a list of one."""
    text = field_texts(lines, payload, NESTED, [key])
    words = _object(F.col("abstract_inverted_index"), "map<string,string>")
    return text.select(
        key,
        F.transform(elements(F.col("locations")), _place).alias("locations"),
        _place(F.col("best_oa_location")).alias("best_oa_location"),
        _object(F.col("open_access"), ACCESS).alias("open_access"),
        F.transform_values(words, lambda _, v: elements(v)).alias("abstract_inverted_index"),
    )


def works_of_table(works: DataFrame, key: str) -> DataFrame:
    """The same columns of the table of works."""
    return works.select(
        key,
        F.col("locations").cast(f"array<{PLACE}>").alias("locations"),
        F.col("best_oa_location").cast(PLACE).alias("best_oa_location"),
        F.col("open_access").cast(ACCESS).alias("open_access"),
        F.col("abstract_inverted_index").cast("map<string,array<string>>").alias("abstract_inverted_index"),
    )


def _works(works: DataFrame, lines: DataFrame, key: str) -> DataFrame:
    return works_of_table(works, key).unionByName(works_of_lines(lines, "payload", key))


def work_children(works: DataFrame, lines: DataFrame, key: str = "record_id") -> DataFrame:
    """All child rows of the works of both feeds (``record_id, child, pos, sub_pos``), a row per record and place.

    ``abstract_word`` has one row per distinct non-negative position.
    """
    return child_rows(_works(works, lines, key), key, CHILDREN)


def work_table(works: DataFrame, lines: DataFrame, name: str, key: str = "record_id") -> DataFrame:
    """The flat table of one child of the works of both feeds: ``record_id, pos, sub_pos`` and its leaves; truth values are booleans, all else is text.

    Works lead to it by ``record_id``, elements of a location to theirs by ``(record_id, pos)``. Only the column that it comes from is read. A word is the smallest at its position.
    """
    child = next(c for c in CHILDREN if c.name == name)
    rows = child_table(_works(works, lines, key), key, child, LEAVES[name])
    return rows.select(*(F.expr(f"try_cast(`{c}` as boolean)").alias(c) if c in TRUTH else F.col(c) for c in rows.columns))
