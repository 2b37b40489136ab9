import pyarrow as pa
from pyspark.sql import functions as F

from quillstream.operators.shredding import Child, child_table, shred
from quillstream.operators.works import LEAVES, work_children, work_table
from quillstream.sources import xml_papers
from quillstream.sources.json_lines import elements, field_texts, is_json_object
from quillstream.streaming import ingest


def test_levels_of_a_nested_column():
    kind = pa.struct([("a", pa.list_(pa.struct([("x", pa.string()), ("b", pa.list_(pa.string()))])))])
    column = pa.array([{"a": [{"x": "1", "b": ["p", "q"]}, {"x": None, "b": []}]}, {"a": []}, {"a": None}, None, {"a": [None, {"x": "2", "b": None}]}], kind)
    lv = shred(column)
    x, b = lv[("a", "x")], lv[("a", "b")]
    assert list(zip(x.row.tolist(), x.rep.tolist(), x.dfn.tolist())) == [(0, 0, 5), (0, 1, 4), (1, 0, 2), (2, 0, 1), (3, 0, 0), (4, 0, 3), (4, 1, 5)]
    assert list(zip(b.rep.tolist(), b.dfn.tolist())) == [(0, 7), (2, 7), (1, 5), (0, 2), (0, 1), (0, 0), (0, 3), (1, 4)]
    assert b.values.to_pylist()[:3] == ["p", "q", None] and b.full == 7


def test_levels_of_a_slice():
    whole = pa.array([[["a"]], [], [["b", "c"], None]], pa.list_(pa.list_(pa.string())))
    lv = shred(whole.slice(1))[()]
    assert lv.values.to_pylist() == [None, "b", "c", None] and lv.rep.tolist() == [0, 0, 2, 1]


WORKS = "record_id long, locations array<struct<is_oa:boolean,landing_page_url:string,pdf_url:string,license:string,version:string,source:struct<id:string,display_name:string,type:string,issn:array<string>,host:struct<name:string,lineage:array<string>>>>>, best_oa_location struct<is_oa:boolean,landing_page_url:string,pdf_url:string,license:string,version:string,source:struct<id:string,display_name:string,type:string,issn:array<string>,host:struct<name:string,lineage:array<string>>>>, open_access struct<is_oa:boolean,oa_status:string,oa_url:string,any_repository_has_fulltext:boolean>, abstract_inverted_index map<string,array<int>>, pos int, child string"


def test_children_of_columns_and_lines(spark):
    none = (None,) * 6
    place = (True, None, None, None, None, ("S1", None, None, ["i0", None, "i2"], ("h", ["l0"])))
    rows = [
        (1, [none, place, None, (None, None, None, None, None, (None, None, None, None, (None, [])))], place, (None, None, None, None), {"a": [0, -1, 2], "b": [0], "c": None, "d": []}, 0, ""),
        (2, [], None, (False, None, None, None), None, 0, ""),
        (3, None, none, None, {}, 0, ""),
    ]
    lines = [
        (4, '{"locations": {"pdf_url": "u", "source": {"issn": "solo"}}, "open_access": {"is_oa": "yes"}, "abstract_inverted_index": {"w": [3, 3]}}'),
        (5, '{"locations": [null, {}, {"is_oa": false}], "best_oa_location": {}}'),
        (6, '{"locations": [{"is_oa": true}'),
        (7, None),
        (8, '["not an object"]'),
    ]
    got = work_children(spark.createDataFrame(rows, WORKS), spark.createDataFrame(lines, "record_id long, payload string")).collect()
    places = sorted((r["record_id"], r["child"], r["pos"], r["sub_pos"]) for r in got)
    assert places == sorted(
        [
            (1, "locations", 1, -1), (1, "locations_issn", 1, 0), (1, "locations_issn", 1, 2), (1, "locations_lineage", 1, 0), (1, "best_oa_location", 0, -1), (1, "abstract_word", 0, -1), (1, "abstract_word", 2, -1),
            (2, "open_access", 0, -1), (4, "locations", 0, -1), (4, "locations_issn", 0, 0), (4, "open_access", 0, -1), (4, "abstract_word", 3, -1), (5, "locations", 2, -1),
        ]
    )
    works, feed = spark.createDataFrame(rows, WORKS), spark.createDataFrame(lines, "record_id long, payload string")
    tables = {name: {(r["record_id"], r["pos"], r["sub_pos"]): {k: v for k, v in r.asDict().items() if v is not None and k not in ("record_id", "pos", "sub_pos")} for r in work_table(works, feed, name).collect()} for name in LEAVES}
    assert sorted((i, name, pos, sub) for name, found in tables.items() for i, pos, sub in found) == places
    assert tables["locations"][1, 1, -1] == {"is_oa": True, "source_id": "S1", "source_host_name": "h"}
    assert tables["locations_issn"][1, 1, 2] == {"issn": "i2"} and tables["abstract_word"][1, 0, -1] == {"word": "a"}
    nothing = spark.createDataFrame([], WORKS), spark.createDataFrame([], "record_id long, payload string")
    assert work_children(*nothing).collect() == [] and all(work_table(*nothing, name).collect() == [] for name in LEAVES)


def test_odd_positions_and_the_smallest_word(spark):
    lines = [(1, '{"abstract_inverted_index": {"b": ["2", 1.5, -1, null, 2147483648, "x"], "a": [2, 2], "": [7], "c": 3}}')]
    got = work_table(spark.createDataFrame([], WORKS), spark.createDataFrame(lines, "record_id long, payload string"), "abstract_word").collect()
    assert sorted((r["pos"], r["word"]) for r in got) == [(2, "a"), (3, "c"), (7, "")]


def test_children_lead_back_to_their_parents(spark, small):
    works = spark.read.parquet(f"{small}/works.parquet")
    rows = child_table(works.select("record_id", F.expr("transform(locations, l -> struct(l.pdf_url as pdf_url))").alias("locations")), "record_id", Child("l", "locations", (), 1), {"pdf_url": "u"})
    back = rows.select("record_id", "pos", "u")
    direct = works.select("record_id", F.posexplode("locations").alias("pos", "l")).select("record_id", "pos", F.col("l.pdf_url").alias("u")).where("u is not null")
    assert back.exceptAll(direct).isEmpty() and direct.exceptAll(back).isEmpty()


def test_json_lines(spark):
    rows = [('{"a": 1, "b": [1, {"c": 2}], "d": null}',), (' {"a": "x"} ',), ('{"a": 1',), ("[1]",), ("3",), ("",), (None,)]
    df = spark.createDataFrame(rows, "payload string")
    assert [r[0] for r in df.select(is_json_object(F.col("payload"))).collect()] == [True, True, False, False, False, False, False]
    got = field_texts(df, "payload", ["a", "b", "d"], []).select("a", elements(F.col("b")), "d").collect()
    assert [tuple(r) for r in got] == [("1", ["1", '{"c":2}'], None), ("x", None, None)]


JATS = """<x:pmc xmlns:x="u"><article><front><article-id pub-id-type="doi">10.1/a</article-id><article-title>A <i>title</i></article-title><pub-date><year>2021</year></pub-date>
<abstract><p>First.</p><p>Second.</p></abstract></front><body><p>Opening.</p><sec><title>Methods</title><p>Text &amp; more.</p><sec><title>Setup</title><list><li>x</li></list></sec></sec>
<sec><title>Empty</title><sec><title>Result</title><p>Deep.</p></sec></sec></body></article></x:pmc>"""
TEI = """<TEI xmlns="http://www.tei-c.org/ns/1.0"><teiHeader><title>T</title><date when="2019-05-01">May</date><idno type="DOI">10.2/b</idno><abstract>Short.</abstract></teiHeader>
<text><body><div><head>Introduction</head><p>One.</p><div><head>Part</head><p>Two.</p></div></div></body></text></TEI>"""


def test_xml_papers(spark):
    rows = [(1, "W1", JATS, 0), (2, "W2", TEI, 0), (3, "W3", "<a>", 0), (4, "W4", "<html/>", 0), (5, None, None, 0)]
    parsed = xml_papers.parse_papers(spark.createDataFrame(rows, "id int, p string, x string, paper int"), "id", "p", "x")
    got = {r["id"]: r["paper"] for r in parsed.collect()}
    a, b = got[1], got[2]
    assert (a["format"], a["title"], a["abstract"], a["doi"], a["publication_year"]) == ("jats_xml", "A title", "First. Second.", "10.1/a", 2021)
    assert [(s["heading"], s["text"], s["section_order"], s["level"], s["section_type"]) for s in a["sections"]] == [
        ("Body", "Opening.", 1, 1, "body"), ("Methods", "Text & more.", 2, 1, "methods"), ("Setup", "x", 3, 2, "body"), ("Result", "Deep.", 4, 2, "results"),
    ]
    assert (b["format"], b["title"], b["abstract"], b["doi"], b["publication_year"], [s["level"] for s in b["sections"]]) == ("grobid_tei", "T", "Short.", "10.2/b", 2019, [1, 2])
    assert [got[k]["problem"] for k in (3, 4, 5)] == ["malformed", "unknown root", "empty"]
    meta = spark.createDataFrame([(1, "M", "other", " 10.9/m ", 1999), (3, "M3", None, None, None)], "id int, title string, abstract string, doi string, publication_year int")
    merged = {r["id"]: r for r in xml_papers.merged_metadata(parsed, meta, "id").collect()}
    assert (merged[1]["title"], merged[1]["doi"], merged[1]["publication_year"], merged[3]["title"]) == ("A title", "10.9/m", 1999, "M3")


def test_files_and_pdfs(spark, tmp_path):
    (tmp_path / "W7.pdf").write_bytes(b"%PDF-" + b"x" * 20000)
    (tmp_path / "w8.PDF").write_bytes(b"%PDF-")
    (tmp_path / "other.pdf").write_bytes(b"z" * 20000)
    (tmp_path / "W9.xml").write_bytes(b"<a/>")
    files = spark.read.format("binaryFile").load(str(tmp_path))
    index = {r["work_id"]: len(r["paths"]) for r in xml_papers.file_index(files, ".pdf").collect()}
    assert index == {"W7": 1, "W8": 1, None: 1}
    why = {r[0].rsplit("/")[-1]: r[1] for r in files.select("path", xml_papers.pdf_problem(F.col("content"), F.col("length"))).collect()}
    assert (why["W7.pdf"], why["w8.PDF"], why["other.pdf"]) == (None, "too small", "no PDF")


def test_files_are_read_once(spark, tmp_path):
    schema = "record_id bigint, payload string"
    put = lambda rows: spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    run = lambda: ingest.ingest_lines(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "at")).count()
    put([(1, "{}"), (2, "{")])
    assert run() == 2 and run() == 2
    put([(3, None)])
    assert run() == 3
    assert spark.read.parquet(str(tmp_path / "out")).where("valid").count() == 1


def test_latest_and_remaining(spark):
    rows = spark.createDataFrame([("a", 1, 1), ("a", 3, 2), ("a", 3, 1), ("b", None, 9), (None, 1, 1)], "k string, at int, tie int")
    assert {tuple(r) for r in ingest.latest(rows, ["k"], "at", "tie").collect()} == {("a", 3, 2), ("b", None, 9), (None, 1, 1)}
    done = spark.createDataFrame([("a",), (None,)], "k string")
    assert {r["k"] for r in ingest.remaining(rows, done, ["k"]).collect()} == {"b", None}


def test_files_without_a_work_id_are_not_gathered(spark):
    files = spark.createDataFrame([("/a/W7.pdf",), ("/b/w7.pdf",), ("/a/x.pdf",), ("/a/y.pdf",)], "path string")
    got = sorted((r["work_id"] or "", r["paths"]) for r in xml_papers.file_index(files, ".pdf").collect())
    assert got == [("", ["/a/x.pdf"]), ("", ["/a/y.pdf"]), ("W7", ["/a/W7.pdf", "/b/w7.pdf"])]
