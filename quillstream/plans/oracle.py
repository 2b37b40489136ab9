"""SQL for DuckDB that gives the rows of the registered queries from the same tables."""

from __future__ import annotations

from quillstream.functions.ids import FRESH, RECENCY
from quillstream.functions.text import SECTION_TYPES, STOPWORDS
from quillstream.plans.settings import CUTOFF, FAILS, JOURNALS, LEXICON, OFF_TOPIC, ON_TOPIC, RUNS, SAVING, WINDOW

SPACE = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}"
WORD = r"[\p{L}\p{N}_]+"
TOKEN = rf"{WORD}|[^\p{{L}}\p{{N}}_{SPACE}]"


def squeezed(c: str) -> str:
    return f"trim(regexp_replace({c}, '[{SPACE}]+', ' ', 'g'))"


def counted(c: str) -> str:
    return f"len(regexp_extract_all({c}, '{TOKEN}'))"


def work_id(c: str) -> str:
    return f"regexp_extract(upper(list_extract(string_split(trim(coalesce({c}, '')), '/'), -1)), '^W\\d+$')"


def found_id(c: str) -> str:
    return f"nullif(upper(regexp_extract({c}, '(?i)W\\d+')), '')"


def section_type(heading: str) -> str:
    cases = " ".join(f"WHEN contains(lower(coalesce({heading}, '')), '{part}') THEN '{kind}'" for part, kind in SECTION_TYPES)
    return f"CASE {cases} ELSE 'body' END"


ABSTRACT = """spots AS (
  SELECT record_id, p AS spot, max(word) AS word FROM (
    SELECT record_id, word, unnest(ps) AS p FROM (SELECT record_id, unnest(map_keys(abstract_inverted_index)) AS word, unnest(map_values(abstract_inverted_index)) AS ps FROM works)
  ) WHERE p >= 0 GROUP BY ALL
), slots AS (
  SELECT record_id, unnest(range(0, 1 + top)) AS spot FROM (SELECT record_id, max(spot) AS top FROM spots GROUP BY record_id)
), built AS (
  SELECT record_id, trim(string_agg(coalesce(word, ''), ' ' ORDER BY spot)) AS abstract FROM slots LEFT JOIN spots USING (record_id, spot) GROUP BY record_id
), abstract_of AS (SELECT record_id, coalesce(abstract, '') AS abstract FROM works LEFT JOIN built USING (record_id))"""


def _some(text: str, terms: list[str]) -> str:
    return "list_filter([" + ", ".join(f"'{t}'" for t in terms) + f"], lambda t: contains({text}, t))"


def _scored() -> str:
    terms = list(LEXICON)
    once = " + ".join(f"CASE WHEN list_contains(tt, '{t}') THEN {2 * w} WHEN list_contains(at_, '{t}') THEN {w} WHEN list_contains(mt, '{t}') THEN {max(1, w // 2)} ELSE 0 END" for t, w in LEXICON.items())
    tests = dict(zip(FAILS, ["is_retracted", "trim(coalesce(title, '')) = ''", "coalesce(cardinality(abstract_inverted_index), 0) = 0", "NOT (coalesce(has_content.pdf, false) OR coalesce(has_content.grobid_xml, false))"]))
    fails = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in tests.items())
    return f"""{ABSTRACT}, texts AS (
  SELECT w.*, lower(coalesce(title, '')) AS tx, lower(a.abstract) AS ax,
    lower(array_to_string(list_concat([primary_topic.display_name], coalesce(list_transform(topics, lambda t: t.display_name), []), coalesce(matched_queries, [])), ' ')) AS mx
  FROM works w JOIN abstract_of a USING (record_id)
), found AS (
  SELECT *, {_some('tx', terms)} AS tt, list_filter({_some('ax', terms)}, lambda t: NOT contains(tx, t)) AS at_, list_filter({_some('mx', terms)}, lambda t: NOT contains(tx, t) AND NOT contains(ax, t)) AS mt,
    CASE WHEN len({_some('tx', SAVING)}) > 0 THEN [] ELSE {_some('tx', OFF_TOPIC)} END AS pt, len({_some('tx', ON_TOPIC)}) AS near FROM texts
), raw AS (SELECT *, {once} + least(greatest(coalesce(query_match_count, 0), 0), 3) - CASE WHEN len(pt) > 0 THEN 12 ELSE 0 END AS r FROM found), scored AS (
  SELECT *, CAST(greatest(0, CASE WHEN near = 0 THEN least(r, 7) ELSE r END) AS BIGINT) AS score, list_filter([{fails}], lambda f: f IS NOT NULL) AS fails FROM raw
)"""


def _leaves(item: str, names: list[str]) -> str:
    """Leaves of a JSON object as columns, truth values as booleans."""
    text = lambda c: f"{item} ->> '$.{c}'"
    return ", ".join(f"{f'TRY_CAST({text(c)} AS BOOLEAN)' if c in ('is_oa', 'any_repository_has_fulltext') else text(c)} AS {c.replace('.', '_')}" for c in names)


LOCATION = ["is_oa", "landing_page_url", "pdf_url", "license", "version", "source.id", "source.display_name", "source.type", "source.host.name"]
CHUNKS = "docs AS (SELECT DISTINCT ON (vector_id) * FROM chunks)"
STOP = ", ".join(f"'{w}'" for w in STOPWORDS)
BM25 = f"""{CHUNKS}, asked AS (
  SELECT question_id, regexp_extract_all(lower(question), '{WORD}') AS ws FROM questions
), kept AS (
  SELECT question_id, ws, list_filter(ws, lambda w: w NOT IN ({STOP})) AS content FROM asked
), terms AS (
  SELECT DISTINCT question_id, unnest(CASE WHEN len(content) > 0 THEN content ELSE ws END) AS term FROM kept
), sized AS (
  SELECT vector_id, regexp_extract_all(lower(coalesce(text, '')), '{WORD}') AS ws FROM docs
), stats AS (SELECT count(*) AS n, avg(len(ws)) AS mean FROM sized), tf AS (
  SELECT vector_id, len, term, count(*) AS tf FROM (SELECT vector_id, len(ws) AS len, unnest(ws) AS term FROM sized) GROUP BY ALL
), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), scored AS (
  SELECT question_id, vector_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
  FROM terms JOIN df USING (term) JOIN tf USING (term), stats GROUP BY question_id, vector_id
), sparse AS (
  SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vector_id) AS rank FROM scored) WHERE rank <= 50
)"""


def _bm25_round(terms: str, out: str) -> str:
    """The ten best of each query of a term list, over the tables of BM25."""
    return f"""{out} AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, vector_id) AS rank FROM (
      SELECT question_id, vector_id, round(sum(greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score
      FROM {terms} JOIN df USING (term) JOIN tf USING (term), stats GROUP BY question_id, vector_id)) WHERE rank <= 10)"""


def _terms(source: str, query: str, out: str) -> str:
    return f"""{out} AS (SELECT DISTINCT question_id, unnest(CASE WHEN len(content) > 0 THEN content ELSE ws END) AS term FROM (
      SELECT question_id, ws, list_filter(ws, lambda w: w NOT IN ({STOP})) AS content FROM (SELECT question_id, regexp_extract_all(lower({query}), '{WORD}') AS ws FROM {source})))"""


def _list(score: str, name: str) -> str:
    return f"""{name} AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, chunk_id) AS rank FROM (
    SELECT question_id, chunk_id, max({score}) AS s FROM candidates WHERE {score} IS NOT NULL AND NOT isnan({score}) GROUP BY ALL)
) WHERE rank <= 50)"""


def _fuse(doc: str, k: int) -> str:
    return f"""fused AS (SELECT * FROM (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY score DESC, dense_rank NULLS LAST, sparse_rank NULLS LAST, {doc}) AS rank FROM (
    SELECT question_id, {doc}, d.rank AS dense_rank, s.rank AS sparse_rank, round(coalesce(1.0 / (60 + d.rank), 0) + coalesce(1.0 / (60 + s.rank), 0), 9) AS score
    FROM dense d FULL JOIN sparse s USING (question_id, {doc}))
) WHERE rank <= {k})"""


LISTS = f"{_list('dense_score', 'dense')}, {_list('sparse_score', 'sparse')}"
JUDGED = f"""{LISTS}, {_fuse('chunk_id', 10)}, rated AS (
  SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY s DESC, chunk_id) AS rank FROM (
    SELECT question_id, chunk_id, max(rerank_score) AS s FROM candidates WHERE rerank_score IS NOT NULL AND NOT isnan(rerank_score) GROUP BY ALL)
), gold AS (SELECT question_id, chunk_id FROM rated WHERE rank <= 5 AND s > 2), cited AS (SELECT question_id, chunk_id FROM rated WHERE rank <= 3),
sizes AS (
  SELECT q.question_id, q.category, (SELECT count(*) FROM gold g WHERE g.question_id = q.question_id) AS gold, (SELECT count(*) FROM fused f WHERE f.question_id = q.question_id) AS got,
    (SELECT count(*) FROM cited c WHERE c.question_id = q.question_id) AS cited FROM questions q
), hits AS (
  SELECT question_id, count(*) AS n, min(rank) AS first, sum(1 / log2(rank + 1)) AS gain FROM fused JOIN gold USING (question_id, chunk_id) GROUP BY question_id
), seen AS (SELECT question_id, count(*) AS n FROM cited JOIN fused USING (question_id, chunk_id) GROUP BY question_id),
right_ AS (SELECT question_id, count(*) AS n FROM cited JOIN gold USING (question_id, chunk_id) GROUP BY question_id), measured AS (
  SELECT question_id, category, CASE WHEN gold = 0 THEN NULL WHEN got = 0 THEN 0.0 ELSE round(coalesce(h.n, 0) / got, 6) END AS precision,
    CASE WHEN gold > 0 THEN round(coalesce(h.n, 0) / gold, 6) END AS recall, CASE WHEN gold > 0 THEN round(coalesce(1.0 / first, 0), 6) END AS reciprocal_rank,
    CASE WHEN gold > 0 THEN round(coalesce(gain, 0) / list_sum(list_transform(range(1, 1 + least(gold, 10)), lambda i: 1 / log2(i + 1))), 6) END AS ndcg,
    CASE WHEN cited = 0 THEN 0.0 ELSE round(coalesce(s.n, 0) / cited, 6) END AS citation_validity, CASE WHEN gold > 0 THEN round(coalesce(r.n, 0) / gold, 6) END AS citation_recall
  FROM sizes LEFT JOIN hits h USING (question_id) LEFT JOIN seen s USING (question_id) LEFT JOIN right_ r USING (question_id)
)"""

SOME = r"""regexp_matches(CAST({0} AS VARCHAR), '[:\[]\s*("|true|false|-?[0-9])|null\s*,\s*"[^"]*"\s*[,\]]')"""
NESTED = f"""src AS (
  SELECT record_id, to_json(locations) AS l, to_json(best_oa_location) AS b, to_json(open_access) AS o, to_json(abstract_inverted_index) AS a FROM works
  UNION ALL SELECT record_id, json_extract(payload, '$.locations'), json_extract(payload, '$.best_oa_location'), json_extract(payload, '$.open_access'), json_extract(payload, '$.abstract_inverted_index')
  FROM raw_lines WHERE feed = 'works' AND json_valid(payload)
), places AS (
  SELECT record_id, unnest(range(0, len(ls))) AS pos, unnest(ls) AS item FROM (
    SELECT record_id, CASE json_type(l) WHEN 'ARRAY' THEN json_extract(l, '$[*]') WHEN 'OBJECT' THEN [l] END AS ls FROM src)
), inner_ AS (
  SELECT record_id, 'locations_issn' AS child, pos, unnest(range(0, len(v))) AS sub_pos, unnest(v) AS x FROM (SELECT record_id, pos, json_extract(item, '$.source.issn[*]') AS v FROM places)
  UNION ALL SELECT record_id, 'locations_lineage', pos, unnest(range(0, len(v))), unnest(v) FROM (SELECT record_id, pos, json_extract(item, '$.source.host.lineage[*]') AS v FROM places)
), words AS (
  SELECT DISTINCT record_id, TRY_CAST(CAST(p AS VARCHAR) AS INT) AS pos FROM (SELECT record_id, unnest(json_extract(v, '$[*]')) AS p FROM (SELECT record_id, unnest(json_extract(a, '$.*')) AS v FROM src))
)"""

OCTETS = ", ".join(f"TRY_CAST(regexp_extract(host, '^(0|[1-9]\\d{{0,2}})\\.(0|[1-9]\\d{{0,2}})\\.(0|[1-9]\\d{{0,2}})\\.(0|[1-9]\\d{{0,2}})$', {k}) AS INT) AS o{k}" for k in range(1, 5))
# by the first octets of an address, where the query compares its number; addresses in brackets are left to the tests
CLOSED = """o1 IN (0, 10, 127) OR o1 >= 224 OR (o1 = 100 AND o2 BETWEEN 64 AND 127) OR (o1 = 169 AND o2 = 254) OR (o1 = 172 AND o2 BETWEEN 16 AND 31) OR (o1 = 192 AND o2 = 168)
  OR (o1 = 192 AND o2 = 0 AND (o3 = 2 OR (o3 = 0 AND o4 NOT IN (9, 10)))) OR (o1 = 198 AND (o2 IN (18, 19) OR (o2 = 51 AND o3 = 100))) OR (o1 = 203 AND o2 = 0 AND o3 = 113)"""
SAFE = f"""starts_with(lower(trim(url)), 'http') AND CASE WHEN greatest(o1, o2, o3, o4) <= 255 AND o4 IS NOT NULL THEN NOT ({CLOSED}) ELSE host NOT IN ('localhost', 'localhost.localdomain') AND NOT ends_with(host, '.local') END"""
FULL_DATES = f"""dates AS (
  SELECT work_id, arg_max(publication_date, record_id) AS publication_date FROM (SELECT {work_id('id')} AS work_id, publication_date, record_id FROM works)
  WHERE regexp_matches(publication_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}$') AND work_id <> '' GROUP BY work_id
)"""


TOP = f"{LISTS}, {_fuse('chunk_id', 10)}"
NAMES = "['dense_score', 'sparse_score', 'rerank_score']"
# records of runs, the last of each and whether it is done
LAST_RUNS = f"""r AS (
  SELECT DISTINCT array_to_string(sources, '+') AS run, question_id, cand_id, chunk_id AS answer, loaded_at >= retrieved_at + INTERVAL 1 DAY AS late, dense_score IS NULL AND sparse_score IS NULL AND rerank_score IS NULL AS bare,
    list_filter([CASE WHEN isnan(dense_score) THEN 'dense_score' END, CASE WHEN isnan(sparse_score) THEN 'sparse_score' END, CASE WHEN isnan(rerank_score) THEN 'rerank_score' END], lambda n: n IS NOT NULL) AS bad,
    coalesce(NOT isnan(dense_score), false) OR coalesce(NOT isnan(sparse_score), false) OR coalesce(NOT isnan(rerank_score), false) AS scored
  FROM candidates
), n AS (SELECT *, row_number() OVER (PARTITION BY run, question_id ORDER BY cand_id DESC) AS back, min(cand_id) OVER (PARTITION BY run, question_id) AS first_place FROM r), last AS (
  SELECT *, NOT coalesce(late, false) AND trim(coalesce(answer, '')) <> '' AS fine FROM n WHERE back = 1
), states AS (
  SELECT run, question_id, cand_id, first_place, CASE WHEN NOT fine THEN '' WHEN bare THEN array_to_string({NAMES}, '|') ELSE array_to_string(bad, '|') END AS missing,
    NOT coalesce(late, false) AND NOT (fine AND (bare OR (len(bad) > 0 AND NOT scored))) AS completed FROM last
)"""


def _files() -> str:
    """Files of works and papers, and the one chosen of each side."""
    return f"""w AS (SELECT record_id, {found_id('upper(id)')} AS work, locations FROM works),
    pf AS (SELECT work, l.pdf_url AS path, bool_or(coalesce(l.is_oa, false)) AS ok FROM (SELECT work, unnest(locations) AS l FROM w) WHERE l.pdf_url IS NOT NULL GROUP BY ALL),
    xf AS (SELECT {found_id("list_extract(string_split(source_path, '/'), -1)")} AS work, source_path AS path, CASE source_format WHEN 'jats_xml' THEN 'jats' WHEN 'grobid_tei' THEN 'tei' END AS kind, bool_or(coalesce(character_count, 0) > 0) AS ok
      FROM parsed_papers WHERE source_path IS NOT NULL GROUP BY ALL),
    pc AS (SELECT DISTINCT ON (work) work, path, ok FROM pf WHERE work IS NOT NULL ORDER BY work, ok DESC, path),
    xc AS (SELECT DISTINCT ON (work) work, path, kind, ok FROM xf WHERE work IS NOT NULL ORDER BY work, CASE WHEN ok AND kind = 'jats' THEN 0 WHEN ok AND kind = 'tei' THEN 1 ELSE 2 END, path),
    chosen AS (SELECT record_id, w.work, pc.path AS pdf_path, coalesce(pc.ok, false) AS pdf_valid, CASE WHEN pc.path IS NULL THEN 'missing' WHEN pc.ok THEN 'valid' ELSE 'closed' END AS pdf_reason,
      xc.path AS xml_path, xc.kind AS xml_kind, coalesce(xc.ok, false) AS xml_valid, CASE WHEN xc.path IS NULL THEN 'missing' WHEN xc.ok THEN 'valid' ELSE 'no text' END AS xml_reason,
      CASE WHEN pc.ok AND xc.ok THEN 'pdf and xml' WHEN pc.ok THEN 'pdf' WHEN xc.ok THEN xc.kind ELSE 'missing' END AS content
      FROM w LEFT JOIN pc ON pc.work = w.work LEFT JOIN xc ON xc.work = w.work)"""


def oracle_sql() -> dict[str, str]:
    begin, end, days = WINDOW
    vec = "list_transform(embedding, lambda x: CAST(x AS DOUBLE))"
    found = {
        "p3_found": f"""WITH {NESTED} SELECT record_id, 'locations' AS child, CAST(pos AS INT) AS pos, -1 AS sub_pos FROM places WHERE {SOME.format('item')}
            UNION ALL SELECT record_id, child, CAST(pos AS INT), CAST(sub_pos AS INT) FROM inner_ WHERE json_type(x) <> 'NULL'
            UNION ALL SELECT record_id, 'best_oa_location', 0, -1 FROM src WHERE {SOME.format('b')} UNION ALL SELECT record_id, 'open_access', 0, -1 FROM src WHERE {SOME.format('o')}
            UNION ALL SELECT record_id, 'abstract_word', pos, -1 FROM words WHERE pos >= 0""",
        "p3_locations": f"""WITH {NESTED} SELECT record_id, CAST(pos AS INT) AS pos, {_leaves('item', LOCATION)} FROM places WHERE {SOME.format('item')}""",
        "p3_best_oa_location": f"""WITH {NESTED} SELECT record_id, {_leaves('b', LOCATION)} FROM src WHERE {SOME.format('b')}""",
        "p3_open_access": f"""WITH {NESTED} SELECT record_id, {_leaves('o', ["is_oa", "oa_status", "oa_url", "any_repository_has_fulltext"])} FROM src WHERE {SOME.format('o')}""",
        "p3_issn": f"""WITH {NESTED} SELECT record_id, CAST(pos AS INT) AS pos, CAST(sub_pos AS INT) AS sub_pos, x ->> '$' AS issn FROM inner_ WHERE child = 'locations_issn' AND json_type(x) <> 'NULL'""",
        "p3_lineage": f"""WITH {NESTED} SELECT record_id, CAST(pos AS INT) AS pos, CAST(sub_pos AS INT) AS sub_pos, x ->> '$' AS lineage FROM inner_ WHERE child = 'locations_lineage' AND json_type(x) <> 'NULL'""",
        "p3_abstract_words": f"""WITH {NESTED}, named AS (SELECT record_id, unnest(json_keys(a)) AS word, a FROM src WHERE json_type(a) = 'OBJECT'),
            at_ AS (SELECT record_id, word, unnest(json_extract(list_extract(map_values(CAST(a AS MAP(VARCHAR, JSON))), list_position(map_keys(CAST(a AS MAP(VARCHAR, JSON))), word)), '$[*]')) AS p FROM named)
            SELECT record_id, TRY_CAST(CAST(p AS VARCHAR) AS INT) AS pos, min(word) AS word FROM at_ WHERE TRY_CAST(CAST(p AS VARCHAR) AS INT) >= 0 GROUP BY ALL""",
        "token_counts": f"SELECT doc_id, {counted('text')} AS tokens, length(text) AS characters, md5({squeezed('text')}) AS squeezed FROM documents",
        "last_tokens": f"""SELECT doc_id, md5(CASE WHEN text IS NULL THEN NULL WHEN len(p) = 0 THEN '' ELSE trim(array_to_string(p[greatest(len(p) - 49, 1):], '')) END) AS tail
            FROM (SELECT doc_id, text, regexp_extract_all(text, '(?:{TOKEN})[{SPACE}]*') AS p FROM documents)""",
        "work_identifiers": f"""SELECT record_id, {work_id('id')} AS work_id, {found_id('id')} AS found_id,
            trim(regexp_replace(lower(trim(coalesce(doi, ''))), '^(https?://(dx\\.)?doi\\.[a-z]+/|doi:)', '')) AS doi,
            lower(list_extract(string_split(regexp_replace(trim(coalesce(id, '')), '/+$', ''), '/'), -1)) AS identifier,
            CASE WHEN publication_year BETWEEN 1900 AND 2100 THEN CAST(publication_year AS BIGINT) END AS year,
            TRY_CAST(nullif(regexp_extract(publication_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS DATE) AS published FROM works""",
        "abstracts": f"WITH {ABSTRACT} SELECT * FROM abstract_of",
        "paper_texts": """WITH parts AS (
              SELECT record_id, list_concat([coalesce(trim(title, ' '), ''), coalesce(trim(abstract, ' '), '')],
                flatten(coalesce(list_transform(sections, lambda s: [coalesce(trim(s.heading, ' '), ''), coalesce(trim(s.text, ' '), '')]), []))) AS p FROM parsed_papers
            ), whole AS (SELECT record_id, array_to_string(list_filter(p, lambda x: x <> ''), chr(10) || chr(10)) AS w FROM parts)
            SELECT record_id, md5(w) AS whole, length(w) AS characters, length(w) >= 500 AS usable FROM whole""",
        "encoder_texts": f"""WITH {CHUNKS}, t AS (
              SELECT vector_id, concat_ws(chr(10), CASE WHEN trim(title, ' ') <> '' THEN 'Paper: ' || trim(title, ' ') END, CASE WHEN trim(section_heading, ' ') <> '' THEN 'Section: ' || trim(section_heading, ' ') END, trim(text, ' ')) AS e FROM docs)
            SELECT vector_id, md5(e) AS encoded FROM t""",
        "open_pdf_urls": """WITH u AS (
              SELECT record_id, 0 AS k, best_oa_location.pdf_url AS url FROM works WHERE best_oa_location.is_oa IS DISTINCT FROM false
              UNION ALL SELECT record_id, generate_subscripts(locations, 1), unnest(list_transform(locations, lambda l: CASE WHEN l.is_oa THEN l.pdf_url END)) FROM works
            ), f AS (SELECT record_id, url, min(k) AS k FROM u WHERE url IS NOT NULL AND trim(url) <> '' GROUP BY ALL)
            SELECT record_id, coalesce(string_agg(url, ' ' ORDER BY k), '') AS urls, count(url) AS n FROM works LEFT JOIN f USING (record_id) GROUP BY record_id""",
        "url_hosts": f"""WITH u AS (
              SELECT unnest([l.landing_page_url, l.pdf_url]) AS url FROM (SELECT unnest(locations) AS l FROM works)
            ), h AS (SELECT url, nullif(regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1), '') AS host FROM u WHERE url IS NOT NULL), o AS (SELECT *, {OCTETS} FROM h)
            SELECT host, count(*) AS urls, count(*) FILTER ({SAFE}) AS safe FROM o GROUP BY host""",
        "date_windows": f"""WITH {CHUNKS}, d AS (
              SELECT paper_id, publication_year AS y, TRY_CAST(nullif(regexp_extract(publication_date, '^\\d{{4}}-\\d{{2}}-\\d{{2}}'), '') AS DATE) AS day FROM docs)
            SELECT paper_id, count(*) AS chunks, count(*) FILTER (CASE WHEN day IS NOT NULL THEN day BETWEEN DATE '{begin}' AND DATE '{end}' ELSE {days >= 365} AND y BETWEEN {begin[:4]} AND {end[:4]} END) AS in_window
            FROM d GROUP BY paper_id""",
        "section_profile": f"""WITH s AS (SELECT unnest(sections) AS s FROM parsed_papers)
            SELECT {section_type('s.heading')} AS by_heading, s.section_type AS section_type, count(*) AS sections, CAST(sum({counted('s.text')}) AS BIGINT) AS tokens FROM s GROUP BY ALL""",
        "window_chunks": f"""WITH p AS (SELECT doc_id, regexp_extract_all(text, '(?:{TOKEN})[{SPACE}]*') AS p FROM documents),
            w AS (SELECT doc_id, p, unnest(range(0, 1 + CAST(greatest(ceil((len(p) - 300) / 250.0), 0) AS BIGINT))) AS chunk_index FROM p WHERE len(p) > 0)
            SELECT doc_id, chunk_index, md5(regexp_replace(array_to_string(p[chunk_index * 250 + 1 : chunk_index * 250 + 300], ''), '[{SPACE}]+$', '')) AS piece FROM w""",
        "chunk_report": """SELECT count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens, CAST(min(token_count) AS BIGINT) AS least, CAST(max(token_count) AS BIGINT) AS most, round(avg(token_count), 6) AS mean,
            count(*) FILTER (section_type = 'abstract') AS abstract_chunks, count(*) FILTER (section_type IS DISTINCT FROM 'abstract') AS body_chunks, count(*) FILTER (token_count < 40) AS small_chunks,
            count(DISTINCT paper_id) AS papers, count(chunk_id) - count(DISTINCT chunk_id) AS repeated_ids FROM chunks""",
        "chunk_profile": f"WITH {CHUNKS} SELECT section_type, source_format, count(*) AS chunks, CAST(sum(token_count) AS BIGINT) AS tokens FROM docs GROUP BY ALL",
        "parsed_xml": f"""WITH s AS (
              SELECT record_id, k, {squeezed('s.text')} AS text, CASE WHEN {squeezed("coalesce(s.heading, '')")} = '' THEN 'Untitled section' ELSE {squeezed('s.heading')} END AS heading
              FROM (SELECT record_id, generate_subscripts(sections, 1) AS k, unnest(sections) AS s FROM parsed_papers))
            SELECT record_id, row_number() OVER (PARTITION BY record_id ORDER BY k) AS section_order, {section_type('heading')} AS section_type, md5(text) AS text FROM s WHERE text <> ''""",
        "discovery_dedup": f"""WITH w AS (SELECT nullif({work_id('id')}, '') AS work_id, record_id, matched_queries FROM works), q AS (
              SELECT work_id, q, min((record_id, k)) AS spot FROM (SELECT work_id, record_id, generate_subscripts(matched_queries, 1) AS k, unnest(matched_queries) AS q FROM w) WHERE work_id IS NOT NULL GROUP BY ALL
            ), l AS (SELECT work_id, string_agg(q, '|' ORDER BY spot) AS queries, count(*) AS n FROM q GROUP BY work_id),
            f AS (SELECT work_id, min(record_id) AS first_record FROM w WHERE work_id IS NOT NULL GROUP BY work_id)
            SELECT work_id, first_record, coalesce(queries, '') AS queries, coalesce(n, 0) AS n FROM f LEFT JOIN l USING (work_id)""",
        "latest_candidates": """SELECT question_id, chunk_id, cand_id, loaded_at FROM (
              SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY loaded_at DESC NULLS LAST, cand_id DESC) AS r FROM candidates) WHERE r = 1""",
        "parsed_union": f"""SELECT work_id, record_id, source_format FROM (
              SELECT *, row_number() OVER (PARTITION BY work_id ORDER BY source_format <> 'jats_xml', record_id) AS r FROM (
                SELECT {found_id('upper(paper_id)')} AS work_id, record_id, source_format FROM parsed_papers WHERE source_format IN ('jats_xml', 'grobid_tei'))
              WHERE work_id IS NOT NULL) WHERE r = 1""",
        "numbered_chunks": "SELECT chunk_id, row_number() OVER (ORDER BY chunk_id) - 1 AS number FROM (SELECT DISTINCT chunk_id FROM chunks)",
        "paper_dates": f"WITH {FULL_DATES} SELECT * FROM dates",
        "dated_chunks": f"WITH {CHUNKS}, {FULL_DATES} SELECT vector_id, coalesce(d.publication_date, k.publication_date) AS publication_date FROM docs d LEFT JOIN dates k ON d.paper_id = k.work_id",
        "coverage": f"""WITH k AS (
              SELECT DISTINCT 'works' AS side, {found_id('upper(id)')} AS k FROM works UNION SELECT 'parsed', {found_id('upper(paper_id)')} FROM parsed_papers UNION SELECT 'chunked', {found_id('upper(paper_id)')} FROM chunks
            ), w AS (SELECT k, string_agg(side, '+' ORDER BY side) AS present_in FROM k WHERE k IS NOT NULL GROUP BY k)
            SELECT present_in, count(*) AS keys FROM w GROUP BY present_in""",
        "repaired_ids": """WITH g AS (SELECT DISTINCT left(chunk_id, 26) AS given FROM candidates WHERE chunk_id IS NOT NULL), k AS (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL),
            n AS (SELECT given, min(chunk_id) AS one FROM g JOIN k ON left(given, 22) = left(chunk_id, 22) AND (starts_with(chunk_id, given) OR starts_with(given, chunk_id))
              WHERE length(given) >= 22 AND length(chunk_id) >= 22 GROUP BY given HAVING count(*) = 1)
            SELECT given, coalesce(k.chunk_id, one) AS chunk_id FROM g LEFT JOIN k ON given = k.chunk_id LEFT JOIN n USING (given)""",
        "screening": """WITH l AS (SELECT doc_id, lower(trim(label)) AS label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY labelled_at DESC NULLS LAST, label_id DESC) AS r FROM doc_labels) WHERE r = 1)
            SELECT source, coalesce(label, 'open') AS decision, count(*) AS documents FROM documents LEFT JOIN l USING (doc_id) GROUP BY ALL""",
        "remaining_chunks": f"SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NULL OR chunk_id NOT IN (SELECT chunk_id FROM chunks WHERE indexed_at < TIMESTAMP '{CUTOFF}' AND chunk_id IS NOT NULL)",
        "relevance_scores": f"WITH {_scored()} SELECT record_id, score, array_to_string(fails, '|') AS fails FROM scored",
        "failure_counts": f"WITH {_scored()} SELECT reason, count(*) AS works FROM (SELECT unnest(fails) AS reason FROM scored) GROUP BY reason",
        "score_histogram": f"WITH {_scored()} SELECT score, count(*) AS works, count(*) FILTER (len(fails) > 0) AS failing FROM scored GROUP BY score",
        "selection_decisions": f"""WITH {_scored()} SELECT record_id, score, array_to_string(tt, '|') AS title_terms, array_to_string(at_, '|') AS abstract_terms, array_to_string(mt, '|') AS metadata_terms,
            array_to_string(pt, '|') AS penalty_terms, CASE WHEN coalesce(is_retracted, false) OR trim(coalesce(title, '')) = '' OR score < 4 THEN 'rejected' WHEN score < 8 THEN 'ambiguous' ELSE 'retained' END AS decision FROM scored""",
        "best_works": f"""WITH {_scored()}, r AS (SELECT publication_year, record_id, score, row_number() OVER (PARTITION BY publication_year
              ORDER BY score DESC, coalesce(has_content.grobid_xml, false) DESC, coalesce(cited_by_count, 0) DESC, record_id) AS rank FROM scored) SELECT * FROM r WHERE rank <= 10""",
        "discovery_report": """WITH r AS (SELECT 'year' AS kind, CAST(publication_year AS VARCHAR) AS key FROM works UNION ALL SELECT 'query', unnest(matched_queries) FROM works
              UNION ALL SELECT 'topic', unnest(topics).display_name FROM works)
            SELECT kind, key, count(*) AS works FROM r WHERE key IS NOT NULL GROUP BY ALL""",
        "audit_counts": f"""WITH w AS (SELECT *, {found_id('upper(id)')} AS work_id, coalesce(has_content.pdf, false) AS p, coalesce(has_content.grobid_xml, false) AS x FROM works)
            SELECT count(*) AS records, count(DISTINCT work_id) AS works, count(*) FILTER (work_id IS NULL) AS without_id, count(*) FILTER (trim(doi) <> '') AS with_doi, count(*) FILTER (p AND NOT x) AS pdf_only,
              count(*) FILTER (x AND NOT p) AS xml_only, count(*) FILTER (p AND x) AS both, count(*) FILTER (NOT p AND NOT x) AS neither, count(work_id) - count(DISTINCT work_id) AS repeated,
              count(*) FILTER (is_retracted) AS retracted FROM w""",
        "index_terms": f"""WITH {CHUNKS}, t AS (SELECT DISTINCT vector_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM docs)
            SELECT term, count(*) AS chunks FROM t GROUP BY term ORDER BY chunks DESC, term LIMIT 100""",
        "event_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
        "ingested_lines": """SELECT feed, coalesce(json_valid(payload) AND TRY(json_type(payload)) = 'OBJECT', false) AS valid, count(*) AS lines, CAST(sum(length(payload)) AS BIGINT) AS characters FROM raw_lines GROUP BY ALL""",
        "bm25_topk": f"WITH {BM25} SELECT question_id, vector_id, score, rank FROM sparse",
        "nearest_vectors": f"""WITH v AS (SELECT DISTINCT ON (vec_id) vec_id, {vec} AS e FROM embeddings), s AS (
              SELECT a.vec_id AS query_id, b.vec_id AS vec_id, round(list_cosine_similarity(a.e, b.e), 9) AS c FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id),
            r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY c DESC, vec_id) AS rank FROM s)
            SELECT query_id, vec_id, round(c, 6) AS cosine, rank FROM r WHERE rank <= 10""",
        "hybrid_search": f"""WITH {BM25}, usable AS (
              SELECT vector_id, {vec} AS e FROM docs WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
            ), asked_v AS (
              SELECT question_id, list(x ORDER BY spot) AS q FROM (
                SELECT question_id, spot, avg(x) AS x FROM (SELECT question_id, generate_subscripts(e, 1) AS spot, unnest(e) AS x FROM sparse JOIN usable USING (vector_id) WHERE rank <= 5) GROUP BY ALL
              ) GROUP BY question_id
            ), near AS (SELECT question_id, vector_id, round(list_cosine_similarity(q, e), 9) AS c FROM asked_v, usable),
            dense AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY c DESC, vector_id) AS rank FROM near) WHERE rank <= 50),
            {_fuse('vector_id', 30)}, few AS (
              SELECT * FROM (SELECT f.*, d.paper_id, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY f.rank) AS r FROM fused f JOIN docs d USING (vector_id)) WHERE r <= 2
            ), last AS (SELECT question_id, vector_id, paper_id, score, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM few)
            SELECT * FROM last WHERE rank <= 10""",
        "corrected_search": f"""WITH {BM25}, {_bm25_round('terms', 'first_')}, seen AS (
              SELECT DISTINCT question_id, unnest(regexp_extract_all(lower(text), '{WORD}')) AS term FROM first_ JOIN docs USING (vector_id) WHERE rank <= 5
            ), weak AS (
              SELECT question_id FROM (SELECT question_id, count(*) AS terms, count(s.term) AS met FROM terms t LEFT JOIN seen s USING (question_id, term) GROUP BY question_id) WHERE met < 0.8 * terms
            ), again AS (SELECT question_id, concat_ws(' ', question, title) AS query FROM questions JOIN weak USING (question_id) JOIN first_ f USING (question_id) JOIN docs USING (vector_id) WHERE f.rank = 1),
            {_terms('again', 'query', 'more')}, {_bm25_round('more', 'second_')},
            both_ AS (SELECT question_id, vector_id, 1 AS round, rank FROM first_ UNION ALL SELECT question_id, vector_id, 2, rank FROM second_),
            once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, vector_id ORDER BY round DESC, rank) AS r FROM both_) WHERE r = 1),
            last AS (SELECT question_id, vector_id, CAST(round AS BIGINT) AS round, row_number() OVER (PARTITION BY question_id ORDER BY round DESC, rank, vector_id) AS rank FROM once)
            SELECT * FROM last WHERE rank <= 12""",
        "fused_candidates": f"WITH {LISTS}, {_fuse('chunk_id', 30)} SELECT question_id, chunk_id, score, dense_rank, sparse_rank, rank FROM fused",
        "capped_candidates": f"""WITH {LISTS}, {_fuse('chunk_id', 30)}, papers AS (SELECT chunk_id, min(paper_id) AS paper_id FROM candidates GROUP BY chunk_id),
            few AS (SELECT * FROM (SELECT f.*, p.paper_id, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY rank) AS r FROM fused f JOIN papers p USING (chunk_id)) WHERE r <= 2),
            last AS (SELECT question_id, chunk_id, paper_id, row_number() OVER (PARTITION BY question_id ORDER BY rank) AS rank FROM few) SELECT * FROM last WHERE rank <= 10""",
        "merged_evidence": f"""WITH {LISTS}, both_ AS (SELECT question_id, chunk_id, 0 AS side, rank, CAST(rank > 6 AS INT) AS tier FROM dense UNION ALL SELECT question_id, chunk_id, 1, rank, CAST(rank > 6 AS INT) FROM sparse),
            once AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY question_id, chunk_id ORDER BY tier, side, rank) AS r FROM both_) WHERE r = 1),
            last AS (SELECT question_id, chunk_id, row_number() OVER (PARTITION BY question_id ORDER BY tier, side, rank) AS rank FROM once) SELECT * FROM last WHERE rank <= 12""",
        "rank_metrics": f"WITH {JUDGED} SELECT * FROM measured",
        "evaluation_report": f"""WITH {JUDGED} SELECT category, count(*) AS questions, count(recall) AS judged, round(avg(precision), 5) AS precision, round(avg(recall), 5) AS recall, round(avg(reciprocal_rank), 5) AS reciprocal_rank,
            round(avg(ndcg), 5) AS ndcg, round(avg(CASE WHEN recall > 0 THEN 1.0 ELSE 0.0 END), 5) AS success FROM measured GROUP BY category""",
        "evidence_routes": f"""WITH {CHUNKS}, {LISTS}, {_fuse('chunk_id', 10)}, {_terms('questions', 'question', 'terms')}, texts AS (SELECT chunk_id, regexp_extract_all(lower(min(text)), '{WORD}') AS ws FROM docs GROUP BY chunk_id),
            scored AS (SELECT question_id, chunk_id, avg(CASE WHEN list_contains(ws, term) THEN 1.0 ELSE 0.0 END) AS s FROM fused JOIN texts USING (chunk_id) JOIN terms USING (question_id) GROUP BY ALL)
            SELECT question_id, CASE WHEN max(s) >= 0.8 THEN 'correct' WHEN max(s) >= 0.4 THEN 'ambiguous' ELSE 'incorrect' END AS route, count(*) AS documents, count(*) FILTER (s >= 0.4) AS useful FROM scored GROUP BY question_id""",
        "evidence_contexts": f"""WITH {CHUNKS}, {LISTS}, {_fuse('chunk_id', 10)}, texts AS (SELECT chunk_id, min(title) AS title, min(section_heading) AS heading, trim(min(text), ' ') AS text FROM docs GROUP BY chunk_id),
            shown AS (SELECT question_id, rank, concat_ws(chr(10), 'Document ' || rank, CASE WHEN trim(title, ' ') <> '' THEN 'Title: ' || trim(title, ' ') END, CASE WHEN trim(heading, ' ') <> '' THEN 'Section: ' || trim(heading, ' ') END,
              CASE WHEN length(text) > 2400 THEN rtrim(left(text, 2400), ' ') || '...' ELSE text END) AS s FROM fused JOIN texts USING (chunk_id)),
            joined AS (SELECT question_id, string_agg(s, chr(10) || '---' || chr(10) ORDER BY rank) AS c FROM shown GROUP BY question_id)
            SELECT question_id, md5(c) AS context, length(c) AS characters FROM joined""",
        "keyword_coverage": f"""WITH {CHUNKS}, {LISTS}, {_fuse('chunk_id', 10)}, asked AS (
              SELECT DISTINCT question_id, unnest(list_filter(regexp_extract_all(lower(reference_answer), '{WORD}'), lambda w: length(w) >= 9)) AS word FROM questions
            ), texts AS (SELECT chunk_id, min(text) AS text FROM docs GROUP BY chunk_id), top_ AS (SELECT question_id, text FROM fused JOIN texts USING (chunk_id)),
            each AS (SELECT question_id, word, max(CASE WHEN list_contains(regexp_extract_all(lower(text), '{WORD}'), word) THEN 1 ELSE 0 END) AS hit FROM asked JOIN top_ USING (question_id) GROUP BY ALL)
            SELECT question_id, count(*) AS words, round(avg(hit), 6) AS coverage FROM each GROUP BY question_id""",
        "answer_scores": f"""WITH {CHUNKS}, {LISTS}, {_fuse('chunk_id', 1)}, {_terms('questions', 'question', 'terms')}, texts AS (SELECT chunk_id, min(text) AS text FROM docs GROUP BY chunk_id),
            top_ AS (SELECT question_id, text, regexp_extract_all(lower(text), '{WORD}') AS ws FROM fused JOIN texts USING (chunk_id)),
            req AS (SELECT question_id, list(term) AS required FROM terms GROUP BY question_id),
            rows_ AS (SELECT q.question_id, category, text, coalesce(ws, []) AS ws, coalesce(required, []) AS required, coalesce(list_distinct(list_filter(regexp_extract_all(lower(reference_answer), '{WORD}'), lambda w: length(w) >= 9)), []) AS forbidden
              FROM questions q LEFT JOIN top_ USING (question_id) LEFT JOIN req USING (question_id)),
            met AS (SELECT *, len(list_filter(required, lambda w: list_contains(ws, w))) AS has, len(list_filter(forbidden, lambda w: list_contains(ws, w))) AS bad FROM rows_),
            stated AS (SELECT *, CASE WHEN text IS NULL THEN 'failed' WHEN len(required) > 0 AND has / len(required) > 0.1 THEN 'accepted' ELSE 'insufficient_evidence' END AS status FROM met)
            SELECT question_id, status, CASE WHEN len(required) + len(forbidden) > 0 THEN round((has + len(forbidden) - bad) / (len(required) + len(forbidden)), 6) END AS keyword_coverage,
              (CASE WHEN (text IS NOT NULL) = (category <> 'unanswerable') THEN 0.5 ELSE 0 END + CASE WHEN (has = 0) = (category = 'time_bound') THEN 0.5 ELSE 0 END)::DOUBLE AS route_accuracy,
              CASE WHEN trim(coalesce(text, '')) <> '' AND CASE WHEN category = 'unanswerable' THEN status = 'insufficient_evidence' ELSE status = 'accepted' OR (category = 'multi_hop' AND status = 'insufficient_evidence') END THEN 1.0 ELSE 0.0 END::DOUBLE AS success
            FROM stated""",
        "candidate_reviews": """WITH l AS (SELECT CASE WHEN isnan(rerank_score) THEN NULL WHEN rerank_score >= 2 THEN 'relevant' WHEN rerank_score >= 0 THEN 'ambiguous' WHEN rerank_score < 0 THEN 'irrelevant' END AS label,
              CASE WHEN NOT isnan(dense_score) THEN dense_score END AS s FROM candidates)
            SELECT label, coalesce(CASE label WHEN 'relevant' THEN s >= 0.8 WHEN 'ambiguous' THEN s >= 0.4 AND s < 0.8 WHEN 'irrelevant' THEN s < 0.4 END, false) AS fits,
              CASE WHEN label = 'relevant' AND s >= 0.8 THEN 'accepted' WHEN label = 'irrelevant' AND s <= 0.39 THEN 'rejected' ELSE 'needs_review' END AS route, count(*) AS candidates FROM l GROUP BY ALL""",
        "corpus_status": f"""WITH a AS (SELECT DISTINCT {found_id('upper(id)')} AS k FROM works), g AS (SELECT DISTINCT {found_id('upper(paper_id)')} AS k FROM parsed_papers), s AS (SELECT DISTINCT {found_id('upper(paper_id)')} AS k FROM chunks),
            h AS (SELECT DISTINCT {found_id('upper(paper_id)')} AS k FROM documents), every AS (SELECT k FROM a UNION SELECT k FROM g UNION SELECT k FROM s UNION SELECT k FROM h),
            f AS (SELECT k, k IN (SELECT k FROM a WHERE k IS NOT NULL) AS a, k IN (SELECT k FROM g WHERE k IS NOT NULL) AS g, k IN (SELECT k FROM s WHERE k IS NOT NULL) AS s, k IN (SELECT k FROM h WHERE k IS NOT NULL) AS h FROM every WHERE k IS NOT NULL),
            c AS (SELECT count(*) FILTER (a) AS ambiguous_candidates, count(*) FILTER (a AND g) AS ambiguous_graded, count(*) FILTER (a AND s) AS ambiguous_screened, count(*) FILTER (h) AS screening_shortlist,
              count(*) FILTER (h AND g) AS shortlist_graded, count(*) FILTER (h AND NOT g) AS deferred_review, count(*) FILTER (a AND NOT g AND NOT s) = 0 AS screening_complete FROM f)
            SELECT *, deferred_review = 0 AS shortlist_grading_complete, CASE WHEN NOT screening_complete THEN 'provisional' WHEN deferred_review = 0 THEN 'complete' ELSE 'complete_with_deferred_review' END AS status FROM c""",
        "question_signs": f"""WITH {JUDGED}, ids AS (SELECT question_id, list(chunk_id ORDER BY rank) AS cited FROM rated WHERE rank <= 3 GROUP BY question_id),
            q AS (SELECT question_id, question, coalesce(reference_answer, '') AS answer, coalesce(cited, []) AS cited FROM questions LEFT JOIN ids USING (question_id))
            SELECT question_id, regexp_matches(question, '{RECENCY}') AS recent,
              md5(concat_ws(' ', answer, nullif(array_to_string(list_transform(list_filter(cited, lambda c: NOT contains(answer, '[' || c || ']')), lambda c: '[' || c || ']'), ' '), ''))) AS answer,
              'none' AS unknown, array_to_string(list_filter([1, 0], lambda i: i < len(cited)), '|') AS indexes FROM q""",
        "paper_identities": """WITH r AS (SELECT record_id, id AS a, CAST(NULL AS VARCHAR) AS b, doi, title, best_oa_location.pdf_url AS url FROM works UNION ALL SELECT record_id, NULL, paper_id, doi, title, source_path FROM parsed_papers)
            SELECT record_id, coalesce(nullif(trim(a), ''), nullif(trim(b), ''), nullif(trim(regexp_replace(lower(trim(coalesce(doi, ''))), '^(https?://(dx\\.)?doi\\.[a-z]+/|doi:)', '')), ''),
              'title:' || regexp_replace(lower(nullif(trim(title), '')), '\\s+', ' ', 'g')) AS identity, coalesce(url, '') || '?api_key=REDACTED&x=1' AS address, 'PMC' || record_id AS pmc FROM r""",
        "reranked_search": f"""WITH {CHUNKS}, {LISTS}, {_fuse('chunk_id', 30)}, {_terms('questions', 'question', 'terms')}, texts AS (SELECT chunk_id, min(title) AS t, min(section_heading) AS h, min(text) AS x FROM docs GROUP BY chunk_id),
            papers AS (SELECT chunk_id, min(paper_id) AS paper_id FROM candidates GROUP BY chunk_id),
            read_ AS (SELECT chunk_id, x, regexp_extract_all(lower(concat_ws(chr(10), CASE WHEN trim(t, ' ') <> '' THEN 'Paper: ' || t END, CASE WHEN trim(h, ' ') <> '' THEN 'Section: ' || h END, x)), '{WORD}') AS ws FROM texts),
            rows_ AS (SELECT question_id, chunk_id, papers.paper_id, score, rank AS before, x, ws, (SELECT list(term) FROM terms WHERE terms.question_id = fused.question_id) AS ts FROM fused JOIN papers USING (chunk_id) LEFT JOIN read_ USING (chunk_id)),
            scored AS (SELECT *, CASE WHEN x IS NULL THEN NULL WHEN len(ts) > 0 THEN len(list_filter(ts, lambda t: list_contains(ws, t))) / len(ts) ELSE 0.0 END AS again FROM rows_),
            placed AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY coalesce(again, score) DESC, before) AS place FROM scored),
            few AS (SELECT *, row_number() OVER (PARTITION BY question_id, paper_id ORDER BY place) AS nth FROM placed),
            last AS (SELECT *, row_number() OVER (PARTITION BY question_id ORDER BY place) AS rank FROM few WHERE nth <= 2)
            SELECT question_id, chunk_id, paper_id, round(again, 6) AS rerank_score, rank FROM last WHERE rank <= 10""",
        "evidence_documents": f"""WITH {TOP}, p AS (SELECT chunk_id, min(paper_id) AS paper_id, min(title) AS title, min(doi) AS doi, min(publication_year) AS y, min(publication_date) AS publication_date FROM chunks GROUP BY chunk_id)
            SELECT question_id, chunk_id AS source_id, paper_id, CASE WHEN paper_id LIKE 'W%' THEN 'https://works.example/' || paper_id END AS url, title, doi, CAST(y AS BIGINT) AS publication_year, publication_date, rank FROM fused JOIN p USING (chunk_id)""",
        "web_sources": rf"""WITH {ABSTRACT}, u AS (SELECT record_id, title, generate_subscripts(locations, 1) AS pos, trim(unnest(locations).landing_page_url, ' ') AS url FROM works),
            k AS (SELECT u.*, trim(abstract, ' ') AS text FROM u JOIN abstract_of USING (record_id) WHERE regexp_matches(url, '^(?i)https?://[^/?#\s]+') AND trim(abstract, ' ') <> ''),
            f AS (SELECT DISTINCT ON (url) * FROM k ORDER BY url, record_id, pos)
            SELECT 'web-' || left(sha256(url), 12) AS source_id, url, coalesce(nullif(trim(title, ' '), ''), 'Untitled web source') AS title, md5(CASE WHEN length(text) > 400 THEN rtrim(left(text, 400), ' ') || '...' ELSE text END) AS text FROM f""",
        "graded_evidence": f"""WITH {TOP}, g AS (SELECT question_id, left(chunk_id, 26) AS given, cand_id, CASE WHEN rerank_score >= 2 THEN 'correct' WHEN rerank_score >= 0 THEN 'ambiguous' ELSE 'incorrect' END AS grade
              FROM candidates WHERE rerank_score IS NOT NULL AND NOT isnan(rerank_score)),
            m AS (SELECT DISTINCT question_id, given, chunk_id FROM fused JOIN g USING (question_id) WHERE given = chunk_id OR (length(given) >= 8 AND (starts_with(chunk_id, given) OR starts_with(given, chunk_id)))),
            one AS (SELECT question_id, given, min(chunk_id) AS chunk_id FROM m GROUP BY ALL HAVING count(*) = 1),
            f AS (SELECT DISTINCT ON (question_id, chunk_id) question_id, chunk_id, grade FROM one JOIN g USING (question_id, given) ORDER BY question_id, chunk_id, cand_id, grade)
            SELECT question_id, chunk_id, coalesce(grade, 'ambiguous') AS grade, rank FROM fused LEFT JOIN f USING (question_id, chunk_id)""",
        "answer_citations": f"""WITH {JUDGED}, p AS (SELECT DISTINCT ON (question_id, chunk_id) question_id, chunk_id, paper_id FROM candidates WHERE paper_id IS NOT NULL ORDER BY question_id, chunk_id, cand_id DESC),
            c AS (SELECT r.question_id, r.rank, r.chunk_id, p.paper_id FROM rated r LEFT JOIN p USING (question_id, chunk_id) WHERE r.rank <= 3)
            SELECT q.question_id, coalesce(string_agg(c.chunk_id, '|' ORDER BY c.rank) FILTER (c.paper_id IS NOT NULL), '') AS sources, coalesce(string_agg(c.paper_id, '|' ORDER BY c.rank), '') AS papers,
              coalesce('none|' || string_agg(c.chunk_id, '|' ORDER BY c.rank) FILTER (c.chunk_id IS NOT NULL AND c.paper_id IS NULL), 'none') AS missing FROM questions q LEFT JOIN c USING (question_id) GROUP BY q.question_id""",
        "answer_checks": f"""WITH {JUDGED}, lists AS (SELECT question_id, list(chunk_id ORDER BY rank) FILTER (rank <= 3) AS cited, coalesce(list(chunk_id ORDER BY chunk_id) FILTER (rank <= 5 AND s > 2), []) AS gold FROM rated GROUP BY question_id),
            q AS (SELECT question_id, coalesce(cited, []) AS cited, coalesce(gold, []) AS gold FROM questions LEFT JOIN lists USING (question_id)),
            t AS (SELECT *, coalesce(list_position(list_transform(cited, lambda c: NOT list_contains(gold, c)), true), 9) AS lost FROM q)
            SELECT question_id, CASE WHEN len(cited) = 0 THEN 'no source' WHEN lost < 9 AND lost <= 3 THEN 'unknown source' WHEN len(cited) >= 3 THEN 'not cited' END AS problem,
              array_to_string(list_concat(cited, list_filter(gold, lambda g: NOT list_contains(cited, g))), '|') AS labels FROM t""",
        "question_evidence": rf"""WITH {CHUNKS}, {TOP}, x AS (SELECT chunk_id, min(text) AS text, min(publication_date) AS pd, min(publication_year) AS py FROM docs GROUP BY chunk_id),
            e AS (SELECT question_id, rank, text, CASE WHEN regexp_matches(pd, '^\d{{4}}-\d{{2}}-\d{{2}}') AND TRY_CAST(left(pd, 10) AS DATE) IS NOT NULL THEN TRY_CAST(left(pd, 10) AS DATE) BETWEEN DATE '{WINDOW[0]}' AND DATE '{WINDOW[1]}'
              ELSE coalesce(py BETWEEN {WINDOW[0][:4]} AND {WINDOW[1][:4]}, false) END AS recent FROM fused JOIN x USING (chunk_id)),
            g AS (SELECT question_id, bool_or(recent) AS recent, 64 + 160 * count(*) AS budget, list(left(text, 2000) ORDER BY rank)[1:3] AS shown FROM e GROUP BY question_id)
            SELECT question_id, regexp_matches(question, '{FRESH}') AS fresh, coalesce(recent, false) AS recent, budget, md5(array_to_string(shown, chr(10))) AS shown FROM questions LEFT JOIN g USING (question_id)""",
        "compacted_runs": f"WITH {LAST_RUNS} SELECT * FROM states",
        "open_runs": f"""WITH {LAST_RUNS}, pairs AS (SELECT DISTINCT unnest({list(RUNS)}) AS run, question_id FROM questions) SELECT run, question_id FROM pairs EXCEPT SELECT run, question_id FROM states WHERE completed""",
        "query_places": """WITH f AS (SELECT record_id, generate_subscripts(matched_queries, 1) - 1 AS pos, unnest(matched_queries) AS query FROM works)
            SELECT query, record_id, pos, row_number() OVER (PARTITION BY query ORDER BY record_id, pos) AS place FROM f""",
        "title_controls": f"""WITH b AS (SELECT 0::BIGINT AS side, record_id, lower({squeezed('title')}) AS key FROM works UNION ALL SELECT 1, record_id, lower({squeezed('title')}) FROM parsed_papers),
            h AS (SELECT DISTINCT ON (key) * FROM b WHERE len({_some('key', ON_TOPIC)}) > 0 ORDER BY key, side, record_id) SELECT side, record_id, key FROM h ORDER BY side, record_id LIMIT 100""",
        "refreshed_works": f"""WITH j AS (SELECT record_id, loaded_at, payload::JSON AS p FROM raw_lines WHERE feed = 'works' AND json_valid(payload)),
            l AS (SELECT *, {work_id("p ->> '$.id'")} AS work FROM j WHERE json_type(p) = 'OBJECT'), f AS (SELECT DISTINCT ON (work) work, p, json_keys(p) AS ks FROM l WHERE work <> '' ORDER BY work, loaded_at DESC NULLS LAST, record_id DESC)
            SELECT record_id, CASE WHEN list_contains(ks, 'title') THEN p ->> '$.title' ELSE title END AS title, CASE WHEN list_contains(ks, 'doi') THEN p ->> '$.doi' ELSE doi END AS doi,
              CASE WHEN list_contains(ks, 'language') THEN p ->> '$.language' ELSE language END AS language, f.work IS NOT NULL AS refreshed FROM works w LEFT JOIN f ON {work_id('w.id')} = f.work""",
        "enrichment_report": f"""WITH k AS (SELECT {work_id('id')} AS work, record_id, best_oa_location AS b, locations FROM works), l AS (SELECT DISTINCT ON (work) * FROM k WHERE work <> '' ORDER BY work, record_id DESC),
            u AS (SELECT *, (b.is_oa IS DISTINCT FROM false AND coalesce(trim(b.pdf_url, ' '), '') <> '') OR len(list_filter(coalesce(locations, []), lambda x: x.is_oa AND trim(x.pdf_url, ' ') <> '')) > 0 AS found FROM l),
            c AS (SELECT (SELECT count(*) FROM parsed_papers) AS papers, count(*) AS enriched, count(*) FILTER (coalesce(b.pdf_url, '') <> '') AS with_best_pdf, count(*) FILTER (found) AS with_any_pdf FROM u)
            SELECT *, enriched - with_any_pdf AS without_pdf, greatest(papers - enriched, 0) AS remaining, CASE WHEN papers > enriched THEN 'partial' ELSE 'complete' END AS status FROM c""",
        "local_inventory": f"WITH {_files()} SELECT * FROM chosen",
        "local_audit": f"""WITH {_files()}, lost AS (SELECT path FROM pf WHERE work IS NULL OR work NOT IN (SELECT work FROM w WHERE work IS NOT NULL) UNION SELECT path FROM xf WHERE work IS NULL OR work NOT IN (SELECT work FROM w WHERE work IS NOT NULL))
            SELECT 'records' AS name, count(*) AS n FROM chosen UNION ALL SELECT 'without_id', count(*) FROM chosen WHERE work IS NULL UNION ALL SELECT 'orphans', count(*) FROM lost
            UNION ALL SELECT k.name, count(c.content) FROM (VALUES ('pdf_only', 'pdf'), ('jats_only', 'jats'), ('tei_only', 'tei'), ('both', 'pdf and xml'), ('missing', 'missing')) k(name, content) LEFT JOIN chosen c ON c.content = k.content GROUP BY k.name""",
        "grading_totals": """WITH r AS (SELECT CASE WHEN isnan(rerank_score) THEN NULL ELSE rerank_score END AS r, CASE WHEN isnan(dense_score) THEN NULL ELSE dense_score END AS d FROM candidates),
            c AS (SELECT count(*) FILTER (r >= 2 AND d >= 0.8) AS accepted, count(*) FILTER (r < 0 AND d <= 0.39) AS rejected, count(*) AS n FROM r)
            SELECT accepted, rejected, n - accepted - rejected AS needs_review, greatest(100000 - accepted, 0) AS lacking FROM c""",
        "page_addresses": f"""SELECT record_id, 'web-' || left(sha256(best_oa_location.pdf_url), 12) AS page, best_oa_location.pdf_url || '?x=1&y=&api_key=k+1#top' AS address,
              CASE WHEN has_content.pdf AND regexp_matches(best_oa_location.pdf_url, '^[a-z]+://preprints[.]example(/|$)') THEN best_oa_location.pdf_url || '?api_key=k+1' END AS keyed,
              coalesce({found_id('doi')}, {found_id('id')}) AS work, CASE WHEN record_id % 3 <> 0 THEN CAST(record_id AS DOUBLE) END AS left FROM works""",
        "limited_payloads": """WITH v AS (SELECT record_id, payload::JSON ->> '$.title' AS title, payload::JSON ->> '$.doi' AS doi FROM (SELECT * FROM raw_lines WHERE json_valid(payload)) WHERE json_type(payload) = 'OBJECT')
            SELECT record_id, CASE WHEN length(title) > 40 THEN rtrim(left(title, 40), ' ') ELSE title END AS title, CASE WHEN length(doi) > 20 THEN rtrim(left(doi, 20), ' ') ELSE doi END AS doi FROM v""",
        "jsonl_records": "SELECT doc_id, md5(text) AS text, lang, source, CAST(publication_year AS BIGINT) AS publication_year FROM documents",
        "appended_lines": """WITH n AS (SELECT count(*) FILTER (feed = 'works') AS a, count(*) FILTER (feed <> 'works') AS b FROM raw_lines)
            SELECT feed, count(*) AS lines, CAST(sum(length(payload)) AS BIGINT) AS characters, any_value(a) AS added_0, any_value(b) AS added_1, 0::BIGINT AS added_2 FROM raw_lines, n GROUP BY feed""",
        "checked_examples": "SELECT question_id, question, category, difficulty FROM questions WHERE difficulty = 'easy'",
        "files_by_id": f"""WITH f AS (SELECT DISTINCT source_path AS path, {found_id("list_extract(string_split(source_path, '/'), -1)")} AS work_id FROM parsed_papers WHERE lower(source_path) LIKE '%.xml')
            SELECT work_id, string_agg(path, '|' ORDER BY path) AS paths FROM f WHERE work_id IS NOT NULL GROUP BY work_id UNION ALL SELECT work_id, path FROM f WHERE work_id IS NULL""",
        "pdf_checks": """SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN CASE WHEN text IS NULL THEN 'empty' WHEN strlen(text) + 9 < 500 THEN 'too small' END
              ELSE CASE WHEN coalesce(text, '') = '' THEN 'empty' WHEN strlen(text) < 500 THEN 'too small' WHEN NOT starts_with(text, '%PDF-') THEN 'no PDF' END END AS problem FROM documents""",
        "xml_checks": """SELECT record_id, CASE WHEN record_id % 4 = 2 THEN 'jats_xml' END AS format, CASE record_id % 4 WHEN 0 THEN 'malformed' WHEN 1 THEN 'empty' WHEN 3 THEN 'unknown root' END AS problem FROM parsed_papers""",
        "merged_papers": rf"""WITH k AS (SELECT {work_id('id')} AS work, record_id, doi, publication_year AS y FROM works), l AS (SELECT DISTINCT ON (work) work, doi, y FROM k WHERE work <> '' ORDER BY work, record_id DESC)
            SELECT p.record_id, coalesce(nullif(trim(l.doi, ' '), ''), nullif({squeezed('p.doi')}, '')) AS doi, coalesce(CAST(l.y AS BIGINT), TRY_CAST(nullif(regexp_extract(CAST(p.publication_year AS VARCHAR), '(19|20)\d\d'), '') AS BIGINT)) AS publication_year,
              CAST(NULL AS VARCHAR) AS problem FROM parsed_papers p LEFT JOIN l ON {found_id('upper(p.paper_id)')} = l.work""",
        "model_scores": f"""WITH {CHUNKS}, {TOP}, texts AS (SELECT chunk_id, regexp_extract_all(lower(min(text)), '{WORD}') AS ws FROM docs GROUP BY chunk_id), q AS (SELECT question_id, list_distinct(regexp_extract_all(lower(question), '{WORD}')) AS qs FROM questions),
            s AS (SELECT question_id, chunk_id, len(list_filter(qs, lambda w: list_contains(ws, w))) / len(qs) AS s FROM fused JOIN texts USING (chunk_id) JOIN q USING (question_id))
            SELECT question_id, chunk_id, round(s, 6) AS score, CASE WHEN s >= 0.8 THEN 'correct' WHEN s >= 0.4 THEN 'ambiguous' ELSE 'incorrect' END AS grade, CAST(NULL AS VARCHAR) AS error FROM s""",
        "rescored_runs": """WITH r AS (SELECT DISTINCT cand_id, dense_score AS d, sparse_score AS s, rerank_score AS r FROM candidates)
            SELECT cand_id, CASE WHEN d IS NULL AND s IS NULL AND r IS NULL THEN '' ELSE 'dense_score|rerank_score|sparse_score' END AS scores,
              array_to_string(list_filter([CASE WHEN isnan(d) THEN 'dense_score' END, CASE WHEN isnan(s) THEN 'sparse_score' END], lambda n: n IS NOT NULL), '|') AS errors, CASE WHEN r IS NULL THEN -99.0 WHEN isnan(r) THEN 0.0 ELSE r END::DOUBLE AS rerank_score FROM r""",
        "journal_addresses": rf"""WITH n AS (SELECT record_id, publication_year AS y, lower(trim(coalesce(best_oa_location.source.display_name, ''), ' ')) AS j, best_oa_location.pdf_url AS url, regexp_extract(lower(coalesce(doi, '')), '10[.]98[0-9]+/([a-z]+)[0-9]', 1) AS code FROM works),
            g AS (SELECT *, [CASE j {' '.join(f"WHEN '{k}' THEN '{v}'" for k, v in JOURNALS.items())} END, regexp_replace(j, '[^a-z0-9]+', '', 'g'), code] AS all_ FROM n),
            o AS (SELECT *, list_filter(all_, lambda x, i: x <> '' AND list_position(all_, x) = i) AS slugs FROM g),
            s AS (SELECT *, slugs[1] || '-' || CASE WHEN y % 100 < 10 THEN '0' ELSE '' END || (y % 100) || '-' || repeat('0', greatest(0, 5 - length(CAST(record_id AS VARCHAR)))) || record_id AS stem FROM o)
            SELECT record_id, array_to_string(slugs, '|') AS slugs, coalesce(regexp_matches(lower(url), '^[a-z]+://(archive|repo)[.]example(/|$)'), false) AS here, 'https://files.example/d/' || slugs[1] || '/' || stem || '/article_deploy/' || stem || '.pdf' AS address FROM s""",
    }
    return found | {"stored_report": found["audit_counts"]}
