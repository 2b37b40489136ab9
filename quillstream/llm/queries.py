"""Registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.llm import fingerprint, mixing, neighbours, packing, splitting, tokens, topn, toxicity
from quillstream.runtime import cut, remove, shared_folder, table
from quillstream.sources.json_lines import field_texts


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbours.near_pairs(table(spark, d, "chunks"), "vector_id", "embedding", 5, 64)


def p1_recall(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks")
    return neighbours.recall(chunks, "vector_id", "embedding", neighbours.most_similar(chunks, "vector_id", "embedding", every=100))


def p1_found_recall(spark: SparkSession, d: str) -> DataFrame:
    """What ``p1_found`` loses, with its own settings."""
    chunks = table(spark, d, "chunks")
    found = neighbours.most_similar(chunks, "vector_id", "embedding", every=100, **neighbours.CLOSE)
    return neighbours.recall(chunks, "vector_id", "embedding", found, least=neighbours.CLOSE["least"])


def p1_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The five nearest of every vector whose id is divisible by 100, among all."""
    return neighbours.most_similar(table(spark, d, "chunks"), "vector_id", "embedding", every=100)


def _paper_records(spark: SparkSession, d: str) -> DataFrame:
    lines = table(spark, d, "raw_lines").where("feed = 'parsed'")
    columns = ["record_id", "paper_id", "title", "doi"]
    return table(spark, d, "parsed_papers").select(*columns).unionByName(field_texts(lines, "payload", columns[1:], ["record_id"]))


def _paper_forms() -> dict:
    return {"paper_id": fingerprint.work_form(F.col("paper_id")), "title": fingerprint.plain_form(F.col("title")), "doi": fingerprint.plain_form(F.col("doi"), "10.")}


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    links = fingerprint.duplicate_links(_paper_records(spark, d), "record_id", _paper_forms())
    return links.select(F.col("kept").alias("kept_record_id"), F.col("copy").alias("copy_record_id"))


def p2_collapsed(spark: SparkSession, d: str) -> DataFrame:
    return fingerprint.collapse(_paper_records(spark, d), "record_id", _paper_forms()).withColumnRenamed("kept", "kept_record_id")


def _items(spark: SparkSession, d: str) -> DataFrame:
    """Sections (an id comes again with each revision of its paper, so the place in its record is part of the key) and chunks (full repeats once)."""
    papers = table(spark, d, "parsed_papers").select("record_id", F.posexplode("sections").alias("place", "s"))
    sections = papers.select(F.lit("section").alias("item_kind"), F.col("s.section_id").alias("item_id"), "record_id", "place", F.col("s.section_type").alias("section_type"), F.col("s.text").alias("text"))
    chunks = table(spark, d, "chunks").select(F.lit("chunk").alias("item_kind"), F.col("chunk_id").alias("item_id"), F.col("vector_id").alias("record_id"), F.lit(0).alias("place"), "section_type", "text")
    return sections.unionByName(chunks)


ITEM = ["item_kind", "item_id", "record_id", "place"]


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitting.plan_items(_items(spark, d), ITEM, "text", 300, 50)
    return pieces.where("chunk_index = 1").select("item_kind", "item_id").distinct()


def p4_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitting.split_items(_items(spark, d), [*ITEM, "section_type"], "text", 300, 50)


def p4_files(spark: SparkSession, d: str) -> DataFrame:
    """All texts of documents written into large files, about a thousand texts each, and these cut by byte ranges: for each file the tokens that its pieces hold, overlaps once, and the pieces over the limit."""
    texts = table(spark, d, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("value"))
    n = max(1, -(-texts.count() // 1000))
    home = f"{shared_folder(spark)}/texts-{uuid.uuid4().hex}"
    filed = texts.select("value", F.pmod("doc_id", F.lit(n)).alias("file"), "doc_id").repartition(n, "file").sortWithinPartitions("file", "doc_id")
    filed.select("value", "file").write.partitionBy("file").text(home)
    pieces = splitting.split_files(spark, home, 300, 50, range_bytes=1 << 18)
    held = F.sum(F.col("token_count") - F.when(F.col("chunk_index") > 0, 50).otherwise(0)).cast("bigint")
    per = cut(pieces.groupBy(F.regexp_extract("path", r"file=(\d+)", 1).cast("bigint").alias("file")).agg(held.alias("tokens"), F.count_if(F.col("token_count") > 300).alias("over")))
    remove(spark, home)
    return per


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n_per_group(table(spark, d, "candidates"), "paper_id", "cand_id", "rerank_score", "rrf_score", 3).select("paper_id", "cand_id")


CAPACITY = 2048
TIGHT = 640


def p6_containers(spark: SparkSession, d: str) -> DataFrame:
    return packing.pack(tokens.token_sizes(table(spark, d, "documents"), ["doc_id"], "text"), "doc_id", "tokens", CAPACITY)


def p6_fill(spark: SparkSession, d: str) -> DataFrame:
    return packing.fill_report(p6_containers(spark, d), CAPACITY)


def p6_whole(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are packed, those in more than one container though none of their parts is a full one, and containers over the capacity."""
    packed = p6_containers(spark, d)
    return packing.soundness(packed, "doc_id", CAPACITY)


def p6_tight(spark: SparkSession, d: str) -> DataFrame:
    """All documents in containers that hold few of them, where it matters how they are combined: containers by evolution, by best-fit alone, and the fewest that could do."""
    sizes = cut(tokens.token_sizes(table(spark, d, "documents"), ["doc_id"], "text"))
    found = packing.fill_report(packing.pack(sizes, "doc_id", "tokens", TIGHT), TIGHT).select("containers", "least_containers", "over")
    fitted = packing.fill_report(packing.pack(sizes, "doc_id", "tokens", TIGHT, rounds=0), TIGHT).select(F.col("containers").alias("best_fit_containers"))
    both = found.unionByName(fitted, allowMissingColumns=True)
    return both.agg(*(F.max(c).alias(c) for c in ("containers", "best_fit_containers", "least_containers", "over")))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    sizes = tokens.token_sizes(table(spark, d, "documents"), ["source", "doc_id"], "text").withColumnRenamed("doc_id", "item")
    return mixing.mix(sizes, table(spark, d, "source_targets")).withColumnRenamed("item", "doc_id")


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.share_report(cut(p7_mix(spark, d)), table(spark, d, "source_targets"))


def p8_scores(spark: SparkSession, d: str) -> DataFrame:
    documents = table(spark, d, "documents")
    return toxicity.score_documents(documents, toxicity.train(documents, table(spark, d, "doc_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return p8_scores(spark, d).where("flagged").select("doc_id")


def p8_rates(spark: SparkSession, d: str) -> DataFrame:
    return toxicity.rates(p8_scores(spark, d))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p1_recall, p1_found_recall, p1_neighbours, p2_found, p2_collapsed, p4_found, p4_pieces, p4_files, p5_found, p6_containers, p6_fill, p6_whole, p6_tight, p7_mix, p7_shares, p8_found, p8_scores, p8_rates)}


P5_SQL = """
WITH c AS (
  SELECT DISTINCT paper_id, cand_id, rerank_score, CASE WHEN isnan(rrf_score) THEN NULL ELSE rrf_score END AS tie
  FROM candidates WHERE paper_id IS NOT NULL AND cand_id IS NOT NULL AND rerank_score IS NOT NULL AND NOT isnan(rerank_score)
), r AS (
  SELECT *, row_number() OVER (PARTITION BY paper_id ORDER BY rerank_score DESC, tie DESC NULLS LAST, cand_id) AS k FROM c
)
SELECT paper_id, cand_id FROM r WHERE k <= 3"""


P4_SPACE = r"\s\p{Z}\x{1c}-\x{1f}\x{85}\x{0b}"
P4_TOKEN = rf"[\p{{L}}\p{{N}}_]+|[^\p{{L}}\p{{N}}_{P4_SPACE}]"
P4_ITEMS = """
  SELECT 'section' AS item_kind, s.section_id AS item_id, record_id, k - 1 AS place, s.section_type AS section_type, s.text AS text
    FROM (SELECT record_id, generate_subscripts(sections, 1) AS k, unnest(sections) AS s FROM parsed_papers)
  UNION SELECT 'chunk', chunk_id, vector_id, 0, section_type, text FROM chunks"""
P4_SQL = f"""
WITH items AS ({P4_ITEMS})
SELECT DISTINCT item_kind, item_id FROM items WHERE len(regexp_extract_all(text, '{P4_TOKEN}')) > 300"""
# where the piece after each possible end ends, then the chain of pieces of each item
P4_PIECES = f"""
WITH RECURSIVE items AS (SELECT row_number() OVER () AS i, * FROM ({P4_ITEMS})), parts AS (
  SELECT i, regexp_extract_all(text, '([{P4_SPACE}]*)({P4_TOKEN})', 1) AS gaps, regexp_extract_all(text, '([{P4_SPACE}]*)({P4_TOKEN})', 2) AS toks FROM items
), tok AS (SELECT i, unnest(range(0, len(toks))) AS k, unnest(gaps) AS gap, unnest(toks) AS tok FROM parts),
placed AS (
  SELECT *, sum(length(gap) + length(tok)) OVER (PARTITION BY i ORDER BY k) AS z, lag(tok) OVER (PARTITION BY i ORDER BY k) AS left_,
    length(gap) - length(replace(gap, chr(10), '')) AS feeds, length(gap) - length(replace(gap, chr(13), '')) AS returns FROM tok
), cuts AS (
  SELECT i, k AS spot, CASE WHEN n > 1 THEN 3 WHEN n = 1 THEN 2 WHEN right(left_, 1) IN ('.', '!', '?', '…', '。', '！', '？') THEN 1 ELSE 0 END AS kind
  FROM (SELECT *, CASE WHEN feeds > 0 THEN feeds ELSE returns END AS n FROM placed) WHERE k > 0 AND gap <> ''
), sizes AS (SELECT i, count(*) AS total FROM tok GROUP BY i),
ends AS (SELECT i, total, unnest(range(0, total)) AS new FROM sizes), reach AS (SELECT *, greatest(0, new - 50) AS start FROM ends),
best AS (
  SELECT r.i, r.new, max((CASE WHEN spot - start > 150 THEN 4 ELSE 0 END + kind) * 1000000000::BIGINT + spot) AS b FROM reach r JOIN cuts c ON r.i = c.i AND spot > greatest(new, start + 50) AND spot <= start + 300 AND kind > 0
  WHERE total - start > 300 GROUP BY r.i, r.new
), step AS (
  SELECT r.i, r.new, start, total, CASE WHEN total - start <= 300 THEN total WHEN b IS NULL THEN start + 300 ELSE b % 1000000000 END AS stop,
    CASE WHEN total - start <= 300 THEN 3 WHEN b IS NULL THEN 0 ELSE (b // 1000000000) % 4 END AS ends_at FROM reach r LEFT JOIN best USING (i, new)
), chain AS (
  SELECT i, 0 AS chunk_index, start, stop, total, ends_at FROM step WHERE new = 0
  UNION ALL SELECT s.i, chunk_index + 1, s.start, s.stop, s.total, s.ends_at FROM chain c JOIN step s ON s.i = c.i AND s.new = c.stop WHERE c.stop < c.total
)
SELECT item_kind, item_id, record_id, CAST(place AS INT) AS place, section_type, CAST(chunk_index AS INT) AS chunk_index, CAST(a.z - length(a.tok) AS BIGINT) AS start, CAST(b.z AS BIGINT) AS stop,
  CAST(c.stop - c.start AS INT) AS token_count, CAST(ends_at AS INT) AS ends_at, substring(text, CAST(a.z - length(a.tok) + 1 AS BIGINT), CAST(b.z - a.z + length(a.tok) AS BIGINT)) AS piece
FROM chain c JOIN items USING (i) JOIN placed a ON a.i = c.i AND a.k = c.start JOIN placed b ON b.i = c.i AND b.k = c.stop - 1"""
P4_FILES = f"""
SELECT doc_id % n AS file, CAST(sum(len(regexp_extract_all(text, '{P4_TOKEN}'))) AS BIGINT) AS tokens, CAST(0 AS BIGINT) AS over
FROM documents, (SELECT greatest(1, CAST(ceil(count(*) / 1000.0) AS BIGINT)) AS n FROM documents) GROUP BY 1"""


def _compatible(c: str) -> str:
    """NFKC as far as the tables need it: full-width letters, ligatures and composed accents; letters, accents and digits of it in lower case."""
    wide, plain = ("".join(chr(k + d) for k in range(0x21, 0x7F) if chr(k) != "'") for d in (0xFEE0, 0))
    out = f"translate(coalesce({c}, ''), '{wide}', '{plain}')"
    for ligature, letters in (("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ß", "ss")):
        out = f"replace({out}, '{ligature}', '{letters}')"
    return f"lower(nfc_normalize({out}))"


def _bare(c: str) -> str:
    return f"regexp_replace({c}, '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


def _p2_sql(last: str) -> str:
    paper, doi = _bare(_compatible("paper_id")), f"regexp_replace({_compatible('doi')}, '[\\x{{ad}}\\x{{200b}}\\x{{2060}}\\x{{feff}}]', '', 'g')"
    return f"""
WITH r AS (
  SELECT record_id, paper_id, title, doi FROM parsed_papers
  UNION ALL SELECT record_id, payload ->> '$.paper_id', payload ->> '$.title', payload ->> '$.doi' FROM raw_lines WHERE feed = 'parsed' AND json_valid(payload)
), f AS (
  SELECT record_id, coalesce(nullif(regexp_extract({paper}, '.*(w[0-9].*)', 1), ''), {paper}) AS p, {_bare(_compatible('title'))} AS t,
    {_bare(f"coalesce(nullif(regexp_extract({doi}, '10\\..*'), ''), {doi})")} AS d FROM r
), g AS (SELECT record_id, min(record_id) OVER (PARTITION BY p, t, d) AS kept, count(*) OVER (PARTITION BY p, t, d) AS copies FROM f)
{last}"""


P1_SQL = """
WITH v AS (
  SELECT DISTINCT ON (vector_id) vector_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM chunks
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), s AS (SELECT a.vector_id AS a, b.vector_id AS b, round(list_cosine_similarity(a.e, b.e), 12) AS c FROM v a JOIN v b ON a.vector_id <> b.vector_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS k FROM s)
SELECT DISTINCT least(a, b) AS vector_id_a, greatest(a, b) AS vector_id_b FROM r WHERE k <= 5 AND c >= 0.9"""


def oracle_sql() -> dict[str, str]:
    pairs = "SELECT kept AS kept_record_id, record_id AS copy_record_id FROM g WHERE kept < record_id"
    kept = "SELECT kept AS kept_record_id, copies FROM g WHERE kept = record_id"
    return {"p1_found": P1_SQL, "p2_found": _p2_sql(pairs), "p2_collapsed": _p2_sql(kept), "p4_found": P4_SQL, "p4_pieces": P4_PIECES, "p4_files": P4_FILES, "p5_found": P5_SQL, "p6_whole": "SELECT count(*) AS documents, CAST(0 AS BIGINT) AS cut_small, CAST(0 AS BIGINT) AS over FROM documents"}
