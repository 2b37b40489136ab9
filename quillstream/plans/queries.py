"""Registered queries of the core. Each runs over its whole tables; ``oracle`` has the SQL that checks them."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstream.functions import ids, nested, text
from quillstream.operators import chunking, dedup, evidence, grading, joins, runs, search, selection
from quillstream.operators.works import work_children, work_table
from quillstream.plans.oracle import oracle_sql
from quillstream.plans.settings import CUTOFF, JOURNALS, ON_TOPIC, RULES, RUNS, WINDOW
from quillstream.runtime import cut, remove, shared_folder, table
from quillstream.sources import files, xml_papers
from quillstream.sources.json_lines import field_texts, is_json_object
from quillstream.streaming import ingest

__all__ = ["oracle_sql", "queries"]


def _chunks(spark: SparkSession, d: str, *columns: str) -> DataFrame:
    """Chunks without repeated rows: only the columns in use are hashed, and nothing is sorted."""
    return table(spark, d, "chunks").select("vector_id", *columns).distinct()


def _feeds(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, d, "works"), table(spark, d, "raw_lines").where("feed = 'works'")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return work_children(*_feeds(spark, d))


def p3_locations(spark: SparkSession, d: str) -> DataFrame:
    """The flat table of locations; works lead to it by record_id, its own children by (record_id, pos)."""
    return work_table(*_feeds(spark, d), "locations").drop("sub_pos")


def p3_issn(spark: SparkSession, d: str) -> DataFrame:
    return work_table(*_feeds(spark, d), "locations_issn")


def p3_lineage(spark: SparkSession, d: str) -> DataFrame:
    return work_table(*_feeds(spark, d), "locations_lineage")


def p3_best_oa_location(spark: SparkSession, d: str) -> DataFrame:
    return work_table(*_feeds(spark, d), "best_oa_location").drop("pos", "sub_pos")


def p3_open_access(spark: SparkSession, d: str) -> DataFrame:
    return work_table(*_feeds(spark, d), "open_access").drop("pos", "sub_pos")


def p3_abstract_words(spark: SparkSession, d: str) -> DataFrame:
    return work_table(*_feeds(spark, d), "abstract_word").drop("sub_pos")


# functions


def token_counts(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return table(spark, d, "documents").select("doc_id", text.token_count(t).cast("bigint").alias("tokens"), F.length(t).cast("bigint").alias("characters"), F.md5(text.squeeze(t)).alias("squeezed"))


def last_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.md5(text.last_tokens(F.col("text"), 50)).alias("tail"))


def work_identifiers(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "works")
    return works.select(
        "record_id", ids.work_id(F.col("id")).alias("work_id"), ids.work_id_anywhere(F.col("id")).alias("found_id"), ids.plain_doi(F.col("doi")).alias("doi"),
        ids.identifier(F.col("id")).alias("identifier"), ids.year(F.col("publication_year")).cast("bigint").alias("year"), ids.iso_date(F.col("publication_date")).alias("published"),
    )


def title_keys(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "parsed_papers").select("record_id", ids.title_key(F.col("title")).alias("title_key"))


def abstracts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "works").select("record_id", nested.abstract_text(F.col("abstract_inverted_index")).alias("abstract"))


def paper_texts(spark: SparkSession, d: str) -> DataFrame:
    whole = text.joined_text(F.col("title"), F.col("abstract"), F.col("sections"))
    return table(spark, d, "parsed_papers").select("record_id", F.md5(whole).alias("whole"), F.length(whole).cast("bigint").alias("characters"), (F.length(whole) >= 500).alias("usable"))


def encoder_texts(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "title", "section_heading", "text")
    return rows.select("vector_id", F.md5(text.embedding_text(F.col("title"), F.col("section_heading"), F.col("text"))).alias("encoded"))


def open_pdf_urls(spark: SparkSession, d: str) -> DataFrame:
    urls = ids.open_pdf_urls(F.col("best_oa_location"), F.col("locations"))
    return table(spark, d, "works").select("record_id", F.array_join(urls, " ").alias("urls"), F.size(urls).cast("bigint").alias("n"))


def url_hosts(spark: SparkSession, d: str) -> DataFrame:
    urls = table(spark, d, "works").select(F.explode("locations").alias("l")).select(F.explode(F.array("l.landing_page_url", "l.pdf_url")).alias("url")).where("url is not null")
    named = urls.select(F.try_parse_url("url", F.lit("HOST")).alias("host"), ids.is_safe_url(F.col("url")).alias("safe"))
    return named.groupBy("host").agg(F.count("*").alias("urls"), F.count_if("safe").alias("safe"))


def date_windows(spark: SparkSession, d: str) -> DataFrame:
    fits = ids.in_window(ids.iso_date(F.col("publication_date")), F.col("publication_year"), *WINDOW)
    return _chunks(spark, d, "paper_id", "publication_date", "publication_year").groupBy("paper_id").agg(F.count("*").alias("chunks"), F.count_if(fits).alias("in_window"))


# sections, chunks and parsing


def section_profile(spark: SparkSession, d: str) -> DataFrame:
    sections = table(spark, d, "parsed_papers").select(F.explode("sections").alias("s"))
    typed = sections.select(text.section_type(F.col("s.heading")).alias("by_heading"), F.col("s.section_type").alias("section_type"), text.token_count(F.col("s.text")).alias("n"))
    return typed.groupBy("by_heading", "section_type").agg(F.count("*").alias("sections"), F.sum("n").cast("bigint").alias("tokens"))


def window_chunks(spark: SparkSession, d: str) -> DataFrame:
    pieces = table(spark, d, "documents").select("doc_id", F.posexplode(chunking.windows(F.col("text"), 300, 50)).alias("chunk_index", "piece"))
    return pieces.select("doc_id", F.col("chunk_index").cast("bigint").alias("chunk_index"), F.md5("piece").alias("piece"))


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.paper_chunks(table(spark, d, "parsed_papers"))


def chunk_report(spark: SparkSession, d: str) -> DataFrame:
    return chunking.chunk_report(table(spark, d, "chunks"))


def chunk_profile(spark: SparkSession, d: str) -> DataFrame:
    rows = _chunks(spark, d, "section_type", "source_format", "token_count")
    return rows.groupBy("section_type", "source_format").agg(F.count("*").alias("chunks"), F.sum("token_count").cast("bigint").alias("tokens"))


def parsed_xml(spark: SparkSession, d: str) -> DataFrame:
    """All papers written as JATS and parsed again, a row per section."""
    parsed = xml_papers.parse_papers(xml_papers.as_jats(table(spark, d, "parsed_papers")), "record_id", "paper_id", "xml")
    rows = parsed.select("record_id", F.explode("paper.sections").alias("s"))
    return rows.select("record_id", F.col("s.section_order").cast("bigint").alias("section_order"), F.col("s.section_type").alias("section_type"), F.md5("s.text").alias("text"))


# joins, duplicates and order


def discovery_dedup(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "works").withColumn("work_id", F.nullif(ids.work_id(F.col("id")), F.lit("")))
    lists = dedup.merged_lists(works, "work_id", "matched_queries", "record_id")
    return lists.select("work_id", F.col("first").alias("first_record"), F.array_join("matched_queries", "|").alias("queries"), F.size("matched_queries").cast("bigint").alias("n"))


def latest_candidates(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "candidates").select("question_id", "chunk_id", "cand_id", "loaded_at")
    return ingest.latest(rows, ["question_id", "chunk_id"], "loaded_at", "cand_id")


def greedy_dedup(spark: SparkSession, d: str) -> DataFrame:
    """Works, then parsed papers, duplicates by work id, DOI or title of a kept record."""
    named = lambda t, i: table(spark, d, t).select("record_id", F.nullif(ids.work_id(F.col(i)), F.lit("")).alias("work"), ids.plain_doi(F.col("doi")).alias("doi"), ids.title_key(F.col("title")).alias("title"))
    both = named("works", "id").withColumn("source", F.lit(0)).unionByName(named("parsed_papers", "paper_id").withColumn("source", F.lit(1)))
    rows = dedup.numbered(both, ["source", "record_id"], "at")
    return rows.select("at", "record_id").join(dedup.greedy_first(rows, "at", ["work", "doi", "title"]).drop("holder"), "at").select("record_id", "kept", "reason")


def parsed_union(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "parsed_papers").withColumn("work_id", ids.work_id_anywhere(F.upper("paper_id"))).where("work_id is not null")
    sides = [papers.where(F.col("source_format") == f).select("work_id", "record_id", "source_format") for f in ("jats_xml", "grobid_tei")]
    return dedup.ordered_union(*sides, ["work_id"], [F.col("record_id")]).select("work_id", "record_id", "source_format")


def numbered_chunks(spark: SparkSession, d: str) -> DataFrame:
    return dedup.numbered(table(spark, d, "chunks").select("chunk_id").distinct(), ["chunk_id"]).select("chunk_id", "number")


def paper_dates(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "works").select(ids.work_id(F.col("id")).alias("work_id"), "publication_date", "record_id")
    full = works.where(F.col("publication_date").rlike(r"^\d{4}-\d{2}-\d{2}$") & (F.col("work_id") != ""))
    return ingest.latest(full, ["work_id"], "record_id", "record_id").select("work_id", "publication_date")


def dated_chunks(spark: SparkSession, d: str) -> DataFrame:
    dates = paper_dates(spark, d).select(F.col("work_id").alias("paper_id"), F.col("publication_date").alias("known"))
    rows = _chunks(spark, d, "paper_id", "publication_date").join(dates, "paper_id", "left")
    return rows.select("vector_id", F.coalesce("publication_date", "known").alias("publication_date"))


def coverage(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "works").select(ids.work_id_anywhere(F.upper("id")).alias("work_id"))
    parsed = table(spark, d, "parsed_papers").select(ids.work_id_anywhere(F.upper("paper_id")).alias("work_id"))
    chunked = table(spark, d, "chunks").select(ids.work_id_anywhere(F.upper("paper_id")).alias("work_id"))
    return joins.key_coverage({"works": works, "parsed": parsed, "chunked": chunked}, "work_id")


def repaired_ids(spark: SparkSession, d: str) -> DataFrame:
    """Chunk ids of the candidates, cut after 26 characters, led back to the one chunk each can mean."""
    cut_ids = table(spark, d, "candidates").select(F.left("chunk_id", F.lit(26)).alias("given")).where("given is not null").distinct()
    return joins.repaired_ids(cut_ids, table(spark, d, "chunks").select("chunk_id").distinct(), "given", "chunk_id", 22)


def screening(spark: SparkSession, d: str) -> DataFrame:
    labels = ingest.latest(table(spark, d, "doc_labels"), ["doc_id"], "labelled_at", "label_id").select("doc_id", F.lower(F.trim("label")).alias("label"))
    rows = table(spark, d, "documents").select("doc_id", "source").join(labels, "doc_id", "left")
    return rows.groupBy("source", F.coalesce("label", F.lit("open")).alias("decision")).agg(F.count("*").alias("documents"))


def remaining_chunks(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("chunk_id", "indexed_at")
    done = chunks.where(F.col("indexed_at") < F.lit(CUTOFF).cast("timestamp_ntz"))
    return ingest.remaining(chunks, done, ["chunk_id"]).select("chunk_id").distinct()


# scores and reports


def _scored_works(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "works")
    found = selection.relevance(F.col("title"), F.col("abstract_inverted_index"), F.col("primary_topic"), F.col("topics"), F.col("matched_queries"), F.col("query_match_count"), RULES)
    fails = selection.failures(
        retracted=F.col("is_retracted"), missing_title=F.trim(F.coalesce("title", F.lit(""))) == "", missing_abstract=F.coalesce(F.cardinality("abstract_inverted_index"), F.lit(0)) == 0,
        missing_downloadable_content=~(F.coalesce("has_content.pdf", F.lit(False)) | F.coalesce("has_content.grobid_xml", F.lit(False))),
    )
    rows = works.select("record_id", "publication_year", "cited_by_count", F.col("has_content.grobid_xml").alias("has_xml"), found.alias("found"), fails.alias("fails"))
    return rows.select("*", F.col("found.score").cast("bigint").alias("score"))


def relevance_scores(spark: SparkSession, d: str) -> DataFrame:
    return _scored_works(spark, d).select("record_id", "score", F.array_join("fails", "|").alias("fails"))


def failure_counts(spark: SparkSession, d: str) -> DataFrame:
    return _scored_works(spark, d).select(F.explode("fails").alias("reason")).groupBy("reason").agg(F.count("*").alias("works"))


def score_histogram(spark: SparkSession, d: str) -> DataFrame:
    return _scored_works(spark, d).groupBy("score").agg(F.count("*").alias("works"), F.count_if(F.size("fails") > 0).alias("failing"))


def selection_decisions(spark: SparkSession, d: str) -> DataFrame:
    """Where each work's terms were found and whether it is retained; only retraction and a missing title fail it."""
    rows = _scored_works(spark, d).withColumn("failed", F.array_intersect("fails", F.array(F.lit("retracted"), F.lit("missing_title"))))
    terms = [F.array_join(f"found.{c}", "|").alias(c) for c in ("title_terms", "abstract_terms", "metadata_terms", "penalty_terms")]
    return rows.select("record_id", "score", *terms, selection.decision(F.col("score"), F.col("failed"), RULES).alias("decision"))


def best_works(spark: SparkSession, d: str) -> DataFrame:
    """The ten best works of each publication year: a top-k report."""
    order = [*selection.candidate_order(F.col("score"), F.col("has_xml"), F.col("cited_by_count"), F.col("publication_year")), F.asc("record_id")]
    return search.best(_scored_works(spark, d), ["publication_year"], order, 10).select("publication_year", "record_id", "score", F.col("rank").cast("bigint").alias("rank"))


def discovery_report(spark: SparkSession, d: str) -> DataFrame:
    works = table(spark, d, "works")
    by = lambda kind, c: works.select(c.alias("key")).where("key is not null").groupBy("key").agg(F.count("*").alias("works")).select(F.lit(kind).alias("kind"), "key", "works")
    topics = by("topic", F.explode(F.expr("transform(topics, t -> t.display_name)")))
    return by("year", F.col("publication_year").cast("string")).unionByName(by("query", F.explode("matched_queries"))).unionByName(topics)


def audit_counts(spark: SparkSession, d: str) -> DataFrame:
    w = table(spark, d, "works").withColumn("work_id", ids.work_id_anywhere(F.upper("id")))
    full = lambda c: F.coalesce(c, F.lit(False))
    pdf, xml = full(F.col("has_content.pdf")), full(F.col("has_content.grobid_xml"))
    return w.agg(
        F.count("*").alias("records"), F.count_distinct("work_id").alias("works"), F.count_if(F.col("work_id").isNull()).alias("without_id"), F.count_if(F.trim("doi") != "").alias("with_doi"),
        F.count_if(pdf & ~xml).alias("pdf_only"), F.count_if(xml & ~pdf).alias("xml_only"), F.count_if(pdf & xml).alias("both"), F.count_if(~pdf & ~xml).alias("neither"),
        (F.count("work_id") - F.count_distinct("work_id")).alias("repeated"), F.count_if("is_retracted").alias("retracted"),
    )


def index_terms(spark: SparkSession, d: str) -> DataFrame:
    """The 100 terms found in the most chunks: a top-k report."""
    terms = _chunks(spark, d, "text").select("vector_id", F.explode(F.array_distinct(text.words(F.col("text")))).alias("term"))
    counts = terms.groupBy("term").agg(F.count("*").alias("chunks"))
    return counts.orderBy(F.desc("chunks"), "term").limit(100)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return ingest.windowed_counts(table(spark, d, "events"), "ts", "event_type")


def ingested_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines as a stream of files into a table, and what of them is valid."""
    home = f"{shared_folder(spark)}/ingest-{uuid.uuid4().hex}"
    rows = ingest.ingest_lines(spark, f"{d}/raw_lines.parquet", "record_id bigint, feed string, payload string", f"{home}/table", f"{home}/progress")
    counts = cut(rows.groupBy("feed", "valid").agg(F.count("*").alias("lines"), F.sum(F.length("payload")).cast("bigint").alias("characters")))
    remove(spark, home)
    return counts


# search and its measures


def _index(spark: SparkSession, d: str, stems: bool = False) -> search.Index:
    return search.stored_index(spark, f"{d}/chunks.parquet", lambda: _chunks(spark, d, "text"), "vector_id", "text", stems)


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_of(_index(spark, d), table(spark, d, "questions"), "question_id", "question", "vector_id", 50).withColumn("rank", F.col("rank").cast("bigint"))


def stemmed_topk(spark: SparkSession, d: str) -> DataFrame:
    return search.bm25_of(_index(spark, d, True), table(spark, d, "questions"), "question_id", "question", "vector_id", 50).withColumn("rank", F.col("rank").cast("bigint"))


def nearest_vectors(spark: SparkSession, d: str) -> DataFrame:
    """For every vector whose id is divisible by 100 its ten nearest among all."""
    vectors = table(spark, d, "embeddings")
    asked = vectors.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("v"))
    found = search.nearest(asked, vectors, "query_id", "v", "vec_id", "embedding", 10, others_only=True)
    return found.select("query_id", "vec_id", F.round("cosine", 6).alias("cosine"), F.col("rank").cast("bigint").alias("rank"))


def hybrid_search(spark: SparkSession, d: str) -> DataFrame:
    chunks = _chunks(spark, d, "paper_id", "embedding")
    return search.hybrid(table(spark, d, "questions"), chunks, "question_id", "question", "vector_id", "paper_id", "text", "embedding", index=_index(spark, d)).withColumn("rank", F.col("rank").cast("bigint"))


def corrected_search(spark: SparkSession, d: str) -> DataFrame:
    found = search.corrective(table(spark, d, "questions"), _chunks(spark, d, "text", "title"), "question_id", "question", "vector_id", "text", "title", index=_index(spark, d))
    return found.select("question_id", "vector_id", F.col("round").cast("bigint").alias("round"), F.col("rank").cast("bigint").alias("rank"))


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Dense and sparse lists of each question from the candidates."""
    rows = table(spark, d, "candidates")
    out = []
    for score in ("dense_score", "sparse_score"):
        known = rows.where(F.col(score).isNotNull() & ~F.isnan(score)).groupBy("question_id", "chunk_id").agg(F.max(score).alias("s"))
        out.append(search.best(known, ["question_id"], [F.desc("s"), F.asc("chunk_id")], 50).select("question_id", "chunk_id", "rank"))
    return out[0], out[1]


def fused_candidates(spark: SparkSession, d: str) -> DataFrame:
    long = lambda c: F.col(c).cast("bigint").alias(c)
    return search.fuse(*_lists(spark, d), "question_id", "chunk_id").select("question_id", "chunk_id", "score", long("dense_rank"), long("sparse_rank"), long("rank"))


def capped_candidates(spark: SparkSession, d: str) -> DataFrame:
    papers = table(spark, d, "candidates").groupBy("chunk_id").agg(F.min("paper_id").alias("paper_id"))
    ranked = search.fuse(*_lists(spark, d), "question_id", "chunk_id").join(papers, "chunk_id")
    return search.capped(ranked, "question_id", "paper_id", 2, 10).select("question_id", "chunk_id", "paper_id", F.col("rank").cast("bigint").alias("rank"))


def merged_evidence(spark: SparkSession, d: str) -> DataFrame:
    """At most 12 results per question: half from the dense list, half from the sparse one, the rest filled from both in order."""
    dense, sparse = _lists(spark, d)
    found = joins.budget_merge(dense, sparse, "question_id", "chunk_id", 12)
    return found.select("question_id", "chunk_id", F.col("rank").cast("bigint").alias("rank"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Per question what the fused search finds, what was rated high, and the three best rated."""
    top = search.fuse(*_lists(spark, d), "question_id", "chunk_id", k=10).groupBy("question_id").agg(F.expr("transform(array_sort(collect_list(struct(rank, chunk_id))), x -> x.chunk_id)").alias("got"))
    rated = table(spark, d, "candidates").where("rerank_score is not null and not isnan(rerank_score)").groupBy("question_id", "chunk_id").agg(F.max("rerank_score").alias("s"))
    ranked = search.best(rated, ["question_id"], [F.desc("s"), F.asc("chunk_id")], 5)
    gold = ranked.groupBy("question_id").agg(
        F.expr("array_sort(collect_list(case when s > 2 then chunk_id end))").alias("gold"), F.expr("transform(array_sort(collect_list(case when rank <= 3 then struct(rank, chunk_id) end)), x -> x.chunk_id)").alias("cited")
    )
    return table(spark, d, "questions").select("question_id", "category").join(top, "question_id", "left").join(gold, "question_id", "left")


def _measures(spark: SparkSession, d: str) -> DataFrame:
    got, gold, cited = F.col("got"), F.col("gold"), F.col("cited")
    measures = {
        "precision": nested.precision_at(got, gold, 10), "recall": nested.recall_at(got, gold, 10), "reciprocal_rank": nested.reciprocal_rank(got, gold), "ndcg": nested.ndcg_at(got, gold, 10),
        "citation_validity": nested.citation_validity(cited, got), "citation_recall": nested.citation_recall(cited, gold),
    }
    return _judged(spark, d).select("question_id", "category", *(F.round(m, 6).alias(n) for n, m in measures.items()))


def rank_metrics(spark: SparkSession, d: str) -> DataFrame:
    return _measures(spark, d)


def evaluation_report(spark: SparkSession, d: str) -> DataFrame:
    """Means per category over the questions that have a value, and the share of all questions with a hit."""
    rows = _measures(spark, d)
    means = [F.round(F.avg(m), 5).alias(m) for m in ("precision", "recall", "reciprocal_rank", "ndcg")]
    hit = F.when(F.coalesce("recall", F.lit(0.0)) > 0, 1.0).otherwise(0.0)
    return rows.groupBy("category").agg(F.count("*").alias("questions"), F.count("recall").alias("judged"), *means, F.round(F.avg(hit), 5).alias("success"))


def _evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first ten fused chunks of each question with their texts."""
    texts = _chunks(spark, d, "chunk_id", "title", "section_heading", "text").groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in ("title", "section_heading", "text")))
    return search.fuse(*_lists(spark, d), "question_id", "chunk_id", k=10).join(texts, "chunk_id")


def evidence_routes(spark: SparkSession, d: str) -> DataFrame:
    asked = table(spark, d, "questions").select("question_id", "question")
    scored = _evidence(spark, d).join(asked, "question_id").withColumn("grade", grading.grade(grading.overlap_score(F.col("question"), F.col("text"))))
    return grading.routes(scored, "question_id")


def evidence_contexts(spark: SparkSession, d: str) -> DataFrame:
    shown = grading.contexts(_evidence(spark, d), "question_id", "rank", "title", "section_heading", "text")
    return shown.select("question_id", F.md5("context").alias("context"), F.length("context").cast("bigint").alias("characters"))


def keyword_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Share of the long words of each reference answer that stand in the text of any of the first ten fused chunks."""
    asked = table(spark, d, "questions").select("question_id", F.explode(F.array_distinct(F.filter(text.words(F.col("reference_answer")), lambda w: F.length(w) >= 9))).alias("word"))
    texts = _chunks(spark, d, "chunk_id", "text").groupBy("chunk_id").agg(F.min("text").alias("text"))
    top = search.fuse(*_lists(spark, d), "question_id", "chunk_id", k=10).join(texts, "chunk_id").select("question_id", "text")
    each = asked.join(top, "question_id").groupBy("question_id", "word").agg(F.max(text.has_phrase(F.col("text"), F.col("word")).cast("int")).alias("hit"))
    return each.groupBy("question_id").agg(F.count("*").alias("words"), F.round(F.avg("hit"), 6).alias("coverage"))


def _answers(spark: SparkSession, d: str) -> DataFrame:
    """An answer per question: the text of its best fused chunk where the overlap of their words is fair, else none; with phrases that it must and must not have, and the decisions expected of it."""
    asked = table(spark, d, "questions").select("question_id", "question", "reference_answer", "category")
    texts = _chunks(spark, d, "chunk_id", "text").groupBy("chunk_id").agg(F.min("text").alias("text"))
    top = search.fuse(*_lists(spark, d), "question_id", "chunk_id", k=1).join(texts, "chunk_id").select("question_id", F.col("text").alias("answer"))
    rows = asked.join(top, "question_id", "left").withColumn("overlap", grading.overlap_score(F.col("question"), F.col("answer")))
    status = F.when(F.col("answer").isNull(), "failed").when(F.col("overlap") > 0.1, "accepted").otherwise("insufficient_evidence")
    return rows.select(
        "question_id", "answer", status.alias("status"), text.search_terms(F.col("question")).alias("required"),
        F.array_distinct(F.filter(text.words(F.col("reference_answer")), lambda w: F.length(w) >= 9)).alias("forbidden"), F.col("answer").isNotNull().alias("retrieved"), (F.col("overlap") == 0).alias("web"),
        (F.col("category") != "unanswerable").alias("needs_retrieval"), (F.col("category") == "time_bound").alias("needs_web"), (F.col("category") == "unanswerable").alias("expects_none"), (F.col("category") == "multi_hop").alias("accepts_none"),
    )


def answer_scores(spark: SparkSession, d: str) -> DataFrame:
    keywords = nested.keyword_coverage(F.col("answer"), F.col("required"), F.col("forbidden"))
    routed = nested.route_accuracy(F.col("retrieved"), F.col("web"), F.col("needs_retrieval"), F.col("needs_web"))
    done = nested.success(F.col("answer"), F.lit(None).cast("string"), F.col("status"), F.col("expects_none"), F.col("accepts_none"))
    return _answers(spark, d).select("question_id", "status", F.round(keywords, 6).alias("keyword_coverage"), routed.alias("route_accuracy"), done.alias("success"))


def candidate_reviews(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the label that the rerank score gives them, whether the dense score fits it, and the route that follows."""
    label = F.when(F.isnan("rerank_score"), None).when(F.col("rerank_score") >= 2, "relevant").when(F.col("rerank_score") >= 0, "ambiguous").when(F.col("rerank_score") < 0, "irrelevant")
    rows = table(spark, d, "candidates").select(label.alias("label"), F.when(~F.isnan("dense_score"), F.col("dense_score")).alias("score"))
    by = rows.select("label", grading.consistent(F.col("label"), F.col("score")).alias("fits"), grading.review_route(F.col("label"), F.col("score")).alias("route"))
    return by.groupBy("label", "fits", "route").agg(F.count("*").alias("candidates"))


def corpus_status(spark: SparkSession, d: str) -> DataFrame:
    """Are all works of the feed parsed or chunked, and all papers of documents parsed."""
    key = lambda t, c: table(spark, d, t).select(ids.work_id_anywhere(F.upper(c)).alias("key"))
    return grading.resolution(key("works", "id"), key("parsed_papers", "paper_id"), key("chunks", "paper_id"), key("documents", "paper_id"), "key")


def accepted_works(spark: SparkSession, d: str) -> DataFrame:
    """Works as they are discovered, one after the other: a known id, or else the DOI of an accepted work, adds its queries to that work."""
    works = table(spark, d, "works").select("record_id", F.nullif(ids.work_id(F.col("id")), F.lit("")).alias("work"), ids.plain_doi(F.col("doi")).alias("doi"), F.array_join("matched_queries", "|").alias("queries"))
    return dedup.accepted_records(works, "record_id", ["work", "doi"], "queries").select("record_id", F.array_join("values", "||").alias("queries"), F.col("matches").cast("bigint").alias("matches"))


def question_signs(spark: SparkSession, d: str) -> DataFrame:
    """Which questions ask for recent evidence, and their answers with the ids of their three best candidates cited and with one unknown id found out."""
    rows = _judged(spark, d).select("question_id", "cited").join(table(spark, d, "questions").select("question_id", "question", "reference_answer"), "question_id")
    cited = F.coalesce("cited", F.expr("cast(array() as array<string>)"))
    unknown = nested.unknown_citations(F.concat(cited, F.array(F.lit("none"))), cited)
    return rows.select(
        "question_id", ids.asks_for_recent(F.col("question")).alias("recent"), F.md5(nested.with_citations(F.coalesce("reference_answer", F.lit("")), cited)).alias("answer"), F.array_join(unknown, "|").alias("unknown"),
        F.array_join(nested.valid_indexes(F.array(F.lit(-1), F.lit(1), F.lit(1), F.size(cited), F.lit(0)), F.size(cited)), "|").alias("indexes"),
    )


def paper_identities(spark: SparkSession, d: str) -> DataFrame:
    """One identity for each record of works and parsed papers, and addresses without keys."""
    works = table(spark, d, "works").select("record_id", F.col("id").alias("a"), F.lit(None).cast("string").alias("b"), "doi", "title", F.col("best_oa_location.pdf_url").alias("url"))
    papers = table(spark, d, "parsed_papers").select("record_id", F.lit(None).cast("string").alias("a"), F.col("paper_id").alias("b"), "doi", "title", F.col("source_path").alias("url"))
    rows = works.unionByName(papers)
    keyed = F.concat(F.coalesce("url", F.lit("")), F.lit("?api_key=secret&x=1"))
    return rows.select("record_id", ids.identity(F.col("a"), F.col("b"), F.col("doi"), F.col("title")).alias("identity"), text.redacted(keyed).alias("address"), ids.pmc_id(F.concat(F.lit(" pmc"), F.col("record_id"))).alias("pmc"))


# evidence, runs and files


def reranked_search(spark: SparkSession, d: str) -> DataFrame:
    """The fused candidates of each question in order of a second score over what an encoder reads of them, then at most two of a paper and ten in all."""
    texts = _chunks(spark, d, "chunk_id", "title", "section_heading", "text").groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in ("title", "section_heading", "text")))
    papers = table(spark, d, "candidates").groupBy("chunk_id").agg(F.min("paper_id").alias("paper_id"))
    asked = table(spark, d, "questions").select("question_id", "question")
    rows = search.fuse(*_lists(spark, d), "question_id", "chunk_id").join(papers, "chunk_id").join(asked, "question_id").join(texts, "chunk_id", "left")
    read = text.embedding_text(F.col("title"), F.col("section_heading"), F.col("text"))
    scored = rows.withColumn("rerank_score", F.when(F.col("text").isNotNull(), grading.overlap_score(F.col("question"), read)))
    found = search.capped(search.reranked(scored, "question_id"), "question_id", "paper_id", 2, 10)
    return found.select("question_id", "chunk_id", "paper_id", F.round("rerank_score", 6).alias("rerank_score"), F.col("rank").cast("bigint").alias("rank"))


def evidence_documents(spark: SparkSession, d: str) -> DataFrame:
    """The first ten fused chunks of each question as evidence with the address of their paper."""
    papers = table(spark, d, "chunks").groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in ("paper_id", "title", "doi", "publication_year", "publication_date")))
    rows = search.fuse(*_lists(spark, d), "question_id", "chunk_id", k=10).join(papers, "chunk_id")
    found = evidence.as_evidence(rows, "chunk_id", "paper_id", "https://works.example/")
    return found.select("question_id", "source_id", "paper_id", "url", "title", "doi", F.col("publication_year").cast("bigint").alias("publication_year"), "publication_date", F.col("rank").cast("bigint").alias("rank"))


def web_sources(spark: SparkSession, d: str) -> DataFrame:
    """Landing pages of works as web results whose content is the abstract."""
    works = table(spark, d, "works").withColumn("content", nested.abstract_text(F.col("abstract_inverted_index")))
    pages = works.select("record_id", "title", "content", F.posexplode("locations").alias("pos", "l")).select("record_id", "pos", "title", "content", F.col("l.landing_page_url").alias("url"))
    found = evidence.web_evidence(pages, "url", "title", "content", ["record_id", "pos"], 400)
    return found.select("source_id", "url", "title", F.md5("text").alias("text"))


def _top(spark: SparkSession, d: str) -> DataFrame:
    return search.fuse(*_lists(spark, d), "question_id", "chunk_id", k=10).select("question_id", "chunk_id", "rank")


def graded_evidence(spark: SparkSession, d: str) -> DataFrame:
    """The first ten fused chunks of each question with grades that were given under ids cut after 26 characters; the first grade counts, a chunk without one is ambiguous."""
    label = F.when(F.col("rerank_score") >= 2, "correct").when(F.col("rerank_score") >= 0, "ambiguous").otherwise("incorrect")
    rated = table(spark, d, "candidates").where("rerank_score is not null and not isnan(rerank_score)")
    grades = rated.select("question_id", F.left("chunk_id", F.lit(26)).alias("given"), "cand_id", label.alias("grade"))
    found = evidence.graded(_top(spark, d), grades, ["question_id"], "chunk_id", "given", "cand_id", "grade", "ambiguous")
    return found.select("question_id", "chunk_id", "grade", F.col("rank").cast("bigint").alias("rank"))


def answer_citations(spark: SparkSession, d: str) -> DataFrame:
    """The papers behind the three best rated chunks of each question, by the last of its candidates that has a paper; one more source that is none of them is missing."""
    rows = table(spark, d, "candidates").where("paper_id is not null").select("question_id", "chunk_id", "cand_id", "paper_id")
    asked = _judged(spark, d).select("question_id", F.concat(F.array(F.lit("none")), F.coalesce("cited", F.expr("cast(array() as array<string>)"))).alias("cited"))
    found = evidence.citations(asked, rows, "question_id", "cited", "chunk_id", "cand_id", ["paper_id"])
    return found.select(
        "question_id", F.array_join(F.transform("citations", lambda c: c["source_id"]), "|").alias("sources"), F.array_join(F.transform("citations", lambda c: c["paper_id"]), "|").alias("papers"), F.array_join("missing", "|").alias("missing")
    )


def answer_checks(spark: SparkSession, d: str) -> DataFrame:
    """Reference answers that cite the two best rated chunks and declare three, with those rated high as evidence: what is wrong with them, and the labels that come of both lists."""
    rows = _judged(spark, d).join(table(spark, d, "questions").select("question_id", "reference_answer"), "question_id")
    answer = nested.with_citations(F.coalesce("reference_answer", F.lit("")), F.slice("cited", 1, 2))
    return rows.select("question_id", nested.answer_problem(answer, F.col("cited"), F.col("gold")).alias("problem"), F.coalesce(F.array_join(nested.united(F.col("cited"), F.col("gold")), "|"), F.lit("")).alias("labels"))


def question_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Per question: does it ask for what came after the corpus, is any of its ten fused chunks from the window, what a reply about them may take, and the first three texts cut short."""
    chunks = _chunks(spark, d, "chunk_id", "text", "publication_date", "publication_year")
    texts = chunks.groupBy("chunk_id").agg(*(F.min(c).alias(c) for c in ("text", "publication_date", "publication_year")))
    recent = ids.in_window(ids.iso_date(F.col("publication_date")), F.col("publication_year"), *WINDOW)
    rows = _top(spark, d).join(texts, "chunk_id").groupBy("question_id").agg(
        F.bool_or(recent).alias("recent"), nested.output_budget(F.count("*")).alias("budget"), F.transform(F.array_sort(F.collect_list(F.struct("rank", "text"))), lambda s: s["text"]).alias("texts")
    )
    shown = F.md5(F.array_join(nested.first_shortened(F.col("texts"), 3, 2000), "\n"))
    asked = table(spark, d, "questions").select("question_id", ids.asks_for_fresh(F.col("question")).alias("fresh"))
    return asked.join(rows, "question_id", "left").select("question_id", "fresh", F.coalesce("recent", F.lit(False)).alias("recent"), "budget", shown.alias("shown"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Candidates as records of runs: one that is loaded a day late counts as failed, a score that is NaN has an error."""
    names = ("dense_score", "sparse_score", "rerank_score")
    rows = table(spark, d, "candidates").select("question_id", F.array_join("sources", "+").alias("run"), "cand_id", "chunk_id", "retrieved_at", "loaded_at", *names).distinct()
    error = F.when(F.col("loaded_at") >= F.col("retrieved_at") + F.expr("interval 1 day"), "late")
    scores = F.when(F.coalesce(*names).isNotNull(), F.create_map(*(c for n in names for c in (F.lit(n), nested.known(F.col(n))))))
    bad = F.filter(F.array(*(F.when(F.isnan(n), F.lit(n)) for n in names)), lambda n: n.isNotNull())
    errors = F.map_from_arrays(bad, F.transform(bad, lambda n: F.lit("not a number")))
    return rows.select("run", "question_id", "cand_id", F.col("chunk_id").alias("answer"), error.alias("error"), scores.alias("scores"), errors.alias("errors"))


def compacted_runs(spark: SparkSession, d: str) -> DataFrame:
    """The last record of each run and question, where it was first seen, and what it still lacks."""
    last = runs.compacted(_runs(spark, d), ["run", "question_id"], "cand_id")
    of = [F.col(c) for c in ("error", "answer", "scores", "errors")]
    return last.select("run", "question_id", "cand_id", "first_place", F.array_join(runs.missing_scores(*of, ["dense_score", "sparse_score", "rerank_score"]), "|").alias("missing"), runs.completed(*of).alias("completed"))


def open_runs(spark: SparkSession, d: str) -> DataFrame:
    """Which questions each kind of run has not completed."""
    last = runs.compacted(_runs(spark, d), ["run", "question_id"], "cand_id")
    done = last.where(runs.completed(*(F.col(c) for c in ("error", "answer", "scores", "errors"))))
    return runs.open_pairs(table(spark, d, "questions"), "question_id", RUNS, done, "run")


def query_places(spark: SparkSession, d: str) -> DataFrame:
    """The place of each work among the results of each query that found it, in order of record."""
    found = table(spark, d, "works").select("record_id", F.posexplode("matched_queries").alias("pos", "query"))
    return dedup.numbered_within(found, "query", ["record_id", "pos"], "place").select("query", "record_id", "pos", "place").withColumn("pos", F.col("pos").cast("bigint"))


def title_controls(spark: SparkSession, d: str) -> DataFrame:
    """The first hundred distinct titles with a term of the domain, works before parsed papers: a top-k report."""
    title = F.lower(text.squeeze(F.col("title")))
    sides = []
    for name in ("works", "parsed_papers"):
        rows = table(spark, d, name).select("record_id", title.alias("key"))
        sides.append(rows.where(F.size(selection.hits(F.col("key"), ON_TOPIC)) > 0))
    return dedup.ordered_union(*sides, ["key"], [F.col("record_id")]).orderBy("side", "record_id").limit(100).select(F.col("side").cast("bigint").alias("side"), "record_id", "key")


def refreshed_works(spark: SparkSession, d: str) -> DataFrame:
    """Works with title, DOI and language of the last line of the feed about them, where that names these fields."""
    fields = ["title", "doi", "language"]
    lines = table(spark, d, "raw_lines").where("feed = 'works'").withColumn("present", F.json_object_keys("payload"))
    fresh = field_texts(lines, "payload", ["id", *fields], ["record_id", "loaded_at", "present"]).withColumn("work", F.nullif(ids.work_id(F.col("id")), F.lit(""))).where("work is not null")
    works = table(spark, d, "works").select("record_id", ids.work_id(F.col("id")).alias("work"), *fields)
    return joins.overlaid(works, ingest.latest(fresh, ["work"], "loaded_at", "record_id").select("work", "present", *fields), "work", fields, "present").drop("work")


def enrichment_report(spark: SparkSession, d: str) -> DataFrame:
    """How many papers have a work with open PDF addresses: the last delivery of each work counts."""
    works = table(spark, d, "works").select("record_id", F.nullif(ids.work_id(F.col("id")), F.lit("")).alias("work"), "best_oa_location", "locations").where("work is not null")
    last = runs.compacted(works, ["work"], "record_id")
    urls = ids.open_pdf_urls(F.col("best_oa_location"), F.col("locations"))
    any_ = F.count_if(F.size(urls) > 0)
    counts = last.agg(F.count("*").alias("enriched"), F.count_if(F.coalesce(F.col("best_oa_location.pdf_url"), F.lit("")) != "").alias("with_best_pdf"), any_.alias("with_any_pdf"), (F.count("*") - any_).alias("without_pdf"))
    total = table(spark, d, "parsed_papers").count()
    remaining = F.greatest(F.lit(total) - F.col("enriched"), F.lit(0))
    return counts.select(F.lit(total).cast("bigint").alias("papers"), "*", remaining.cast("bigint").alias("remaining"), F.when(remaining == 0, "complete").otherwise("partial").alias("status"))


def _local_files(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Works by id, their PDF addresses as files that are valid if open, and the XML files of parsed papers, valid if they gave text."""
    works = table(spark, d, "works").withColumn("work", ids.work_id_anywhere(F.upper("id")))
    places = works.select("work", F.explode("locations").alias("l")).where("l.pdf_url is not null")
    open_ = F.coalesce("l.is_oa", F.lit(False))
    pdfs = places.select("work", F.col("l.pdf_url").alias("path"), F.lit("pdf").alias("kind"), open_.alias("valid"), F.when(open_, "valid").otherwise("closed").alias("reason"))
    papers = table(spark, d, "parsed_papers").where("source_path is not null")
    full = F.coalesce("character_count", F.lit(0)) > 0
    name = ids.work_id_anywhere(F.regexp_extract("source_path", r"[^/]*$", 0))
    kind = F.when(F.col("source_format") == "jats_xml", "jats").when(F.col("source_format") == "grobid_tei", "tei")
    xmls = papers.select(name.alias("work"), F.col("source_path").alias("path"), kind.alias("kind"), full.alias("valid"), F.when(full, "valid").otherwise("no text").alias("reason"))
    return works.select("record_id", "work"), pdfs, xmls


def local_inventory(spark: SparkSession, d: str) -> DataFrame:
    """Each work with the PDF and the XML file chosen for it."""
    works, pdfs, xmls = _local_files(spark, d)
    return xml_papers.local_inventory(works, "work", pdfs, xmls)


def local_audit(spark: SparkSession, d: str) -> DataFrame:
    """Counts of the inventory, and of files that belong to no work."""
    works, pdfs, xmls = _local_files(spark, d)
    of = lambda c: F.count_if(F.col("content") == c)
    rows = xml_papers.local_inventory(works, "work", pdfs, xmls)
    counts = rows.agg(F.count("*").alias("records"), F.count_if(F.col("work").isNull()).alias("without_id"), of("pdf").alias("pdf_only"), of("jats").alias("jats_only"), of("tei").alias("tei_only"), of("pdf and xml").alias("both"), of("missing").alias("missing"))
    lost = xml_papers.orphans(works, "work", pdfs, xmls).agg(F.count("*").alias("orphans"))
    long = lambda t: t.select(F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(c).alias("n")) for c in t.columns))).alias("r")).select("r.*")
    return long(counts).unionByName(long(lost))


def grading_totals(spark: SparkSession, d: str) -> DataFrame:
    """Candidates by the route that their scores lead to, against a target of 100,000."""
    label = F.when(F.isnan("rerank_score"), None).when(F.col("rerank_score") >= 2, "relevant").when(F.col("rerank_score") >= 0, "ambiguous").when(F.col("rerank_score") < 0, "irrelevant")
    rows = table(spark, d, "candidates").select(grading.review_route(label, nested.known(F.col("dense_score"))).alias("route"))
    return grading.route_counts(rows, "route", 100_000).withColumn("lacking", F.col("lacking").cast("bigint"))


def page_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Addresses of best locations with another key, as ids and by host, and ids from whichever field has one."""
    rows = table(spark, d, "works").select("record_id", "id", "doi", "has_content", F.col("best_oa_location.pdf_url").alias("url"), F.col("best_oa_location.license").alias("license"))
    old = F.concat("url", F.lit("?x=1&api_key=old&y=#top"))
    keyed = ids.keyed_url(F.col("has_content.pdf"), F.col("url"), "preprints.example", "api_key", F.lit("k 1"))
    headers = F.create_map(F.lit("left"), F.concat(F.lit(" "), F.col("record_id").cast("string"), F.when(F.col("record_id") % 3 == 0, "x").otherwise("")))
    return rows.select(
        "record_id", ids.web_source_id(F.col("url")).alias("page"), ids.with_parameter(old, "api_key", F.lit("k 1")).alias("address"), keyed.alias("keyed"), ids.first_work_id(F.lit(None).cast("string"), F.col("doi"), F.col("id")).alias("work"),
        ids.header_number(headers, "left").alias("left"),
    )


def limited_payloads(spark: SparkSession, d: str) -> DataFrame:
    """Titles and DOIs of all valid lines, cut where they are longer than 40 and 20 characters."""
    lines = table(spark, d, "raw_lines").where(is_json_object(F.col("payload")))
    row = lines.select("record_id", nested.limited(F.from_json("payload", "title string, doi string"), {"title": 40, "doi": 20}).alias("v"))
    return row.select("record_id", "v.title", "v.doi")


# files that operators write and read again


def _in_folder(spark: SparkSession, use: Callable[[str], DataFrame]) -> DataFrame:
    """What ``use`` makes of a folder of its own, which is removed after."""
    home = f"{shared_folder(spark)}/files-{uuid.uuid4().hex}"
    try:
        return cut(use(home))
    finally:
        remove(spark, home)


def jsonl_records(spark: SparkSession, d: str) -> DataFrame:
    """Documents written as JSON lines and read again with their schema."""
    rows = table(spark, d, "documents").select("doc_id", "text", "lang", "source", "publication_year")

    def use(home: str) -> DataFrame:
        files.write_jsonl(rows, home)
        return files.read_jsonl(spark, home, rows.schema).select("doc_id", F.md5("text").alias("text"), "lang", "source", F.col("publication_year").cast("bigint").alias("publication_year"))

    return _in_folder(spark, use)


def appended_lines(spark: SparkSession, d: str) -> DataFrame:
    """The lines of one feed, then those of both, appended by key to the same files."""
    lines = table(spark, d, "raw_lines").select("record_id", "feed", "payload")

    def use(home: str) -> DataFrame:
        added = [files.append_new(rows, home, ["record_id"]) for rows in (lines.where("feed = 'works'"), lines, lines)]
        counts = files.read_jsonl(spark, home, lines.schema).groupBy("feed").agg(F.count("*").alias("lines"), F.sum(F.length("payload")).cast("bigint").alias("characters"))
        return counts.select("*", *(F.lit(n).cast("bigint").alias(f"added_{k}") for k, n in enumerate(added)))

    return _in_folder(spark, use)


def checked_examples(spark: SparkSession, d: str) -> DataFrame:
    """Questions written as a data set and read with the check of their keys, easy ones alone."""
    rows = table(spark, d, "questions")

    def use(home: str) -> DataFrame:
        files.write_jsonl(rows, home)
        return files.read_examples(spark, home, "question_id string, question string, category string, difficulty string", difficulty="easy")

    return _in_folder(spark, use)


def stored_report(spark: SparkSession, d: str) -> DataFrame:
    """The counts of the audit, written as a report and read again."""
    counts = audit_counts(spark, d)

    def use(home: str) -> DataFrame:
        files.write_report(counts, f"{home}/report.json")
        return spark.read.schema(counts.schema).option("multiLine", True).json(f"{home}/report.json")

    return _in_folder(spark, use)


def files_by_id(spark: SparkSession, d: str) -> DataFrame:
    """Paths of parsed papers by the work id in their name."""
    found = xml_papers.file_index(table(spark, d, "parsed_papers").select(F.col("source_path").alias("path")).distinct(), ".XML")
    return found.select("work_id", F.array_join("paths", "|").alias("paths"))


def pdf_checks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as bytes, those of even id with the first bytes of a PDF: why each is no usable one."""
    made = F.encode(F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("%PDF-1.7 "), "text")).otherwise(F.col("text")), "UTF-8")
    return table(spark, d, "documents").select("doc_id", made.alias("content")).select("doc_id", xml_papers.pdf_problem(F.col("content"), F.length("content"), 500).alias("problem"))


def xml_checks(spark: SparkSession, d: str) -> DataFrame:
    """Papers as JATS, some cut off, emptied, inside another element or of another kind: the reason why there is no paper, or its format."""
    kind = F.col("record_id") % 4
    broken = F.when(kind == 0, F.expr("left(xml, length(xml) - 5)")).when(kind == 1, "").when(kind == 2, F.concat(F.lit("<other>"), "xml", F.lit("</other>"))).otherwise("<other><body/></other>")
    rows = xml_papers.as_jats(table(spark, d, "parsed_papers")).withColumn("xml", broken)
    return xml_papers.parse_papers(rows, "record_id", "paper_id", "xml").select("record_id", "paper.format", "paper.problem")


def merged_papers(spark: SparkSession, d: str) -> DataFrame:
    """DOI and year of parsed XML with those of the last work of the same id before them."""
    works = table(spark, d, "works").select(F.nullif(ids.work_id(F.col("id")), F.lit("")).alias("work"), "record_id", "doi", "publication_year").where("work is not null")
    last = runs.compacted(works, ["work"], "record_id").select("work", "doi", "publication_year")
    papers = table(spark, d, "parsed_papers").select("record_id", ids.work_id_anywhere(F.upper("paper_id")).alias("work"))
    records = papers.join(last, "work", "left").select("record_id", F.lit(None).cast("string").alias("title"), F.lit(None).cast("string").alias("abstract"), "doi", "publication_year")
    parsed = xml_papers.parse_papers(xml_papers.as_jats(table(spark, d, "parsed_papers")), "record_id", "paper_id", "xml")
    found = xml_papers.merged_metadata(parsed, records, "record_id")
    return found.select("record_id", "doi", F.col("publication_year").cast("bigint").alias("publication_year"), "problem")


def _shared_words(queries: pd.Series, texts: pd.Series) -> pd.Series:
    """A scorer as a model would be one: the share of a query's distinct words that the text has."""
    split = lambda t: set(re.findall(r"\w+", (t or "").lower()))
    return pd.Series([len(q & split(t)) / len(q) if (q := split(a)) else 0.0 for a, t in zip(queries, texts)])


def model_scores(spark: SparkSession, d: str) -> DataFrame:
    """The first ten fused chunks of each question, scored in Arrow batches and graded."""
    asked = table(spark, d, "questions").select("question_id", "question")
    rows = _evidence(spark, d).join(asked, "question_id").select("question_id", "chunk_id", "question", "text")
    found = grading.scored_by(rows, "question", "text", _shared_words)
    return found.select("question_id", "chunk_id", F.round("score", 6).alias("score"), grading.grade(F.col("score")).alias("grade"), "error")


def rescored_runs(spark: SparkSession, d: str) -> DataFrame:
    """Records of runs whose failed second score has been made up for: names of the scores and of the errors that are left."""
    again = F.when(F.map_contains_key("errors", "rerank_score"), F.create_map(F.lit("rerank_score"), F.lit(0.0)))
    both = grading.merged_scores(F.col("scores"), again, F.col("errors"), F.lit(None).cast("map<string,string>"))
    names = lambda c: F.array_join(F.array_sort(F.map_keys(c)), "|")
    return _runs(spark, d).select("cand_id", both.alias("b")).select("cand_id", names(F.col("b.scores")).alias("scores"), names(F.col("b.errors")).alias("errors"), F.coalesce(F.try_element_at("b.scores", F.lit("rerank_score")), F.lit(-99.0)).alias("rerank_score"))


def journal_addresses(spark: SparkSession, d: str) -> DataFrame:
    """Short names of the journals of best locations, and the addresses that follow from the first guess, year and number of a work."""
    rows = table(spark, d, "works").select("record_id", "doi", "publication_year", F.col("best_oa_location.source.display_name").alias("journal"), F.col("best_oa_location.pdf_url").alias("url"))
    slugs = ids.slug_candidates(F.col("journal"), F.col("doi"), JOURNALS, "10[.]98[0-9]+")
    made = F.concat(F.lit("https://Archive.example/1234-567X/"), F.col("publication_year").cast("string"), F.lit("/1/"), F.col("record_id").cast("string"), F.lit("/pdf?v=1"))
    parts = ids.article_parts(made, ["archive.example"])
    address = ids.deployed_address("https://files.example/d/", F.get(slugs, F.lit(0)), parts["volume"] % 100, parts["article"])
    return rows.select("record_id", F.array_join(slugs, "|").alias("slugs"), ids.host_in(F.col("url"), ["archive.example", "repo.example"]).alias("here"), address.alias("address"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = (
        hybrid_search, bm25_topk, stemmed_topk, corrected_search, nearest_vectors, fused_candidates, capped_candidates, merged_evidence, rank_metrics, evaluation_report, keyword_coverage, answer_scores, candidate_reviews, corpus_status, accepted_works, question_signs, paper_identities, evidence_routes, evidence_contexts,
        p3_found, p3_locations, p3_issn, p3_lineage, p3_best_oa_location, p3_open_access, p3_abstract_words, token_counts, last_tokens, work_identifiers, title_keys, abstracts, paper_texts, encoder_texts, open_pdf_urls, url_hosts, date_windows,
        section_profile, window_chunks, sentence_chunks, chunk_report, chunk_profile, parsed_xml, discovery_dedup, latest_candidates, greedy_dedup, parsed_union, numbered_chunks,
        paper_dates, dated_chunks, coverage, repaired_ids, screening, remaining_chunks, relevance_scores, failure_counts, score_histogram, selection_decisions, best_works, discovery_report, audit_counts, index_terms,
        event_windows, ingested_lines, reranked_search, evidence_documents, web_sources, graded_evidence, answer_citations, answer_checks, question_evidence, compacted_runs, open_runs, query_places, title_controls,
        refreshed_works, enrichment_report, local_inventory, local_audit, grading_totals, page_addresses, limited_payloads,
        jsonl_records, appended_lines, checked_examples, stored_report, files_by_id, pdf_checks, xml_checks, merged_papers, model_scores, rescored_runs, journal_addresses,
    )
    return {f.__name__: f for f in found}
