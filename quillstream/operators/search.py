"""Lexical, vector and hybrid search over batches of queries."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillstream.functions.stem import stemmed
from quillstream.functions.text import search_terms, words
from quillstream.runtime import cut, exists, file_states, remove, rename, shared_folder

K1, B, LEAST_IDF = 1.2, 0.75, 1e-6
FEW_TERMS = 100_000  # terms that are broadcast at most


@dataclass(frozen=True)
class Index:
    """Stored postings of a corpus (``term, d, tf, len``), the number of documents of each term (``term, df``), and the number and mean length of the documents."""

    postings: DataFrame
    terms: DataFrame
    documents: int
    mean: float
    stems: bool


def build_index(docs: DataFrame, doc: str, text: str, path: str, stems: bool = False) -> None:
    """Write the postings of all documents to a new folder: the texts are read and counted once, and searches read only what is stored. ``doc`` must be unique.

    Lengths count all words. With ``stems`` the counts of words with the same stem are added up. Null and empty texts have no postings but count as documents.
    """
    spark = docs.sparkSession
    # texts are shuffled by document, which is less than their counted words; the counts of a document then stay where they are
    sized = docs.select(F.col(doc).alias("d"), F.col(text).alias("t")).repartition("d").select("d", words(F.coalesce("t", F.lit(""))).alias("words"))
    counts = sized.select("d", F.size("words").alias("len"), F.explode_outer("words").alias("term")).groupBy("d", "len", "term").agg(F.count("*").alias("tf"))
    if stems:
        counts = counts.withColumn("term", stemmed(F.col("term"))).groupBy("d", "len", "term").agg(F.sum("tf").alias("tf"))
    counts.write.parquet(f"{path}/postings")
    held = spark.read.parquet(f"{path}/postings")
    held.where("term is not null").groupBy("term").agg(F.count("*").alias("df")).write.parquet(f"{path}/terms")
    each = held.groupBy("d").agg(F.first("len").alias("len"))
    each.agg(F.count("*").alias("documents"), F.coalesce(F.avg("len"), F.lit(0.0)).alias("mean"), F.lit(stems).alias("stems")).write.parquet(f"{path}/corpus")


def open_index(spark: SparkSession, path: str) -> Index:
    corpus = spark.read.parquet(f"{path}/corpus").first()
    return Index(spark.read.parquet(f"{path}/postings").where("term is not null"), spark.read.parquet(f"{path}/terms"), corpus["documents"], corpus["mean"] or 1.0, corpus["stems"])


def stored_index(spark: SparkSession, source: str, make: Callable[[], DataFrame], doc: str, text: str, stems: bool = False) -> Index:
    """The index of the table at ``source``, built in the shared folder if there is none of its files as they are now: their names, sizes and times are part of its name."""
    name = hashlib.md5(repr((source, file_states(spark, source), stems)).encode()).hexdigest()
    path = f"{shared_folder(spark)}/index-{name}"
    if not exists(spark, f"{path}/corpus/_SUCCESS"):
        part = f"{path}-{uuid.uuid4().hex}"
        build_index(make(), doc, text, part, stems)
        if not rename(spark, part, path):  # another job was first
            remove(spark, part)
    return open_index(spark, path)


def bm25_of(index: Index, queries: DataFrame, qid: str, query: str, doc: str, k: int = 50) -> DataFrame:
    """``qid, doc, score, rank``: the ``k`` best documents of each query by BM25 over lower-case words or their stems, ties by smaller ``doc``.

    Only the postings of the queries' terms are scored. Queries without words find nothing.
    """
    terms = queries.select(F.col(qid).alias("q"), F.explode(search_terms(F.col(query))).alias("term"))
    if index.stems:
        terms = terms.withColumn("term", stemmed(F.col("term"))).distinct()
    asked = cut(terms.join(index.terms, "term"))
    wanted = asked.select("term").distinct()
    postings = index.postings.join(F.broadcast(wanted) if wanted.count() <= FEW_TERMS else wanted, "term", "left_semi")
    idf = F.greatest(F.log((F.lit(index.documents) - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    weight = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / index.mean))
    scored = asked.join(postings, "term").groupBy("q", "d").agg(F.round(F.sum(weight), 6).alias("score"))
    return best(scored, ["q"], [F.desc("score"), F.asc("d")], k).select(F.col("q").alias(qid), F.col("d").alias(doc), "score", "rank")


@contextmanager
def own_index(docs: DataFrame, doc: str, text: str, stems: bool = False) -> Iterator[Index]:
    """An index for one search alone, removed at the end."""
    spark = docs.sparkSession
    path = f"{shared_folder(spark)}/index-{uuid.uuid4().hex}"
    build_index(docs, doc, text, path, stems)
    try:
        yield open_index(spark, path)
    finally:
        remove(spark, path)


def bm25(queries: DataFrame, docs: DataFrame, qid: str, query: str, doc: str, text: str, k: int = 50, stems: bool = False) -> DataFrame:
    """``bm25_of`` over documents without a stored index."""
    with own_index(docs, doc, text, stems) as index:
        return cut(bm25_of(index, queries, qid, query, doc, k))


def best(df: DataFrame, group: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank; rows beyond never leave their map task."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col(name) <= k)


def usable(vector: Column, dim: int) -> Column:
    """``dim`` finite entries, not all zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == dim) & finite & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(column: pa.ChunkedArray, dim: int) -> np.ndarray:
    x = column.combine_chunks().flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x /= np.abs(x).max(1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def nearest(queries: DataFrame, corpus: DataFrame, qid: str, qvec: str, doc: str, vec: str, k: int = 50, dim: int = 64, block: int = 65_536, others_only: bool = False) -> DataFrame:
    """``qid, doc, cosine, rank``: the ``k`` most similar vectors of each query, exact, ties by smaller ``doc``.

    Blocks of the corpus meet blocks of queries as matrices; from each block only its ``k`` best leave. The work is queries times vectors, so this is
    for query sets that are stated and small against the corpus. Unusable vectors (see ``usable``) are left out, repeated ids count once.
    ``others_only``: a query does not find the vector of its own id.
    """
    side = lambda d, i, v, a: d.where(usable(F.col(v), dim)).select(F.col(i).alias(a), F.col(v).cast("array<double>").alias("v")).dropDuplicates([a])
    asked, held = side(queries, qid, qvec, "q"), side(corpus, doc, vec, "d")
    total = corpus.count()
    parts = max(1, -(-total // block), min(corpus.sparkSession.sparkContext.defaultParallelism, total // 2048))
    blocks = max(1, -(-queries.count() // block))
    cell = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("block", cell("q", blocks)).withColumn("part", every(parts))
    right = held.withColumn("part", cell("d", parts)).withColumn("block", every(blocks))
    q_type, d_type = (t.schema[c].dataType.simpleString() for t, c in ((asked, "q"), (held, "d")))

    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        qs, ds = a.column("q").combine_chunks(), b.column("d").combine_chunks()
        schema = pa.schema([("q", qs.type), ("d", ds.type), ("cosine", pa.float64())])
        if not len(qs) or not len(ds):
            return schema.empty_table()
        b = b.sort_by("d")
        ds = b.column("d").combine_chunks()
        x, y = _unit(a.column("v"), dim), _unit(b.column("v"), dim)
        names_q, names_d = qs.to_numpy(zero_copy_only=False), ds.to_numpy(zero_copy_only=False)
        out = []
        for at in range(0, len(x), 128):
            sims = np.round(x[at : at + 128] @ y.T, 9)
            if others_only:
                sims[names_q[at : at + 128, None] == names_d[None, :]] = -9
            for r in range(len(sims)):
                edge = np.partition(sims[r], -min(k, len(y)))[-min(k, len(y))]
                near = np.flatnonzero(sims[r] >= edge)  # ties with the k-th in order of id
                near = near[np.argsort(-sims[r][near], kind="stable")][:k]
                near = near[sims[r][near] > -2]
                out.append((np.full(len(near), at + r), near, sims[r][near]))
        rows, near, cos = (np.concatenate(o) for o in zip(*out))
        return pa.table([qs.take(pa.array(rows)), ds.take(pa.array(near)), pa.array(cos)], schema=schema)

    found = left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(run, f"q {q_type}, d {d_type}, cosine double")
    return best(found, ["q"], [F.desc("cosine"), F.asc("d")], k).select(F.col("q").alias(qid), F.col("d").alias(doc), "cosine", "rank")


def fuse(dense: DataFrame, sparse: DataFrame, qid: str, doc: str, rrf_k: int = 60, k: int = 30) -> DataFrame:
    """``qid, doc, dense_rank, sparse_rank, score, rank``: reciprocal rank fusion of two ranked lists; of equal scores the better dense rank, then the better sparse rank comes first."""
    if rrf_k <= 0:
        raise ValueError("rrf_k must be positive")
    both = dense.select(qid, doc, F.col("rank").alias("dense_rank")).join(sparse.select(qid, doc, F.col("rank").alias("sparse_rank")), [qid, doc], "full_outer")
    part = lambda c: F.coalesce(1.0 / (rrf_k + F.col(c)), F.lit(0.0))
    scored = both.withColumn("score", F.round(part("dense_rank") + part("sparse_rank"), 9))
    return best(scored, [qid], [F.desc("score"), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("sparse_rank"), F.asc(doc)], k)


def capped(ranked: DataFrame, qid: str, group: str, cap: int = 2, k: int = 10) -> DataFrame:
    """The first ``k`` of each query with at most ``cap`` of one group; null groups are one group. ``rank`` starts anew."""
    few = best(ranked, [qid, group], [F.asc("rank")], cap, "__in_group").drop("__in_group").withColumnRenamed("rank", "__before")
    return best(few, [qid], [F.asc("__before")], k).drop("__before")


def reranked(ranked: DataFrame, qid: str, score: str = "rerank_score", before: str = "score") -> DataFrame:
    """Results in order of a second score; those without one, or with NaN, take part with the score ``before``, and ties keep their rank. ``rank`` starts anew."""
    order = [F.desc(F.coalesce(F.when(~F.isnan(score), F.col(score)), F.col(before))), F.asc("__before")]
    return ranked.withColumnRenamed("rank", "__before").withColumn("rank", F.row_number().over(Window.partitionBy(qid).orderBy(*order))).drop("__before")


def relevance_vectors(found: DataFrame, chunks: DataFrame, qid: str, doc: str, vec: str, first: int = 5, dim: int = 64) -> DataFrame:
    """A vector per query without an encoder: the mean of the vectors of its first lexical hits."""
    hits = found.where(F.col("rank") <= first).join(chunks.where(usable(F.col(vec), dim)).select(doc, vec), doc)
    each = hits.select(qid, F.posexplode(vec).alias("at", "x")).groupBy(qid, "at").agg(F.avg("x").alias("x"))
    return each.groupBy(qid).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "x"))), lambda s: s["x"]).alias("query_vector"))


def hybrid(queries: DataFrame, chunks: DataFrame, qid: str, query: str, doc: str, group: str, text: str, vec: str, k: int = 10, wide: int = 50, fused: int = 30, cap: int = 2, dim: int = 64, index: Index | None = None, rerank: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """``qid, doc, group, score, rank``: the lexical list and that of the vectors near its first hits (relevance feedback, as there is no encoder) fused, then at most ``cap`` results of one group.

    ``index``: stored postings of the chunks. ``rerank`` adds ``rerank_score`` to rows with ``query`` and ``text``, such as ``grading.scored_by`` with a model; the fused results are put in its order first.
    """
    texts = chunks
    sparse = cut(bm25_of(index, queries, qid, query, doc, wide)) if index else bm25(queries, chunks, qid, query, doc, text, wide)
    chunks = cut(chunks.select(doc, group, vec))  # read three times
    asked = cut(relevance_vectors(sparse, chunks, qid, doc, vec, dim=dim))  # a vector per query, counted and searched for
    dense = nearest(asked, chunks, qid, "query_vector", doc, vec, wide, dim)
    ranked = fuse(dense, sparse, qid, doc, k=fused).join(chunks.select(doc, group), doc)
    if rerank:
        pairs = ranked.join(queries.select(qid, query), qid).join(texts.select(doc, text), doc)
        ranked = reranked(rerank(pairs), qid)
    return capped(ranked, qid, group, cap, k).select(qid, doc, group, "score", "rank")


def term_coverage(queries: DataFrame, found: DataFrame, docs: DataFrame, qid: str, query: str, doc: str, text: str, first: int = 5) -> DataFrame:
    """``qid, terms, met``: distinct content words of each query, and how many stand in any of its first results; 0 for a query without results."""
    terms = queries.select(qid, F.explode(search_terms(F.col(query))).alias("term")).distinct()
    seen = found.where(F.col("rank") <= first).join(docs.select(doc, text), doc).select(qid, F.explode(F.array_distinct(words(F.col(text)))).alias("term")).distinct()
    met = terms.join(seen.withColumn("met", F.lit(1)), [qid, "term"], "left")
    return met.groupBy(qid).agg(F.count("*").alias("terms"), F.coalesce(F.sum("met"), F.lit(0)).alias("met"))


def corrective(queries: DataFrame, docs: DataFrame, qid: str, query: str, doc: str, text: str, title: str, enough: float = 0.8, most: int = 12, k: int = 10, index: Index | None = None) -> DataFrame:
    """``qid, doc, round, rank``: evidence per query after at most one correction.

    A query whose first results hold less than the share ``enough`` of its content words is asked again together with the title of its best result. The second
    round's results come before the first round's others, each document once, at most ``most``. All queries go through each round
    together, as rows. A query without any result keeps none.
    """
    if index is None:
        with own_index(docs, doc, text) as index:
            return cut(corrective(queries, docs, qid, query, doc, text, title, enough, most, k, index))
    docs = docs.select(doc, text, title)
    first = cut(bm25_of(index, queries, qid, query, doc, k))
    weak = term_coverage(queries, first, docs, qid, query, doc, text).where(F.col("met") < enough * F.col("terms")).select(qid)
    best_title = first.where("rank = 1").join(docs.select(doc, title), doc).select(qid, F.col(title).alias("__hint"))
    again = queries.join(weak, qid).join(best_title, qid).select(qid, F.concat_ws(" ", query, "__hint").alias(query))
    second = bm25_of(index, again, qid, query, doc, k)
    both = first.select(qid, doc, F.lit(1).alias("round"), "rank").unionByName(second.select(qid, doc, F.lit(2).alias("round"), "rank"))
    once = best(both, [qid, doc], [F.desc("round"), F.asc("rank")], 1, "__one").drop("__one")
    return best(once.withColumnRenamed("rank", "__rank"), [qid], [F.desc("round"), F.asc("__rank"), F.asc(doc)], most).drop("__rank")
