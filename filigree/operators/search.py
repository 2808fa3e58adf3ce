"""Filtered dense and sparse search, rank fusion, quotas and relaxation, for many queries in one plan."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from filigree.operators import impact
from filigree.operators.blocks import K1, B, dense_best, sparse_best, term_weights


def predicate(flt: dict) -> Column:
    """A conjunction of equalities and, for lists, memberships."""
    terms = [F.col(k).isin(list(v)) if isinstance(v, (list, tuple, set)) else F.col(k) == v for k, v in flt.items()]
    return reduce(lambda a, b: a & b, terms, F.lit(True))


def dot(a: str | Column, b: str | Column) -> Column:
    """Inner product in double precision; null if either vector is."""
    d = lambda x: F.transform(x, lambda v: v.cast("double"))
    return F.aggregate(F.zip_with(d(a), d(b), lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def ranked(scored: DataFrame, by: list[str], k: int, rank: str) -> DataFrame:
    """The k best rows (score, then id) of each group with their 1-based rank."""
    w = Window.partitionBy(*by).orderBy(F.desc(F.round("score", 6)), "id")
    return scored.withColumn(rank, F.row_number().over(w).cast("bigint")).where(F.col(rank) <= k)


def dense_scores(cand: DataFrame) -> DataFrame:
    """Cosine of unit vectors for rows that have both `vector` (of the query) and `embedding`."""
    return cand.where("vector is not null and embedding is not null").withColumn("score", dot("vector", "embedding")).drop("vector", "embedding")


def sparse_scores(queries: DataFrame, post: DataFrame, idf: DataFrame, stats: DataFrame) -> DataFrame:
    """Okapi BM25 (qid, id, score); a term counts as often as the query has it. Weights are those of the whole corpus.

    Where queries and postings have a ticker, a query meets its own ticker's postings alone: sums are made chunk by
    chunk, so the scores are the same, and postings that lie by ticker are read for the tickers asked for."""
    weights = term_weights(queries, idf)
    on = ["term"]
    if "ticker" in queries.columns and "ticker" in post.columns:
        tickers = queries.select("qid", "ticker").distinct()
        weights, on = weights.join(F.broadcast(tickers), "qid"), ["term", "ticker"]
        post = post.join(F.broadcast(tickers.select("ticker").distinct()), "ticker", "left_semi")
    hits = weights.join(post, on).crossJoin(F.broadcast(stats.select("avgdl")))
    w = F.col("w") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return hits.groupBy("qid", "id").agg(F.sum(w).alias("score"))


def fuse(dense: DataFrame, sparse: DataFrame, by: list[str], k: int = 60) -> DataFrame:
    """Reciprocal rank fusion of (by, id, dense_rank) and (by, id, bm25_rank)."""
    both = dense.select(*by, "id", "dense_rank").join(sparse.select(*by, "id", "bm25_rank"), [*by, "id"], "full_outer")
    part = lambda c: F.coalesce(F.lit(1.0).cast("double") / (F.col(c) + k), F.lit(0.0))
    return both.withColumn("rrf", part("dense_rank") + part("bm25_rank"))


def fusion_order(*by: str) -> Window:
    """Best fused score first; ties keep the dense order, then the sparse one."""
    return Window.partitionBy(*by).orderBy(F.desc(F.round("rrf", 9)), F.asc_nulls_last("dense_rank"), F.asc_nulls_last("bm25_rank"), "id")


def rrf(rankings: DataFrame, k: int = 60) -> DataFrame:
    """Fusion of any number of rankings given as rows (qid, list, id, rank): (qid, id, score, place), ties in first-seen order."""
    s = rankings.groupBy("qid", "id").agg(F.sum(F.lit(1.0).cast("double") / (F.col("rank") + k)).alias("score"), F.min(F.struct("list", "rank")).alias("seen"))
    w = Window.partitionBy("qid").orderBy(F.desc(F.round("score", 12)), "seen")
    return s.select("qid", "id", "score", F.row_number().over(w).cast("bigint").alias("place"))


def dense_topk(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """The k nearest rows (id, embedding) of each question (qid, vector): (qid, id, score, dense_rank)."""
    return ranked(dense_best(queries, rows, k), ["qid"], k, "dense_rank")


def sparse_topk(queries: DataFrame, bags: DataFrame, idf: DataFrame, stats: DataFrame, k: int, blocks: DataFrame | None = None) -> DataFrame:
    """The k best chunks (id, terms) of each question (qid, query) by BM25 above 0: (qid, id, score, bm25_rank).

    With the blocks of an impact-ordered index over all bags only those that matter are read; without, as for a few chunks that a filter leaves, all texts are."""
    found = sparse_best(queries, bags, idf, stats, k) if blocks is None else impact.sparse_best(queries, bags, blocks, idf, stats, k)
    return ranked(found, ["qid"], k, "bm25_rank")


def hybrid(queries: DataFrame, chunks: DataFrame, bags: DataFrame, idf: DataFrame, stats: DataFrame, keep: Column | None = None, *, top: int = 20, rrf_k: int = 60, blocks: DataFrame | None = None) -> DataFrame:
    """Hybrid search of queries (qid, query, vector) under one filter: (qid, id, rrf, dense_rank, bm25_rank, place). blocks, an impact-ordered index of all bags, serves searches without a filter.

    bags hold the terms of all chunks. The filter comes before both rankings; weights are
    those of the whole corpus. Ranks are made of ids alone; texts are joined by the caller.
    """
    allowed = chunks.where(keep) if keep is not None else chunks
    seen = bags if keep is None else bags.join(allowed.select("id"), "id", "left_semi")
    fused = fuse(dense_topk(queries, allowed, top), sparse_topk(queries, seen, idf, stats, top, blocks if keep is None else None), ["qid"], rrf_k)
    return fused.withColumn("place", F.row_number().over(fusion_order("qid")).cast("bigint"))


def relevant(subq: DataFrame, chunks: DataFrame) -> DataFrame:
    """Chunks that a sub-query may see, with the strictest filter they pass: tier 0 sections and periods, 1 periods alone, 2 none.

    subq: (sq, ticker, sections, periods, fiscal_year or null for any)."""
    on = (F.col("c.ticker") == F.col("q.ticker")) & (F.col("q.fiscal_year").isNull() | (F.col("c.fiscal_year") == F.col("q.fiscal_year")))
    # sub-queries are few and made of questions: their tickers prune what lies by ticker
    chunks = chunks.join(F.broadcast(subq.select("ticker").distinct()), "ticker", "left_semi")
    both = subq.alias("q").join(chunks.alias("c"), on)
    fits = lambda values, c: (F.size(values) == 0) | F.array_contains(values, c)
    periods, sections = fits("q.periods", F.col("c.fiscal_quarter")), fits("q.sections", F.col("c.section"))
    tier = F.when(periods & sections, 0).when(periods, 1).otherwise(2)
    return both.select("q.sq", "q.fiscal_year", "q.vector", "c.id", "c.embedding", tier.alias("own_tier"))


def relaxed(subq: DataFrame, chunks: DataFrame, post: DataFrame, idf: DataFrame, stats: DataFrame, *, top: int = 20, rrf_k: int = 60, quota: int = 5, reranker=None) -> DataFrame:
    """Hits of every sub-query and year under the strictest tier that finds anything, at most quota each: (sq, fiscal_year, tier, id, rrf, dense_rank, bm25_rank, place).

    subq: (sq, ticker, query, sections, periods, fiscal_year, vector); a null fiscal_year
    searches all years as one group. A row of a stricter tier counts in the looser ones.
    A reranker (a column function of query and text) orders the fused hits before the quota.
    """
    seen = relevant(subq, chunks)
    by = ["sq", "fiscal_year", "tier"]
    # scored once, then counted in each tier
    tiers = F.explode(F.sequence("own_tier", F.lit(2))).alias("tier")
    each = lambda d: d.select("sq", "fiscal_year", tiers, "id", "score")
    dense = ranked(each(dense_scores(seen)), by, top, "dense_rank")
    texts = subq.select(F.col("sq").alias("qid"), "query", "ticker").distinct()
    scores = sparse_scores(texts, post, idf, stats).where("score > 0").withColumnRenamed("qid", "sq")
    sparse = ranked(each(seen.select("sq", "fiscal_year", "own_tier", "id").join(scores, ["sq", "id"])), by, top, "bm25_rank")
    # a year may be null, which an equality join would lose
    sure = lambda d: d.withColumn("fiscal_year", F.coalesce("fiscal_year", F.lit(0)))
    fused = fuse(sure(dense), sure(sparse), by, rrf_k)
    best = Window.partitionBy("sq", "fiscal_year")
    kept = fused.withColumn("_t", F.min("tier").over(best)).where("tier = _t").drop("_t")
    if reranker is None:
        out = kept.withColumn("place", F.row_number().over(fusion_order("sq", "fiscal_year")).cast("bigint"))
    else:
        read = kept.join(chunks.select("id", F.col("text").alias("_text")), "id").join(texts.select(F.col("qid").alias("sq"), F.col("query").alias("_query")), "sq")
        out = rerank(read, reranker(F.col("_query"), F.col("_text")), ["sq", "fiscal_year"]).drop("_text", "_query")
    out = out.where(F.col("place") <= quota)
    return out.withColumn("fiscal_year", F.nullif("fiscal_year", F.lit(0)))


def rerank(hits: DataFrame, score: Column, by: list[str]) -> DataFrame:
    """hits in the order of another score, which is kept as `rerank`."""
    w = Window.partitionBy(*by).orderBy(F.desc("rerank"), "id")
    return hits.withColumn("rerank", score).withColumn("place", F.row_number().over(w).cast("bigint"))


def query_text(query: Column, name: Column, question: Column) -> Column:
    """A sub-query without text asks the question about its company."""
    return F.coalesce(F.nullif(query, F.lit("")), F.concat_ws(" ", name, question))
