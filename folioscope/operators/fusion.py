"""Reciprocal-rank fusion, adaptive cuts and hybrid retrieval."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from folioscope.functions.rules import LAW_KINDS

#: Sizes and cuts of the lists.
POOL, K, CAP, MARGIN, RATIO = 200, 60, 25, 2.0, 0.30


def fuse(lists: list[DataFrame], k: int = K) -> DataFrame:
    """(qid, rid, rrf): the sum of 1 / (k + rank) over the ranked lists (qid, rid, rank); an absent row adds nothing."""
    every = reduce(DataFrame.unionByName, [x.select("qid", "rid", "rank") for x in lists])
    return every.groupBy("qid", "rid").agg(F.sum(1.0 / (k + F.col("rank"))).alias("rrf"))


def pool(fused: DataFrame, n: int = POOL) -> DataFrame:
    order = Window.partitionBy("qid").orderBy(F.round("rrf", 12).desc(), "rid")
    return fused.withColumn("_place", F.row_number().over(order)).where(F.col("_place") <= n).drop("_place")


def hydrate(fused: DataFrame, chunks: DataFrame, types: tuple[str, ...] | None = LAW_KINDS, slug: str | None = None, with_repealed: bool = False) -> DataFrame:
    """The pool's chunks, filtered after pooling."""
    rows = chunks
    if types is not None:
        rows = rows.where(F.col("doc_type").isin(*types))
    if slug:
        rows = rows.where(F.col("slug") == slug)
    if not with_repealed:
        rows = rows.where("vigente = 1")
    return fused.join(rows, "rid")


def cut(hits: DataFrame, score: str, least: Column, cap: int = CAP) -> DataFrame:
    """hits with rank, best first, whose score reaches least (a column that may use _top, the query's best)."""
    own = Window.partitionBy("qid")
    kept = hits.withColumn("_top", F.max(score).over(own)).where(F.col(score) >= least).drop("_top")
    order = own.orderBy(F.round(score, 12).desc(), "rid")
    return kept.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def ratio_cut(hits: DataFrame, score: str = "rrf", ratio: float = RATIO, cap: int = CAP) -> DataFrame:
    return cut(hits, score, F.col("_top") * ratio, cap)


def margin_cut(hits: DataFrame, score: str = "score", margin: float = MARGIN, cap: int = CAP) -> DataFrame:
    return cut(hits, score, F.col("_top") - margin, cap)


def packed(hits: DataFrame, score: str) -> DataFrame:
    fields = [c for c in ("slug", "article", "citation", "structure", "doc_type", "rama", "name") if c in hits.columns]
    return hits.select("qid", "rank", "rid", F.round(score, 4).alias("score"), *fields, (F.col("vigente") == 1).alias("vigente"), "text")


def hybrid(
    chunks: DataFrame, lexical: DataFrame, semantic: DataFrame, *, slug: str | None = None, types: tuple[str, ...] | None = LAW_KINDS, with_repealed: bool = False, pool_size: int = POOL, k: int = K, cap: int = CAP,
    margin: float = MARGIN, reranker=None, queries: DataFrame | None = None,
) -> DataFrame:
    """(qid, rank, rid, score, ..., text) from two ranked lists (qid, rid, rank) of pool_size rows.

    lexical is ranked within the slug, semantic over all; both count in the ranks, whatever is filtered later. reranker
    takes hits (with query, text) and adds score; without one the fused order counts, cut at 0.30 of the best that is left.
    """
    hits = hydrate(pool(fuse([lexical, semantic], k), pool_size), chunks, types, slug, with_repealed)
    if reranker is not None:
        scored = reranker(hits.join(queries.select("qid", "query"), "qid"))
        return packed(margin_cut(scored, "score", margin, cap), "score")
    return packed(ratio_cut(hits, "rrf", RATIO, cap), "rrf")
