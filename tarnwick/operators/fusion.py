"""Rank fusion of candidate lists: reciprocal rank and weighted min-max."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.config import ConfigError
from tarnwick.operators.ranking import DIGITS, rank

STAGES = ("dense_score", "lexical_score", "dense_rank", "lexical_rank")


def distinct_hits(hits: DataFrame) -> DataFrame:
    """One row per query, list and chunk with its best valid score, and its 1-based position."""
    valid = hits.where(F.col("qid").isNotNull() & F.col("retriever").isNotNull() & F.col("chunk_id").isNotNull() & F.col("score").isNotNull() & ~F.isnan("score"))
    best = valid.groupBy("qid", "retriever", "chunk_id").agg(F.max("score").alias("score"))
    return rank(best, "score", "rank", "qid", "retriever")


def union_lists(**lists: DataFrame) -> DataFrame:
    """Candidate lists (qid, chunk_id, score, rank) under one roof, numbered in the order given."""
    out = None
    for n, (name, df) in enumerate(lists.items()):
        one = df.select("qid", F.lit(name).alias("retriever"), F.lit(n).alias("list_no"), "chunk_id", "score", "rank")
        out = one if out is None else out.unionByName(one)
    return out


def numbered(candidates: DataFrame) -> DataFrame:
    """Candidates with the number of their list; where none is stated, dense comes first, lexical second, and others by name."""
    if "list_no" in candidates.columns:
        return candidates
    name = F.col("retriever")
    return candidates.withColumn("list_no", F.when(name == "dense", 0).when(name == "lexical", 1).otherwise(2))


def _stages() -> list[Column]:
    """Evidence of each stage: score and rank in the first of its lists (dense, dense_1, ...) that has the chunk."""
    out = []
    for name in ("dense", "lexical"):
        own = F.when(F.col("retriever").startswith(name), F.struct("score", "rank"))
        first = F.min_by(own, F.when(own.isNotNull(), F.struct("list_no", "retriever")))
        out += [first["score"].alias(f"{name}_score"), first["rank"].alias(f"{name}_rank")]
    return out


def rrf(candidates: DataFrame, k: int = 60) -> DataFrame:
    """Sum over lists of 1 / (k + rank), with the evidence of each stage and the fused rank."""
    if k <= 0:
        raise ConfigError("rrf_k must be positive")
    score = F.round(F.sum(1.0 / (k + F.col("rank"))), DIGITS)
    return rank(numbered(candidates).groupBy("qid", "chunk_id").agg(score.alias("score"), *_stages()), "score", "fused_rank", "qid")


def weighted(candidates: DataFrame, weights: list[float] | None = None, n_lists: int | None = None) -> DataFrame:
    """Weighted sum of scores that are min-max normalised per list; a flat list counts 1.0 throughout.

    ``weights`` are of the lists by their number; without any, all of ``n_lists`` (or those the query has) count alike.
    """
    if weights is not None and n_lists is not None and len(weights) != n_lists:
        raise ConfigError(f"{len(weights)} weights for {n_lists} lists")
    candidates = numbered(candidates)
    per = Window.partitionBy("qid", "retriever")
    low, high = F.min("score").over(per), F.max("score").over(per)
    unit = F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0))
    if weights is not None:
        weight = F.coalesce(F.get(F.array(*[F.lit(float(w)) for w in weights]), F.col("list_no")), F.lit(0.0))
    else:
        weight = 1.0 / (F.lit(n_lists) if n_lists else F.size(F.collect_set("retriever").over(Window.partitionBy("qid"))))
    scored = candidates.withColumn("part", weight * unit)
    return rank(scored.groupBy("qid", "chunk_id").agg(F.round(F.sum("part"), DIGITS).alias("score"), *_stages()), "score", "fused_rank", "qid")


def fuse(candidates: DataFrame, n_lists: int, method: str = "rrf", rrf_k: int = 60, dense_weight: float = 0.5) -> DataFrame:
    """Of two lists the first has the dense weight and the second the rest; any other number is weighted evenly."""
    if method == "rrf":
        return rrf(candidates, rrf_k)
    if method == "weighted":
        return weighted(candidates, [dense_weight, 1 - dense_weight] if n_lists == 2 else None, n_lists)
    raise ConfigError(f"unknown fusion {method!r}")


def candidate_counts(candidates: DataFrame, fused: DataFrame, reranked: DataFrame | None = None) -> DataFrame:
    """qid, stage, n: list sizes before, and candidates after, removing repeats, and of those that were reranked."""
    out = candidates.groupBy("qid", F.col("retriever").alias("stage")).agg(F.count("*").alias("n"))
    for name, df in (("fused", fused), ("reranked", reranked)):
        if df is not None:
            out = out.unionByName(df.groupBy("qid", F.lit(name).alias("stage")).agg(F.count("*").alias("n")))
    return out
