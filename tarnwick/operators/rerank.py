"""Reranking of a shortlist by a pair scorer, with a score cache."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions.text import words
from tarnwick.operators.ranking import DIGITS, rank


class PairScorer(Protocol):
    """A cross-encoder; ``predict`` runs in the Python workers."""

    def predict(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def overlap_score(query: Column, text: Column) -> Column:
    """The deterministic default: shared distinct words over ten."""
    return F.size(F.array_intersect(words(query), words(text))) / 10.0


def pair_scores(pairs: DataFrame, questions: DataFrame, chunks: DataFrame) -> DataFrame:
    """qid, chunk_id, rerank_score by the default scorer: as ``overlap_score``, but words are cut where white space is as Python sees it, which is faster by far."""
    lower = lambda c: F.lower(F.coalesce(F.col(c), F.lit("")))
    met = pairs.join(questions.select("qid", lower("question").alias("question")), "qid").join(chunks.select("chunk_id", lower("text").alias("text")), "chunk_id")

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            both = zip(b.column("question").to_pylist(), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("qid"), b.column("chunk_id"), pa.array([len(set(q.split()).intersection(t.split())) / 10.0 for q, t in both], pa.float64())], names=["qid", "chunk_id", "rerank_score"])

    scored = met.select("qid", "chunk_id", "question", "text").mapInArrow(score, "qid string, chunk_id string, rerank_score double")
    return scored.withColumn("rerank_score", F.round("rerank_score", DIGITS))


def scored_by(model: PairScorer, query: Column, text: Column, batch: int = 16) -> Column:
    @F.pandas_udf("double")
    def run(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for q, t in parts:
            pairs = list(zip(q.fillna(""), t.fillna("")))
            yield pd.Series([s for i in range(0, len(pairs), batch) for s in model.predict(pairs[i : i + batch])], dtype=float)

    return run(query, text)


def shortlist(fused: DataFrame, n: int) -> DataFrame:
    return fused.where(F.col("fused_rank") <= n)


def cache_key(query: Column) -> Column:
    return F.substring(F.sha2(query, 256), 1, 16)


def rerank(short: DataFrame, k: int, model: PairScorer | None = None, cache: DataFrame | None = None) -> DataFrame:
    """qid, chunk_id, fused_rank, rerank_score, final_rank, rank_movement of the k best.

    ``short`` has question and text.  ``cache`` (query_key, chunk_id, rerank_score) is
    read first; only pairs it lacks are scored.
    """
    def score(df: DataFrame) -> DataFrame:
        q, t = F.col("question"), F.col("text")
        return df.withColumn("rerank_score", F.round(overlap_score(q, t) if model is None else scored_by(model, q, t), DIGITS))

    if cache is None:
        done = score(short)
    else:
        keyed = short.withColumn("query_key", cache_key(F.col("question")))
        known = cache.select("query_key", "chunk_id", F.col("rerank_score").alias("known"))
        both = keyed.join(known, ["query_key", "chunk_id"], "left")
        hit = both.where("known IS NOT NULL").withColumnRenamed("known", "rerank_score").drop("query_key")
        done = hit.unionByName(score(both.where("known IS NULL").drop("known", "query_key")))
    out = rank(done, "rerank_score", "final_rank", "qid").where(F.col("final_rank") <= k)
    return out.withColumn("rank_movement", F.col("fused_rank") - F.col("final_rank"))


def update_cache(cache: DataFrame, scored: DataFrame, size: int) -> DataFrame:
    """The newest ``size`` entries; ``scored`` has query_key, chunk_id, rerank_score, used_at."""
    both = cache.unionByName(scored)
    latest = F.row_number().over(Window.partitionBy("query_key", "chunk_id").orderBy(F.desc("used_at")))
    one = both.withColumn("__n", latest).where("__n = 1").drop("__n")
    return one.orderBy(F.desc("used_at"), "query_key", "chunk_id").limit(size)


def cache_report(lookups: DataFrame, cache: DataFrame) -> DataFrame:
    """One row: lookups (query_key, chunk_id) that the cache answers, those that it does not, and the share of the first (0 without any)."""
    known = cache.select("query_key", "chunk_id").distinct().withColumn("__hit", F.lit(True))
    met = lookups.join(known, ["query_key", "chunk_id"], "left").agg(F.count("__hit").alias("hits"), F.count_if(F.col("__hit").isNull()).alias("misses"))
    return met.select("hits", "misses", F.round(F.coalesce(F.try_divide("hits", F.col("hits") + F.col("misses")), F.lit(0.0)), DIGITS).alias("hit_rate"))
