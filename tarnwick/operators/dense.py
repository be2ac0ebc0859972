"""Exact cosine search for a set of query vectors, in blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.ranking import GROUP, Best, blocked_top_k, kth, query_blocks

#: Pairs of query and row that are looked at in double precision at once.
PAIRS = 16_384


class WidthError(ValueError):
    """A vector has another width than its collection."""


def _rows(lists: pa.Array) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(lists), -1)


def _normed(x: np.ndarray) -> np.ndarray:
    n = np.sqrt((x * x).sum(1, keepdims=True))
    return np.divide(x, n, out=np.zeros_like(x), where=n > 0)


def top_k(corpus: DataFrame, queries: DataFrame, k: int, dim: int, *, id_: str = "chunk_id", vector: str = "embedding", qid: str = "qid", query_vector: str = "embedding") -> DataFrame:
    """qid, chunk_id, score, rank.  Zero rows score 0; zero queries find nothing; null and odd-width rows do not answer."""
    rows = corpus.select(F.col(id_).cast("string").alias("chunk_id"), F.col(vector).cast("array<double>").alias("v")).where(F.size("v") == dim)
    asked = queries.select(F.col(qid).alias("qid"), F.col(query_vector).cast("array<double>").alias("v"))
    asked = asked.where((F.size("v") == dim) & F.exists("v", lambda x: x != 0))
    blocks = ((qids, _normed(np.array(vs, float))) for qids, vs in query_blocks(asked, "qid", "v"))
    return blocked_top_k(rows, blocks, _score, k)


def _score(table: pa.Table, queries: np.ndarray, best: Best) -> None:
    """All products in single precision; those that may be kept, by its largest error, again in double precision."""
    unit = _normed(_rows(table.column("v").combine_chunks()))
    whole = np.flatnonzero(np.isfinite(unit).all(1))
    unit = unit[whole]
    if not len(unit):
        return
    fast, asked, error = unit.astype(np.float32).T.copy(), queries.astype(np.float32), (unit.shape[1] + 4) * 2.0**-24
    for s in range(0, len(queries), GROUP):
        at = slice(s, s + GROUP)
        near = asked[at] @ fast
        bound = best.bound(at)
        if not best.full[at].all():
            bound = np.maximum(bound, kth(near, best.k) - error - 1e-8)
        query, row = np.divmod(np.flatnonzero(near >= np.where(np.isfinite(bound), bound - error, bound).astype(np.float32)[:, None]), len(unit))
        for o in range(0, len(query), PAIRS):
            q, r = query[o : o + PAIRS] + s, row[o : o + PAIRS]
            best.meet(q, whole[r], np.einsum("ij,ij->i", unit[r], queries[q]))


def check_width(df: DataFrame, vector: str, dim: int) -> DataFrame:
    """The same rows; a job that meets a vector of another width fails."""
    v = F.col(vector)
    return df.withColumn(vector, F.when(F.size(v) == dim, v).otherwise(F.raise_error(F.concat(F.lit(f"width is not {dim}: "), F.size(v).cast("string")))))
