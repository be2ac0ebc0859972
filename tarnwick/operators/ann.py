"""Approximate cosine search: an inverted file of lists around centres, of which a query probes the nearest.

Centres come from spherical k-means on a bounded sample, chosen by hash; every row is put into the
list of its nearest centre, and the lists are stored as partitions, so a search reads those alone
that some query probes.  A list is a task of its own, and keeps the k best of each visitor.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.dense import top_k as exact
from tarnwick.operators.ranking import DIGITS, top_k
from tarnwick.runtime import stage

#: Rows in the sample, rows that a list should have, and rounds of k-means.
SAMPLE, LIST, ROUNDS = 20_000, 4096, 10


class Index(NamedTuple):
    centres: np.ndarray
    rows: DataFrame  #: chunk_id, v (unit vector), list_no
    dim: int


def _units(column: pa.Array) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)
    return x / np.sqrt((x * x).sum(1))[:, None]


def _usable(df: DataFrame, id_: str, vector: str, dim: int) -> DataFrame:
    src = df.select(F.col(id_).cast("string").alias("id"), F.col(vector).cast("array<double>").alias("v"))
    bad = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return src.where(F.col("id").isNotNull() & F.coalesce((F.size("v") == dim) & ~bad & F.exists("v", lambda x: x != 0), F.lit(False)))


def build(corpus: DataFrame, dim: int, *, id_: str = "chunk_id", vector: str = "embedding", lists: int | None = None) -> Index:
    """The index of all rows with a vector of this width that is finite and not zero (others are never found); of repeated ids the larger vector."""
    rows = _usable(corpus, id_, vector, dim).groupBy("id").agg(F.max("v").alias("v"))
    n = max(1, corpus.count())
    upto = min(1 << 20, max(1, (SAMPLE << 20) // n))
    picked = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < upto).select("v").toArrow()  # about SAMPLE rows
    sample = np.unique(_units(picked.column(0).combine_chunks()), axis=0) if picked.num_rows else np.eye(1, dim)
    k = min(len(sample), lists or max(1, -(-n // LIST)))
    centres = sample[np.random.default_rng(7).permutation(len(sample))[:k]]
    for _ in range(ROUNDS):
        near = (sample @ centres.T).argmax(1)
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        length = np.sqrt((sums * sums).sum(1, keepdims=True))
        centres = np.where(length > 0, sums / np.maximum(length, 1e-12), centres)
    shared = corpus.sparkSession.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _units(b.column("v"))
                units = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * dim, pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id"), units, pa.array((x @ shared.value.T).argmax(1), pa.int32())], names=["chunk_id", "v", "list_no"])

    made = rows.mapInArrow(assign, "chunk_id string, v array<double>, list_no int")
    return Index(centres, stage(made.repartition("list_no"), partition_by=["list_no"]), dim)


def search(index: Index, queries: DataFrame, k: int, probes: int, *, qid: str = "qid", vector: str = "embedding") -> DataFrame:
    """qid, chunk_id, score, rank: the k best rows of the ``probes`` lists nearest to each query."""
    dim = index.dim
    asked = _usable(queries, qid, vector, dim).dropDuplicates(["id"])
    shared, n = queries.sparkSession.sparkContext.broadcast(index.centres), min(probes, len(index.centres))

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _units(b.column("v"))
                near = x @ shared.value.T
                lists = np.argpartition(-near, n - 1, axis=1)[:, :n].ravel() if n else np.empty(0, np.int64)
                at = np.repeat(np.arange(len(x)), n)
                units = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1) * dim, pa.int32()), pa.array(x[at].ravel()))
                yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), units, pa.array(lists, pa.int32())], names=["qid", "q", "list_no"])

    visits = asked.mapInArrow(visit, "qid string, q array<double>, list_no int")

    def meet(left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[pa.Table] = []
        if left.num_rows and right.num_rows and k > 0:
            names = np.array(right.column("chunk_id").to_pylist(), object)
            rows, asks = (t.column(c).combine_chunks() for t, c in ((right, "v"), (left, "q")))
            x = rows.flatten().to_numpy().reshape(-1, dim)
            for s in range(0, left.num_rows, 512):
                q = asks.slice(s, 512)
                score = np.round(q.flatten().to_numpy().reshape(-1, dim) @ x.T, DIGITS)
                m = min(k, len(names))
                least = np.partition(score, len(names) - m, axis=1)[:, len(names) - m]
                a, b = np.nonzero(score >= least[:, None])
                order = np.lexsort((np.unique(names, return_inverse=True)[1][b], -score[a, b], a))
                a, b = a[order], b[order]
                first = np.searchsorted(a, a)
                keep = np.arange(len(a)) - first < m
                a, b = a[keep], b[keep]
                out.append(pa.table({"qid": left.column("qid").combine_chunks().slice(s, 512).take(pa.array(a)), "chunk_id": pa.array(names[b], pa.string()), "score": pa.array(score[a, b])}))
        return pa.concat_tables(out) if out else pa.table({"qid": pa.array([], pa.string()), "chunk_id": pa.array([], pa.string()), "score": pa.array([], pa.float64())})

    found = visits.groupBy("list_no").cogroup(index.rows.groupBy("list_no")).applyInArrow(meet, "qid string, chunk_id string, score double")
    return top_k(found, "score", k, "qid")


def recall(index: Index, queries: DataFrame, k: int, probes: int, **names: str) -> float:
    """The share of the exact k best (of the index's rows) that a search finds."""
    rows = index.rows.withColumn("embedding", F.col("v"))
    true = exact(rows, queries, k, index.dim, **{{"qid": "qid", "vector": "query_vector"}[n]: c for n, c in names.items()}).select("qid", "chunk_id")
    found = search(index, queries, k, probes, **names).select("qid", "chunk_id", F.lit(1).alias("hit"))
    met = true.distinct().join(found, ["qid", "chunk_id"], "left").agg(F.count("*"), F.count("hit")).first()
    return met[1] / met[0] if met[0] else 1.0
