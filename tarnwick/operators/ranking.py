"""Ranked lists: total orders, blocked top-k search of a stated query set, shortlists, rank movement."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.runtime import stage

#: Queries that a worker holds at once; larger query sets are answered in several blocks.
BLOCK = 16_384
#: Rows of the corpus that are scored at once, and queries that are compared with them at once.
ROWS = 16_384
GROUP = 64
DIGITS = 9


def rank(df: DataFrame, score: str, name: str, *keys: str, item: str = "chunk_id") -> DataFrame:
    """Adds the 1-based position within the keys by (-score, item)."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc(score), F.asc(item))))


def top_k(df: DataFrame, score: str, k: int, *keys: str, item: str = "chunk_id", name: str = "rank") -> DataFrame:
    """The k best of each key; the limit is pushed below the exchange. k <= 0 gives none."""
    return rank(df, score, name, *keys, item=item).where(F.col(name) <= k)


def rank_movement(before: Column, after: Column) -> Column:
    return before - after


class Best:
    """The k best rows of every query of a block, by (-score, name), from rows that stream by.

    Holds k rows per query, and the names of rows that may be among them; never the rows themselves.
    """

    def __init__(self, n_queries: int, k: int, floor: float | None = None):
        self.k = k
        #: What a rounded score must reach to be kept.
        self.least = np.full(n_queries, -np.inf if floor is None else np.nextafter(floor, np.inf))
        self.full = np.zeros(n_queries, bool)
        self.score = np.full((n_queries, k), -np.inf)
        self.row = np.full((n_queries, k), -1, np.int64)
        self.names: list[str] = []

    def begin(self, names: list[str]) -> None:
        """The rows that are added next have these names."""
        if len(self.names) > self.row.size:
            held, number = np.unique(self.row, return_inverse=True)  # begins with -1 where a place is free
            free = int(len(held) > 0 and held[0] < 0)
            self.names, self.row = [self.names[i] for i in held[free:].tolist()], number.reshape(self.row.shape) - free
        self.first = len(self.names)
        self.names += names
        self.place = np.empty(len(self.names), np.int64)
        self.place[np.argsort(np.array(self.names, object), kind="stable")] = np.arange(len(self.names))

    def bound(self, at: slice) -> np.ndarray:
        """What is below can't be kept. Rounding comes last; until then, what is short of the least by less than it may be passes."""
        return np.where(np.isfinite(self.least[at]), self.least[at] - 10.0**-DIGITS, self.least[at])

    def add(self, names: np.ndarray, scores: np.ndarray) -> None:
        """``scores``: rows x queries."""
        self.begin(list(names))
        query, row = np.nonzero(scores.T >= self.bound(slice(None))[:, None])
        self.meet(query, row, scores[row, query])

    def meet(self, query: np.ndarray, row: np.ndarray, score: np.ndarray) -> None:
        """Pairs of queries (ascending) and rows since ``begin``."""
        score = np.round(score, DIGITS)
        kept = score >= self.least[query]
        query, row, score = query[kept], row[kept] + self.first, score[kept]
        if not len(query):
            return
        asked = query[np.append(True, query[1:] != query[:-1])]
        old, place = np.nonzero(self.row[asked] >= 0)
        query = np.concatenate([asked[old], query])
        row = np.concatenate([self.row[asked[old], place], row])
        score = np.concatenate([self.score[asked[old], place], score])
        order = np.lexsort((self.place[row], -score, query))
        query = query[order]
        first = np.flatnonzero(np.append(True, query[1:] != query[:-1]))
        nth = np.arange(len(query)) - np.repeat(first, np.diff(np.append(first, len(query))))
        kept = nth < self.k
        query, nth, order = query[kept], nth[kept], order[kept]
        self.row[query, nth], self.score[query, nth] = row[order], score[order]
        last = query[nth == self.k - 1]
        self.full[last] = True
        self.least[last] = np.maximum(self.least[last], self.score[last, self.k - 1])

    @property
    def query(self) -> np.ndarray:
        return np.nonzero(self.row >= 0)[0]

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        query, place = np.nonzero(self.row >= 0)
        return query, np.array(self.names, object)[self.row[query, place]], self.score[query, place]


def kth(scores: np.ndarray, k: int) -> np.ndarray:
    """A value that at least ``k`` of each row reach, and few more: the ``k``-th largest of the maxima of 512 blocks."""
    n = scores.shape[1]
    if n < k:
        return np.full(len(scores), -np.inf, scores.dtype)
    if n >= 1024 and 512 >= 4 * k:
        scores = scores[:, : n // 512 * 512].reshape(len(scores), n // 512, 512).max(1)
    return np.partition(scores, scores.shape[1] - k, axis=1)[:, scores.shape[1] - k]


def blocked_top_k(corpus: DataFrame, blocks: Iterator[tuple[list[str], object]], score: Callable[[pa.Table, object, Best], None], k: int, floor: float | None = None) -> DataFrame:
    """qid, chunk_id, score, rank: every query of every block against all rows of ``corpus`` (id first).

    Partitions, no more than there are cores, stream their rows, ``score`` adds those that may be kept,
    and the k best per query are shuffled, whatever the corpus holds.  A block of queries has a fixed bound and
    is broadcast; where there are several, each is answered and stored before the next is made.
    """
    spark = corpus.sparkSession
    done: list[DataFrame] = []
    held = None

    def answered(block: tuple[list[str], object]) -> tuple[DataFrame, Broadcast]:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            qids, payload = shared.value
            best = Best(len(qids), k, floor)
            for part in _rows_at_once(batches):
                best.begin(part.column(0).to_pylist())
                score(part, payload, best)
            query, name, value = best.rows()
            yield pa.RecordBatch.from_arrays([pa.array(qids, pa.string()).take(pa.array(query)), pa.array(name, pa.string()), pa.array(value)], names=["qid", "chunk_id", "score"])

        return top_k(corpus.coalesce(spark.sparkContext.defaultParallelism).mapInArrow(run, "qid string, chunk_id string, score double"), "score", k, "qid"), shared

    for block in blocks if k > 0 else ():
        if held is not None:
            done.append(stage(held[0]))
            held[1].unpersist()
        held = answered(block)
    if held is None:
        return spark.createDataFrame([], "qid string, chunk_id string, score double, rank int")
    return reduce(DataFrame.unionByName, [*done, held[0]])


def _rows_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    held: list[pa.RecordBatch] = []
    n = 0
    for b in batches:
        while b.num_rows:
            part = b.slice(0, ROWS - n)
            held.append(part)
            n, b = n + part.num_rows, b.slice(part.num_rows)
            if n == ROWS:
                yield pa.Table.from_batches(held)
                held, n = [], 0
    if n:
        yield pa.Table.from_batches(held)


def query_blocks(queries: DataFrame, qid: str, payload: str, size: int | None = None) -> Iterator[tuple[list[str], list]]:
    """The query set in blocks of a bounded size, without a global order."""
    n = max(1, -(-queries.count() // (size or BLOCK)))
    keyed = queries.select(F.col(qid).cast("string").alias("q"), F.col(payload).alias("p"))
    for i in range(n):
        rows = keyed.where(F.pmod(F.xxhash64("q"), F.lit(n)) == i).collect()  # about ``size`` rows
        rows.sort(key=lambda r: r["q"])
        if rows:
            yield [r["q"] for r in rows], [r["p"] for r in rows]
