"""BM25 (Okapi): an index that stays, and exact top-k for a set of queries.

The index is sharded by documents: a row per chunk with its terms and their counts, made from
the text once, and a table of the terms with their weights.  It is stored under a key of the
chunk ids and found again by it.  A search reads no text: each partition of the index meets
the terms that a block of queries asks for and keeps its k best of each, so no term is hot and
no pair of query and chunk leaves its partition but those k.  Of a query's terms, those that
together can't lift a chunk to the k best are added up only where the others leave it a chance.

idf(t) = ln(N - df + 0.5) - ln(df + 0.5); where that is negative, epsilon times the
mean idf over all terms takes its place.  A chunk without terms has one sentinel
term, so it counts in N and in the mean length.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.functions.text import TERM, terms
from tarnwick.operators.ranking import GROUP, Best, blocked_top_k, kth, query_blocks
from tarnwick.runtime import hadoop_path, shared_dir

K1, B, EPSILON = 1.5, 0.75, 0.25
SENTINEL = ""
#: Pairs of query and term in a block; a block of more is split.
ENTRIES = 500_000
DOCS = "chunk_id string, terms array<string>, counts array<int>, dl int"


class Index(NamedTuple):
    docs: DataFrame  #: chunk_id, terms (each once), counts, dl
    weights: DataFrame  #: term, df, idf
    mean: float  #: mean length


def tokenised(chunks: DataFrame, id_: str = "chunk_id", text: str = "text") -> DataFrame:
    """chunk_id, terms, counts, dl."""
    src = chunks.select(F.col(id_).cast("string").alias("chunk_id"), F.lower(F.coalesce(F.col(text), F.lit(""))).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [Counter(TERM.findall(t) or [SENTINEL]) for t in b.column("text").to_pylist()]
            arrays = [pa.array([list(c) for c in found], pa.list_(pa.string())), pa.array([list(c.values()) for c in found], pa.list_(pa.int32())), pa.array([c.total() for c in found], pa.int32())]
            yield pa.RecordBatch.from_arrays([b.column("chunk_id"), *arrays], names=["chunk_id", "terms", "counts", "dl"])

    return src.mapInArrow(count, DOCS)


def idf(docs: DataFrame) -> DataFrame:
    """term, df, idf with the floor applied."""
    size = docs.agg(F.count("*").alias("n"))
    df = docs.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count("*").alias("df"))
    raw = df.crossJoin(F.broadcast(size)).select("term", "df", (F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))  # one row
    floor = F.col("mean") * EPSILON
    return raw.crossJoin(F.broadcast(mean)).select("term", "df", F.when(F.col("raw") < 0, floor).otherwise(F.col("raw")).alias("idf"))


def key(chunks: DataFrame, id_: str = "chunk_id") -> str:
    """A key of the set of chunk ids; reads nothing else."""
    h = lambda seed: F.xxhash64(F.lit(seed), F.col(id_).cast("string"))
    n, a, b = chunks.select(id_).distinct().agg(F.count("*"), F.bit_xor(h(1)), F.bit_xor(h(2))).first()
    return f"{n}-{(a or 0) & (1 << 64) - 1:016x}{(b or 0) & (1 << 64) - 1:016x}"


def load(spark: SparkSession, path: str, name: str) -> Index | None:
    """The index stored under a key; none if there is none, or it can't be read."""
    where = f"{path}/{name}"
    try:
        mean = spark.read.schema("mean double").parquet(f"{where}/mean").first()
        docs, weights = (spark.read.parquet(f"{where}/{t}") for t in ("docs", "weights"))
        return None if mean is None or docs.columns != ["chunk_id", "terms", "counts", "dl"] or weights.columns != ["term", "df", "idf"] else Index(docs, weights, mean[0])
    except AnalysisException:
        return None


def ensure(chunks: DataFrame, path: str | None = None, id_: str = "chunk_id", text: str = "text") -> Index:
    """The index of these chunks: the stored one, if their ids are the same, else a new one, which is stored.

    The row that makes it complete is written last, so one that was left half written counts as none.
    The key is of the ids, as they are of content; where texts change under an id, store under another path.
    """
    spark = chunks.sparkSession
    path = (path or f"{shared_dir(spark)}/tarnwick-bm25").rstrip("/")
    name = key(chunks, id_)
    found = load(spark, path, name)
    if found is not None:
        return found
    where, files = hadoop_path(spark, f"{path}/{name}")
    files.delete(where, True)
    tokenised(chunks, id_, text).write.option("compression", "zstd").parquet(f"{path}/{name}/docs")
    docs = spark.read.schema(DOCS).parquet(f"{path}/{name}/docs")
    idf(docs).write.parquet(f"{path}/{name}/weights")
    docs.agg(F.coalesce(F.avg("dl"), F.lit(1.0)).alias("mean")).write.parquet(f"{path}/{name}/mean")
    return load(spark, path, name)


def top_k(index: Index, queries: DataFrame, k: int, *, qid: str = "qid", question: str = "question") -> DataFrame:
    """qid, chunk_id, score, rank of the k best chunks with a positive score."""
    asked = queries.select(F.col(qid).alias("qid"), terms(F.col(question)).alias("terms"))
    return blocked_top_k(index.docs, _blocks(index, asked), _score, k, floor=0.0)


def _blocks(index: Index, asked: DataFrame) -> Iterator[tuple[list[str], tuple]]:
    """Blocks of queries: for each of their terms, which queries ask for it and what it is worth to them."""
    spark = asked.sparkSession
    for qids, lists in query_blocks(asked, "qid", "terms"):
        counts = [Counter(x) for x in lists]
        begin = 0
        while begin < len(qids):
            end, n = begin, 0
            while end < len(qids) and (end == begin or n + len(counts[end]) <= ENTRIES):
                n += len(counts[end])
                end += 1
            own = counts[begin:end]
            used = sorted({t for c in own for t in c})
            wanted = spark.createDataFrame([(t,) for t in used], "term string")
            value = dict(index.weights.join(F.broadcast(wanted), "term").select("term", "idf").collect()) if used else {}  # at most ENTRIES terms
            number = {t: i for i, t in enumerate(value)}
            asks = [[(number[t], m * value[t]) for t, m in c.items() if t in number] for c in own]
            yield qids[begin:end], (list(number), asks, index.mean)
            begin = end


def _score(table: pa.Table, payload: tuple[list[str], list[list[tuple[int, float]]], float], best: Best) -> None:
    used, asks, mean = payload
    n = table.num_rows
    lists, counts = table.column("terms").combine_chunks(), table.column("counts").combine_chunks()
    row = np.repeat(np.arange(n), np.diff(lists.offsets.to_numpy()))
    code = pc.index_in(lists.flatten(), pa.array(used, pa.string())).fill_null(-1).to_numpy()
    known = code >= 0
    row, code, tf = row[known], code[known], counts.flatten().to_numpy()[known].astype(float)
    dl = table.column("dl").to_numpy().astype(float)[row]
    value = tf * (K1 + 1) / (tf + K1 * (1 - B + B * dl / mean))
    order = np.argsort(code, kind="stable")
    row, code, value = row[order], code[order], value[order]
    end = np.cumsum(np.bincount(code, minlength=len(used)))
    first, end = np.append(0, end[:-1]).tolist(), end.tolist()
    there = np.flatnonzero(np.diff(np.append(0, end))).tolist()
    most = np.zeros(len(used))
    most[there] = np.maximum.reduceat(value, [first[t] for t in there]) if there else 0.0
    most = most.tolist()
    wide: dict[int, np.ndarray] = {}  # values of terms that many rows have, by row

    def by_row(t: int) -> np.ndarray | None:
        if (end[t] - first[t]) * 4 < n:
            return None
        if t not in wide:
            wide[t] = np.zeros(n)
            wide[t][row[first[t] : end[t]]] = value[first[t] : end[t]]
        return wide[t]

    total = np.empty(n)
    for s in range(0, len(asks), GROUP):
        bound, found = best.bound(slice(s, s + GROUP)).tolist(), []
        for q, least in enumerate(bound, s):
            own = sorted((w * most[t], t, w) for t, w in asks[q] if end[t] > first[t])
            if not own or any(w < 0 for _, _, w in own):
                rest, rare = 0, own
            else:
                rest = 0  # as many of the least terms as can't make a kept chunk alone
                lift = 0.0
                while rest < len(own) and (lift + own[rest][0] < least if best.full[q] else (end[own[rest][1]] - first[own[rest][1]]) * 4 >= n):
                    lift += own[rest][0]
                    rest += 1
                rare = own[rest:]
            if not rare and best.full[q]:
                continue
            total.fill(0.0)
            for _, t, w in rare:
                values = by_row(t)
                if values is None:
                    total[row[first[t] : end[t]]] += w * value[first[t] : end[t]]
                else:
                    total += w * values
            if not best.full[q]:  # what the k best have of these terms alone, all have at least
                least = max(least, float(kth(total[None], best.k)[0]) - 1e-8)
            lift = sum(x for x, _, _ in own[:rest])
            at = np.flatnonzero(total >= least - lift * (1 + 1e-12) - 1e-9)
            score = total[at]
            for x, t, w in reversed(own[:rest]):
                lift -= x
                values = by_row(t)
                if values is None:
                    rows = row[first[t] : end[t]]
                    place = np.minimum(np.searchsorted(rows, at), len(rows) - 1)
                    score += np.where(rows[place] == at, w * value[first[t] : end[t]][place], 0.0)
                else:
                    score += w * values[at]
                may = score >= least - lift * (1 + 1e-12) - 1e-9
                if not may.all():
                    at, score = at[may], score[may]
            if len(at):
                found.append((q, at, score))
        if found:
            best.meet(np.repeat([q for q, _, _ in found], [len(at) for _, at, _ in found]), np.concatenate([at for _, at, _ in found]), np.concatenate([x for _, _, x in found]))
