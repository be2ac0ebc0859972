"""Repetition inside single documents, and cutoffs on it with controlled risk.

Measure.  Words are maximal runs of letters and digits of the lower-cased text.
A word is repeated if it lies in a stretch of ``window`` consecutive words that
also begins at an earlier word of the same text; the share is repeated words over
words.  Whole Arrow batches are measured at once: one sort of 64-bit stretch
codes, whose equal neighbours are then compared word by word, so that the result
is exact.

Decision.  Who needs that measure is decided by a cheap estimate: the share of words
that occur earlier in the same text.  Every repeated word does, so the estimate is
never below the share.  From which estimate on a text is measured is set per stratum
(bands of length) from a labelled holdout: for every cutoff of a grid, the labelled
cases that it would turn away are counted; the exact (Clopper-Pearson) binomial
upper bound on that false rejection rate is taken at a level corrected for all
strata and cutoffs (Bonferroni), and the highest cutoff up to which the bound stays
under ``alpha`` is used.  With probability ``1 - delta`` over the holdout, no
stratum turns away more than ``alpha`` of its cases; a stratum with too few labelled
cases to certify any cutoff measures everything.  Since the grid ends at the share
that makes a case, and no estimate is below the share, no case is lost at all; what
is let through is measured exactly.

Defined results: null, empty and blank texts have 0 words and a share of 0.0;
texts shorter than the window repeat nothing; repeated rows are measured each;
a null id is kept; an empty table gives no rows and no strata; other columns are
not read.
"""

from __future__ import annotations

import math
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = re.compile(r"[^\W_]+")
#: Words measured at once; a longer text is measured alone.
CHUNK = 1 << 20
GRID = (0.05, 0.10, 0.15, 0.20, 0.25, 0.30)
#: Strata by number of words: name and first length above it.
BANDS = (("short", 64), ("medium", 512), ("long", 1 << 62))
_MIX = np.uint64(0x9E3779B97F4A7C15)


def _repeated(codes: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """For each word of several texts, whether it is repeated.  ``codes``: word numbers; ``doc``: text numbers, ascending."""
    n = len(codes)
    if n < window:
        return np.zeros(n, bool)
    m = n - window + 1
    with np.errstate(over="ignore"):
        key = doc[:m].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        for j in range(window):
            key = (key ^ (codes[j : j + m].astype(np.uint64) + np.uint64(j))) * _MIX
            key ^= key >> np.uint64(29)
    inside = doc[:m] == doc[window - 1 :]
    starts = np.flatnonzero(inside)
    order = starts[np.argsort(key[starts], kind="stable")]
    same = key[order[1:]] == key[order[:-1]]
    a, b = order[1:][same], order[:-1][same]
    equal = doc[a] == doc[b]
    for j in range(window):
        equal &= codes[a + j] == codes[b + j]
    if not equal.all():  # two stretches share a code: number the stretches exactly
        rows = np.stack([doc[starts], *[codes[starts + j] for j in range(window)]], axis=1)
        _, number = np.unique(rows, axis=0, return_inverse=True)
        order = starts[np.argsort(number, kind="stable")]
        number = np.sort(number, kind="stable")
        a = order[1:][number[1:] == number[:-1]]
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, a, 1)
    np.add.at(edge, a + window, -1)
    return np.cumsum(edge[:-1]) > 0


def measure(texts: list[str | None], window: int = 8, wanted: Callable[[int, int], bool] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, different words and repeated words of each text; of texts that are not ``wanted`` (words, different words) the last is -1."""
    words = np.zeros(len(texts), np.int64)
    different = np.zeros(len(texts), np.int64)
    repeated = np.zeros(len(texts), np.int64)
    numbers: dict[str, int] = {}
    codes: list[np.ndarray] = []
    own: list[int] = []
    held = 0

    def flush() -> None:
        nonlocal held
        if own:
            doc = np.repeat(np.arange(len(own)), words[own])
            repeated[own] = np.bincount(doc[_repeated(np.concatenate(codes), doc, window)], minlength=len(own))
        codes.clear()
        own.clear()
        numbers.clear()
        held = 0

    for i, text in enumerate(texts):
        found = WORD.findall(text.lower()) if text else []
        words[i], different[i] = len(found), len(set(found))
        if wanted is not None and not wanted(len(found), int(different[i])):
            repeated[i] = -1
            continue
        if held and held + len(found) > CHUNK:
            flush()
        # a new word is numbered by its place among the words held
        codes.append(np.fromiter(map(numbers.setdefault, found, range(held, held + len(found))), np.int64, len(found)))
        own.append(i)
        held += len(found)
    flush()
    return words, different, repeated


def band(words: int) -> str:
    return next(name for name, end in BANDS if words < end)


def repetition(df: DataFrame, doc_id: str, text: str, window: int = 8, cutoffs: list[dict] | None = None) -> DataFrame:
    """doc_id, n_words, estimate, n_repeated, share, stratum.

    With ``cutoffs`` (of :func:`controlled_cutoffs`), texts whose estimate is below that of their stratum are not
    measured: n_repeated and share are null.
    """
    src = df.select(F.col(f"`{doc_id}`").alias("__id"), F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([src.schema["__id"], *[T.StructField(n, T.LongType()) for n in ("__n", "__d", "__r")]])
    least = None if cutoffs is None else {c["stratum"]: c["cutoff"] for c in cutoffs}

    def wanted(n: int, d: int) -> bool:
        return n - d >= least.get(band(n), 0.0) * n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = measure(b.column(1).to_pylist(), window, None if least is None else wanted)
            yield pa.RecordBatch.from_arrays([b.column(0), *map(pa.array, found)], names=schema.names)

    done = src.mapInArrow(run, schema)
    share = lambda x: F.when(F.col("__n") > 0, x / F.col("__n")).otherwise(F.lit(0.0))
    known = F.when(F.col("__r") >= 0, F.col("__r"))
    name = F.lit(BANDS[-1][0])
    for n, end in reversed(BANDS[:-1]):
        name = F.when(F.col("__n") < end, F.lit(n)).otherwise(name)
    return done.select(
        F.col("__id").alias(doc_id),
        F.col("__n").alias("n_words"),
        share(F.col("__n") - F.col("__d")).alias("estimate"),
        known.alias("n_repeated"),
        F.when(known.isNotNull(), share(known)).alias("share"),
        name.alias("stratum"),
    )


def reaches(cutoffs: list[dict]) -> Column:
    """Whether the estimate of a row of :func:`repetition` reaches the cutoff of its stratum; without one it does."""
    least = F.lit(0.0)
    for c in cutoffs:
        least = F.when(F.col("stratum") == c["stratum"], F.lit(c["cutoff"])).otherwise(least)
    return F.col("estimate") >= least


def upper_bound(errors: int, n: int, level: float) -> float:
    """Exact binomial upper bound: the rate at which ``errors`` or fewer of ``n`` have probability ``level``."""
    if n == 0 or errors >= n:
        return 1.0

    def below(p: float) -> float:
        logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(errors + 1)]
        top = max(logs)
        return math.exp(top) * sum(math.exp(x - top) for x in logs)

    low, high = 0.0, 1.0
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if below(mid) > level else (low, mid)
    return high


def controlled_cutoffs(holdout: DataFrame, score: str, case: str, stratum: str, alpha: float = 0.05, delta: float = 0.05, grid: tuple[float, ...] = GRID) -> list[dict]:
    """Per stratum: the cutoff below which rows are turned away, labelled cases, those lost, and the bound that certifies it.

    ``case`` is the label.  Counting is one aggregation; the driver gets one row per stratum.
    """
    real = F.coalesce(F.col(case), F.lit(False))
    counts = holdout.groupBy(stratum).agg(
        F.count_if(real).alias("n"), *[F.count_if(real & (F.col(score) < c)).alias(f"e{i}") for i, c in enumerate(grid)]
    ).collect()
    level = delta / max(1, len(counts) * len(grid))
    out = []
    for row in sorted(counts, key=lambda r: str(r[0])):
        one = {"stratum": row[0], "cutoff": 0.0, "n_cases": row["n"], "lost": 0, "bound": 0.0, "certified": False}
        for i, c in enumerate(grid):  # higher cutoffs lose no fewer cases
            bound = upper_bound(row[f"e{i}"], row["n"], level)
            if bound > alpha:
                break
            one |= {"cutoff": c, "lost": row[f"e{i}"], "bound": bound, "certified": True}
        out.append(one)
    return out
