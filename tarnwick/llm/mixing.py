"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact token length.  For each source of each
mix the budget is its target, or all it has times the allowed repeats if that is
less.  Whole passes over the source take up the most of it; of the rest, every
length first gives its proportional part (so that lengths stay as they are in the
source), and a bounded-knapsack dynamic program over the lengths fills what is
left, the last ``FIT`` tokens and the rounding, as closely as the lengths allow.  Then the wanted number of documents of each
length is selected in a seeded order.

Only histograms are gathered, one source in a task: as many rows as a source has
different lengths.  Selection counts hash buckets and ranks only inside the one
bucket per length that the number falls into, so equal lengths of a hot source are
never ranked in one task.

Defined results: sources are compared trimmed and without case; documents with a
null source count only in the total; null and empty texts have size 0 and are
used as often as the whole passes say; a target whose source has no documents, a
null share, ratio or number of repeats (0) yields a row with nothing reached;
repeated document rows are separate documents; empty tables give no rows, or
targets with nothing reached.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

#: Tokens that the dynamic program fits exactly; above it lengths are taken greedily.
FIT = 1 << 14

FITTED = T.StructType(
    [
        T.StructField("mix_id", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("__key", T.StringType()),
        T.StructField("__size", T.LongType()),
        T.StructField("__passes", T.LongType()),
        T.StructField("__picks", T.LongType()),
        T.StructField("target_tokens", T.DoubleType()),
        T.StructField("available_tokens", T.LongType()),
        T.StructField("max_repeats", T.LongType()),
    ]
)


def source_key(source: Column) -> Column:
    return F.lower(F.regexp_replace(source, r"(?U)^\s+|\s+$", ""))


def fill(lengths: list[int], counts: list[int], budget: int) -> list[int]:
    """How many of each length to take so that the total comes as near below ``budget`` as found.

    Proportional parts of all but FIT tokens first, then the longest that fit while more
    than FIT is left, then a bounded knapsack over bit sets (bit t of ``reach``: t tokens
    can be made), which is exact for what is left.
    """
    everything = sum(n * c for n, c in zip(lengths, counts))
    if budget <= 0 or not everything:
        return [0] * len(lengths)
    if budget >= everything:
        return list(counts)
    bulk = max(0, budget - FIT)
    take = [c * bulk // everything if n else 0 for n, c in zip(lengths, counts)]
    left = budget - sum(n * t for n, t in zip(lengths, take))
    order = sorted((i for i, n in enumerate(lengths) if n), key=lambda i: -lengths[i])
    for i in order:
        more = min(counts[i] - take[i], max(0, left - FIT) // lengths[i])
        take[i] += more
        left -= more * lengths[i]
    left = min(left, everything - sum(n * t for n, t in zip(lengths, take)))
    mask, reach, steps = (1 << (left + 1)) - 1, 1, []
    for i in order:
        rest, size = counts[i] - take[i], 1
        while rest > 0 and lengths[i] * size <= left and not reach >> left & 1:
            part = min(size, rest)  # binary splitting of the bounded count
            steps.append((i, part, reach))
            reach |= (reach << part * lengths[i]) & mask
            rest, size = rest - part, size * 2
    made = reach.bit_length() - 1
    for i, part, before in reversed(steps):
        if not before >> made & 1:
            made -= part * lengths[i]
            take[i] += part
    return take


def _fit(rows: pd.DataFrame) -> pd.DataFrame:
    one = rows.iloc[0]
    sized = rows[rows["__size"].notna()].sort_values("__size")
    lengths, counts = [int(x) for x in sized["__size"]], [int(x) for x in sized["__count"]]
    available = sum(n * c for n, c in zip(lengths, counts))
    repeats = 0 if pd.isna(one["__repeats"]) else max(0, int(one["__repeats"]))
    target = 0.0 if pd.isna(one["__target"]) else float(one["__target"])
    budget = min(int(target), available * repeats)
    passes = min(repeats, budget // available) if available else 0
    picks = fill(lengths, counts, budget - passes * available) if passes < repeats else [0] * len(lengths)
    out = pd.DataFrame({"__size": lengths or [0], "__picks": picks or [0]})
    out["mix_id"], out["source"], out["__key"], out["__passes"] = one["mix_id"], one["source"], one["__key"], passes
    out["target_tokens"], out["available_tokens"], out["max_repeats"] = target, available, repeats
    return out[[f.name for f in FITTED]]


def fit(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """The plan: per mix, source and token length, the whole passes and how many documents more.

    ``sizes``: doc_id, source, n_tokens.  ``targets``: mix_id, source, target_share,
    max_repeats, budget_ratio.
    """
    histogram = sizes.groupBy(source_key(F.col("source")).alias("__key"), F.col("n_tokens").alias("__size")).agg(F.count("*").alias("__count"))
    total = histogram.agg(F.coalesce(F.sum(F.col("__size") * F.col("__count")), F.lit(0)).alias("__total"))
    wanted = targets.crossJoin(F.broadcast(total)).select(  # the total is one row
        "mix_id",
        "source",
        source_key(F.col("source")).alias("__want"),
        (F.col("target_share") * F.col("budget_ratio") * F.col("__total")).alias("__target"),
        F.col("max_repeats").alias("__repeats"),
    )
    rows = wanted.join(histogram, F.col("__want") == F.col("__key"), "left").drop("__key").withColumnRenamed("__want", "__key")
    return rows.groupBy("mix_id", "source").applyInPandas(_fit, FITTED)


def report(plan: DataFrame) -> DataFrame:
    """Per mix and source: target and reached tokens, both as shares of the mix, and whether it falls short.

    A source falls short if what the fit reached is below the target though no use of any document is left.
    """
    per = plan.groupBy("mix_id", "source").agg(
        F.first("target_tokens").alias("target_tokens"),
        F.first("available_tokens").alias("available_tokens"),
        F.first("max_repeats").alias("max_repeats"),
        (F.first("__passes") * F.first("available_tokens") + F.sum(F.col("__picks") * F.col("__size"))).alias("reached_tokens"),
    )
    left = F.col("available_tokens") * F.col("max_repeats") - F.col("reached_tokens")
    mix = Window.partitionBy("mix_id")
    return per.select(
        "*",
        ((F.col("reached_tokens") < F.col("target_tokens")) & (left == 0)).alias("short"),
        F.try_divide("target_tokens", F.sum("target_tokens").over(mix)).alias("target_share"),
        F.try_divide("reached_tokens", F.sum("reached_tokens").over(mix)).alias("reached_share"),
    )


def select(sizes: DataFrame, plan: DataFrame, seed: int = 42) -> DataFrame:
    """mix_id, doc_id, source, n_tokens and repeats of every document used; which of equal length is seeded."""
    hashed = F.xxhash64(F.lit(seed), F.col("doc_id"))
    docs = sizes.select("doc_id", source_key(F.col("source")).alias("__key"), F.col("n_tokens").alias("__size"), hashed.alias("__h"))
    docs = docs.withColumn("__b", F.shiftrightunsigned("__h", 52).cast("int")).where(F.col("__key").isNotNull())
    bucket = docs.groupBy("__key", "__size", "__b").agg(F.count("*").alias("__n"))
    before = Window.partitionBy("__key", "__size").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    bucket = bucket.withColumn("__before", F.coalesce(F.sum("__n").over(before), F.lit(0)))
    use = plan.select("mix_id", "source", "__key", "__size", "__passes", "__picks").where("__passes > 0 OR __picks > 0")
    need = bucket.join(use, ["__key", "__size"]).withColumn("__need", F.greatest(F.lit(0), F.least(F.col("__n"), F.col("__picks") - F.col("__before"))))
    need = need.where("__passes > 0 OR __need > 0").select("mix_id", "source", "__key", "__size", "__b", "__n", "__passes", "__need")
    rows = docs.join(need, ["__key", "__size", "__b"])
    whole = rows.where("__need = 0 OR __need = __n").withColumn("__more", F.when(F.col("__need") > 0, 1).otherwise(0))
    seeded = Window.partitionBy("mix_id", "source", "__size", "__b").orderBy("__h", "doc_id")
    part = rows.where("__need > 0 AND __need < __n").withColumn("__more", F.when(F.row_number().over(seeded) <= F.col("__need"), 1).otherwise(0))
    out = whole.unionByName(part).withColumn("repeats", F.col("__passes") + F.col("__more")).where("repeats > 0")
    return out.select("mix_id", "doc_id", "source", F.col("__size").alias("n_tokens"), "repeats")
