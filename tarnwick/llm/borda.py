"""One ranking from several differently scaled scores, by Borda count.

Only ranks of scores are used, so no range or outlier of a score decides alone.
In each list, items get competition ranks by score with ties averaged.  Items of a
query that a list does not score share the ranks after its last one and get their
mid-rank.  A list gives an item as many points as the query has items, less its
rank; points are weighted by list, summed, and sorted with the identifier as tie
break.

Ranks in groups of any size come from a range-partitioned sort, with so many
partitions that each holds about ``ROWS`` rows however many there are: every
partition ranks its own rows, and the driver stitches the at most two groups per
partition that cross its borders (runs of equal scores included).  No query, however
hot, is gathered in one task; where statistics of a query meet its items, hot
queries are spread over salts.

Defined results: rows with a null query, list or item and null or NaN scores do
not count; a repeated item counts once per list, with its highest score; positions
break ties by item (as bytes of its text); queries without a configuration use
every list with weight 1; a list that is off, has weight 0 or has no valid score
is left out; items in no counted list do not appear; empty input gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.operators.skew import join_spread
from tarnwick.runtime import parallelism, stage, unstage

#: Rows that a partition of the sort should have; its task holds them as Arrow columns.
ROWS = 250_000


def _changes(columns: list[pa.Array]) -> np.ndarray:
    """True where a row differs from the one before in any column; the first row always does."""
    n = len(columns[0])
    out = np.zeros(n, bool)
    out[:1] = True
    for c in columns:
        out[1:] |= pc.not_equal(c[1:], c[:-1]).to_numpy(zero_copy_only=False)
    return out


def _runs(starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row, where its run starts and how long it is."""
    first = np.flatnonzero(starts)
    size = np.diff(np.append(first, len(starts)))
    return np.repeat(first, size), np.repeat(size, size)


def ranked(df: DataFrame, groups: list[str], item: str, score: str) -> DataFrame:
    """Adds ``position`` (ties by item) and ``rank`` (ties averaged) within the groups, highest score first.

    ``df`` has the string columns ``groups`` and ``item``, unique together, and a non-null double ``score``.
    It is stored first, since the sort reads it twice: for its borders and for its rows.
    """
    src = stage(df.select(*groups, item, score))
    n_parts = max(parallelism(df.sparkSession), -(-src.count() // ROWS))
    order = [*[F.asc(g) for g in groups], F.desc(score), F.asc(item)]
    parts = src.repartitionByRange(n_parts, *order).sortWithinPartitions(*order)
    own = [("__pos", T.LongType()), ("__above", T.LongType()), ("__ties", T.LongType()), ("__edge", T.BooleanType())]
    schema = T.StructType([*src.schema.fields, *[T.StructField(n, t) for n, t in own]])
    k = len(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held).combine_chunks()
        cols = [c.chunk(0) for c in table.columns]
        group = _changes(cols[:k])
        begin, _ = _runs(group)
        tie, size = _runs(group | _changes([cols[k + 1]]))
        edge = (begin == 0) | (begin == begin[-1])
        more = [np.arange(len(begin)) - begin + 1, tie - begin, size, edge]
        out = pa.Table.from_arrays([*cols, *[pa.array(x) for x in more]], names=schema.names)
        yield from out.to_batches(max_chunksize=65536)

    sorted_ = stage(parts.mapInArrow(run, schema).withColumn("__part", F.spark_partition_id()))
    unstage(src)
    edges = (
        sorted_.where("__edge")
        .groupBy("__part", *groups)
        .agg(
            F.count("*").alias("n"),
            F.max(score).alias("top"),
            F.max_by("__ties", score).alias("top_n"),
            F.min(score).alias("low"),
            F.min_by("__ties", score).alias("low_n"),
        )
        .collect()  # at most two rows per partition
    )
    seams = _stitch(sorted(edges, key=lambda e: e["__part"]), groups)
    fields = [T.StructField("__part", T.IntegerType()), *[src.schema[g] for g in groups]]
    fields += [T.StructField(n, T.LongType()) for n in ("__off", "__top_above", "__top_ties", "__low_above", "__low_ties")]
    fields += [T.StructField(n, T.DoubleType()) for n in ("__top", "__low")]
    seam = df.sparkSession.createDataFrame(seams, T.StructType(fields))
    met = sorted_.join(F.broadcast(seam), ["__part", *groups], "left")  # at most two rows per partition
    off = F.coalesce("__off", F.lit(0))
    top, low = F.col(score) == F.col("__top"), F.col(score) == F.col("__low")
    above = F.when(top, F.col("__top_above")).when(low, F.col("__low_above")).otherwise(F.col("__above") + off)
    ties = F.when(top, F.col("__top_ties")).when(low, F.col("__low_ties")).otherwise(F.col("__ties"))
    return met.select(*groups, item, score, (F.col("__pos") + off).alias("position"), (above + (ties + 1) / 2).alias("rank"))


def _stitch(edges: list, groups: list[str]) -> list[tuple]:
    """Offsets of the parts of groups that cross partitions, and the full extent of their first and last runs."""
    chains: dict[tuple, list] = {}
    for e in edges:
        chains.setdefault(tuple(e[g] for g in groups), []).append(e)
    out = []
    for key, chain in chains.items():
        offset, runs, where = 0, [], []  # runs: [score, rows above, rows]
        for e in chain:
            if not runs or runs[-1][0] != e["top"]:
                runs.append([e["top"], offset, 0])
            runs[-1][2] += e["top_n"]
            first = len(runs) - 1
            if e["low"] != e["top"]:
                runs.append([e["low"], offset + e["n"] - e["low_n"], e["low_n"]])
            where.append((e, offset, first, len(runs) - 1))
            offset += e["n"]
        for e, off, first, last in where:
            a, b = runs[first], runs[last]
            out.append((e["__part"], *key, off, a[1], a[2], b[1], b[2], e["top"], e["low"]))
    return out


def positions(hits: DataFrame, query: str, list_: str, item: str, score: str) -> DataFrame:
    """query, list, item, score, position and averaged rank of every valid hit, repeated ones once."""
    src = hits.select(*[F.col(f"`{c}`").cast("string").alias(a) for c, a in ((query, "qid"), (list_, "list"), (item, "item"))], F.col(f"`{score}`").cast("double").alias("score"))
    src = src.dropna().where(~F.isnan("score")).withColumn("score", F.col("score") + F.lit(0.0))
    distinct = src.groupBy("qid", "list", "item").agg(F.max("score").alias("score"))
    return ranked(distinct, ["qid", "list"], "item", "score")


def borda(placed: DataFrame, weights: DataFrame | None, lists: list[str], first: int = 3, contest: int = 8) -> DataFrame:
    """Points of every item: qid, item, points, n_lists and, per counted list, its position (``pos_<list>``).

    ``head_points``: what an item has at least that is among the first ``first`` of every counted list of
    the query; ``contest_points``: what one has that is among the first ``contest`` of two of them.
    ``placed`` comes from :func:`positions`; ``weights`` has one row per qid with
    ``w_<list>`` (0 or null: the list is off).
    """
    one = placed.groupBy("qid", "item").agg(
        *[F.max(F.when(F.col("list") == x, F.col("position"))).alias(f"p_{x}") for x in lists],
        *[F.max(F.when(F.col("list") == x, F.col("rank"))).alias(f"r_{x}") for x in lists],
    )
    mask = reduce(lambda a, b: a + b, [F.when(F.col(f"p_{x}").isNotNull(), 1 << i).otherwise(0) for i, x in enumerate(lists)])
    one = one.withColumn("mask", mask)
    sets = range(1, 1 << len(lists))
    stats = one.groupBy("qid").agg(
        *[F.count(f"p_{x}").alias(f"n_{x}") for x in lists],
        *[F.count_if(F.col("mask") == s).alias(f"m_{s}") for s in sets],
        F.count("*").alias("size"),
        *[F.max(F.when(F.col(f"p_{x}") <= n, F.col(f"r_{x}"))).alias(f"{name}_{x}") for x in lists for name, n in (("head", first), ("near", contest))],
    )
    if weights is None:
        stats = stats.select("*", *[F.lit(1.0).alias(f"w_{x}") for x in lists])
    else:
        known = weights.select("qid", *[f"w_{x}" for x in lists], F.lit(True).alias("known"))
        stats = stats.join(known, "qid", "left").withColumns({f"w_{x}": F.when(F.col("known"), F.col(f"w_{x}")).otherwise(F.lit(1.0)) for x in lists})
    on = {x: F.when((F.col(f"n_{x}") > 0) & (F.col(f"w_{x}") > 0), F.lit(True)).otherwise(False) for x in lists}
    used = reduce(lambda a, b: a + b, [F.when(on[x], 1 << i).otherwise(0) for i, x in enumerate(lists)])
    stats = stats.withColumn("used", used)
    items = reduce(lambda a, b: a + b, [F.when(F.col("used").bitwiseAND(F.lit(s)) > 0, F.col(f"m_{s}")).otherwise(0) for s in sets])
    stats = stats.withColumns({"m": items, "n_lists": F.bit_count("used")})

    def least(x: str, name: str) -> Column:  # points of the worst rank among the first positions of a list; 0 where it is off
        bit = F.col("used").bitwiseAND(F.lit(1 << lists.index(x))) > 0
        return F.when(bit, F.col(f"w_{x}") * (F.col("m") - F.col(f"{name}_{x}"))).otherwise(F.lit(0.0))

    head = reduce(lambda a, b: a + b, [least(x, "head") for x in lists])
    pairs = [F.when(on_both, least(x, "near") + least(y, "near")) for i, x in enumerate(lists) for y in lists[i + 1 :] for on_both in [F.col("used").bitwiseAND(F.lit(1 << i | 1 << lists.index(y))) == (1 << i | 1 << lists.index(y))]]
    stats = stats.select("qid", "used", "m", "n_lists", "size", *[f"w_{x}" for x in lists], *[f"n_{x}" for x in lists], head.alias("head_points"), (F.least(*pairs) if len(pairs) > 1 else pairs[0] if pairs else F.lit(None).cast("double")).alias("contest_points"))

    stats = stage(stats)
    both = join_spread(one, stats, ["qid"], "size", "item").where(F.col("mask").bitwiseAND(F.col("used")) > 0)
    points: Column = F.lit(0.0)
    for i, x in enumerate(lists):
        rank = F.coalesce(F.col(f"r_{x}"), (F.col(f"n_{x}") + 1 + F.col("m")) / 2)
        points = points + F.when(F.col("used").bitwiseAND(F.lit(1 << i)) > 0, F.col(f"w_{x}") * (F.col("m") - rank)).otherwise(F.lit(0.0))
    shown = [F.when(F.col("used").bitwiseAND(F.lit(1 << i)) > 0, F.col(f"p_{x}")).alias(f"pos_{x}") for i, x in enumerate(lists)]
    return both.select("qid", "item", points.alias("points"), "n_lists", "head_points", "contest_points", *shown)


def fused(scored: DataFrame) -> DataFrame:
    """qid, item, points and final position."""
    return ranked(scored, ["qid"], "item", "points").select("qid", "item", "points", "position")


def heads(scored: DataFrame, lists: list[str], first: int = 3, contest: int = 8) -> DataFrame:
    """qid and item of undisputed heads: at least two lists count, the item is among the first ``first`` of every
    one, and no other item is among the first ``contest`` of two or more.

    The count decides who is looked at: only items whose points reach what a head, or one who contests it, has
    at least.  Their positions are then checked.  ``scored`` comes from :func:`borda` with the same numbers.
    """
    slack = 1e-9 * (1 + F.abs("points"))
    upper = scored.where((F.col("n_lists") >= 2) & (F.col("points") + slack >= F.least("head_points", "contest_points")))
    place = [F.col(f"pos_{x}") for x in lists]
    inside = reduce(lambda a, b: a + b, [F.when(p <= first, 1).otherwise(0) for p in place])
    near = reduce(lambda a, b: a + b, [F.when(p <= contest, 1).otherwise(0) for p in place])
    head = F.when(inside == F.col("n_lists"), F.col("item"))
    per = upper.groupBy("qid").agg(F.count_if(near >= 2).alias("n"), F.max(head).alias("item"))
    return per.where("n = 1 AND item IS NOT NULL").select("qid", "item")


def run_weights(results: DataFrame, runs: DataFrame) -> DataFrame:
    """Weights of the dense, lexical and rerank lists of each qid, from the configuration of its run.

    Under weighted fusion the dense list has ``dense_weight`` (null or NaN: 0.5) and the
    lexical list the rest; otherwise, and for the rerank list, the weight is 1.
    """
    c = F.col("config")
    weighted = F.coalesce(F.lower(F.regexp_replace(c["fusion"], r"(?U)^\s+|\s+$", "")), F.lit("rrf")) == "weighted"
    w = F.coalesce(F.nanvl(c["dense_weight"].cast("double"), F.lit(None).cast("double")), F.lit(0.5))
    w = F.least(F.greatest(w, F.lit(-1e9)), F.lit(1e9))  # infinite weights would leave nothing to add
    per = runs.select(
        "run_id",
        F.when(c["use_dense"], F.when(weighted, F.greatest(w, F.lit(0.0))).otherwise(1.0)).otherwise(0.0).alias("w_dense"),
        F.when(c["use_lexical"], F.when(weighted, F.greatest(1 - w, F.lit(0.0))).otherwise(1.0)).otherwise(0.0).alias("w_lexical"),
        F.when(c["use_rerank"], F.lit(1.0)).otherwise(0.0).alias("w_rerank"),
    ).dropDuplicates(["run_id"])
    return results.select("qid", "run_id").where("qid IS NOT NULL").groupBy("qid").agg(F.min("run_id").alias("run_id")).join(per, "run_id").drop("run_id")
