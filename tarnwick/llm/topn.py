"""Top N items within every group, by simultaneous per-group bisection.

Every hit has an order-preserving code: a signed 64-bit integer that sorts like
its score, followed by integers that sort like the bytes of its identifier.  All
groups refine their cutoffs at once: midpoints cut the bracket of each group into
some two hundred sections, one aggregation counts the rows of every section and so
those above each midpoint, and the bracket shrinks to the section that holds the
N-th row, narrowed to the codes that occur in it.  Rows above the bracket are kept,
rows below it are out, and only rows inside it go to the next round, until each
group holds exactly N (or all its rows, if fewer).

The first bracket is that of the whole table, so the first round needs no join
before it counts.  No group is ever sorted or gathered: a hot group costs a counter
per section and map task, and where the cutoffs (one row per group) meet the rows,
hot groups are spread over salts.  Rounds are written to the shared folder, so lost
executors cost a re-read; the tables of a finished round are deleted.

Defined results: rows with a null group column, null item or null or NaN score do
not count; infinite scores do, and -0.0 equals 0.0.  A repeated item counts once
per group, with its highest score.  Equal scores: smaller item (as bytes of its
text) first.  Empty input gives no rows.  Columns other than the named ones are
ignored, whatever their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.operators.skew import join_spread
from tarnwick.runtime import stage, unstage

#: A bracket is cut into more than half as many sections, and at most one more than these (a power of two).
SECTIONS = 256
#: Identifier bytes per level of the code, and the range of such a level.
ID_BYTES = 6
ID_LOW = -((1 << 51) - 1)


def score_code(score: Column) -> Column:
    """A signed 64-bit integer that sorts as the double does (no NaN): exponent and mantissa, negated for negative scores."""
    size = F.abs(score)
    rough = F.greatest(F.least(F.floor(F.log2(size)), F.lit(1023)), F.lit(-1022)).cast("int")
    power = F.pow(F.lit(2.0), rough)
    exponent = F.when(size < power, rough - 1).when(size >= power * 2, rough + 1).otherwise(rough)
    mantissa = ((size / F.pow(F.lit(2.0), exponent) - 1) * F.lit(2.0**52)).cast("long")
    normal = (exponent + 1023).cast("long") * F.lit(1 << 52) + mantissa
    tiny = (size * F.lit(2.0**537) * F.lit(2.0**537)).cast("long")  # below the normal range: multiples of 2 ** -1074
    code = F.when(size == float("inf"), F.lit(0x7FF << 52)).when(size < 2.0**-1022, tiny).otherwise(normal)
    return F.when(score < 0, -code).otherwise(code)


def item_code(item: Column, level: Column) -> Column:
    """Level 1, 2, ... of the identifier: larger for smaller text; six bytes and how many of them exist."""
    part = F.substring(F.encode(item, "UTF-8"), (level - 1) * ID_BYTES + 1, F.lit(ID_BYTES))
    digits = F.rpad(F.hex(part), 2 * ID_BYTES, "0")
    return -(F.conv(digits, 16, 10).cast("long") * 8 + F.octet_length(part))


def top_n(df: DataFrame, groups: list[str], item: str, score: str, n: int) -> DataFrame:
    """The ``n`` best items of every group: the group columns, the item and its score."""
    if n < 1:
        raise ValueError("n must be at least 1")
    g = [f"__g{i}" for i in range(len(groups))]
    value = F.col(f"`{score}`").cast("double")
    hits = df.select(*[F.col(f"`{c}`").alias(a) for c, a in zip(groups, g)], F.col(f"`{item}`").cast("string").alias("__item"), value.alias("__score"))
    hits = hits.dropna(subset=[*g, "__item", "__score"]).where(~F.isnan("__score"))
    distinct = hits.groupBy(*g, "__item").agg(F.max("__score").alias("__score"))
    rows = stage(distinct.withColumn("__code", score_code(F.col("__score"))))

    ends = rows.agg(F.min("__code"), F.max("__code")).first()  # one row
    if ends[0] is None:
        return _named(rows, g, groups, item, score)
    bracket = {"__level": F.lit(0), "__low": F.lit(ends[0]).cast("long"), "__shift": F.lit(_shift(*ends)), "__need": F.lit(n).cast("long")}
    open_ = rows.withColumns(bracket)
    kept: list[DataFrame] = []
    used: list[DataFrame] = [rows]
    while True:
        cut = stage(_cutoffs(open_, g))
        seen = cut.agg(F.sum("__size"), F.max("__size"), F.count_if(~F.col("__whole"))).first()  # one row
        decided = stage(_decide(open_, cut, g, (seen[0], seen[1])))
        unstage(cut, *([rows] if not kept else []))
        used.append(decided)
        kept.append(decided.where("__done").select(*g, "__item", "__score"))
        if not seen[2]:
            break
        open_ = decided.where("NOT __done").drop("__done")
    if len(kept) == 1:
        return _named(kept[0], g, groups, item, score)
    out = stage(reduce(DataFrame.unionByName, kept))
    unstage(*used)
    return _named(out, g, groups, item, score)


def _named(rows: DataFrame, g: list[str], groups: list[str], item: str, score: str) -> DataFrame:
    return rows.select(*[F.col(a).alias(c) for a, c in zip(g, groups)], F.col("__item").alias(item), F.col("__score").alias(score))


def _shift(low: int, high: int) -> int:
    """By how many bits codes are shifted so that the bracket has at most SECTIONS + 1 different ones."""
    return max(0, (high - low).bit_length() - (SECTIONS.bit_length() - 1))


def _shifts(low: Column, high: Column) -> Column:
    """The same as an expression; halves, so that no difference overflows."""
    half = F.shiftright(high, 1) - F.shiftright(low, 1) + 1
    return F.greatest(F.lit(0), F.ceil(F.log2(half)).cast("int") + 2 - (SECTIONS.bit_length() - 1))


def _cutoffs(rows: DataFrame, g: list[str]) -> DataFrame:
    """One refinement of every group: its new bracket, how many rows it still needs from it, and whether that is all it holds."""
    section = F.call_function("shiftright", F.col("__now"), F.col("__shift")) - F.call_function("shiftright", F.col("__low"), F.col("__shift"))
    counted = _coded(rows).groupBy(*g, section.alias("__section")).agg(
        F.first("__need").alias("__need"), F.count("*").alias("n"), F.min("__now").alias("low"), F.max("__now").alias("high")
    )
    one = F.struct((-F.col("__section")).alias("at"), "n", "low", "high")  # at most SECTIONS + 2 of them
    per = counted.groupBy(*g).agg(F.first("__need").alias("__need"), F.sum("n").alias("__size"), F.array_sort(F.collect_list(one)).alias("s"))
    # From the top, the section in which the wanted number of rows is reached, and the rows above it.
    start = F.struct(F.lit(0).cast("long").alias("above"), F.lit(False).alias("met"), F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("low"), F.lit(0).cast("long").alias("high"))
    found = F.aggregate(
        "s",
        start,
        lambda a, x: F.when(a["met"], a).otherwise(
            F.struct((a["above"] + a["n"]).alias("above"), (a["above"] + a["n"] + x["n"] >= F.col("__need")).alias("met"), x["n"].alias("n"), x["low"].alias("low"), x["high"].alias("high"))
        ),
    )
    per = per.select(*g, "__size", "__need", found.alias("f"))
    return per.select(
        *g,
        "__size",
        F.col("f.low").alias("__low1"),
        F.col("f.high").alias("__high1"),
        (F.col("__need") - F.col("f.above")).alias("__need1"),
        (F.col("f.n") <= F.col("__need") - F.col("f.above")).alias("__whole"),
    )


def _coded(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__now", F.when(F.col("__level") == 0, F.col("__code")).otherwise(item_code(F.col("__item"), F.col("__level"))))


def _decide(rows: DataFrame, cut: DataFrame, g: list[str], sizes: tuple[int, int]) -> DataFrame:
    """The rows above the new brackets (done) and those inside them.

    Groups whose bracket has shrunk to one code go on to the next level of the code.
    """
    narrow = _coded(rows).select(*g, "__item", "__score", "__code", "__level", "__now")
    met = join_spread(narrow, cut, g, "__size", "__item", sizes=sizes).where(F.col("__now") >= F.col("__low1"))
    flat = F.col("__low1") == F.col("__high1")
    return met.select(
        *g,
        "__item",
        "__score",
        "__code",
        F.when(flat, F.col("__level") + 1).otherwise(F.col("__level")).alias("__level"),
        F.when(flat, F.lit(ID_LOW)).otherwise(F.col("__low1")).cast("long").alias("__low"),
        F.when(flat, F.lit(_shift(ID_LOW, 0))).otherwise(_shifts(F.col("__low1"), F.col("__high1"))).alias("__shift"),
        F.col("__need1").alias("__need"),
        (F.col("__whole") | (F.col("__now") > F.col("__high1"))).alias("__done"),
    )
