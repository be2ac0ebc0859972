"""Joins in which one key may hold a large part of all rows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.runtime import parallelism

#: A key is spread if it holds more than one part in ``SPREAD`` of a task's even share, and more rows than ``LEAST``.
SPREAD, LEAST = 4, 10_000


def threshold(spark: SparkSession, total: int) -> int:
    """Rows above which a key is hot; at most ``SPREAD`` times the partitions can have more of ``total``."""
    return max(LEAST, total // (SPREAD * parallelism(spark)))


def salts(size: str, limit: int) -> Column:
    return F.ceil(F.col(size) / limit).cast("int").alias("__salts")


def join_salted(rows: DataFrame, table: DataFrame, keys: list[str], hot: DataFrame, by: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row per key; the keys of ``hot`` are spread over its ``__salts``.

    ``hot`` has few rows and is broadcast.  A row takes its salt from a hash of column ``by``, and the table's
    row is repeated for each salt.  ``how``: inner or left.  Null keys meet nothing.
    """
    few = hot.select(*[F.col(k).alias(f"__hot_{i}") for i, k in enumerate(keys)], "__salts")
    same = reduce(Column.__and__, [F.col(k) == F.col(f"__hot_{i}") for i, k in enumerate(keys)])

    def marked(df: DataFrame) -> DataFrame:
        return df.join(F.broadcast(few), same, "left").drop(*[f"__hot_{i}" for i in range(len(keys))]).withColumn("__salts", F.coalesce("__salts", F.lit(1)))

    salted = marked(rows).withColumn("__salt", F.pmod(F.xxhash64(F.col(by)), F.col("__salts")).cast("int")).drop("__salts")
    repeated = marked(table).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1))).drop("__salts")
    return salted.join(repeated, [*keys, "__salt"], how).drop("__salt")


def join_spread(rows: DataFrame, table: DataFrame, keys: list[str], size: str, by: str, how: str = "inner", sizes: tuple[int, int] | None = None) -> DataFrame:
    """The same where ``table`` itself has the number of rows of each key, in column ``size``.

    It is read more than once, so it should be stored.  ``sizes``: the sum and the maximum of ``size``, where known.
    """
    total, largest = sizes or table.agg(F.coalesce(F.sum(size), F.lit(0)), F.coalesce(F.max(size), F.lit(0))).first()
    limit = threshold(rows.sparkSession, total)
    if largest <= limit:
        return rows.join(table, keys, how)
    return join_salted(rows, table, keys, table.where(F.col(size) > limit).select(*keys, salts(size, limit)), by, how)
