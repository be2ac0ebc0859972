"""Metadata predicates and pages of a listing."""

from __future__ import annotations

import re
from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def matches(metadata: Column, wanted: Mapping[str, str], fallback: Column | None = None, lists: Mapping[str, str] | None = None) -> Column:
    """Whether every key has its wanted value: equal to it, or among the entries of a list.

    Metadata holds lists as JSON arrays, or, for keys in ``lists``, as text joined by the separator named there.
    A key the chunk lacks is looked up in ``fallback`` (its document); null never matches.
    """
    out = F.lit(True)
    for key, value in wanted.items():
        own = F.element_at(metadata, F.lit(key))
        if fallback is not None:
            own = F.coalesce(own, F.element_at(fallback, F.lit(key)))
        entries = F.split(own, re.escape(lists[key])) if lists and key in lists else F.when(own.startswith("["), F.from_json(own, "array<string>"))
        out = out & F.coalesce((own == F.lit(value)) | F.coalesce(F.array_contains(entries, F.lit(value)), F.lit(False)), F.lit(False))
    return out


def filter_chunks(chunks: DataFrame, documents: DataFrame | None, wanted: Mapping[str, str], lists: Mapping[str, str] | None = None) -> DataFrame:
    """Chunks whose metadata, or else their document's (where documents are given), match."""
    if documents is None:
        return chunks.where(matches(F.col("metadata"), wanted, None, lists))
    parent = documents.select("doc_id", F.col("metadata").alias("__parent"))
    return chunks.join(parent, "doc_id", "left").where(matches(F.col("metadata"), wanted, F.col("__parent"), lists)).drop("__parent")


def page(df: DataFrame, order: str, limit: int, offset: int = 0) -> DataFrame:
    """A slice in a total order, with the total number of rows before it; beyond the end it is empty."""
    total = df.agg(F.count("*").alias("total"))
    return df.orderBy(order).offset(offset).limit(limit).crossJoin(F.broadcast(total))  # the total is one row
