"""Identifiers and hashes, as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the namespace of chunk identifiers.
NAMESPACE = "6f9619ff-8b86-d011-b42d-00c04fc964ff"


def uuid5(name: Column, namespace: str = NAMESPACE) -> Column:
    """UUID version 5 of a name."""
    h = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), F.encode(name, "UTF-8")))
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(h, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)), F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def chunk_id(doc_id: Column, start: Column) -> Column:
    return uuid5(F.concat(doc_id.cast("string"), F.lit(":"), start.cast("string")))


def content_hash(text: Column) -> Column:
    return F.sha2(F.coalesce(text, F.lit("")), 256)


def fingerprint(id_: Column) -> Column:
    """Aggregate: SHA-256 over the sorted distinct ids, each followed by NUL."""
    return F.sha2(F.array_join(F.transform(F.array_sort(F.collect_set(id_)), lambda x: F.concat(x, F.lit("\0"))), ""), 256)
