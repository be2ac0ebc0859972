"""Versioned tables of a collection: change detection, atomic replacement, deletion, listings."""

from __future__ import annotations

import json
import uuid
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.operators.dense import check_width
from tarnwick.runtime import hadoop_path


class StoreError(RuntimeError):
    """A collection that doesn't exist, or exists with another embedding space."""


def changes(docs: DataFrame, known: DataFrame) -> DataFrame:
    """doc_id, content_hash, status: new, changed or unchanged by content hash."""
    old = known.select("doc_id", F.col("content_hash").alias("__old"))
    status = F.when(F.col("__old").isNull(), "new").when(F.col("__old") == F.col("content_hash"), "unchanged").otherwise("changed")
    return docs.join(old, "doc_id", "left").select("doc_id", "content_hash", status.alias("status"))


def upserted(current: DataFrame, docs: DataFrame, rows: DataFrame) -> DataFrame:
    """The chunk table after the given documents got ``rows`` as their whole chunk set (possibly none)."""
    return current.join(docs.select("doc_id").distinct(), "doc_id", "left_anti").unionByName(rows)


def deleted(current: DataFrame, doc_ids: DataFrame) -> DataFrame:
    return current.join(doc_ids.select("doc_id").distinct(), "doc_id", "left_anti")


def listing(docs: DataFrame, chunks: DataFrame) -> DataFrame:
    """doc_id, source_path and chunk_count (0 without chunks)."""
    n = chunks.groupBy("doc_id").agg(F.count("*").alias("n"))
    return docs.join(n, "doc_id", "left").select("doc_id", "source_path", F.coalesce("n", F.lit(0)).alias("chunk_count"))


def ingest_summary(statuses: DataFrame, chunks: DataFrame) -> DataFrame:
    """One row: documents seen, changed, unchanged and failed; chunks and tokens of the changed ones; sorted errors.

    ``statuses``: doc_id, status (new, changed, unchanged, failed), error.
    """
    per = chunks.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"))
    met = statuses.join(per, "doc_id", "left")
    new = F.col("status").isin("new", "changed")
    return met.agg(
        F.count("*").alias("docs_seen"),
        F.count_if(new).alias("docs_changed"),
        F.count_if(F.col("status") == "unchanged").alias("docs_unchanged"),
        F.count_if(F.col("status") == "failed").alias("docs_failed"),
        F.coalesce(F.sum(F.when(new, F.col("n"))), F.lit(0)).alias("chunks_created"),
        F.coalesce(F.sum(F.when(F.col("status") == "unchanged", F.col("n"))), F.lit(0)).alias("chunks_skipped"),
        F.coalesce(F.sum(F.when(new, F.col("tokens"))), F.lit(0)).alias("tokens_embedded"),
        F.array_sort(F.collect_list("error")).alias("errors"),
    )


#: Parts of a collection by a hash of the document; a write replaces the parts it touches.
BUCKETS = 32
TABLES = ("documents", "chunks")


class View:
    """One table of a collection, as of its current version."""

    def __init__(self, collection: Collection, table: str):
        self._collection, self._table = collection, table

    def version(self) -> int | None:
        state = self._collection.current()
        return None if state is None or self._table not in state["schemas"] else state["number"]

    def read(self) -> DataFrame:
        return self._collection.read(self._table)


class Collection:
    """Documents and chunks of one embedding space; (collection, doc_id) is the key.

    A version is one file that names the folders of every part of both tables.  A write puts the parts it
    touches into a new folder, and then the file of the next version, by one rename to a name that did not
    exist: readers see the old version or the new one, of both tables at once, and whatever happens before
    the rename leaves the old one as it was.  One writer at a time is assumed; a second one fails.
    """

    def __init__(self, spark: SparkSession, path: str, embedder: str, dimension: int):
        self.spark, self.path, self.embedder, self.dimension = spark, path.rstrip("/"), embedder, dimension
        self.documents, self.chunks = View(self, "documents"), View(self, "chunks")

    def _versions(self) -> list[str]:
        where, files = hadoop_path(self.spark, f"{self.path}/versions")
        return sorted(s.getPath().getName() for s in files.listStatus(where) if s.getPath().getName().endswith(".json")) if files.exists(where) else []

    def _state(self, name: str) -> dict:
        return json.loads("\n".join(r[0] for r in self.spark.read.text(f"{self.path}/versions/{name}", wholetext=True).collect()))

    def current(self) -> dict | None:
        names = self._versions()
        return self._state(names[-1]) if names else None

    def _commit(self, state: dict) -> None:
        name = f"{self.path}/versions/{state['number']:012d}.json"
        side, files = hadoop_path(self.spark, f"{self.path}/versions/.{uuid.uuid4().hex}")
        stream = files.create(side, False)
        stream.write(bytearray(json.dumps(state).encode()))
        stream.close()
        where, _ = hadoop_path(self.spark, name)
        if files.exists(where) or not files.rename(side, where):
            files.delete(side, False)
            raise StoreError(f"another writer made version {state['number']}")

    def _clean(self) -> None:
        """Delete folders that neither the current version nor the one before names, and older versions."""
        names = self._versions()
        kept = {folder for n in names[-2:] for parts in self._state(n)["parts"].values() for folder in parts.values()}
        where, files = hadoop_path(self.spark, f"{self.path}/data")
        for status in files.listStatus(where) if files.exists(where) else ():
            if status.getPath().getName() not in kept:
                files.delete(status.getPath(), True)
        for n in names[:-2]:
            files.delete(hadoop_path(self.spark, f"{self.path}/versions/{n}")[0], False)

    def ensure(self) -> None:
        """Create the collection, or check that it has this embedder and dimension."""
        state = self.current()
        if state is None:
            self._commit({"number": 0, "embedder": self.embedder, "dimension": self.dimension, "created_at": datetime.now(UTC).isoformat(), "schemas": {}, "parts": {t: {} for t in TABLES}})
        elif (state["embedder"], state["dimension"]) != (self.embedder, self.dimension):
            raise StoreError(f"collection holds {state['embedder']} vectors of width {state['dimension']}")

    def info(self) -> DataFrame:
        """One row: embedder, dimension, created_at and the number of chunks."""
        state = self._needed()
        n = self.read("chunks").agg(F.count("*").alias("chunk_count")) if "chunks" in state["schemas"] else self.spark.createDataFrame([(0,)], "chunk_count long")
        return n.select(F.lit(state["embedder"]).alias("embedder"), F.lit(state["dimension"]).alias("dimension"), F.lit(state["created_at"]).alias("created_at"), "chunk_count")

    def _needed(self) -> dict:
        state = self.current()
        if state is None:
            raise StoreError(f"no collection at {self.path}")
        return state

    def read(self, table: str, buckets: list[int] | None = None) -> DataFrame:
        state = self._needed()
        if table not in state["schemas"]:
            raise StoreError(f"no {table} at {self.path}")
        schema = T.StructType.fromJson(state["schemas"][table])
        paths = [f"{self.path}/data/{folder}/{table}/bucket={b}" for b, folder in state["parts"][table].items() if buckets is None or int(b) in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def _replace(self, state: dict, gone: DataFrame, new: dict[str, DataFrame]) -> None:
        """A version in which the documents ``gone`` have, in every table, the rows of ``new`` and no others."""
        bucket = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(BUCKETS)).cast("int")
        touched = [r[0] for r in gone.select(bucket.alias("b")).distinct().collect()]  # at most BUCKETS
        folder = uuid.uuid4().hex
        parts, schemas = {t: dict(p) for t, p in state["parts"].items()}, dict(state["schemas"])
        for table in TABLES:
            rows = new.get(table)
            if table in schemas:
                kept = deleted(self.read(table, touched), gone)
                rows = kept if rows is None else kept.unionByName(rows)
            if rows is None:
                continue
            schemas[table] = rows.schema.jsonValue()
            where = f"{self.path}/data/{folder}/{table}"
            rows.withColumn("bucket", bucket).repartition("bucket").write.partitionBy("bucket").parquet(where)
            path, files = hadoop_path(self.spark, where)
            made = {s.getPath().getName().removeprefix("bucket=") for s in files.listStatus(path) if s.isDirectory()}
            for b in map(str, touched):
                parts[table].pop(b, None)
            parts[table] |= dict.fromkeys(made, folder)
        self._commit(state | {"number": state["number"] + 1, "schemas": schemas, "parts": parts})
        self._clean()

    def upsert(self, docs: DataFrame, chunks: DataFrame) -> None:
        """The given documents replace theirs, and the given chunks are all that these have."""
        state = self._needed()
        self._replace(state, docs.select("doc_id").distinct(), {"documents": docs, "chunks": check_width(chunks, "embedding", self.dimension)})

    def delete(self, doc_ids: DataFrame) -> tuple[int, int]:
        """Documents and chunks removed, both in one version."""
        state = self._needed()
        n = tuple(self.read(t).join(doc_ids, "doc_id", "left_semi").count() for t in TABLES)
        if any(n):
            self._replace(state, doc_ids.select("doc_id").distinct(), {})
        return n
