"""Continuous ingest of a watched folder: parse, detect changes, chunk, embed, replace."""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from tarnwick.functions.embedding import Embedder, HashEmbedder, embed
from tarnwick.operators import chunking
from tarnwick.operators.store import Collection, changes
from tarnwick.runtime import stage, unstage
from tarnwick.sources.files import SUFFIXES, UnsupportedFormatError, parse

BINARY = "path string, modificationTime timestamp, length long, content binary"


def ingest(collection: Collection, files: DataFrame, size: int = 512, model: Embedder | None = None, strategy: str = "recursive_structural", overlap: int = 64) -> DataFrame:
    """Ingest a batch of (path, content); returns doc_id, status, error.  Unchanged documents are neither chunked nor embedded.

    What is parsed, and which documents changed, is stored for the batch, so that neither is done twice.
    """
    model = model or HashEmbedder(collection.dimension)
    docs = stage(parse(files))
    good = docs.where("error IS NULL").dropDuplicates(["doc_id"])
    if collection.documents.version() is None:
        status = good.select("doc_id", "content_hash", F.lit("new").alias("status"))
    else:
        status = changes(good, collection.documents.read())
    status = stage(status)
    todo = good.join(status.where("status != 'unchanged'").select("doc_id"), "doc_id", "left_semi")
    if not todo.isEmpty():
        made = chunking.chunker(strategy, size, overlap, model)(todo)
        collection.upsert(todo.drop("error"), made.withColumn("embedding", embed(F.col("text"), model).cast("array<float>")))
    failed = docs.where("error IS NOT NULL").select("doc_id", F.lit("failed").alias("status"), "error")
    out = stage(status.select("doc_id", "status", F.lit(None).cast("string").alias("error")).unionByName(failed))
    unstage(docs, status)
    return out


def watch(spark: SparkSession, directory: str, collection: Collection, checkpoint: str, size: int = 512, strategy: str = "recursive_structural") -> StreamingQuery:
    """A stream over the folder; each micro-batch is one atomic replacement. A batch that is run again changes nothing."""
    collection.ensure()
    files = spark.readStream.format("binaryFile").schema(BINARY).option("recursiveFileLookup", "true").load(directory)
    wanted = files.where(F.lower(F.regexp_extract("path", r"(\.[A-Za-z]+)$", 1)).isin(*SUFFIXES)).select("path", "content")
    return wanted.writeStream.foreachBatch(lambda df, _: unstage(ingest(collection, df, size, strategy=strategy))).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


# Fixed value: the largest upload.
UPLOAD_BYTES = 25 << 20


def upload(collection: Collection, name: str, content: bytes, size: int = 512) -> DataFrame:
    """Ingest one uploaded file; one of an unknown kind, or too large, is refused."""
    suffix = PurePosixPath(name).suffix.lower()
    if suffix not in SUFFIXES:
        raise UnsupportedFormatError(f"unsupported format {suffix!r}")
    if len(content) > UPLOAD_BYTES:
        raise ValueError(f"{name!r} has {len(content)} bytes; {UPLOAD_BYTES} are allowed")
    raw = collection.spark.createDataFrame([(PurePosixPath(name).name, bytearray(content))], "path string, content binary")
    return ingest(collection, raw, size)


def replay(answers: DataFrame) -> DataFrame:
    """qid, position, event, data: finished answers as a stream of words, each closed by ``done``."""
    words = answers.select("qid", F.posexplode(F.split("answer", " ")).alias("position", "data")).withColumn("event", F.lit("token"))
    ends = answers.select("qid", F.size(F.split("answer", " ")).alias("position"), F.lit("").alias("data"), F.lit("done").alias("event"))
    return words.unionByName(ends).select("qid", "position", "event", "data")
