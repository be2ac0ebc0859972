import hashlib
import math
import uuid

import pytest
from pyspark.sql import functions as F

from tarnwick.config import ConfigError, RetrievalConfig, Settings
from tarnwick.functions import ids, text, vectors
from tarnwick.functions.embedding import HashEmbedder, embed


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def test_terms_and_words(spark):
    r = one(spark, text.terms(F.lit("BM25-okapi, Été 3x")).alias("t"), text.terms(F.lit(None).cast("string")).alias("n"), text.words(F.lit(" A a\tB c ")).alias("w"))
    assert r["t"] == ["bm25", "okapi", "t", "3x"]
    assert r["n"] == []
    assert r["w"] == ["a", "b", "c"]


@pytest.mark.parametrize(
    ("source", "expected"),
    [("One. Two!\nThree? four", ["One.", "Two!", "Three?", "four"]), ("3.5 is one", ["3.5 is one"]), ("", []), ("  \n ", []), ("a.\n\n b", ["a.", "b"])],
)
def test_sentences(spark, source, expected):
    assert one(spark, text.sentences(F.lit(source)).alias("s"))["s"] == expected


def test_citations_keep_first_appearance(spark):
    r = one(spark, text.citation_markers(F.lit("a [2] b [1] c [2] [1234]")).alias("m"), text.strip_citations(F.lit("a [2]  b [1].")).alias("s"))
    assert r["m"] == [2, 1]
    assert r["s"] == "a b ."


@pytest.mark.parametrize(
    ("hay", "needle", "expected"),
    [("", "x", False), ("x", "", False), ("a b c", "b", True), ("a" * 60, "a" * 49 + "b", False), ("z" + "q" * 50, "y" + "q" * 50, True), ("q" * 49, "y" + "q" * 49, False)],
)
def test_overlaps(spark, hay, needle, expected):
    assert one(spark, text.overlaps(F.lit(hay), F.lit(needle)).alias("x"))["x"] is expected


def test_uuid5_and_fingerprint(spark):
    names = ["1:0", "doc-é:17", "x:999"]
    df = spark.createDataFrame([(n,) for n in names], "n string")
    space = uuid.UUID(ids.NAMESPACE)
    assert {r["n"]: r["u"] for r in df.select("n", ids.uuid5(F.col("n")).alias("u")).collect()} == {n: str(uuid.uuid5(space, n)) for n in names}
    expected = hashlib.sha256("".join(n + "\0" for n in sorted(names)).encode()).hexdigest()
    assert df.agg(ids.fingerprint(F.col("n")).alias("f")).first()["f"] == expected
    assert df.where("false").agg(ids.fingerprint(F.col("n")).alias("f")).first()["f"] == hashlib.sha256(b"").hexdigest()


def test_cosine_edges(spark):
    a, z = F.array(F.lit(3.0), F.lit(4.0)), F.array(F.lit(0.0), F.lit(0.0))
    r = one(spark, vectors.cosine(a, a).alias("same"), vectors.cosine(a, z).alias("zero"), vectors.cosine(a, F.array(F.lit(1.0))).alias("odd"))
    assert math.isclose(r["same"], 1.0) and r["zero"] == 0.0 and r["odd"] == 0.0


def test_hash_embedder(spark):
    v = HashEmbedder(128).embed(["a b a", "", None])
    assert math.isclose((v[0] ** 2).sum(), 1.0) and not v[1].any() and not v[2].any()
    r = one(spark, embed(F.lit("a b a")).alias("v"))["v"]
    assert r == pytest.approx(v[0].tolist())


def test_title(spark):
    path = F.lit("x/y/doc.md")
    r = one(spark, text.title(F.create_map(F.lit("title"), F.lit(" T ")), path).alias("a"), text.title(F.create_map(F.lit("title"), F.lit("  ")), path).alias("b"))
    assert (r["a"], r["b"]) == ("T", "doc.md")


def test_config_checks():
    with pytest.raises(ConfigError):
        RetrievalConfig(use_dense=False, use_lexical=False)
    with pytest.raises(ConfigError):
        RetrievalConfig(rerank_candidates=3)
    with pytest.raises(ConfigError):
        Settings(chunk_size=10, chunk_overlap=10)
    assert RetrievalConfig().with_top_k(30).rerank_candidates == 30
    assert RetrievalConfig(use_lexical=False).label == "dense only + rerank"
