"""Searches of many questions: what is left out of the work changes nothing."""

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from tarnwick.config import RetrievalConfig
from tarnwick.functions.embedding import HashEmbedder
from tarnwick.operators import bm25, dense, ranking
from tarnwick.operators.rerank import overlap_score, pair_scores
from tarnwick.plans import retrieval


def test_terms_that_cannot_lift_a_chunk_are_left_out():
    rng = np.random.default_rng(6)
    share = np.array([0.9, 0.8, 0.5, *[0.05] * 20])
    has = [[(t, int(rng.integers(1, 4))) for t in np.flatnonzero(rng.random(23) < share)] or [(0, 1)] for _ in range(4000)]
    names = [f"n{i:04d}" for i in rng.permutation(4000)]
    dl = [sum(c for _, c in d) for d in has]
    used, mean = [f"t{t}" for t in range(23)], float(np.mean(dl))
    asks = [[(t, float(w)) for t, w in zip([0, 1, 2, *rng.choice(np.arange(3, 23), 3, False)], [1.5, 1.5, 1.0, 3, 3.5, 4])] for _ in range(30)] + [[], [(0, 1.5)], [(22, 2.0)]]
    table = pa.table({"chunk_id": names, "terms": [[used[t] for t, _ in d] for d in has], "counts": pa.array([[c for _, c in d] for d in has], pa.list_(pa.int32())), "dl": pa.array(dl, pa.int32())})
    best = ranking.Best(len(asks), 10, 0.0)
    for s in range(0, 4000, 1300):
        part = table.slice(s, 1300)
        best.begin(part.column(0).to_pylist())
        bm25._score(part, (used, asks, mean), best)
    query, name, value = best.rows()
    for q, own in enumerate(asks):
        weight = dict(own)
        score = [sum(weight.get(t, 0.0) * c * 2.5 / (c + 1.5 * (0.25 + 0.75 * n / mean)) for t, c in d) for d, n in zip(has, dl)]
        expected = sorted((-round(x, 9), i) for x, i in zip(score, names) if x > 1e-9)[:10]
        got = sorted(zip((-value[query == q]).tolist(), name[query == q].tolist()))
        assert [i for _, i in got] == [i for _, i in expected] and all(math.isclose(a, b, abs_tol=2e-9) for (a, _), (b, _) in zip(got, expected))


def test_rows_that_are_moved_do_not_grow_with_the_partitions(spark):
    rows = spark.createDataFrame([(str(i), [1.0, float(i)]) for i in range(400)], "chunk_id string, embedding array<double>").repartition(40)
    got = dense.top_k(rows, spark.createDataFrame([("q", [1.0, 2.0])], "qid string, embedding array<double>"), 3, 2)
    assert f"Coalesce {spark.sparkContext.defaultParallelism}" in got._jdf.queryExecution().toString()
    assert got.orderBy("rank").first()["chunk_id"] == "2"


def test_ablation_embeds_a_text_once_for_all_blocks(spark, monkeypatch, tmp_path):
    class Noting(HashEmbedder):
        def embed(self, texts):
            with open(where, "a") as f:
                f.writelines(f"{t}\n" for t in texts)
            return super().embed(texts)

    where = str(tmp_path / "texts")
    monkeypatch.setattr(ranking, "BLOCK", 1)
    chunks = spark.createDataFrame([(f"c{i}", f"chunk {w} text") for i, w in enumerate("alpha beta gamma".split())], "chunk_id string, text string").coalesce(1)
    asked = spark.createDataFrame([(f"q{i}", f"question {w}") for i, w in enumerate("alpha beta gamma delta".split())], "qid string, question string")
    got = retrieval.ablate(chunks, asked, [RetrievalConfig(), RetrievalConfig(use_rerank=False)], Noting()).collect()
    assert {(r["qid"], r["chunk_id"]) for r in got if r["final_rank"] == 1 and r["config"] == "hybrid"} >= {("q0", "c0"), ("q1", "c1"), ("q2", "c2")}
    assert sorted(x for x in open(where).read().split("\n") if x.startswith("chunk")) == ["chunk alpha text", "chunk beta text", "chunk gamma text"]


def test_pair_scores_are_those_of_the_expression(spark):
    texts = ["Alpha  beta gamma", " BETA\u0085beta\x1cdelta", "", None, "ΣΟΦΟΣ σοφος　x", "a​b c"]
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(texts)], "chunk_id string, text string")
    asked = spark.createDataFrame([("q0", "beta  gamma alpha"), ("q1", "σοφος X beta"), ("q2", None), ("q3", "a​b c c")], "qid string, question string")
    pairs = asked.crossJoin(chunks)
    expected = pairs.select("qid", "chunk_id", F.round(overlap_score(F.col("question"), F.col("text")), 9).alias("s")).collect()
    assert sorted(map(tuple, pair_scores(pairs.select("qid", "chunk_id"), asked, chunks).collect())) == sorted(map(tuple, expected))
