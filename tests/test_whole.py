"""Queries that once left out a part of their input."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tarnwick.config import RetrievalConfig
from tarnwick.operators import fusion
from tarnwick.plans import registry, retrieval

SF = "/root/testdata/sf0.001"
tables = pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")


@tables
def test_every_query_is_reranked_and_answered(spark):
    corpus = registry.corpus(spark, SF).select("chunk_id")
    answerable = {r["qid"] for r in registry.rrf(spark, SF).where("fused_rank <= 20").join(corpus, "chunk_id", "left_semi").select("qid").distinct().collect()}
    logged = {r["qid"] for r in registry.table(spark, SF, "retrieval_results").select("qid").distinct().collect()}
    golden = {r["qid"] for r in registry.golden(spark, SF).select("qid").collect()}
    assert len(answerable) > len(golden) and "q000000000" in answerable - golden
    assert {r["qid"] for r in registry.rerank_all(spark, SF).select("qid").distinct().collect()} == answerable
    for name in ("answers", "extractive_all", "prompts_all"):
        assert sorted(r["qid"] for r in registry.queries()[name](spark, SF).collect()) == sorted(logged | answerable | golden)
    both = registry.rerank_all(spark, SF).join(registry.golden(spark, SF).select("qid"), "qid", "left_semi")
    assert sorted(map(repr, both.collect())) == sorted(map(repr, registry.rerank_overlap(spark, SF).collect()))


@tables
def test_ablation_has_every_row_that_needs_no_model(spark):
    rows = {r["config"]: r for r in registry.ablation(spark, SF).collect()}
    assert set(rows) >= {
        "dense only", "lexical only", "hybrid", "hybrid + rerank", "hybrid (weighted) + rerank", "hybrid + rerank, fixed-token chunking", "hybrid + rerank, semantic chunking",
    }
    n = registry.golden(spark, SF).where("category IS NULL OR category != 'negative'").count()
    for r in rows.values():
        assert r["n"] == n and all(0 <= r[m] <= 1 for m in ("recall", "precision", "hit", "rr", "ndcg"))
    hits = registry.ablation_hits(spark, SF).groupBy("config").agg(F.sort_array(F.collect_set("chunk_id")).alias("c")).collect()
    found = {r["config"]: r["c"] for r in hits}
    assert set(found) == set(rows)
    assert found["hybrid + rerank"] != found["hybrid + rerank, fixed-token chunking"] != found["hybrid + rerank, semantic chunking"]


@tables
def test_multi_query_takes_fifty_of_each_list(spark):
    asked = registry.golden(spark, SF)
    logged = registry.table(spark, SF, "retrieval_results").groupBy("qid").agg(F.max("expanded_queries").alias("e"))
    variants = logged.select("qid", F.posexplode("e").alias("i", "question")).where("question IS NOT NULL").withColumn("variant", F.col("i") + 1)
    config = RetrievalConfig(expansion="multi_query", use_rerank=False, top_k_dense=50, top_k_lexical=50)
    lists, _ = retrieval.candidates(registry.corpus(spark, SF), asked, config, paraphrases=variants)
    whole = fusion.rrf(lists).where("fused_rank <= 10").select("qid", "chunk_id", "score", "fused_rank", "dense_rank", "lexical_rank")
    assert sorted(map(tuple, registry.multi_query(spark, SF).collect())) == sorted(map(tuple, whole.collect()))


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="no test tables")
def test_the_default_cache_has_its_default_size(spark):
    d = "/root/testdata/sf0.01"
    n = registry.table(spark, d, "search_hits").where("retriever = 'rerank' AND score IS NOT NULL AND NOT isnan(score) AND logged_at IS NOT NULL").select("qid", "chunk_id").distinct().count()
    assert n > 1000 and registry.queries()["score_cache_default"](spark, d).count() == min(n, 10_000)
