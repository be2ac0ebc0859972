import random

import pytest

from tarnwick.llm import borda
from tarnwick.llm.topn import top_n

HITS = "qid string, retriever string, chunk_id string, score double, __item int, __code string"


def brute(rows, n):
    best = {}
    for q, r, c, s in rows:
        if None in (q, r, c, s) or s != s:
            continue
        best[q, r, c] = max(best.get((q, r, c), -float("inf")), s)
    lists = {}
    for (q, r, c), s in best.items():
        lists.setdefault((q, r), []).append((-s, c.encode(), c))
    return {(q, r, c, -s) for (q, r), items in lists.items() for s, _, c in sorted(items)[:n]}


def hits():
    rng = random.Random(3)
    rows = [("hot", "dense", f"{rng.randrange(16):x}{i:05x}-same-long-prefix", round(rng.gauss(0, 1), 2)) for i in range(3000)]
    rows += [("tied", "dense", "p" * 40 + str(i), 1.0) for i in range(200)]  # equal scores, long equal prefixes
    rows += [(f"q{rng.randrange(60)}", rng.choice(["dense", "lexical"]), f"c{rng.randrange(30)}", rng.choice([0.5, -0.0, 0.0, -3.0, 1e300, 5e-324, float("inf")])) for _ in range(2000)]
    rows += [("pre", "x", c, 0.0) for c in ("a", "ab", "a\0", "", "é", "z", "a\0b")]
    rows += [("n", None, "c", 1.0), (None, "d", "c", 1.0), ("n", "d", None, 1.0), ("n", "d", "c", None), ("n", "d", "c", float("nan")), ("n", "d", "e", float("-inf"))]
    return rows + rows[:500]


@pytest.mark.parametrize("n", [1, 5])
def test_top_n_against_brute_force(spark, n):
    rows = hits()
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], HITS).repartition(5)
    got = [tuple(r) for r in top_n(df, ["qid", "retriever"], "chunk_id", "score", n).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows, n)


def test_top_n_edges(spark):
    empty = spark.createDataFrame([], HITS)
    assert top_n(empty, ["qid"], "chunk_id", "score", 3).count() == 0
    with pytest.raises(ValueError):
        top_n(empty, ["qid"], "chunk_id", "score", 0)


def test_positions_over_partition_seams(spark):
    rows = [(q, r, c, s) for q, r, c, s in hits() if q in ("hot", "tied", "q1", "q2")]
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        got = borda.positions(spark.createDataFrame([(*r, 1, "x") for r in rows], HITS), "qid", "retriever", "chunk_id", "score").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    best = {}
    for q, r, c, s in rows:
        best[q, r, c] = max(best.get((q, r, c), -float("inf")), s)
    lists = {}
    for (q, r, c), s in best.items():
        lists.setdefault((q, r), []).append((-s, c.encode(), c))
    expected = {}
    for (q, r), items in lists.items():
        scores = [s for s, _, _ in items]
        for place, (s, _, c) in enumerate(sorted(items), 1):
            above = sum(x < s for x in scores)
            expected[q, r, c] = (place, above + (scores.count(s) + 1) / 2) if len(scores) < 500 else (place, None)
    assert len(got) == len(expected)
    for x in got:
        place, rank = expected[x["qid"], x["list"], x["item"]]
        assert x["position"] == place and rank in (None, x["rank"])
    tied = {x["rank"] for x in got if x["qid"] == "tied"}
    assert tied == {100.5}


def test_borda_points_and_heads(spark):
    rows = [("q", "dense", "a", 9.0), ("q", "dense", "b", 8.0), ("q", "dense", "c", 8.0), ("q", "lexical", "a", 0.1), ("q", "lexical", "d", 0.05), ("off", "dense", "a", 1.0), ("off", "lexical", "b", 1.0)]
    placed = borda.positions(spark.createDataFrame([(*r, 1, "x") for r in rows], HITS), "qid", "retriever", "chunk_id", "score")
    weights = spark.createDataFrame([("off", 1.0, 0.0, 0.0)], "qid string, w_dense double, w_lexical double, w_rerank double")
    lists = ["dense", "lexical", "rerank"]
    scored = borda.borda(placed, weights, lists).cache()
    points = {(r["qid"], r["item"]): r["points"] for r in scored.collect()}
    # four items; the lexical list lacks b and c, which share ranks 3 and 4; the dense list lacks d, which has rank 4
    assert points == {("q", "a"): 3 + 3, ("q", "b"): 1.5 + 0.5, ("q", "c"): 1.5 + 0.5, ("q", "d"): 0 + 2, ("off", "a"): 0.0}
    order = [r["item"] for r in borda.fused(scored).where("qid = 'q'").orderBy("position").collect()]
    assert order == ["a", "b", "c", "d"]
    assert [tuple(r) for r in borda.heads(scored, lists).collect()] == [("q", "a")]
    assert borda.borda(placed.where("false"), None, lists).count() == 0
    one = borda.borda(placed, None, lists).where("qid = 'off'").collect()
    assert {r["n_lists"] for r in one} == {2}
