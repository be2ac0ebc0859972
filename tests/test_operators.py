import math
import re
import shutil

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.config import ConfigError, RetrievalConfig
from tarnwick.functions.embedding import HashEmbedder
from tarnwick.operators import ann, answer, bm25, chunking, dense, evaluate, filters, fusion, ranking, rerank, store
from tarnwick.plans import retrieval


def lists(spark, **given):
    rows = [("q", name, c, float(s), i) for name, items in given.items() for i, (c, s) in enumerate(items, 1)]
    return spark.createDataFrame(rows, "qid string, retriever string, chunk_id string, score double, rank int")


def test_rrf_by_hand(spark):
    got = fusion.rrf(lists(spark, dense=[("p", 7), ("q", 5), ("r", 2)], lexical=[("s", 9), ("q", 4), ("r", 1)]), 10).orderBy("fused_rank").collect()
    assert [r["chunk_id"] for r in got] == ["q", "r", "p", "s"]  # p and s are equal, and go by id
    assert [r["score"] for r in got] == pytest.approx([2 / 12, 2 / 13, 1 / 11, 1 / 11], abs=1e-8)
    assert (got[0]["dense_rank"], got[0]["lexical_rank"], got[2]["lexical_rank"]) == (2, 2, None)


def test_rrf_k_turns_the_order(spark):
    given = lists(spark, dense=[("x", 9), ("y", 8), ("z", 7)], lexical=[("u", 9), ("v", 8), ("z", 7)])
    assert fusion.rrf(given, 1).where("fused_rank = 1").first()["chunk_id"] == "u"  # 1/2 each for u and x; 2/4 for z
    assert fusion.rrf(given, 500).where("fused_rank = 1").first()["chunk_id"] == "z"
    with pytest.raises(ConfigError):
        fusion.rrf(given, 0)


def test_weighted_by_hand(spark):
    given = lists(spark, dense=[("p", 8), ("q", 4), ("r", 0)], lexical=[("q", 30), ("s", 20), ("r", 10)])
    got = fusion.fuse(given, 2, "weighted", dense_weight=0.6).collect()
    assert {r["chunk_id"]: r["score"] for r in got} == pytest.approx({"p": 0.6, "q": 0.7, "s": 0.2, "r": 0.0})
    flat = fusion.weighted(lists(spark, dense=[("A", 0.4), ("B", 0.4)])).collect()
    assert [r["score"] for r in flat] == [1.0, 1.0]
    with pytest.raises(ConfigError):
        fusion.weighted(given, [0.5, 0.3, 0.2], 2)


def numbered(spark, *rows):
    return spark.createDataFrame(list(rows), "qid string, retriever string, list_no int, chunk_id string, score double, rank int")


def test_two_lists_are_weighted_by_number_whatever_their_names(spark):
    both = numbered(spark, ("q", "dense", 0, "a", 1.0, 1), ("q", "dense_hyde", 1, "b", 5.0, 1))
    got = {r["chunk_id"]: r for r in fusion.fuse(both, 2, "weighted", dense_weight=0.3).collect()}
    assert (got["a"]["score"], got["b"]["score"]) == (0.3, 0.7)
    three = numbered(spark, ("q", "dense", 0, "a", 1.0, 1), ("q", "dense_1", 1, "b", 5.0, 1))  # the third list found nothing
    assert {r["score"] for r in fusion.fuse(three, 3, "weighted", dense_weight=0.3).collect()} == {round(1 / 3, 9)}


def test_evidence_is_that_of_the_first_list_of_its_stage(spark):
    rows = numbered(spark, ("q", "dense", 0, "a", 0.9, 4), ("q", "dense_1", 1, "a", 0.95, 1), ("q", "dense_1", 1, "b", 0.8, 2), ("q", "lexical_2", 4, "b", 3.0, 7), ("q", "dense_hyde", 2, "c", 0.1, 9))
    got = {r["chunk_id"]: r for r in fusion.rrf(rows).collect()}
    assert (got["a"]["dense_score"], got["a"]["dense_rank"], got["a"]["lexical_rank"]) == (0.9, 4, None)
    assert (got["b"]["dense_score"], got["b"]["dense_rank"], got["b"]["lexical_score"], got["b"]["lexical_rank"]) == (0.8, 2, 3.0, 7)
    assert got["c"]["dense_rank"] == 9


def bm25_top(chunks, asked, k, tmp_path):
    return bm25.top_k(bm25.ensure(chunks, f"file://{tmp_path}/bm25"), asked, k)


def test_bm25_tiny_corpus_has_no_hits(spark, tmp_path):
    chunks = spark.createDataFrame([("a", "bm25 lexical scoring"), ("b", "hnsw graph search")], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "bm25")], "qid string, question string")
    assert bm25_top(chunks, asked, 5, tmp_path).count() == 0
    assert bm25_top(chunks.where("false"), asked, 5, tmp_path).count() == 0


def test_bm25_index_is_found_again_and_broken_ones_are_not(spark, tmp_path):
    where = f"file://{tmp_path}/bm25"
    chunks = spark.createDataFrame([(f"c{i}", f"word{i % 3} common") for i in range(9)], "chunk_id string, text string")
    first = bm25.ensure(chunks, where)
    unread = chunks.withColumn("text", F.raise_error(F.lit("the text was read")).cast("string"))
    again = bm25.ensure(unread, where)
    asked = spark.createDataFrame([("q", "word1")], "qid string, question string")
    assert sorted(map(tuple, bm25.top_k(again, asked, 3).collect())) == sorted(map(tuple, bm25.top_k(first, asked, 3).collect())) != []
    with pytest.raises(Exception, match="the text was read"):
        bm25.ensure(unread.where("chunk_id != 'c0'"), where)
    name, n_terms = bm25.key(chunks), first.weights.count()
    shutil.rmtree(tmp_path / "bm25" / name / "weights")
    assert bm25.load(spark, where, name) is None
    assert bm25.ensure(chunks, where).weights.count() == n_terms


def reference_bm25(texts, query, k1=1.5, b=0.75, eps=0.25):
    docs = {i: (t.split() or [""]) for i, t in texts.items()}
    n, mean = len(docs), sum(map(len, docs.values())) / len(docs)
    df = {}
    for d in docs.values():
        for t in set(d):
            df[t] = df.get(t, 0) + 1
    raw = {t: math.log(n - f + 0.5) - math.log(f + 0.5) for t, f in df.items()}
    floor = eps * sum(raw.values()) / len(raw)
    idf = {t: floor if r < 0 else r for t, r in raw.items()}
    return {i: sum(idf.get(t, 0) * d.count(t) * (k1 + 1) / (d.count(t) + k1 * (1 - b + b * len(d) / mean)) for t in query.split()) for i, d in docs.items()}


def test_bm25_against_brute_force(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(ranking, "BLOCK", 1)
    monkeypatch.setattr(bm25, "ENTRIES", 1)
    texts = {f"c{i}": " ".join(w for j, w in enumerate("alpha beta gamma delta common".split()) if (i * 7 + j * 3) % 4 or w == "common") * (1 + i % 2) for i in range(12)}
    texts["c12"], texts["c13"] = "", "common"
    chunks = spark.createDataFrame(list(texts.items()), "chunk_id string, text string")
    asked = spark.createDataFrame([("q1", "alpha common common"), ("q2", "delta nothing"), ("q3", "")], "qid string, question string")
    got = bm25_top(chunks, asked, 4, tmp_path).collect()
    plain = {i: " ".join(re.findall("[a-z0-9]+", t)) for i, t in texts.items()}
    for qid, q in (("q1", "alpha common common"), ("q2", "delta nothing")):
        scores = {i: round(x, 9) for i, x in reference_bm25(plain, q).items() if x > 1e-9}
        expected = sorted(((x, i) for i, x in scores.items()), key=lambda x: (-x[0], x[1]))[:4]
        mine = [(r["score"], r["chunk_id"]) for r in sorted((r for r in got if r["qid"] == qid), key=lambda r: r["rank"])]
        assert [c for _, c in mine] == [c for _, c in expected]
        assert [x for x, _ in mine] == pytest.approx([x for x, _ in expected], abs=1e-8)
    assert not [r for r in got if r["qid"] == "q3"]


def test_dense_ties_zero_and_width(spark):
    rows = spark.createDataFrame([("b", [1.0, 0.0]), ("a", [2.0, 0.0]), ("z", [0.0, 0.0]), ("w", [1.0]), ("n", None)], "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([("q", [1.0, 0.0]), ("zero", [0.0, 0.0])], "qid string, embedding array<double>")
    got = dense.top_k(rows, asked, 3, 2).orderBy("rank").collect()
    assert [(r["qid"], r["chunk_id"], r["score"]) for r in got] == [("q", "a", 1.0), ("q", "b", 1.0), ("q", "z", 0.0)]
    with pytest.raises(Exception, match="width is not 2"):
        dense.check_width(rows.where("chunk_id = 'w'"), "embedding", 2).collect()
    assert dense.top_k(rows.where("false"), asked, 3, 2).count() == 0
    assert dense.top_k(rows, asked.where("false"), 3, 2).count() == 0


def test_best_rows_of_a_stream_against_brute_force():
    rng = np.random.default_rng(2)
    names = np.array([f"n{i:04d}" for i in rng.permutation(3000)], object)
    scores = rng.integers(-3, 4, size=(3000, 7)) / 4.0  # many ties
    for floor in (None, 0.0):
        best = ranking.Best(7, 5, floor)
        for s in range(0, 3000, 97):
            best.add(names[s : s + 97], scores[s : s + 97])
        query, name, value = best.rows()
        for q in range(7):
            expected = sorted((-x, n) for x, n in zip(scores[:, q], names) if floor is None or x > floor)[:5]
            assert sorted(zip((-value[query == q]).tolist(), name[query == q].tolist())) == expected
        assert len(best.query) == 35


def test_approximate_search_probes_lists(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 8)) + 3 * rng.normal(size=(12, 8))[rng.integers(12, size=900)]
    rows = [(f"c{i:03d}", v.tolist()) for i, v in enumerate(x)]
    bad = [("z", [0.0] * 8), ("n", None), ("s", [1.0]), ("nan", [float("nan")] * 8)]
    df = spark.createDataFrame(rows + rows[:20] + bad, "chunk_id string, embedding array<double>")
    asked = spark.createDataFrame([(f"q{i}", v) for i, (_, v) in enumerate(rows[:40])] + [("zero", [0.0] * 8)], "qid string, embedding array<double>")
    index = ann.build(df, 8, lists=12)
    assert index.rows.count() == 900 and len(index.centres) == 12
    whole = ann.search(index, asked, 5, 12).collect()  # all lists: exact
    true = dense.top_k(df.where("chunk_id NOT IN ('z', 'nan')").dropDuplicates(["chunk_id"]), asked, 5, 8).collect()
    assert sorted((r["qid"], r["chunk_id"], r["rank"]) for r in whole) == sorted((r["qid"], r["chunk_id"], r["rank"]) for r in true)
    assert ann.recall(index, asked, 5, 12) == 1.0 and 0.9 <= ann.recall(index, asked, 5, 4) <= 1.0 and ann.recall(index, asked, 5, 1) < 1.0
    assert ann.search(ann.build(df.where("false"), 8), asked, 5, 3).count() == 0 and ann.search(index, asked.where("false"), 5, 3).count() == 0


def test_rerank_cache_and_movement(spark):
    short = spark.createDataFrame([("q", "x", 1, "red fox", "a b c"), ("q", "y", 2, "red fox", "fox red")], "qid string, chunk_id string, fused_rank int, question string, text string")
    got = {r["chunk_id"]: r for r in rerank.rerank(short, 5).collect()}
    assert (got["y"]["rerank_score"], got["y"]["final_rank"], got["y"]["rank_movement"]) == (0.2, 1, 1)
    key = short.select(rerank.cache_key(F.col("question")).alias("k")).first()["k"]
    cache = spark.createDataFrame([(key, "x", 0.9)], "query_key string, chunk_id string, rerank_score double")
    assert rerank.rerank(short, 1, cache=cache).first()["chunk_id"] == "x"
    stamped = spark.createDataFrame([(key, "x", 0.9, 1), (key, "y", 0.1, 2), (key, "x", 0.9, 3)], "query_key string, chunk_id string, rerank_score double, used_at int")
    kept = rerank.update_cache(stamped.where("used_at < 3"), stamped.where("used_at = 3"), 1).collect()
    assert [(r["chunk_id"], r["used_at"]) for r in kept] == [("x", 3)]


def test_filters(spark):
    chunks = spark.createDataFrame([("a", 1, {"k": "v"}), ("b", 1, {}), ("c", 2, {"k": "w"})], "chunk_id string, doc_id int, metadata map<string,string>")
    docs = spark.createDataFrame([(1, {"k": "v"}), (2, {"k": "v"})], "doc_id int, metadata map<string,string>")
    assert {r["chunk_id"] for r in filters.filter_chunks(chunks, docs, {"k": "v"}).collect()} == {"a", "b"}
    assert filters.page(chunks, "chunk_id", 2, 9).count() == 0
    assert [(r["chunk_id"], r["total"]) for r in filters.page(chunks, "chunk_id", 2, 1).collect()] == [("b", 3), ("c", 3)]
    many = spark.createDataFrame([("j", 1, {"a": '["x", "y"]'}), ("t", 1, {"a": "x; yy"}), ("s", 2, {"a": "x"}), ("n", 2, {"a": None}), ("b", 2, {"a": "[not json"}), ("m", 3, None)], chunks.schema)
    found = lambda **k: {r["chunk_id"] for r in filters.filter_chunks(many, None, {"a": "x"}, **k).collect()}
    assert found() == {"j", "s"} and found(lists={"a": "; "}) == {"t", "s"}


def results(spark, *rows):
    return spark.createDataFrame(list(rows), "qid string, chunk_id string, score double, rerank_score double")


def test_refusal_order(spark):
    asked = spark.createDataFrame([(q,) for q in "abcd"], "qid string")
    got = {r["qid"]: r for r in answer.refusal(results(spark, ("a", "x", 0.1, None), ("b", "x", 9.0, 0.29), ("c", "x", 1.0, 0.31)), asked).collect()}
    assert (got["a"]["refused"], got["a"]["threshold_applied"], got["a"]["confidence"]) == (False, False, 0.1)
    assert got["b"]["refused"] and got["b"]["reason"] == "top confidence 0.290 below 0.30"
    assert not got["c"]["refused"] and got["c"]["usable_sources"] == 1
    assert got["d"]["refused"] and got["d"]["confidence"] == 0.0


def test_answers_and_grounding(spark):
    sources = spark.createDataFrame([("q", 1, "c1", "Foxes are red animals in the forest. Short one."), ("q", 2, "c2", "Whales swim through very deep oceans.")], "qid string, source_no int, chunk_id string, text string")
    asked = spark.createDataFrame([("q", "red foxes forest"), ("none", "x")], "qid string, question string")
    got = {r["qid"]: r["answer"] for r in answer.extractive(sources, asked, take=1).collect()}
    assert got == {"q": "Foxes are red animals in the forest. [1]", "none": answer.DECLINED}
    said = spark.createDataFrame([("q", "Foxes are red animals in the forest. [1]"), ("bad", "Claims. [7]"), ("no", answer.DECLINED), ("empty", "")], "qid string, answer string")
    g = {r["qid"]: r for r in answer.grounding(said, sources).collect()}
    assert g["q"]["grounded"] and g["no"]["grounded"] and not g["bad"]["grounded"] and not g["empty"]["grounded"]
    assert g["bad"]["n_unresolved"] == 1 and g["no"]["n_sentences"] == 0
    both = answer.generate_or_extract(spark.createDataFrame([("q", "  ")], "qid string, answer string"), said).where("qid = 'q'").first()
    assert both["answer_type"] == "extractive"


def flags_of(spark, pattern, total):
    rows = [("q", f"c{i}", i, x == "T") for i, x in enumerate(pattern, 1)]
    return spark.createDataFrame(rows, "qid string, chunk_id string, rank int, relevant boolean"), spark.createDataFrame([("q", total)], "qid string, total long")


@pytest.mark.parametrize(
    ("pattern", "total", "k", "expected"),
    [("TFTFF", 4, 3, {"recall": 0.5, "precision": 2 / 3, "rr": 1.0}), ("TFTFF", 2, 4, {"precision": 0.5}), ("TT", 1, 5, {"precision": 0.4, "recall": 1.0}), ("FFT", 1, 3, {"rr": 1 / 3}),
     ("FTT", 2, 3, {"ndcg": 0.693426}), ("T", 3, 3, {"ndcg": 1 / (1 + 1 / math.log2(3) + 0.5)}), ("FF", 0, 3, {"recall": 0.0, "ndcg": 0.0, "hit": 0.0, "rr": 0.0})],
)
def test_metrics_by_hand(spark, pattern, total, k, expected):
    r = evaluate.retrieval_metrics(*flags_of(spark, pattern, total), k).first().asDict()
    assert {m: r[m] for m in expected} == pytest.approx(expected, abs=1e-6)


def test_graded_ndcg(spark):
    gains = F.array(F.lit(3.0), F.lit(1.0), F.lit(2.0))
    assert spark.range(1).select(evaluate.ndcg(gains, F.lit(0), 3).alias("n")).first()["n"] == pytest.approx(0.9725045, abs=1e-6)


def test_percentiles_and_gate(spark):
    df = spark.createDataFrame([("k", float(v)) for v in [5, 1, 1, 3, 2]] + [("k", None)], "k string, v double")
    r = evaluate.latency(df, "v", "k").first()
    assert (r["p50"], r["p95"], r["max"], r["mean"], r["n"]) == (2.0, 5.0, 5.0, 2.4, 5)
    floors = evaluate.floors({"recall": 0.75, "rr": 0.01})
    assert floors == {"recall": 0.7, "rr": 0.0}
    assert evaluate.gate({"recall": 0.6}, floors) == {"recall": (0.6, 0.7)}


def test_golden_checks(spark):
    schema = "qid string, question string, relevant_doc_ids array<long>, relevant_chunk_texts array<string>, answer string, category string, difficulty string"
    rows = [("a", "?", [1], ["needle"], "", "factual", "easy"), ("b", "?", [2], ["needle"], "", "factual", None), ("c", "?", [9], ["lost"], "", "factual", None),
            ("d", "?", [], ["x"], "", "negative", None), ("e", "?", [1], [], "", "ambiguous", None), ("e", "?", [1], [], "", "ambiguous", None)]
    docs = spark.createDataFrame([(1, "a needle here"), (2, "other"), (3, None)], "doc_id long, text string")
    got = {(r["qid"], r["problem"], r["severity"]) for r in evaluate.validate_golden(spark.createDataFrame(rows, schema), docs).collect()}
    assert got == {("b", "span in another document", "warning"), ("c", "unknown document", "failure"), ("c", "span not found", "failure"), ("d", "negative with evidence", "failure"),
                   ("e", "answerable without span", "failure"), ("e", "repeated qid", "failure"), ("*", "too few negatives", "failure")}


def docs_of(spark, **texts):
    return spark.createDataFrame(list(texts.items()), "doc_id string, text string")


def test_fixed_windows(spark):
    assert chunking.window_starts(10, 4, 2).tolist() == [0, 2, 4, 6] and chunking.window_starts(8, 4, 2).tolist() == [0, 2, 4]
    assert chunking.window_starts(0, 4, 2).tolist() == [] and chunking.window_starts(3, 4, 2).tolist() == [0]
    got = chunking.fixed_token(docs_of(spark, d="a bb  ccc\nd e", n=None, e="  "), 3, 1).orderBy("start_char").collect()
    assert [(r["text"], r["start_char"], r["end_char"], r["token_count"]) for r in got] == [("a bb  ccc", 0, 9, 3), ("ccc\nd e", 6, 13, 3)]


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (-1, 0), (4, 4), (4, 9), (4, -1)])
def test_sizes_that_cannot_work_are_refused(spark, size, overlap):
    df = docs_of(spark, d="a b c d e f")
    with pytest.raises(ConfigError):
        chunking.fixed_token(df, size, overlap)
    with pytest.raises(Exception, match="chunk (size|overlap)"):  # from a table, where the rows are met
        chunking.fixed_token(df, F.lit(size), F.lit(overlap)).collect()
    with pytest.raises(ConfigError):
        chunking.chunker("fixed_token", size, overlap)


def test_chunker_by_name(spark):
    for name, embedder in (("semantic", None), ("other", HashEmbedder())):
        with pytest.raises(ConfigError):
            chunking.chunker(name, embedder=embedder)
    df = docs_of(spark, d="One two. Three four.")
    for name in ("semantic", "fixed_token", "recursive_structural"):
        assert [r["text"] for r in chunking.chunker(name, 50, 0, HashEmbedder())(df).collect()] == ["One two. Three four."]


@given(st.text(alphabet=st.sampled_from("ab .!?\n\t# \r\u00a0\u2028é😀"), max_size=300), st.integers(1, 20))
@settings(max_examples=200, deadline=None)
def test_chunks_cover_the_text(text, size):
    words = text.split()
    for tokenizer in (None, chunking.ApproximateTokenizer()):
        one = chunking.layout(text, tokenizer)
        for pieces in (chunking.fixed(one, size, 0), chunking.structural(one, size)):
            rows = list(chunking.capped(one, pieces, size))
            assert all(n <= size and text[s:e] == text[s:e].strip() != "" for s, e, n, _ in rows)
            assert len({s for s, *_ in rows}) == len(rows) and rows == sorted(rows)
            if tokenizer is None:
                assert [w for s, e, *_ in rows for w in text[s:e].split()] == words
            else:
                assert "".join("".join(text[s:e].split()) for s, e, *_ in rows) == "".join(words)


def test_tokenizer_plug_ins(spark):
    got = chunking.fixed_token(docs_of(spark, d="don't stop, ever"), 3, 0, chunking.ApproximateTokenizer()).orderBy("start_char").collect()
    assert [(r["text"], r["token_count"]) for r in got] == [("don't", 3), ("stop, ever", 3)]
    assert chunking.ApproximateTokenizer().spans("a_1 é,²b") == [(0, 3), (4, 5), (5, 6), (6, 8)]


def test_headings_end_sections(spark):
    text = "### Deep\n\nx\n\n####### no heading\n# A #\nb\n\n#no\n"
    got = chunking.recursive_structural(docs_of(spark, d=text), 50).orderBy("start_char").collect()
    assert [(r["section_path"], r["text"]) for r in got] == [(["Deep"], "### Deep\n\nx\n\n####### no heading"), (["A #"], "# A #\nb\n\n#no")]


def test_structural_sections(spark):
    text = "# A\n\nintro\n\n## B\n\none two\n\n# C\n\nlast 😀 one\n"
    got = chunking.recursive_structural(docs_of(spark, d=text), 50).orderBy("start_char").collect()
    assert [(r["section_path"], r["text"]) for r in got] == [(["A"], "# A\n\nintro"), (["A", "B"], "## B\n\none two"), (["C"], "# C\n\nlast 😀 one")]
    assert all(text[r["start_char"] : r["end_char"]] == r["text"] for r in got)
    capped = chunking.recursive_structural(docs_of(spark, d="One two three. Four five six. " * 4), 5).collect()
    assert all(r["token_count"] <= 5 for r in capped) and sum(r["token_count"] for r in capped) == 24


def test_page_numbers(spark):
    df = spark.createDataFrame([("d", "ab cd ef", [(1, 0, 4, "P"), (2, 4, 99, None), (3, None, 2, None)])], "doc_id string, text string, page_spans array<struct<page_number:int,start_char:int,end_char:int,label:string>>")
    got = chunking.fixed_token(df, 1, 0).orderBy("start_char").collect()
    assert [(r["page_number"], r["section_path"]) for r in got] == [(1, ["P"]), (1, ["P"]), (2, [])]


def test_semantic(spark):
    text = "Red fox runs. Red fox runs. Red fox runs. Blue whale swims. Blue whale swims."
    got = chunking.semantic(docs_of(spark, d=text, one="Only one.", none=""), 50, 75.0).where("doc_id = 'd'").orderBy("start_char").collect()
    assert [r["text"] for r in got] == ["Red fox runs. Red fox runs. Red fox runs.", "Blue whale swims. Blue whale swims."]


def test_store(spark, tmp_path):
    c = store.Collection(spark, f"file://{tmp_path}/c", "m", 2)
    with pytest.raises(store.StoreError):
        c.read("documents")
    c.ensure()
    with pytest.raises(store.StoreError):
        store.Collection(spark, f"file://{tmp_path}/c", "other", 2).ensure()
    docs = spark.createDataFrame([("a", "h1"), ("b", "h2")], "doc_id string, content_hash string")
    chunks = spark.createDataFrame([("a0", "a", [1.0, 0.0]), ("b0", "b", [1.0, 0.0])], "chunk_id string, doc_id string, embedding array<double>")
    c.upsert(docs, chunks)
    new = spark.createDataFrame([("b", "h3"), ("c", "h4")], "doc_id string, content_hash string")
    assert {r["doc_id"]: r["status"] for r in store.changes(docs.unionByName(new.where("doc_id = 'c'")), c.documents.read()).collect()} == {"a": "unchanged", "b": "unchanged", "c": "new"}
    assert store.changes(new, c.documents.read()).where("doc_id = 'b'").first()["status"] == "changed"
    c.upsert(new, spark.createDataFrame([("c0", "c", [0.0, 1.0])], "chunk_id string, doc_id string, embedding array<double>"))
    assert {r["chunk_id"] for r in c.chunks.read().collect()} == {"a0", "c0"}  # b lost its chunks
    assert c.info().first()["chunk_count"] == 2
    assert c.delete(spark.createDataFrame([("b",), ("x",)], "doc_id string")) == (1, 0)
    assert {r["doc_id"] for r in c.documents.read().collect()} == {"a", "c"}
    with pytest.raises(Exception, match="width"):
        c.upsert(new, spark.createDataFrame([("c0", "c", [0.0])], "chunk_id string, doc_id string, embedding array<double>"))
    assert {r["chunk_id"] for r in c.chunks.read().collect()} == {"a0", "c0"}


def test_a_write_that_stops_half_way_loses_nothing(spark, tmp_path, monkeypatch):
    c = store.Collection(spark, f"file://{tmp_path}/c", "m", 1)
    c.ensure()
    rows = lambda *ids: (spark.createDataFrame([(i, "h") for i in ids], "doc_id string, content_hash string"), spark.createDataFrame([(i + "0", i, [1.0]) for i in ids], "chunk_id string, doc_id string, embedding array<double>"))
    c.upsert(*rows(*[f"d{i}" for i in range(60)]))
    before = c.documents.version()

    def stop(state):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(c, "_commit", stop)
        with pytest.raises(KeyboardInterrupt):
            c.upsert(*rows("d1", "new"))
    assert c.documents.version() == before and c.documents.read().count() == c.chunks.read().count() == 60
    state = c.current()
    c.upsert(*rows("d1", "new"))
    assert c.documents.read().count() == c.chunks.read().count() == 61
    same = {b for b, f in c.current()["parts"]["chunks"].items() if state["parts"]["chunks"].get(b) == f}
    assert len(same) >= 20  # parts without a changed document were not written again
    with pytest.raises(store.StoreError):
        c._commit(state | {"number": c.documents.version()})  # a second writer


def test_answers_of_a_model_or_extraction(spark):
    class Echo:
        """A model that answers from its prompt, says nothing to some, and fails on others."""

        name = "echo"

        def complete(self, prompts):
            if any("fail" in p for p in prompts):
                raise OSError("unavailable")
            return ["" if "silent" in p else "Foxes are red. [1] [1] [5]" for p in prompts]

    given = [("q", "x", 0.9, 0.9, 1, "Foxes are red animals in the forest."), ("silent", "x", 0.9, 0.9, 1, "Foxes are red animals in the forest."), ("fail", "x", 0.9, 0.9, 1, "Foxes are red animals in the forest."), ("weak", "x", 0.1, 0.1, 1, "Nothing much to say about it here.")]
    found = spark.createDataFrame(given, "qid string, chunk_id string, score double, rerank_score double, final_rank int, text string")
    asked = spark.createDataFrame([("q", "red foxes"), ("silent", "silent foxes"), ("fail", "fail foxes"), ("weak", "?"), ("none", "?")], "qid string, question string").repartition(5, "qid")
    got = {r["qid"]: r for r in retrieval.respond(found, asked, generator=Echo()).collect()}
    assert {q: r["answer_type"] for q, r in got.items()} == {"q": "generated", "silent": "extractive", "fail": "extractive", "weak": "refused", "none": "refused"}
    assert [(c["marker"], c["chunk_id"], c["resolved"]) for c in got["q"]["citations"]] == [(1, "x", True), (5, None, False)] and not got["q"]["grounded"]
    assert got["weak"]["answer"].startswith(answer.REFUSED) and got["weak"]["grounded"] and got["weak"]["citations"] == [] and len(got["weak"]["sources"]) == 1 and got["none"]["sources"] == []


def test_whole_prompts(spark):
    sources = spark.createDataFrame([("q", 2, "B", " two "), ("q", 1, "A > a", "one")], "qid string, source_no int, label string, text string")
    got = {r["qid"]: r["prompt"] for r in answer.prompt(sources, spark.createDataFrame([("q", " why? "), ("n", "x")], "qid string, question string")).collect()}
    assert got["q"] == f"{answer.RULES}\n\nSources:\n[1] (A > a) one\n\n[2] (B) two\n\nQuestion: why?\n\nAnswer:" and "(no sources retrieved)" in got["n"]


def test_run_metrics_and_latency_of_stages(spark):
    rows = [("a", "factual", 1.0, False, True, 0.5, 0.8), ("b", "factual", 0.0, True, True, 0.0, None), ("c", "negative", 0.0, True, True, 0.0, None), ("d", None, 0.5, False, False, 1.0, 0.4)]
    df = spark.createDataFrame(rows, "qid string, category string, recall double, refused boolean, grounded boolean, citation_precision double, answer_similarity double")
    r = evaluate.run_metrics(df.withColumns({m: F.col("recall") for m in ("precision", "hit", "rr", "ndcg")})).first()
    assert (r["n"], r["recall"], r["citation_precision"], r["answer_similarity"]) == (4, 0.5, 0.5, 0.6)
    assert (r["refusal_accuracy"], r["grounded_rate"], r["false_refusal_rate"]) == (1.0, round(2 / 3, 9), round(1 / 3, 9))
    said = evaluate.answer_similarity(spark.createDataFrame([("a", "red fox"), ("b", " ")], "qid string, answer string"), spark.createDataFrame([("a", "red fox"), ("b", "x")], "qid string, answer string")).collect()
    assert [tuple(x) for x in said] == [("a", 1.0)]
    times = {x["stage"]: x for x in evaluate.stage_latency(spark.createDataFrame([(1.0, 5.0), (3.0, None)], "dense_ms double, total_ms double")).collect()}
    assert set(times) == set(evaluate.STAGES) and (times["dense"]["max"], times["total"]["n"], times["rerank"]["p95"]) == (3.0, 1, 0.0)


def test_one_whole_row_per_key(spark):
    df = spark.createDataFrame([("k", 1, "z", "old"), ("k", 2, "a", None), ("k", 2, "a", "b"), (None, 1, "x", "y")], "key string, at int, x string, y string")
    assert sorted(map(str, evaluate.one_row(df, "key", "at").collect())) == ["Row(key='k', at=2, x='a', y='b')", "Row(key=None, at=1, x='x', y='y')"]


def test_retrieve_end_to_end(spark):
    chunks = spark.createDataFrame([(f"c{i}", t) for i, t in enumerate(["bm25 ranks lexical matches well", "hnsw graphs search vectors fast", "rerankers read pairs of texts", "ndcg discounts gains by rank"])], "chunk_id string, text string")
    asked = spark.createDataFrame([("q", "how do hnsw graphs search"), ("m", "ndcg gains rank")], "qid string, question string")
    for config in (RetrievalConfig(), RetrievalConfig(use_rerank=False), RetrievalConfig(use_lexical=False, use_rerank=False), RetrievalConfig(fusion="weighted", use_rerank=False)):
        best = {r["qid"]: r["chunk_id"] for r in retrieval.retrieve(chunks, asked, config).where("final_rank = 1").collect()}
        assert best == {"q": "c1", "m": "c3"}
    passages = spark.createDataFrame([("q", "rerankers read pairs of texts")], "qid string, passage string")
    hyde = retrieval.retrieve(chunks, asked, RetrievalConfig(expansion="hyde", use_rerank=False), passages=passages)
    assert "c2" in {r["chunk_id"] for r in hyde.where("qid = 'q' AND dense_rank <= 2").collect()} or hyde.count() == 8
    plain = retrieval.retrieve(chunks, asked, RetrievalConfig(use_rerank=False))
    for unexpanded in ("hyde", "multi_query"):  # nothing was made by a model: searched as they are
        assert sorted(map(str, retrieval.retrieve(chunks, asked, RetrievalConfig(expansion=unexpanded, use_rerank=False)).collect())) == sorted(map(str, plain.collect()))
    tagged = chunks.withColumn("metadata", F.create_map(F.lit("kind"), F.when(F.col("chunk_id") == "c3", "b").otherwise("a")))
    few = retrieval.retrieve(tagged, asked, RetrievalConfig(use_rerank=False), filters={"kind": "b"}).collect()
    assert {r["chunk_id"] for r in few} == {"c3"} and {r["lexical_rank"] for r in few} == {1, None}
    said = retrieval.respond(retrieval.retrieve(chunks, asked), asked).collect()
    assert {r["qid"]: r["refused"] for r in said} == {"q": False, "m": False}
    labels = {r["config"] for r in retrieval.ablate(chunks, asked, [RetrievalConfig(), RetrievalConfig(expansion="hyde"), RetrievalConfig(use_dense=False)]).collect()}
    assert labels == {"hybrid + rerank", "lexical only + rerank"}
