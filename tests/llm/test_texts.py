import base64
import random
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tarnwick.llm import bpe, markup, markup_labels, mincut, mixing, queries, repetition, splitting

SF = "/root/testdata/sf0.001"

tiktoken = pytest.importorskip("tiktoken")
public = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def reference():
    with open(public.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("reference", pat_str=public.PATTERN, mergeable_ranks=ranks, special_tokens={})


@given(st.text(alphabet=st.one_of(st.characters(exclude_categories=["Cs"]), st.sampled_from("abcde  \n'=-0123")), max_size=300))
@settings(max_examples=150, deadline=None)
def test_ids_equal_the_public_library(reference, text):
    assert bpe.load().encode(text).tolist() == reference.encode_ordinary(text)


@pytest.mark.parametrize("text", ["a" * 20_000, "<|endoftext|>", "=" * 4_000, "中文字" * 3_000, " \n\t" * 2_000, "averylongwordwithoutanyspace" * 500])
def test_ids_of_long_runs(reference, text):
    assert bpe.load().encode(text).tolist() == reference.encode_ordinary(text)


DOC = "doc_id long, text string, __text string, __id int, id int"


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "x", 1, 2) for i, t in enumerate(texts)], DOC)


def test_encode_edges(spark):
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(docs(spark, None, "", " ", "hi"), "text", "doc_id").collect()}
    assert got[0] == [] and got[1] == [] and got[2] == [220] and got[3] == [5303]
    assert bpe.encode(docs(spark, "x").where("false"), "text", "doc_id").count() == 0
    assert [r["n_tokens"] for r in bpe.count_tokens(docs(spark, "hi hi"), "text", "doc_id").collect()] == [2]


def repeated_brute(text, w=8):
    words = repetition.WORD.findall((text or "").lower())
    seen, hit = set(), [False] * len(words)
    for i in range(len(words) - w + 1):
        key = tuple(words[i : i + w])
        if key in seen:
            hit[i : i + w] = [True] * w
        seen.add(key)
    return len(words), sum(hit)


def test_repetition_against_brute_force(monkeypatch):
    rng = random.Random(1)
    texts = [None, "", " \n", "a b c", "x " * 1000, "Ünï_cödé 中文 １２ " * 20] + [" ".join(rng.choice("ab") for _ in range(rng.randrange(120))) for _ in range(200)]
    for chunk in (1 << 20, 64):
        monkeypatch.setattr(repetition, "CHUNK", chunk)
        n, _, r = repetition.measure(texts)
        assert list(zip(n.tolist(), r.tolist())) == [repeated_brute(t) for t in texts]


def test_repetition_colliding_codes(monkeypatch):
    monkeypatch.setattr(repetition, "_MIX", repetition.np.uint64(0))  # every stretch gets the same code
    text = "a b c d e f g h i j k a b c d e f g h"
    n, _, r = repetition.measure([text, text[::-1]])
    assert [tuple(x) for x in zip(n.tolist(), r.tolist())] == [repeated_brute(text), repeated_brute(text[::-1])]


def test_the_estimate_is_never_below_the_share():
    rng = random.Random(5)
    texts = [" ".join(rng.choice(["a", "b", "c d e f g h i j", "same words come again and again in here"]) for _ in range(rng.randrange(60))) for _ in range(300)]
    n, d, r = repetition.measure(texts)
    assert ((n - d) >= r).all() and (r > 0).any() and (n - d > r).any()
    _, _, some = repetition.measure(texts, wanted=lambda n, d: n % 2 == 0)
    assert [x if m % 2 == 0 else -1 for x, m in zip(r.tolist(), n.tolist())] == some.tolist()


def test_controlled_cutoffs(spark):
    rows = [("s", 0.07 if i < 5 else 0.9, True) for i in range(2000)] + [("s", 0.0, False)] * 50 + [("tiny", 0.9, True)] * 3 + [("noisy", 0.26 if i % 3 == 0 else 0.9, True) for i in range(2000)] + [("none", 0.5, None)]
    df = spark.createDataFrame(rows, "stratum string, estimate double, bad boolean")
    got = {c["stratum"]: c for c in repetition.controlled_cutoffs(df, "estimate", "bad", "stratum")}
    assert got["s"]["cutoff"] == 0.30 and got["s"]["certified"] and got["s"]["lost"] == 5 and 0 < got["s"]["bound"] <= 0.05
    assert got["noisy"]["cutoff"] == 0.25 and got["noisy"]["certified"] and got["noisy"]["lost"] == 0
    assert (got["tiny"]["cutoff"], got["tiny"]["certified"]) == (got["none"]["cutoff"], got["none"]["certified"]) == (0.0, False)
    assert repetition.controlled_cutoffs(df.where("false"), "estimate", "bad", "stratum") == []
    assert repetition.upper_bound(0, 100, 0.05) == pytest.approx(1 - 0.05 ** (1 / 100), abs=1e-9)
    assert repetition.upper_bound(3, 3, 0.05) == 1.0
    cutoffs = [{"stratum": "medium", "cutoff": 0.3}]
    done = {r["doc_id"]: r for r in repetition.repetition(docs(spark, "x y z " * 30, " ".join(map(str, range(80))), None), "doc_id", "text", cutoffs=cutoffs).collect()}
    assert done[0]["share"] > 0.8 and done[1]["share"] is None and done[1]["estimate"] == 0.0
    assert (done[2]["n_words"], done[2]["share"], done[2]["stratum"]) == (0, 0.0, "short")  # a stratum without a cutoff is measured


def test_cutoffs_decide_what_is_found(spark, monkeypatch):
    every = {r["doc_id"] for r in queries.p8_found(spark, SF).collect()}
    assert every == {r["doc_id"] for r in queries.p8_shares(spark, SF).where("share >= 0.30").collect()} != set()
    monkeypatch.setattr(repetition, "controlled_cutoffs", lambda *_: [{"stratum": b, "cutoff": 1.1} for b, _ in repetition.BANDS])
    assert queries.p8_found(spark, SF).count() == 0


def test_cutoffs_are_of_all_documents(spark, monkeypatch):
    monkeypatch.setattr(queries, "P8_HOLDOUT", 5, raising=False)  # a bound on labelled documents, if there is one
    cases = queries.p8_shares(spark, SF).where("share >= 0.30").count()
    assert sum(r["n_cases"] for r in queries.p8_cutoffs(spark, SF).collect()) == cases > 0


def test_fill():
    rng = random.Random(2)
    for _ in range(200):
        lengths = sorted(rng.sample(range(1, 90), rng.randrange(1, 7)))
        counts = [rng.randrange(0, 9) for _ in lengths]
        total = sum(a * b for a, b in zip(lengths, counts))
        budget = rng.randrange(0, total + 20)
        take = mixing.fill(lengths, counts, budget)
        reached = sum(a * b for a, b in zip(lengths, take))
        assert all(0 <= t <= c for t, c in zip(take, counts)) and reached <= max(budget, 0)
        assert budget - reached < max(lengths) or reached == total
    assert mixing.fill([3, 5], [10, 10], 40) in ([5, 5], [10, 2], [0, 8]) and mixing.fill([], [], 5) == [] and mixing.fill([0], [4], 5) == [0]


def test_mix(spark):
    sizes = spark.createDataFrame([(i, s, n, 7) for i, (s, n) in enumerate([(" A ", 10)] * 20 + [("a", 3)] * 10 + [("b", 5)] * 4 + [(None, 50)] * 2 + [("a", 0)])], "doc_id long, source string, n_tokens long, __key int")
    targets = spark.createDataFrame([("m", "a", 0.5, 1, 0.8), ("m", "B", 0.4, 4, 0.8), ("m", "gone", 0.1, 3, 0.8)], "mix_id string, source string, target_share double, max_repeats int, budget_ratio double")
    total = 20 * 10 + 30 + 20 + 100
    plan = mixing.fit(sizes, targets).cache()
    rep = {r["source"]: r for r in mixing.report(plan).collect()}
    assert {s for s, r in rep.items() if r["short"]} == {"B", "gone"}
    assert rep["a"]["target_tokens"] == pytest.approx(0.5 * 0.8 * total) and rep["a"]["reached_tokens"] == 140
    assert rep["B"]["reached_tokens"] == 80 and rep["gone"]["reached_tokens"] == 0
    used = mixing.select(sizes, plan).collect()
    exact = mixing.report(mixing.fit(sizes, spark.createDataFrame([("m", "b", 20 / total, 1, 1.0), ("n", "b", 20.5 / total, 1, 1.0), ("o", "b", 19.5 / total, 1, 1.0)], targets.schema))).collect()
    assert {r["mix_id"]: (r["short"], r["reached_tokens"]) for r in exact} == {"m": (False, 20), "n": (True, 20), "o": (False, 15)}
    reached = {}
    for r in used:
        reached[r["source"]] = reached.get(r["source"], 0) + r["n_tokens"] * r["repeats"]
    assert reached == {"a": 140, "B": 80} and all(r["repeats"] == 4 for r in used if r["source"] == "B")
    assert len({r["doc_id"] for r in used}) == len(used)
    assert sorted(used) == sorted(mixing.select(sizes, plan).collect())
    none = mixing.report(mixing.fit(sizes.where("false"), targets)).collect()  # the total is 0, and so is every target
    assert len(none) == 3 and not any(r["short"] or r["reached_tokens"] for r in none)
    assert mixing.report(mixing.fit(sizes, targets.where("false"))).count() == 0


TOKEN = re.compile(r"[^ \t\n\f\r]+")


def check_pieces(texts, rows, size, overlap):
    by = {}
    for r in rows:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in enumerate(texts):
        tokens, at = TOKEN.findall(t or ""), 0
        own = sorted(by.get(i, []), key=lambda r: r["piece_no"])
        for n, r in enumerate(own):
            words = TOKEN.findall(r["text"])
            assert t[r["start_char"] : r["end_char"]] == r["text"] and len(words) == r["n_tokens"] <= size
            assert words == tokens[at : at + len(words)]
            at += len(words) - (overlap if n + 1 < len(own) else 0)
        assert at == len(tokens)


def test_pieces_do_not_depend_on_ranges(spark):
    rng = random.Random(4)
    alphabet = ["word", "é😀", "end.", "\n\n", "\n", " ", "  ", "# Head\n\n", "x" * 90, "句。", "\r\n\r\n", "Title line\n\n", "\f"]
    texts = [None, "", " \n ", "one"] + ["".join(rng.choice(alphabet) + rng.choice(["", " "]) for _ in range(n)) for n in (30, 400, 2500)]
    df = spark.createDataFrame([(i, t, [(1, 0, 5, None), (2, 40, 3, "x"), None, (3, None, 9, None), (4, 10**6, 9, None)], "x", 1) for i, t in enumerate(texts)],
                               "doc_id long, text string, page_spans array<struct<page_number:int,start_char:int,end_char:int,label:string>>, raw string, key int")
    whole = splitting.pieces(df, "doc_id", "text", F.lit(20), F.lit(6), "page_spans").collect()
    parts = splitting.pieces(df, "doc_id", "text", F.lit(20), F.lit(6), "page_spans", range_bytes=257).collect()
    key = lambda r: (r["doc_id"], r["piece_no"])
    assert sorted(whole, key=key) == sorted(parts, key=key)
    check_pieces(texts, whole, 20, 6)
    assert {r["boundary"] for r in whole} >= {"paragraph", "heading", "end"}
    assert {r["doc_id"] for r in whole if r["piece_no"] == 1} == {i for i, t in enumerate(texts) if len(TOKEN.findall(t or "")) > 20}
    assert splitting.pieces(df.where("false"), "doc_id", "text", F.lit(20), F.lit(6)).count() == 0


def test_gaps_tokens_and_marked_lines_of_any_length(spark, tmp_path):
    halo = splitting.HALO
    texts = [
        "one two.\n" + " " * (3 * halo) + "\nthree four " * 9, "a " * 9 + "x" * (3 * halo) + ". b " * 9, "a b c d e f\n\n# " + "long " * (halo // 2) + "\n\ng h i", "a " + "\n" * (3 * halo) + "b c " * 9,
        "tail " * 20 + " " * (2 * halo), "\n" * (2 * halo) + "head " * 20, "x" * (3 * halo), "end.\r" + "\n" * halo + "y z " * 9,
    ]
    df = docs(spark, *texts)
    key = lambda r: (r["doc_id"], r["piece_no"])
    whole = sorted(splitting.pieces(df, "doc_id", "text", F.lit(7), F.lit(2)).collect(), key=key)
    for size in (64, 1000, halo, halo + 1):
        assert sorted(splitting.pieces(df, "doc_id", "text", F.lit(7), F.lit(2), range_bytes=size).collect(), key=key) == whole
    check_pieces(texts, whole, 7, 2)
    assert [r["boundary"] for r in whole if r["doc_id"] == 2][0] == "heading" and [r["boundary"] for r in whole if r["doc_id"] == 3][0] == "token"
    for i, t in enumerate(texts):
        (tmp_path / f"{i}.txt").write_bytes(t.encode())
    (tmp_path / "empty.txt").write_bytes(b"")
    paths = [f"file://{tmp_path}/{n}.txt" for n in [*range(len(texts)), "empty"]]
    for size in (1000, splitting.RANGE):  # files are read by ranges
        got = sorted(((r["path"], *tuple(r)[1:]) for r in splitting.file_pieces(spark, paths, 7, 2, size).collect()))
        assert got == [(f"file://{tmp_path}/{r['doc_id']}.txt", *tuple(r)[1:]) for r in whole]
    (tmp_path / "bad.txt").write_bytes(b"\xff" * 50)
    with pytest.raises(Exception, match="utf-8"):
        splitting.file_pieces(spark, [f"file://{tmp_path}/bad.txt"]).collect()


def test_the_mix_holds_what_its_report_says(spark):
    sums = {(r["mix_id"], r["source"]): r["n"] for r in queries.p7_mix(spark, SF).groupBy("mix_id", "source").agg(F.sum(F.col("n_tokens") * F.col("repeats")).alias("n")).collect()}
    report = queries.p7_report(spark, SF).collect()
    assert {(r["mix_id"], r["source"]): r["reached_tokens"] for r in report if r["reached_tokens"]} == {k: n for k, n in sums.items() if n}
    assert {(r["mix_id"], r["source"]) for r in report if r["short"]} == {tuple(r) for r in queries.p7_found(spark, SF).collect()}


def test_natural_cuts(spark):
    text = "# One\n\n" + "a b c d. " * 3 + "\n\n# Two\n\n" + "e f g h. " * 3
    got = [r["text"] for r in splitting.pieces(docs(spark, text), "doc_id", "text", F.lit(18), F.lit(99)).where("piece_no = 0").collect()]
    assert got == ["# One\n\na b c d. a b c d. a b c d."] or got[0].startswith("# One")
    got = splitting.pieces(docs(spark, text), "doc_id", "text", F.lit(18), F.lit(0)).orderBy("piece_no").collect()
    assert [r["text"].split("\n")[0] for r in got] == ["# One", "# Two"] and got[0]["boundary"] == "heading"


MARKED = [
    "a <b>bold</b> word", "x<br/>y", "note <!-- gone --> here", "Q&amp;A", "&lt;li&gt;x", "# Title\n\ntext", "Title\n=====\n\ntext", "run `ls -l` now", "**b**", "__so__ it",
    "~~no~~", "[t](u)", "![alt](img/x.png)", "fact.[^1]", "| a | b |\n|---|:-:|\n| 1 | 2 |", "- [ ] task", "> quote", "see [[Page|p]]", "{{stub}}", "== Head ==", "''it'' is", "{| class=x\n|-\n| a || b\n|}",
    "\\section{S}", "left\\footnote{n}.", "$\\alpha_{n}$", "\\[x_1\\]", "~\\cite{a}", "```\ncode\n```", "\\begin{itemize}\n\\item a\n\\end{itemize}",
]
PLAIN = [
    "", " ", "p < 0.01 and for all x > 36", "returns a List<String> or a Map<Long, Foo>", "map to <unk> and <pad>; <|endoftext|>", "C:\\temp\\new_answer\\beta and restart", "Q&A of the R&D memo: a == b & c != 4", "Costs rose from $81 to $149 per rotor",
    "As in [11] and [37], 5 * 6 * 2", "The __init__ hook of a 7'' panel", "Ticket #1976 in C# code", "• a\n• b", "(a) one\n(a) two", "– dash\n– dash", 'payload {"k": [22, 15]}', "score = b / (n + 31)", "shard_shard_reranker", "No. 1: x", "1. one thing",
]


@pytest.mark.parametrize("text", MARKED)
def test_markup_is_found(text):
    assert markup.residue(text)


@pytest.mark.parametrize("text", PLAIN)
def test_look_alikes_are_content(text):
    assert not markup.residue(text) and markup.clean(text) == ([("text", text)] if text.strip() else [])


def test_minimum_cut_equals_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        n = rng.randrange(2, 9)
        w = [rng.uniform(-3, 3) for _ in range(n)]
        links = [(a, b, rng.uniform(0, rng.choice([0.2, 2]))) for a in range(n) for b in range(a + 1, n) if rng.random() < 0.5]
        cost = lambda x: sum(-w[i] if w[i] < 0 and x[i] else w[i] if w[i] > 0 and not x[i] else 0 for i in range(n)) + sum(c for a, b, c in links if x[a] != x[b])  # noqa: B023, E731
        best = min(cost([bool(k >> i & 1) for i in range(n)]) for k in range(1 << n))
        assert cost(mincut.max_flow(w, links)) == pytest.approx(best)
        assert cost(mincut.cut(w, links)) == pytest.approx(best)


def accuracy(edges):
    model, right, n = markup.fit(), {"spans": 0, "blocks": 0, "texts": 0}, {"spans": 0, "blocks": 0, "texts": 0}
    for text, spans, marked, found, furnished in markup.labelled_nodes(markup_labels.texts(400, seed=77, held_out=True)):
        if edges:
            got, pages = markup.label(text, spans, model), markup.label_blocks(text, found, model)
        else:
            got = (markup.span_features(text, spans) @ model.span > 0).tolist() if spans else []
            pages = (markup.block_features(text, found) @ model.block > 0).tolist() if found else []
        for name, a, b in (("spans", got, marked), ("blocks", pages, furnished), ("texts", [any(got)], [any(marked)])):
            right[name] += sum(x == y for x, y in zip(a, b))
            n[name] += len(b)
    return {k: right[k] / n[k] for k in n}


def test_edges_help_on_held_out_texts():
    whole, bare = accuracy(True), accuracy(False)
    assert whole["spans"] > bare["spans"] and whole["spans"] > 0.98 and whole["blocks"] > 0.97 and whole["texts"] > 0.99


def test_page_furniture_goes_and_content_stays():
    text = "<nav><ul><li>Home</li><li>About us</li></ul></nav>\n<p>The river turned to copper in late summer. It stayed so.</p>\n<footer>\u00a9 2020 Basin Press. All rights reserved.</footer>"
    assert markup.clean(text) == [("text", "The river turned to copper in late summer. It stayed so.")]
    text = "Home | Search | Contact | Log in\n\nThe river turned to copper in late summer, and stayed so.\n\nSubscribe to our newsletter"
    assert markup.clean(text) == [("text", "The river turned to copper in late summer, and stayed so.")]


@pytest.mark.parametrize("body", ["<script> ", "<style>", "<!-- ", "<p><b><i>", "</b>", "<a x ", "\\begin{verbatim} ", "\\begin{tabular} a & b ", "$$ ", "\\[ ", "\\( ", "$_", "`` ` ``` ", "{{a}", "''a'b ", "== ", "&lt;p x ", "[a][", "* a *", "| a ", " \t", "_a", "**a"])
def test_scans_are_linear(body):
    def seconds(n):
        began = time.process_time()
        markup.clean("x " + body * n)
        return time.process_time() - began

    seconds(50)
    few, many = min(seconds(2000) for _ in range(2)), seconds(32_000)
    assert many < 0.3 or many < 90 * few  # sixteen times the text, and collecting of garbage; its square is 256


def test_an_escaped_tag_of_any_length():
    for n in (190, 260, 5000):
        text = "see &lt;p class=" + "x" * n + "&gt; here"
        assert [s.kind for s in markup.residue(text)] == ["escaped"]


def test_nested_deeper_than_ever():
    text = "<div>" * 3000 + "deep" + "</div>" * 3000
    spans = markup.candidates(text)
    assert sum(w == markup.PAIR for _, _, w in markup.edges(spans)) == 3000 and markup.clean(text) == [("text", "deep")]
    assert "num" in {s.kind for s in markup.candidates("1234. one\n1235. two")}


def test_a_weak_span_follows_its_neighbours():
    assert not markup.residue("1. one\n2. two")
    kinds = {s.kind for s in markup.residue("- a\n- b\n1. one\n2. two\n- c\n- d")}
    assert kinds == {"dash", "num"}


def test_clean_keeps_structure():
    html = "<h1>T</h1><script>x()</script><p>a &amp; <b>b</b></p><ul><li>one</li><li>two</li></ul><pre><code>if x &lt; 2:\n    y</code></pre><table><tr><td>1</td><td>2</td></tr></table>"
    assert markup.clean(html) == [("heading", "T"), ("text", "a & b"), ("list", "• one\n• two"), ("code", "if x < 2:\n    y"), ("table", "1\t2")]
    md = "## H\n\ntext **b** [l](u)\n\n- x\n- y\n\n```py\n# c\n<div>\n```\n\n| a | b |\n|--|--|\n| 1 | 2 |\n\n$$\n\\alpha\n$$"
    assert markup.clean(md) == [("heading", "H"), ("text", "text b l"), ("list", "• x\n• y"), ("code", "# c\n<div>"), ("table", "a\tb\n1\t2"), ("formula", "\\alpha")]


def test_markup_frames(spark):
    df = docs(spark, None, "", "plain", "<p>x</p>" * 2000, "<" * 5000, "**" * 3000, "$" * 3000, "[" * 3000, "\n" * 5000)
    rows = {r["doc_id"]: r for r in markup.cleaned(df, "doc_id", "text").collect()}
    assert rows[0]["clean"] is None and rows[1]["clean"] == "" and rows[2]["clean"] == "plain" and rows[2]["n_residue"] == 0
    assert rows[3]["n_residue"] == 4000 and len(rows[3]["blocks"]) == 2000
    assert {r["doc_id"]: r["n_residue"] for r in markup.labelled(df, "doc_id", "text").collect()} == {i: r["n_residue"] for i, r in rows.items()}
    assert markup.cleaned(df.where("false"), "doc_id", "text").count() == 0
