import json
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tarnwick.operators.store import Collection
from tarnwick.sources import files, golden
from tarnwick.streaming import events, ingest


def test_loaders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.md").write_bytes(b"---\ntitle: T\nid: doc-a\ntags:\n- x\n- y\npublished: '2024-01-02'\n---\n# H1\r\n\r\nbody\n\n## H2\n\nmore 10\n")
    (tmp_path / "sub/b.TXT").write_bytes("plain é\r\n".encode())
    (tmp_path / "c.html").write_text("<html><head><title> My  page </title><script>x</script></head><body><h1>Top</h1><p>One <b>two</b><p>three<ul><li>item<li>next</ul><nav><li>kept</li></nav></body>")
    (tmp_path / "bad.txt").write_bytes(b"\xff\xfe\x00")
    (tmp_path / "x.bin").write_bytes(b"no")
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    with zipfile.ZipFile(tmp_path / "d.docx", "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>Head</w:t></w:r></w:p><w:p><w:r><w:t>Body</w:t></w:r></w:p></w:body></w:document>')
    got = {r["source_path"].rsplit("/", 1)[-1]: r for r in files.read_documents(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.md", "b.TXT", "c.html", "bad.txt", "d.docx"}
    a = got["a.md"]
    assert (a["doc_id"], a["metadata"]["title"], a["metadata"]["published"], a["metadata"]["tags"]) == ("doc-a", "T", "2024-01-02", '["x", "y"]')
    assert a["text"] == "# H1\n\nbody\n\n## H2\n\nmore 10\n" and [s["label"] for s in a["page_spans"]] == ["H1", "H2"]
    assert got["b.TXT"]["text"] == "plain é\n" and got["bad.txt"]["error"] and got["bad.txt"]["text"] is None
    assert got["c.html"]["text"] == "Top\n\nOne two\n\nthree\n\nitem\n\nnext\n\nkept" and got["c.html"]["metadata"]["title"] == "My page"
    d = got["d.docx"]
    assert d["text"] == "Head\n\nBody" and (d["page_spans"][0]["label"], d["page_spans"][0]["end_char"]) == ("Head", 10)


def test_markdown_headings_and_ids():
    text = "intro\n# C#\nx\n##  Two   words ##\n#### deep\n#no\n###\tTabbed\n# \n"
    spans = files.heading_spans(text)
    assert [(s["page_number"], s["label"]) for s in spans] == [(1, "C#"), (2, "Two words ##"), (3, "Tabbed")]
    assert [text[s["start_char"] : s["end_char"]].split("\n")[0] for s in spans] == ["# C#", "##  Two   words ##", "###\tTabbed"]
    assert spans[-1]["end_char"] == len(text) and spans[0]["end_char"] == spans[1]["start_char"]
    assert files.front_matter("---\na: 1\n--- \nbody") [1] == "body" and files.front_matter("---\na: 1\nbody") == ({}, "---\na: 1\nbody") and files.front_matter("x\n---\na\n---")[0] == {}
    assert files.stated_id({"arxiv_id": " ", "doc_id": True, "id": " x "}) == "x" and files.stated_id({"doc_id": 17}) == "17" and files.stated_id({"id": False}) is None
    assert files.coerce({"a": [1, "b"], "d": {"x": 1}, "n": None, "t": True, "f": 1.5}) == {"a": '["1", "b"]', "t": "True", "f": "1.5"}


def test_directories_and_paths(spark, tmp_path):
    for name in ("b.md", "a.txt", "c.bin"):
        (tmp_path / name).write_text("x")
    assert [r["path"].rsplit("/", 1)[-1] for r in files.list_files(spark, str(tmp_path)).collect()] == ["a.txt", "b.md"]
    with pytest.raises(NotADirectoryError):
        files.read_documents(spark, str(tmp_path / "b.md"))
    assert files.contained(str(tmp_path), "b.md").endswith("b.md")
    for bad in ("../x", "/etc/passwd", "a/../../x"):
        with pytest.raises(PermissionError):
            files.contained(str(tmp_path), bad)


def test_golden_io(spark, tmp_path):
    good = tmp_path / "g.jsonl"
    good.write_text('{"qid": "a", "question": "?", "relevant_doc_ids": ["d"], "relevant_chunk_texts": [], "answer": "", "category": "negative", "difficulty": "easy"}\n\n')
    df = golden.read_golden(spark, str(good))
    golden.write_golden(df, str(tmp_path / "out"))
    assert golden.read_golden(spark, str(tmp_path / "out")).collect() == df.collect()
    (tmp_path / "bad.jsonl").write_text(good.read_text() + "{nope\n")
    with pytest.raises(Exception, match=r"bad.jsonl: line 3 is no golden entry"):
        golden.read_golden(spark, str(tmp_path / "bad.jsonl")).collect()
    (tmp_path / "m.jsonl").write_text('{"doc_id": "a", "path": "p", "sha256": "s"}\n')
    assert golden.read_manifest(spark, str(tmp_path / "m.jsonl")).count() == 1
    (tmp_path / "m2.jsonl").write_text('{"doc_id": "a", "path": "p", "sha256": "s"}\n{broken\n')
    assert golden.read_manifest(spark, str(tmp_path / "m2.jsonl")).count() == golden.read_manifest(spark, str(tmp_path / "none.jsonl")).count() == 0
    golden.write_run(spark, str(tmp_path / "run"), "hybrid", {"k": 5}, {"recall": 0.5}, {"by category": df.groupBy("category").count()})
    assert json.loads((tmp_path / "run/run.json").read_text())["metrics"] == {"recall": 0.5} and "| recall | 0.500 |" in (tmp_path / "run/report.md").read_text()
    assert golden.write_baseline(spark, str(tmp_path / "base.json"), {"recall": 0.5}) == json.loads((tmp_path / "base.json").read_text())["floors"] == {"recall": 0.45}
    many = golden.markdown_table(spark.range(700).selectExpr("CAST(id AS STRING) AS i"), ["i"])
    assert len(many.splitlines()) == 702
    with pytest.raises(ValueError):
        golden.markdown_table(spark.range(golden.REPORT_ROWS + 1), ["id"])
    table = golden.markdown_table(spark.createDataFrame([("x", 0.12345, None)], "a string, b double, c double"), ["a", "b", "c"])
    assert table.splitlines()[-1] == "| x | 0.123 | 0.000 |"


def test_ingest_stream_is_incremental(spark, tmp_path):
    source = tmp_path / "in"
    source.mkdir()
    (source / "one.md").write_text("# One\n\nfirst text\n")
    (source / "bad.md").write_bytes(b"\xff")
    c = Collection(spark, str(tmp_path / "col"), "hash-bow-128", 128)
    ingest.watch(spark, str(source), c, str(tmp_path / "cp")).awaitTermination()
    before = c.chunks.version()
    assert c.documents.read().count() == 1 and c.chunks.read().count() == 1
    (source / "two.txt").write_text("second")
    ingest.watch(spark, str(source), c, str(tmp_path / "cp")).awaitTermination()
    assert c.chunks.version() != before and c.documents.read().count() == 2
    again = c.chunks.version()
    raw = spark.createDataFrame([(str(source / "one.md"), bytearray(b"# One\n\nfirst text\n"))], "path string, content binary")
    assert [r["status"] for r in ingest.ingest(c, raw).collect()] == ["unchanged"] and c.chunks.version() == again
    raw = spark.createDataFrame([(str(source / "one.md"), bytearray(b" "))], "path string, content binary")
    assert [r["status"] for r in ingest.ingest(c, raw).collect()] == ["changed"]
    assert {r["doc_id"] for r in c.chunks.read().collect()} == {"two"}  # no stale chunks


def at(*seconds):
    return [pd.Timestamp("2024-01-01") + pd.Timedelta(seconds=s) for s in seconds]


def test_token_bucket(spark):
    rows = pd.DataFrame({"user_id": [1] * 5 + [2], "event_id": range(6), "ts": at(0, 0, 0, 30, 31, 0)})
    got = {r["event_id"]: r["allowed"] for r in events.token_bucket(spark.createDataFrame(rows), per_minute=2, capacity=2).collect()}
    assert got == {0: True, 1: True, 2: False, 3: True, 4: False, 5: True}
    assert events.refill(1.0, 10.0, 5.0, 1.0, 5.0) == 1.0
    none = events.token_bucket(spark.createDataFrame(rows), per_minute=2, capacity=0).collect()
    assert len(none) == 6 and not any(r["allowed"] for r in none)  # a capacity of 0 is no default


def test_streams_equal_batches(spark, tmp_path):
    rows = pd.DataFrame({"user_id": [1, 1, 2, 1], "event_id": range(4), "ts": at(0, 10, 20, 7300), "event_type": list("aaba"), "value": [1.0, 2.0, 3.0, 4.0]})
    spark.createDataFrame(rows).coalesce(1).write.parquet(str(tmp_path / "ev"))
    schema = spark.read.parquet(str(tmp_path / "ev")).schema
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "ev"))

    def run(df, name, mode):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        assert q.awaitTermination(60)
        return spark.table(name)

    batch = spark.read.parquet(str(tmp_path / "ev"))
    assert sorted(run(events.token_bucket(stream, 2, 2), "bucket", "append").collect()) == sorted(events.token_bucket(batch, 2, 2).collect())
    assert sorted(run(events.windowed(stream), "win", "complete").collect()) == sorted(events.windowed(batch).collect())
    assert events.sessions(batch).agg(F.sum("n")).first()[0] == 4
