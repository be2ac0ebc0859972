import json
import threading
from http.server import BaseHTTPRequestHandler, HTTPServer
from types import SimpleNamespace

import pytest

from tarnwick.functions import remote
from tarnwick.functions.embedding import embed
from tarnwick.operators import answer, drafting
from tarnwick.operators.store import Collection
from tarnwick.sources import files, golden, harvest
from tarnwick.streaming import ingest


@pytest.fixture(scope="module")
def server():
    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            if self.path == "/embed":
                reply = {"data": [{"index": i, "embedding": [float(len(t)), 1.0]} for i, t in reversed(list(enumerate(body["input"])))]}
            elif self.path == "/draft":
                inside = "verbatim words of the passage" if "good" in body["prompt"] else "never written"
                reply = {"response": f"Sure.\nQ: What is it?\nS: {inside}"}
            else:
                reply = {"response": "said [1]."} if self.path == "/ok" else [1]
            raw = json.dumps(reply).encode() if self.path != "/broken" else b"{"
            self.send_response(500 if self.path == "/down" else 200)
            self.end_headers()
            self.wfile.write(raw)

        def log_message(self, *_):
            pass

    s = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=s.serve_forever, daemon=True).start()
    yield f"http://127.0.0.1:{s.server_port}"
    s.shutdown()


def test_models_behind_http(spark, server):
    model = remote.HttpEmbedder(f"{server}/embed", "m", 2)
    df = spark.createDataFrame([("abc",), ("x",)], "t string")
    assert sorted(r["v"] for r in df.select(embed(df["t"], model).alias("v")).collect()) == [[1.0, 1.0], [3.0, 1.0]]
    with pytest.raises(remote.ModelUnavailableError):
        remote.HttpEmbedder(f"{server}/embed", "m", 3).embed(["a"])
    with pytest.raises(remote.ModelUnavailableError):
        remote.HttpEmbedder(f"{server}/other", "m", 2).embed(["a"])
    assert remote.HttpGenerator(f"{server}/ok", "m").complete(["p"]) == ["said [1]."] and remote.HttpGenerator(f"{server}/ok", "m").health()
    for bad in ("down", "broken", "other"):
        assert remote.HttpGenerator(f"{server}/{bad}", "m").complete(["p", "q"]) == [None, None]
    assert not remote.HttpGenerator("http://127.0.0.1:9/x", "m", timeout=1).health()
    prompts = spark.createDataFrame([("q", "p")], "qid string, prompt string")
    assert answer.generated(prompts, remote.HttpGenerator(f"{server}/ok", "m")).first()["answer"] == "said [1]."


def test_drafts_are_verbatim(spark, server):
    long = "filler " * 60
    chunks = spark.createDataFrame([("c1", "a", long + "good verbatim words of the passage"), ("c2", "b", long), ("c3", "s", "good short")], "chunk_id string, doc_id string, text string")
    docs = spark.createDataFrame([("a", long + "good verbatim words of the passage"), ("b", long), ("s", "good short")], "doc_id string, text string")
    got = drafting.drafts(chunks, docs, remote.HttpGenerator(f"{server}/draft", "m")).collect()
    assert [(r["qid"], r["question"], r["relevant_doc_ids"], r["relevant_chunk_texts"]) for r in got] == [("draft-a", "What is it?", ["a"], ["verbatim words of the passage"])]
    assert drafting.drafts(chunks, docs, remote.HttpGenerator(f"{server}/down", "m")).count() == 0


PAGE = """<?xml version="1.0"?><OAI-PMH xmlns="http://www.openarchives.org/OAI/2.0/"><ListRecords>
<record><header><identifier>oai:x.org:1</identifier><setSpec>cs</setSpec></header><metadata><dc xmlns:dc="http://purl.org/dc/elements/1.1/"><dc:title>One  title</dc:title><dc:creator>A, B</dc:creator><dc:creator>C</dc:creator><dc:date>2020-01-02</dc:date><dc:description>Body: text.</dc:description></dc></metadata></record>
<record><header status="deleted"><identifier>oai:x.org:2</identifier></header></record>
<record><header><identifier>oai:x.org:3</identifier><setSpec>math</setSpec></header></record>
<resumptionToken>t1</resumptionToken></ListRecords></OAI-PMH>"""


def test_harvested_records_become_a_corpus(spark, tmp_path):
    pages = spark.createDataFrame([("p1", bytearray(PAGE.encode())), ("p2", bytearray(PAGE.encode())), ("bad", bytearray(b"<x"))], "path string, content binary")
    every = {r["doc_id"]: r for r in harvest.records(pages).collect()}
    assert set(every) == {"1", "3", "bad"} and every["bad"]["error"] and every["1"]["token"] == "t1" and every["1"]["authors"] == ["A, B", "C"]
    found = harvest.records(pages, ["cs"]).cache()
    assert {r["doc_id"] for r in found.collect()} == {"1", "bad"}
    manifest = harvest.write_corpus(found, str(tmp_path / "corpus")).cache()
    assert [r["path"] for r in manifest.collect()] == ["1.md"]
    harvest.write_manifest(manifest, str(tmp_path / "m"))
    known = golden.read_manifest(spark, str(tmp_path / "m"))
    assert {r["doc_id"] for r in harvest.fresh(spark, found, known).collect()} == {"bad"}
    doc = files.read_documents(spark, str(tmp_path / "corpus")).first()
    assert (doc["doc_id"], doc["metadata"]["title"], doc["text"]) == ("1", "One title", "# One title\n\nBody: text.\n") and doc["metadata"]["authors"] == '["A, B", "C"]'


def test_uploads_and_replay(spark, tmp_path, monkeypatch):
    c = Collection(spark, f"file://{tmp_path}/c", "hash-bow-128", 128)
    c.ensure()
    assert [r["status"] for r in ingest.upload(c, "../x/note.md", b"# T\n\nwords").collect()] == ["new"] and c.documents.read().first()["doc_id"] == "note"
    with pytest.raises(files.UnsupportedFormatError):
        ingest.upload(c, "x.exe", b"")
    monkeypatch.setattr(ingest, "UPLOAD_BYTES", 3)
    with pytest.raises(ValueError):
        ingest.upload(c, "x.md", b"1234")
    said = ingest.replay(spark.createDataFrame([("q", "two words")], "qid string, answer string")).orderBy("position").collect()
    assert [(r["event"], r["data"]) for r in said] == [("token", "two"), ("token", "words"), ("done", "")]


def test_pdf_pages(monkeypatch):
    page = lambda t: SimpleNamespace(extract_text=lambda: t)
    reader = SimpleNamespace(pages=[page(" One "), page(""), page("Three")], metadata={"/Title": "T"})
    monkeypatch.setattr(files, "pypdf", SimpleNamespace(PdfReader=lambda _: reader))
    row = files.load("a/b.pdf", b"%PDF")
    assert (row["text"], row["metadata"]) == ("One\n\nThree", {"title": "T"}) and [(s["page_number"], s["start_char"], s["end_char"]) for s in row["page_spans"]] == [(1, 0, 3), (3, 5, 10)]
    monkeypatch.setattr(files, "pypdf", None)
    assert "pypdf" in files.load("a/b.pdf", b"%PDF")["error"]
