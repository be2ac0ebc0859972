"""A corpus from harvested records: OAI-PMH pages to records, records to files with front matter, and their manifest.

The pages are files that were fetched before; nothing here reads the network.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyarrow.fs import FileSystem, FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.sources.golden import MANIFEST

# The name spaces of the protocol and of its plain records.
_OAI, _DC = "{http://www.openarchives.org/OAI/2.0/}", "{http://purl.org/dc/elements/1.1/}"
RECORD = "doc_id string, title string, authors array<string>, published string, categories array<string>, text string, token string, error string"


def parse_page(content: bytes | str) -> list[dict]:
    """The records of a page that are not deleted; each has the page's resumption token, null on the last page."""
    root = ElementTree.fromstring(content)
    token = root.findtext(f".//{_OAI}resumptionToken") or None
    out = []
    for record in root.iter(f"{_OAI}record"):
        head = record.find(f"{_OAI}header")
        if head is None or head.get("status") == "deleted":
            continue
        texts = lambda name: [" ".join((e.text or "").split()) for e in record.iter(f"{_DC}{name}") if (e.text or "").strip()]  # noqa: B023, E731
        name = (head.findtext(f"{_OAI}identifier") or "").strip().rsplit(":", 1)[-1]
        out.append({"doc_id": name, "title": next(iter(texts("title")), None), "authors": texts("creator"), "published": next(iter(texts("date")), None), "categories": [(e.text or "").strip() for e in head.iter(f"{_OAI}setSpec")], "text": "\n\n".join(texts("description")), "token": token, "error": None})
    return out


def records(pages: DataFrame, categories: list[str] | None = None) -> DataFrame:
    """Records of all pages (path, content), each identifier once, of any of the ``categories`` where they are given; a bad page is an error row."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in re.split(r", (?=\w+ )", RECORD)]
        for p in parts:
            rows = []
            for path, content in zip(p["path"], p["content"]):
                try:
                    rows += parse_page(content)
                except ElementTree.ParseError as e:
                    rows.append(dict.fromkeys(columns) | {"doc_id": path, "error": f"{path}: {e}"})
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    found = pages.select("path", "content").mapInPandas(run, RECORD)
    if categories:
        found = found.where(F.col("error").isNotNull() | F.arrays_overlap("categories", F.array(*map(F.lit, categories))))
    return found.dropDuplicates(["doc_id"])


def write_corpus(found: DataFrame, directory: str) -> DataFrame:
    """Each record as ``<doc_id>.md`` with front matter in a folder that all executors share; returns the manifest (doc_id, path, sha256)."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, root = FileSystem.from_uri(directory if "://" in directory else f"file://{directory}")
        if files.get_file_info(root).type == FileType.NotFound:
            files.create_dir(root, recursive=True)
        for p in parts:
            rows = []
            for r in p.to_dict("records"):
                name = re.sub(r"[^\w.-]", "_", r["doc_id"])
                meta = {"id": r["doc_id"], "title": r["title"], "published": r["published"]}
                lines = [f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in meta.items() if v]
                lines += [f"authors: {json.dumps(list(r['authors']), ensure_ascii=False)}"] if r["authors"] is not None and len(r["authors"]) else []
                body = ("---\n" + "\n".join(lines) + f"\n---\n# {r['title'] or r['doc_id']}\n\n{r['text']}\n").encode()
                with files.open_output_stream(f"{root}/{name}.md") as out:
                    out.write(body)
                rows.append((r["doc_id"], f"{name}.md", hashlib.sha256(body).hexdigest()))
            yield pd.DataFrame(rows, columns=["doc_id", "path", "sha256"])

    return found.where("error IS NULL").select("doc_id", "title", "authors", "published", "text").mapInPandas(run, MANIFEST)


def write_manifest(manifest: DataFrame, path: str) -> None:
    manifest.write.mode("overwrite").json(path)


def fresh(spark: SparkSession, found: DataFrame, known: DataFrame) -> DataFrame:
    """Records that the manifest doesn't have."""
    return found.join(known.select("doc_id").distinct(), "doc_id", "left_anti")
