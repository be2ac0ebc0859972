"""What operators once left out, or took for something else."""

import pytest
from pyspark.sql import functions as F

from tarnwick.llm import markup, splitting


def test_every_giant_row_counts(spark):
    text = "word one. " * 60
    rows = [(1, text, 10, 2, None), (1, text, 10, 2, None), (1, text, 500, 2, [(1, 300, 600, None)]), (None, text, 10, 2, None), (None, "a b", 10, 2, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, size int, overlap int, page_spans array<struct<page_number:int,start_char:int,end_char:int,label:string>>")
    limits = (F.col("size"), F.col("overlap"))
    whole, parts = (sorted(map(repr, splitting.pieces(df, "doc_id", "text", *limits, "page_spans", range_bytes=n).collect())) for n in (1 << 18, 100))
    assert whole == parts and len(whole) == 15 + 15 + 1 + 15 + 1


@pytest.mark.parametrize("text", ["<p>one", "one\n\n<P>two\n<P>three", "<div>\nx", "<li>one\n<li>two", "<tr><td>a<td>b", "<H1>T</H1>\n\n<P>Neither of them", "<ul><p>x"])
def test_unclosed_elements_are_markup(text):
    assert [s.kind for s in markup.residue(text)] == [s.kind for s in markup.candidates(text)] != []
    assert "<" not in "".join(b for _, b in markup.clean(text))


@pytest.mark.parametrize("text", ["a Box<p> or a List<a>", "set <title> and <object> first", "read from <table> into <body>", "the <s> token"])
def test_placeholders_are_content(text):
    assert not markup.residue(text)


@pytest.mark.parametrize("text,clean", [
    ("an _important point_ here", "an important point here"), ("see <https://a.example/x> now", "see https://a.example/x now"), ("write to <me@a.example> now", "write to me@a.example now"),
    ("see [the paper][one] here\n\n[one]: https://a.example/x", "see the paper here"), ("see [https://a.example the page] here", "see the page here"),
])
def test_further_forms_are_markup(text, clean):
    assert "\n".join(b for _, b in markup.clean(text)) == clean


def test_a_rule_that_starts_with_a_colon():
    assert "mdtable" in {s.kind for s in markup.residue("a | b\n:--- | ---:\n1 | 2")}


@pytest.mark.parametrize("text", ["snake_case_name and _private", "f(_a = 1, b_)", "as in [11] [37] and [x][y]", "path /a/_b_/c", "[note]: the values differ", "an array[0] of http://a.example"])
def test_look_alikes_of_further_forms_are_content(text):
    assert not markup.residue(text)
