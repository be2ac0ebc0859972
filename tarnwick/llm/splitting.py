"""Splitting oversized documents at natural boundaries, by byte ranges.

A text is read in ranges of bytes with halos.  Workers find, in their range alone,
where tokens start and how natural a cut before each would be (heading, paragraph,
sentence or line, any token); what they can't see, the gap and the token before
their first one, they leave to the stitching as counts.  The boundary tables of a
text are stitched in order, with prefix sums of the characters of its ranges: the
stitcher streams over them and holds one range and one piece at a time.  Page starts
are met there, pieces are planned, and emitted by offset from the ranges they touch.

Giant files (:func:`file_pieces`) are read range by range with a seek each, and no
worker or driver ever holds one.  Texts of a table arrive as whole cells, as its
reader makes them; those above ``RANGE`` bytes are cut into the same ranges, spread
over the cluster by (row, range), and go the same way from there.  A text of one
range takes the same steps in one task, without a shuffle.

A piece holds at most ``size`` tokens and shares exactly ``overlap`` tokens with the
next.  The cut is the most natural boundary in the second half of what fits (the
last of equals), else the most natural one that still makes progress, else the
token limit.  A token is a maximal run of characters other than space, tab, line
feed, form feed and carriage return, and is never cut.  A heading is a line that is
marked as one, or, up to ``HEADING_TOKENS`` tokens and ``HEADING_BYTES`` bytes, one
that is underlined or stands alone without a full stop.  Tokens, gaps and marked
lines may have any length, and the pieces don't depend on how a text falls into
ranges.

Defined results: null, empty and blank texts give no pieces; texts within the size
give one piece; a null or non-positive size means the default, a null or negative
overlap the default, and an overlap of the size or more means size - 1; null,
reversed, unordered or out-of-range page spans are skipped or count where they
start; repeated rows and rows without an id are split each; empty tables give no rows;
a file that isn't UTF-8 is an error; other columns are not read, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tarnwick.runtime import hadoop_path, stage

RANGE = 1 << 18
#: Bytes that a range sees before and behind itself; more than a heading's line may have.
HALO = 1 << 12
SIZE, OVERLAP = 512, 64
HEADING_TOKENS, HEADING_BYTES = 12, 1 << 10
TOKEN, SENTENCE, PARAGRAPH, HEADING, PAGE = 1, 2, 3, 4, 5
NAMES = {TOKEN: "token", SENTENCE: "sentence", PARAGRAPH: "paragraph", HEADING: "heading", PAGE: "page"}

_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\f\r")] = True
_STOP = np.zeros(256, bool)
_STOP[list(b".!?")] = True
_CLOSER = np.zeros(256, bool)
_CLOSER[list(b"\"')]}*_")] = True
_NO_HEADING_END = np.zeros(256, bool)
_NO_HEADING_END[list(b".!?;,")] = True
_BULLET = np.zeros(256, bool)
_BULLET[list(b"-*+|>(")] = True


class Seen(NamedTuple):
    """What one range shows: its tokens, and what its neighbours need to know."""

    at: np.ndarray  #: where tokens start, as bytes of the window
    strength: np.ndarray  #: of a cut before each; the first is decided when ranges are stitched
    heading: bool  #: whether the first token starts a heading's line
    stop: int  #: whether the token that ends before the first start ends a sentence; -1 if it ends in an earlier range
    breaks: int  #: line breaks from there, or from the beginning of the range, to the first start
    last_stop: int  #: the same of the last token that ends here; -1 if none does
    last_breaks: int  #: line breaks from there, or from the beginning of the range, to its end


def detect(window: np.ndarray, begin: int, end: int) -> Seen:
    """The tokens that start in [begin, end) of the window."""
    space = _SPACE[window]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    newline = window == 10
    newline |= (window == 13) & ~np.append(newline[1:], False)
    lines = np.flatnonzero(newline)
    inside = lines[(lines >= begin) & (lines < end)]
    last, inner, third = (window[np.maximum(ends - k, 0)] for k in (1, 2, 3))
    stop = _STOP[last] | (_CLOSER[last] & _STOP[inner])
    stop |= (third == 0xE3) & (inner == 0x80) & (last == 0x82)
    stop |= (third == 0xEF) & (inner == 0xBC) & ((last == 0x81) | (last == 0x9F))
    own = np.flatnonzero((starts >= begin) & (starts < end))
    at = starts[own]
    strength = np.full(len(own), TOKEN, np.int8)

    def between(a: int, z: int) -> int:
        return int(np.searchsorted(inside, z) - np.searchsorted(inside, a))

    def before(z: int) -> tuple[int, int]:
        """Of the last token that ends in (begin, z]: whether it ends a sentence, and the line breaks behind it up to z."""
        k = int(np.searchsorted(ends, z, "right")) - 1
        if k < 0 or ends[k] <= begin:
            return -1, between(begin, z)
        return int(stop[k]), between(int(ends[k]), z)

    last_stop, last_breaks = before(end)
    if not len(own):
        return Seen(at, strength, False, -1, 0, last_stop, last_breaks)
    breaks = np.searchsorted(lines, at[1:]) - np.searchsorted(lines, ends[own[1:] - 1])
    strength[1:][stop[own[1:] - 1] | (breaks >= 1)] = SENTENCE
    strength[1:][breaks >= 2] = PARAGRAPH
    look = np.flatnonzero(np.append(True, breaks >= 2))
    heads = look[_headings(window, at[look], own[look], starts, lines)]
    strength[heads] = HEADING
    first_stop, first_breaks = before(int(at[0]))
    return Seen(at, strength, bool(len(heads) and heads[0] == 0), first_stop, first_breaks, last_stop, last_breaks)


def _headings(window: np.ndarray, at: np.ndarray, number: np.ndarray, starts: np.ndarray, lines: np.ndarray) -> np.ndarray:
    """At which token starts a line is a heading: marked as one, underlined, or one short line without a full stop."""
    n = len(window)
    nth = np.searchsorted(lines, at)
    stop = np.append(lines, n)[np.minimum(nth, len(lines))]
    near = stop - at <= HEADING_BYTES
    first, second = window[at], window[np.minimum(at + 1, n - 1)]
    third = window[np.minimum(at + 2, n - 1)]
    marked = ((first == 35) & ((second == 35) | (second == 32))) | ((first == 61) & (second == 61))
    marked |= (first == 60) & ((second | 32) == 104) & (third >= 49) & (third <= 54)
    section = b"section"
    for i in range(3):  # \section, \subsection, \subsubsection
        match = first == 92
        for j, c in enumerate(b"sub" * i + section):
            match &= window[np.minimum(at + 1 + j, n - 1)] == c
        marked |= match
    after = np.minimum(stop + 1, n - 1)
    under = window[after]
    run = window[np.minimum(stop + 2, n - 1)]
    underlined = ((under == 61) | (under == 45)) & (under == run) & (stop + 2 < n)
    final = window[np.maximum(stop - 1, 0)]
    final = np.where((final == 13) | (final == 32), window[np.maximum(stop - 2, 0)], final)
    count = np.searchsorted(starts, stop) - number
    alone = (stop + 1 < n) & ((under == 10) | (under == 13))
    short = (count <= HEADING_TOKENS) & ~_NO_HEADING_END[final] & ~_BULLET[first] & alone & (first < 0x80)
    return marked | (near & (underlined | short))


class Stitcher:
    """Plans the pieces of one text from its ranges, in order; holds what the current piece may still need.

    A piece is (number, first and end character, tokens, boundary).
    """

    def __init__(self, size: int, overlap: int, pages: list | None):
        self.size, self.overlap = size, overlap
        pages = [s["start_char"] for s in pages or [] if s is not None and s["start_char"] is not None and s["start_char"] > 0]
        self.pages = np.array(sorted(pages), np.int64)
        self.starts, self.strength = np.empty(0, np.int64), np.empty(0, np.int8)
        self.chars = self.pieces = 0
        self.stop, self.breaks = -1, 0  # of the last token so far; -1: there was none

    def feed(self, n_chars: int, starts: np.ndarray, seen: tuple[np.ndarray, bool, int, int, int, int]) -> list[tuple[int, int, int, int, str]]:
        """Takes the next range; ``starts`` are characters of the range, ``seen`` is what :func:`detect` gives besides."""
        strength, heading, stop, breaks, last_stop, last_breaks = seen
        starts = starts + self.chars
        if len(starts):
            strength = strength.copy()
            if stop < 0:
                stop, breaks = self.stop, self.breaks + breaks
            block = stop < 0 or breaks >= 2
            strength[0] = (HEADING if heading else PARAGRAPH) if block else SENTENCE if stop or breaks else TOKEN
            here = np.searchsorted(starts, self.pages)
            strength[here[here < len(starts)]] = PAGE
            self.pages = self.pages[here == len(starts)]
            self.starts, self.strength = np.concatenate([self.starts, starts]), np.concatenate([self.strength, strength])
        self.stop, self.breaks = (last_stop, last_breaks) if last_stop >= 0 else (self.stop, self.breaks + last_breaks)
        self.chars += n_chars
        return self._plan()

    def _plan(self) -> list[tuple[int, int, int, int, str]]:
        out, s, size, overlap = [], 0, self.size, self.overlap
        while len(self.starts) - s > size:
            e = 0
            for low in (s + max(overlap, size // 2), s + overlap):
                inside = self.strength[low + 1 : s + size + 1]
                if len(inside) and (best := inside.max()) >= SENTENCE:
                    e = low + 1 + len(inside) - 1 - int(np.argmax(inside[::-1] == best))
                    break
            e = e or s + size
            out.append((self.pieces, int(self.starts[s]), int(self.starts[e]), e - s, NAMES[int(self.strength[e])]))
            self.pieces += 1
            s = e - overlap
        self.starts, self.strength = self.starts[s:], self.strength[s:]
        return out

    def end(self) -> list[tuple[int, int, int, int, str]]:
        """The last piece; it ends with the text."""
        return [(self.pieces, int(self.starts[0]), self.chars, len(self.starts), "end")] if len(self.starts) else []


PAGES = T.ArrayType(T.StructType([T.StructField("start_char", T.LongType())]))


def _limits(size: Column, overlap: Column) -> tuple[Column, Column]:
    size = F.when(size > 0, size.cast("int")).otherwise(F.lit(SIZE))
    overlap = F.when(overlap >= 0, overlap.cast("int")).otherwise(F.lit(OVERLAP))
    return size, F.least(overlap, size - 1)


def _source(docs: DataFrame, doc_id: str, text: str, size: Column, overlap: Column, spans: str | None) -> DataFrame:
    size, overlap = _limits(size, overlap)
    pages = F.col(f"`{spans}`") if spans else F.lit(None).cast("array<struct<start_char:int>>")
    pages = F.transform(pages, lambda s: F.struct(s["start_char"].cast("long").alias("start_char")))
    raw = F.col(f"`{text}`").cast("string").cast("binary")
    return docs.select(F.col(f"`{doc_id}`").alias("id"), raw.alias("raw"), size.alias("size"), overlap.alias("overlap"), pages.alias("pages"))


def _chars(window: np.ndarray) -> np.ndarray:
    """Characters before each byte position (one entry more than bytes)."""
    out = np.zeros(len(window) + 1, np.int64)
    np.cumsum((window & 0xC0) != 0x80, out=out[1:])
    return out


def _bytes(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.uint8)


PIECE = [("piece_no", T.IntegerType()), ("text", T.StringType()), ("start_char", T.LongType()), ("end_char", T.LongType()), ("n_tokens", T.IntegerType()), ("boundary", T.StringType())]


def pieces(docs: DataFrame, doc_id: str, text: str, size: Column, overlap: Column, spans: str | None = None, range_bytes: int = RANGE) -> DataFrame:
    """doc_id, piece_no, text, start_char, end_char, n_tokens and the boundary before which the piece ends."""
    src = _source(docs, doc_id, text, size, overlap, spans)
    out = T.StructType([src.schema["id"], *[T.StructField(n, t) for n, t in PIECE]])
    kinds = [pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.string()]

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, rows = [], []
            for i, r in enumerate(b.to_pylist()):
                if not r["raw"]:
                    continue
                window = _bytes(r["raw"])
                seen = detect(window, 0, len(window))
                before = _chars(window)
                one = Stitcher(r["size"], r["overlap"], r["pages"])
                decoded = r["raw"].decode("utf-8", "replace")
                for no, a, z, n, how in [*one.feed(int(before[-1]), before[seen.at], seen[1:]), *one.end()]:
                    piece = decoded[a:z].rstrip(" \t\n\f\r")
                    at.append(i)
                    rows.append((no, piece, a, a + len(piece), n, how))
            cols = list(zip(*rows)) if rows else [()] * len(PIECE)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at, pa.int64())), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=out.names)

    small = src.where(F.octet_length("raw") <= range_bytes).mapInArrow(whole, out)
    # Each giant row has its own key; written once, so that a key never changes.
    giants = stage(src.where(F.octet_length("raw") > range_bytes).withColumn("key", F.expr("uuid()")))
    return small.unionByName(_stitched(_ranges(giants, range_bytes), out)).withColumnRenamed("id", doc_id)


def file_pieces(spark: SparkSession, paths: list[str], size: int = SIZE, overlap: int = OVERLAP, range_bytes: int = RANGE) -> DataFrame:
    """path and the pieces of each text file, which is read by ranges of bytes; no task reads more of one than a range and its halos.

    The paths are URIs of a file system that all executors share and that Arrow can open.
    """
    sized = []
    for path in paths:
        where, files = hadoop_path(spark, path)
        sized.append((path, files.getFileStatus(where).getLen()))
    table = spark.createDataFrame(sized, "id string, length long").where("length > 0")
    size_, overlap_ = _limits(F.lit(size), F.lit(overlap))
    number = F.explode(F.sequence(F.lit(0), F.floor((F.col("length") - 1) / range_bytes).cast("int"))).alias("no")
    each = table.select("id", F.col("id").alias("key"), size_.alias("size"), overlap_.alias("overlap"), "length", number).repartition("key", "no")
    out = T.StructType([T.StructField("id", T.StringType()), *[T.StructField(n, t) for n, t in PIECE]])
    fields = [T.StructField(n, t) for n, t in (("id", T.StringType()), ("key", T.StringType()), ("size", T.IntegerType()), ("overlap", T.IntegerType()), ("no", T.IntegerType()))]
    fields += [T.StructField("pages", PAGES), T.StructField("lead", T.IntegerType()), T.StructField("core", T.IntegerType()), T.StructField("window", T.BinaryType())]
    schema = T.StructType(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, (path, no, length) in enumerate(zip(*(b.column(c).to_pylist() for c in ("id", "no", "length")))):
                files, name = FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                begin = no * range_bytes
                lead = min(begin, HALO)
                with files.open_input_file(name) as f:
                    window = f.read_at(min(lead + range_bytes + HALO, length - begin + lead), begin - lead)
                one = b.slice(i, 1)
                more = [pa.nulls(1, pa.list_(pa.struct([("start_char", pa.int64())]))), pa.array([lead], pa.int32()), pa.array([min(range_bytes, length - begin)], pa.int32()), pa.array([window], pa.binary())]
                yield pa.RecordBatch.from_arrays([*[one.column(c) for c in ("id", "key", "size", "overlap", "no")], *more], names=schema.names)

    return _stitched(each.mapInArrow(read, schema), out, strict=True).withColumnRenamed("id", "path")


def _ranges(giants: DataFrame, range_bytes: int) -> DataFrame:
    """id, key, no, window, lead (bytes of halo before), core (bytes of the range itself) of every range, spread over the cluster."""
    number = F.sequence(F.lit(0), ((F.octet_length("raw") - 1) / range_bytes).cast("int"))
    each = giants.select("*", F.explode(number).alias("no"))
    begin = F.col("no") * range_bytes
    lead = F.least(begin, F.lit(HALO))
    window = F.substring("raw", begin - lead + 1, lead + range_bytes + HALO)
    core = F.least(F.lit(range_bytes), F.octet_length("raw") - begin)
    pages = F.when(F.col("no") == 0, F.col("pages")).alias("pages")
    return each.select("id", "key", "size", "overlap", "no", pages, lead.alias("lead"), core.alias("core"), window.alias("window")).repartition("key", "no")


def _stitched(ranges: DataFrame, out: T.StructType, strict: bool = False) -> DataFrame:
    keys = [ranges.schema[c] for c in ("id", "key", "size", "overlap", "no", "pages")]
    seen = [T.StructField("strength", T.BinaryType()), T.StructField("heading", T.BooleanType()), *[T.StructField(n, T.IntegerType()) for n in ("stop", "breaks", "last_stop", "last_breaks")]]
    table = T.StructType([*keys, T.StructField("n_chars", T.LongType()), T.StructField("starts", T.ArrayType(T.IntegerType())), *seen, T.StructField("body", T.StringType())])
    kinds = [pa.int64(), pa.list_(pa.int32()), pa.binary(), pa.bool_(), *[pa.int32()] * 4, pa.string()]

    def boundaries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for w, lead, core in zip(*(b.column(x).to_pylist() for x in ("window", "lead", "core"))):
                window = _bytes(w)
                first, end = lead, lead + core  # a character belongs to the range of its first byte
                while first < end and window[first] & 0xC0 == 0x80:
                    first += 1
                while end < len(window) and window[end] & 0xC0 == 0x80:
                    end += 1
                found = detect(window, lead, lead + core)
                chars = _chars(window)
                body = w[first:end].decode("utf-8", "strict" if strict else "replace")
                rows.append((int(chars[end] - chars[first]), chars[found.at] - chars[first], found.strength.tobytes(), *found[2:], body))
            cols = list(zip(*rows)) if rows else [()] * len(kinds)
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in keys], *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=table.names)

    found = stage(ranges.mapInArrow(boundaries, table))
    planned = T.StructType([*keys[:2], T.StructField("no", T.IntegerType()), *[T.StructField(n, t) for n, t in PIECE if n not in ("text", "end_char")], T.StructField("from", T.LongType()), T.StructField("length", T.LongType())])
    plan_kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64()]

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = one = None
        who: list[tuple] = []
        rows: list[tuple] = []
        spread: list[tuple[int, int, int]] = []  # number, first and end character of the ranges that an open piece may touch

        def place(made: list[tuple[int, int, int, int, str]]) -> None:
            for no, a, z, n, how in made:
                while spread[0][2] <= a:  # pieces begin in order
                    del spread[0]
                for r, u, v in spread:
                    if u >= z:
                        break
                    who.append(key)
                    rows.append((r, no, a, n, how, max(a, u) - u, min(z, v) - max(a, u)))

        def batch() -> pa.RecordBatch:
            cols = list(zip(*rows)) if rows else [()] * len(plan_kinds)
            ids = list(zip(*who)) if who else [(), ()]
            made = pa.RecordBatch.from_arrays([pa.array(ids[0], id_kind), pa.array(ids[1], pa.string()), *[pa.array(c, k) for c, k in zip(cols, plan_kinds)]], names=planned.names)
            who.clear()
            rows.clear()
            return made

        id_kind = to_arrow_type(keys[0].dataType)
        for b in batches:
            for r in b.to_pylist():
                if one is None or r["key"] != key[1]:
                    if one is not None:
                        place(one.end())
                    key, one = (r["id"], r["key"]), Stitcher(r["size"], r["overlap"], r["pages"])
                    spread.clear()
                spread.append((r["no"], one.chars, one.chars + r["n_chars"]))
                what = (np.frombuffer(r["strength"], np.int8), *(r[f.name] for f in seen[1:]))
                place(one.feed(r["n_chars"], np.array(r["starts"], np.int64), what))
            yield batch()
        if one is not None:
            place(one.end())
            yield batch()

    # One text's ranges go to one task in order, which streams over them; texts are spread.
    ordered = found.drop("body").repartition("key").sortWithinPartitions("key", "no")
    parts = ordered.mapInArrow(stitch, planned).join(found.select("key", "no", "body"), ["key", "no"])
    parts = parts.withColumn("part", F.substring(F.col("body"), F.col("from").cast("int") + 1, F.col("length").cast("int"))).drop("body")
    joined = parts.groupBy("id", "key", "piece_no", "start_char", "n_tokens", "boundary").agg(F.array_sort(F.collect_list(F.struct("no", "part"))).alias("p"))
    body = F.regexp_replace(F.array_join(F.transform("p", lambda x: x["part"]), ""), "[ \\t\\n\\f\\r]+\\z", "")
    full = joined.select("id", "piece_no", body.alias("text"), "start_char", "n_tokens", "boundary")
    return full.withColumn("end_char", F.col("start_char") + F.length("text")).select(*out.names)
