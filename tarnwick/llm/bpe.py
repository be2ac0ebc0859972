"""Exact byte-pair encoding by dynamic programming over prefixes.

The encoding of every prefix of a pre-token ends in one unique token.  A suffix
automaton of the whole vocabulary reads the bytes once; at each position its
suffix links list the vocabulary tokens that end there, longest first.  A token
is the last one of the prefix exactly if it starts the prefix or if it may follow
the last token of the prefix before it, which is decided by undoing the merges of
the two tokens (no merge across the seam may come before those inside).  The ids
come out by following the back-pointers.  Time is linear in the bytes, however
long a pre-token is; nothing is merged step by step.

Pre-tokens that a worker has met before come from a bounded memo, which is
emptied when full, so its size never depends on the data.
"""

from __future__ import annotations

import base64
import hashlib
import importlib
import os
import shutil
import tempfile
from array import array
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

MEMO = 400_000
#: A pair of tokens is one integer of twice as many bits; a larger vocabulary is refused.
PAIR_BITS = 31
_NONE = -1


class SuffixAutomaton:
    """All substrings of the vocabulary, with the longest token that is a suffix of each state.

    ``token[s]`` is the id of the vocabulary token that equals the longest string
    of state ``s``; ``shorter[s]`` is the next state on the suffix links that has one.
    """

    def __init__(self, tokens: list[bytes]):
        self.length = array("i", [0])
        self.link = array("i", [_NONE])
        self.to: dict[int, int] = {}
        ends = [self._add(t) for t in tokens]
        n = len(self.length)
        self.token = array("i", [_NONE]) * n
        for i, (s, t) in enumerate(zip(ends, tokens)):
            if self.length[s] == len(t):
                self.token[s] = i
        self.shorter = array("i", [_NONE]) * n
        for s in sorted(range(1, n), key=self.length.__getitem__):
            up = self.link[s]
            self.shorter[s] = up if up == _NONE or self.token[up] != _NONE else self.shorter[up]

    def _add(self, word: bytes) -> int:
        last, to, length, link = 0, self.to, self.length, self.link
        for byte in word:
            q = to.get(last << 8 | byte)
            if q is not None and length[q] == length[last] + 1:
                last = q
                continue
            if q is not None:
                last = self._clone(last, byte, q)
                continue
            new = len(length)
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p != _NONE and (p << 8 | byte) not in to:
                to[p << 8 | byte] = new
                p = link[p]
            if p != _NONE:
                q = to[p << 8 | byte]
                link[new] = q if length[q] == length[p] + 1 else self._clone(p, byte, q)
            last = new
        return last

    def _clone(self, p: int, byte: int, q: int) -> int:
        to, new = self.to, len(self.length)
        self.length.append(self.length[p] + 1)
        self.link.append(self.link[q])
        for b in range(256):
            if (t := to.get(q << 8 | b)) is not None:
                to[new << 8 | b] = t
        self.link[q] = new
        while p != _NONE and to.get(p << 8 | byte) == q:
            to[p << 8 | byte] = new
            p = self.link[p]
        return new


class PrefixEncoder:
    """Encodes pre-tokens of a vocabulary in which ids are merge ranks and the 256 bytes come first."""

    def __init__(self, tokens: list[bytes]):
        if len(tokens) > 1 << PAIR_BITS:
            raise ValueError(f"the vocabulary has {len(tokens)} tokens; pairs are kept for {1 << PAIR_BITS} at most")
        self.tokens = tokens
        self.automaton = SuffixAutomaton(tokens)
        ids = {t: i for i, t in enumerate(tokens)}
        self.merged: dict[int, int] = {}
        self.parts: list[tuple[int, int]] = []
        for i, t in enumerate(tokens):
            pair = (i, i)
            for cut in range(len(t) - 1, 0, -1):
                a, b = ids.get(t[:cut], i), ids.get(t[cut:], i)
                if a < i and b < i and self.may_follow(a, b):
                    pair = (a, b)
                    self.merged[a << PAIR_BITS | b] = i
                    break
            self.parts.append(pair)
        self.whole = ids

    def may_follow(self, a: int, b: int) -> bool:
        """Whether the text of token ``a`` followed by that of ``b`` encodes to exactly these two."""
        merged, parts = self.merged, self.parts
        bound = 1 << 2 * PAIR_BITS  # a merge across the seam wins if it has a lower rank than this
        while True:
            m = merged.get(a << PAIR_BITS | b)
            if m is not None and m < bound:
                return False
            if a > b:  # the merge that made the later token is undone first
                bound, right = a, parts[a][1]
                if right != a:
                    a = right
                    continue
                bound, left = b + 1, parts[b][0]
                if left == b:
                    return True
                b = left
            else:
                bound, left = b + 1, parts[b][0]
                if left != b:
                    b = left
                    continue
                bound, right = a, parts[a][1]
                if right == a:
                    return True
                a = right

    def encode(self, word: bytes) -> list[int]:
        one = self.whole.get(word)
        if one is not None:
            return [one]
        sa = self.automaton
        to, link, length, token, shorter = sa.to, sa.link, sa.length, sa.token, sa.shorter
        may = self.may_follow
        tokens = self.tokens
        last = array("i", [_NONE]) * (len(word) + 1)
        state, held = 0, 0
        for end, byte in enumerate(word, 1):
            while True:
                nxt = to.get(state << 8 | byte)
                if nxt is not None:
                    state, held = nxt, held + 1
                    break
                state = link[state]
                held = length[state]
            # The matched suffix may be shorter than the longest string of its state.
            s = state
            if held < length[s] or token[s] == _NONE:
                s = shorter[s]
            while s > 0:
                t = token[s]
                begin = end - length[s]
                if begin == 0 or (last[begin] != _NONE and may(last[begin], t)):
                    last[end] = t
                    break
                s = shorter[s]
        out: list[int] = []
        at = len(word)
        while at > 0:
            t = last[at]
            out.append(t)
            at -= len(tokens[t])
        out.reverse()
        return out


class _Memo(dict):
    """pre-token -> ids, bounded."""

    def __init__(self, encoder: PrefixEncoder):
        super().__init__()
        self.encoder = encoder

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = tuple(self.encoder.encode(piece.encode("utf-8", "surrogatepass")))
        if len(self) >= MEMO:
            self.clear()
        if len(piece) <= 64:
            self[piece] = ids
        return ids


class Tokenizer:
    def __init__(self, tokens: list[bytes], pattern: str):
        self.memo = _Memo(PrefixEncoder(tokens))
        self.find = regex.compile(pattern).findall

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a text without special tokens; none for an empty or null text."""
        if not text:
            return np.empty(0, np.int32)
        return np.fromiter(chain.from_iterable(map(self.memo.__getitem__, self.find(text))), np.int32)

    def count(self, text: str | None) -> int:
        return sum(map(len, map(self.memo.__getitem__, self.find(text)))) if text else 0


def vocabulary(path: str) -> list[bytes]:
    """Tokens of a rank file: one base64 token and its rank per line."""
    ranks: dict[int, bytes] = {}
    with open(path, "rb") as lines:
        for line in lines:
            if line.strip():
                token, rank = line.split()
                ranks[int(rank)] = base64.b64decode(token)
    return [ranks[i] for i in range(len(ranks))]


def _public(path: str | None, pattern: str | None) -> tuple[str, str]:
    """By default byte_bpe_50k of the public tokenizers, where they are installed on the driver."""
    if path is None or pattern is None:
        public = importlib.import_module("public_tokenizers")
        path = path or os.fspath(public.path("byte_bpe_50k.tiktoken"))
        pattern = pattern or public.PATTERN
    return path, pattern


@lru_cache(maxsize=2)
def load(path: str | None = None, pattern: str | None = None) -> Tokenizer:
    """The tokenizer of a rank file, built once per worker."""
    path, pattern = _public(path, pattern)
    return Tokenizer(vocabulary(path), pattern)


def shipped(spark: SparkSession, path: str | None, pattern: str | None) -> tuple[str, str]:
    """The name under which the workers find the driver's rank file, and the pattern; a file is sent once per application."""
    path, pattern = _public(path, pattern)
    sc = spark.sparkContext
    sent = sc.__dict__.setdefault("_tarnwick_files", {})
    if path not in sent:
        with open(path, "rb") as f:
            name = f"{hashlib.file_digest(f, 'sha256').hexdigest()[:16]}.ranks"
        copy = os.path.join(tempfile.mkdtemp(prefix="tarnwick-"), name)  # on the driver alone, which serves it
        shutil.copyfile(path, copy)
        sc.addFile(copy)
        sent[path] = name
    return sent[path], pattern


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    offsets = np.zeros(len(arrays) + 1, np.int32)
    np.cumsum([len(a) for a in arrays], out=offsets[1:])
    flat = np.concatenate(arrays) if arrays else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat, pa.int32()))


def _texts(column: pa.Array) -> Iterable[str | None]:
    return column.to_pylist()


def encode(df: DataFrame, text: str, *keep: str, vocab: str | None = None, pattern: str | None = None, out: str = "ids") -> DataFrame:
    """The ``keep`` columns and the token ids of ``text`` as ARRAY<INT>.

    Defined results: null and empty texts give an empty list; text that spells a
    special token is ordinary text; repeated rows are encoded each; other columns
    are not read.  The size of a text is bounded only by a worker's memory.
    """
    src = df.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("__ids", T.ArrayType(T.IntegerType()), False)])

    ranks, split = shipped(df.sparkSession, vocab, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(SparkFiles.get(ranks), split)
        for b in batches:
            ids = _lists([tok.encode(t) for t in _texts(b.column(b.num_columns - 1))])
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], ids], names=[*b.schema.names[:-1], "__ids"])

    done = src.mapInArrow(run, schema)
    return done.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__ids").alias(out))


def count_tokens(df: DataFrame, text: str, *keep: str, vocab: str | None = None, pattern: str | None = None, out: str = "n_tokens") -> DataFrame:
    """The ``keep`` columns and the number of tokens of ``text`` (0 for null and empty texts)."""
    src = df.select(*[F.col(f"`{c}`").alias(f"__k{i}") for i, c in enumerate(keep)], F.col(f"`{text}`").cast("string").alias("__text"))
    schema = T.StructType([*src.schema.fields[:-1], T.StructField("__n", T.LongType(), False)])

    ranks, split = shipped(df.sparkSession, vocab, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = load(SparkFiles.get(ranks), split)
        for b in batches:
            n = pa.array([tok.count(t) for t in _texts(b.column(b.num_columns - 1))], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], names=[*b.schema.names[:-1], "__n"])

    done = src.mapInArrow(run, schema)
    return done.select(*[F.col(f"__k{i}").alias(c) for i, c in enumerate(keep)], F.col("__n").alias(out))
