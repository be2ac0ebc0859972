"""Which of a stated set of strings occur in a corpus: one pass over the texts per block of strings."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from tarnwick.operators.ranking import query_blocks

try:
    import ahocorasick
except ImportError:  # plain search works everywhere
    ahocorasick = None

#: Strings that a worker looks for at once.
STRINGS = 4096


def occurring(texts: DataFrame, text: str, wanted: DataFrame, key: str, string: str) -> DataFrame:
    """Distinct ``key`` (as text) of the non-empty ``string``s of ``wanted`` that some text contains, character for character."""
    spark = texts.sparkSession
    out = spark.createDataFrame([], "key string")
    for keys, strings in query_blocks(wanted.where(f"length({string}) > 0"), key, string, STRINGS):
        shared = spark.sparkContext.broadcast((keys, strings))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            keys, strings = shared.value
            by: dict[str, list[str]] = {}
            for k, s in zip(keys, strings):
                by.setdefault(s, []).append(k)
            machine = None
            if ahocorasick is not None:
                machine = ahocorasick.Automaton()
                for s in by:
                    machine.add_word(s, s)
                machine.make_automaton()
            found: set[str] = set()
            for b in batches:
                for t in b.column(0).to_pylist():
                    if t:
                        found.update((s for _, s in machine.iter(t)) if machine is not None else (s for s in by if s in t))
            yield pa.RecordBatch.from_arrays([pa.array([k for s in found for k in by[s]], pa.string())], names=["key"])

        out = out.unionByName(texts.select(text).mapInArrow(run, "key string"))
    return out.distinct()
