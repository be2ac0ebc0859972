"""Schemas of the engine's tables."""

from __future__ import annotations

from pyspark.sql import types as T

_S, _I, _L, _D, _B, _TS = T.StringType(), T.IntegerType(), T.LongType(), T.DoubleType(), T.BooleanType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in fields.items()])


PAGE_SPAN = _struct(page_number=_I, start_char=_I, end_char=_I, label=_S)
METADATA = T.MapType(_S, _S)
DOCUMENT = _struct(doc_id=_S, source_path=_S, text=_S, content_hash=_S, media_type=_S, metadata=METADATA, page_spans=T.ArrayType(PAGE_SPAN), error=_S)
CHUNK = _struct(chunk_id=_S, doc_id=_S, text=_S, start_char=_I, end_char=_I, token_count=_I, section_path=T.ArrayType(_S), page_number=_I, strategy=_S)
EMBEDDED_CHUNK = T.StructType([*CHUNK.fields, T.StructField("embedding", T.ArrayType(T.FloatType()))])
COLLECTION = _struct(name=_S, embedder=_S, dimension=_I, created_at=_TS)
GOLDEN = _struct(qid=_S, question=_S, relevant_doc_ids=T.ArrayType(_S), relevant_chunk_texts=T.ArrayType(_S), answer=_S, category=_S, difficulty=_S)
SEARCH_HIT = _struct(qid=_S, retriever=_S, chunk_id=_S, score=_D)
