"""Draft questions for a golden set: a model proposes, and what it quotes must be there word for word."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwick.functions.text import strip
from tarnwick.operators.answer import Generator, generated

# The marks of the lines of a reply, and the length of a span.
QUESTION, SPAN, SPAN_CHARS = "Q:", "S:", 300
LEAST_CHARS = 400


def drafts(chunks: DataFrame, documents: DataFrame, model: Generator, least: int = LEAST_CHARS) -> DataFrame:
    """Golden entries to be reviewed, at most one per document: from one of its chunks above ``least`` characters, chosen by hash.

    A reply without a question or a quotation, or with one that the document does not hold word for word, gives none.
    """
    usable = chunks.where(F.length("text") > least)
    chosen = usable.groupBy("doc_id").agg(F.min_by("text", F.xxhash64("chunk_id")).alias("text"))
    ask = f"Write one question that the passage answers, after '{QUESTION}', and on the next line the sentence of it that answers, word for word, after '{SPAN}'.\n\nPassage:\n"
    replies = generated(chosen.select(F.col("doc_id").alias("qid"), F.concat(F.lit(ask), "text").alias("prompt")), model)

    def last(mark: str) -> Column:
        lines = F.filter(F.split("answer", r"\r?\n"), lambda x: x.startswith(mark))
        return strip(F.substring(F.try_element_at(lines, F.lit(-1)), F.lit(len(mark) + 1), F.length("answer")))

    found = replies.where("answer IS NOT NULL").select(F.col("qid").alias("doc_id"), F.when(F.col("answer").contains(QUESTION), last(QUESTION)).alias("question"), F.when(F.col("answer").contains(SPAN), last(SPAN)).alias("span"))
    real = found.where("question != '' AND span != ''").join(documents.select("doc_id", F.col("text").alias("__text")), "doc_id").where(F.col("__text").contains(F.col("span")))
    return real.select(
        F.concat(F.lit("draft-"), F.col("doc_id").cast("string")).alias("qid"), "question", F.array("doc_id").alias("relevant_doc_ids"), F.array(F.substring("span", 1, SPAN_CHARS)).alias("relevant_chunk_texts"),
        F.lit("").alias("answer"), F.lit("factual").alias("category"), F.lit("medium").alias("difficulty"),
    )
