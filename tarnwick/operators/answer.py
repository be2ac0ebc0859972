"""Refusal, extractive answers, citations and grounding, for batches of queries."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions.embedding import Embedder, embed
from tarnwick.functions.text import citation_markers, sentences, squash, strip, strip_citations
from tarnwick.functions.vectors import cosine
from tarnwick.operators.ranking import DIGITS

# The words with which the engine declines, by which a declined answer is also known, and those of a refusal.
INSUFFICIENT = "I don't have enough information in the provided sources"
DECLINED = INSUFFICIENT + "."
REFUSED = INSUFFICIENT + " to answer that"
NO_SOURCES = "(no sources retrieved)"
PROMPT_VERSION = "t1"
#: What a model is told; own words.
RULES = f"""Answer from the numbered sources below and from nothing else.
- Give the number of its source behind every claim, as [1]; name each number if there are several.
- If the sources do not answer the question, write exactly: "{DECLINED}"
- Keep to three sentences unless the question needs more, and don't speak of sources or rules otherwise."""


def refusal(results: DataFrame, questions: DataFrame, min_confidence: float = 0.3, min_sources: int = 1) -> DataFrame:
    """qid, refused, reason, confidence, usable_sources, threshold_applied; one row per question.

    ``results``: qid, chunk_id, score, rerank_score (null: not calibrated).  Only a
    rerank score is a confidence; without any, sources are merely counted.
    """
    per = results.groupBy("qid").agg(
        F.count("chunk_id").alias("n"),
        F.max("rerank_score").alias("top_rerank"),
        F.max("score").alias("top"),
        F.count_if(F.col("rerank_score") >= min_confidence).alias("strong"),
    )
    n, rerank = F.coalesce("n", F.lit(0)), F.col("top_rerank")
    calibrated = rerank.isNotNull()
    usable = F.when(calibrated, F.col("strong")).otherwise(n).cast("long")
    confidence = F.when(n == 0, F.lit(0.0)).when(calibrated, rerank).otherwise(F.col("top"))
    reason = (
        F.when(n == 0, F.lit("no sources were retrieved"))
        .when(~calibrated & (n < min_sources), F.format_string("%d of %d required sources", n, F.lit(min_sources)))
        .when(~calibrated, F.lit(None).cast("string"))
        .when(rerank < min_confidence, F.format_string("top confidence %.3f below %.2f", rerank, F.lit(min_confidence)))
        .when(usable < min_sources, F.format_string("%d of %d required sources", usable, F.lit(min_sources)))
    )
    joined = questions.select("qid").distinct().join(per, "qid", "left")
    return joined.select("qid", reason.isNotNull().alias("refused"), reason.alias("reason"), F.round(confidence, DIGITS).alias("confidence"), usable.alias("usable_sources"), (calibrated & (n > 0)).alias("threshold_applied"))


def refusal_text(reason: Column) -> Column:
    return F.concat(F.lit(REFUSED), F.when(F.coalesce(reason, F.lit("")) != "", F.concat(F.lit(" ("), reason, F.lit(")"))).otherwise(F.lit("")), F.lit("."))


def number_sources(final: DataFrame) -> DataFrame:
    """Sources of each query, numbered from 1 in their final order."""
    return final.withColumn("source_no", F.col("final_rank"))


def source_label(section_path: Column, title: Column, doc_id: Column) -> Column:
    """Where a source is from: its section path, else its title, else its document."""
    path = F.when(F.size(section_path) > 0, F.array_join(section_path, " > "))
    return F.coalesce(F.nullif(path, F.lit("")), F.nullif(title, F.lit("")), doc_id.cast("string"))


def prompt(sources: DataFrame, questions: DataFrame | None = None) -> DataFrame:
    """qid, sources: numbered ``[i] (label) text`` blocks; ``sources`` has source_no, label, text.

    With ``questions`` (qid, question) also the whole prompt of each: rules, sources (or that there are none) and question.
    """
    line = F.concat(F.lit("["), F.col("source_no").cast("string"), F.lit("] ("), F.col("label"), F.lit(") "), strip(F.col("text")))
    lines = F.transform(F.array_sort(F.collect_list(F.struct("source_no", line.alias("line")))), lambda x: x["line"])
    shown = sources.groupBy("qid").agg(F.array_join(lines, "\n\n").alias("sources"))
    if questions is None:
        return shown
    both = questions.select("qid", "question").join(shown, "qid", "left").withColumn("sources", F.coalesce("sources", F.lit(NO_SOURCES)))
    whole = F.concat(F.lit(f"{RULES}\n\nSources:\n"), F.col("sources"), F.lit("\n\nQuestion: "), strip(F.coalesce("question", F.lit(""))), F.lit("\n\nAnswer:"))
    return both.select("qid", "sources", whole.alias("prompt"))


class Generator(Protocol):
    """A language model; ``complete`` runs in the Python workers and gives None where the model is unavailable."""

    name: str

    def complete(self, prompts: list[str]) -> list[str | None]: ...


def generated(prompts: DataFrame, model: Generator, batch: int = 16) -> DataFrame:
    """qid, answer of a model for each prompt; null where it failed."""

    @F.pandas_udf("string")
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for s in parts:
            texts, out = s.tolist(), []
            for i in range(0, len(texts), batch):
                try:
                    out += model.complete(texts[i : i + batch])
                except Exception:  # noqa: BLE001  an unavailable model leaves its answers to extraction
                    out += [None] * len(texts[i : i + batch])
            yield pd.Series(out, dtype=object)

    return prompts.select("qid", run("prompt").alias("answer"))


def source_sentences(sources: DataFrame, min_chars: int = 25) -> DataFrame:
    """qid, source_no, position, sentence of every sentence long enough; white space collapsed."""
    split = sources.select("qid", "source_no", F.posexplode(sentences(F.col("text"))).alias("position", "sentence"))
    return split.withColumn("sentence", squash(F.col("sentence"))).where(F.length("sentence") >= min_chars)


def extractive(sources: DataFrame, questions: DataFrame, take: int = 3, min_chars: int = 25, embedder: Embedder | None = None) -> DataFrame:
    """qid, answer: the ``take`` sentences most similar to the question, in source order, each with its citation."""
    asked = questions.select("qid", embed(F.col("question"), embedder).alias("__q"))
    vectors = source_sentences(sources, min_chars).withColumn("__s", embed(F.col("sentence"), embedder))
    scored = vectors.join(asked, "qid").withColumn("similarity", F.round(cosine(F.col("__q"), F.col("__s")), DIGITS)).drop("__q", "__s")
    order = Window.partitionBy("qid").orderBy(F.desc("similarity"), "source_no", "position")
    best = scored.withColumn("n", F.row_number().over(order)).where(F.col("n") <= take)
    cited = F.concat("sentence", F.lit(" ["), F.col("source_no").cast("string"), F.lit("]"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("source_no", "position", "sentence", cited.alias("cited")))), lambda x: x["cited"]), " ")
    made = best.groupBy("qid").agg(text.alias("answer"))
    return questions.select("qid").distinct().join(made, "qid", "left").select("qid", F.coalesce("answer", F.lit(DECLINED)).alias("answer"))


def generate_or_extract(generated: DataFrame, extracted: DataFrame) -> DataFrame:
    """A model's answer, or the extractive one where it is missing or blank."""
    both = extracted.join(generated.select("qid", F.col("answer").alias("__g")), "qid", "left")
    blank = strip(F.coalesce("__g", F.lit(""))) == ""
    return both.select("qid", F.when(blank, F.col("answer")).otherwise(F.col("__g")).alias("answer"), F.when(blank, F.lit("extractive")).otherwise(F.lit("generated")).alias("answer_type"))


def citations(answers: DataFrame, sources: DataFrame) -> DataFrame:
    """qid, marker, appearance, chunk_id, resolved: markers in order of first appearance; unknown ones stay unresolved."""
    marks = answers.select("qid", F.posexplode(citation_markers(F.col("answer"))).alias("appearance", "marker"))
    known = sources.select("qid", F.col("source_no").alias("marker"), "chunk_id")
    return marks.join(known, ["qid", "marker"], "left").withColumn("resolved", F.col("chunk_id").isNotNull())


def sentence_grounding(answers: DataFrame, sources: DataFrame, threshold: float = 0.55, embedder: Embedder | None = None) -> DataFrame:
    """qid, sent_no, sentence, max_similarity, supporting_chunk_id, grounded of every answer sentence.

    The first source wins ties.  Sentences of a query without sources have similarity 0.
    """
    split = answers.select("qid", F.posexplode(sentences(strip_citations(F.col("answer")))).alias("sent_no", "sentence"))
    said = split.withColumn("__a", embed(F.col("sentence"), embedder))
    given = sources.select("qid", "source_no", "chunk_id", embed(F.col("text"), embedder).alias("__s"))
    # An equi-join within the query; each pair is reduced at once.
    met = said.join(given, "qid", "left").withColumn("sim", F.coalesce(F.round(cosine(F.col("__a"), F.col("__s")), DIGITS), F.lit(0.0)))
    best = F.max_by(F.struct("chunk_id", "sim"), F.struct("sim", -F.col("source_no")))
    per = met.groupBy("qid", "sent_no", "sentence").agg(best.alias("b"))
    grounded = F.coalesce(F.col("b.sim") >= threshold, F.lit(False))
    return per.select("qid", "sent_no", "sentence", F.coalesce("b.sim", F.lit(0.0)).alias("max_similarity"), F.when(grounded, F.col("b.chunk_id")).alias("supporting_chunk_id"), grounded.alias("grounded"))


def grounding(answers: DataFrame, sources: DataFrame, threshold: float = 0.55, embedder: Embedder | None = None) -> DataFrame:
    """qid, grounded, n_sentences, n_flagged, n_unresolved, mean_similarity.

    An answer that says it lacks information is grounded, with no sentences; one
    without sentences is not.  Otherwise nothing may be flagged or unresolved.
    """
    declined = answers.select("qid", F.lower("answer").contains(INSUFFICIENT.lower()).alias("declined"))
    real = answers.join(declined.where("NOT declined"), "qid", "left_semi")
    per = sentence_grounding(real, sources, threshold, embedder).groupBy("qid").agg(F.count("*").alias("n"), F.count_if(~F.col("grounded")).alias("flagged"), F.avg("max_similarity").alias("mean"))
    loose = citations(real, sources).where("NOT resolved").groupBy("qid").agg(F.count("*").alias("loose"))
    n, flagged, open_ = (F.coalesce(c, F.lit(0)) for c in ("n", "flagged", "loose"))
    out = declined.join(per, "qid", "left").join(loose, "qid", "left")
    ok = F.col("declined") | ((n > 0) & (flagged == 0) & (open_ == 0))
    return out.select("qid", ok.alias("grounded"), n.alias("n_sentences"), flagged.alias("n_flagged"), open_.alias("n_unresolved"), F.round(F.coalesce("mean", F.lit(0.0)), DIGITS).alias("mean_similarity"))
