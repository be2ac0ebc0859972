"""The query path as one plan: {dense, lexical} -> fuse -> rerank -> refuse or answer -> ground."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import asdict, replace
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwick.config import ConfigError, RetrievalConfig, Settings
from tarnwick.functions.embedding import Embedder, HashEmbedder, embed
from tarnwick.functions.text import title as stated_title
from tarnwick.operators import answer, bm25, dense, fusion, ranking
from tarnwick.operators.filters import filter_chunks
from tarnwick.operators.rerank import PairScorer, pair_scores, rerank, shortlist
from tarnwick.runtime import stage, unstage


def candidates(
    chunks: DataFrame, questions: DataFrame, config: RetrievalConfig, model: Embedder | None = None, paraphrases: DataFrame | None = None, passages: DataFrame | None = None,
    index: bm25.Index | None = None, filters: Mapping[str, str] | None = None, documents: DataFrame | None = None, lists: Mapping[str, str] | None = None,
) -> tuple[DataFrame, int]:
    """Candidate lists of every question, and how many lists there are per question.

    ``chunks``: chunk_id, text and, if stored, embedding.  ``paraphrases`` (qid, variant,
    question) adds a list per variant and retriever; ``passages`` (qid, passage) adds one
    dense list of an embedded hypothetical answer.  Where an expansion is asked for but not
    given, as when no model is there to make it, the questions are searched as they are.
    ``index``: the stored lexical index of these chunks.  ``filters`` restricts all lists to
    chunks whose metadata, or their document's, match; ``lists`` are separators of keys with several values.
    """
    model, separators = model or HashEmbedder(), lists
    if config.use_lexical and index is None:
        index = bm25.ensure(chunks)
    if filters:
        chunks = stage(filter_chunks(chunks, documents, filters, separators).drop("metadata"))
        if index is not None:
            index = index._replace(docs=index.docs.join(chunks.select("chunk_id"), "chunk_id", "left_semi"))
    if config.use_dense and "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", embed(F.col("text"), model))
    made: dict[str, DataFrame] = {}
    variants = [("", questions)]
    if config.expansion == "multi_query" and paraphrases is not None:
        known = paraphrases.join(questions.select("qid", F.lower("question").alias("__q")), "qid").where(F.lower("question") != F.col("__q"))
        variants += [(f"_{i}", known.where(F.col("variant") == i).select("qid", "question")) for i in range(1, config.num_paraphrases + 1)]
    for tag, asked in variants:
        if config.use_dense:
            vectors = asked.select("qid", embed(F.concat(F.lit(model.query_prefix), F.col("question")), model).alias("embedding"))
            made[f"dense{tag}"] = dense.top_k(chunks, vectors, config.top_k_dense, model.dimension)
    if config.use_dense and config.expansion == "hyde" and passages is not None:
        made["dense_hyde"] = dense.top_k(chunks, passages.select("qid", embed(F.col("passage"), model).alias("embedding")), config.top_k_dense, model.dimension)
    for tag, asked in variants:
        if config.use_lexical:
            made[f"lexical{tag}"] = bm25.top_k(index, asked, config.top_k_lexical)
    return fusion.union_lists(**made), len(made)


class Retrieved(NamedTuple):
    """Results, and what led to them."""

    results: DataFrame  #: qid, chunk_id, text, score, the evidence of every stage, final_rank
    counts: DataFrame  #: qid, stage, n


def retrieve(
    chunks: DataFrame, questions: DataFrame, config: RetrievalConfig | None = None, model: Embedder | None = None, scorer: PairScorer | None = None, cache: DataFrame | None = None,
    paraphrases: DataFrame | None = None, passages: DataFrame | None = None, index: bm25.Index | None = None, filters: Mapping[str, str] | None = None, documents: DataFrame | None = None, lists: Mapping[str, str] | None = None,
) -> DataFrame:
    """qid, chunk_id, text, score, the evidence of every stage, final_rank."""
    return traced(chunks, questions, config, model, scorer, cache, paraphrases, passages, index, filters, documents, lists).results


def traced(
    chunks: DataFrame, questions: DataFrame, config: RetrievalConfig | None = None, model: Embedder | None = None, scorer: PairScorer | None = None, cache: DataFrame | None = None,
    paraphrases: DataFrame | None = None, passages: DataFrame | None = None, index: bm25.Index | None = None, filters: Mapping[str, str] | None = None, documents: DataFrame | None = None, lists: Mapping[str, str] | None = None,
) -> Retrieved:
    """The same with the number of candidates of each stage."""
    config = config or RetrievalConfig()
    found, n = candidates(chunks, questions, config, model, paraphrases, passages, index, filters, documents, lists)
    found = stage(found)
    results = ranked(found, n, chunks, questions, config, scorer, cache)
    fused = found.select("qid", "chunk_id").distinct()
    return Retrieved(results, fusion.candidate_counts(found.withColumn("retriever", F.split("retriever", "_")[0]), fused, results if config.use_rerank else None))


def ranked(lists: DataFrame, n: int, chunks: DataFrame, questions: DataFrame, config: RetrievalConfig, scorer: PairScorer | None = None, cache: DataFrame | None = None) -> DataFrame:
    fused = fusion.fuse(lists, n, config.fusion, config.rrf_k, config.dense_weight)
    text = chunks.select("chunk_id", "text")
    if not config.use_rerank:
        return fused.where(F.col("fused_rank") <= config.final_top_k).join(text, "chunk_id").withColumns({"rerank_score": F.lit(None).cast("double"), "final_rank": F.col("fused_rank")})
    short = shortlist(fused, config.rerank_candidates).join(text, "chunk_id").join(questions.select("qid", "question"), "qid")
    return rerank(short, config.final_top_k, scorer, cache).drop("question").withColumn("score", F.col("rerank_score"))


def source_refs(results: DataFrame, chunks: DataFrame, documents: DataFrame | None = None) -> DataFrame:
    """Numbered sources: qid, source_no, chunk_id, doc_id, title, label, source_path, section_path, page_number, text, score.

    ``chunks`` has doc_id and may have section_path and page_number; ``documents`` has metadata and source_path.
    """
    have = set(chunks.columns)
    path = F.col("section_path") if "section_path" in have else F.array().cast("array<string>")
    page = F.col("page_number") if "page_number" in have else F.lit(None).cast("int")
    owners = chunks.select("chunk_id", "doc_id", path.alias("section_path"), page.alias("page_number"))
    met = answer.number_sources(results).select("qid", "source_no", "chunk_id", "text", "score").join(owners, "chunk_id")
    if documents is None:
        met = met.withColumns({"title": F.lit(None).cast("string"), "source_path": F.lit(None).cast("string")})
    else:
        met = met.join(documents.select("doc_id", stated_title(F.col("metadata"), F.col("source_path")).alias("title"), "source_path"), "doc_id", "left")
    name = F.col("doc_id").cast("string")
    return met.withColumns({"label": answer.source_label(F.col("section_path"), F.col("title"), F.col("doc_id")), "title": F.coalesce(F.nullif("title", F.lit("")), name), "source_path": F.coalesce("source_path", name)})


def respond(results: DataFrame, questions: DataFrame, settings: Settings | None = None, model: Embedder | None = None, sources: DataFrame | None = None, generator: answer.Generator | None = None) -> DataFrame:
    """qid, refused, answer, answer_type, grounded, confidence, citations, sources: one row per question.

    Refused questions are not answered: they have no citations, keep their sources and count as
    grounded.  Others get the model's answer, or an extractive one where there is no model, or it
    failed or said nothing.  ``sources``: those of :func:`source_refs`, else the results themselves.
    """
    s = settings or Settings()
    decision = stage(answer.refusal(results, questions, s.min_confidence, s.min_sources))
    if sources is None:
        sources = answer.number_sources(results).select("qid", "source_no", "chunk_id", "text", "score", F.col("chunk_id").alias("label"))
    sources = stage(sources)
    open_ = questions.select("qid", "question").join(decision.where("NOT refused"), "qid", "left_semi")
    given = sources.join(decision.where("NOT refused").select("qid"), "qid", "left_semi")
    said = answer.extractive(given, open_, s.extractive_sentences, s.min_sentence_chars, model).withColumn("answer_type", F.lit("extractive"))
    if generator is not None:
        said = answer.generate_or_extract(answer.generated(answer.prompt(given, open_), generator), said.drop("answer_type"))
    said = stage(said)
    checked = answer.grounding(said, given, s.grounding_threshold, model)
    cited = answer.citations(said, given).groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("appearance", "marker", "chunk_id", "resolved"))).alias("citations"))
    shown = sources.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("source_no", "chunk_id", "label", "score"))).alias("sources"))
    both = decision.join(said, "qid", "left").join(checked.select("qid", "grounded", "mean_similarity"), "qid", "left").join(cited, "qid", "left").join(shown, "qid", "left")
    refused = F.col("refused")
    return both.select(
        "qid", "refused", F.when(refused, answer.refusal_text(F.col("reason"))).otherwise(F.col("answer")).alias("answer"), F.when(refused, F.lit("refused")).otherwise(F.col("answer_type")).alias("answer_type"),
        F.coalesce("grounded", F.lit(True)).alias("grounded"), F.coalesce("mean_similarity", F.lit(0.0)).alias("mean_similarity"), "confidence", "threshold_applied",
        F.coalesce("citations", F.array().cast(cited.schema["citations"].dataType)).alias("citations"), F.coalesce("sources", F.array().cast(shown.schema["sources"].dataType)).alias("sources"),
    )


def debug_trail(found: Retrieved, config: RetrievalConfig, paraphrases: DataFrame | None = None) -> DataFrame:
    """qid, config, expanded_queries, candidate_counts and the evidence and movement of every result."""
    cols = [c for c in ("final_rank", "chunk_id", "dense_score", "dense_rank", "lexical_score", "lexical_rank", "fused_rank", "rerank_score", "rank_movement") if c in found.results.columns]
    trail = found.results.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct(*cols))).alias("stages"))
    counts = found.counts.groupBy("qid").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("stage", "n")))).alias("candidate_counts"))
    out = counts.join(trail, "qid", "left")
    if paraphrases is None:
        out = out.withColumn("expanded_queries", F.array().cast("array<string>"))
    else:
        asked = paraphrases.groupBy("qid").agg(F.transform(F.array_sort(F.collect_list(F.struct("variant", "question"))), lambda x: x["question"]).alias("expanded_queries"))
        out = out.join(asked, "qid", "left").withColumn("expanded_queries", F.coalesce("expanded_queries", F.array().cast("array<string>")))
    settings = F.create_map(*[F.lit(str(x)) for item in sorted(asdict(config).items()) for x in item])
    return out.withColumn("config", settings)


def ablate(chunks: Mapping[str, DataFrame] | DataFrame, questions: DataFrame, configs: list[RetrievalConfig], model: Embedder | None = None) -> DataFrame:
    """Final results of every configuration, labelled ``config``.

    ``chunks``: by chunk strategy, stored; or one table for all.  Those that need a language model
    are skipped.  Dense and lexical lists are made once per strategy and depth, and shared; so is the index.
    A pair of question and chunk is scored once, and texts meet the final results alone.
    """
    final, lists = None, {}
    for c in configs:
        if c.expansion != "none":
            continue
        if not isinstance(chunks, DataFrame) and c.chunk_strategy not in chunks:
            raise ConfigError(f"no chunks by {c.chunk_strategy}")
        lists.setdefault("" if isinstance(chunks, DataFrame) else c.chunk_strategy, {}).setdefault((c.top_k_dense, c.top_k_lexical), []).append(c)
    if not lists:
        raise ConfigError("no configuration can run without a language model")
    for strategy, depths in lists.items():
        own = chunks if isinstance(chunks, DataFrame) else chunks[strategy]
        index = bm25.ensure(own)
        vectors = own if "embedding" in own.columns else stage(own.select("chunk_id", embed(F.col("text"), model or HashEmbedder()).alias("embedding")))  # once for all blocks
        short = None
        for same in depths.values():
            both, _ = candidates(vectors, questions, replace(same[0], use_dense=True, use_lexical=True), model, index=index)
            both = stage(both)
            for c in same:
                names = [n for n, on in (("dense", c.use_dense), ("lexical", c.use_lexical)) if on]
                fused = fusion.fuse(both.where(F.col("retriever").isin(*names)), len(names), c.fusion, c.rrf_k, c.dense_weight)
                cut = fused.where(F.col("fused_rank") <= (c.rerank_candidates if c.use_rerank else c.final_top_k))
                one = cut.select(F.lit(c.label).alias("config"), F.lit(c.use_rerank).alias("again"), F.lit(c.final_top_k).alias("k"), "qid", "chunk_id", "score", "fused_rank")
                short = one if short is None else short.unionByName(one)
        short = stage(short)
        if vectors is not own:
            unstage(vectors)
        scores = pair_scores(short.where("again").select("qid", "chunk_id").distinct(), questions, own)
        again = ranking.rank(short.where("again").join(scores, ["qid", "chunk_id"]), "rerank_score", "final_rank", "config", "qid").withColumn("score", F.col("rerank_score"))
        plain = short.where("NOT again").withColumns({"rerank_score": F.lit(None).cast("double"), "final_rank": F.col("fused_rank")})
        kept = again.unionByName(plain).where("final_rank <= k").join(own.select("chunk_id", "text"), "chunk_id")
        kept = kept.select("config", "qid", "chunk_id", "text", "score", "rerank_score", "final_rank")
        final = kept if final is None else final.unionByName(kept)
    return final
