"""Named queries over the test tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwick.config import RetrievalConfig, Settings
from tarnwick.functions import ids, text
from tarnwick.functions.embedding import HashEmbedder, embed
from tarnwick.operators import ann, answer, bm25, chunking, dense, evaluate, filters, fusion, rerank, store
from tarnwick.plans import retrieval
from tarnwick.plans.sql import SQL
from tarnwick.runtime import once, shared_dir, stage
from tarnwick.sources import files
from tarnwick.streaming import events as streams

Query = Callable[[SparkSession, str], DataFrame]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each once, as last written; made once per application for the same files."""
    def make() -> DataFrame:
        chunks = table(spark, d, "chunks").where("chunk_id IS NOT NULL")
        wanted = ["ingested_at", "doc_id", "collection", "text", "start_char", "token_count", "section_path", "page_number"]
        return evaluate.one_row(chunks.select("chunk_id", *wanted), "chunk_id", *wanted).drop("ingested_at")

    return once(spark, "corpus", [f"{d}/chunks.parquet"], make)


def lexical(spark: SparkSession, d: str) -> bm25.Index:
    """The lexical index of the corpus; it goes with the application."""
    return bm25.ensure(corpus(spark, d), f"{shared_dir(spark)}/tarnwick/{spark.sparkContext.applicationId}/bm25")


def golden(spark: SparkSession, d: str) -> DataFrame:
    return once(spark, "golden", [f"{d}/golden_set.parquet"], lambda: evaluate.golden_once(table(spark, d, "golden_set")))


def flagship(spark: SparkSession, d: str) -> DataFrame:
    return hybrid(spark, d)


def bm25_stats(spark: SparkSession, d: str) -> DataFrame:
    return lexical(spark, d).weights.select("term", "df", F.round("idf", 9).alias("idf"))


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return bm25.top_k(lexical(spark, d), golden(spark, d), 10)


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    rows = table(spark, d, "embeddings").select(F.col("vec_id").cast("string").alias("chunk_id"), "embedding", "label")
    return rows, rows.where(F.pmod(F.col("chunk_id").cast("long"), F.lit(100)) == 0).select(F.col("chunk_id").alias("qid"), "embedding")


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return dense.top_k(rows, asked, 10, 64)


def dense_filtered(spark: SparkSession, d: str) -> DataFrame:
    rows, asked = _vectors(spark, d)
    return dense.top_k(rows.where("label = 3"), asked, 10, 64)


def ann_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten nearest of the stated queries by the approximate index: a quarter of its lists are probed."""
    rows, asked = _vectors(spark, d)
    index = ann.build(rows, 64, lists=16)
    return ann.search(index, asked, 10, 4)


def metadata_filter(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("chunk_id", "doc_id", "metadata")
    wanted = {"title": "Notes on the seasonal passage"}
    return filters.filter_chunks(chunks, table(spark, d, "documents"), wanted).select("chunk_id", "doc_id").distinct()


AUTHOR = "Vewo"


def list_filter(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of which, or of whose document, one of the authors is the wanted one."""
    chunks = table(spark, d, "chunks").select("chunk_id", "doc_id", "metadata")
    return filters.filter_chunks(chunks, table(spark, d, "documents"), {"authors": AUTHOR}, {"authors": "; "}).select("chunk_id", "doc_id").distinct()


def document_filter(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where(filters.matches(F.col("metadata"), {"authors": AUTHOR}, lists={"authors": "; "}))
    return filters.page(store.listing(docs, corpus(spark, d)), "doc_id", 50)


def hybrid_filtered(spark: SparkSession, d: str) -> DataFrame:
    """Both retrievers search only the chunks with a stated publication date, in them or in their document."""
    config = RetrievalConfig(use_rerank=False, final_top_k=10)
    dates = table(spark, d, "documents").select(F.max(F.element_at("metadata", "published"))).first()[0]
    own = evaluate.one_row(table(spark, d, "chunks").where("chunk_id IS NOT NULL").select("chunk_id", "ingested_at", F.to_json("metadata").alias("m")), "chunk_id", "ingested_at")
    chunks = corpus(spark, d).join(own.select("chunk_id", F.from_json("m", "map<string,string>").alias("metadata")), "chunk_id")
    found = retrieval.retrieve(chunks, golden(spark, d), config, index=lexical(spark, d), filters={"published": dates}, documents=table(spark, d, "documents"))
    return found.select("qid", "chunk_id", "score", "fused_rank", "dense_rank", "lexical_rank")


def hash_embed(spark: SparkSession, d: str) -> DataFrame:
    vectors = corpus(spark, d).select("chunk_id", embed(F.col("text"), HashEmbedder()).alias("v"))
    return vectors.select("chunk_id", F.posexplode("v").alias("bucket", "weight")).where("weight > 0").withColumn("weight", F.round("weight", 9))


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return fusion.distinct_hits(table(spark, d, "search_hits"))


def _pair(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    """Dense and lexical hits, of the asked queries alone where they are given: others are left out before any ranking."""
    hits = table(spark, d, "search_hits").where(F.col("retriever").isin("dense", "lexical"))
    return fusion.distinct_hits(hits if asked is None else hits.join(asked.select("qid"), "qid", "left_semi"))


def rrf(spark: SparkSession, d: str) -> DataFrame:
    return fusion.rrf(_pair(spark, d)).select("qid", "chunk_id", "score", "fused_rank", "dense_rank", "lexical_rank")


def weighted_fusion(spark: SparkSession, d: str) -> DataFrame:
    return fusion.fuse(_pair(spark, d), 2, "weighted", dense_weight=0.7).select("qid", "chunk_id", F.round("score", 6).alias("score"))


def candidate_counts(spark: SparkSession, d: str) -> DataFrame:
    pair = _pair(spark, d)
    return fusion.candidate_counts(pair, fusion.rrf(pair))


def hybrid(spark: SparkSession, d: str) -> DataFrame:
    config = RetrievalConfig(use_rerank=False, final_top_k=10)
    found = retrieval.retrieve(corpus(spark, d), golden(spark, d), config, index=lexical(spark, d))
    return found.select("qid", "chunk_id", "score", "fused_rank", "dense_rank", "lexical_rank")


def debug_trail(spark: SparkSession, d: str) -> DataFrame:
    """What led to the results of the golden questions: candidates of every stage, and evidence and movement of each result."""
    config = RetrievalConfig()
    found = retrieval.traced(corpus(spark, d), golden(spark, d), config, index=lexical(spark, d))
    trail = retrieval.debug_trail(found, config)
    return trail.select("qid", *[F.coalesce(F.element_at("candidate_counts", c), F.lit(0)).alias(f"n_{c}") for c in ("dense", "lexical", "fused", "reranked")],
                        F.transform("stages", lambda x: F.format_string("%s:%d", x["chunk_id"], x["rank_movement"])).alias("results"))


def _asked(spark: SparkSession, d: str) -> DataFrame:
    """Every logged query with its text; the golden question where none was logged, and no words where there is neither."""
    logged = table(spark, d, "retrieval_results").where("qid IS NOT NULL").groupBy("qid").agg(F.max("query").alias("query"))
    known = logged.join(golden(spark, d).select("qid", "question"), "qid", "full")
    known = known.join(table(spark, d, "search_hits").where("qid IS NOT NULL AND retriever IN ('dense', 'lexical') AND chunk_id IS NOT NULL AND score IS NOT NULL AND NOT isnan(score)").select("qid").distinct(), "qid", "full")
    return known.select("qid", F.coalesce("query", "question", F.lit("")).alias("question"))


def _reranked(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    """Of the golden questions, or of those asked."""
    asked = (golden(spark, d) if asked is None else asked).select("qid", "question")
    short = rerank.shortlist(fusion.rrf(_pair(spark, d, asked)), 20)
    return rerank.rerank(short.join(asked, "qid").join(corpus(spark, d).select("chunk_id", "text"), "chunk_id"), 5)


def rerank_overlap(spark: SparkSession, d: str) -> DataFrame:
    return _reranked(spark, d).select("qid", "chunk_id", "fused_rank", "rerank_score", "final_rank", "rank_movement")


def rerank_all(spark: SparkSession, d: str) -> DataFrame:
    """rerank_overlap over every query of the hits, not only those of the golden set."""
    return _reranked(spark, d, _asked(spark, d)).select("qid", "chunk_id", "fused_rank", "rerank_score", "final_rank", "rank_movement")


def refusal(spark: SparkSession, d: str, asked: DataFrame | None = None) -> DataFrame:
    hits = table(spark, d, "search_hits")
    hits = fusion.distinct_hits(hits if asked is None else hits.join(asked.select("qid"), "qid", "left_semi"))
    hits = hits.withColumn("rerank_score", F.when(F.col("retriever") == "rerank", F.col("score")))
    per = hits.groupBy("qid", "chunk_id").agg(F.max("score").alias("score"), F.max("rerank_score").alias("rerank_score"))
    logged = table(spark, d, "retrieval_results")
    return answer.refusal(per, logged if asked is None else logged.join(asked.select("qid"), "qid", "left_semi"))


def _flags(spark: SparkSession, d: str) -> DataFrame:
    asked = golden(spark, d)
    results = fusion.rrf(_pair(spark, d, asked)).where("fused_rank <= 5").select("qid", "chunk_id", F.col("fused_rank").alias("rank"))
    return evaluate.relevance(results.join(corpus(spark, d).select("chunk_id", "text"), "chunk_id"), asked)


def relevance(spark: SparkSession, d: str) -> DataFrame:
    return _flags(spark, d)


def retrieval_metrics(spark: SparkSession, d: str) -> DataFrame:
    totals = evaluate.relevant_total(corpus(spark, d), golden(spark, d))
    return evaluate.retrieval_metrics(_flags(spark, d), totals, 5)


def breakdowns(spark: SparkSession, d: str) -> DataFrame:
    asked = golden(spark, d).select("qid", "category", "difficulty")
    refused = refusal(spark, d, asked).select("qid", "refused")
    rows = retrieval_metrics(spark, d).join(asked, "qid").join(refused, "qid", "left").withColumn("refused", F.coalesce("refused", F.lit(True)))
    return evaluate.breakdowns(rows)


def latency_percentiles(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.latency(table(spark, d, "retrieval_results"), "total_ms", "run_id")


def latency_stages(spark: SparkSession, d: str) -> DataFrame:
    """Every stage; the log has the time of the whole alone, so the others have zeros."""
    return evaluate.stage_latency(table(spark, d, "retrieval_results"))


def golden_counts(spark: SparkSession, d: str) -> DataFrame:
    return golden(spark, d).groupBy("category", "difficulty").agg(F.count("*").alias("n"))


def golden_validate(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.validate_golden(table(spark, d, "golden_set"), table(spark, d, "documents"))


def sentences(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", F.posexplode(text.sentences(F.col("text"))).alias("sent_no", "sentence"))


def _sources(spark: SparkSession, d: str) -> DataFrame:
    """Numbered sources of the golden questions; written once, as plans read them more than once."""
    return stage(answer.number_sources(_reranked(spark, d)).select("qid", "source_no", "chunk_id", "text"))


def extractive(spark: SparkSession, d: str) -> DataFrame:
    return answer.extractive(_sources(spark, d), golden(spark, d))


def _all_reranked(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The results of every query and the queries; written once, as the plans above read them many times."""
    asked = stage(_asked(spark, d))
    return stage(_reranked(spark, d, asked)), asked


def extractive_all(spark: SparkSession, d: str) -> DataFrame:
    """extractive over every query, not only those of the golden set."""
    found, asked = _all_reranked(spark, d)
    return answer.extractive(answer.number_sources(found), asked)


def _golden_answers(spark: SparkSession, d: str) -> DataFrame:
    """Golden answers with citations after each sentence: of its number, of one more, and of the first again."""
    cited = lambda s, i: F.concat(s, F.format_string(" [%d] [%d] [1]", i + 1, i * 7 + 2))
    said = F.array_join(F.transform(text.sentences(F.col("answer")), cited), " ")
    return golden(spark, d).where("answer != ''").select("qid", said.alias("answer"))


def citations(spark: SparkSession, d: str) -> DataFrame:
    return answer.citations(_golden_answers(spark, d), _sources(spark, d))


def sentence_grounding(spark: SparkSession, d: str) -> DataFrame:
    return answer.sentence_grounding(_golden_answers(spark, d), _sources(spark, d))


def grounding(spark: SparkSession, d: str) -> DataFrame:
    return answer.grounding(_golden_answers(spark, d), _sources(spark, d))


def answers(spark: SparkSession, d: str) -> DataFrame:
    """Every query, answered or refused; one without a known text has no words, scores 0 and is refused."""
    found, asked = _all_reranked(spark, d)
    said = retrieval.respond(found.withColumn("score", F.col("rerank_score")), asked)
    cited = F.transform("citations", lambda x: F.concat(x["marker"].cast("string"), F.lit(":"), F.coalesce(x["chunk_id"], F.lit("?"))))
    return said.withColumns({"citations": cited, "sources": F.transform("sources", lambda x: x["chunk_id"])})


def _prompts(spark: SparkSession, d: str, found: DataFrame, asked: DataFrame) -> DataFrame:
    sources = retrieval.source_refs(found.withColumn("score", F.col("rerank_score")), corpus(spark, d), table(spark, d, "documents"))
    return answer.prompt(sources, asked)


def prompts(spark: SparkSession, d: str) -> DataFrame:
    """Whole prompts of the golden questions: rules, numbered sources by section or title, question."""
    return _prompts(spark, d, _reranked(spark, d), golden(spark, d)).select("qid", "sources", F.col("prompt").startswith(answer.RULES).alias("rules"), F.expr("substring(prompt, instr(prompt, sources) + length(sources))").alias("rest"))


def prompts_all(spark: SparkSession, d: str) -> DataFrame:
    """prompts over every query, not only those of the golden set."""
    found, asked = _all_reranked(spark, d)
    return _prompts(spark, d, found, asked).select("qid", "sources")


def _cited(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Sources of the golden questions, extractive answers over them, and which sources are relevant."""
    sources, asked = _sources(spark, d), golden(spark, d)
    flags = evaluate.relevance(sources.withColumn("rank", F.col("source_no")), asked)
    return sources, answer.extractive(sources, asked), flags


def citation_precision(spark: SparkSession, d: str) -> DataFrame:
    sources, said, flags = _cited(spark, d)
    return evaluate.citation_precision(answer.citations(said, sources), flags, golden(spark, d))


def evaluation(spark: SparkSession, d: str) -> DataFrame:
    """The means of a run: the golden questions answered from their reranked results."""
    asked = golden(spark, d)
    sources, _, flags = _cited(spark, d)
    results = sources.join(_reranked(spark, d).select("qid", "chunk_id", "rerank_score", F.col("final_rank")), ["qid", "chunk_id"]).withColumn("score", F.col("rerank_score"))
    said = stage(retrieval.respond(results, asked))
    flags = stage(flags)
    answered = said.where("NOT refused")
    rows = evaluate.retrieval_metrics(flags, evaluate.relevant_total(corpus(spark, d), asked), 5)
    rows = rows.join(said.select("qid", "refused", "grounded"), "qid").join(asked.select("qid", "category"), "qid")
    rows = rows.join(evaluate.citation_precision(answer.citations(answered, sources), flags, asked), "qid").join(evaluate.answer_similarity(answered, asked), "qid", "left")
    return evaluate.run_metrics(rows)


#: The evaluation matrix without the two rows that need a language model, and weighted fusion without reranking.
ABLATION = [
    RetrievalConfig(use_lexical=False, use_rerank=False), RetrievalConfig(use_dense=False, use_rerank=False), RetrievalConfig(use_rerank=False), RetrievalConfig(),
    RetrievalConfig(fusion="weighted"), RetrievalConfig(chunk_strategy="fixed_token"), RetrievalConfig(chunk_strategy="semantic"), RetrievalConfig(fusion="weighted", use_rerank=False),
]


def _ablated(spark: SparkSession, d: str) -> tuple[DataFrame, dict[str, DataFrame], DataFrame]:
    """Hits of every configuration over the golden questions, the documents' chunks by strategy, and the questions."""
    docs, asked = table(spark, d, "documents").select("doc_id", "text"), stage(golden(spark, d))
    chunks = {s: stage(chunking.chunker(s, embedder=HashEmbedder())(docs).select("chunk_id", F.col("doc_id").cast("long").alias("doc_id"), "text")) for s in dict.fromkeys(c.chunk_strategy for c in ABLATION)}
    return retrieval.ablate(chunks, asked, ABLATION), chunks, asked


def ablation_hits(spark: SparkSession, d: str) -> DataFrame:
    return _ablated(spark, d)[0].drop("text")


def ablation(spark: SparkSession, d: str) -> DataFrame:
    """Means of the five metrics per configuration, over the answerable golden questions."""
    found, chunks, asked = _ablated(spark, d)
    strategy = F.create_map(*[F.lit(x) for c in ABLATION for x in (c.label, c.chunk_strategy)])[F.col("config")]
    found = stage(found.withColumns({"rank": F.col("final_rank"), "of": F.concat_ws(":", strategy, "chunk_id")}))
    # The same result of several configurations is held against the spans once; strategies may give different texts one id.
    each = found.select("qid", F.col("of").alias("chunk_id"), "text", F.lit(0).alias("rank")).dropDuplicates(["qid", "chunk_id"])
    judged = evaluate.relevance(each, asked).select("qid", F.col("chunk_id").alias("of"), "relevant")
    judged = stage(found.select("config", "qid", "chunk_id", "rank", "of").join(judged, ["qid", "of"]))
    totals = {s: stage(evaluate.relevant_total(c, asked)) for s, c in chunks.items()}
    answerable = asked.where(F.coalesce("category", F.lit("")) != "negative").select("qid")
    out = None
    for c in ABLATION:
        rows = evaluate.retrieval_metrics(judged.where(F.col("config") == c.label), totals[c.chunk_strategy], c.final_top_k).join(answerable, "qid", "left_semi")
        means = [F.round(F.coalesce(F.avg(m), F.lit(0.0)), 9).alias(m) for m in evaluate.METRICS]
        one = rows.agg(F.count("*").alias("n"), *means).select(F.lit(c.label).alias("config"), "n", *evaluate.METRICS)
        out = one if out is None else out.unionByName(one)
    return out


def multi_query(spark: SparkSession, d: str) -> DataFrame:
    """Fused results of each golden question and up to three logged paraphrases, one list per variant and retriever."""
    asked = golden(spark, d)
    logged = table(spark, d, "retrieval_results").groupBy("qid").agg(F.max("expanded_queries").alias("e")).join(asked.select("qid"), "qid", "left_semi")
    variants = logged.select("qid", F.posexplode("e").alias("i", "question")).where("question IS NOT NULL").withColumn("variant", F.col("i") + 1)
    config = RetrievalConfig(expansion="multi_query", use_rerank=False)
    lists, _ = retrieval.candidates(corpus(spark, d), asked, config, paraphrases=variants, index=lexical(spark, d))
    return fusion.rrf(lists).where("fused_rank <= 10").select("qid", "chunk_id", "score", "fused_rank", "dense_rank", "lexical_rank")


def _score_cache(spark: SparkSession, d: str, size: int) -> DataFrame:
    logged = table(spark, d, "search_hits").where("retriever = 'rerank' AND score IS NOT NULL AND NOT isnan(score) AND logged_at IS NOT NULL")
    entries = logged.groupBy(rerank.cache_key(F.col("qid")).alias("query_key"), "chunk_id", F.col("logged_at").alias("used_at")).agg(F.max("score").alias("rerank_score")).select("query_key", "chunk_id", "rerank_score", "used_at")
    return rerank.update_cache(entries.where("false"), entries, size)


def cache_report(spark: SparkSession, d: str) -> DataFrame:
    """Hits, misses and hit rate of the reranker's logged pairs in a cache of 1,000 entries."""
    pairs = table(spark, d, "search_hits").where("retriever = 'rerank'").select(rerank.cache_key(F.col("qid")).alias("query_key"), "chunk_id")
    return rerank.cache_report(pairs, _score_cache(spark, d, 1000))


def score_cache(spark: SparkSession, d: str) -> DataFrame:
    """The newest 1,000 rerank scores by query and chunk, as the SQL has it; the limit is the feature."""
    return _score_cache(spark, d, 1000)


def score_cache_default(spark: SparkSession, d: str) -> DataFrame:
    """The same with the default size of the cache."""
    return _score_cache(spark, d, Settings().cache_size)


def _sized(spark: SparkSession, d: str) -> DataFrame:
    limits = table(spark, d, "collections").select(F.col("name").alias("collection"), "chunk_size", "chunk_overlap")
    return table(spark, d, "documents").select("doc_id", "text", "page_spans", "collection").join(limits, "collection", "left")


def fixed_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = chunking.fixed_token(_sized(spark, d), F.coalesce("chunk_size", F.lit(512)), F.coalesce("chunk_overlap", F.lit(64)))
    return made.drop("metadata", "strategy")


def structural_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.recursive_structural(_sized(spark, d), F.coalesce("chunk_size", F.lit(512)))


def semantic_groups(spark: SparkSession, d: str) -> DataFrame:
    groups = chunking.semantic_groups(table(spark, d, "documents"))
    return groups.select(F.col("doc_id").cast("long").alias("doc_id"), "sent_no", F.round("distance", 6).alias("distance"), "group_no")


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    return chunking.semantic(table(spark, d, "documents"))


def chunk_ids(spark: SparkSession, d: str) -> DataFrame:
    chunks = table(spark, d, "chunks").select("doc_id", "start_char", ids.chunk_id(F.col("doc_id"), F.col("start_char")).alias("chunk_id"))
    return chunks.distinct()


def fingerprints(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").groupBy("collection").agg(ids.fingerprint(F.col("chunk_id")).alias("fingerprint"))


def document_titles(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.title(F.col("metadata"), F.col("source_path")).alias("title"))


def change_detection(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", ids.content_hash(F.concat_ws("", "text", F.when(F.col("collection") == "notes", " ").otherwise(""))).alias("content_hash"))
    known = table(spark, d, "documents").where("ingested_at < TIMESTAMP '2026-04-01'").select("doc_id", "content_hash")
    return store.changes(docs, known)


def _after_upsert(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("collection = 'notes'").select("doc_id")
    rows = docs.select(ids.chunk_id(F.col("doc_id"), F.lit(0)).alias("chunk_id"), "doc_id")
    return store.upserted(corpus(spark, d).select("chunk_id", "doc_id"), docs, rows)


def upsert_state(spark: SparkSession, d: str) -> DataFrame:
    return _after_upsert(spark, d)


def delete_state(spark: SparkSession, d: str) -> DataFrame:
    gone = table(spark, d, "documents").where("collection = 'scans'").select("doc_id")
    return store.deleted(corpus(spark, d).select("chunk_id", "doc_id"), gone)


def list_documents(spark: SparkSession, d: str) -> DataFrame:
    """A page of the listing; the limit is the feature."""
    return filters.page(store.listing(table(spark, d, "documents"), corpus(spark, d)), "doc_id", 50, 100)


def count_chunks(spark: SparkSession, d: str) -> DataFrame:
    return corpus(spark, d).groupBy("collection").agg(F.count("*").alias("n_chunks"))


def ingest_summary(spark: SparkSession, d: str) -> DataFrame:
    blank = F.trim(F.coalesce("text", F.lit(""))) == ""
    error = table(spark, d, "documents").select("doc_id", F.when(blank, F.concat(F.lit("no text: "), "source_path")).alias("error"))
    statuses = change_detection(spark, d).join(error, "doc_id").withColumn("status", F.when(F.col("error").isNotNull(), "failed").otherwise(F.col("status")))
    return store.ingest_summary(statuses, corpus(spark, d))


def html_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of every text that has any, whatever its media type says."""
    return files.blocks_of(table(spark, d, "documents"))


def html_markdown(spark: SparkSession, d: str) -> DataFrame:
    return files.markdown_of(table(spark, d, "documents")).where("markdown != ''")


def approximate_tokens(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", text.approximate_tokens(F.col("text")).alias("n_tokens"))


def token_bucket(spark: SparkSession, d: str) -> DataFrame:
    return streams.token_bucket(table(spark, d, "events"), per_minute=1 / 30, capacity=2.0)


def event_windows(spark: SparkSession, d: str) -> DataFrame:
    return streams.windowed(table(spark, d, "events"))


def event_sessions(spark: SparkSession, d: str) -> DataFrame:
    return streams.sessions(table(spark, d, "events"), "2 hours")


NAMED: list[Query] = [
    bm25_stats, bm25_topk, dense_topk, dense_filtered, ann_topk, metadata_filter, list_filter, document_filter, hash_embed, rrf, weighted_fusion, candidate_counts, hybrid, hybrid_filtered, debug_trail, rerank_overlap, rerank_all,
    refusal, relevance, retrieval_metrics, breakdowns, latency_percentiles, latency_stages, golden_counts, golden_validate, sentences, extractive, extractive_all, citations,
    sentence_grounding, grounding, answers, prompts, prompts_all, citation_precision, evaluation, ablation, ablation_hits, multi_query, score_cache, score_cache_default, cache_report,
    fixed_chunks, structural_chunks, semantic_groups, semantic_chunks, chunk_ids, fingerprints, document_titles, change_detection, upsert_state, delete_state, list_documents, count_chunks,
    ingest_summary, html_blocks, html_markdown, approximate_tokens, token_bucket, event_windows, event_sessions,
]


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in NAMED}


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
