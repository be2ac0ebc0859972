"""The pN_ queries over the test tables, and the SQL they are held against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.llm import borda, bpe, knn, markup, mixing, repetition, splitting
from tarnwick.llm.topn import top_n
from tarnwick.operators import dense
from tarnwick.runtime import stage

Query = Callable[[SparkSession, str], DataFrame]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = _table(spark, sf_dir, "search_hits")
    return top_n(hits, ["qid", "retriever"], "chunk_id", "score", 5).select("qid", "retriever", "chunk_id")


P1_SQL = """
WITH d AS (
  SELECT qid, retriever, chunk_id, max(score) AS score FROM search_hits
  WHERE score IS NOT NULL AND NOT isnan(score) AND qid IS NOT NULL AND retriever IS NOT NULL AND chunk_id IS NOT NULL
  GROUP BY qid, retriever, chunk_id)
SELECT qid, retriever, chunk_id FROM d
QUALIFY row_number() OVER (PARTITION BY qid, retriever ORDER BY score DESC, chunk_id) <= 5
"""


P2_DIM, P2_K, P2_SHARE, P2_RECALL = 128, 10, 0.95, 0.99


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the lists of all chunks, the pairs that are similar enough."""
    near = knn.neighbours(_table(spark, sf_dir, "chunks"), "chunk_id", "embedding", P2_DIM, P2_K, P2_RECALL).where(F.col("similarity") >= P2_SHARE)
    return near.select(F.least("chunk_id", "neighbour").alias("chunk_id_a"), F.greatest("chunk_id", "neighbour").alias("chunk_id_b")).distinct()


P2_SQL = """
WITH v AS (
  SELECT chunk_id, any_value(embedding) AS e FROM chunks
  WHERE len(embedding) = 128 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0
  GROUP BY chunk_id)
SELECT a.chunk_id AS chunk_id_a, b.chunk_id AS chunk_id_b FROM v a JOIN v b ON a.chunk_id < b.chunk_id
WHERE list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) >= 0.95
"""


def p2_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten nearest of the stated queries (chunks of documents whose id is divisible by 100), against all chunks."""
    asks = F.pmod(F.col("doc_id"), F.lit(100)) == 0
    near = knn.neighbours(_table(spark, sf_dir, "chunks"), "chunk_id", "embedding", P2_DIM, P2_K, P2_RECALL, queries=asks)
    return near.select("chunk_id", "neighbour", F.round("similarity", 6).alias("similarity"), "position")


#: Chunks whose lists are held against an exhaustive search, at most about so many (chosen by hash).
P2_PROBES = 400


def p2_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The recall of the lists, measured over other probes than those of the calibration: one row."""
    chunks = _table(spark, sf_dir, "chunks")
    every = max(1, chunks.count() // P2_PROBES)
    asks = F.pmod(F.xxhash64(F.lit(99), "chunk_id"), F.lit(every)) == 0
    found = knn.neighbours(chunks, "chunk_id", "embedding", P2_DIM, P2_K, P2_RECALL, queries=asks).select("chunk_id", "neighbour")
    usable = chunks.where(F.col("chunk_id").isNotNull() & knn.usable(F.col("embedding"), P2_DIM)).dropDuplicates(["chunk_id"])
    asked = usable.where(asks).select(F.col("chunk_id").alias("qid"), "embedding")
    true = dense.top_k(usable, asked, P2_K + 1, P2_DIM).where("qid != chunk_id").select(F.col("qid").alias("chunk_id"), F.col("chunk_id").alias("neighbour"), "score")
    place = F.row_number().over(Window.partitionBy("chunk_id").orderBy(F.desc("score"), "neighbour"))
    true = true.withColumn("place", place).where(F.col("place") <= P2_K)
    met = true.join(found.withColumn("found", F.lit(True)), ["chunk_id", "neighbour"], "left")
    return met.agg(F.count_distinct("chunk_id").alias("probes"), F.count("*").alias("neighbours"), F.count("found").alias("found"), F.round(F.try_divide(F.count("found"), F.count("*")), 4).alias("recall"))


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with the limits of their collection (null where it has none)."""
    limits = _table(spark, sf_dir, "collections").select(F.col("name").alias("collection"), "chunk_size", "chunk_overlap").dropDuplicates(["collection"])
    return _table(spark, sf_dir, "documents").select("doc_id", "text", "page_spans", "collection").join(limits, "collection", "left")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that come out as more than one piece."""
    return p3_pieces(spark, sf_dir).where("piece_no = 1").select("doc_id")


P3_SQL = r"""
SELECT doc_id FROM documents LEFT JOIN collections ON collection = name
WHERE len(regexp_extract_all(text, '[^ \t\n\f\r]+')) > coalesce(chunk_size, 512)
"""


def p3_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splitting.pieces(_sized(spark, sf_dir), "doc_id", "text", F.col("chunk_size"), F.col("chunk_overlap"), "page_spans")


LISTS = ["dense", "lexical", "rerank"]


def _p4(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = borda.positions(_table(spark, sf_dir, "search_hits"), "qid", "retriever", "chunk_id", "score")
    weights = borda.run_weights(_table(spark, sf_dir, "retrieval_results"), _table(spark, sf_dir, "ablation_runs"))
    return borda.borda(placed, weights, LISTS)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return borda.heads(_p4(spark, sf_dir), LISTS).withColumnRenamed("item", "chunk_id")


def p4_fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    return borda.fused(_p4(spark, sf_dir)).select("qid", F.col("item").alias("chunk_id"), F.round("points", 6).alias("points"), "position")


P4_LISTS_SQL = """
WITH conf AS (
  SELECT r.qid, any_value(c.use_dense) AS ud, any_value(c.use_lexical) AS ul, any_value(c.use_rerank) AS ur,
         any_value(coalesce(lower(trim(c.fusion)), 'rrf') = 'weighted') AS weighted,
         any_value(coalesce(c.dense_weight, 0.5)) AS w
  FROM (SELECT qid, min(run_id) AS run_id FROM retrieval_results GROUP BY qid) r
  JOIN (SELECT run_id, unnest(config) FROM ablation_runs) c USING (run_id) GROUP BY r.qid),
d AS (
  SELECT qid, retriever, chunk_id, max(score) AS score FROM search_hits
  WHERE score IS NOT NULL AND NOT isnan(score) AND qid IS NOT NULL AND retriever IS NOT NULL AND chunk_id IS NOT NULL
  GROUP BY qid, retriever, chunk_id),
l AS (
  SELECT d.*, CASE retriever
      WHEN 'dense' THEN CASE WHEN conf.qid IS NULL THEN 1.0 WHEN NOT ud THEN 0.0 WHEN weighted THEN greatest(w, 0.0) ELSE 1.0 END
      WHEN 'lexical' THEN CASE WHEN conf.qid IS NULL THEN 1.0 WHEN NOT ul THEN 0.0 WHEN weighted THEN greatest(1 - w, 0.0) ELSE 1.0 END
      WHEN 'rerank' THEN CASE WHEN conf.qid IS NULL THEN 1.0 WHEN NOT ur THEN 0.0 ELSE 1.0 END END::DOUBLE AS wt
  FROM d LEFT JOIN conf USING (qid)),
p AS (
  SELECT *, row_number() OVER (PARTITION BY qid, retriever ORDER BY score DESC, chunk_id) AS pos,
         rank() OVER (PARTITION BY qid, retriever ORDER BY score DESC) + (count(*) OVER (PARTITION BY qid, retriever, score) - 1) / 2.0::DOUBLE AS rnk,
         count(*) OVER (PARTITION BY qid, retriever) AS n
  FROM l WHERE wt > 0)
"""

P4_FOUND_SQL = P4_LISTS_SQL + """,
q AS (SELECT qid, count(DISTINCT retriever) AS lists FROM p GROUP BY qid),
c AS (SELECT qid, chunk_id, count_if(pos <= 3) AS top3, count_if(pos <= 8) AS top8 FROM p GROUP BY qid, chunk_id),
h AS (SELECT qid, count_if(top8 >= 2) AS contested, max(CASE WHEN top3 = lists AND lists >= 2 THEN chunk_id END) AS chunk_id
      FROM c JOIN q USING (qid) GROUP BY qid)
SELECT qid, chunk_id FROM h WHERE contested = 1 AND chunk_id IS NOT NULL
"""

P4_FUSED_SQL = P4_LISTS_SQL + """,
q AS (SELECT qid, count(DISTINCT chunk_id) AS m FROM p GROUP BY qid),
s AS (SELECT DISTINCT qid, retriever, wt, n FROM p),
u AS (SELECT DISTINCT qid, chunk_id FROM p),
v AS (
  SELECT u.qid, u.chunk_id, s.retriever, s.wt * (q.m - coalesce(p.rnk, (s.n + 1 + q.m) / 2.0::DOUBLE)) AS pts
  FROM u JOIN s USING (qid) JOIN q USING (qid)
  LEFT JOIN p ON p.qid = u.qid AND p.chunk_id = u.chunk_id AND p.retriever = s.retriever),
t AS (
  SELECT qid, chunk_id, coalesce(sum(pts) FILTER (retriever = 'dense'), 0.0) + coalesce(sum(pts) FILTER (retriever = 'lexical'), 0.0)
         + coalesce(sum(pts) FILTER (retriever = 'rerank'), 0.0) AS points
  FROM v GROUP BY qid, chunk_id)
SELECT qid, chunk_id, round(points, 6) AS points, row_number() OVER (PARTITION BY qid ORDER BY points DESC, chunk_id) AS position FROM t
"""


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts in which the minimum cut leaves any span on the side of residue."""
    return markup.labelled(_table(spark, sf_dir, "documents"), "doc_id", "text").where("n_residue > 0").select("doc_id")


def p5_clean(spark: SparkSession, sf_dir: str) -> DataFrame:
    return markup.cleaned(_table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode(_table(spark, sf_dir, "documents"), "text", "doc_id")


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Only an empty or null text has no ids."""
    return p6_ids(spark, sf_dir).where(F.size("ids") == 0).select("doc_id")


P6_FOUND_SQL = "SELECT doc_id FROM documents WHERE text IS NULL OR text = ''"


def _sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens of every document; written once, as the fit reads them more than once."""
    return stage(bpe.count_tokens(_table(spark, sf_dir, "documents"), "text", "doc_id", "source"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.fit(_sizes(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))
    return mixing.report(plan).where("short").select("mix_id", "source")


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    plan = mixing.fit(_sizes(spark, sf_dir), _table(spark, sf_dir, "mix_targets"))
    return mixing.report(plan)


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    sizes = _sizes(spark, sf_dir)
    plan = stage(mixing.fit(sizes, _table(spark, sf_dir, "mix_targets")))
    return mixing.select(sizes, plan)


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repetition.repetition(_table(spark, sf_dir, "documents"), "doc_id", "text").select("doc_id", "n_words", "n_repeated", "share")


P8_SHARE = 0.30


def _p8(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[dict]]:
    """Every document by the exact measure, written once, and the cutoffs of the estimate that all of them certify."""
    measured = stage(repetition.repetition(_table(spark, sf_dir, "documents"), "doc_id", "text"))
    labelled = measured.withColumn("case", F.col("share") >= P8_SHARE)
    return measured, repetition.controlled_cutoffs(labelled, "estimate", "case", "stratum")


def p8_cutoffs(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = "stratum string, cutoff double, n_cases long, lost long, bound double, certified boolean"
    return spark.createDataFrame([tuple(c.values()) for c in _p8(spark, sf_dir)[1]], schema)


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Let through by the controlled cutoffs, and of a share that makes a case."""
    measured, cutoffs = _p8(spark, sf_dir)
    return measured.where(repetition.reaches(cutoffs) & (F.col("share") >= P8_SHARE)).select("doc_id")


P8_SQL = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}]+') AS w FROM documents),
p AS (SELECT doc_id, len(w) AS n, i, list_slice(w, i, i + 7) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS i FROM d)),
s AS (SELECT doc_id, i, i + 7 <= n AND i > min(i) OVER (PARTITION BY doc_id, g) AS again FROM p),
c AS (SELECT doc_id, max(again::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS repeated FROM s),
r AS (SELECT doc_id, sum(repeated)::BIGINT AS n_repeated FROM c GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_repeated, 0)::BIGINT AS n_repeated,
             CASE WHEN len(w) > 0 THEN coalesce(n_repeated, 0) / len(w)::DOUBLE ELSE 0.0 END AS share FROM d LEFT JOIN r USING (doc_id))
"""


def queries() -> dict[str, Query]:
    return {
        "p1_found": p1_found,
        "p2_found": p2_found,
        "p2_neighbours": p2_neighbours,
        "p2_recall": p2_recall,
        "p3_found": p3_found,
        "p3_pieces": p3_pieces,
        "p4_found": p4_found,
        "p4_fused": p4_fused,
        "p5_found": p5_found,
        "p5_clean": p5_clean,
        "p6_found": p6_found,
        "p6_ids": p6_ids,
        "p7_found": p7_found,
        "p7_report": p7_report,
        "p7_mix": p7_mix,
        "p8_found": p8_found,
        "p8_shares": p8_shares,
        "p8_cutoffs": p8_cutoffs,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "p1_found": P1_SQL,
        "p2_found": P2_SQL,
        "p3_found": P3_SQL,
        "p4_found": P4_FOUND_SQL,
        "p4_fused": P4_FUSED_SQL,
        "p6_found": P6_FOUND_SQL,
        "p8_found": P8_SQL + "SELECT doc_id FROM m WHERE share >= 0.30",
        "p8_shares": P8_SQL + "SELECT * FROM m",
    }
