"""Evaluation: relevance, retrieval metrics, aggregates, percentiles, golden-set checks and the regression gate."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tarnwick.functions.embedding import Embedder, embed
from tarnwick.functions.text import overlaps, squash, strip
from tarnwick.functions.vectors import cosine
from tarnwick.operators.ranking import DIGITS
from tarnwick.operators.search import occurring


def one_row(df: DataFrame, key: str, *first: str) -> DataFrame:
    """One whole row per key: the last by the columns ``first``, then by all others (nulls come first); columns must have an order."""
    order = [*first, *[c for c in df.columns if c != key and c not in first]]
    last = df.groupBy(key).agg(F.max(F.struct(*order)).alias("r"))
    return last.select(*[F.col(key) if c == key else F.col(f"r.{c}").alias(c) for c in df.columns])


def golden_once(golden: DataFrame) -> DataFrame:
    """One entry per qid."""
    return one_row(golden, "qid")


def relevance(results: DataFrame, golden: DataFrame) -> DataFrame:
    """qid, chunk_id, rank, relevant: whether a result overlaps any span of its question.  ``results`` has text."""
    met = results.select("qid", "chunk_id", "rank", squashed(F.col("text")).alias("hay")).join(_needles(golden), "qid")
    return met.select("qid", "chunk_id", "rank", _hit().alias("relevant"))


def squashed(text: Column) -> Column:
    return squash(F.coalesce(text, F.lit("")))


def _needles(golden: DataFrame) -> DataFrame:
    return golden.select("qid", F.transform("relevant_chunk_texts", squashed).alias("needles"))


def _hit() -> Column:
    return F.coalesce(F.exists("needles", lambda s: overlaps(F.col("hay"), s)), F.lit(False))


def relevant_total(chunks: DataFrame, golden: DataFrame) -> DataFrame:
    """qid, total: relevant chunks among those of the documents the entry names (0 if it names none)."""
    named = golden.select("qid", F.explode(F.array_distinct("relevant_doc_ids")).alias("doc_id")).join(_needles(golden), "qid")
    texts = chunks.join(named.select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", squashed(F.col("text")).alias("hay"))
    per = named.join(texts, "doc_id").groupBy("qid").agg(F.count_if(_hit()).alias("total"))
    return golden.select("qid").join(per, "qid", "left").select("qid", F.coalesce("total", F.lit(0)).alias("total"))


def ndcg(gains: Column, total: Column, k: int) -> Column:
    """nDCG at k of an array of gains in rank order, with ``total`` relevant items in the corpus."""
    def dcg(values: Column) -> Column:
        parts = F.transform(F.slice(values, 1, k), lambda g, i: g / F.log2(i + F.lit(2.0)))
        return F.aggregate(parts, F.lit(0.0), lambda s, x: s + x)

    positive = F.filter(gains, lambda g: g > 0)
    best = F.coalesce(F.array_max(positive), F.lit(1.0))
    missing = F.greatest(total - F.size(positive), F.lit(0)).cast("int")
    ideal = dcg(F.reverse(F.array_sort(F.concat(positive, F.array_repeat(best, missing)))))
    return F.when(ideal > 0, dcg(gains) / ideal).otherwise(F.lit(0.0))


def retrieval_metrics(flags: DataFrame, totals: DataFrame, k: int = 5) -> DataFrame:
    """qid and its recall, precision, hit rate, reciprocal rank and nDCG at k; questions without results score 0."""
    per = flags.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("rank", F.when(F.col("relevant"), 1.0).otherwise(0.0).alias("gain")))).alias("r"))
    met = totals.join(per, "qid", "left").withColumn("gains", F.coalesce(F.transform("r", lambda x: x["gain"]), F.array().cast("array<double>")))
    found = F.aggregate(F.slice("gains", 1, k), F.lit(0.0), lambda s, x: s + x)
    first = F.array_position("gains", F.lit(1.0))
    total = F.col("total")
    return met.select(
        "qid",
        total.alias("total"),
        F.round(F.when(total > 0, F.least(F.lit(1.0), found / total)).otherwise(F.lit(0.0)), DIGITS).alias("recall"),
        F.round(found / k, DIGITS).alias("precision"),
        F.when(found > 0, 1.0).otherwise(0.0).alias("hit"),
        F.round(F.when(first > 0, 1.0 / first).otherwise(F.lit(0.0)), DIGITS).alias("rr"),
        F.round(ndcg(F.col("gains"), total, k), DIGITS).alias("ndcg"),
    )


METRICS = ("recall", "precision", "hit", "rr", "ndcg")


def breakdowns(rows: DataFrame) -> DataFrame:
    """Overall, per category and per difficulty in one pass.

    ``rows``: per question metrics, category, difficulty, refused.  Retrieval averages
    leave negatives out; by category they are counted; by difficulty they are not.
    """
    negative = F.col("category") == "negative"
    level = F.when(F.grouping("category") == 0, F.lit("category")).when(F.grouping("difficulty") == 0, F.lit("difficulty")).otherwise(F.lit("all"))
    sets = rows.groupingSets([["category"], ["difficulty"], []], "category", "difficulty")
    everything = sets.agg(
        level.alias("level"),
        F.count_if(~negative).alias("n_answerable"),
        F.count("*").alias("n"),
        *[F.round(F.avg(F.when(~negative, F.col(m))), DIGITS).alias(f"answerable_{m}") for m in METRICS],
        *[F.round(F.avg(m), DIGITS).alias(f"all_{m}") for m in METRICS],
        F.round(F.coalesce(F.avg(F.when(negative, F.col("refused").cast("double"))), F.lit(0.0)), DIGITS).alias("refusal_accuracy"),
        F.round(F.coalesce(F.avg(F.when(~negative, F.col("refused").cast("double"))), F.lit(0.0)), DIGITS).alias("false_refusal"),
        F.round(F.avg(F.col("refused").cast("double")), DIGITS).alias("refused_rate"),
    )
    by_category = F.col("level") == "category"
    kept = everything.where((F.col("level") != "difficulty") | (F.col("n_answerable") > 0))
    return kept.select(
        "level",
        F.coalesce("category", "difficulty").alias("value"),
        F.when(F.col("level") == "difficulty", F.col("n_answerable")).otherwise(F.col("n")).alias("n"),
        *[F.coalesce(F.when(by_category, F.col(f"all_{m}")).otherwise(F.col(f"answerable_{m}")), F.lit(0.0)).alias(m) for m in METRICS],
        "refusal_accuracy",
        "false_refusal",
        "refused_rate",
    )


def latency(df: DataFrame, value: str, *keys: str) -> DataFrame:
    """p50, p95, mean and maximum per key, at the nearest rank: index round-half-even(f (n - 1)).

    Positions come from counts per value, so no key's rows are gathered: distinct values
    are counted, accumulated in order, and the value that covers the wanted index is kept.
    """
    counts = df.where(F.col(value).isNotNull()).groupBy(*keys, F.col(value).alias("__v")).agg(F.count("*").alias("__c"))
    run = Window.partitionBy(*keys).orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    cum = counts.select(*keys, "__v", "__c", F.sum("__c").over(run).alias("__cum"), F.sum("__c").over(Window.partitionBy(*keys)).alias("__n"))

    def at(f: float) -> Column:
        index = F.bround(F.lit(f) * (F.col("__n") - 1)).cast("long")
        return F.min(F.when(F.col("__cum") > index, F.col("__v")))

    return cum.groupBy(*keys).agg(
        at(0.50).alias("p50"), at(0.95).alias("p95"), F.round(F.sum(F.col("__v") * F.col("__c")) / F.max("__n"), 6).alias("mean"), F.max("__v").alias("max"), F.max("__n").alias("n")
    )


#: Stages of a query whose time is taken.
STAGES = ("dense", "lexical", "fusion", "rerank", "retrieval", "generation", "grounding", "total")


def stage_latency(rows: DataFrame, stages: tuple[str, ...] = STAGES) -> DataFrame:
    """Latency of each stage from its column ``<stage>_ms``; a stage without rows or column has zeros."""
    known = [c for c in stages if f"{c}_ms" in rows.columns]
    spark = rows.sparkSession
    every = spark.createDataFrame([(c,) for c in stages], "stage string")
    if not known:
        found = spark.createDataFrame([], "stage string, p50 double, p95 double, mean double, max double, n long")
    else:
        pairs = ", ".join(f"'{c}', CAST({c}_ms AS DOUBLE)" for c in known)
        found = latency(rows.selectExpr(f"stack({len(known)}, {pairs}) AS (stage, ms)"), "ms", "stage")
    return every.join(F.broadcast(found), "stage", "left").na.fill(0)  # a row per stage


def answer_similarity(answers: DataFrame, golden: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """qid, answer_similarity: cosine of the answer and the reference answer; only where both have words."""
    words = lambda c: strip(F.coalesce(c, F.lit(""))) != ""
    both = answers.select("qid", F.col("answer").alias("__said")).join(golden.select("qid", "answer"), "qid").where(words(F.col("__said")) & words(F.col("answer")))
    return both.select("qid", F.round(cosine(embed(F.col("__said"), embedder), embed(F.col("answer"), embedder)), DIGITS).alias("answer_similarity"))


def run_metrics(rows: DataFrame) -> DataFrame:
    """One row: the means of a run.

    ``rows``: per question category, METRICS, citation_precision, answer_similarity (null where
    there is none), refused, grounded.  All but the refusal accuracy are over answerable questions.
    """
    negative = F.coalesce(F.col("category") == "negative", F.lit(False))
    mean = lambda c, keep: F.round(F.coalesce(F.avg(F.when(keep, c.cast("double"))), F.lit(0.0)), DIGITS)
    own = [mean(F.col(m), ~negative).alias(m) for m in (*METRICS, "citation_precision", "answer_similarity")]
    return rows.agg(
        F.count("*").alias("n"), *own, mean(F.col("refused"), negative).alias("refusal_accuracy"), mean(F.col("grounded"), ~negative).alias("grounded_rate"), mean(F.col("refused"), ~negative).alias("false_refusal_rate")
    )


def citation_precision(cited: DataFrame, flags: DataFrame, questions: DataFrame) -> DataFrame:
    """qid, citation_precision: relevant share of the distinct cited chunks; 0.0 if none is cited."""
    used = cited.where("resolved").select("qid", "chunk_id").distinct().join(flags.select("qid", "chunk_id", "relevant"), ["qid", "chunk_id"])
    per = used.groupBy("qid").agg(F.avg(F.col("relevant").cast("double")).alias("p"))
    return questions.select("qid").distinct().join(per, "qid", "left").select("qid", F.round(F.coalesce("p", F.lit(0.0)), DIGITS).alias("citation_precision"))


def validate_golden(golden: DataFrame, documents: DataFrame, min_negatives: int = 8) -> DataFrame:
    """qid, problem, severity: repeated ids, evidence that contradicts the category, unknown documents, spans found
    nowhere (failure) or only in other documents (warning), and too few negatives.

    Spans meet the named documents by equi-join; only spans not found there are searched in the
    whole corpus, which is read once, against the block of open spans.
    """
    again = golden.groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.explode(F.sequence(F.lit(1), F.col("n").cast("int"))).alias("i")).where("i > 1")  # one row per repeat
    repeated = again.select("qid", F.lit("repeated qid").alias("problem"), F.lit("failure").alias("severity"))
    one = golden_once(golden)
    spans, docs = F.coalesce(F.size("relevant_chunk_texts"), F.lit(0)), F.coalesce(F.size("relevant_doc_ids"), F.lit(0))
    negative = F.coalesce(F.col("category") == "negative", F.lit(False))
    wrong = one.where(negative & ((spans > 0) | (docs > 0))).select("qid", F.lit("negative with evidence").alias("problem"), F.lit("failure").alias("severity"))
    bare = one.where(~negative & (spans < 1)).select("qid", F.lit("answerable without span").alias("problem"), F.lit("failure").alias("severity"))
    named = one.select("qid", F.explode("relevant_doc_ids").alias("doc_id")).distinct()
    unknown = named.join(documents.select("doc_id"), "doc_id", "left_anti").groupBy("qid").agg(F.count("*").alias("n")).select("qid", F.lit("unknown document").alias("problem"), F.lit("failure").alias("severity"))
    each = one.where(~negative).select("qid", "relevant_doc_ids", F.posexplode("relevant_chunk_texts").alias("no", "span"))
    in_named = (
        each.select("qid", "no", "span", F.explode("relevant_doc_ids").alias("doc_id"))
        .join(documents.select("doc_id", "text"), "doc_id")
        .where(F.col("text").contains(F.col("span")))
        .select("qid", "no")
        .distinct()
    )
    open_ = each.join(in_named, ["qid", "no"], "left_anti").select("qid", "no", "span")
    open_ = open_.withColumn("key", F.concat_ws(":", "no", "qid"))
    elsewhere = occurring(documents, "text", open_, "key", "span").withColumn("found", F.lit(True))
    lost = open_.join(elsewhere, "key", "left").groupBy("qid").agg(F.bool_and(F.coalesce("found", F.lit(False))).alias("all"))
    missing = lost.select("qid", F.when(F.col("all"), "span in another document").otherwise("span not found").alias("problem"), F.when(F.col("all"), "warning").otherwise("failure").alias("severity"))
    few = one.agg(F.count_if(negative).alias("n")).where(F.col("n") < min_negatives).select(F.lit("*").alias("qid"), F.lit("too few negatives").alias("problem"), F.lit("failure").alias("severity"))
    out = repeated
    for part in (wrong, bare, unknown, missing, few):
        out = out.unionByName(part)
    return out


def floors(measured: dict[str, float], margin: float = 0.05) -> dict[str, float]:
    """Regression floors below measured values."""
    return {k: round(max(0.0, v - margin), 4) for k, v in measured.items()}


def gate(measured: dict[str, float], floor: dict[str, float]) -> dict[str, tuple[float, float]]:
    """Metrics below their floor, with both values."""
    return {k: (measured.get(k, 0.0), f) for k, f in floor.items() if measured.get(k, 0.0) < f}
