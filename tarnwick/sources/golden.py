"""Golden sets, manifests and evaluation output as JSON lines, JSON and Markdown."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarnwick.operators.evaluate import floors
from tarnwick.runtime import hadoop_path
from tarnwick.schema import GOLDEN

#: Rows of a report table; one with more is an error.
REPORT_ROWS = 10_000
MANIFEST = "doc_id string, path string, sha256 string"


def read_golden(spark: SparkSession, path: str) -> DataFrame:
    """A golden set of JSON lines; blank lines are skipped, and the job fails at a malformed one with its file and number.

    A file is read whole, so that its lines have numbers; golden sets are written by hand.
    """
    parsed = T.StructType([*GOLDEN.fields, T.StructField("__bad", T.StringType())])
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.posexplode(F.split("value", "\r?\n")).alias("no", "line")).where("trim(line) != ''")
    rows = lines.withColumn("r", F.from_json("line", parsed, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}))
    broken = F.col("r.__bad").isNotNull() | F.coalesce(F.col("r.qid"), F.lit("")).eqNullSafe("")
    fail = F.raise_error(F.format_string("%s: line %d is no golden entry", "file", F.col("no") + 1))
    return rows.select(F.when(broken, fail.cast("string")).otherwise(F.col("r.qid")).alias("qid"), *[f"r.{f.name}" for f in GOLDEN.fields if f.name != "qid"])


def write_golden(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """A corpus manifest; one that is missing or has a malformed line counts as none, so that work starts fresh."""
    where, files = hadoop_path(spark, path)
    empty = spark.createDataFrame([], MANIFEST)
    if not files.exists(where):
        return empty
    rows = spark.read.schema(f"{MANIFEST}, __bad string").option("columnNameOfCorruptRecord", "__bad").json(path).cache()
    return empty if not rows.where("__bad IS NOT NULL").isEmpty() else rows.drop("__bad")


def write_rows(rows: DataFrame, path: str) -> None:
    """Evaluation rows as JSON lines, in the order of their questions (sorted in parts, whose names are in order)."""
    rows.orderBy("qid").write.mode("overwrite").json(path)


def markdown_table(df: DataFrame, columns: list[str]) -> str:
    """A report table with three decimals (0.000 for missing numbers); for aggregates: more than REPORT_ROWS rows are an error."""
    rows = df.select(*[F.col(c) for c in columns]).limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows")
    cell = lambda v: f"{v:.3f}" if isinstance(v, float) else "0.000" if v is None else str(v)
    lines = ["| " + " | ".join(columns) + " |", "|" + "---|" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(r[c]) for c in columns) + " |" for r in rows])


def _put(spark: SparkSession, path: str, text: str) -> None:
    where, files = hadoop_path(spark, path)
    stream = files.create(where, True)
    stream.write(bytearray(text.encode()))
    stream.close()


def write_run(spark: SparkSession, path: str, label: str, config: dict, metrics: dict[str, float], tables: dict[str, DataFrame]) -> None:
    """A run: ``run.json`` with its configuration and metrics, and ``report.md`` with those and the named tables."""
    _put(spark, f"{path}/run.json", json.dumps({"label": label, "config": config, "metrics": metrics}, indent=2, sort_keys=True))
    parts = [f"# {label}", "| metric | value |\n|---|---|\n" + "\n".join(f"| {k} | {v:.3f} |" for k, v in sorted(metrics.items()))]
    parts += [f"## {name}\n\n{markdown_table(df, df.columns)}" for name, df in tables.items()]
    _put(spark, f"{path}/report.md", "\n\n".join(parts) + "\n")


def write_baseline(spark: SparkSession, path: str, measured: dict[str, float], margin: float = 0.05) -> dict[str, float]:
    """Measured values and the floors of the regression gate below them."""
    below = floors(measured, margin)
    _put(spark, path, json.dumps({"measured": measured, "floors": below}, indent=2, sort_keys=True))
    return below
