"""Sessions and tables written between jobs.

An operator that needs several jobs cuts its lineage with :func:`stage`: the
rows go to a Parquet table in the folder that all executors share
(``spark.checkpoint.dir``), so a lost executor costs a re-read and nothing else.
"""

from __future__ import annotations

import io
import os
import re
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

_KEY = "spark.checkpoint.dir"


def local_session(cores: int | str = "*", partitions: int = 8, memory: str = "8g") -> SparkSession:
    """A session for tests and benchmarks on one machine."""
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("tarnwick")
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.driver.memory", memory)
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ship(spark: SparkSession) -> None:
    """Send this package to the Python workers, once per application, so they need no path to it."""
    sc = spark.sparkContext
    if getattr(sc, "_tarnwick_shipped", False):
        return
    root, buffer = Path(__file__).resolve().parent, io.BytesIO()
    with zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent).as_posix())
    path = os.path.join(tempfile.mkdtemp(prefix="tarnwick-"), "tarnwick.zip")
    Path(path).write_bytes(buffer.getvalue())
    sc.addPyFile(path)
    sc._tarnwick_shipped = True


class SharedFolderError(RuntimeError):
    """A cluster session that names no folder which all executors share."""


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it.

    Where none is named, a session on one machine gets a temporary folder, for itself alone; on a
    cluster such a folder would be another one on each machine, so that is an error.
    """
    path = spark.conf.get(_KEY, None) or spark.sparkContext.getConf().get(_KEY)
    if path:
        return path.rstrip("/")
    sc = spark.sparkContext
    if not re.match(r"local(\[|$)", sc.master):
        raise SharedFolderError(f"set {_KEY} to a folder that all executors share")
    if getattr(sc, "_tarnwick_folder", None) is None:
        sc._tarnwick_folder = "file://" + tempfile.mkdtemp(prefix="tarnwick-")
    return sc._tarnwick_folder


def hadoop_path(spark: SparkSession, path: str) -> tuple[Any, Any]:
    """A path and its file system in the JVM."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def stage(df: DataFrame, *, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and return a DataFrame that reads it back.

    Its path is kept on the result for :func:`unstage`.  What is not deleted so goes with the
    application: its folder is deleted when the driver's JVM ends.
    """
    spark = df.sparkSession
    sc = spark.sparkContext
    own = f"{shared_dir(spark)}/tarnwick/{sc.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    if getattr(sc, "_tarnwick_owned", None) != own:
        where, files = hadoop_path(spark, own)
        files.deleteOnExit(where)
        sc._tarnwick_owned = own
    back = spark.read.schema(df.schema).parquet(path)
    back._staged_path = path
    return back


def unstage(*staged: DataFrame) -> None:
    """Delete tables written by :func:`stage` that no later plan reads."""
    for df in staged:
        path = getattr(df, "_staged_path", None)
        if path is not None:
            where, files = hadoop_path(df.sparkSession, path)
            files.delete(where, True)


def once(spark: SparkSession, name: str, sources: list[str], make: Callable[[], DataFrame]) -> DataFrame:
    """A table that is made once per application and stored, as long as its source files are the same."""
    seen = [name]
    for source in sources:
        where, files = hadoop_path(spark, source)
        found = files.listStatus(where) if files.exists(where) else ()
        seen += [f"{s.getPath()}:{s.getLen()}:{s.getModificationTime()}" for s in found]
    made = spark.sparkContext.__dict__.setdefault("_tarnwick_once", {})
    key = tuple(seen)
    if key in made:
        where, files = hadoop_path(spark, made[key]._staged_path)
        if files.exists(where):
            return made[key]
    made[key] = stage(make())
    return made[key]


def parallelism(spark: SparkSession) -> int:
    """Partitions that a shuffle gets in this session."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
