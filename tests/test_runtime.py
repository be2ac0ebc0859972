import os
import random

import pytest
from pyspark.sql import functions as F

from tarnwick import runtime
from tarnwick.operators import skew


class Elsewhere:
    """A session on a cluster that names no shared folder."""

    class conf:  # noqa: N801
        @staticmethod
        def get(key, default=None):
            return default

    class sparkContext:  # noqa: N801
        master = "spark://host:7077"

        @staticmethod
        def getConf():
            return {}


def test_a_cluster_needs_a_shared_folder():
    with pytest.raises(runtime.SharedFolderError):
        runtime.shared_dir(Elsewhere)


def test_the_session_is_left_as_it_was_and_tables_go(spark):
    before = spark.conf.get("spark.checkpoint.dir", None)
    staged = runtime.stage(spark.range(5))
    assert spark.conf.get("spark.checkpoint.dir", None) == before and staged.count() == 5
    folder = staged._staged_path.removeprefix("file://")
    assert os.path.isdir(folder)
    runtime.unstage(staged)
    assert not os.path.exists(folder)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_spread_join_equals_the_plain_one(spark, monkeypatch, how):
    monkeypatch.setattr(skew, "LEAST", 10)
    rng = random.Random(1)
    rows = [("hot" if i % 3 else f"k{rng.randrange(50)}", f"i{i}", 1) for i in range(900)] + [(None, "n", 1), ("lone", "l", 1)]
    left = spark.createDataFrame(rows, "k string, i string, x int")
    table = left.where("k != 'lone'").groupBy("k").agg(F.count("*").alias("n")).cache()
    got = skew.join_spread(left, table, ["k"], "n", "i", how)
    assert sorted(map(repr, got.collect())) == sorted(map(repr, left.join(table, ["k"], how).collect()))
    assert "__salt" in got._jdf.queryExecution().toString()
