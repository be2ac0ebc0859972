"""The score code sorts as the doubles do, at every exponent."""

import math
import struct

from pyspark.sql import functions as F

from tarnwick.llm.topn import score_code


def bits(x):
    n = struct.unpack("<q", struct.pack("<d", x + 0.0))[0]
    return n if n >= 0 else -(n & ((1 << 63) - 1))


def test_score_code_is_that_of_the_bits(spark):
    values = [0.0, -0.0, math.inf, -math.inf, 5e-324, -5e-324, 1.7976931348623157e308, 2.2250738585072014e-308, 2.225073858507201e-308, 0.1, 1 / 3]
    for e in range(-1074, 1024):
        x = math.ldexp(1.0, e)
        values += [x, -x, math.nextafter(x, math.inf), math.nextafter(x, 0.0), x * 1.37]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    got = df.select("v", score_code(F.col("v")).alias("c")).collect()
    assert [r["c"] for r in got] == [bits(r["v"]) for r in got]
