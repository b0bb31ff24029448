"""Texts of doubles: those made in the JVM, those left to Python, and both against Python's shortest."""

import random
import struct

from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.functions import numbers

EDGES = [0.0, -0.0, 1.0, -1.5, 0.1, 0.001, 0.00099, 1e-7, 1.5e-7, -2.5e-300, 2e23, 1e22, 1e23, 9007199254740991.0, 9007199254740992.0, 9007199254740993.0, 12345678.9, -98765432.125, 1e7, 1234567.5, 10000000.5, 2.2250738585072014e-308, 5e-324, 2e-323, 1.7976931348623157e308, 123456789012345.6, 0.1 + 0.2, 100.0, 10.05, 1e-3, float("nan"), float("inf"), float("-inf"), 2.0**-44, 2.0e-3, 4.35, 0.3, 2.2e-322]


def _texts(spark, values):
    df = spark.createDataFrame([(x,) for x in values], "d double")
    return df.select("d", numbers.native_text(F.col("d")).alias("jvm"), numbers.canonical_number(F.col("d"), T.DoubleType()).alias("text")).collect()


def test_doubles_of_any_bits(spark):
    rng = random.Random(31)
    values = [struct.unpack("<d", rng.randbytes(8))[0] for _ in range(15_000)]
    values += [round(rng.uniform(-1, 1) * 10 ** rng.randrange(-12, 16), rng.randrange(12)) for _ in range(15_000)]
    values += [float(f"{rng.randrange(10 ** rng.randrange(1, 16))}e{rng.randrange(-320, 290)}") for _ in range(10_000)]
    for r in _texts(spark, EDGES + values):
        want = numbers.number_text(r["d"])
        assert r["text"] == want and r["jvm"] in (None, want), (r["d"], r["jvm"], r["text"])


def test_few_digits_stay_in_the_jvm(spark):
    """Numbers of up to 15 digits and special ones need no Python; only longer or subnormal ones go there."""
    rng = random.Random(7)
    short = [rng.randrange(-(10**14), 10**14) / 10 ** rng.randrange(14) for _ in range(5000)]
    short += [float(f"{rng.randrange(1, 10**6)}e{rng.randrange(-290, 290)}") for _ in range(2000)] + [float("nan"), float("inf"), -0.0]
    rows = _texts(spark, short)
    left = sum(r["jvm"] is None for r in rows)
    assert left <= len(rows) // 100  # where the JVM's own text is longer than need be
    assert [r["jvm"] for r in _texts(spark, [0.1 + 0.2, 5e-324, None])] == [None, None, None]


def test_amounts_stay_in_the_jvm(spark):
    t = spark.read.parquet("/root/testdata/sf0.01/lineitem.parquet")
    for c in ("l_extendedprice", "l_discount", "l_tax"):
        assert t.where(F.col(c).isNotNull() & numbers.native_text(F.col(c).cast("double")).isNull()).isEmpty()
