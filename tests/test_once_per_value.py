"""Members of sets get one text each, and pads of keys are made eight bytes at a time."""

import hashlib
import hmac

from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyseal.functions import encoding


def test_members_of_sets_have_one_text(spark):
    plan = entry.queries()["set_fields"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert " AS k" not in plan and "named_struct" not in plan


def test_pads(spark):
    keys = [bytes((7 * k * k + 255 * (k % 3) + j * 37) % 256 for j in range(k)) for k in (1, 7, 8, 9, 16, 63, 64, 65, 200)] + [b"\xff" * 64, b"\x36" * 64, b"\x80" * 32]
    df = spark.createDataFrame([(bytearray(k),) for k in keys], "k binary")
    made = df.select("k", encoding.hmac_sha256(encoding.hmac_pads(F.col("k")), F.lit("message")).alias("h"))
    assert all(r["h"] == hmac.digest(bytes(r["k"]), b"message", hashlib.sha256).hex() for r in made.collect())
    assert "sequence(" not in made._jdf.queryExecution().optimizedPlan().toString()
