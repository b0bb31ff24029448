"""Envelopes are written and parsed once, their rows are dealt to all tasks, and single HMAC signatures are judged without Python, with the same results."""

import base64

import pyarrow as pa
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyseal.functions import encoding
from tallyseal.operators import keys as K
from tallyseal.operators import receipts

SF = "/root/testdata/sf0.001"
AT = "2024-05-01T00:00:00Z"


def test_envelopes_are_written_and_parsed_once(spark):
    plan = entry.queries()["receipt_text"](spark, SF)._jdf.queryExecution()
    made = plan.optimizedPlan().toString()
    assert made.count("from_json(") == 2  # the envelope and its payload
    assert made.count("StructsToJsonEvaluator(") == 1
    assert "RoundRobinPartitioning" in plan.executedPlan().toString()


def _keys(spark):
    secret = base64.b64encode(b"no secret of anybody").decode()
    long = base64.b64encode(bytes(range(100))).decode()
    past = "2024-01-01T00:00:00Z"
    rows = [
        ("good", K.HMAC, None, None, secret), ("long", K.HMAC, "2099-01-01T00:00:00Z", None, long), ("late", K.HMAC, past, None, secret), ("now", K.HMAC, AT, None, secret), ("empty", K.HMAC, "", None, secret),
        ("gone", K.HMAC, None, past, secret), ("bare", K.HMAC, None, None, None), ("hollow", K.HMAC, None, None, ""), ("odd", "RSA", None, None, secret), ("none", None, None, None, secret), ("", K.HMAC, None, None, secret), ("é", K.HMAC, None, None, secret),
    ]
    return spark.createDataFrame([(k, a, past, e, r, True, s, None, None, None, k == "good") for k, a, e, r, s in rows], K.SCHEMA)


def test_native_verdicts_are_python_s(spark):
    keys = _keys(spark)
    base = spark.createDataFrame([("a",)], "canonical_form string").withColumn("frozen_hash", F.sha2("canonical_form", 256))
    made = {k: receipts.sign(base, keys, k, receipt_id=F.lit("r"), when=AT, at="2023-01-01T00:00:00Z").first()["envelope"] for k in ("good", "long")}
    good, long = (made[k]["signatures"][0]["sig"] for k in ("good", "long"))
    names = ["good", "long", "late", "now", "empty", "gone", "bare", "hollow", "odd", "none", "", "é", "nobody", None]
    ones = [[(n, s)] for n in names for s in (good, long, good + "==", "AAAA", "!", "", None)]
    several = [[("nobody", good), ("good", good)], [("late", good), ("good", "AAAA")], [None], [None, ("long", long)], []]
    e = made["good"]
    rows = [(i, (e["payloadType"], e["payload"], s)) for i, s in enumerate(ones + several)]
    df = spark.createDataFrame(rows, f"id long, envelope {receipts.ENVELOPE}")
    for enforce in (True, False):
        near, far = (receipts.verify(df, keys, most_keys=most, enforce_sign_time=enforce).orderBy("id") for most in (100, 1))
        got = near.collect()
        assert got == far.collect() and {r["keyid"] for r in got if r["valid"]} == {"good", "long", "empty", "", "é"} | (set() if enforce else {"late", "now"})
        assert "no secret" not in (shown := near._jdf.queryExecution().toString()) and encoding.py_hmac_pads(b"no secret of anybody")[0].hex() not in shown.lower()


def test_rows_without_a_message_are_left_out():
    judge = receipts._judged(lambda name: 1 / 0, True).func
    none = judge(pa.nulls(2, pa.binary()), pa.nulls(2, pa.string()), pa.array([["k"], []], pa.list_(pa.string())), pa.array([[b"s"], []], pa.list_(pa.binary())))
    assert none.null_count == 2


def test_pads_of_python(spark):
    for n in (0, 1, 63, 64, 65, 200):
        pads = spark.createDataFrame([(bytearray(range(n)),)], "k binary").select(encoding.hmac_pads(F.col("k")).alias("p")).first()["p"]
        assert tuple(map(bytes, pads)) == encoding.py_hmac_pads(bytes(range(n)))
