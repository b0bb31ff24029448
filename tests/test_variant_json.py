"""Canonical and sorted JSON in the JVM against the Python path, on random and on hard texts."""

import json
import random

import pytest
from pyspark.sql import functions as F

from tallyseal.functions import schemaless, variant_json
from tallyseal.plans.policy import DEFAULT, Policy

SF = "/root/testdata/sf0.001"
NAMES = ["a", "b", " a", "A", "nonce", "Trace_ID", "timestamp", "date", "created_at", "é", "x y", "", "US", "日"]


def value(rng, depth):
    kind = rng.randrange(12 if depth else 8)
    if kind == 0:
        return rng.choice([None, True, False])
    if kind == 1:
        return rng.choice([0, -1, 7, 2**53 + 1, 2**63 - 1, -(2**63)])
    if kind == 2:
        return rng.choice([1.5, -0.25, 2.0, 0.001, 0.0, -0.0, 123456.789, 0.1 + 0.2, 1e22, 1e-7])
    if kind < 8:
        return rng.choice(["", " x ", "US of A", "été", "日本", "2024-02-03T04:05:06Z", "2024-02-03", "a\tb\n", 'q"\\', "plain", "\x7f", "²", "é"])
    if kind < 10:
        return [value(rng, depth - 1) for _ in range(rng.randrange(4))]
    return {rng.choice(NAMES): value(rng, depth - 1) for _ in range(rng.randrange(5))}


def texts():
    rng = random.Random(15)
    out = [json.dumps(value(rng, rng.randrange(5)), ensure_ascii=k % 3 == 0, indent=1 if k % 5 == 0 else None) for k in range(1500)]
    out += ["", "nope", "{", '{"a":1} x', '{"a":1}],[1', '{"a":1},{"b":2}', '1,"x"],[2', "[1,]", '{"a":1,"a":2}', '{"a":{"b":1,"b":2}}', "NaN", "[Infinity]", "{'a':1}", '{"a":01}', '{"a":-0}', '{"a":-0.0}', '{"a":1.50}', '{"a":100.0}', '{"a":1e2}', '{"a":0.00001}', '{"a":12345678901234567890}', '{"a":123456789012345.5}', '{"a":0.1234567890123456}', '{"a":"\\u00e9"}', '{"a":"\\ud800"}', '"US"', " 5 ", "null", "true", "[]", "{}", '{"a":"x\ny"}', "﻿{}", '{"a ":1,"a":2}', '{"a":1," a":2,"b":3}', "[[[[[[1]]]]]]", '{"a":{"a":{"a":{"a":{"a":{}}}}}}', None]
    return out


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, t) for k, t in enumerate(texts())], "id long, t string").repartition(4).cache()


POLICIES = [DEFAULT, Policy("x"), DEFAULT.with_(lower=True, remove_empty=True, timestamps="strip"), Policy("x", remove_null=False, trim=False, collapse=False, timestamps="bucket", granularity="hour"), DEFAULT.with_(numbers=False)]


@pytest.mark.parametrize("k", range(len(POLICIES)))
def test_forms_equal_python(table, k):
    p = POLICIES[k]
    rows = variant_json.with_json_form(table, "t", p, bind=k % 2 == 0).collect()
    assert not [(r["t"], r["canonical_form"]) for r in rows if r["canonical_form"] != schemaless._try(lambda t: schemaless.canonical_text(t, p, frozenset(), k % 2 == 0), r["t"])]


def test_sorted_json_equals_python(table):
    def plain(t):
        x = json.loads(t)
        return schemaless.compact({k: v for k, v in x.items() if k not in ("a", "US")} if isinstance(x, dict) else x)

    rows = variant_json.with_sorted_json(table, "t", without=("a", "US")).collect()
    assert not [(r["t"], r["bytes"]) for r in rows if r["bytes"] != schemaless._try(plain, r["t"])]


def test_what_crosses(spark, table):
    """Of plain rows none; of random ones those that the module names."""
    native = table.select("t", variant_json.native_form(F.col("t"), DEFAULT).isNull().alias("crosses")).collect()
    crossing = {r["t"] for r in native if r["crosses"]}
    assert {'{"a":1,"a":2}', '{"a":1} x', '{"a":1}],[1', '1,"x"],[2', '{"a":1e2}', '{"a":"\\u00e9"}', "NaN", '{"a ":1,"a":2}', "[[[[[[1]]]]]]"} <= crossing
    assert not crossing & {'{"a":1.50}', '{"a":-0}', '{"a":100.0}', '"US"', " 5 ", "null", "[]", "{}"}
    plain = [t for t in texts() if t and "\\u" not in t and t.isascii() and "e" not in t.lower() and t[0] == "{"]
    events = spark.read.parquet(f"{SF}/events.parquet")
    assert events.where(F.col("props").isNotNull() & variant_json.native_form(F.col("props"), DEFAULT).isNull()).count() == 0 and plain


def test_clashing_names_and_empty_tables(spark):
    df = spark.createDataFrame([('{"b":1,"a":2}', 1)], "t string, data int")
    assert [tuple(r) for r in variant_json.with_json_form(df, "t", Policy("v")).collect()] == [('{"b":1,"a":2}', 1, '{"_policy_version":"v","data":{"a":"2","b":"1"}}')]
    assert variant_json.with_json_form(df.limit(0), "t", Policy("v")).collect() == []
