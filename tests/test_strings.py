"""Strings in the JVM: quick check of Unicode forms, escapes and normalization, against Python's own."""

import json
import random
import unicodedata

import pytest
from pyspark.sql import functions as F

from tallyseal.functions import schemaless, strings
from tallyseal.operators import hashing
from tallyseal.plans.policy import DEFAULT, Policy

SF = "/root/testdata/sf0.001"


def hard_strings():
    rng = random.Random(12)
    every = [chr(c) for c in [*range(0x20000), *range(0x2F7F0, 0x2FA20), 0xE0001, 0xE0100, 0xF0000, 0x10FFFF] if not 0xD800 <= c <= 0xDFFF]
    some = ["US", "u.s.", "USA", "UK", "é", "é", "́", "a", " ", "\t", "\xa0", " ", "²", "½", "Ⅷ", "_", "‍", "ı", "İ", "ſ", "K", "ß", "Σ", "ς", "가", "가", "\U0001f600", "日", "Ⓐ", "\x00", "\x7f", '"', "\\", "ः", "⃝", "٣", "ﬁ", "Å"]
    out = ["".join(rng.choice(some) for _ in range(rng.randrange(6))) for _ in range(4000)]
    out += ["".join(rng.sample(every, 8)) for _ in range(1500)] + ["".join(every[k : k + 100]) for k in range(0, len(every), 100)] + ["x" + c + "US" for c in every[0x80:0x3000]]
    return out + ["", None, "é" * 50_000, "".join(every[0x4E00:0x4F00])]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(k, s) for k, s in enumerate(hard_strings())], "id long, s string").repartition(8).cache()


@pytest.mark.parametrize("form", ["NFC", "NFD", "NFKC", "NFKD"])
def test_quick_check_lets_nothing_through(table, form):
    rows = table.select("s", strings.may_change(F.col("s"), form).alias("may"), strings.unicode_form(F.col("s"), form).alias("got")).collect()
    assert all(r["got"] == (r["s"] and unicodedata.normalize(form, r["s"])) for r in rows)
    assert all(unicodedata.is_normalized(form, r["s"]) for r in rows if r["s"] and not r["may"])
    plain = [r for r in rows if r["s"] and all(ord(c) < 0x300 for c in r["s"]) and not r["s"].isascii()]
    assert form not in ("NFC",) or not any(r["may"] for r in plain)


def test_json_text(table):
    rows = table.select("s", strings.json_text(F.col("s")).alias("got"), strings.json_text(F.col("s"), native=True).alias("native")).collect()
    assert all(r["got"] == r["native"] == (None if r["s"] is None else json.dumps(r["s"])) for r in rows)


@pytest.mark.parametrize("policy", [DEFAULT, DEFAULT.with_(lower=True), Policy("x"), Policy("x", unicode_form="NFKC", lower=True, synonyms=(("straße", "street"),))])
def test_json_normal_equals_python(table, policy):
    rows = table.select("s", strings.json_normal(F.col("s"), policy).alias("got")).collect()
    bad = [(r["s"], r["got"], json.dumps(schemaless.normalize(r["s"], policy))) for r in rows if r["s"] is not None and r["got"] != json.dumps(schemaless.normalize(r["s"], policy))]
    assert not bad and all(r["got"] is None for r in rows if r["s"] is None)


def test_few_documents_cross(spark):
    """Texts with letters beyond ASCII stay in the JVM; only those with marks or very many different characters don't."""
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("text")
    wide, crossing = docs.select(F.count_if(F.rlike("text", F.lit(r"[^\x{00}-\x{7f}]"))), F.count_if(strings.crosses(F.col("text"), DEFAULT))).first()
    marks = sum(1 for (t,) in docs.collect() if t and not unicodedata.is_normalized("NFC", t))
    assert wide > 20 and marks <= crossing <= marks + 2


def test_hashes_of_documents_do_not_change(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    got = {r["doc_id"]: r["cf"] for r in docs.select("doc_id", hashing.value_form(docs, "text", policy=DEFAULT).alias("cf")).collect()}
    assert got == {r["doc_id"]: schemaless.canonical_text(json.dumps(r["text"]), DEFAULT) for r in docs.collect() if r["text"] is not None}


def rule_sets():
    rng = random.Random(13)
    words = ["us", "usa", "u.s.", "u.s.a.", "uk", "u.k.", "a b", "b c", "c", "ab", "ba", "x.", "n.y.", "new york", "s us"]
    names = ["United States", "United Kingdom", "us", "Big Apple", "b", "A us", "x. y", "$1", "a\\b"]
    return [tuple((v, rng.choice(names)) for v in rng.sample(words, rng.randrange(1, 6))) for _ in range(60)]


def test_synonyms_in_one_pass_equal_those_in_a_row(spark):
    rng = random.Random(14)
    parts = ["us", "US", "usa", "U.S.", "u.s.a.", "U.S.A", "uk", "u.k.", "a b c", "ab", "x.", "n.y.", "New York", " ", " ", ".", "-", "s", "1", ".us", "$"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(400)]
    df = spark.createDataFrame([(t,) for t in texts], "s string").cache()
    policies = [Policy("x", synonyms=rules) for rules in rule_sets()] + [DEFAULT]
    rows = df.select("s", *[strings.synonyms(F.col("s"), p.rules()).alias(str(k)) for k, p in enumerate(policies)]).collect()
    plain = Policy("x", trim=False, collapse=False)
    for k, p in enumerate(policies):
        own = plain.with_(synonyms=p.synonyms)
        assert [r[str(k)] for r in rows] == [schemaless.normalize(r["s"], own) for r in rows], p.rules()
    alone = [p for p in policies if strings.independent(p.rules())]
    assert len(alone) > 5 and len(alone) < len(policies)


def test_plan_has_a_pass_for_each_name(spark):
    df = spark.range(1).select(F.col("id").cast("string").alias("s"))
    plan = df.select(strings.synonyms(F.col("s"), DEFAULT.rules()).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 2
    plan = df.select(strings.synonyms(F.col("s"), [("a b", "x"), ("b c", "y"), ("x", "z")]).alias("t"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("regexp_replace(") == 3
