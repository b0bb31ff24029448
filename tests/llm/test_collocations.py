import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from oracle import both
from pyspark.sql import functions as F

from tallyseal.llm import collocations
from tallyseal.llm.common import Scratch

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans({c: c.lower() for c in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"})


def plain_counts(rows, longest):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\x0a-\x0d]", (text or "").translate(LOWER)):
            w = re.findall("[^\x20\x09]+", piece)
            n[lang or ("und" if lang is None else lang)] += len(w)
            for k in range(1, longest + 1):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    return f, n


def plain(rows, longest=3, least=10, share=(50, 100), top=2000):
    f, n = plain_counts(rows, longest)
    out = []
    for lang, own in f.items():
        cand = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in cand.items():
            for k in range(2, len(p)):
                for i in range(len(p) - k + 1):
                    longer[p[i : i + k]] = max(longer[p[i : i + k]], a)
        kept = []
        for p, a in cand.items():
            if p in longer and share[1] * longer[p] >= share[0] * a:
                continue
            score, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
            kept.append((-score, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        out += [(lang, k, p.decode(), -a, left, right, n[lang], -score) for k, (score, a, p, left, right) in enumerate(sorted(kept)[:top], 1)]
    return set(out)


def found(df):
    assert df.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"] and {f.dataType.simpleString() for f in df.schema if f.name not in ("lang", "phrase")} == {"bigint"}
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def test_query_equals_sql_and_brute_force(spark):
    ours, theirs = both(spark, collocations.op11_collocations, collocations.SQL, SF)
    assert ours == theirs
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("lang", "text").collect()]
    assert found(collocations.op11_collocations(spark, SF)) == plain(rows)


@pytest.fixture(scope="module")
def hard():
    rng = random.Random(3)
    words = ["a", "A", "b", "New", "york", "città", "日本", "x" * 30, "X" * 30, "é", "it's", "\x1c", "a" * 16, "a" * 15 + "b"]
    seps = [" ", "  ", "\t", " \t ", ", ", ".", "\n", "\r\n", " ! ", "\x0b", "\xa0"]
    rows = [("en", "".join(rng.choice(words) + rng.choice(seps) for _ in range(rng.randrange(120)))) for _ in range(120)]
    rows += [(None, "one two three. " * 30), ("", "one two. three " * 20), ("de", None), ("de", ""), ("fr", " . , "), ("es", "y y y y " * 4000), (None, "one two three. " * 30)]
    return rows


@pytest.mark.parametrize("options", [{}, {"longest": 2, "least": 1}, {"longest": 4, "least": 3, "share": (80, 100)}, {"top": 5}, {"longest": 5, "least": 255}])
def test_hard_texts(spark, hard, options):
    df = spark.createDataFrame(hard, "lang string, text string").withColumn("phrase", F.lit("clash")).withColumn("n", F.lit(1)).repartition(3)
    assert found(collocations.collocations(df, **options)) == plain(hard, **options)


@pytest.mark.parametrize("most", [0, 3])
def test_crowded_bitmaps_lose_nothing(spark, hard, monkeypatch, most):
    """Bitmaps of 2^most bytes, which let nearly everything pass."""
    monkeypatch.setattr(collocations, "_power", lambda n, least, top: 8 << most)
    assert found(collocations.collocations(spark.createDataFrame(hard, "lang string, text string").repartition(2))) == plain(hard)


def test_bitmaps_prune(spark):
    """Phrases that occur too rarely hardly reach the second count."""
    rng = random.Random(5)
    rows = [("en", " ".join(f"w{rng.randrange(4000)}" for _ in range(400)) + " often met often met ") for _ in range(60)]
    counted = []
    scratch = Scratch(spark, "t")
    keep = scratch.keep
    scratch.keep = lambda df, name: counted.append((name, t := keep(df, name))) or t
    scratch.drop = lambda *tables: None
    by_size, _ = collocations.frequent_phrases(spark.createDataFrame(rows, "lang string, text string"), scratch, 3, 10)
    made = {name: t for name, t in counted}
    assert made["pass1"].where("phrase is not null").count() > 3000
    assert made["pass2"].where("phrase is not null").select("phrase").distinct().count() < 50 and {r["phrase"] for r in by_size[2].collect()} == {"often met often", "met often met"}


def test_large_counts_are_exact(spark):
    """Products over 64 bits."""
    a, left, right = 3_000_000_019, 3_000_000_029, 7_000_000_001
    df = spark.createDataFrame([(a, left, right)], "a long, l long, r long")
    exact = [F.col(c).cast("decimal(19,0)") for c in ("a", "a", "l", "r")]
    got = df.withColumn("over", (exact[0] * exact[1]).cast("decimal(31,0)") * F.lit(1_000_000).cast("decimal(7,0)")).withColumn("under", exact[2] * exact[3]).select(F.expr("over div under")).first()[0]
    assert got == 10**6 * a * a // (left * right)


def test_empty_table_and_wrong_options(spark):
    none = spark.createDataFrame([], "lang string, text string")
    assert found(collocations.collocations(none)) == set()
    for wrong in ({"longest": 1}, {"least": 0}, {"least": 256}):
        with pytest.raises(ValueError):
            collocations.collocations(none, **wrong)


def test_bits():
    bits = np.zeros(4, np.uint8)
    bits[2] = 0b100
    assert collocations.has_bit(bits, np.array([18, 17, 18 + 32, 0], np.uint64)).tolist() == [True, False, True, False]
