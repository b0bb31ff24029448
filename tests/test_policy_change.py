import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tallyseal.operators import policy_change


def plain(rows):
    up = {}

    def root(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    kept = [(a and "o" + a, b and "w" + b) for a, b in rows if a is not None or b is not None]
    for a, b in kept:
        if a and b:
            x, y = root(a), root(b)
            up[max(x, y)] = min(x, y)
    n, olds, news = defaultdict(int), defaultdict(set), defaultdict(set)
    for a, b in kept:
        part = root(a or b)
        n[part] += 1
        if a:
            olds[part].add(a)
        if b:
            news[part].add(b)
    kinds = {}
    for p in n:
        o, w = len(olds[p]), len(news[p])
        kinds[p] = "only new" if not o else "only old" if not w else "same" if o == w == 1 else "split" if o == 1 else "merged" if w == 1 else "mixed"
    return {(p[1:], kinds[p], n[p], len(olds[p]), len(news[p])) for p in n}


@pytest.mark.parametrize("seed", [1, 2])
def test_changes_equal_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = [(f"{rng.randrange(60):02}", f"{rng.randrange(60):02}") for _ in range(45)] + [(f"x{k}", f"y{k // 3}") for k in range(12)] + [(f"s{k // 4}", f"t{k}") for k in range(12)] + [("one", "one")] * 50
    rows += [(f"p{k:03}", f"q{(k + d):03}") for k in range(40) for d in (0, 1)]  # a long path
    rows += [(None, None), (None, "n1"), ("m1", None), ("one", None), (None, "one"), (None, "y0")]
    got = policy_change.class_changes(spark.createDataFrame(rows, "old string, b string").withColumn("n", F.lit("clash")), "old", "b")
    assert got.columns == ["part", "kind", "n", "old_classes", "new_classes"]
    assert {tuple(r) for r in got.collect()} == plain(rows) and got.count() == len(plain(rows))


def test_no_records(spark):
    assert policy_change.class_changes(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []
