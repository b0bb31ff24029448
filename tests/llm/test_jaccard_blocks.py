"""Names of sets, and large groups in blocks with hubs."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyseal.llm import jaccard_join
from tallyseal.llm.common import Scratch


def test_names_of_sets_are_their_own(spark):
    """Keys that share the first half, or a name already given anew, get different names; equal keys get one."""
    keys = [(1, 1), (1, 2), (1, 2), (2, 1), (3, 3), (None, None)]
    sets = spark.createDataFrame([(k, a, b, 5) for k, (a, b) in enumerate(keys)], "doc_id long, k1 long, k2 long, n long")
    third = sets.select(F.xxhash64(F.lit(1).cast("long"), F.lit(2).cast("long"), F.lit(1)).alias("x")).first()["x"]
    sets = sets.union(spark.createDataFrame([(6, third, 9, 5)], sets.schema))
    rows, who = jaccard_join.named(sets, Scratch(spark, "test"))
    got = {r["doc_id"]: r["sid"] for r in rows.collect()}
    assert got[1] == got[2] and got[5] is None and got[3] == 2 and got[4] == 3
    assert len({got[k] for k in (0, 1, 3, 4, 6)}) == 5
    assert sorted((r["k1"], r["k2"], r["doc_id"]) for r in who.collect()) == sorted([(1, 1, 0), (1, 2, 1), (2, 1, 3), (3, 3, 4), (third, 9, 6)])
    assert jaccard_join.set_key(np.array([1, 2], np.uint64)) != jaccard_join.set_key(np.array([1, 3], np.uint64))


def _large(spark, sets):
    return spark.createDataFrame([(7, k, len(s), bytearray(np.array(sorted(s), np.uint64).tobytes())) for k, s in enumerate(sets)], "grp long, sid long, n long, data binary").withColumn("bin", jaccard_join.size_range(90, 100))


def _solved(rows):
    dealt = rows.repartition(4, "grp").sortWithinPartitions("grp", "side", "n", "sid").select("grp", "side", "sid", "data")
    return dealt.mapInArrow(lambda it: jaccard_join._link_groups(it, 90, 100), "a long, b long")


@pytest.mark.parametrize("shape", ["family", "chain", "apart", "mixed"])
def test_hubs_and_blocks_lose_no_link(spark, shape):
    """Components of blocks with hubs and of the pairs that are left, against all pairs; a family that the hubs connect has no pair left."""
    rng, sets = random.Random(5), []
    if shape in ("family", "mixed"):
        sets += [{*range(100)} - {rng.randrange(100)} for _ in range(60)] + [{*range(100)} | {1000 + k} for k in range(60)]
    if shape in ("chain", "mixed"):
        sets += [{*range(5000 + 4 * k, 5100 + 4 * k)} for k in range(120)]
    if shape in ("apart", "mixed"):
        sets += [{*range(9000, 9080)} | {10_000 + 100 * k + j for j in range(20 + k % 9)} for k in range(120)]
    sets = [set(x) for x in {frozenset(s) for s in sets}]
    rng.shuffle(sets)
    up = list(range(len(sets)))

    def root(k):
        while up[k] != k:
            k = up[k]
        return k

    for a in range(len(sets)):
        for b in range(a):
            i = len(sets[a] & sets[b])
            if 100 * i >= 90 * (len(sets[a]) + len(sets[b]) - i):
                x, y = sorted((root(a), root(b)))
                up[y] = x
    large, scratch = _large(spark, sets), Scratch(spark, "test")
    near = scratch.keep(_solved(jaccard_join.hub_blocks(large, 10**6, 40)), "near")
    labels = jaccard_join.components(near, scratch).withColumnsRenamed({"node": "sid", "label": "part"})
    left = scratch.keep(jaccard_join.block_pairs(large, labels, 10**6, 40), "left")
    assert left.isEmpty() == (shape == "family")
    got = {r["node"]: r["label"] for r in jaccard_join.components(near.union(_solved(left)), scratch).collect()}
    assert {k: got.get(k, k) for k in range(len(sets))} == {k: root(k) for k in range(len(sets))}
