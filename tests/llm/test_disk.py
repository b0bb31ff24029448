"""What the near-duplicate stage leaves where it is: texts, and tokens but once."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from tallyseal.llm import jaccard_join, pipeline, substring_dedup


@pytest.fixture
def docs(spark):
    word = F.concat(F.lit("w"), (F.col("id") * 131).cast("string"), F.lit("x"))
    rows = spark.range(200).select(F.col("id").alias("doc_id"), F.array_join(F.transform(F.sequence(F.lit(1), F.lit(60)), lambda k: F.concat(word, k.cast("string"))), " ").alias("text"), F.lit("en").alias("lang"))
    near = rows.where("doc_id % 10 = 0").select((F.col("doc_id") + 1000).alias("doc_id"), F.concat("text", F.lit(" end")).alias("text"), "lang")
    return rows.union(near)


def test_texts_are_not_shuffled(spark, docs):
    out = pipeline.near_duplicates(spark, docs, "")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "Join LeftAnti" in plan and "strategy=broadcast" in plan
    assert sorted(r[0] for r in out.select("doc_id").collect()) == list(range(200))


@pytest.mark.parametrize("most", [0, 2_000_000])
def test_many_ids_are_shuffled(spark, docs, monkeypatch, most):
    monkeypatch.setattr(jaccard_join, "FEW_IDS", most)
    ids = docs.where("doc_id % 3 = 0").select("doc_id")
    kept, left = (jaccard_join.picked(docs, ids, how) for how in ("left_semi", "left_anti"))
    assert {r[0] % 3 for r in kept.select("doc_id").collect()} == {0} and kept.count() + left.count() == docs.count()
    assert {r[0] % 3 for r in left.select("doc_id").collect()} == {1, 2}
    found = jaccard_join.jaccard_components(docs, words=5, threshold=(80, 100))
    assert found.where("component_id != doc_id").count() == 20 and found.where("component_id = doc_id").count() == 200


def test_tokens_are_shuffled_once(spark, docs, monkeypatch):
    plans, keep = [], jaccard_join.arrow_map

    def seen(df, f, schema):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, f, schema)

    monkeypatch.setattr(jaccard_join, "arrow_map", seen)
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        jaccard_join.jaccard_components(docs, words=5, threshold=(80, 100))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    (dealt,) = [p for p in plans if "hashpartitioning(held" in p]
    assert dealt.count("hashpartitioning(tok") == 1


@pytest.mark.parametrize("most", [0, 2_000_000])
@pytest.mark.parametrize("shard_words", [0, 240_000])
def test_texts_without_repeats_stay(spark, docs, monkeypatch, most, shard_words):
    monkeypatch.setattr(jaccard_join, "FEW_IDS", most)
    out = substring_dedup.remove_repeats(docs, shard_words=shard_words)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert ("Join LeftSemi" in plan and "Join LeftAnti" in plan and "strategy=broadcast" in plan) == (most > 0)
    got = {r["doc_id"]: (r["n_words"], r["n_removed"]) for r in out.collect()}
    near = {k for k in range(0, 200, 10)}
    assert got == {**{k: (60, 60 * (k in near)) for k in range(200)}, **{k + 1000: (61, 60) for k in near}}


def test_tables_of_repeats_go_when_done(spark, docs, monkeypatch):
    kept, gone = [], []
    keep, drop = substring_dedup.Scratch.keep, substring_dedup.Scratch.drop

    def keeps(self, df, name):
        kept.append((name, list(gone)))
        return keep(self, df, name)

    def drops(self, *tables):
        gone.extend(t._scratch_path.rsplit("-", 1)[-1] for t in tables)
        drop(self, *tables)

    monkeypatch.setattr(substring_dedup.Scratch, "keep", keeps)
    monkeypatch.setattr(substring_dedup.Scratch, "drop", drops)
    substring_dedup.remove_repeats(docs, shard_words=0)
    before = dict(kept)
    assert "distinct" in before["windows"] and {"windows", "wanted", "whole"} <= set(before["hits"]) and {"segments", "verdict"} <= set(gone)
