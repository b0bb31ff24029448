"""Conformance run: sameness vectors as one table, with receipts, counts and a summary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from tallyseal.functions import schemaless
from tallyseal.operators import hashing, receipts
from tallyseal.operators.receipt_store import ReceiptStore
from tallyseal.plans.policy import DEFAULT, Policy
from tallyseal.sources.shared import scratch_path


def run(vectors: DataFrame, policy: Policy = DEFAULT, only: str | None = None) -> DataFrame:
    """vectors(id, description, a_json, b_json, expect_same, set_fields) with both forms and hashes and whether the expectation holds."""
    v = vectors if only is None else vectors.where(F.col("id") == only)
    sets = F.coalesce("set_fields", F.array().cast("array<string>"))
    v = v.withColumn("cf_a", schemaless.canonical_json_sets(F.col("a_json"), sets, policy)).withColumn("cf_b", schemaless.canonical_json_sets(F.col("b_json"), sets, policy))
    v = v.withColumn("fh_a", hashing.digest(F.col("cf_a"), policy)).withColumn("fh_b", hashing.digest(F.col("cf_b"), policy))
    same = F.col("fh_a") == F.col("fh_b")
    return v.withColumn("actual_same", same).withColumn("passed", F.coalesce(same == F.col("expect_same"), F.lit(False)))


def counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))


def to_sign(results: DataFrame) -> DataFrame:
    """One row a distinct hash of a vector: one where both are equal, two otherwise."""
    pairs = F.array_distinct(F.array(F.struct(F.col("fh_a").alias("fh"), F.col("cf_a").alias("cf")), F.struct(F.col("fh_b").alias("fh"), F.col("cf_b").alias("cf"))))
    return results.select("id", F.explode(pairs).alias("x")).select("id", F.col("x.fh").alias("frozen_hash"), F.col("x.cf").alias("canonical_form"))


def prove(vectors: DataFrame, keys: DataFrame | None, keyid: str | None, *, public: DataFrame | None = None, policy: Policy = DEFAULT, when: Column | None = None, out: str | None = None, only: str | None = None) -> dict:
    """Runs, signs, verifies with an independently loaded key table and writes what it found. Without keys nothing is signed.

    Vectors are evaluated once, and receipts signed once: both are written (under `out`, else in the shared scratch folder), counted in the same pass, and read back for what follows.
    """
    spark = vectors.sparkSession
    base = f"{out}/stage" if out else scratch_path(spark, "prove")
    seen = Observation()
    made = run(vectors, policy, only).observe(seen, F.count(F.lit(1)).alias("total"), F.count_if("passed").alias("passed"), F.count_if(~F.col("passed")).alias("failed"))
    made.write.mode("overwrite").parquet(f"{base}/results")
    n = {k: int(v or 0) for k, v in seen.get.items()} | {"receipts": 0, "receipts_valid": 0, "policy_version": policy.version, "hash_algorithm": policy.digest}
    results = spark.read.schema(made.schema).parquet(f"{base}/results")
    if keys is not None:
        signed = receipts.sign(to_sign(results), keys, keyid, policy_version=policy.version, algorithm=policy.digest, when=when).withColumn("rid", F.concat_ws(":", "id", "frozen_hash"))
        store = ReceiptStore(spark, f"{out}/store" if out else f"{base}/store")
        n["receipts"] = store.append(signed, "all")["rows"]
        n["receipts_valid"] = receipts.verify(store.rows("all"), public if public is not None else keys, id_col="rid").agg(F.count_if("valid")).first()[0]
        if out:
            store.receipts("all").write.text(f"{out}/receipts")
            store.manifest("all").select("receipt_id", "frozen_hash").write.json(f"{out}/manifest")
    n["ok"] = n["failed"] == 0 and n["receipts"] == n["receipts_valid"] and n["total"] > 0
    if out:
        results.select("id", "description", "expect_same", "actual_same", "passed", "fh_a", "fh_b").write.json(f"{out}/results")
        spark.createDataFrame([(line,) for line in summary(n).split("\n")], "value string").coalesce(1).write.text(f"{out}/summary")
    return n


def summary(n: dict) -> str:
    return "\n".join([f"Policy {n['policy_version']}, {n['hash_algorithm']}", f"Vectors: {n['passed']} of {n['total']} as expected", f"Receipts: {n['receipts_valid']} of {n['receipts']} verified", "Result: " + ("PASS" if n["ok"] else "FAIL"), "Records with one hash are equal under the policy; look them up by the hash."])
