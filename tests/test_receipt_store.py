import json

import pytest
from pyspark.sql import functions as F

from tallyseal.operators import prove, receipts
from tallyseal.operators.receipt_store import ReceiptStore
from tallyseal.plans import catalog

VECTOR = "id string, description string, a_json string, b_json string, expect_same boolean, set_fields array<string>"
VECTORS = [("w", "white space", '"a b"', '" a  b "', True, None), ("o", "other", '{"v":1}', '{"v":2}', False, None), ("n", "number", '{"v":10}', '{"v":10.0}', True, None)]


def signed(spark, n=40):
    rows = spark.range(n).select(F.col("id"), F.concat(F.lit("cf"), "id").alias("canonical_form"))
    return receipts.sign(rows.withColumn("frozen_hash", F.sha2("canonical_form", 256)), catalog._keys(spark), "good", when=F.lit(catalog.WHEN))


def test_receipts_and_manifest_agree(spark, tmp_path):
    """Ids are made at random, once."""
    store = ReceiptStore(spark, f"file://{tmp_path}/store")
    bad = signed(spark, 3).withColumn("envelope", F.when(F.col("id") == 0, F.lit(None)).when(F.col("id") == 1, F.struct(F.lit("t").alias("payloadType"), F.lit("?").alias("payload"), F.array().cast("array<struct<keyid:string,sig:string>>").alias("signatures"))).otherwise(F.col("envelope")))
    assert store.append(signed(spark), "one") == {"rows": 40, "receipts": 40, "unsigned": 0, "unreadable": 0}
    assert store.append(bad, "two") == {"rows": 3, "receipts": 2, "unsigned": 1, "unreadable": 1}
    assert store.append(signed(spark, 7), "one") == {"rows": 40, "receipts": 40, "unsigned": 0, "unreadable": 0} and set(store.batches()) == {"one", "two"}
    texts = [r["value"] for r in store.receipts().collect()]
    ids = {r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(receipts.payload_of(receipts.parse_envelope(F.col("t")))["receipt_id"]).collect()}
    manifest = store.manifest().collect()
    assert len(texts) == len(manifest) == 42 and ids == {r["receipt_id"] for r in manifest} and len(ids) == 42  # one of them null
    assert receipts.verify(store.rows("one"), catalog._keys(spark), id_col="id").where("valid").count() == 40
    assert all(r["file"].startswith("batch-0000") for r in manifest)


def test_a_killed_job_leaves_nothing(spark, tmp_path):
    store = ReceiptStore(spark, f"file://{tmp_path}/store")
    store.append(signed(spark, 5), "one")

    @F.udf("string")
    def dies(k):
        if k == 3:
            raise RuntimeError("killed")
        return str(k)

    with pytest.raises(Exception, match="killed"):
        store.append(signed(spark, 5).withColumn("x", dies("id")), "two")
    assert set(store.batches()) == {"one"} and store.manifest().count() == 5 == store.receipts().count()
    # the batch's files are there, but its state file isn't: a writer that dies before it commits
    number, state = store._last()
    store._states.create(f"{number + 1:012d}.json", json.dumps(state))
    before = store._last
    object.__setattr__(store, "_last", lambda: (number, state))
    with pytest.raises(RuntimeError, match="another writer"):
        store.append(signed(spark, 5), "three")
    object.__setattr__(store, "_last", before)
    assert store.manifest().count() == 5


def test_refused_rows_and_empty_batches(spark, tmp_path):
    store = ReceiptStore(spark, f"file://{tmp_path}/store")
    with pytest.raises(FileNotFoundError):
        store.rows()
    with pytest.raises(ValueError):
        store.append(signed(spark).withColumn("Receipt_Id", F.lit(1)), "x")
    with pytest.raises(ValueError):
        store.append(spark.range(1), "x")
    assert store.append(signed(spark).limit(0), "none") == {"rows": 0, "receipts": 0, "unsigned": 0, "unreadable": 0} and store.manifest().count() == 0
    with pytest.raises(KeyError):
        store.rows("other")


@pytest.mark.parametrize("written", [True, False])
def test_prove_evaluates_vectors_once(spark, tmp_path, written):
    counted = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def seen(x):
        counted.add(1)
        return x

    vectors = spark.createDataFrame(VECTORS, VECTOR).coalesce(1).withColumn("a_json", seen("a_json"))
    out = f"file://{tmp_path}/out" if written else None
    n = prove.prove(vectors, catalog._keys(spark), "good", out=out, when=F.lit(catalog.WHEN))
    assert (n["total"], n["passed"], n["failed"], n["receipts"], n["receipts_valid"], n["ok"]) == (3, 3, 0, 4, 4, True) and counted.value == 3
    if written:
        ids = {r["receipt_id"] for r in spark.read.json(f"{out}/manifest").collect()}
        back = spark.read.text(f"{out}/receipts").select(receipts.payload_of(receipts.parse_envelope(F.col("value")))["receipt_id"].alias("i"))
        assert ids == {r["i"] for r in back.collect()} and len(ids) == 4 and spark.read.json(f"{out}/results").count() == 3


def test_save_agrees(spark, tmp_path):
    assert receipts.save(signed(spark, 6), f"file://{tmp_path}/s")["receipts"] == 6
    ids = {r["receipt_id"] for r in spark.read.json(f"file://{tmp_path}/s/manifest").collect()}
    back = spark.read.text(f"file://{tmp_path}/s/receipts").select(receipts.payload_of(receipts.parse_envelope(F.col("value")))["receipt_id"].alias("i"))
    assert ids == {r["i"] for r in back.collect()} and len(ids) == 6
