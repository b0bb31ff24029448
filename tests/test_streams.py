import random

from pyspark.sql import functions as F

from tallyseal.operators import hashing, sameness
from tallyseal.streaming import streams


def test_running_classes_equal_a_batch_after_restarts(spark, tmp_path):
    """Three runs of a stream, each started anew from its checkpoint, with late rows and classes of all sizes."""
    rng = random.Random(9)
    source, out, marks = (f"file://{tmp_path}/{x}" for x in ("in", "out", "checkpoint"))
    schema = "id long, ts timestamp, name string"
    for run in range(3):
        rows = [(run * 1000 + k, f"2024-0{rng.randrange(1, 9)}-01 00:00:00", rng.choice(["  A b", "A  b ", "US", "United States", f"own {run} {k}", None])) for k in rng.sample(range(1000), 60)]
        spark.createDataFrame(rows, "id long, t string, name string").select("id", F.col("t").cast("timestamp").alias("ts"), "name").coalesce(2).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        query = streams.keep_classes(streams.running_classes(streams.frozen(stream, ["name"]), "id"), out, marks).trigger(availableNow=True).start()
        query.awaitTermination()
        everything = hashing.with_hash(spark.read.schema(schema).parquet(source), ["name"])
        want = {tuple(r) for r in sameness.classes(everything, "id").collect()}
        got = [tuple(r) for r in streams.read_classes(spark, out).collect()]
        assert set(got) == want and len(got) == len(want)


def test_a_batch_that_is_tried_again_counts_once(spark, tmp_path):
    out = f"file://{tmp_path}/out"
    for number, rows in ((0, [("a", 1, 5), ("b", 2, 6)]), (1, [("a", 3, 4)]), (1, [("a", 3, 4)])):
        spark.createDataFrame(rows, "frozen_hash string, n long, first_id long").write.mode("overwrite").parquet(f"{out}/batch={number}")
    assert {tuple(r) for r in streams.read_classes(spark, out).collect()} == {("a", 3, 4), ("b", 2, 6)}
