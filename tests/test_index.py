import hashlib
import json

import pytest
from pyspark.sql import functions as F

from tallyseal.operators.index import HashIndex


def files_read(df):
    """Numbers of files that the scans of an executed plan read."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    found, stack = [], [plan]
    while stack:
        p = stack.pop()
        kind = p.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            stack.append(p.executedPlan())
        elif kind.endswith("QueryStageExec"):
            stack.append(p.plan())
        metrics = p.metrics()
        if metrics.contains("numFiles"):
            found.append(metrics.apply("numFiles").value())
        children = p.children()
        stack += [children.apply(k) for k in range(children.size())]
    return found


def table(spark, names, first=0):
    return spark.createDataFrame([(first + k, n, n and hashlib.sha256(n.encode()).hexdigest()) for k, n in enumerate(names)], "id long, name string, frozen_hash string")


def h(name):
    return hashlib.sha256(name.encode()).hexdigest()


@pytest.fixture
def index(spark, tmp_path):
    made = HashIndex.create(spark, f"file://{tmp_path}/index", digits=1)
    assert made.append(table(spark, [f"n{k}" for k in range(500)] + ["twice", "twice", None]), "first")
    return made


def test_a_lookup_reads_one_bucket(index):
    got = index.lookup(h("twice"))
    assert [(r["name"], r["frozen_hash"]) for r in got.collect()] == [("twice", h("twice"))] * 2 and got.columns == ["id", "name", "frozen_hash"]
    assert files_read(index.lookup(h("twice"))) == [1] and files_read(index.rows())[0] == 16
    assert index.lookup(h("nobody")).collect() == [] and index.lookup("").collect() == [] and index.lookup("zz").collect() == []
    assert index.rows().count() == 502


def test_files_are_sorted_and_have_bloom_filters(spark, index):
    folder = index.path.removeprefix("file://") + "/" + next(iter(index.batches().values()))
    import glob

    import pyarrow.parquet as pq

    paths = glob.glob(f"{folder}/*/*.parquet")
    assert len(paths) == 16
    for p in paths:
        hashes = pq.ParquetFile(p).read(["frozen_hash"]).column(0).to_pylist()
        assert hashes == sorted(hashes)
    jvm = spark._jvm
    source = jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(paths[0]), spark.sparkContext._jsc.hadoopConfiguration())
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(source)
    column = next(c for c in reader.getFooter().getBlocks()[0].getColumns() if c.getPath().toDotString() == "frozen_hash")
    assert column.getBloomFilterOffset() > 0


def test_appends_add_up_once(spark, index):
    assert index.append(table(spark, ["twice", "new"], 1000), "second")
    assert not index.append(table(spark, ["twice", "new"], 1000), "second")
    assert sorted(r["id"] for r in index.lookup(h("twice")).collect()) == [500, 501, 1000]
    assert files_read(index.lookup(h("twice"))) == [2]
    before = sorted(map(tuple, index.rows().collect()))
    index.compact()
    assert files_read(index.lookup(h("twice"))) == [1] and sorted(map(tuple, index.rows().collect())) == before
    assert not index.append(table(spark, ["x"]), "first")
    assert len(index.vacuum()) == 2 and sorted(map(tuple, index.rows().collect())) == before
    assert index.append(table(spark, [], 0), "none") and index.append(table(spark, ["later"], 2000), "third")
    assert [r["id"] for r in index.lookup(h("later")).collect()] == [2000] and index.rows().count() == len(before) + 1


def test_unpublished_batches_are_not_read(spark, index):
    number, state = index._last()
    index._write(table(spark, ["twice"], 7000), state, "_batch=000000000099")  # a writer that dies here
    assert index.lookup(h("twice")).count() == 2
    assert index.vacuum() == ["_batch=000000000099"]


def test_of_two_writers_one_is_refused(spark, index):
    number, state = index._last()
    index._publish(number + 1, state)
    with pytest.raises(RuntimeError, match="another writer"):
        index._publish(number + 1, state)


def test_lookup_of_many(spark, index):
    wanted = spark.createDataFrame([(h("n3"), "a"), (h("twice"), "b"), (None, "c"), (h("nobody"), "d"), (h("n3"), "e")], "asked string, tag string")
    got = sorted((r["tag"], r["name"], r["id"]) for r in index.lookup_all(wanted, "asked").collect())
    assert got == [("a", "n3", 3), ("b", "twice", 500), ("b", "twice", 501), ("e", "n3", 3)]
    with pytest.raises(ValueError, match="name"):
        index.lookup_all(wanted.withColumn("name", F.lit(1)), "asked")
    few = spark.createDataFrame([(h("n3"),)], "asked string")
    assert files_read(index.lookup_all(few, "asked")) == [16] and files_read(index.lookup_all(few, "asked", few=True)) == [1]
    assert [r["id"] for r in index.lookup_all(few, "asked", few=True).collect()] == [3]


def test_wrong_rows_are_refused(spark, index, tmp_path):
    with pytest.raises(ValueError, match="frozen_hash"):
        index.append(spark.range(1), "x")
    with pytest.raises(ValueError, match="in its order"):
        index.append(table(spark, ["a"]).select("name", "id", "frozen_hash"), "x")
    with pytest.raises(FileNotFoundError):
        HashIndex(spark, f"file://{tmp_path}/none").rows()
    with pytest.raises(ValueError, match="digits"):
        HashIndex.create(spark, f"file://{tmp_path}/other", digits=0)
    with pytest.raises(RuntimeError):
        HashIndex.create(spark, index.path)


def test_a_hot_hash_is_spread(spark, tmp_path):
    made = HashIndex.create(spark, f"file://{tmp_path}/hot", digits=1)
    rows = spark.range(0, 40_000, 1, 16).select("id", F.when(F.col("id") % 2 == 0, h("hot")).otherwise(F.sha2(F.col("id").cast("string"), 256)).alias("frozen_hash"))
    before = spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "64k")
    try:
        made.append(rows, "one")
    finally:
        spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", before)
    assert files_read(made.lookup(h("hot")))[0] > 1 and made.lookup(h("hot")).count() == 20_000 and made.rows().count() == 40_000


def test_base64_hashes(spark, tmp_path):
    made = HashIndex.create(spark, f"file://{tmp_path}/b64")
    rows = spark.createDataFrame([(k, x) for k, x in enumerate(["+/ab", "a/cd", "A/cd", "==", "x", "a/cd"])], "id long, frozen_hash string")
    made.append(rows, "one")
    assert {x: sorted(r["id"] for r in made.lookup(x).collect()) for x in ("+/ab", "a/cd", "A/cd", "==", "x")} == {"+/ab": [0], "a/cd": [1, 5], "A/cd": [2], "==": [3], "x": [4]}
    assert json.loads(made._manifests.read("000000000001.json"))["digits"] == 2
