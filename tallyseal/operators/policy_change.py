"""What changing a policy does to a table's classes: which stay, split, merge or mix.

Records have a hash under the old policy and one under the new. Classes are nodes, an edge joins an old and a new class that share a record,
and each connected part of this graph is one change: one old class and one new is no change, one old and several new a split, several old and
one new a merge, several of both a mix. Records are reduced to distinct edges with counts before anything else, so a class of any size is a few
rows; parts are found by large-star and small-star rounds over written tables, in which labels spread to all of a part in a number of rounds
that grows with the logarithm of its size.

Edge cases: a record with a null hash on one side is in no class there (a policy that can't be applied): its class on the other side stands
by itself; records with neither are left out; equal records count each; an empty table has no parts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyseal.sources.shared import scratch_path


class _Tables:
    """Tables written in the shared folder, so that a lost executor costs only its tasks."""

    def __init__(self, spark):
        self.spark, self.path, self.n = spark, scratch_path(spark, "parts"), 0

    def keep(self, df: DataFrame) -> DataFrame:
        self.n += 1
        df.write.parquet(f"{self.path}/{self.n:03d}")
        return self.spark.read.schema(df.schema).parquet(f"{self.path}/{self.n:03d}")


def components(edges: DataFrame) -> DataFrame:
    """(node, part) for edges(a, b): part is the smallest node that is reached."""
    tables = _Tables(edges.sparkSession)
    now = tables.keep(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct())
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(low, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.where("m < u").select("u", F.col("m").alias("v"))).distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        now = tables.keep(large.join(low, "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v")).where("u != v").distinct())
        state = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if state == mark:
            break
        mark = state
    own = now.select(F.col("u").alias("node"), F.col("v").alias("part"))
    return own.union(own.select(F.col("part").alias("node"), "part").distinct())


def class_changes(df: DataFrame, old: str, new: str) -> DataFrame:
    """(part, kind, n, old_classes, new_classes): a row for each part, named by the smallest old hash in it (the smallest new one where it has no old); n counts its records."""
    pairs = df.where(F.col(old).isNotNull() | F.col(new).isNotNull()).groupBy(F.col(old).alias("old"), F.col(new).alias("new")).agg(F.count("*").alias("n"))
    pairs = _Tables(df.sparkSession).keep(pairs)
    a, b = F.concat(F.lit("o"), "old"), F.concat(F.lit("w"), "new")  # old nodes sort before new ones
    parts = components(pairs.where("old is not null and new is not null").select(a.alias("a"), b.alias("b")))
    node = F.coalesce(a, b)
    named = pairs.withColumn("node", node).join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    # distinct classes are counted by aggregation over (part, class), no set of one part's classes is held
    told = named.groupBy("part").agg(F.sum("n").alias("n"))
    olds = named.where("old is not null").select("part", "old").distinct().groupBy("part").agg(F.count("*").alias("old_classes"))
    news = named.where("new is not null").select("part", "new").distinct().groupBy("part").agg(F.count("*").alias("new_classes"))
    out = told.join(olds, "part", "left").join(news, "part", "left").select(F.substring("part", 2, 1 << 30).alias("part"), "n", F.coalesce("old_classes", F.lit(0)).alias("old_classes"), F.coalesce("new_classes", F.lit(0)).alias("new_classes"))
    o, w = F.col("old_classes"), F.col("new_classes")
    kind = F.when(o == 0, "only new").when(w == 0, "only old").when((o == 1) & (w == 1), "same").when(o == 1, "split").when(w == 1, "merged").otherwise("mixed")
    return out.select("part", kind.alias("kind"), "n", "old_classes", "new_classes")
