"""Canonicalization, dedup and receipt verification over unbounded tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyseal.operators import hashing
from tallyseal.plans.policy import DEFAULT, Policy


def frozen(stream: DataFrame, columns: list[str] | None = None, policy: Policy = DEFAULT) -> DataFrame:
    """The batch expression: no state."""
    return hashing.with_hash(stream, columns, policy=policy)


def first_seen(stream: DataFrame, time_col: str, delay: str = "1 hour", hash_col: str = "frozen_hash") -> DataFrame:
    """The first row of each hash; state older than the watermark goes."""
    return stream.withWatermark(time_col, delay).dropDuplicatesWithinWatermark([hash_col])


def windowed_classes(stream: DataFrame, time_col: str, width: str = "1 day", delay: str = "1 hour", hash_col: str = "frozen_hash") -> DataFrame:
    """Class sizes in tumbling windows."""
    return stream.withWatermark(time_col, delay).groupBy(F.window(time_col, width), hash_col).agg(F.count("*").alias("n"))


def running_classes(stream: DataFrame, id_col: str, hash_col: str = "frozen_hash") -> DataFrame:
    """(hash, n, first id) of every class so far, late rows and all: a row each time a class grows, to be written in update mode. State is a row a class and is never dropped; rows with a null hash make one class, as in sameness.classes."""
    return stream.groupBy(hash_col).agg(F.count("*").alias("n"), F.min(id_col).alias(f"first_{id_col}"))


def keep_classes(running: DataFrame, path: str, checkpoint: str):
    """A writer of running_classes: each micro-batch is a folder of its number, written over if the batch is tried again, so that a restarted stream repeats nothing. Start it with a trigger of choice."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={number}")

    return running.writeStream.outputMode("update").option("checkpointLocation", checkpoint).foreachBatch(write)


def read_classes(spark: SparkSession, path: str, hash_col: str = "frozen_hash") -> DataFrame:
    """The classes as the last micro-batches that touched them left them."""
    found = spark.read.parquet(path)
    return found.groupBy(hash_col).agg(F.max_by(F.struct(*[c for c in found.columns if c not in (hash_col, "batch")]), F.col("batch")).alias("_c")).select(hash_col, "_c.*")
