"""Readers of vectors, receipts and key tables, and the writer of public keys."""

from __future__ import annotations

import json

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.operators import keys as K

_S = T.StringType()
VECTOR = T.StructType([T.StructField(k, t) for k, t in {"id": _S, "description": _S, "a_json": _S, "b_json": _S, "expect_same": T.BooleanType(), "set_fields": T.ArrayType(_S)}.items()])


JUDGED = T.StructType([*VECTOR.fields, T.StructField("reason", _S)])


def _judged(line: str) -> dict:
    """A vector, or why the line is none."""
    bad = dict.fromkeys(JUDGED.names)
    try:
        d = json.loads(line)
    except (ValueError, RecursionError):
        return bad | {"reason": "no JSON"}
    if not isinstance(d, dict):
        return bad | {"reason": "no object"}
    missing = [k for k in ("id", "a", "b", "expect_same") if k not in d]
    if missing:
        return bad | {"reason": f"no {', '.join(missing)}"}
    sets = d.get("set_fields")
    good = {"id": isinstance(d["id"], str), "expect_same": isinstance(d["expect_same"], bool), "description": isinstance(d.get("description", ""), str), "set_fields": sets is None or (isinstance(sets, list) and all(isinstance(x, str) for x in sets))}
    wrong = [k for k, v in good.items() if not v]
    if wrong:
        return bad | {"reason": f"wrong type of {', '.join(wrong)}"}
    return {"id": d["id"], "description": d.get("description", ""), "a_json": json.dumps(d["a"]), "b_json": json.dumps(d["b"]), "expect_same": d["expect_same"], "set_fields": sets, "reason": None}


@F.pandas_udf(JUDGED)
def _vector(s: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([_judged(x) for x in s], columns=JUDGED.names, dtype=object)


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, block, at, value): `at` ascends within a file's block."""
    return spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), "value")


def read_vectors(spark: SparkSession, path: str) -> DataFrame:
    """Sameness vectors of JSON lines; blank and malformed lines are left out, the latter being read_rejects'. a and b stay JSON text, whatever their shape."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    return lines.select(_vector("value").alias("v")).where("v.reason is null").select(*[F.col(f"v.{k}").alias(k) for k in VECTOR.names])


def read_rejects(spark: SparkSession, path: str) -> DataFrame:
    """(file, line, reason, value): the lines that are neither blank nor vectors, with their number in their file (from 1).

    Files are read in blocks by many tasks: each block's lines are counted, and only rejected lines meet the sums of the blocks before theirs.
    """
    lines = _lines(spark, path)
    blocks = lines.groupBy("file", "block").agg(F.min("at").alias("first"), F.count("*").alias("n"))
    before = Window.partitionBy("file").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select("file", "block", "first", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"))
    bad = lines.where(F.trim("value") != "").withColumn("reason", _vector("value")["reason"]).where("reason is not null")
    return bad.join(starts, ["file", "block"]).select("file", (F.col("before") + F.col("at") - F.col("first") + 1).alias("line"), "reason", "value")


def read_receipts(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(id, receipt): each file whole, id its path."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("id"), F.col("value").alias("receipt"))


def read_keys(spark: SparkSession, path: str) -> DataFrame:
    """Key rows of a registry or public export; `current` marks the active one."""
    schema = f"active_keyid string, exported_utc string, keys array<struct<{K.SCHEMA.replace(' string', ':string').replace(' boolean', ':boolean')}>>"
    return spark.read.schema(schema).json(path, multiLine=True).select("active_keyid", F.inline("keys")).withColumn("current", F.col("keyid").eqNullSafe(F.col("active_keyid"))).drop("active_keyid")


def write_public_keys(keys: DataFrame, path: str) -> None:
    K.public_keys(keys).write.json(path)
