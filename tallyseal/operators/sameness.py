"""Which records are the same: lookups, classes and joins by frozen hash."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def lookup(df: DataFrame, value: str, hash_col: str = "frozen_hash") -> DataFrame:
    return df.where(F.col(hash_col) == value)


def classes(df: DataFrame, id_col: str, hash_col: str = "frozen_hash") -> DataFrame:
    """One row a class with its size and smallest id; partial aggregation keeps hot classes small in the shuffle."""
    return df.groupBy(hash_col).agg(F.count("*").alias("n"), F.min(id_col).alias(f"first_{id_col}"))


def match(left: DataFrame, right: DataFrame, hash_col: str = "frozen_hash") -> DataFrame:
    return left.join(right, hash_col)


def match_counts(left: DataFrame, right: DataFrame, id_col: str, hash_col: str = "frozen_hash") -> DataFrame:
    """One row a class met on both sides, with its size and smallest id on each: what match() tells, without a row for each pair of a hot class."""
    sides = [x.groupBy(hash_col).agg(F.count("*").alias(f"n_{s}"), F.min(id_col).alias(f"first_{s}")) for x, s in ((left, "left"), (right, "right"))]
    return sides[0].join(sides[1], hash_col)


def keep_first(df: DataFrame, order: str, hash_col: str = "frozen_hash") -> DataFrame:
    """The row with the smallest order of each class, nulls last: an aggregate, not a window, so that a hot class is reduced before the shuffle."""
    return df.groupBy(hash_col).agg(F.min_by(F.struct("*"), F.struct(F.col(order).isNull(), F.col(order))).alias("_row")).select("_row.*")


def policy_diff(df: DataFrame, one: str, two: str) -> DataFrame:
    """Classes under the first hash that the second splits: the number of second hashes in each."""
    return df.groupBy(one).agg(F.count("*").alias("n"), F.count_distinct(two).alias("parts"))


def rank_in_class(df: DataFrame, order: str, hash_col: str = "frozen_hash") -> DataFrame:
    return df.withColumn("place", F.row_number().over(Window.partitionBy(hash_col).orderBy(order)))
