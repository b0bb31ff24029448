"""Canonical form, frozen hash and input hash of rows or columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.plans import compiler
from tallyseal.plans.policy import DEFAULT, Policy


def digest(text: Column, p: Policy = DEFAULT) -> Column:
    hexed = F.sha2(text, p.bits)
    return hexed if p.output == "hex" else F.translate(F.base64(F.unhex(hexed)), "\r\n", "")


def row_form(df: DataFrame, columns: list[str] | None = None, *, policy: Policy = DEFAULT, set_fields=(), bind: bool = True) -> Column:
    """Canonical form of a row as an object of its columns; the policy's drops become column pruning."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    text = compiler.Compiler(policy, frozenset(set_fields)).fields(T.StructType(fields), lambda f: F.col(f"`{f.name}`"))
    return compiler.wrap(text, policy) if bind else text


def with_hash(df: DataFrame, columns: list[str] | None = None, *, policy: Policy = DEFAULT, set_fields=(), bind: bool = True, form: str = "canonical_form", hash_col: str = "frozen_hash") -> DataFrame:
    """df with canonical form and frozen hash; the form is projected first, so it is computed once."""
    return df.withColumn(form, row_form(df, columns, policy=policy, set_fields=set_fields, bind=bind)).withColumn(hash_col, digest(F.col(form), policy))


def value_form(df: DataFrame, column: str, *, policy: Policy = DEFAULT, set_fields=(), bind: bool = True) -> Column:
    return compiler.canonical_form(df.schema[column].dataType, F.col(f"`{column}`"), policy, set_fields, bind)


def input_hash(df: DataFrame, columns: list[str] | None = None, policy: Policy = DEFAULT) -> Column:
    """Hex digest of the row's sorted compact JSON, without normalization."""
    fields = [f for f in df.schema.fields if columns is None or f.name in columns]
    text = compiler.Compiler(Policy("raw"), raw=True).fields(T.StructType(fields), lambda f: F.col(f"`{f.name}`"))
    return F.sha2(text, policy.bits)
