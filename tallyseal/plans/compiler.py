"""Typed path: a policy and a schema become one Column with the canonical form."""

from __future__ import annotations


import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tallyseal.functions import numbers, schemaless, strings, timestamps
from tallyseal.plans.policy import Policy


def normal_name(name: str, p: Policy) -> str:
    return schemaless.normalize(name, p)


def _texted(kind: T.DataType) -> T.DataType:
    """The type with floating numbers as text."""
    match kind:
        case T.DoubleType() | T.FloatType():
            return T.StringType()
        case T.ArrayType():
            return T.ArrayType(_texted(kind.elementType))
        case T.MapType():
            return T.MapType(kind.keyType, _texted(kind.valueType))
        case T.StructType():
            return T.StructType([T.StructField(f.name, _texted(f.dataType)) for f in kind.fields])
    return kind


def _holds(kind: T.DataType, *kinds: type) -> bool:
    inner = {T.ArrayType: lambda k: [k.elementType], T.MapType: lambda k: [k.keyType, k.valueType], T.StructType: lambda k: [f.dataType for f in k.fields]}
    return isinstance(kind, kinds) or any(_holds(x, *kinds) for x in inner.get(type(kind), lambda _: [])(kind))


def prepared(kind: T.DataType, c: Column, p: Policy, raw: bool) -> Column:
    """A collection with strings in the Unicode form and floating numbers as text: what lambdas can't call Python for. ASCII collections without floating numbers stay in the JVM."""
    floats, texts = _holds(kind, T.DoubleType, T.FloatType), _holds(kind, T.StringType) and not raw
    if not floats and not texts:
        return c

    def number(x, single: bool) -> str:
        value = float(str(np.float32(x))) if single else float(x)
        return schemaless.compact(value) if raw or not p.numbers else numbers.number_text(value)

    def fix(x, k: T.DataType):
        if x is None:
            return None
        match k:
            case T.StringType():
                return x if raw else unicodedata.normalize(p.unicode_form, x)
            case T.DoubleType() | T.FloatType():
                return number(x, isinstance(k, T.FloatType))
            case T.ArrayType():
                return [fix(v, k.elementType) for v in x]
            case T.MapType():
                return [(fix(a, k.keyType), fix(v, k.valueType)) for a, v in (x.items() if isinstance(x, dict) else x)]
            case T.StructType():
                return {f.name: fix(x[f.name], f.dataType) for f in k.fields}
        return x

    target = _texted(kind)
    arrow = to_arrow_type(target)

    @F.arrow_udf(target)
    def run(a: pa.Array) -> pa.Array:
        return pa.array([fix(x, kind) for x in a.to_pylist()], arrow)

    if floats:
        return run(c)
    odd = F.rlike(F.to_json(c), F.lit(r"[^\x{00}-\x{7f}]"))
    return F.coalesce(run(F.when(odd, c)), c)


class Compiler:
    """text(kind, c) is the JSON text of a value, null where it is null; spaced gives the text with ", " and ": " that orders sets."""

    def __init__(self, p: Policy, set_fields: frozenset[str] = frozenset(), raw: bool = False, inside: bool = False):
        self.p, self.sets, self.raw, self.inside = p, set_fields, raw, inside  # inside: of a prepared collection

    def within(self) -> Compiler:
        return Compiler(self.p, self.sets, self.raw, True)

    def text(self, kind: T.DataType, c: Column, spaced: bool = False) -> Column:
        if isinstance(kind, T.StringType):
            if self.inside:
                return strings.json_text(c if self.raw else strings.normalize(c, self.p, form=False), native=True)
            return strings.json_text(c) if self.raw else strings.json_normal(c, self.p)
        if isinstance(kind, T.BooleanType):
            return c.cast("string")
        if self.inside and isinstance(kind, (T.DoubleType, T.FloatType)):
            return c if self.raw or not self.p.numbers else F.concat(F.lit('"'), c, F.lit('"'))
        if isinstance(kind, T.NumericType):
            if self.raw or not self.p.numbers:
                return self.native(kind, c)
            return F.concat(F.lit('"'), numbers.canonical_number(c, kind), F.lit('"'))
        if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
            return F.concat(F.lit('"'), F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'"), F.lit('"'))
        if isinstance(kind, T.DateType):
            return F.concat(F.lit('"'), c.cast("string"), F.lit('"'))
        if isinstance(kind, T.ArrayType):
            return self.array(kind, c, False, spaced)
        if isinstance(kind, T.StructType):
            return self.struct(kind, c, spaced)
        if isinstance(kind, T.MapType):
            return self.map(kind, c, spaced)
        raise TypeError(f"no canonical form for {kind.simpleString()}")

    def native(self, kind: T.DataType, c: Column) -> Column:
        """Number text as JSON writes it: whole floating values keep .0."""
        if isinstance(kind, (T.DoubleType, T.FloatType)):
            return schemaless.float_repr(c.cast("double") if isinstance(kind, T.DoubleType) else c.cast("string").cast("double"))
        return c.cast("string")

    def array(self, kind: T.ArrayType, c: Column, is_set: bool, spaced: bool = False) -> Column:
        if not self.inside:
            return self.within().array(kind, prepared(kind, c, self.p, self.raw), is_set, spaced)

        def one(x: Column) -> Column:
            return F.coalesce(self.text(kind.elementType, x, spaced), F.lit("null"))

        if is_set and self.p.sort_sets and not self.raw:
            if isinstance(kind.elementType, (T.ArrayType, T.MapType, T.StructType)):
                pairs = F.array_sort(F.transform(c, lambda x: F.struct(F.coalesce(self.text(kind.elementType, x, True), F.lit("null")).alias("k"), one(x).alias("t"))))
                items = F.transform(pairs, lambda x: x["t"])
            else:  # a single value has no spaces of its own, so its text orders itself
                items = F.sort_array(F.transform(c, one))
            if self.p.dedup_sets:
                items = F.array_distinct(items)
        else:
            items = F.transform(c, one)
        return F.when(c.isNotNull(), F.concat(F.lit("["), F.array_join(items, ", " if spaced else ","), F.lit("]")))

    def member(self, name: str, kind: T.DataType, c: Column, spaced: bool) -> tuple[Column, Column] | None:
        """(is it dropped, text) of the value under a normalized name, or None if the policy always drops it."""
        p = self.p
        dropped = c.isNull() if p.remove_null and not self.raw else F.lit(False)
        if self.raw:
            return dropped, F.coalesce(self.text(kind, c, spaced), F.lit("null"))
        action = p.timestamp_action(name)
        if isinstance(kind, T.StringType):
            if p.remove_empty:
                dropped = dropped | F.coalesce(c == "", F.lit(False))
            if action == "strip":
                if p.remove_null:
                    return None
                return c.isNotNull(), F.lit("null")
            text = self.text(kind, c, spaced)
            if action == "bucket":  # a bucket's text is ASCII
                bucket = timestamps.bucket_text(timestamps.parse(c), p.granularity)
                text = F.coalesce(F.concat(F.lit('"'), strings.normalize(bucket, p, form=False), F.lit('"')), text)
        elif isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType)) and action != "keep":
            if action == "strip":
                return (c.isNotNull(), F.lit("null")) if not p.remove_null else None
            text = F.concat(F.lit('"'), timestamps.bucket_text(c.cast("timestamp"), p.granularity), F.lit('"'))
        elif isinstance(kind, T.ArrayType):
            text = self.array(kind, c, name in self.sets, spaced)
        else:
            text = self.text(kind, c, spaced)
        return dropped, F.coalesce(text, F.lit("null"))

    def fields(self, kind: T.StructType, at, spaced: bool = False) -> Column:
        """The object of a schema's fields; at(field) is its column. Of fields with one normalized name the last that is not dropped counts."""
        by_name: dict[str, list[tuple[Column, Column]]] = {}
        for f in sorted(kind.fields, key=lambda f: f.name):
            name = f.name if self.raw else normal_name(f.name, self.p)
            if not self.raw and self.p.drops(name):
                continue
            made = self.member(name, f.dataType, at(f), spaced)
            if made is not None:
                by_name.setdefault(name, []).append(made)
        members = []
        for name in sorted(by_name):
            label = schemaless.quote(name) + (": " if spaced else ":")
            values = [F.when(~dropped, F.concat(F.lit(label), text)) for dropped, text in reversed(by_name[name])]
            members.append(F.coalesce(*values) if len(values) > 1 else values[0])
        inner = F.concat_ws(", " if spaced else ",", *members) if members else F.lit("")
        return F.concat(F.lit("{"), inner, F.lit("}"))

    def struct(self, kind: T.StructType, c: Column, spaced: bool = False) -> Column:
        return F.when(c.isNotNull(), self.fields(kind, lambda f: c[f.name], spaced))

    def map(self, kind: T.MapType, c: Column, spaced: bool = False) -> Column:
        """Entries by raw key; of keys with one normalized name the last that is kept counts; then by normalized key. Field rules that depend on names apply to values at run time."""
        if not isinstance(kind.keyType, T.StringType):
            raise TypeError("map keys must be strings")
        if not self.inside:
            return self.within().map(kind, prepared(kind, c, self.p, self.raw), spaced)
        p = self.p
        entries = F.array_sort(F.map_entries(c), lambda a, b: F.when(a["key"] < b["key"], -1).when(a["key"] > b["key"], 1).otherwise(0))

        def one(e: Column) -> Column:
            name = e["key"] if self.raw else strings.normalize(e["key"], p, form=False)
            low, value = F.lower(name), e["value"]
            dropped = F.lit(False)
            text = self.text(kind.valueType, value, spaced)
            if not self.raw:
                if p.nonces:
                    dropped = dropped | low.isin([n.lower() for n in p.nonces])
                if p.remove_null:
                    dropped = dropped | value.isNull()
                if isinstance(kind.valueType, T.StringType):
                    if p.remove_empty:
                        dropped = dropped | F.coalesce(value == "", F.lit(False))
                    if p.strip_non_substantive:
                        dropped = dropped | low.isin([n.lower() for n in p.non_substantive])
                    listed = low.isin([n.lower() for n in p.timestamp_fields])
                    if p.timestamps == "strip":
                        dropped = dropped | listed
                    elif p.timestamps == "bucket":
                        text = F.when(listed, self.text(kind.valueType, timestamps.bucket_or_same(value, p.granularity), spaced)).otherwise(text)
                if isinstance(kind.valueType, T.ArrayType) and self.sets:
                    text = F.when(name.isin(sorted(self.sets)), self.array(kind.valueType, value, True, spaced)).otherwise(text)
            return F.struct(name.alias("name"), dropped.alias("dropped"), F.coalesce(text, F.lit("null")).alias("text"))

        kept = F.filter(F.transform(entries, one), lambda e: ~e["dropped"])
        last = F.reduce(kept, F.filter(kept, lambda e: F.lit(False)), lambda acc, e: F.concat(F.filter(acc, lambda x: x["name"] != e["name"]), F.array(e)))
        ordered = F.array_sort(F.transform(last, lambda e: F.struct(e["name"].alias("name"), F.concat(strings.json_text(e["name"], native=True), F.lit(": " if spaced else ":"), e["text"]).alias("t"))))
        return F.when(c.isNotNull(), F.concat(F.lit("{"), F.array_join(F.transform(ordered, lambda e: e["t"]), ", " if spaced else ","), F.lit("}")))




def canonical_form(kind: T.DataType, c: Column, p: Policy, set_fields=(), bind: bool = True) -> Column:
    text = F.coalesce(Compiler(p, frozenset(set_fields)).text(kind, c), F.lit("null"))
    return wrap(text, p) if bind else text


def wrap(text: Column, p: Policy) -> Column:
    return F.concat(F.lit('{"_policy_version":' + schemaless.quote(p.version) + ',"data":'), text, F.lit("}"))


def raw_json(kind: T.DataType, c: Column) -> Column:
    """Sorted compact ASCII JSON without any normalization."""
    return F.coalesce(Compiler(Policy("raw"), raw=True).text(kind, c), F.lit("null"))


