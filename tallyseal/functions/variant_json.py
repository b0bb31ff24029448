"""Schemaless JSON in the JVM: canonical and sorted forms of JSON text by way of variants.

Text is parsed once into a variant, objects and arrays are taken apart level by level down to `depth` levels, and put together from their
members' texts. What variants can't say as Python's json module does is left null, for Python to do: duplicate names, text that is no JSON
to Spark, numbers with exponents or over 15 significant digits after a point, or over 64 bits, \\u escapes, strings whose Unicode form or
case folding is in doubt, names that become equal under the policy, and values nested deeper.

A text must be one value and nothing more, which Spark's parser doesn't ask for: it is parsed as the first of two elements, of which the
second is its digest, so that no text can close the array by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyseal.functions import schemaless, strings, timestamps
from tallyseal.plans.policy import Policy

DEPTH = 4


def _json_string(c: Column) -> Column:
    return strings.json_text(c, native=True)


class _Forms:
    def __init__(self, p: Policy | None, without: tuple[str, ...]):
        self.p, self.without = p, without  # p None: sorted JSON without normalization

    def number(self, x: Column, kind: Column) -> Column:
        text = x.cast("string")
        exact = F.rlike(kind, F.lit(r"^DECIMAL\((?:[0-9]|1[0-5]),"))
        if self.p is not None:
            bare = F.when(kind == "BIGINT", text).when(exact, F.when(F.contains(text, F.lit(".")), F.rtrim(F.rtrim(text, F.lit("0")), F.lit("."))).otherwise(text))
            return F.concat(F.lit('"'), F.when(bare == "-0", "0").otherwise(bare), F.lit('"'))
        usual = F.abs(F.try_variant_get(x, "$", "double")) >= 1e-4  # below Python writes an exponent, and a zero may have had a sign
        return F.when(kind == "BIGINT", text).when(exact & usual, F.when(F.contains(text, F.lit(".")), text).otherwise(F.concat(text, F.lit(".0"))))

    def value(self, x: Column, depth: int, top: bool = False) -> Column:
        """Text of a variant; null where Python must do it."""
        text = (lambda s: strings.normalize(s, self.p, form=False)) if self.p is not None else (lambda s: s)

        def by_kind(kind: Column) -> Column:
            return (
                F.when(kind == "STRING", _json_string(text(x.cast("string")))).when(kind == "BOOLEAN", x.cast("string")).when(kind == "VOID", "null")
                .when((kind == "BIGINT") | F.startswith(kind, F.lit("DECIMAL")), self.number(x, kind)).when(F.rlike(kind, F.lit("^(?:OBJECT|ARRAY)<")), self.members(x, depth, top) if depth else F.lit(None).cast("string"))
            )

        return strings.once(F.schema_of_variant(x), by_kind)

    def members(self, x: Column, depth: int, top: bool) -> Column:
        """Text of an object or an array, whose members are taken alike; those of an array have no key."""
        items = F.coalesce(
            F.transform(F.map_entries(F.try_variant_get(x, "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("value"))),
            F.transform(F.try_variant_get(x, "$", "array<variant>"), lambda v: F.struct(F.lit(None).cast("string").alias("key"), v.alias("value"))),
        )
        made = F.filter(F.transform(items, lambda e: self.member(e["key"], e["value"], depth - 1, top)), lambda e: ~e["dropped"])

        def joined(kept: Column) -> Column:
            names = F.array_compact(F.transform(kept, lambda e: e["name"]))
            good = ~F.exists(kept, lambda e: e["text"].isNull()) & (F.size(F.array_distinct(names)) == F.size(names))
            as_object = F.array_join(F.transform(F.array_sort(kept), lambda e: F.concat(_json_string(e["name"]), F.lit(":"), e["text"])), ",")
            as_array = F.array_join(F.transform(kept, lambda e: e["text"]), ",")
            is_object = F.startswith(F.schema_of_variant(x), F.lit("OBJECT"))
            return F.when(good, F.when(is_object, F.concat(F.lit("{"), as_object, F.lit("}"))).otherwise(F.concat(F.lit("["), as_array, F.lit("]"))))

        return strings.once(made, joined)

    def member(self, key: Column, x: Column, depth: int, top: bool) -> Column:
        """struct(name, text, dropped) of a member."""
        if self.p is None:
            gone = F.coalesce(key.isin(*self.without), F.lit(False)) if top and self.without else F.lit(False)
            return F.struct(key.alias("name"), self.value(x, depth).alias("text"), gone.alias("dropped"))
        p = self.p
        name = strings.normalize(key, p, form=False)

        def by_name(low: Column) -> Column:
            def among(names) -> Column:
                return low.isin(sorted({n.lower() for n in names})) if names else F.lit(False)

            kind = F.schema_of_variant(x)
            is_text = kind == "STRING"
            dropped = among(p.nonces)
            if p.remove_null:
                dropped = dropped | (kind == "VOID")
            if p.remove_empty:
                dropped = dropped | (is_text & (x.cast("string") == ""))
            plain = among(p.non_substantive) if p.strip_non_substantive else F.lit(False)
            listed = among(p.timestamp_fields)
            dropped = dropped | (is_text & (plain | listed if p.timestamps == "strip" else plain))
            text = self.value(x, depth)
            if p.timestamps == "bucket":
                bucket = strings.normalize(timestamps.bucket_or_same(x.cast("string"), p.granularity), p, form=False)
                text = F.when(is_text & listed, _json_string(bucket)).otherwise(text)
            return F.struct(name.alias("name"), text.alias("text"), (key.isNotNull() & dropped).alias("dropped"))

        return strings.once(F.lower(name), by_name)


def _one_value(text: Column) -> Column:
    """The variant of a text that is one JSON value; null else."""
    mark = F.md5(text)
    pair = F.try_variant_get(F.try_parse_json(F.concat(F.lit("["), text, F.lit(',"'), mark, F.lit('"]'))), "$", "array<variant>")
    return strings.once(pair, lambda v: F.when((F.size(v) == 2) & (F.try_variant_get(F.get(v, F.lit(1)), "$", "string") == mark), F.get(v, F.lit(0))))


def _plain(text: Column, p: Policy | None) -> Column:
    """Whether no string of a JSON text can need Python."""
    good = ~F.contains(text, F.lit("\\u"))
    if p is not None:
        good = good & ~strings.may_change(text, p.unicode_form)
        if p.lower or p.rules():
            good = good & ~F.rlike(text, F.lit(strings.DOUBTFUL))
    return good


def able(p: Policy, set_fields=()) -> bool:
    """Whether forms under a policy can be made in the JVM at all."""
    return p.numbers and p.sort_keys and not set_fields


def native_form(text: Column, p: Policy, depth: int = DEPTH) -> Column:
    """Canonical text of a JSON text's value, or null where Python must do it."""
    return _forms(text, _Forms(p, ()), p, depth)


def native_sorted(text: Column, without: tuple[str, ...] = (), depth: int = DEPTH) -> Column:
    """Sorted compact JSON without some top-level names, or null where Python must do it."""
    return _forms(text, _Forms(None, tuple(without)), None, depth)


def _forms(text: Column, forms: _Forms, p: Policy | None, depth: int) -> Column:
    v = _one_value(F.when(_plain(text, p), text))
    return strings.once(v, lambda x: F.when(x.isNotNull(), forms.value(x, depth, top=True)))


def with_json_form(df: DataFrame, column: str, p: Policy, *, form: str = "canonical_form", set_fields=(), bind: bool = True, depth: int = DEPTH) -> DataFrame:
    """df with the canonical form of a column of JSON text, as schemaless.canonical_json gives it: only rows that the JVM can't do go to Python."""
    if not able(p, set_fields):
        return df.withColumn(form, schemaless.canonical_json(F.col(column), p, set_fields, bind))
    made = df.select("*", F.inline(F.array(F.struct(native_form(F.col(column), p, depth).alias("_native")))))
    head = F.lit('{"_policy_version":' + schemaless.quote(p.version) + ',"data":')
    whole = F.concat(head, "_native", F.lit("}")) if bind else F.col("_native")
    rest = schemaless.canonical_json(F.when(F.col("_native").isNull(), F.col(column)), p, (), bind)
    return made.withColumn(form, F.coalesce(whole, rest)).drop("_native")


def with_sorted_json(df: DataFrame, column: str, *, form: str = "bytes", without: tuple[str, ...] = (), depth: int = DEPTH) -> DataFrame:
    """df with schemaless.sorted_json of a column; only rows that the JVM can't do go to Python."""
    made = df.select("*", F.inline(F.array(F.struct(native_sorted(F.col(column), without, depth).alias("_native")))))
    return made.withColumn(form, F.coalesce("_native", schemaless.sorted_json(F.when(F.col("_native").isNull(), F.col(column)), without))).drop("_native")
