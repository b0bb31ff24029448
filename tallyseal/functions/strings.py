"""String normalization and JSON string text as Column expressions."""

from __future__ import annotations

import functools
import json
import re
import unicodedata

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyseal.plans.policy import Policy

#: White space of Unicode, as a regex class for Java and RE2 (fixed values).
SPACE = r"[\x{09}-\x{0d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"


#: The same for Java, where most characters of a text are told by two comparisons instead of one with each range.
_JAVA_SPACE = rf"[[\x{{00}}-\x{{20}}\x{{80}}-\x{{10ffff}}]&&{SPACE}]"


@functools.cache
def _form(name: str):
    @F.pandas_udf(T.StringType())
    def normal(s: pd.Series) -> pd.Series:
        return s.map(lambda x: unicodedata.normalize(name, x), na_action="ignore")

    return normal


#: Beyond it no character changes under normalization (Unicode's last ones are compatibility ideographs of plane 2).
LAST = 0x2FFFF


def _ranges(codes: list[int]) -> str:
    """A Java regex class of ascending code points, without its brackets."""
    out, first = [], None
    for k, c in enumerate(codes):
        first = c if first is None else first
        if k + 1 == len(codes) or codes[k + 1] != c + 1:
            out.append(rf"\x{{{first:x}}}" + (rf"-\x{{{c:x}}}" if c > first else ""))
            first = None
    return "".join(out)


@functools.cache
def unsure(name: str) -> tuple[int, str]:
    """(least code point, regex class) of the characters by which a string may not be in a Unicode form: those that change by themselves, those that may join the one before, and those that may change places."""
    chars = [chr(c) for c in range(0x80, LAST + 1) if not 0xD800 <= c <= 0xDFFF]
    found = {c for c in chars if unicodedata.combining(c) or unicodedata.normalize(name, c) != c}
    if name in ("NFC", "NFKC"):
        for c in chars:
            parts = unicodedata.decomposition(c).split()
            if len(parts) == 2 and not parts[0].startswith("<") and unicodedata.normalize("NFC", c) == c:
                found.add(chr(int(parts[1], 16)))
        found |= {chr(c) for c in (*range(0x1161, 0x1176), *range(0x11A8, 0x11C3))}  # vowels and finals of Hangul
    codes = sorted(map(ord, found))
    return codes[0], rf"[\x{{{codes[0]:x}}}-\x{{{LAST:x}}}&&[{_ranges(codes)}]]"


def _extra_bytes(c: Column) -> Column:
    """Bytes beyond one a character: none in ASCII."""
    return F.octet_length(c) - F.length(c)


def _only(c: Column, chars: str) -> Column:
    """Whether the string holds no other characters than a class's: one loop over it, where a search for another one starts anew at each place."""
    return F.rlike(c, F.lit(rf"\A[{chars}]*\z"))


def may_change(c: Column, name: str) -> Column:
    """Quick check: false for strings that are in the form for sure."""
    least, pattern = unsure(name)
    return (_extra_bytes(c) > 0) & ~_only(c, rf"\x{{00}}-\x{{{least - 1:x}}}") & F.rlike(c, F.lit(pattern))


def unicode_form(c: Column, name: str = "NFC") -> Column:
    """Strings that are in the form by the quick check stay in the JVM; only others are sent to Python."""
    return F.coalesce(_form(name)(F.when(may_change(c, name), c)), c)


def trim(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(c, f"^{SPACE}+", ""), rf"{SPACE}+\z", "")


def collapse(c: Column) -> Column:
    return F.regexp_replace(c, f"{_JAVA_SPACE}+", " ")


def collapse_trim(c: Column) -> Column:
    """collapse(trim(c)): where every run is one blank, only blanks are left to trim."""
    return F.btrim(collapse(c))


def synonym_pattern(variant: str) -> str:
    quoted = re.sub(r"([^0-9A-Za-z\s])", r"\\\1", variant)
    return rf"(?iu:(?<![A-Za-z0-9.]){quoted}(?![A-Za-z0-9]))" if "." in variant else rf"(?iuU:\b{quoted}\b)"


def _meet(left: str, right: str) -> bool:
    """Whether an end of left is a beginning of right."""
    return any(left.endswith(right[:k]) for k in range(1, min(len(left), len(right)) + 1))


def independent(rules: list[tuple[str, str]]) -> bool:
    """Whether rules (variant, name), longest variant first, give the same in one pass as one after the other.

    Sufficient: variants are ASCII words with dots and spaces; no name holds, begins or ends in a part of a variant; and no variant ends as
    another begins, except where the shorter one is the beginning of the longer. Then matches neither touch nor make new ones.
    """
    variants = [v.lower() for v, _ in rules]
    if not all(re.fullmatch(r"[A-Za-z0-9](?:[A-Za-z0-9. ]*[A-Za-z0-9.])?", x) for rule in rules for x in rule):
        return False
    for v in variants:
        for name in (n.lower() for _, n in rules):
            if v in name or _meet(v, name) or _meet(name, v):
                return False
        for other in variants:
            if other != v and any(other.startswith(v[k:]) for k in range(1, len(v))):
                return False
    return True


def synonyms(c: Column, rules: list[tuple[str, str]]) -> Column:
    """Variants become their names: one pass a name where rules are independent, else one a rule, in order."""
    if independent(rules):
        by_name: dict[str, list[str]] = {}
        for variant, name in rules:
            by_name.setdefault(name, []).append(synonym_pattern(variant))
        passes = [("|".join(patterns), name) for name, patterns in by_name.items()]
    else:
        passes = [(synonym_pattern(variant), name) for variant, name in rules]
    for pattern, name in passes:
        c = F.regexp_replace(c, pattern, name.replace("\\", "\\\\").replace("$", "\\$"))
    return c


def normalize(c: Column, p: Policy, form: bool = True) -> Column:
    """form: also bring the string into the policy's Unicode form (not possible in lambdas)."""
    if form:
        c = unicode_form(c, p.unicode_form)
    if p.trim and p.collapse:
        c = collapse_trim(c)
    elif p.trim:
        c = trim(c)
    elif p.collapse:
        c = collapse(c)
    if p.lower:
        c = F.lower(c)
    return synonyms(c, p.rules())


#: Short escapes of JSON (fixed values).
SHORT = {"\b": "\\b", "\t": "\\t", "\n": "\\n", "\f": "\\f", "\r": "\\r", '"': '\\"', "\\": "\\\\"}


#: Characters that escapes of one letter, or none, can write; the most frequent ones first.
EVEN = r"\x{20}-\x{7e}\x{08}-\x{0a}\x{0c}\x{0d}"
#: Characters that JSON writes as they are, in ASCII.
BARE = r"\x{20}\x{21}\x{23}-\x{5b}\x{5d}-\x{7e}"
#: Characters that only Python's escapes know: beyond ASCII, and controls without a short escape, of which there are so many.
ODD = f"[^{EVEN}]"
ODD_CONTROLS = 28


def once(c: Column, f) -> Column:
    """f(c) with c evaluated once, however often f mentions it; f can't call Python."""
    return F.transform(F.array(c), f)[0]


def _escaped(c: Column) -> Column:
    """Short escapes; the backslash first."""
    for char in sorted(SHORT, key="\\".__ne__):
        c = F.replace(c, F.lit(char), F.lit(SHORT[char]))
    return c


def _quoted(c: Column) -> Column:
    return F.concat(F.lit('"'), c, F.lit('"'))


def _escape_char(x: Column) -> Column:
    code = F.ascii(x)
    rest = code - 0x10000
    pair = F.format_string("\\u%04x\\u%04x", F.lit(0xD800) + F.floor(rest / 1024).cast("int"), F.lit(0xDC00) + F.pmod(rest, F.lit(1024)).cast("int"))
    return F.when(~F.rlike(x, F.lit(ODD)), _escaped(x)).when(code > 0xFFFF, pair).otherwise(F.format_string("\\u%04x", code))


@F.arrow_udf(T.StringType())
def _dumped(a: pa.Array) -> pa.Array:
    return pa.array([None if x is None else json.dumps(x) for x in a.to_pylist()], pa.string())


@functools.cache
def _dumped_normal(p: Policy):
    from tallyseal.functions import schemaless

    @F.arrow_udf(T.StringType())
    def run(a: pa.Array) -> pa.Array:
        return pa.array([None if x is None else json.dumps(schemaless.normalize(x, p)) for x in a.to_pylist()], pa.string())

    return run


#: A string with more different odd characters is escaped by Python.
MOST_ODD = 64


def _odd_chars(c: Column) -> Column:
    return F.array_distinct(F.split(F.regexp_replace(c, f"[{EVEN}]+", ""), ""))


def _native_text(c: Column) -> Column:
    """Quoted JSON text; odd characters are replaced one kind after the other, as escapes hold none."""
    return once(c, lambda x: _quoted(F.when(_only(x, BARE), x).when(_only(x, EVEN), _escaped(x)).otherwise(F.reduce(_odd_chars(x), _escaped(x), lambda acc, o: F.when(o == "", acc).otherwise(F.replace(acc, o, _escape_char(o)))))))


def json_text(c: Column, native: bool = False) -> Column:
    """The string as quoted ASCII JSON; null stays null. Strings with very many different odd characters go to Python, unless native."""
    if native:
        return _native_text(c)
    cross = many_odd(c)
    return F.coalesce(_dumped(F.when(cross, c)), _native_text(c))


def many_odd(c: Column) -> Column:
    """Odd characters are controls or have more bytes than one, so few further bytes mean few of them."""
    return (_extra_bytes(c) > MOST_ODD - ODD_CONTROLS) & (F.size(_odd_chars(c)) > MOST_ODD)


#: Characters on which case folding or word bounds of Java and Python may differ: numbers that are no digits, marks, connectors, joiners, letters in circles, relatives of I, K and S, final sigma, and what Java doesn't know.
DOUBTFUL = r"[\x{80}-\x{10ffff}&&[\p{No}\p{Nl}\p{M}\p{Pc}\p{Cn}\x{200c}\x{200d}\x{24b6}-\x{24e9}\x{1f130}-\x{1f189}\x{130}\x{131}\x{17f}\x{212a}\x{3a3}\x{3c3}\x{3c2}]]"


def crosses(c: Column, p: Policy) -> Column:
    """Whether json_normal sends a string to Python: it may not be in the Unicode form, holds a doubtful character where that matters, or very many odd ones."""
    out = may_change(c, p.unicode_form)
    if p.lower or p.rules():
        out = out | ((_extra_bytes(c) > 0) & F.rlike(c, F.lit(DOUBTFUL)))
    return out | many_odd(c)


def json_normal(c: Column, p: Policy) -> Column:
    """json_text(normalize(c, p)) with each string normalized once: in the JVM, or in Python where crosses() says so."""
    return F.coalesce(_dumped_normal(p)(F.when(crosses(c, p), c)), _native_text(normalize(c, p, form=False)))
