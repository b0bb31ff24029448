"""ISO timestamps in text: parse and bucket. Plans that use them run with the session time zone UTC."""

from __future__ import annotations

import re
from datetime import datetime, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

_DATE = r"(\d{4})-(\d{1,2})-(\d{1,2})"
_CLOCK = r"(\d{1,2}):(\d{1,2}):(\d{1,2})"
_ZONED = rf"^{_DATE}[Tt]{_CLOCK}(?:\.(\d{{1,6}}))?(?:[Zz]|([+-])(\d\d):?(\d\d)(?::?(\d\d))?)\z"
_SPACED = rf"^{_DATE}\s+{_CLOCK}\z"
_DAY = rf"^{_DATE}\z"
_USUAL = r"^\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(?:\.\d{1,6})?Z\z"

PATTERNS = {"day": "yyyy-MM-dd'T00:00:00Z'", "hour": "yyyy-MM-dd'T'HH:00:00'Z'", "minute": "yyyy-MM-dd'T'HH:mm:00'Z'"}
FULL = "yyyy-MM-dd'T'HH:mm:ss'Z'"


def bucket_text(ts: Column, granularity: str) -> Column:
    """Floor of a timestamp as text; an unknown granularity floors to seconds by its format."""
    return F.date_format(ts, PATTERNS.get(granularity, FULL))


def parse(c: Column) -> Column:
    """Timestamp in UTC, null where the text is none: date and time with zone, date and time with a space, or a date."""

    def part(pattern: str, k: int) -> Column:
        return F.regexp_extract(c, pattern, k)

    def made(pattern: str, clock: bool) -> Column:
        n = [part(pattern, k) for k in range(1, 7 if clock else 4)]
        n += [F.lit("0")] * (6 - len(n))
        ok = F.rlike(c, F.lit(pattern))
        text = F.concat(n[0], F.lit("-"), F.lpad(n[1], 2, "0"), F.lit("-"), F.lpad(n[2], 2, "0"), F.lit(" "), F.lpad(n[3], 2, "0"), F.lit(":"), F.lpad(n[4], 2, "0"), F.lit(":"), F.lpad(n[5], 2, "0"))
        return F.try_to_timestamp(F.when(ok, text), F.lit("yyyy-MM-dd HH:mm:ss"))

    def number(k: int) -> Column:
        return F.coalesce(F.try_to_number(F.nullif(part(_ZONED, k), F.lit("")), F.lit("99")).cast("int"), F.lit(0))

    seconds = (number(9) * 3600 + number(10) * 60 + number(11)) * F.when(part(_ZONED, 8) == "-", -1).otherwise(1)
    offset_ok = (number(10) < 60) & (number(11) < 60) & (number(9) < 24)
    zoned = F.when(offset_ok, made(_ZONED, True))
    usual = F.try_to_timestamp(F.substring(c, 1, 19), F.lit("yyyy-MM-dd'T'HH:mm:ss"))
    other = F.coalesce(F.timestamp_seconds(F.unix_timestamp(zoned) - seconds), made(_SPACED, True), made(_DAY, False))
    return F.when(F.rlike(c, F.lit(_USUAL)), usual).otherwise(other)


def bucket_or_same(c: Column, granularity: str) -> Column:
    return F.coalesce(bucket_text(parse(c), granularity), c)


def py_bucket(text: str, granularity: str) -> str | None:
    """The same for one Python string: the schemaless path."""
    m = re.match(_ZONED.replace(r"\z", r"\Z"), text, re.ASCII) or re.match(_SPACED.replace(r"\z", r"\Z"), text) or re.match(_DAY.replace(r"\z", r"\Z"), text, re.ASCII)
    if m is None:
        return None
    g = list(m.groups()) + [None] * (11 - len(m.groups()))
    try:
        t = datetime(*(int(x or 0) for x in g[:6]))
        if g[7]:
            h, mi, s = int(g[8]), int(g[9]), int(g[10] or 0)
            if h > 23 or mi > 59 or s > 59:
                return None
            t -= (1 if g[7] == "+" else -1) * timedelta(hours=h, minutes=mi, seconds=s)
    except (ValueError, OverflowError):
        return None
    keep = {"day": 0, "hour": 1, "minute": 2}.get(granularity, 3)
    clock = [t.hour, t.minute, t.second]
    h, mi, s = clock[:keep] + [0] * (3 - keep)
    return f"{t.year:04d}-{t.month:02d}-{t.day:02d}T{h:02d}:{mi:02d}:{s:02d}Z"
