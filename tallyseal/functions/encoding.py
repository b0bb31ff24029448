"""base64url, pre-authentication encoding and HMAC as Column expressions."""

from __future__ import annotations

import hashlib
import string

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyseal.functions import strings

PAE_TAG = "DSSEv1"  # fixed value of the public DSSE protocol
#: Digits of base64 one by one: Java looks these up in one table, but compares with each range.
_DIGITS = string.ascii_letters + string.digits + "+/"


def _swapped(c: Column, by: dict[str, str]) -> Column:
    """Searches for bytes, where translate() looks every character up in a map."""
    for old, new in by.items():
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def b64url(data: Column) -> Column:
    """Without padding."""
    return _swapped(F.base64(data), {"+": "-", "/": "_", "\r\n": "", "=": ""})


def from_b64(text: Column) -> Column:
    """Either alphabet, padded or not; null where the text is no base64."""

    def read(plain: Column) -> Column:
        good = F.rlike(plain, F.lit(rf"\A[{_DIGITS}]*\z")) & (F.octet_length(plain) % 4 != 1)
        return F.unbase64(F.when(good, plain))  # padding isn't needed

    return strings.once(_swapped(text, {"-": "+", "_": "/"}), lambda x: strings.once(F.when(F.endswith(x, F.lit("=")), F.rtrim(x, F.lit("="))).otherwise(x), read))


def pae(kind: Column, payload: Column) -> Column:
    """Binary: tag, byte length of the type, type, byte length of the payload, payload."""
    head = F.concat_ws(" ", F.lit(PAE_TAG), F.octet_length(kind).cast("string"), kind, F.octet_length(payload).cast("string"))
    return F.concat(F.encode(head, "UTF-8"), F.encode(F.lit(" "), "UTF-8"), payload.cast("binary"))


def py_pae(kind: str, payload: bytes) -> bytes:
    """pae() of Python values."""
    raw = kind.encode()
    return f"{PAE_TAG} {len(raw)} ".encode() + raw + f" {len(payload)} ".encode() + payload


def _pad(key: Column, byte: int) -> Column:
    """The key, hashed if over 64 bytes, filled to 64 and combined with one byte, as hex."""
    hexed = F.hex(F.when(F.octet_length(key) > 64, F.unhex(F.sha2(key, 256))).otherwise(key))
    full = F.rpad(hexed, 128, "0")
    word = int.from_bytes(bytes([byte]) * 8)  # eight bytes at a time, as signed 64-bit numbers
    return F.concat(*[F.lpad(F.hex(F.conv(F.substring(full, i, 16), 16, -10).cast("long").bitwiseXOR(F.lit(word).cast("long"))), 16, "0") for i in range(1, 128, 16)])


def hmac_pads(key: Column) -> Column:
    """struct(inner, outer) of binary: what a key's HMACs begin with. To be made where keys are rows, not where messages are."""
    return F.struct(F.unhex(_pad(key, 0x36)).alias("inner"), F.unhex(_pad(key, 0x5C)).alias("outer"))


def py_hmac_pads(key: bytes) -> tuple[bytes, bytes]:
    """hmac_pads() of a Python value."""
    full = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in full), bytes(b ^ 0x5C for b in full)


def hmac_sha256(pads: Column, data: Column) -> Column:
    """Hex digest; keys come as a column, never as a literal in the plan."""
    inner = F.unhex(F.sha2(F.concat(pads["inner"], data.cast("binary")), 256))
    return F.sha2(F.concat(pads["outer"], inner), 256)
