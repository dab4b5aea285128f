"""Bit streams, least significant bit first, as hex text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def bits_of(value: Column, n: Column | int) -> Column:
    """The low ``n`` bits of a number as text, lowest first."""
    n = F.lit(n) if isinstance(n, int) else n
    text = F.reverse(F.conv(value.cast("long").cast("string"), 10, 2))
    return F.rpad(text, n, F.lit("0"))


def to_hex(bits: Column) -> Column:
    """A text of bits as lower-case hex bytes, the last one filled with zeros."""
    filled = F.rpad(bits, (F.ceil(F.length(bits) / 8) * 8).cast("int"), F.lit("0"))
    octets = F.transform(F.sequence(F.lit(0), F.greatest((F.length(filled) / 8).cast("int") - 1, F.lit(0))), lambda i: F.lpad(F.conv(F.reverse(F.substring(filled, i * 8 + 1, F.lit(8))), 2, 16), 2, "0"))
    return F.when(F.length(bits) == 0, "").otherwise(F.lower(F.array_join(octets, "")))


def from_hex(text: Column) -> Column:
    """Hex bytes as a text of bits."""
    octets = F.transform(F.sequence(F.lit(0), F.greatest((F.length(text) / 2).cast("int") - 1, F.lit(0))), lambda i: F.reverse(F.lpad(F.conv(F.substring(text, i * 2 + 1, F.lit(2)), 16, 2), 8, "0")))
    return F.when(F.length(text) == 0, "").otherwise(F.array_join(octets, ""))


def read(bits: Column, at: Column | int, n: Column | int) -> Column:
    """``n`` bits from position ``at`` as a number; past the end they are zero."""
    at, n = (F.lit(v) if isinstance(v, int) else v for v in (at, n))
    part = F.rpad(F.substring(bits, (at + 1).cast("int"), n.cast("int")), n.cast("int"), F.lit("0"))
    return F.when(n == 0, F.lit(0)).otherwise(F.conv(F.reverse(part), 2, 10).cast("int"))


def pack(fields: list[tuple[Column, Column | int]]) -> Column:
    """Hex of numbers written one after another with their widths in bits."""
    return to_hex(F.concat(*(F.substring(bits_of(v, n), F.lit(1), F.lit(n) if isinstance(n, int) else n) for v, n in fields)))


def clean_hex(text: Column) -> Column:
    """Hex text without white space in lower case; null if its length is odd or a digit is none."""
    plain = F.lower(F.regexp_replace(text, "\\s", ""))
    return F.when(plain.rlike("^([0-9a-f]{2})*$"), plain)
