"""64-bit hashes as signed BIGINT columns and as 16 hex digits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def pack(bits: Column) -> Column:
    """A BIGINT from an array of 64 booleans, the first as the highest bit."""
    return F.aggregate(bits, F.lit(0).cast("long"), lambda acc, b: F.shiftleft(acc, 1).bitwiseOR(b.cast("long")))


def to_hex(h: Column) -> Column:
    return F.lpad(F.lower(F.hex(h)), 16, "0")


def is_hex(text: Column) -> Column:
    return F.coalesce(text.rlike(r"^[0-9a-fA-F]{16}\z"), F.lit(False))


def from_hex(text: Column) -> Column:
    """Null unless there are exactly 16 hex digits, of either case."""
    return F.when(is_hex(text), F.conv(text, 16, -10).cast("long"))


def hamming(x: Column, y: Column) -> Column:
    return F.bit_count(x.bitwiseXOR(y)).cast("int")
