"""Seeded draws that any engine with MD5 can repeat."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Range of ``seeded_bits``: 13 hexadecimal digits, which a double holds exactly.
BITS_RANGE = 1 << 52


def seeded_bits(seed: int, *keys: Column) -> Column:
    """Number below 2**52 from the MD5 of ``seed|key|key``; null keys are left out."""
    text = F.concat_ws("|", F.lit(str(seed)), *(k.cast("string") for k in keys))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("bigint")
