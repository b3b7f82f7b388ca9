"""The 32-bit string hash that numbers strings for histograms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def string_number(column: Column) -> Column:
    """s[0] * 31^(n-1) + ... + s[n-1] in 32-bit arithmetic, signed; code units are those of characters up to U+FFFF."""
    total = F.aggregate(F.split(column, ""), F.lit(0).cast("bigint"), lambda h, c: (h * 31 + F.ascii(c)).bitwiseAND(F.lit(0xFFFFFFFF)))
    return F.when(total >= F.lit(1 << 31), total - F.lit(1 << 32)).otherwise(total)
