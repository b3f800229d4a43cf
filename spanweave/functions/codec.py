"""Encodings as column expressions: quantised log-probabilities, gaps, signed buckets, packed integers."""

from __future__ import annotations

from math import log

from pyspark.sql import Column
from pyspark.sql import functions as F

_LARGEST_FLOAT = 3.4028234663852886e38
_SCALE = log(_LARGEST_FLOAT) / 255**2


def decode_log_prob(code: Column) -> Column:
    """Codes 255 down to 0 stand for 0 down to minus the logarithm of the largest float, by squares."""
    b = 255 - code
    return -(b * b) * F.lit(_SCALE)


def encode_log_prob(x: Column) -> Column:
    """The least code whose value is not below x."""
    return F.greatest(F.lit(0), F.least(F.lit(255), 255 - F.floor(F.sqrt(-x / F.lit(_SCALE)) + 1e-12))).cast("int")


def gaps(sorted_values: Column) -> Column:
    """The first value and the differences of those after it."""
    return F.transform(sorted_values, lambda x, i: x - F.when(i > 0, F.element_at(sorted_values, i)).otherwise(0))


def from_gaps(values: Column) -> Column:
    return F.transform(values, lambda x, i: F.aggregate(F.slice(values, 1, i + 1), F.lit(0).cast("bigint"), lambda s, v: s + v))


def signed_bucket(key: Column, n: int) -> Column:
    """Struct of bucket and sign of a key: of a 32-bit hash one bit is the sign, the others give the bucket."""
    h = F.conv(F.substring(F.md5(key), 1, 8), 16, 10).cast("long")
    return F.struct(F.pmod(F.shiftright(h, 1), F.lit(n)).alias("bucket"), F.when(h.bitwiseAND(F.lit(1)) == 0, 1).otherwise(-1).alias("sign"))


def pack_ints(high: Column, low: Column) -> Column:
    return F.shiftleft(high.cast("long"), 32).bitwiseOR(low.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))


def high_int(packed: Column) -> Column:
    return F.shiftright(packed, 32).cast("int")


def low_int(packed: Column) -> Column:
    x = packed.bitwiseAND(F.lit(0xFFFFFFFF))
    return F.when(x > 0x7FFFFFFF, x - F.lit(1 << 32)).otherwise(x).cast("int")
