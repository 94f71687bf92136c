"""Numbers as plain Python rounds them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Splits a double into two halves of which each product is exact.
_SPLIT = float(2**27 + 1)


def halves(x: Column) -> tuple[Column, Column]:
    big = x * _SPLIT
    high = big - (big - x)
    return high, x - high


def round_exact(x: Column, digits: int = 6) -> Column:
    """x to that many decimals (15 at most), by its exact binary value, ties to even: 2.675 is a little less than it looks and
    becomes 2.67. Null, NaN and infinite values stay.

    The product with the power of ten is taken without loss, as a double and what the double lacks.
    """
    if not 0 <= digits <= 15:
        raise ValueError("0 to 15 digits")
    ten = float(10**digits)
    x = x.cast("double")
    product = x * ten
    xh, xl = halves(x)
    split = ten * _SPLIT
    th = split - (split - ten)
    tl = ten - th
    lack = ((xh * th - product) + xh * tl + xl * th) + xl * tl
    # floor() gives whole numbers that are exact below 2**53
    low = F.floor(product).cast("double")
    part = product - low
    odd = F.pmod(low, F.lit(2.0)) == 1
    up = (part > 0.5) | ((part == 0.5) & ((lack > 0) | ((lack == 0) & odd)))
    whole = low + F.when(up, 1.0).otherwise(0.0)
    small = F.abs(product) < float(2**53)  # beyond, x has no such decimals
    return F.when(small, F.when(whole == 0, x * 0.0).otherwise(whole / ten)).otherwise(x)
