"""Exact money arithmetic: prices and fees are integer ticks of 1e-4.

A null price has a null fee, nulls in ``divided`` give null, a null date has no days to another one.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fee coefficients in hundredths (taker A, taker B), the maker's rebate at B in ten-thousandths,
# slippage buffer in ticks, size cap, staleness in seconds, session gap in seconds.
FEE_A, FEE_B = 7, 5
REBATE_B = 125
BUFFER, CAP, STALE_SECONDS, GAP_SECONDS = 100, 1000, 2.0, 120


def divided(n: Column, d: Column) -> Column:
    """n / d for d > 0, rounded half to even in integers."""
    r = F.pmod(n, d)
    q = F.try_divide(n - r, d).cast("long")
    up = (2 * r > d) | ((2 * r == d) & (F.pmod(q, F.lit(2)) == 1))
    return q + up.cast("long")


def fee_ticks(coefficient: Column, price: Column) -> Column:
    """The taker fee of one contract: coefficient (hundredths) * p * (1 - p). Prices outside [0, 1] are an error."""
    fee = divided(coefficient.cast("long") * price * (10000 - price), F.lit(1_000_000).cast("long"))
    return F.when(price.isNull() | price.between(0, 10000), fee).otherwise(F.raise_error(F.lit("price out of range")).cast("long"))


def fee_coefficient(platform: Column, fees: dict[str, int] | None = None) -> Column:
    """The taker fee's coefficient at the platform (a and b unless ``fees`` names others); an unknown or missing one is an error."""
    found = F.raise_error(F.concat(F.lit("no fee for platform "), F.coalesce(platform, F.lit("null")))).cast("long")
    for name, coefficient in (fees or {"a": FEE_A, "b": FEE_B}).items():
        found = F.when(platform == name, F.lit(coefficient).cast("long")).otherwise(found)
    return found


def taker_fee_ticks(platform: Column, price: Column, fees: dict[str, int] | None = None) -> Column:
    """The taker fee of one contract at the platform; an unknown or missing one is an error."""
    return fee_ticks(fee_coefficient(platform, fees), price)


def maker_rebate_ticks(price: Column) -> Column:
    """What a maker at B pays for one contract: less than nothing. Prices outside [0, 1] are an error."""
    paid = -divided(REBATE_B * price.cast("long") * (10000 - price), F.lit(100_000_000).cast("long"))
    return F.when(price.isNull() | price.between(0, 10000), paid).otherwise(F.raise_error(F.lit("price out of range")).cast("long"))


def delta_days(a: Column, b: Column) -> Column:
    """Absolute value of the whole days from b to a, rounded down before the sign goes."""
    us = lambda t: F.unix_micros(t.cast("timestamp"))
    return F.abs(F.floor((us(a) - us(b)) / F.lit(86_400_000_000.0))).cast("long")
