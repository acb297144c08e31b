"""Amounts as Columns: exact decimals inside, longs or decimals at the edge."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PPM = 1_000_000
_D = "decimal(38,0)"


def product(a: Column, b: Column) -> Column:
    """a * b of longs as an exact decimal; the decimal product is made only where a long overflows."""
    return F.coalesce(F.try_multiply(a, b).cast(_D), (a.cast(_D) * b.cast(_D)).cast(_D))


def fee(amount: Column, ppm: Column) -> Column:
    """floor(amount * ppm / 10^6). Amounts whose product fits a long take long arithmetic; above,
    whole and broken millions are multiplied apart, so no product exceeds 38 digits."""
    a, p = amount.cast(_D), ppm.cast(_D)
    rest = a % PPM
    whole, part = ((a - rest) / PPM).cast(_D), (rest * p).cast(_D)
    exact = (whole * p + ((part - part % PPM) / PPM)).cast(_D)
    quick = F.call_function("div", amount.cast("long") * ppm.cast("long"), F.lit(PPM).cast("long")).cast(_D)
    return F.when(amount <= (1 << 63) // PPM - 1, quick).otherwise(exact)


def percent(amount: Column, p: int) -> Column:
    """amount/100*p + amount%100*p/100 in whole numbers."""
    hundred = F.lit(100).cast("long")
    return F.call_function("div", amount, hundred) * p + F.call_function("div", (amount % 100) * p, hundred)


def hold(side: Column, price: Column, qty: Column, lot: Column) -> Column:
    """Amount held for an order: price * qty of the quote for a buy, lot * qty of the base for a sell."""
    return F.when(side == "buy", price.cast(_D) * qty.cast(_D)).otherwise(lot.cast(_D) * qty.cast(_D)).cast(_D)


def fee_rate(taker: Column, maker_ppm: Column, taker_ppm: Column, default_ppm: int) -> Column:
    """The symbol's own pair, else the default for both."""
    return F.coalesce(F.when(taker, taker_ppm).otherwise(maker_ppm), F.lit(default_ppm))
