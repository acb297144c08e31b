"""Closed form of a sweep: a static side of makers and one stream of takers that cross every level.

Both sides become stretches of cumulative quantity per symbol; a trade is an overlap of two
stretches. Overlaps are found by an equi-join on buckets of the quantity axis, so neither a
range join over all pairs nor one task for a symbol's takers is needed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numbering import running_sum


def _stretches(rows: DataFrame, order: list[str], step: int) -> DataFrame:
    s = running_sum(rows, ["symbol"], order, "qty", "hi").withColumn("lo", F.col("hi") - F.col("qty"))
    return s.withColumn("b", F.explode(F.expr(f"sequence(lo div {step}, (hi - 1) div {step})")))


def sweep_trades(makers: DataFrame, takers: DataFrame, maker_side: str = "ask", step: int | None = None) -> DataFrame:
    """symbol, maker, taker, price, qty. makers: symbol, iseq, order_id, price, qty; takers the same without price.
    `step` is the width of a bucket of the quantity axis; none: some ten mean quantities, so that
    rows and buckets stay in proportion whatever the unit."""
    if step is None:
        mean = makers.select("qty").unionByName(takers.select("qty")).agg(F.avg("qty")).first()[0]
        step = max(1, round(10 * (mean or 0)))
    best = F.col("price") if maker_side == "ask" else -F.col("price")
    m = _stretches(makers.select("symbol", "iseq", "order_id", "price", "qty").withColumn("best", best), ["best", "iseq"], step)
    t = _stretches(takers.select("symbol", "iseq", "order_id", "qty"), ["iseq"], step)
    a, b = m.alias("m"), t.alias("t")
    lo, hi = F.greatest("m.lo", "t.lo"), F.least("m.hi", "t.hi")
    pairs = a.join(b, (F.col("m.symbol") == F.col("t.symbol")) & (F.col("m.b") == F.col("t.b"))).filter((lo < hi) & (F.expr(f"greatest(m.lo, t.lo) div {step}") == F.col("m.b")))
    return pairs.select(F.col("m.symbol").alias("symbol"), F.col("m.order_id").alias("maker"), F.col("t.order_id").alias("taker"), F.col("m.price").alias("price"), (hi - lo).alias("qty"))
