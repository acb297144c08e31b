"""Read-only book queries over resting orders, and books rebuilt from events alone."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def best_quotes(resting: DataFrame) -> DataFrame:
    bid, ask = F.col("side") == "bid", F.col("side") == "ask"
    return resting.groupBy("symbol").agg(F.max(F.when(bid, F.col("price"))).alias("best_bid"), F.min(F.when(ask, F.col("price"))).alias("best_ask"))


def levels(resting: DataFrame) -> DataFrame:
    """symbol, side, price, total, orders."""
    return resting.groupBy("symbol", "side", "price").agg(F.sum("qty").alias("total"), F.count(F.lit(1)).alias("orders"))


def level_total(resting: DataFrame, asked: DataFrame) -> DataFrame:
    """Total of each asked (symbol, side, price), 0 where there is no level."""
    return asked.join(levels(resting), ["symbol", "side", "price"], "left").select("symbol", "side", "price", F.coalesce("total", F.lit(0)).cast("long").alias("total"))


def counts(resting: DataFrame) -> DataFrame:
    """symbol, orders, bid_levels, ask_levels."""
    lv = levels(resting)
    n = lambda s: F.count(F.when(F.col("side") == s, 1))
    return lv.groupBy("symbol").agg(F.sum("orders").alias("orders"), n("bid").alias("bid_levels"), n("ask").alias("ask_levels"))


def depth(resting: DataFrame, n: int) -> DataFrame:
    """symbol, side, level (1 is best), price, total: the n best levels of each side."""
    towards = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    w = Window.partitionBy("symbol", "side").orderBy(towards)
    return levels(resting).withColumn("level", F.row_number().over(w)).filter(F.col("level") <= n).select("symbol", "side", F.col("level").cast("long").alias("level"), "price", "total")


def from_events(commands: DataFrame, events: DataFrame) -> DataFrame:
    """Resting orders (RESTING without the fold's state) from the event stream.

    A lifetime begins with an accepted event. Its price and quantity are those of its last
    accepted or replaced event, less later trades in which it is the maker; it lives if no
    closed event follows. Its place in its level is that of the last event that lost priority:
    accepted, or a replace that changed the price or raised the quantity.
    """
    by_order = Window.partitionBy("symbol", "id").orderBy("seq")
    so_far = by_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = events.filter("ev in ('accepted', 'replaced', 'closed')").select("symbol", F.col("order_id").alias("id"), "seq", "iseq", "ev", "price", F.coalesce("leaves_qty", "qty").alias("q"))
    fills = events.filter("ev = 'trade'").select("symbol", F.col("maker").alias("id"), "seq", "iseq", F.lit("fill").alias("ev"), F.lit(None).cast("long").alias("price"), F.col("qty").alias("q"))
    rows = own.unionByName(fills)
    born = F.when(F.col("ev") == "accepted", F.col("iseq"))
    rows = rows.withColumn("born", F.last(born, True).over(so_far)).filter("born is not null")
    life = Window.partitionBy("symbol", "id", "born").orderBy("seq")
    upto = life.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    new = commands.filter("cmd = 'new'").select(F.col("symbol").alias("s"), F.col("iseq").alias("i"), "side", "otype", "tif", F.col("price").alias("first_price"))
    rows = rows.join(new, (F.col("symbol") == F.col("s")) & (F.col("born") == F.col("i")))
    rows = rows.withColumn("at", F.when(F.col("ev") == "accepted", F.col("first_price")).when(F.col("ev") == "replaced", F.col("price")))
    rows = rows.withColumn("epoch", F.sum(F.when(F.col("ev").isin("accepted", "replaced"), 1).otherwise(0)).over(upto))
    in_epoch = Window.partitionBy("symbol", "id", "born", "epoch").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("left", F.first("q").over(in_epoch) - F.sum(F.when(F.col("ev") == "fill", F.col("q")).otherwise(0)).over(in_epoch))
    rows = rows.withColumn("before_left", F.lag("left").over(life)).withColumn("before_at", F.last("at", True).over(life.rowsBetween(Window.unboundedPreceding, -1)))
    lost = (F.col("ev") == "accepted") | ((F.col("ev") == "replaced") & ((F.col("at") != F.col("before_at")) | (F.col("left") > F.col("before_left"))))
    ends = rows.groupBy("symbol", "id", "born", "side", "otype", "tif").agg(
        F.max(F.struct("seq", "ev", "left")).alias("e"),
        F.max(F.when(F.col("at").isNotNull(), F.struct("seq", "at")))["at"].alias("price"),
        F.max(F.when(lost, F.col("seq"))).alias("place"),
    )
    live = ends.filter("e.ev <> 'closed' and e.left > 0")
    towards = F.when(F.col("side") == "bid", -F.col("price")).otherwise(F.col("price"))
    pos = F.row_number().over(Window.partitionBy("symbol").orderBy(F.when(F.col("side") == "bid", 0).otherwise(1), towards, "place"))
    return live.select("symbol", "side", (pos - 1).cast("long").alias("book_pos"), F.col("id").alias("order_id"), "otype", "tif", "price", F.col("e.left").alias("qty"))


def problems(resting: DataFrame) -> DataFrame:
    """symbol, problem: crossed books, empty orders, ids that rest twice."""
    q = best_quotes(resting)
    crossed = q.filter("best_bid >= best_ask").select("symbol", F.lit("crossed").alias("problem"))
    empty = resting.filter("qty <= 0").select("symbol", F.lit("empty order").alias("problem"))
    twice = resting.groupBy("symbol", "order_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("symbol", F.lit("id twice").alias("problem"))
    return crossed.unionByName(empty).unionByName(twice)
