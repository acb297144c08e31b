"""Dataflow between matching and ledgers: archiving, settlement, intake, spans, forwarding."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import money
from .fold import fold

_D = "decimal(38,0)"


def archive_events(events: DataFrame, forwarded: DataFrame) -> DataFrame:
    """The settlement events of a matching stream: source, iseq, ordinal, kind, buy, sell,
    price, qty, taker_is_buy, order_id; kind `unmapped` for trades whose sides are unknown.

    events: EVENTS with `source`. forwarded: symbol, iseq, order_id, side (buy, sell): the new
    orders that were sent. A side holds from its order's command until the order's next end,
    so a reused id has the side of its own lifetime: an as-of join by window.
    """
    ends = "(ev = 'closed' or (ev = 'rejected' and reason not in ('duplicate_order_id', 'unknown_order_id')))"
    uses = events.filter(f"ev = 'trade' or {ends}").withColumn("who", F.explode(F.expr("if(ev = 'trade', array(struct('m' as role, maker as id), struct('t' as role, taker as id)), array(struct('o' as role, order_id as id)))")))
    uses = uses.select("source", "symbol", "iseq", "ordinal", "ev", "reason", "price", "qty", "who.role", "who.id", F.lit(None).cast("string").alias("side"))
    starts = forwarded.select(F.lit(None).cast("long").alias("source"), "symbol", "iseq", F.lit(-1).alias("ordinal"), F.lit("start").alias("ev"), F.lit(None).cast("string").alias("reason"), F.lit(None).cast("long").alias("price"), F.lit(None).cast("long").alias("qty"), F.lit("s").alias("role"), F.col("order_id").alias("id"), "side")
    w = Window.partitionBy("symbol", "id").orderBy("iseq", "ordinal", "role")
    rows = uses.unionByName(starts)
    change = F.when(F.col("ev") == "start", F.col("side")).when(F.col("ev") != "trade", F.lit("none"))
    rows = rows.withColumn("known", F.last(change, True).over(w.rowsBetween(Window.unboundedPreceding, -1)))
    # a start while the id is live does not change its side: a duplicate is refused
    known = F.when(F.col("known") != "none", F.col("known"))
    rows = rows.filter("ev <> 'start'").withColumn("known", known)
    pair = rows.filter("ev = 'trade'").groupBy("source", "symbol", "iseq", "ordinal", "price", "qty").agg(
        F.max(F.when(F.col("role") == "m", F.col("id"))).alias("maker"), F.max(F.when(F.col("role") == "t", F.col("id"))).alias("taker"),
        F.max(F.when(F.col("role") == "m", F.col("known"))).alias("ms"), F.max(F.when(F.col("role") == "t", F.col("known"))).alias("ts"),
    )
    ok = F.coalesce((F.col("ms") != F.col("ts")) & (F.col("price") >= 0), F.lit(False))
    buy = F.col("ts") == "buy"
    trades = pair.select(
        "source", "symbol", "iseq", "ordinal", F.when(ok, "trade").otherwise("unmapped").alias("kind"),
        F.when(buy, F.col("taker")).otherwise(F.col("maker")).alias("buy"), F.when(buy, F.col("maker")).otherwise(F.col("taker")).alias("sell"),
        "price", "qty", buy.alias("taker_is_buy"), F.lit(None).cast("long").alias("order_id"),
    )
    nil = lambda t: F.lit(None).cast(t)
    closed = rows.filter("ev <> 'trade' and known is not null and not (ev = 'closed' and reason = 'filled')").select(
        "source", "symbol", "iseq", "ordinal", F.lit("closed").alias("kind"), nil("long").alias("buy"), nil("long").alias("sell"), nil("long").alias("price"), nil("long").alias("qty"), nil("boolean").alias("taker_is_buy"), F.col("id").alias("order_id"),
    )
    return trades.unionByName(closed)


def settle_sides(trades: DataFrame, symbols: DataFrame, default_ppm: int) -> DataFrame:
    """Both sides of each trade as balance changes: account, asset, delta, fee, flow (in, out).

    trades: symbol, buyer, seller, price, qty, taker_is_buy. symbols: symbol, base, quote, lot,
    maker_ppm, taker_ppm (null: default). For trades whose orders are known to be sound; the
    fold of ledger.py checks each one.
    """
    t = trades.join(symbols, "symbol")
    goods, cash = money.product(F.col("lot"), F.col("qty")), money.product(F.col("price"), F.col("qty"))

    def leg(who, asset, amount, way, taker):
        fee = money.fee(amount, money.fee_rate(taker, F.col("maker_ppm"), F.col("taker_ppm"), default_ppm)) if way == "in" else F.lit(0).cast(_D)
        return F.struct(F.col(who).alias("account"), F.col(asset).alias("asset"), amount.alias("gross"), fee.cast(_D).alias("fee"), F.lit(way).alias("flow"))

    legs = F.array(
        leg("buyer", "quote", cash, "out", F.col("taker_is_buy")), leg("buyer", "base", goods, "in", F.col("taker_is_buy")),
        leg("seller", "base", goods, "out", ~F.col("taker_is_buy")), leg("seller", "quote", cash, "in", ~F.col("taker_is_buy")),
    )
    e = t.select(F.explode(legs).alias("l")).select("l.*")
    return e.withColumn("delta", F.when(F.col("flow") == "in", F.col("gross") - F.col("fee")).otherwise(-F.col("gross")).cast(_D))


INTAKE = "shard long, arrival long, idx long, outcome string, cursor long"


def intake(arrivals: DataFrame) -> DataFrame:
    """Outcome of each arrival (shard, arrival, idx): applied at the cursor, duplicate below it,
    gap above it (to be sent again)."""

    def step(shard, rows):
        cursor = 0
        for r in rows:
            outcome = "applied" if r["idx"] == cursor else "duplicate" if r["idx"] < cursor else "gap"
            cursor += outcome == "applied"
            yield shard, r["arrival"], r["idx"], outcome, cursor

    return fold(arrivals, "shard", ["arrival"], step, INTAKE, ["shard", "arrival", "idx"])


SPANS = "shard long, arrival long, first long, end long, outcome string, skip long, cursor long"


def span_intake(spans: DataFrame) -> DataFrame:
    """Spans [first, end) apply if first <= cursor < end; what lies below the cursor is skipped."""

    def step(shard, rows):
        cursor = 0
        for r in rows:
            ok = r["first"] <= cursor < r["end"]
            outcome, skip = ("applied", cursor - r["first"]) if ok else ("gap" if r["first"] > cursor else "duplicate", None)
            cursor = r["end"] if ok else cursor
            yield shard, r["arrival"], r["first"], r["end"], outcome, skip, cursor

    return fold(spans, "shard", ["arrival"], step, SPANS, ["shard", "arrival", "first", "end"])


def thin_spans(outbox: DataFrame, page: int) -> DataFrame:
    """outbox: shard, idx, grp. Per shard, page of `page` messages and group: how many it owns and
    the covered range [first, end)."""
    p = outbox.withColumn("page", F.expr(f"idx div {page}"))
    cover = p.groupBy("shard", "page").agg(F.min("idx").alias("first"), (F.max("idx") + 1).alias("end"))
    return p.groupBy("shard", "page", "grp").agg(F.count(F.lit(1)).alias("messages")).join(cover, ["shard", "page"])


def trim_point(cursors: DataFrame) -> DataFrame:
    """shard, upto: a ledger may trim below the least cursor of its groups."""
    return cursors.groupBy("shard").agg(F.min("cursor").alias("upto"))


def forwarded_commands(outbox: DataFrame) -> DataFrame:
    """Ledger messages as matching commands: submit is a resting limit order, submit_ioc an
    immediate one; prices beyond a signed long become -1, which matching refuses."""
    price = F.when(F.col("price") < 0, F.lit(-1)).otherwise(F.col("price"))  # ids and prices from 2^63 on are negative here
    new = F.col("name").isin("submit", "submit_ioc")
    return outbox.filter("name in ('submit', 'submit_ioc', 'cancel')").select(
        "shard", "outbox_idx", "symbol", F.when(new, "new").otherwise("cancel").alias("cmd"), "order_id",
        F.when(new, F.when(F.col("side") == "buy", "bid").otherwise("ask")).alias("side"), F.when(new, "limit").alias("otype"), F.when(new, price).alias("price"), F.when(new, F.col("qty")).alias("qty"),
        F.when(F.col("name") == "submit", "gtc").when(F.col("name") == "submit_ioc", "ioc").alias("tif"),
    )


def trade_sides(trades: DataFrame, orders: DataFrame) -> DataFrame:
    """A ledger's own sides of each trade: source, idx, side, order_id and `sound`: whether the order
    is open, on that side, large enough and as good as the price. A side of another shard is left out.

    trades: shard, source, idx, buy, sell, price, qty. orders: the `order` rows of ledger.ROWS."""
    sides = trades.select("shard", "source", "idx", "price", "qty", F.explode(F.array(*[F.struct(F.lit(s).alias("side"), F.col(s).alias("order_id")) for s in ("buy", "sell")])).alias("s")).select("shard", "source", "idx", F.col("price").alias("at"), F.col("qty").alias("traded"), "s.side", "s.order_id")
    own = sides.filter(F.shiftrightunsigned("order_id", 48) == F.col("shard"))
    o = orders.select(F.col("shard").alias("_s"), F.col("order_id").alias("_o"), F.col("side").alias("_side"), "price", F.col("qty").alias("left"))
    j = own.join(o, (F.col("shard") == F.col("_s")) & (F.col("order_id") == F.col("_o")), "left")
    good = F.when(F.col("side") == "buy", F.col("at") <= F.col("price")).otherwise(F.col("at") >= F.col("price"))
    sound = (F.col("side") == F.col("_side")) & (F.col("traded") > 0) & (F.col("traded") <= F.col("left")) & good
    return j.select("shard", "source", "idx", "side", "order_id", F.coalesce(sound, F.lit(False)).alias("sound"))


def tick_commands(shards: DataFrame, now_ns: int, max_age_ns: int, retry_ns: int, most: int) -> DataFrame:
    """What a tick sends each shard (shard, lsn of its last command): its clock, then a sweep."""
    rows = F.array(F.struct(F.lit(1).cast("long").alias("k"), F.lit("clock").alias("cmd")), F.struct(F.lit(2).cast("long").alias("k"), F.lit("sweep").alias("cmd")))
    of = lambda cmd, v: F.when(F.col("t.cmd") == cmd, F.lit(v).cast("long"))
    return shards.select("shard", "lsn", F.explode(rows).alias("t")).select(
        "shard", (F.col("lsn") + F.col("t.k")).alias("lsn"), "t.cmd", of("clock", now_ns).alias("now_ns"), of("sweep", max_age_ns).alias("max_age_ns"), of("sweep", retry_ns).alias("retry_ns"), of("sweep", most).cast("int").alias("max"),
    )
