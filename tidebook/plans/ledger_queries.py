"""Registered queries of the ledger, its settlement and its audits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import digest, metrics
from ..operators import audit, endpoints, flow, ledger, matching, replication, slices
from ..sources import adapters as A
from .queries import _events, register

#: Reference data of the fixtures: base, quote, lot, own fees (none: default).
SYMBOLS = {10: {"base": 1, "quote": 2, "lot": 1000}, 11: {"base": 3, "quote": 2, "lot": 10, "maker_ppm": 5000, "taker_ppm": 25000}}
DEFAULT_PPM = 15000
_CMD = [x.split(" ", 1) for x in ledger.CMDS.split(", ")]


def cmds(rows: DataFrame) -> DataFrame:
    """`rows` with the columns of ledger commands, absent ones null."""
    have = set(rows.columns)
    return rows.select(*[(F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in _CMD])


def _deposits(spark, d):
    return cmds(A.adapted(spark, d, A.DEPOSITS, "events").withColumn("cmd", F.lit("deposit")))


_D = f"SELECT *, row_number() OVER (PARTITION BY shard, external_id, amount > 0 ORDER BY lsn) AS nth FROM ({A.DEPOSITS})"


@register("deposit_outcomes", f"SELECT shard, lsn, CASE WHEN amount = 0 THEN 'rejected' WHEN nth = 1 THEN 'deposited' ELSE 'duplicate' END AS outcome, CASE WHEN amount = 0 THEN 'bad_amount' END AS reject FROM ({_D})")
def deposit_outcomes(spark, d):
    return ledger.run_ledger(_deposits(spark, d), SYMBOLS, DEFAULT_PPM, False).select("shard", "lsn", "outcome", "reject")


_BALANCE = f"SELECT shard, account, asset, CAST(sum(amount) AS BIGINT) AS available FROM ({_D}) WHERE amount > 0 AND nth = 1 GROUP BY ALL"


@register("deposit_balances", _BALANCE)
def deposit_balances(spark, d):
    s = ledger.run_ledger(_deposits(spark, d), SYMBOLS, DEFAULT_PPM)
    return s.filter("rec = 'balance'").select("shard", "account", "asset", F.col("amount").cast("long").alias("available"))


@register("deposit_balances_native", _BALANCE)
def deposit_balances_native(spark, d):
    """The same without a fold: the first row with money of each external id."""
    rows = A.adapted(spark, d, A.DEPOSITS, "events").filter("amount > 0")
    first = rows.groupBy("shard", "external_id").agg(F.min(F.struct("lsn", "account", "asset", "amount")).alias("r"))
    return first.groupBy("shard", "r.account", "r.asset").agg(F.sum("r.amount").alias("available"))


@register("balance_point", _BALANCE.replace("GROUP BY ALL", "AND account = 7 GROUP BY ALL"))
def balance_point(spark, d):
    s = ledger.run_ledger(_deposits(spark, d).filter(f"shard = {7 % 3}"), SYMBOLS, DEFAULT_PPM)
    return s.filter("rec = 'balance' and account = 7").select("shard", "account", "asset", F.col("amount").cast("long").alias("available"))


_TRADES_SYM = f"SELECT t.*, CASE symbol WHEN 0 THEN 10 ELSE 11 END AS sym FROM ({A.TRADES}) t"
_LEGS = f"""
  WITH s(sym, base, quote, lot, maker_ppm, taker_ppm) AS (VALUES (10, 1, 2, 1000, 15000, 15000), (11, 3, 2, 10, 5000, 25000)),
  t AS (SELECT t.*, s.* EXCLUDE (sym), price * qty AS cash, lot * qty AS goods FROM ({_TRADES_SYM}) t JOIN s USING (sym)),
  l AS (SELECT buyer AS account, quote AS asset, cash AS gross, 0 AS fee, 'out' AS flow FROM t
        UNION ALL SELECT buyer, base, goods, goods * (CASE WHEN taker_is_buy THEN taker_ppm ELSE maker_ppm END) // 1000000, 'in' FROM t
        UNION ALL SELECT seller, base, goods, 0, 'out' FROM t
        UNION ALL SELECT seller, quote, cash, cash * (CASE WHEN taker_is_buy THEN maker_ppm ELSE taker_ppm END) // 1000000, 'in' FROM t)"""


def symbols_table(spark):
    rows = [(s, c["base"], c["quote"], c["lot"], c.get("maker_ppm"), c.get("taker_ppm")) for s, c in SYMBOLS.items()]
    values = ", ".join("(" + ", ".join("null" if v is None else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"select cast(symbol as long) symbol, cast(base as long) base, cast(quote as long) quote, cast(lot as long) lot, cast(maker_ppm as long) maker_ppm, cast(taker_ppm as long) taker_ppm from values {values} as t(symbol, base, quote, lot, maker_ppm, taker_ppm)")


def _legs(spark, d):
    t = A.adapted(spark, d, A.TRADES, "lineitem", "part").withColumn("symbol", F.when(F.col("symbol") == 0, 10).otherwise(11).cast("long"))
    return flow.settle_sides(t, symbols_table(spark), DEFAULT_PPM)


@register("settlement_flows", _LEGS + "SELECT asset, CAST(sum(CASE WHEN flow = 'in' THEN gross ELSE 0 END) AS BIGINT) AS settled_in, CAST(sum(CASE WHEN flow = 'out' THEN gross ELSE 0 END) AS BIGINT) AS settled_out, CAST(sum(fee) AS BIGINT) AS fees FROM l GROUP BY asset")
def settlement_flows(spark, d):
    way = lambda w: F.sum(F.when(F.col("flow") == w, F.col("gross")).otherwise(0)).cast("long")
    return _legs(spark, d).groupBy("asset").agg(way("in").alias("settled_in"), way("out").alias("settled_out"), F.sum("fee").cast("long").alias("fees"))


@register("settlement_balances", _LEGS + "SELECT account, asset, CAST(sum(CASE WHEN flow = 'in' THEN gross - fee ELSE -gross END) AS BIGINT) AS delta FROM l GROUP BY ALL")
def settlement_balances(spark, d):
    return _legs(spark, d).groupBy("account", "asset").agg(F.sum("delta").cast("long").alias("delta"))


@register("fees_by_symbol", _LEGS.replace("'in' FROM t)", "'in' FROM t)") + ", f AS (SELECT sym AS symbol, (lot * qty) * (CASE WHEN taker_is_buy THEN taker_ppm ELSE maker_ppm END) // 1000000 AS fee FROM t) SELECT symbol, CAST(sum(fee) AS BIGINT) AS base_fees FROM f GROUP BY symbol")
def fees_by_symbol(spark, d):
    from ..functions import money

    t = A.adapted(spark, d, A.TRADES, "lineitem", "part").withColumn("symbol", F.when(F.col("symbol") == 0, 10).otherwise(11).cast("long")).join(symbols_table(spark), "symbol")
    fee = money.fee(F.col("lot") * F.col("qty"), money.fee_rate(F.col("taker_is_buy"), F.col("maker_ppm"), F.col("taker_ppm"), DEFAULT_PPM))
    return t.groupBy("symbol").agg(F.sum(fee).cast("long").alias("base_fees"))


def exchange_cmds(spark, d) -> DataFrame:
    """A whole session on three shards: deposits, then orders that cross at one price, settled."""
    e = _events(spark, d).filter("event_type in ('click', 'view')").select("event_id", F.col("user_id").alias("account"), F.pmod("user_id", F.lit(3)).alias("shard"), "event_type")
    two = e.select("shard", "account").distinct().withColumn("asset", F.explode(F.array(F.lit(1), F.lit(2))))
    fund = two.select("shard", "account", "asset", F.lit(10**12).alias("amount"), (F.col("account") * 4 + F.col("asset")).alias("external_id"), (F.col("account") * 4 + F.col("asset")).alias("lsn"), F.lit("deposit").alias("cmd"))
    side = F.when(F.col("event_type") == "click", "buy").otherwise("sell")
    order = e.select("shard", "account", F.lit("reserve").alias("cmd"), F.lit(10).alias("symbol"), side.alias("side"), F.lit(100).alias("price"), (1 + F.col("event_id") % 7).alias("qty"), (10**6 + F.col("event_id")).alias("lsn"))
    return cmds(fund.unionByName(order, True))


@register("order_holds", """
  WITH e AS (SELECT user_id AS account, user_id % 3 AS shard, event_type, 1 + event_id % 7 AS qty FROM events WHERE event_type IN ('click', 'view'))
  SELECT shard, account, CASE event_type WHEN 'click' THEN 2 ELSE 1 END AS asset, CAST(sum(CASE event_type WHEN 'click' THEN 100 * qty ELSE 1000 * qty END) AS BIGINT) AS held FROM e GROUP BY ALL""")
def order_holds(spark, d):
    s = ledger.run_ledger(exchange_cmds(spark, d), SYMBOLS, DEFAULT_PPM)
    return s.filter("rec = 'balance' and held > 0").select("shard", "account", "asset", F.col("held").cast("long").alias("held"))


@register("ledger_audit", "SELECT '' AS rule, '' AS key, '' AS detail WHERE FALSE")
def ledger_audit(spark, d):
    """Every identity over the state of the session: no violation."""
    s = ledger.run_ledger(exchange_cmds(spark, d), SYMBOLS, DEFAULT_PPM)
    return audit.full_round(s, symbols_table(spark).select("symbol", "base", "quote", "lot"))


@register("ledger_state_digest")
def ledger_state_digest(spark, d):
    s = ledger.run_ledger(exchange_cmds(spark, d), SYMBOLS, DEFAULT_PPM)
    return digest.state_digest(s.filter("rec <> 'outcome'").drop("lsn"), ["shard"])


@register("forwarded_commands", """
  SELECT shard, n - 1 AS outbox_idx, 10::BIGINT AS symbol, 'new' AS cmd, shard * 281474976710656 + n AS order_id, side, 'limit' AS otype, 100::BIGINT AS price, qty, 'gtc' AS tif
  FROM (SELECT user_id % 3 AS shard, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n, CASE event_type WHEN 'click' THEN 'bid' ELSE 'ask' END AS side, 1 + event_id % 7 AS qty FROM events WHERE event_type IN ('click', 'view'))""")
def forwarded(spark, d):
    s = ledger.run_ledger(exchange_cmds(spark, d), SYMBOLS, DEFAULT_PPM)
    return flow.forwarded_commands(s.filter("rec = 'outbox'"))


@register("archive_of_matching", f"""
  WITH f AS ({A.SWEEP}),
  m AS (SELECT *, sum(qty) OVER (PARTITION BY symbol ORDER BY price, iseq) AS hi FROM f WHERE side = 'ask'),
  t AS (SELECT *, sum(qty) OVER (PARTITION BY symbol ORDER BY iseq) AS hi FROM f WHERE side = 'bid'),
  x AS (SELECT m.symbol, CAST(m.price AS BIGINT) AS price, t.order_id AS buy, m.order_id AS sell, least(m.hi, t.hi) - greatest(m.hi - m.qty, t.hi - t.qty) AS qty FROM m JOIN t ON m.symbol = t.symbol AND m.hi > t.hi - t.qty AND t.hi > m.hi - m.qty)
  SELECT 'trade' AS kind, symbol, symbol % 4 AS source, buy AS iseq, buy, sell, price, CAST(qty AS BIGINT) AS qty, TRUE AS taker_is_buy, NULL::BIGINT AS order_id FROM x
  UNION ALL SELECT 'closed', symbol, symbol % 4, order_id, NULL, NULL, NULL, NULL, NULL, order_id FROM (SELECT t.symbol, t.order_id FROM t LEFT JOIN (SELECT buy, sum(qty) AS q FROM x GROUP BY buy) b ON t.order_id = b.buy WHERE coalesce(b.q, 0) < t.qty)""")
def archive_of_matching(spark, d):
    """Trades and releases that a ledger would be sent."""
    c = A.commands(spark, d, A.SWEEP)
    e = matching.match(c, A.ROOM).withColumn("source", F.col("symbol") % 4)
    sent = c.select("symbol", "iseq", "order_id", F.when(F.col("side") == "bid", "buy").otherwise("sell").alias("side"))
    return flow.archive_events(e, sent).select("kind", "symbol", "source", "iseq", "buy", "sell", "price", "qty", "taker_is_buy", "order_id")


@register("order_audit", """
  WITH a AS (SELECT o_orderkey AS order_id, 3 AS qty FROM orders WHERE o_orderkey % 5 > 0),
  s AS (SELECT l_orderkey AS order_id, count(*) AS filled FROM lineitem GROUP BY 1),
  j AS (SELECT a.order_id, qty, coalesce(filled, 0) AS filled FROM a LEFT JOIN s USING (order_id))
  SELECT rule, count(*) AS n FROM (
    SELECT 'overfilled' AS rule FROM j WHERE filled > qty UNION ALL SELECT 'released unfilled' FROM j WHERE filled < qty AND order_id % 7 <> 0
    UNION ALL SELECT 'still open' FROM j WHERE order_id % 7 = 0 UNION ALL SELECT 'never acknowledged' FROM s WHERE order_id NOT IN (SELECT order_id FROM a)) GROUP BY rule""")
def order_audit(spark, d):
    """Orders against an archive made of line items, each a fill of one."""
    orders = spark.read.parquet(f"{d}/orders.parquet")
    acked = orders.filter("o_orderkey % 5 > 0").selectExpr("o_orderkey as order_id", "3L as qty")
    nil = F.lit(None).cast("long")
    fills = spark.read.parquet(f"{d}/lineitem.parquet").select(F.lit("trade").alias("kind"), F.col("l_orderkey").alias("buy"), nil.alias("sell"), nil.alias("order_id"), F.lit(1).cast("long").alias("qty"))
    opened = acked.filter("order_id % 7 = 0").select("order_id")
    return audit.order_audit(acked, fills, opened).groupBy("rule").agg(F.count(F.lit(1)).alias("n"))


@register("money_audit", f"SELECT 'acknowledged money' AS rule, 'deposited/' || asset AS key, CAST(CAST(-sum(amount) AS BIGINT) AS VARCHAR) AS detail FROM (SELECT asset, amount FROM ({_D}) WHERE amount > 0 AND nth > 1) GROUP BY asset")
def money_audit(spark, d):
    """Clients that count repeated deposits as money: the audit names each asset and the excess."""
    s = ledger.run_ledger(_deposits(spark, d), SYMBOLS, DEFAULT_PPM)
    claimed = A.adapted(spark, d, A.DEPOSITS, "events").select(F.lit("deposited").alias("kind"), "asset", "amount")
    return audit.money_audit(claimed, s)


@register("intake_with_gaps")
def intake_with_gaps(spark, d):
    e = _events(spark, d)
    return flow.intake(e.selectExpr("user_id % 3 as shard", "event_id * 7919 % 10007 as arrival", "event_id div 3 as idx"))


@register("credit_demand", """
  SELECT account, asset FROM (SELECT user_id AS account, 1 + event_id % 3 AS asset, event_type, row_number() OVER (PARTITION BY user_id, event_id % 3 ORDER BY event_id DESC) AS r
  FROM events WHERE event_type IN ('error', 'purchase')) WHERE r = 1 AND event_type = 'error'""")
def credit_demand(spark, d):
    e = _events(spark, d).selectExpr("event_id as idx", "user_id as account", "1 + event_id % 3 as asset", "case event_type when 'error' then 'insufficient' when 'purchase' then 'grant' else 'other' end as kind")
    return slices.demand(e)


@register("credit_epochs", "SELECT user_id % 4 AS grp, CAST((row_number() OVER (PARTITION BY user_id % 4 ORDER BY event_id) - 1) // 100 AS BIGINT) AS epoch, event_id AS idx FROM events")
def credit_epochs(spark, d):
    return slices.epochs(_events(spark, d).selectExpr("user_id % 4 as grp", "event_id as idx"), 100).select("grp", "epoch", "idx")


@register("slice_deltas", "SELECT account, asset, CASE WHEN gap > 0 THEN 'slice_in' ELSE 'slice_out' END AS event, abs(gap) AS amount FROM (SELECT event_id AS account, event_id % 3 AS asset, event_id % 11 - event_id % 7 AS gap FROM events) WHERE gap <> 0")
def slice_deltas(spark, d):
    return slices.slice_deltas(_events(spark, d).selectExpr("event_id as account", "event_id % 3 as asset", "event_id % 11 as total", "event_id % 7 as in_", "0L as out"))


_NODES = "SELECT event_id % 3 AS node, event_id // 3 AS idx, CASE WHEN event_id % 31 = 0 THEN 'x' WHEN event_id % 17 = 0 THEN event_type ELSE 'd' END AS digest FROM events"


def _nodes(spark, d):
    return _events(spark, d).selectExpr("event_id % 3 as node", "event_id div 3 as idx", "case when event_id % 31 = 0 then 'x' when event_id % 17 = 0 then event_type else 'd' end as digest")


@register("digest_divergence", f"""
  WITH n AS ({_NODES}), v AS (SELECT *, count(*) OVER (PARTITION BY idx, digest) AS votes FROM n), w AS (SELECT *, max(votes) OVER (PARTITION BY idx) AS most, count(*) OVER (PARTITION BY idx) AS reported FROM v)
  SELECT node, idx, CASE WHEN votes >= 2 THEN FALSE WHEN most >= 2 THEN TRUE ELSE reported = 3 END AS halt FROM w""")
def digest_divergence(spark, d):
    return audit.divergence(_nodes(spark, d), 3)


@register("digest_audit", f"SELECT 'digests differ' AS rule, CAST(idx AS VARCHAR) AS key, CAST(count(DISTINCT digest) AS VARCHAR) AS detail FROM ({_NODES}) GROUP BY idx HAVING count(DISTINCT digest) > 1")
def digest_audit(spark, d):
    return audit.digest_audit(_nodes(spark, d))


@register("mark_audit", """
  SELECT shard, source, mark, last, mark = last AS caught_up, mark > e AS ahead FROM (
    SELECT user_id % 3 AS shard, user_id % 4 AS source, max(event_id) AS last, max(event_id) - (user_id % 3) % 2 AS mark FROM events GROUP BY 1, 2, (user_id % 3) % 2)
  JOIN (SELECT user_id % 4 AS source, max(event_id) AS e FROM events GROUP BY 1) USING (source)""")
def mark_audit(spark, d):
    e = _events(spark, d).selectExpr("user_id % 4 as source", "user_id % 3 as shard", "event_id as idx")
    marks = e.groupBy("shard", "source").agg((F.max("idx") - F.col("shard") % 2).alias("mark"))
    return audit.mark_audit(marks, e, e.groupBy("source").agg(F.max("idx").alias("end")))


@register("thinned_spans", "SELECT shard, page, grp, messages, first, \"end\" FROM (SELECT user_id % 3 AS shard, event_id // 64 AS page, user_id % 5 AS grp, count(*) AS messages FROM events GROUP BY ALL) JOIN (SELECT user_id % 3 AS shard, event_id // 64 AS page, min(event_id) AS first, max(event_id) + 1 AS \"end\" FROM events GROUP BY ALL) USING (shard, page)")
def thinned_spans(spark, d):
    return flow.thin_spans(_events(spark, d).selectExpr("user_id % 3 as shard", "event_id as idx", "user_id % 5 as grp"), 64)


@register("trim_points", "SELECT shard, min(c) AS upto FROM (SELECT user_id % 3 AS shard, user_id % 5 AS grp, max(event_id) AS c FROM events GROUP BY ALL) GROUP BY shard")
def trim_points(spark, d):
    c = _events(spark, d).groupBy((F.col("user_id") % 3).alias("shard"), (F.col("user_id") % 5).alias("grp")).agg(F.max("event_id").alias("cursor"))
    return flow.trim_point(c)


# --- read endpoints, metrics and replicated-log invariants ---

def _session(spark, d, shard: int):
    """The session of one shard: a point read folds no other."""
    return ledger.run_ledger(exchange_cmds(spark, d).filter(F.col("shard") == shard), SYMBOLS, DEFAULT_PPM)


_RESERVES = "SELECT user_id % 3 AS shard, event_id, event_type, 1 + event_id % 7 AS qty, row_number() OVER (PARTITION BY user_id % 3 ORDER BY event_id) AS n FROM events WHERE event_type IN ('click', 'view')"


@register("endpoint_state", f"SELECT count(*) + 2 * (SELECT count(DISTINCT user_id) FROM events WHERE event_type IN ('click', 'view') AND user_id % 3 = 1) AS applied, 0::BIGINT AS clock, 0::BIGINT AS outbox_base, count(*) AS outbox_next, count(*) AS open_orders, 0::BIGINT AS anomalies, 0::BIGINT AS mark_0 FROM ({_RESERVES}) WHERE shard = 1")
def endpoint_state(spark, d):
    return endpoints.state(_session(spark, d, 1), 1, [0])


@register("endpoint_outbox", f"SELECT n - 1 AS outbox_idx, 'submit' AS name, (CAST(1 AS BIGINT) << 48) + n AS order_id, 10::BIGINT AS symbol, CASE event_type WHEN 'click' THEN 'buy' ELSE 'sell' END AS side, 100::BIGINT AS price, qty FROM ({_RESERVES}) WHERE shard = 1 AND n > 20 ORDER BY n LIMIT 50")
def endpoint_outbox(spark, d):
    return endpoints.outbox_page(_session(spark, d, 1), 1, 20, 50)


@register("endpoint_balance", f"SELECT 1000000000000 - CAST(sum(CASE WHEN event_type = 'click' THEN 100 * qty ELSE 0 END) AS BIGINT) AS available, CAST(sum(CASE WHEN event_type = 'click' THEN 100 * qty ELSE 0 END) AS BIGINT) AS held FROM (SELECT *, 1 + event_id % 7 AS qty FROM events WHERE user_id = 7 AND event_type IN ('click', 'view'))")
def endpoint_balance(spark, d):
    return endpoints.balance(_session(spark, d, 7 % 3), 7, 2)


@register("endpoint_order", f"SELECT TRUE AS found, (SELECT user_id FROM events e WHERE e.event_id = r.event_id) AS account, 10::BIGINT AS symbol, CASE event_type WHEN 'click' THEN 'buy' ELSE 'sell' END AS side, 100::BIGINT AS price, qty, CAST(CASE event_type WHEN 'click' THEN 100 ELSE 1000 END * qty AS BIGINT) AS held, FALSE AS cancelling FROM ({_RESERVES}) r WHERE shard = 1 AND n = 5")
def endpoint_order(spark, d):
    return endpoints.order(_session(spark, d, 1), (1 << 48) + 5).withColumn("held", F.col("held").cast("long"))


@register("endpoint_cursors", "SELECT user_id % 5 AS grp, user_id % 3 AS shard, max(event_id) + 1 AS cursor FROM events GROUP BY ALL")
def endpoint_cursors(spark, d):
    return endpoints.cursors(_events(spark, d).selectExpr("user_id % 5 as grp", "user_id % 3 as shard", "event_id as idx"))


@register("endpoint_request", "SELECT 'ok' AS status, max(event_id) AS result FROM events WHERE user_id = 3")
def endpoint_request(spark, d):
    r = _events(spark, d).selectExpr("user_id as client", "event_id as seq", "event_id as result")
    last = r.filter("client = 3").agg(F.max("seq")).first()[0]
    return endpoints.request_result(r, 3, last)


@register("metrics_by_partition", "SELECT user_id % 4 AS partition, count(*) AS events, count(DISTINCT event_id // 2) AS commands, count(*) FILTER (event_type = 'purchase') AS trades FROM events GROUP BY ALL")
def metrics_by_partition(spark, d):
    e = _events(spark, d).selectExpr("user_id % 4 as partition", "event_id div 2 as iseq", "if(event_type = 'purchase', 'trade', 'accepted') as ev")
    return metrics.by_partition(e)


@register("metrics_text", """
  SELECT name, p AS partition, 'stream_' || name || '_total{partition="' || p || '"} ' || n AS line FROM (
    SELECT p, unnest(['events', 'commands', 'trades']) AS name, unnest([e, c, t]) AS n FROM (SELECT user_id % 4 AS p, count(*) AS e, count(DISTINCT event_id // 3) AS c, count(*) FILTER (event_type = 'purchase') AS t FROM events GROUP BY 1))""")
def metrics_text(spark, d):
    e = _events(spark, d).selectExpr("user_id % 4 as partition", "event_id div 3 as iseq", "if(event_type = 'purchase', 'trade', 'accepted') as ev")
    return metrics.prometheus(metrics.by_partition(e))


@register("metrics_latency", "SELECT user_id % 4 AS partition, count(*) AS events, count(*) AS commands, 0::BIGINT AS trades, CAST(sum(event_id * 7 % 100) AS BIGINT) AS latency_sum, max(event_id * 7 % 100) AS latency_max FROM events GROUP BY ALL")
def metrics_latency(spark, d):
    e = _events(spark, d).selectExpr("user_id % 4 as partition", "event_id as iseq", "0 as ordinal", "'accepted' as ev", "event_id * 1000 + event_id * 7 % 100 as t_evt")
    return metrics.by_partition(e, _events(spark, d).selectExpr("event_id as iseq", "event_id * 1000 as t_pub"))


@register("replication_votes", "SELECT 'votes' AS rule, user_id || '/' || term AS key FROM (SELECT event_id // 50 AS term, user_id, event_type FROM events WHERE event_id % 3 > 0) GROUP BY term, user_id HAVING count(DISTINCT event_type) > 1")
def replication_votes(spark, d):
    v = _events(spark, d).selectExpr("event_id div 50 as term", "user_id as voter", "event_type as candidate", "event_id % 3 > 0 as granted")
    return replication.one_vote(v)


@register("replication_leaders", "SELECT 'leaders' AS rule, CAST(event_id // 5 AS VARCHAR) AS key FROM events WHERE event_type = 'purchase' GROUP BY event_id // 5 HAVING count(DISTINCT user_id % 3) > 1")
def replication_leaders(spark, d):
    return replication.one_leader(_events(spark, d).filter("event_type = 'purchase'").selectExpr("event_id div 5 as term", "user_id % 3 as node"))


@register("replication_commit", "SELECT term, matched AS committed FROM (SELECT event_id // 5 AS term, event_id * 7919 % 1000 AS matched, event_id // 5 - event_id % 2 AS mt, row_number() OVER (PARTITION BY event_id // 5 ORDER BY event_id * 7919 % 1000 DESC, event_id % 5) AS r FROM events) WHERE r = 3 AND mt = term")
def replication_commit(spark, d):
    m = _events(spark, d).selectExpr("event_id div 5 as term", "event_id % 5 as node", "event_id * 7919 % 1000 as matched", "event_id div 5 - event_id % 2 as matched_term")
    return replication.commit_index(m, 3)


@register("replication_apply_order", "SELECT 'applied order' AS rule, node || '/' || life || '/' || place AS key FROM (SELECT *, lag(idx) OVER (PARTITION BY node, life ORDER BY place) AS b FROM (SELECT user_id % 3 AS node, user_id % 2 AS life, row_number() OVER (PARTITION BY user_id % 3, user_id % 2 ORDER BY event_id) AS place, row_number() OVER (PARTITION BY user_id % 3, user_id % 2 ORDER BY event_id) + event_id // 900 AS idx FROM events)) WHERE idx <> b + 1")
def replication_apply_order(spark, d):
    w = Window.partitionBy(F.expr("user_id % 3"), F.expr("user_id % 2")).orderBy("event_id")
    a = _events(spark, d).select(F.expr("user_id % 3").alias("node"), F.expr("user_id % 2").alias("life"), F.row_number().over(w).cast("long").alias("place"), (F.row_number().over(w) + F.expr("event_id div 900")).alias("idx"))
    return replication.applied_in_order(a)


_DIFFERS = "event_id % 1000 = 700"


@register("replication_log_matching", f"""
  WITH l AS (SELECT event_id // 3 AS idx, event_id // 300 AS term, min(CASE WHEN {_DIFFERS} THEN event_id // 3 END) OVER () AS bad FROM events)
  SELECT 'log matching' AS rule, idx || '/' || term AS key FROM l WHERE idx >= bad GROUP BY idx, term HAVING count(*) > 1""")
def replication_log_matching(spark, d):
    """Three nodes' logs of one entry for three events; some payloads differ, the first at event 700."""
    logs = _events(spark, d).selectExpr("event_id % 3 as node", "event_id div 3 as idx", "event_id div 300 as term", f"if({_DIFFERS}, 'other', concat('p', event_id div 3)) as payload")
    return replication.log_matching(logs)


@register("replication_completeness", """
  WITH c AS (SELECT event_id AS idx, 1 + event_id % 3 AS term FROM events), l AS (SELECT range AS led FROM range(2, 6)),
  h AS (SELECT led, count(*) FILTER (term < led) AS due, count(*) FILTER (NOT (led = 4 AND idx % 11 = 2) AND term < led) AS have FROM c, l GROUP BY led)
  SELECT 'leader completeness' AS rule, CAST(led AS VARCHAR) AS key FROM h WHERE have < due""")
def replication_completeness(spark, d):
    """Leaders of terms 2 to 5 over committed entries of terms 1 to 3; the one of term 4 lacks some."""
    committed = _events(spark, d).selectExpr("event_id as idx", "1 + event_id % 3 as term")
    logs = committed.withColumn("led_term", F.explode(F.array(*[F.lit(t).cast("long") for t in range(2, 6)]))).filter("term < led_term and not (led_term = 4 and idx % 11 = 2)")
    return replication.leader_completeness(committed, logs)
