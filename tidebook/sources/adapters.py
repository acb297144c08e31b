"""Deterministic adapters from the star-schema and event tables to command, ledger and
settlement streams. Each is written once as Spark SQL that DuckDB reads as well, so a query
and its oracle share the input's definition but not the operator."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

SYMBOLS = 8


def _flow(kind_columns: str) -> str:
    """Commands of an events view `events`; cancels aim at the user's latest click or view."""
    return f"""
        SELECT event_id + 1 AS iseq, user_id % {SYMBOLS} AS symbol, event_id, event_type,
               CASE WHEN event_type = 'error' THEN 'cancel' ELSE 'new' END AS cmd,
               CASE WHEN event_type = 'error'
                    THEN COALESCE(MAX(CASE WHEN event_type IN ('click', 'view') THEN event_id + 1 END)
                           OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1000000000 + event_id)
                    ELSE event_id + 1 END AS order_id,
               {kind_columns}
        FROM events"""


#: Orders that cross: bids and asks over one price range, all order types.
CROSSING = _flow("""
               CASE WHEN event_type IN ('click', 'purchase') THEN 'bid' WHEN event_type IN ('view', 'signup') THEN 'ask' END AS side,
               CASE WHEN event_type = 'signup' THEN 'market' WHEN event_type <> 'error' THEN 'limit' END AS otype,
               CASE WHEN event_type <> 'error' THEN 980 + event_id * 7919 % 41 END AS price,
               CASE WHEN event_type <> 'error' THEN 1 + event_id * 31 % 9 END AS qty,
               CASE WHEN event_type IN ('click', 'view') THEN 'gtc' WHEN event_type <> 'error' THEN 'ioc' END AS tif""")
#: Orders that never cross: bids from 900 to 949, asks from 1051 to 1100, all resting.
PASSIVE = _flow("""
               CASE WHEN event_type IN ('click', 'purchase') THEN 'bid' WHEN event_type <> 'error' THEN 'ask' END AS side,
               CASE WHEN event_type <> 'error' THEN 'limit' END AS otype,
               CASE WHEN event_type IN ('click', 'purchase') THEN 900 + event_id * 7919 % 50 WHEN event_type <> 'error' THEN 1051 + event_id * 7919 % 50 END AS price,
               CASE WHEN event_type <> 'error' THEN 1 + event_id * 31 % 9 END AS qty,
               CASE WHEN event_type <> 'error' THEN 'gtc' END AS tif""")
#: The closed forms of these flows know no full book: whatever was sent may rest.
ROOM = {"max_orders": 1 << 40}
#: A static book swept by market orders: the first half of the events rest as asks.
SWEEP = f"""
        SELECT event_id + 1 AS iseq, user_id % {SYMBOLS} AS symbol, event_id, event_type, 'new' AS cmd, event_id + 1 AS order_id,
               CASE WHEN event_id < half THEN 'ask' ELSE 'bid' END AS side,
               CASE WHEN event_id < half THEN 'limit' ELSE 'market' END AS otype,
               CASE WHEN event_id < half THEN 980 + event_id * 7919 % 41 ELSE 0 END AS price,
               1 + event_id * 31 % 9 AS qty, 'gtc' AS tif
        FROM events CROSS JOIN (SELECT CAST(FLOOR(COUNT(*) / 2) AS BIGINT) AS half FROM events) h"""
#: Deposits with repeated external ids and amounts of zero. One row per event.
DEPOSITS = """
        SELECT event_id AS lsn, user_id AS account, 1 + event_id % 3 AS asset,
               CASE WHEN event_id % 97 = 0 THEN 0 ELSE CAST(ROUND(value * 100) AS BIGINT) END AS amount,
               event_id % 4000 AS external_id, user_id % 3 AS shard
        FROM events"""
#: Trades of line items: two symbols, whole prices and quantities.
TRADES = """
        SELECT l_orderkey, l_linenumber,
               l_partkey % 2 AS symbol, CAST(FLOOR(p_retailprice) AS BIGINT) AS price, CAST(FLOOR(l_quantity) AS BIGINT) AS qty,
               l_suppkey AS buyer, 1000000 + l_partkey AS seller, l_linenumber % 2 = 0 AS taker_is_buy
        FROM lineitem JOIN part ON l_partkey = p_partkey"""


def commands(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """Commands of one flow, columns as in schemas.COMMANDS."""
    rows = adapted(spark, sf_dir, sql, "events")
    return rows.selectExpr("iseq", "symbol", "cmd", "order_id", "side", "otype", "cast(price as long) price", "cast(qty as long) qty", "tif")


def adapted(spark: SparkSession, sf_dir: str, sql: str, *tables: str) -> DataFrame:
    """An adapter's rows, its tables read from `sf_dir` (no view is left in the session)."""
    frames = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in tables}
    for t in tables:
        sql = re.sub(rf"\b(FROM|JOIN) {t}\b", rf"\1 {{{t}}} AS {t}", sql)
    return spark.sql(sql, **frames)
