"""Canonical one-line JSON of commands, events and snapshots, written and read as Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import BOOK_CONFIG, CMD_CODES, OTYPE_CODES, SIDE_CODES, TIF_CODES


def _field(name: str, col: str, text: bool = False) -> Column:
    value = F.col(col).cast("string")
    return F.concat(F.lit(f',"{name}":'), F.concat(F.lit('"'), value, F.lit('"')) if text else value)


def command_line(tagged: bool = True, with_iseq: bool = False) -> Column:
    """cmd[,symbol],order_id,side,otype,price,qty,tif[,iseq]; fields by variant, no blanks."""
    head = F.concat(F.lit('{"cmd":"'), F.col("cmd"), F.lit('"'), *([_field("symbol", "symbol")] if tagged else []), _field("order_id", "order_id"))
    body = (
        F.when(F.col("cmd") == "new", F.concat(_field("side", "side", True), _field("otype", "otype", True), _field("price", "price"), _field("qty", "qty"), _field("tif", "tif", True)))
        .when(F.col("cmd") == "replace", F.concat(_field("price", "price"), _field("qty", "qty")))
        .otherwise(F.lit(""))
    )
    return F.concat(head, body, *([_field("iseq", "iseq")] if with_iseq else []), F.lit("}"))


def event_line(tagged: bool = True) -> Column:
    """seq,ev[,symbol], then the event's own fields."""
    head = F.concat(F.lit('{"seq":'), F.col("seq").cast("string"), F.lit(',"ev":"'), F.col("ev"), F.lit('"'), *([_field("symbol", "symbol")] if tagged else []))
    oid, ev = _field("order_id", "order_id"), F.col("ev")
    body = (
        F.when(ev == "accepted", F.concat(oid, _field("leaves_qty", "leaves_qty")))
        .when(ev == "trade", F.concat(_field("maker", "maker"), _field("taker", "taker"), _field("price", "price"), _field("qty", "qty")))
        .when(ev == "replaced", F.concat(oid, _field("price", "price"), _field("qty", "qty")))
        .otherwise(F.concat(oid, _field("reason", "reason", True)))
    )
    return F.concat(head, body, F.lit("}"))


_RAW = "cmd string, symbol long, order_id long, side string, otype string, price long, qty long, tif string, iseq long"


def parse_commands(lines: DataFrame, col: str = "value") -> DataFrame:
    """The columns of a command from its line, and `ok`: whether every field that its
    variant needs is there with a known token. Unknown keys are ignored."""
    p = lines.select(*[c for c in lines.columns if c != col], F.from_json(col, _RAW).alias("p")).select("*", "p.*").drop("p")
    known = lambda c, t: F.coalesce(F.col(c).isin(*t), F.lit(False))
    has = lambda *cs: F.expr(" and ".join(f"{c} is not null" for c in cs))
    new = known("side", SIDE_CODES) & known("otype", OTYPE_CODES) & known("tif", TIF_CODES) & has("price", "qty")
    ok = known("cmd", CMD_CODES) & has("order_id") & F.when(F.col("cmd") == "new", new).when(F.col("cmd") == "replace", has("price", "qty")).otherwise(True)
    return p.withColumn("ok", ok)


def snapshot_lines(books: DataFrame, orders: DataFrame, config: dict | None = None, fmt: str = "snap/1") -> DataFrame:
    """(n1, n2, n3, line) of a snapshot file in order: header, then per book, by symbol, its
    `book` line and its orders in book order. Sorting by the first three gives the file."""
    c = BOOK_CONFIG | (config or {})
    zero = F.lit(0).cast("long")
    head = books.sparkSession.range(1).select(
        F.lit(-1).cast("long").alias("n1"), zero.alias("n2"), zero.alias("n3"),
        F.lit('{"format":"%s","pmin":%d,"pmax":%d,"max_orders":%d,"index":"%s"}' % (fmt, c["pmin"], c["pmax"], c["max_orders"], c["index"])).alias("line"),
    )
    b = books.select(F.col("symbol").alias("n1"), zero.alias("n2"), zero.alias("n3"), F.concat(F.lit('{"rec":"book"'), _field("symbol", "symbol"), _field("seq", "seq"), F.lit("}")).alias("line"))
    o = orders.select(
        F.col("symbol").alias("n1"), F.lit(1).cast("long").alias("n2"), F.col("book_pos").alias("n3"),
        F.concat(F.lit('{"rec":"order"'), _field("order_id", "order_id"), _field("side", "side", True), _field("otype", "otype", True), _field("tif", "tif", True), _field("price", "price"), _field("qty", "qty"), F.lit("}")).alias("line"),
    )
    return head.unionByName(b).unionByName(o)
