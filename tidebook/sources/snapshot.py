"""Snapshot files and their sidecars, read and validated."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.numbering import number, running

_REC = "rec string, symbol long, seq long, order_id long, side string, otype string, tif string, price long, qty long"


def lines(spark: SparkSession, path: str) -> DataFrame:
    """file, place, line: a file's lines numbered from 0, however many parts Spark reads it in. Bytes
    that are no UTF-8 are an error."""
    rows = spark.read.option("lineSep", "\n").text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("_at"), F.monotonically_increasing_id().alias("_n"), F.expr("validate_utf8(value)").alias("line"))
    return number(rows, ["file"], ["_at", "_n"], "_k").select("file", (F.col("_k") - 1).alias("place"), "line")


def parse(rows: DataFrame) -> DataFrame:
    """Records with the symbol of their book block: place, rec, symbol, seq, order fields, block."""
    p = rows.filter("place > 0").select("file", "place", F.from_json("line", _REC).alias("r")).select("file", "place", "r.*")
    book = F.when(F.col("rec") == "book", F.struct("place", F.coalesce("symbol", F.lit(0).cast("long")).alias("symbol")))
    return running(p.withColumn("_book", book), ["file"], ["place"], "_book", "_last", "max").withColumn("block", F.col("_last.symbol")).drop("_book", "_last")


def books(parsed: DataFrame) -> DataFrame:
    return parsed.filter("rec = 'book'").select(F.col("block").alias("symbol"), "seq")


def orders(parsed: DataFrame) -> DataFrame:
    pos = F.row_number().over(Window.partitionBy("block").orderBy("place")) - 1
    return parsed.filter("rec = 'order'").select(F.col("block").alias("symbol"), "side", pos.cast("long").alias("book_pos"), "order_id", "otype", "tif", "price", "qty")


def problems(parsed: DataFrame, pmin: int = 0, pmax: int = 1_000_000, max_orders: int = 65_536, index: str = "ladder") -> DataFrame:
    """problem, symbol: why a snapshot must not be restored."""
    o = parsed.filter("rec = 'order'")
    say = lambda df, text: df.select(F.lit(text).alias("problem"), F.col("block").alias("symbol"))
    by = lambda cond: parsed.filter("rec = 'book'").groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(cond)
    out = say(o.filter("block is null"), "order before book").unionByName(say(by("n > 1"), "book twice"))
    out = out.unionByName(say(o.groupBy("block", "order_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "id twice"))
    out = out.unionByName(say(o.filter("qty is null or qty = 0"), "no quantity"))
    bad = "price <= 0" if index == "tree" else f"price < {pmin} or price > {pmax}"
    out = out.unionByName(say(o.filter(bad), "price"))
    out = out.unionByName(say(o.groupBy("block").agg(F.count(F.lit(1)).alias("n")).filter(f"n > {max_orders}"), "too many orders"))
    q = o.groupBy("block").agg(F.max(F.when(F.col("side") == "bid", F.col("price"))).alias("b"), F.min(F.when(F.col("side") == "ask", F.col("price"))).alias("a"))
    return out.unionByName(say(q.filter("b >= a"), "crossed"))


def meta(text: str | None) -> tuple[int, int]:
    """(cut, partitions) of a sidecar; without one, 0 and 1."""
    if text is None:
        return 0, 1
    m = json.loads(text)
    return m["iseq"], m["partitions"]
