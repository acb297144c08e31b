"""Partition tables: a header line with the partition count, then (symbol, partition) lines."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.routing import table_problems
from . import snapshot

MAX_PARTITIONS = 1024  # fixed limit


def read(spark: SparkSession, path: str, partitions: int) -> DataFrame:
    """symbol, partition. A header for another count, a symbol listed twice or a partition out of range is an error."""
    rows = snapshot.lines(spark, path)
    head = json.loads(rows.filter("place = 0").first()["line"])
    if not 1 <= partitions <= MAX_PARTITIONS or head.get("partitions") != partitions or not str(head.get("format", "")).endswith("-map/1"):
        raise ValueError(f"{path}: header is not for {partitions} partitions")
    t = rows.filter("place > 0 and trim(line) <> ''").select(F.from_json("line", "symbol long, partition long").alias("r")).select("r.*")
    bad = table_problems(t, partitions).first() or t.filter("symbol is null or partition is null").first()
    if bad:
        raise ValueError(f"{path}: symbol {bad[0]}: {bad[1]}")
    return t
