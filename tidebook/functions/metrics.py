"""Metrics of an event stream, and their Prometheus text."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_partition(events: DataFrame, published: DataFrame | None = None) -> DataFrame:
    """partition, events, commands, trades and, with published (iseq, t_pub) and t_evt, mean and most latency at
    each command's first event."""
    base = events.groupBy("partition").agg(F.count(F.lit(1)).alias("events"), F.count_distinct("iseq").alias("commands"), F.count_if(F.col("ev") == "trade").alias("trades"))
    if published is None:
        return base
    first = events.withColumn("r", F.row_number().over(Window.partitionBy("iseq").orderBy("ordinal"))).filter("r = 1").select("partition", "iseq", "t_evt")
    lat = first.join(published, "iseq").groupBy("partition").agg(F.sum(F.col("t_evt") - F.col("t_pub")).alias("latency_sum"), F.max(F.col("t_evt") - F.col("t_pub")).alias("latency_max"))
    return base.join(lat, "partition", "left")


def prometheus(metrics: DataFrame, prefix: str = "stream", key: str = "partition") -> DataFrame:
    """name, partition, line: one text line per counter and partition."""
    names = [c for c in metrics.columns if c != key]
    rows = F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).cast("long").alias("value")) for n in names])
    m = metrics.select(key, F.explode(rows).alias("m")).filter("m.value is not null")
    return m.select("m.name", key, F.concat(F.lit(f"{prefix}_"), "m.name", F.lit(f'_total{{{key}="'), F.col(key).cast("string"), F.lit('"} '), F.col("m.value").cast("string")).alias("line"))
