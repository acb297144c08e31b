"""An archive of event streams: a table in segments of equal index ranges, one folder for each source and segment.

Appending skips what the store already has, so a replayed batch adds nothing; retention drops
whole segments. Indexes are contiguous from 1 for each source; a gap that no replay fills is reported.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import stored

#: Events of a segment.
SEGMENT = 65536


def window(spark: SparkSession, folder: str) -> DataFrame | None:
    """source, base, next of the stored streams; None where nothing is stored."""
    events = read(spark, folder)
    return None if events is None else events.groupBy("source").agg(F.min("idx").alias("base"), (F.max("idx") + 1).alias("next"))


def read(spark: SparkSession, folder: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(path) or not any(x.getPath().getName().startswith("source=") for x in fs.listStatus(path)):
        return None
    return spark.read.option("basePath", folder).parquet(folder).withColumn("source", F.col("source").cast("long")).withColumn("segment", F.col("segment").cast("long"))


def append(spark: SparkSession, folder: str, events: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """Adds the events (source, idx, ...) that follow those stored, once each. Returns source, first,
    next of streams whose new events do not follow the stored ones: a gap; those are not added."""
    have = window(spark, folder)
    new = events.dropDuplicates(["source", "idx"])
    if have is None:
        fresh = new.withColumn("next", F.lit(1).cast("long"))
    else:
        fresh = new.join(stored(have, "store-window"), "source", "left").withColumn("next", F.coalesce("next", F.lit(1)))
    fresh = stored(fresh.filter("idx >= next"), "store-fresh")
    ends = fresh.groupBy("source").agg(F.min("idx").alias("first"), F.max("idx").alias("last"), F.count(F.lit(1)).alias("n"), F.first("next").alias("next"))
    gaps = stored(ends.filter("first <> next or last - first + 1 <> n").select("source", "first", "next"), "store-gaps")
    good = fresh.join(gaps.select("source"), "source", "left_anti")
    columns = [c for c in events.columns if c not in ("base",)]
    # a segment is written by one task: dealt otherwise, each would be a file in every task
    good.select(*columns, F.expr(f"idx div {segment}").alias("segment")).repartition("source", "segment").write.partitionBy("source", "segment").mode("append").parquet(folder)
    return gaps


def retain(spark: SparkSession, folder: str, events: int, segment: int = SEGMENT) -> list[str]:
    """Drops the segments that hold none of a source's newest `events`; their names."""
    have = window(spark, folder)
    if have is None:
        return []
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark._jsc.hadoopConfiguration())
    gone = []
    for r in have.collect():  # a row per source
        least = max(r["next"] - events, 1) // segment
        source = path(folder, f"source={r['source']}")
        for x in fs.listStatus(source):
            name = x.getPath().getName()
            if name.startswith("segment=") and int(name[8:]) < least:
                fs.delete(x.getPath(), True)
                gone.append(f"source={r['source']}/{name}")
    return sorted(gone)


def stream(spark: SparkSession, folder: str, source: int, start: int, limit: int) -> DataFrame:
    """The first `limit` stored events of a source from `start` on (a page; the limit is the feature)."""
    return read(spark, folder).filter((F.col("source") == source) & (F.col("idx") >= start)).orderBy("idx").limit(limit)

