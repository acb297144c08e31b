"""Recovery and checkpoints as batch plans over journals and snapshots."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import lines, routing
from ..functions.tables import stored
from ..operators import matching
from ..sources import journal, snapshot


class Corrupt(ValueError):
    """A journal or snapshot that must not be used; the message names what and where."""


def _refuse(problems: DataFrame) -> None:
    bad = problems.limit(5).collect()
    if bad:
        raise Corrupt("; ".join(f"{r[0]}: {r[1]}" for r in bad))


def run_journaled(commands: DataFrame, folder: str, partitions: int, config: dict | None = None, binary: bool = False) -> DataFrame:
    """Matching with its journals: the commands are written before they are applied, the events
    after; both by partition. Returns the events."""
    spark, line = commands.sparkSession, lines.command_line(True, True)
    cmds = routing.with_partition(commands, partitions)
    journal.write(cmds if binary else cmds.withColumn("line", line), folder, "cmd", partitions, config, binary).count()
    again = journal.commands(journal.read(spark, folder))  # what is applied is what was written
    events = stored(routing.with_partition(matching.match(again, config), partitions), "journaled-events")
    journal.write(events if binary else events.withColumn("line", lines.event_line()), folder, "evt", partitions, config, binary).count()
    return events.drop("partition")


def recover(spark: SparkSession, folder: str, snapshot_file: str | None = None, cut: int = 0, mode: str = "strict", config: dict | None = None) -> DataFrame:
    """matching.STATE rows of a run from the snapshot (none: from nothing) over the commands after its cut."""
    rows = journal.read(spark, folder, mode)
    _refuse(journal.problems(rows, mode))
    tail = journal.commands(rows, cut)
    _refuse(tail.groupBy("iseq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.lit("iseq twice"), F.col("iseq").cast("string")))
    if snapshot_file is None:
        return matching.match_with_state(tail, config)
    parsed = snapshot.parse(snapshot.lines(spark, snapshot_file))
    _refuse(snapshot.problems(parsed, **(config or {})))
    return matching.resume(snapshot.books(parsed), snapshot.orders(parsed), tail, config)


CHECKPOINT = re.compile(r"checkpoint-(\d+)$")


def _listed(spark: SparkSession, folder: str):
    """The file system of a folder, and the paths in it by name."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    fs = path.getFileSystem(spark._jsc.hadoopConfiguration())
    return fs, {x.getPath().getName(): x.getPath() for x in fs.listStatus(path)} if fs.exists(path) else {}


def latest(spark: SparkSession, folder: str) -> int | None:
    """The cut of the newest complete checkpoint."""
    fs, found = _listed(spark, folder)
    done = [int(m[1]) for name, path in found.items() if (m := CHECKPOINT.match(name)) and fs.exists(spark._jvm.org.apache.hadoop.fs.Path(path, "_SUCCESS"))]
    return max(done, default=None)


def remove_below(spark: SparkSession, folder: str, iseq: int, journals: str | None = None) -> list[str]:
    """Deletes checkpoints of earlier cuts and journal segments that begin below the cut; their names."""
    gone = []
    for place, cut_of in ((folder, lambda n: int(m[1]) if (m := CHECKPOINT.match(n)) else None), (journals, lambda n: int(m[3] or 0) if (m := journal.NAME.match(n)) else None)):
        if place is None:
            continue
        fs, found = _listed(spark, place)
        for name, path in found.items():
            start = cut_of(name)
            if start is not None and start < iseq:
                fs.delete(path, True)
                gone.append(name)
    return sorted(gone)


def checkpoint(spark: SparkSession, commands: DataFrame, iseq: int, folder: str, config: dict | None = None, journals: str | None = None, partitions: int = 1) -> None:
    """Books and resting orders after `iseq`, as tables under folder/checkpoint-{iseq}; complete once _SUCCESS is there.

    It goes on from the newest checkpoint, if there is one. With `journals`, every partition's next
    segment is opened at the cut first; older segments and checkpoints go once the new one is complete,
    so that a crash at any point leaves a checkpoint and the segments after it."""
    last = latest(spark, folder)
    if last is None:
        s = matching.match_with_state(matching.cut(commands, iseq), config)
    elif last < iseq:
        s = resume_from(spark, matching.cut(commands, iseq), last, folder, config)
    else:
        return
    if journals is not None:
        open_segments(spark, journals, iseq, partitions, config)
    s.filter("rec is not null").write.mode("overwrite").parquet(f"{folder}/checkpoint-{iseq}")
    if journals is not None:
        remove_below(spark, folder, iseq, journals)


def open_segments(spark: SparkSession, journals: str, start: int, partitions: int, config: dict | None = None) -> None:
    """An empty segment of every partition and kind from `start` on, where there is none yet."""
    _, found = _listed(spark, journals)
    for kind in ("cmd", "evt"):
        for p in range(partitions):
            if f"{kind}-{p}.{start}.journal" not in found:
                journal.open_segment(journals, kind, p, partitions, start, config)


def resume_from(spark: SparkSession, commands: DataFrame, iseq: int, folder: str, config: dict | None = None) -> DataFrame:
    s = spark.read.parquet(f"{folder}/checkpoint-{iseq}")
    return matching.resume(matching.books_of(s), matching.resting_of(s), commands.filter(F.col("iseq") > iseq), config)
