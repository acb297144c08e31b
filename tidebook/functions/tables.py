"""Tables shared by driver and executors: written once, read by several plans."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where that is unset and there is one machine only (tests), a folder of its own."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        known = os.path.join(tempfile.gettempdir(), "checkpoints")
    return known.rstrip("/")


def as_uri(folder: str) -> str:
    """A folder's name as pyarrow's file systems take it: a bare path and file:/path are local ones."""
    if "://" in folder:
        return folder
    return "file://" + os.path.abspath(folder.removeprefix("file:"))


def stored(df: DataFrame, label: str) -> DataFrame:
    """`df` written to the shared folder and read back: computed once however many plans read
    it, with its lineage cut. The folder can be emptied when the job has ended."""
    path = f"{shared_dir(df.sparkSession)}/tidebook/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    for made in _made:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: What stored() has written inside each open released().
_made: list[list[str]] = []


@contextmanager
def released(spark: SparkSession, keep: int = 1):
    """Deletes the tables that stored() wrote inside, but for the last `keep`: for steps whose
    result is stored itself. What is read lazily afterwards must be among those kept."""
    made: list[str] = []
    _made.append(made)
    try:
        yield
    finally:
        _made.remove(made)
        for path in made[: len(made) - keep]:
            p = spark._jvm.org.apache.hadoop.fs.Path(path)
            p.getFileSystem(spark._jsc.hadoopConfiguration()).delete(p, True)
