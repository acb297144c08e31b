"""Helpers shared by the text operators: reading, shared tables, null-safe keys.

Every operator here takes DataFrames and column names, selects the columns that
it needs at once (so extra or clashing columns never matter) and returns only
the columns that its docstring names.
"""

from __future__ import annotations

import ctypes
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import released, shared_dir, stored  # noqa: F401  used by the operators

#: Java and RE2 class of the six ASCII blanks that separate words.
BLANKS = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/tidebook/{label}-{uuid.uuid4().hex}"


def words_of(text):
    """Column: the words of `text` (null: none)."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), BLANKS), "")


def get_field(rows, name):
    return F.transform(rows, lambda r: r[name])


_AT_END: list[Callable] = []


def at_task_end(forget: Callable) -> Callable:
    """Registers a function that empties what a module's tasks have kept at hand."""
    _AT_END.append(forget)
    return forget


def give_back() -> None:
    """Empties caches and returns a worker's free memory to the machine: workers live on, idle, beside the next tasks."""
    for forget in _AT_END:
        forget()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (OSError, AttributeError):  # another C library than glibc
        pass


def map_arrow(rows: DataFrame, run: Callable, schema: str) -> DataFrame:
    """rows.mapInArrow(run, schema) whose tasks give their memory back when they end."""

    def task(batches):
        try:
            yield from run(batches)
        finally:
            give_back()

    return rows.mapInArrow(task, schema)
