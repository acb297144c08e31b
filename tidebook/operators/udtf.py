"""Matching as a table function: SELECT * FROM match_commands(TABLE(commands) PARTITION BY symbol ORDER BY iseq)."""

from __future__ import annotations

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import udtf

from ..schemas import EVENTS
from .book import Book


class MatchCommands:
    """One instance, and so one book, for each symbol."""

    config: dict = {}

    def __init__(self):
        self.book = Book(**self.config)

    def eval(self, row: Row):
        c = row.asDict()
        for i, event in enumerate(self.book.apply(c)):
            yield (c["symbol"], c["iseq"], i, *event)


def register(spark: SparkSession, name: str = "match_commands", config: dict | None = None) -> None:
    """Registers the function for books of one configuration (none: the default one)."""
    made = type("MatchCommands", (MatchCommands,), {"config": config or {}})
    spark.udtf.register(name, udtf(made, returnType=EVENTS))
