"""Command files: a header line with the book's configuration, then one command per line."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lines import parse_commands
from ..schemas import BOOK_CONFIG, COMMANDS, names
from . import snapshot


def read(spark: SparkSession, path: str) -> tuple[DataFrame, dict, bool]:
    """(commands, book configuration, whether lines carry symbols). Blank lines are skipped, the
    k-th command has iseq k. A malformed line is an error that names the file and line."""
    rows = snapshot.lines(spark, path)
    head = json.loads(rows.filter("place = 0").first()["line"])
    config = {k: head.get(k, BOOK_CONFIG[k]) for k in BOOK_CONFIG}
    tagged = bool(head.get("engine", False))
    parsed = parse_commands(rows.filter("place > 0 and trim(line) <> ''"), "line")
    bad = parsed.filter(~F.col("ok") | (F.col("symbol").isNull() if tagged else F.lit(False))).orderBy("place").select("place").first()
    if bad:
        raise ValueError(f"{path}:{bad['place'] + 1}: malformed command")
    n = F.row_number().over(Window.partitionBy("file").orderBy("place")).cast("long")
    cmds = parsed.withColumn("iseq", n).withColumn("symbol", F.coalesce("symbol", F.lit(0)) if tagged else F.lit(0).cast("long"))
    return cmds.select(*names(COMMANDS)), config | {"index": "ladder" if config["index"] == "both" else config["index"]}, tagged
