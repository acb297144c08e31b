"""Row numbers, running sums and running maxima over an order, without a task that sees all rows of a key.

Rows are dealt by ranges of (keys, order), so a key with a large share of all rows is many
partitions. Each partition runs over its own rows; what came before a partition is a small table, a
row per partition and key.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .tables import stored


def running(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str, how: str = "sum", before: bool = False) -> DataFrame:
    """`rows` with a column `name`: the sum (`how` max: the maximum) of the column `value` up to the
    row, with `before` without the row itself, along `order` within `keys` (none: the whole table).
    A sum over no rows is 0, a maximum null. Rows of equal order share no defined place."""
    agg = {"sum": F.sum, "max": F.max}[how]
    none = F.lit(0) if how == "sum" else F.lit(None)
    dealt = rows.repartitionByRange(*keys, *order).withColumn("_pid", F.spark_partition_id())
    kept = stored(dealt, "running")  # the deal must not be drawn twice
    parts = kept.groupBy(*keys, "_pid").agg(agg(value).alias("_part"))
    over = (Window.partitionBy(*keys) if keys else Window).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    # null keys are keys like others
    earlier = parts.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.col("_pid").alias("_p"), F.coalesce(agg("_part").over(over), none).alias("_before"))
    same = F.col("_pid") == F.col("_p")
    for i, k in enumerate(keys):
        same = same & F.col(k).eqNullSafe(F.col(f"_k{i}"))
    own = agg(value).over(Window.partitionBy(*keys, "_pid").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1 if before else Window.currentRow))
    both = F.col("_before") + F.coalesce("_own", none) if how == "sum" else F.greatest("_before", "_own")
    return kept.withColumn("_own", own).join(earlier, same).withColumn(name, both).drop("_own", "_pid", "_p", "_before", *[f"_k{i}" for i in range(len(keys))])


def running_sum(rows: DataFrame, keys: list[str], order: list[str], value: str, name: str) -> DataFrame:
    return running(rows, keys, order, value, name)


def number(rows: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """`rows` with a long column `name`: 1, 2, ... along `order` within `keys`."""
    return running(rows.withColumn("_one", F.lit(1).cast("long")), keys, order, "_one", name).drop("_one")
