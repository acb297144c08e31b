"""Proportional stratified interleaving (native DataFrame operations only).

Rows are shuffled by a seeded hash and ranked within their source; a row's
fractional rank is (rank + phase) / rows of its source, ranks from 0 and a phase
in [0, 1) for each source, from a seeded hash of its name: sources of one size,
millions of sources with a single row among them, do not fall on one point. All
rows sorted by that rank are cut into shards of equal counts, so every shard
(and every stretch of a shard) has the mixture of the whole table.

No rank is computed in one task: ranks are counts of whole hash buckets, summed
in two levels, plus a row number inside one bucket. The number of buckets
follows the number of rows, so a bucket stays near ROWS_PER_BUCKET rows however
many rows a source, or sources a table, has.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import stored, table

#: Mean rows of the buckets in which rows are numbered.
ROWS_PER_BUCKET = 512
#: Buckets whose counts are summed before they are numbered.
FAN = 256
SEED = "interleave-1"


def _number(rows: DataFrame, keys: list[str], bucket: str, order: list, name: str) -> DataFrame:
    """`rows` with a long column `name`: 0-based position within `keys` by (bucket, order).

    The counts by bucket are numbered within groups of FAN buckets, and these groups over
    `keys`, so that no window sees more than one bucket in FAN of a key.
    """
    counts = rows.groupBy(*keys, bucket).agg(F.count(F.lit(1)).alias("_n")).withColumn("_top", F.expr(f"{bucket} div {FAN}"))
    before = lambda w, n: F.coalesce(F.sum(n).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    over = Window.partitionBy(*keys) if keys else Window
    tops = counts.groupBy(*keys, "_top").agg(F.sum("_n").alias("_tn")).withColumn("_before_top", before(over.orderBy("_top"), "_tn")).drop("_tn")
    counts = counts.join(tops, [*keys, "_top"]).select(*keys, bucket, (before(Window.partitionBy(*keys, "_top").orderBy(bucket), "_n") + F.col("_before_top")).alias("_before"))
    numbered = rows.withColumn("_in", F.row_number().over(Window.partitionBy(*keys, bucket).orderBy(*order)))
    return numbered.join(counts, [*keys, bucket]).withColumn(name, (F.col("_before") + F.col("_in") - 1).cast("long")).drop("_in", "_before")


def interleave(rows: DataFrame, n_shards: int, id_col: str, stratum_col: str, payload: dict, seed=SEED) -> DataFrame:
    """id, payload columns, shard (int), slot (long, gapless from 0 in each shard).

    Shard sizes differ by one row at most. Null strata form a stratum of their
    own; rows with equal ids are ordered by their payload, identical rows
    arbitrarily (their results are the same set). A text takes no part but in the
    payload columns, however long it is. Empty table: empty result.
    """
    base = rows.select(
        F.col(id_col).alias("_id"),
        F.coalesce(F.concat(F.lit("="), F.col(stratum_col).cast("string")), F.lit("")).alias("_stratum"),
        *[c.alias(n) for n, c in payload.items()],
    ).withColumn("_h", F.md5(F.concat(F.lit(seed + ":"), F.coalesce(F.col("_id").cast("string"), F.lit("")))))
    base = stored(base, "interleave-rows")
    total = base.count()
    buckets = max(1, -(-total // ROWS_PER_BUCKET))
    by_hash = base.withColumn("_b", F.expr(f"shiftright(cast(conv(substring(_h, 1, 8), 16, 10) as bigint) * {buckets}L, 32)"))
    order = ["_h", "_id", *payload]
    sizes = base.groupBy("_stratum").agg(F.count(F.lit(1)).alias("_size"))
    ranked = _number(by_hash, ["_stratum"], "_b", order, "_rank").drop("_b")
    ranked = ranked.join(sizes, "_stratum")
    phase = F.conv(F.substring(F.md5(F.concat(F.lit(seed + "/"), F.col("_stratum"))), 1, 8), 16, 10).cast("long") / F.lit(float(1 << 32))
    frac = ranked.withColumn("_frac", (F.col("_rank") + phase) / F.col("_size").cast("double")).drop("_size")
    cut = frac.withColumn("_b", F.least(F.floor(F.col("_frac") * buckets), F.lit(buckets - 1)).cast("long"))
    placed = _number(cut, [], "_b", ["_frac", "_stratum", "_rank"], "_pos")
    n = max(total, 1)
    shard = F.expr(f"_pos * {n_shards}L div {n}L")
    return placed.withColumn("_shard", shard).select(
        F.col("_id").alias(id_col), *payload, F.col("_shard").cast("int").alias("shard"),
        (F.col("_pos") - F.expr(f"(_shard * {n}L + {n_shards - 1}L) div {n_shards}L")).cast("long").alias("slot"),
    )


def op8(spark, sf_dir: str) -> DataFrame:
    """All documents dealt to eight shards by the law `rows`."""
    text = F.col("text")
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + 1).cast("long")
    out = interleave(table(spark, sf_dir, "documents"), 8, "doc_id", "source", {"size": size, "text_crc32": F.crc32(F.coalesce(text, F.lit("")).cast("binary"))})
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
