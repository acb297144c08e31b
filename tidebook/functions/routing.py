"""Routing as Column functions: symbol -> partition, group and account -> shard.

All 64-bit products are done on 16-bit limbs in longs, so they wrap as intended under
ANSI mode and stay inside generated code.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

M32 = 0xFFFFFFFF
GOLDEN = 0x9E3779B97F4A7C15  # fixed value of the partition hash and of the group hash
MIX = (0xBF58476D1CE4E5B9, 0x94D049BB133111EB)  # fixed values of the group hash


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def hash_partition(symbol: Column, partitions: Column | int) -> Column:
    """((symbol * GOLDEN mod 2^64) >> 32) * partitions >> 32, for 0 <= symbol < 2^32."""
    hi, lo = GOLDEN >> 32, GOLDEN & M32
    upper = (F.shiftleft((symbol * (hi >> 16)).bitwiseAND(F.lit(0xFFFF)), 16) + symbol * (hi & 0xFFFF)).bitwiseAND(F.lit(M32))
    lower = F.shiftrightunsigned(symbol * (lo >> 16) + F.shiftrightunsigned(symbol * (lo & 0xFFFF), 16), 16)
    h = (upper + lower).bitwiseAND(F.lit(M32))
    return F.shiftrightunsigned(h * (F.lit(partitions) if isinstance(partitions, int) else partitions), 32)


def mul64(x: Column, c: int) -> Column:
    """x * c mod 2^64 as a long's two's complement."""
    limb = [(c >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    x0, x1 = x.bitwiseAND(F.lit(M32)), F.shiftrightunsigned(x, 32)
    low16 = lambda v: F.shiftleft(v.bitwiseAND(F.lit(0xFFFF)), 16)
    low = x0 * limb[0] + low16(x0 * limb[1])
    high = F.shiftrightunsigned(low, 32) + F.shiftrightunsigned(x0 * limb[1], 16) + x0 * limb[2] + low16(x0 * limb[3]) + x1 * limb[0] + low16(x1 * limb[1])
    return F.shiftleft(high.bitwiseAND(F.lit(M32)), 32).bitwiseOR(low.bitwiseAND(F.lit(M32)))


def add64(a: Column, b: Column) -> Column:
    """a + b mod 2^64."""
    low = a.bitwiseAND(F.lit(M32)) + b.bitwiseAND(F.lit(M32))
    high = F.shiftrightunsigned(a, 32) + F.shiftrightunsigned(b, 32) + F.shiftrightunsigned(low, 32)
    return F.shiftleft(high.bitwiseAND(F.lit(M32)), 32).bitwiseOR(low.bitwiseAND(F.lit(M32)))


def rotate_left(x: Column, n: int) -> Column:
    return F.shiftleft(x, n).bitwiseOR(F.shiftrightunsigned(x, 64 - n))


def unsigned_mod(x: Column, n: int) -> Column:
    """x mod n with x as unsigned 64 bits; n at most 2^31."""
    return ((F.shiftrightunsigned(x, 32) % n) * ((1 << 32) % n) + x.bitwiseAND(F.lit(M32))) % n


def group_of(symbol: Column, groups: int) -> Column:
    """The group that owns a symbol: a 64-bit finaliser of the symbol, modulo groups."""
    z = symbol + F.lit(_signed(GOLDEN))
    z = mul64(z.bitwiseXOR(F.shiftrightunsigned(z, 30)), MIX[0])
    z = mul64(z.bitwiseXOR(F.shiftrightunsigned(z, 27)), MIX[1])
    return unsigned_mod(z.bitwiseXOR(F.shiftrightunsigned(z, 31)), groups)


def shard_of_order(order_id: Column) -> Column:
    return F.shiftrightunsigned(order_id, 48)


def is_slice_order(order_id: Column) -> Column:
    return order_id < 0


def order_id(shard: Column, number: Column) -> Column:
    return F.shiftleft(shard, 48).bitwiseOR(number)


def shard_of_account(account: Column, shards: int) -> Column:
    return F.pmod(account, F.lit(shards))


def with_partition(df: DataFrame, partitions: int, overrides: DataFrame | None = None) -> DataFrame:
    """Adds `partition`: the override (symbol, partition) where there is one, else the hash.

    Overrides are a configuration table of at most one row per symbol; Spark decides by its
    size how to join it."""
    hashed = hash_partition(F.col("symbol"), partitions)
    if overrides is None:
        return df.withColumn("partition", hashed)
    t = overrides.select(F.col("symbol").alias("_s"), F.col("partition").alias("_p"))
    return df.join(t, df["symbol"] == t["_s"], "left").withColumn("partition", F.coalesce("_p", hashed)).drop("_s", "_p")


def table_problems(overrides: DataFrame, partitions: int) -> DataFrame:
    """Rows (symbol, problem) of a partition table that must be refused."""
    twice = overrides.groupBy("symbol").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("symbol", F.lit("twice").alias("problem"))
    return twice.unionByName(overrides.filter((F.col("partition") >= partitions) | (F.col("partition") < 0)).select("symbol", F.lit("range").alias("problem")))
