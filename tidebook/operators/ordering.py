"""Ordered per-key rules as window expressions: sequences, gaps, dedup, chaining, pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import number, running
from ..functions.routing import group_of, shard_of_account, shard_of_order
from .fold import fold


def echo(commands: DataFrame) -> DataFrame:
    """The core that validates nothing: one event per command, dense per symbol."""
    w = Window.partitionBy("symbol").orderBy("iseq")
    ev = F.when(F.col("cmd") == "new", "accepted").when(F.col("cmd") == "cancel", "closed").otherwise("replaced")
    return commands.select(
        "symbol", "iseq", F.row_number().over(w).cast("long").alias("seq"), ev.alias("ev"), "order_id",
        F.when(F.col("cmd") == "replace", F.col("price")).alias("price"), F.when(F.col("cmd") == "replace", F.col("qty")).alias("qty"),
        F.when(F.col("cmd") == "new", F.col("qty")).alias("leaves_qty"), F.when(F.col("cmd") == "cancel", "cancelled").alias("reason"),
    )


def density_problems(events: DataFrame, key: str = "symbol", seq: str = "seq") -> DataFrame:
    """Rows whose number does not follow the one before it (the first must be 1)."""
    before = F.lag(seq).over(Window.partitionBy(key).orderBy(seq))
    return events.withColumn("expected", F.coalesce(before, F.lit(0)) + 1).filter(F.col(seq) != F.col("expected")).select(key, seq, "expected")


def not_increasing(journal: DataFrame, key: str = "partition", place: str = "place", seq: str = "iseq") -> DataFrame:
    """Rows of a journal, in file order, whose iseq is not above the one before."""
    before = F.lag(seq).over(Window.partitionBy(key).orderBy(place))
    return journal.withColumn("before", before).filter(F.col(seq) <= F.col("before")).select(key, place, seq, "before")


def merge_after_cut(journals: list[DataFrame], cut: int) -> DataFrame:
    """One list of commands after a snapshot's cut. Order it by iseq where order matters."""
    out = journals[0]
    for j in journals[1:]:
        out = out.unionByName(j)
    return out.filter(F.col("iseq") > cut)


def duplicate_iseqs(merged: DataFrame) -> DataFrame:
    return merged.groupBy("iseq").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def sequence(commands: DataFrame, order: list[str], first: int = 1) -> DataFrame:
    """`commands` with `iseq`: numbered from `first` along their order of arrival (which must be total)."""
    return number(commands, [], order, "_n").withColumn("iseq", F.col("_n") + (first - 1)).drop("_n")


def split(commands: DataFrame, groups: int) -> DataFrame:
    """Adds `group_id` and `place`: a batch's commands by owning group, each symbol's in their order."""
    return number(commands.withColumn("group_id", group_of(F.col("symbol"), groups)), ["group_id"], ["iseq"], "place")


def listing(events: DataFrame) -> DataFrame:
    """Adds `place`: an event's line number in the listing of its partition, from 1. The listing of
    all partitions is sorted by partition and place."""
    return number(events, ["partition"], ["iseq", "ordinal"], "place")


def merge_events(streams: list[DataFrame]) -> DataFrame:
    """One stream from several that may overlap: (symbol, seq) names an event."""
    out = streams[0]
    for s in streams[1:]:
        out = out.unionByName(s)
    return out.dropDuplicates(["symbol", "seq"])


SESSIONS = "node long, idx long, client long, seq long, reply string, result long"
#: Sessions that a node keeps (fixed value); the one created first goes when there are more.
MAX_SESSIONS = 65536


def sessions(requests: DataFrame, limit: int = MAX_SESSIONS) -> DataFrame:
    """What each request (node, idx, client, seq, result) is answered, in the order of idx: `applied`
    with its result if its seq is above the client's last, `repeat` with the stored result of an equal
    one, `stale` below. Of more than `limit` clients the one that has been known longest is forgotten.

    Memory: `limit` sessions a node."""

    def step(node, rows):
        known: dict = {}  # by creation
        for r in rows:
            last = known.get(r["client"])
            if last is not None and r["seq"] <= last[0]:
                same = r["seq"] == last[0]
                yield node, r["idx"], r["client"], r["seq"], "repeat" if same else "stale", last[1] if same else None
                continue
            known[r["client"]] = (r["seq"], r["result"])
            if len(known) > limit:
                del known[next(iter(known))]
            yield node, r["idx"], r["client"], r["seq"], "applied", r["result"]

    return fold(requests, "node", ["idx"], step, SESSIONS, ["node", "idx", "client", "seq", "result"])


def replay_problems(replayed: DataFrame, ring: DataFrame) -> DataFrame:
    """source, idx of events that came again unlike those kept under the same index. Both: source, idx, event."""
    kept = ring.select("source", "idx", F.col("event").alias("_kept"))
    return replayed.join(kept, ["source", "idx"]).filter(~F.col("event").eqNullSafe(F.col("_kept"))).select("source", "idx")


def session_accepted(rows: DataFrame, client: str = "client", seq: str = "seq", index: str = "idx") -> DataFrame:
    """Adds `applied`: whether a request's seq is above all earlier ones of its client."""
    seen = running(rows, [client], [index], seq, "_seen", "max", True)
    return seen.withColumn("applied", F.col(seq) > F.coalesce("_seen", F.lit(0))).drop("_seen")


def running_clock(rows: DataFrame, key: str, ts: str, order: str) -> DataFrame:
    """Adds `clock`: the greatest time so far."""
    return running(rows, [key], [order], ts, "clock", "max")


def intake_without_gaps(arrivals: DataFrame, key: str = "shard", idx: str = "idx", arrival: str = "arrival") -> DataFrame:
    """Adds `outcome` where every index arrives and none early: the first arrival is applied, repeats are duplicates."""
    first = F.min(arrival).over(Window.partitionBy(key, idx))
    return arrivals.withColumn("outcome", F.when(F.col(arrival) == first, "applied").otherwise("duplicate"))


def archive_index(events: DataFrame, retain: int, source: str = "source", order: tuple = ("iseq", "ordinal")) -> DataFrame:
    """Adds `idx`, contiguous from 1 per source, and `retained`: whether it is in the last `retain`."""
    numbered = number(events, [source], list(order), "idx")
    last = numbered.groupBy(source).agg(F.max("idx").alias("_last"))
    return numbered.join(last, source).withColumn("retained", F.col("idx") > F.col("_last") - retain).drop("_last")


def page(stream: DataFrame, start: int, limit: int, idx: str = "idx") -> DataFrame:
    """The first `limit` rows from index `start` on; the limit is the feature."""
    return stream.filter(F.col(idx) >= start).orderBy(idx).limit(limit)


def read_stream(archive: DataFrame, source: int, start: int, limit: int) -> DataFrame:
    """status (ok, truncated, unknown), base, idx: a page of a source's retained window. A start
    before the window gives one truncated row, a source without events one unknown row."""
    s = archive.filter(F.col("source") == source)
    ends = s.agg(F.min(F.when(F.col("retained"), F.col("idx"))).alias("base"), F.count(F.lit(1)).alias("n"))
    bad = ends.select(F.when(F.col("n") == 0, "unknown").when(F.col("base") > start, "truncated").alias("status"), "base", F.lit(None).cast("long").alias("idx")).filter("status is not null")
    good = page(s.filter("retained"), start, limit).select("idx").join(F.broadcast(ends), F.col("base") <= start).select(F.lit("ok").alias("status"), "base", "idx")  # one row
    return good.unionByName(bad)


def concerned_shards(shards: int):
    """Column: the ledger shards that a settlement event concerns: of both orders of a trade, of a closed
    order, of the account of a slice event (account modulo shards); slice fees are booked on shard 0."""
    of = lambda c: shard_of_order(F.col(c))
    return (
        F.when(F.col("kind") == "trade", F.array_distinct(F.array(of("buy"), of("sell"))))
        .when(F.col("kind") == "closed", F.array(of("order_id")))
        .when(F.col("kind") == "slice_fee", F.array(F.lit(0).cast("long")))
        .otherwise(F.array(shard_of_account(F.col("account"), shards).cast("long")))
    )


def settle_routes(events: DataFrame, shards: int) -> DataFrame:
    """events: source, idx, kind, buy, sell, order_id, account. A row for each of the `shards`
    that an event concerns, with `prev`, the index before it that went there (0: none); orders of
    credit slices belong to no ledger shard."""
    routed = events.withColumn("shard", F.explode(concerned_shards(shards))).filter((F.col("shard") >= 0) & (F.col("shard") < shards))
    return _chained(routed)


def _chained(routed: DataFrame) -> DataFrame:
    """Adds `prev`: the greatest index before it of the same source and shard."""
    return running(routed, ["source", "shard"], ["idx"], "idx", "prev", "max", True).withColumn("prev", F.coalesce("prev", F.lit(0)))


def settle_chain(events: DataFrame, shards: int) -> DataFrame:
    """events: source, idx, buy, sell (order ids). One row for each shard that an event concerns,
    with `prev`, the index before it that went to the same shard (0: none)."""
    of = lambda c: F.pmod(F.col(c), F.lit(shards))
    routed = events.select("*", F.explode(F.array_distinct(F.array(of("buy"), of("sell")))).alias("shard"))
    return _chained(routed)


def durable_acks(events: DataFrame, marks: DataFrame) -> DataFrame:
    """Events that a partition's durable mark has reached; marks: partition, durable_iseq."""
    return events.join(marks, "partition").filter(F.col("iseq") <= F.col("durable_iseq")).drop("durable_iseq")


def due_cancels(orders: DataFrame, now: int, max_age: int, retry: int, limit: int) -> DataFrame:
    """order_id, place of the orders that a sweep cancels: cancels queued `retry` ago or longer by
    (cancel_at, id), then orders never cancelled of age `max_age` or more by (born, id)."""
    again = orders.filter(F.col("cancelling") & F.lit(retry > 0) & (F.col("cancel_at") <= now - retry)).select(F.lit(0).alias("p"), F.col("cancel_at").alias("t"), "order_id")
    old = orders.filter(~F.col("cancelling") & (F.col("born") <= now - max_age)).select(F.lit(1).alias("p"), F.col("born").alias("t"), "order_id")
    picked = again.unionByName(old).orderBy("p", "t", "order_id").limit(limit)
    return picked.withColumn("place", F.row_number().over(Window.orderBy("p", "t", "order_id")).cast("long")).select("order_id", "place")


def percentiles(samples: DataFrame, value: str, shares: list[str], rule: str = "nearest", by: str | None = None, cells: int = 4096) -> DataFrame:
    """Exact percentiles over all samples of a whole-number `value`. Rule `nearest`: rank ceil(p * n);
    `index`: 0-based place ceil((n - 1) * p). by..., share, value.

    Values are counted in `cells` stretches between least and greatest first; only those in the
    stretches where an asked rank lies are counted one by one, so no task orders all values."""
    keys = [by] if by else []
    ends = samples.groupBy(*keys).agg(F.min(value).alias("_lo"), F.max(value).alias("_hi")).filter("_lo is not null").withColumn("_step", F.expr(f"(_hi - _lo) div {cells} + 1"))
    placed = (samples.join(ends, keys) if keys else samples.join(F.broadcast(ends), F.col(value) >= F.col("_lo"))).withColumn("_cell", F.expr(f"({value} - _lo) div _step"))
    per = placed.groupBy(*keys, "_cell").agg(F.count(F.lit(1)).alias("_c"))
    w = (Window.partitionBy(*keys) if keys else Window.partitionBy()).orderBy("_cell")
    per = per.withColumn("_upto", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))).withColumn("n", F.sum("_c").over(Window.partitionBy(*keys)))
    share = F.explode(F.array(*[F.lit(s) for s in shares]))
    per_mille = F.round(F.col("share").cast("double") * 1000).cast("long")
    up = lambda a: F.floor((a + 999) / 1000)
    rank = F.greatest(up(per_mille * F.col("n")), F.lit(1)) if rule == "nearest" else up(per_mille * (F.col("n") - 1)) + 1
    sought = per.withColumn("share", share).withColumn("_rank", rank - (F.col("_upto") - F.col("_c"))).filter((F.col("_rank") >= 1) & (F.col("_rank") <= F.col("_c"))).select(*keys, "_cell", "share", "_rank")
    cell = placed.join(sought.select(*keys, "_cell").distinct(), [*keys, "_cell"], "left_semi")
    c = cell.groupBy(*keys, "_cell", value).agg(F.count(F.lit(1)).alias("c"))
    inner = Window.partitionBy(*keys, "_cell").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    c = c.withColumn("hi", F.sum("c").over(inner)).join(sought, [*keys, "_cell"])
    hit = c.filter((F.col("hi") >= F.col("_rank")) & (F.col("hi") - F.col("c") < F.col("_rank")))
    return hit.select(*keys, "share", F.col(value).alias("value"))
