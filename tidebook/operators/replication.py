"""Invariants of a replicated log, checked over recorded rows: violations as (rule, key)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.numbering import running_sum


def _v(df: DataFrame, rule: str, *key) -> DataFrame:
    return df.select(F.lit(rule).alias("rule"), F.concat_ws("/", *key).alias("key"))


def one_leader(leaders: DataFrame) -> DataFrame:
    """leaders: term, node. Terms in which more than one node led."""
    return _v(leaders.groupBy("term").agg(F.count_distinct("node").alias("n")).filter("n > 1"), "leaders", "term")


def one_vote(votes: DataFrame) -> DataFrame:
    """votes: term, voter, candidate, granted. A voter grants one candidate a term."""
    return _v(votes.filter("granted").groupBy("term", "voter").agg(F.count_distinct("candidate").alias("n")).filter("n > 1"), "votes", "voter", "term")


def commit_index(matches: DataFrame, quorum: int) -> DataFrame:
    """matches: term, node, matched, matched_term. Per term, the quorum-th largest index, if its entry is of that term."""
    w = Window.partitionBy("term").orderBy(F.desc("matched"), "node")
    return matches.withColumn("r", F.row_number().over(w)).filter(F.col("r") == quorum).filter("matched_term = term").select("term", F.col("matched").alias("committed"))


def applied_in_order(applied: DataFrame) -> DataFrame:
    """applied: node, life, place, idx. Within one life of a node, indexes follow each other."""
    before = F.lag("idx").over(Window.partitionBy("node", "life").orderBy("place"))
    return _v(applied.withColumn("b", before).filter("b is not null and idx <> b + 1"), "applied order", "node", "life", "place")


def log_matching(logs: DataFrame) -> DataFrame:
    """logs: node, idx, term, payload. Entries of equal index and term have equal payloads, and so
    have all entries before them: compared by a digest of the prefix, summed along each log. Sums
    are decimals: those of 64-bit numbers pass a long's range after a few entries."""
    h = logs.withColumn("_h", F.xxhash64("idx", "term", "payload").cast("decimal(20,0)"))
    p = running_sum(h, ["node"], ["idx"], "_h", "prefix")
    return _v(p.groupBy("idx", "term").agg(F.count_distinct("prefix").alias("n")).filter("n > 1"), "log matching", "idx", "term")


def leader_completeness(committed: DataFrame, leader_logs: DataFrame) -> DataFrame:
    """committed: idx, term. leader_logs: led_term, idx, term. A leader of a later term holds every
    committed entry; a leader's log is compared by counts of entries up to each index."""
    c = committed.distinct()
    have = leader_logs.join(c, ["idx", "term"], "left_semi").groupBy("led_term").agg(F.count_distinct("idx").alias("have"))
    terms = leader_logs.select("led_term").distinct()
    # committed entries of earlier terms, counted along the terms
    steps = c.groupBy(F.col("term").alias("led_term")).agg(F.count(F.lit(1)).alias("n")).unionByName(terms.select("led_term", F.lit(0).cast("long").alias("n"))).groupBy("led_term").agg(F.sum("n").alias("n"))
    due = steps.withColumn("due", F.coalesce(F.sum("n").over(Window.orderBy("led_term").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    j = terms.join(due, "led_term").join(have, "led_term", "left").na.fill(0, ["have"])
    return _v(j.filter("have < due"), "leader completeness", "led_term")
