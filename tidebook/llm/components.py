"""Connected components of a link table, distributed.

Alternating large-star and small-star steps: every step replaces links by links
to a smaller node, and after about log(diameter) rounds each component is a star
around its smallest node. All joins are between two stored tables dealt by the
same key, so adaptive execution can split a node that has a large share of the
links; minima are combined before they are shuffled.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def local_roots(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Smallest reachable index of each of 0..n-1 under links x[i]-y[i]."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if np.array_equal(new, label):
            return label
        label = new


def forest(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Places of links x[i]-y[i] that form a spanning forest of 0..n-1: in rounds, every
    component takes its first link that leaves it."""
    label, taken, left = np.arange(n), [], np.arange(len(x))
    while len(left):
        a, b = label[x[left]], label[y[left]]
        left, a, b = left[a != b], a[a != b], b[a != b]
        if not len(left):
            break
        first = np.full(n, len(x))
        np.minimum.at(first, a, left)
        np.minimum.at(first, b, left)
        taken.append(np.unique(first[first < len(x)]))
        got = np.concatenate(taken)
        label = local_roots(n, x[got], y[got])
    return np.concatenate(taken) if taken else np.empty(0, np.int64)


def _state(edges: DataFrame):
    r = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
    return tuple(r)


def _star(pairs: DataFrame, keep_all: bool, label: str) -> DataFrame:
    """For each u of (u, v): links from its neighbours (keep_all: and u itself) to its least neighbour."""
    lows = stored(pairs.groupBy("u").agg(F.min("v").alias("m")), label + "-low")
    joined = pairs.join(lows, "u")
    if keep_all:
        out = joined.select(F.explode(F.array(F.struct(F.col("m").alias("a"), F.col("v").alias("b")), F.struct(F.col("m").alias("a"), F.col("u").alias("b")))).alias("e")).select("e.a", "e.b").filter("a < b")
    else:
        out = joined.filter("v > u").select(F.least("u", "m").alias("a"), F.col("v").alias("b"))
    return stored(out.distinct(), label)


def components(edges: DataFrame, label="components") -> DataFrame:
    """edges: two long columns a, b. Returns node, root: every node of a link with
    the smallest node of its component. Null ends and loops are ignored."""
    lo, hi = F.least("a", "b"), F.greatest("a", "b")
    e = stored(edges.filter("a is not null and b is not null and a <> b").select(lo.alias("a"), hi.alias("b")).distinct(), label)
    before = _state(e)
    while before[0]:
        both = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        large = _star(both, False, label)
        e = _star(large.select(F.col("b").alias("u"), F.col("a").alias("v")), True, label)
        after = _state(e)
        if after == before:
            break
        before = after
    roots = e.select(F.col("a").alias("node")).distinct().withColumn("root", F.col("node"))
    return e.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(roots)
