"""Embedding near-duplicates by product quantisation.

Equal vectors are one class first. A coarse quantiser deals class vectors to inverted
lists; residuals are coded by sub-space. Every class vector probes its nearest lists:
asymmetric table look-ups give its distance to each code there, and since each code keeps
its quantisation error, the triangle inequality drops only vectors that cannot link, and
takes those that must. What lies between is reranked by exact cosine in double precision.

Probes are sufficient by measurement: for sample vectors and partners drawn at exactly the
least cosine, the farthest that can link, enough lists are probed that SURE of the pairs meet
from one side or the other. A probe is left out where the plane between two centroids
is farther off than a link can be.

Lists are cut to blocks of vectors, so a list with a large share of all vectors is many
tasks. Pairs are never emitted: a block sends a count for each vector and a spanning set of
its links. A link that only one side can find (the other did not probe its list) is counted
for both where it is found.

Lists nearer than SEPARATION are merged, so near copies of one vector share a list
however many there are. Vectors within half the distance of a link from their list's
centroid are its core: any two of them link, by the triangle inequality, so they are
counted and joined by one sum over the list and compared only with the rest. A crowd of near
copies therefore costs as much as it has vectors, not as it has pairs. Quantisers are trained in one task on a bounded sample (MAX_SAMPLE
vectors, by hash); all vectors are indexed. Recall is measured in the tests.
"""

from __future__ import annotations

import hashlib
import pickle

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType

from .common import map_arrow, stored, table
from .components import components, local_roots

LEAST_COSINE = 0.9
#: Share of the hardest pairs that probes must bring together, pairs drawn to measure it, and probes at most.
SURE, DRAWN, MAX_PROBES = 0.999, 4096, 64
#: Vectors that train the quantisers, and inverted lists, at most.
MAX_SAMPLE, MAX_LISTS = 65536, 16384
SUBSPACES, CODES = 8, 256
#: Vectors of a block, and of one in the largest tables.
BLOCK, MAX_BLOCK = 2048, 16384
QUERIES = 128
#: Coarse centroids of unit vectors are at least so far apart.
SEPARATION = 0.45
ROUNDS = 6


def _nearest(x: np.ndarray, c: np.ndarray, k: int = 1) -> np.ndarray:
    """Indices of the k nearest rows of c, nearest first, ties by index."""
    out = np.empty((len(x), k), np.int64)
    half = (c * c).sum(1) / 2
    for i in range(0, len(x), 4096):
        d = half - x[i : i + 4096] @ c.T
        if k == 1:
            out[i : i + 4096, 0] = d.argmin(1)
        else:
            some = np.sort(np.argpartition(d, min(k, d.shape[1]) - 1, axis=1)[:, :k], axis=1)
            out[i : i + 4096] = np.take_along_axis(some, np.argsort(np.take_along_axis(d, some, 1), axis=1, kind="stable"), 1)
    return out


def kmeans(x: np.ndarray, k: int, rounds: int = ROUNDS) -> np.ndarray:
    """Centroids from evenly spaced rows of x (the sample's order is a hash)."""
    c = x[np.linspace(0, len(x) - 1, min(k, len(x))).astype(int)].copy()
    for _ in range(rounds):
        at = _nearest(x, c)[:, 0]
        n = np.bincount(at, minlength=len(c))
        sums = np.stack([np.bincount(at, x[:, j], minlength=len(c)) for j in range(x.shape[1])], 1)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def apart(c: np.ndarray, least: float) -> np.ndarray:
    """Rows of c in order, without those nearer than `least` to a kept one."""
    kept: list[int] = []
    for i in range(len(c)):
        if not kept or ((c[kept] - c[i]) ** 2).sum(1).min() >= least * least:
            kept.append(i)
    return c[kept]


class Quantiser:
    """coarse: centroids of the lists; books: centroids of the residuals' sub-spaces; probes: lists to probe."""

    def __init__(self, sample: np.ndarray, lists: int, separation=SEPARATION, least=LEAST_COSINE):
        self.coarse = apart(kmeans(sample, lists), separation)
        cuts = np.linspace(0, sample.shape[1], min(SUBSPACES, sample.shape[1]) + 1).astype(int)
        self.parts = [slice(a, b) for a, b in zip(cuts, cuts[1:])]
        rest = sample - self.coarse[_nearest(sample, self.coarse)[:, 0]]
        self.books = [kmeans(rest[:, p], CODES) for p in self.parts]
        self.far = float(np.sqrt(2 - 2 * least) + 1e-9)
        self.probes = self.sufficient(sample, least)

    def sufficient(self, sample: np.ndarray, least: float) -> int:
        """Probes that bring together SURE of the pairs of sample vectors and partners at the least cosine."""
        g = np.random.default_rng(1)
        x = sample[np.linspace(0, len(sample) - 1, min(DRAWN, len(sample))).astype(int)]
        u = g.normal(size=x.shape)
        u -= (u * x).sum(1, keepdims=True) * x
        y = least * x + np.sqrt(1 - least * least) * u / np.maximum(np.sqrt((u * u).sum(1, keepdims=True)), 1e-300)
        half, ranks = (self.coarse * self.coarse).sum(1) / 2, []
        for i in range(0, len(x), 512):
            sx, sy = half - x[i : i + 512] @ self.coarse.T, half - y[i : i + 512] @ self.coarse.T
            at = np.arange(len(sx))
            ranks.append(np.minimum((sx < sx[at, sy.argmin(1)][:, None]).sum(1), (sy < sy[at, sx.argmin(1)][:, None]).sum(1)))
        return int(min(MAX_PROBES, 1 + np.quantile(np.concatenate(ranks), SURE, method="higher")))

    def encode(self, x: np.ndarray, probes: int | None = None):
        """Probed lists (own first, -1 where a probe can find nothing), codes, distances from the decoded
        vectors, and whether a vector is in the core of its list."""
        near = _nearest(x, self.coarse, min(probes or self.probes, len(self.coarse)))
        own = self.coarse[near[:, :1]]
        # distance of x from the plane between its own centroid and another: what lies beyond is no nearer
        away = np.sqrt(((self.coarse[near] - own) ** 2).sum(2))
        gap = (((x[:, None] - self.coarse[near]) ** 2).sum(2) - ((x - own[:, 0]) ** 2).sum(1)[:, None]) / 2
        probed = np.where(gap <= self.far * away + 1e-9, near, -1)
        rest = x - own[:, 0]
        codes = np.stack([_nearest(rest[:, p], b)[:, 0] for p, b in zip(self.parts, self.books)], 1).astype(np.uint8)
        decoded = np.concatenate([b[codes[:, i]] for i, b in enumerate(self.books)], 1)
        return probed, codes, np.sqrt(((rest - decoded) ** 2).sum(1)), np.sqrt((rest * rest).sum(1)) <= self.far / 2 - 1e-6

    def distances(self, x: np.ndarray, own: int, codes: np.ndarray) -> np.ndarray:
        """Distances of rows of x from vectors coded in list `own`, by table look-up."""
        rest, out = x - self.coarse[own], 0.0
        for i, (p, b) in enumerate(zip(self.parts, self.books)):
            r = rest[:, p]
            out = out + ((r * r).sum(1)[:, None] - 2 * r @ b.T + (b * b).sum(1))[:, codes[:, i]]
        return np.sqrt(np.maximum(out, 0))


def _unit(raw: list[bytes], size: int) -> np.ndarray:
    """Unit vectors in double precision; components are stored as floats or as doubles."""
    data = b"".join(raw)
    x = np.frombuffer(data, "<f4" if len(data) == 4 * size * len(raw) else "<f8").astype(np.float64).reshape(-1, size)
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors(rows: DataFrame, id_col="vec_id", vec_col="embedding") -> DataFrame:
    """id, size (null: links with nothing), key (digest of the components), raw (floats of a float column, else doubles)."""
    kind = rows.schema[vec_col].dataType
    item = "float" if isinstance(kind, ArrayType) and isinstance(kind.elementType, FloatType) else "double"
    number = np.dtype("<f4" if item == "float" else "<f8")

    def run(batches):
        for b in batches:
            size, key, raw = [], [], []
            for i, v in zip(b.column(0).to_pylist(), b.column(1)):
                v = None if i is None or not v.is_valid or v.values.null_count else v.values.to_numpy(zero_copy_only=False).astype(number) + number.type(0)
                ok = v is not None and len(v) > 0 and np.isfinite(v).all() and v.any()
                data = v.tobytes() if ok else None
                size.append(len(v) if ok else None)
                key.append(hashlib.blake2b(data, digest_size=16).digest() if ok else None)
                raw.append(data)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(size, pa.int32()), pa.array(key, pa.binary()), pa.array(raw, pa.binary())], names=["id", "size", "key", "raw"])

    return map_arrow(rows.select(F.col(id_col).cast("long").alias("id"), F.col(vec_col).cast(f"array<{item}>").alias("v")), run, "id long, size int, key binary, raw binary")


FOUND = "edge boolean, a long, b long"


def _trained(classes: DataFrame, total: int, size: int, lists: int, least: float) -> Quantiser:
    """Learned in one task from a sample by hash; only the centroids come to the driver."""
    most = min(MAX_SAMPLE, max(8192, 32 * lists))
    h = F.pmod(F.xxhash64("key"), F.lit(1 << 40))
    taken = classes.select("key", "raw", h.alias("h")).filter(F.col("h") <= int(min(1.0, 1.1 * most / total + 0.01) * (1 << 40)))

    def run(batches):
        raw = [x for b in batches for x in b.column(0).to_pylist()]
        if raw:
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(Quantiser(_unit(raw, size), lists, least=least))], pa.binary())], names=["q"])

    sample = taken.repartition(1).sortWithinPartitions("h", "key").limit(most).select("raw")
    return pickle.loads(map_arrow(sample, run, "q binary").first()["q"])


def _search(classes: DataFrame, size: int, least: float, lists: int | None = None) -> DataFrame:
    """FOUND rows for class vectors of one size: counts (a linked with b more vectors), edges."""
    spark = classes.sparkSession
    total = classes.count()
    lists = lists or int(min(MAX_LISTS, max(1, 2 ** round(np.log2(max(total, 1)) / 2))))
    block = int(min(MAX_BLOCK, max(BLOCK, total >> 16)))
    sent = spark.sparkContext.broadcast(_trained(classes, total, size, lists, least))  # MAX_LISTS centroids at most

    def index(batches):
        for b in batches:
            if b.num_rows:
                near, codes, err, core = sent.value.encode(_unit(b.column(2).to_pylist(), size))
                lists_of = pa.array([x[x >= 0] for x in near.astype(np.int32)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [b.column(0), b.column(1), pa.array(near[:, 0].astype(np.int32)), pa.array(core), lists_of, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(err), b.column(2)],
                    names=["rep", "n", "own", "core", "near", "codes", "err", "raw"],
                )

    coded = stored(map_arrow(classes.select("rep", "n", "raw"), index, "rep long, n long, own int, core boolean, near array<int>, codes binary, err double, raw binary"), "pq-codes")
    # a row per list, MAX_LISTS at most: blocks of its core (numbers below 0) and of the rest, and what the core holds
    of = lambda c, core: F.when(F.col("core") == core, F.col(c))
    cut = lambda core: F.ceil(F.count(of("rep", core)) / block).cast("int")
    lists_of = stored(coded.groupBy(F.col("own").alias("l")).agg(cut(True).alias("core_blocks"), cut(False).alias("rest_blocks"), F.sum(of("n", True)).alias("core_n"), F.min(of("rep", True)).alias("core_rep")), "pq-blocks")
    place = F.expr("if(core, -1 - pmod(xxhash64(rep), core_blocks), pmod(xxhash64(rep), rest_blocks))").cast("int")
    held = coded.join(F.broadcast(lists_of), F.col("own") == F.col("l")).select("own", place.alias("block"), F.lit(0).alias("asks"), "rep", "n", F.col("own").alias("home"), "near", "codes", "err", "raw")
    asked = F.expr("concat(if(rest_blocks > 0, sequence(0, rest_blocks - 1), array()), if(core_blocks > 0 and not (core and to = own), sequence(-core_blocks, -1), array()))")
    asking = coded.withColumn("to", F.explode("near")).join(F.broadcast(lists_of), F.col("to") == F.col("l")).withColumn("block", F.explode(asked))
    none = F.lit(None)
    asking = asking.select(F.col("to").alias("own"), "block", F.lit(1).alias("asks"), "rep", "n", F.col("own").alias("home"), none.cast("array<int>").alias("near"), none.cast("binary").alias("codes"), none.cast("double").alias("err"), "raw")

    def links(batches):
        q = sent.value
        state = {"key": None}

        def answer(s, asks):
            rep, n, home, x = asks
            y_rep, y_n, near, codes, err, y = s["index"]
            dist = q.distances(x, s["key"][0], codes)
            link = (dist + err <= q.far - 1e-6) & (rep[:, None] != y_rep[None, :])  # must link
            i, j = np.nonzero((dist <= q.far + err) & ~link & (rep[:, None] != y_rep[None, :]))
            for k in range(0, len(i), 32768):
                a, b = i[k : k + 32768], j[k : k + 32768]
                link[a, b] = np.einsum("ij,ij->i", x[a], y[b]) >= least
            i, j = np.nonzero(link)
            if not len(i):
                return None
            homes, at_home = np.unique(home, return_inverse=True)
            probed = np.stack([(near == h).any(1) for h in homes])
            alone = ~probed[at_home[i], j]  # these askers' lists are not probed by what they found
            ids = np.concatenate([rep, y_rep])
            values, at = np.unique(ids, return_inverse=True)
            a, b = at[: len(rep)], at[len(rep) :]
            count = np.bincount(a[i], y_n[j], minlength=len(values)) + np.bincount(b[j[alone]], n[i[alone]], minlength=len(values))
            root = local_roots(len(values), a[i], b[j])
            c, e = np.flatnonzero(count), np.flatnonzero(root != np.arange(len(values)))
            return pa.RecordBatch.from_arrays(
                [pa.array(np.r_[np.zeros(len(c), bool), np.ones(len(e), bool)]), pa.array(np.r_[values[c], values[e]]), pa.array(np.r_[count[c].astype(np.int64), values[root[e]]])],
                names=["edge", "a", "b"],
            )

        def rows_of(part):
            return part.column("rep").to_numpy(), part.column("n").to_numpy()

        pending: list = []

        def finish():
            """Index rows of the block are complete: turn them into arrays."""
            t = pa.Table.from_batches(pending)
            lists_of = t.column("near").to_pylist()
            near = np.full((len(lists_of), max(map(len, lists_of))), -1, np.int32)
            for row, x in zip(near, lists_of):
                row[: len(x)] = x
            codes = np.frombuffer(b"".join(t.column("codes").to_pylist()), np.uint8).reshape(t.num_rows, -1)
            state["index"] = (*rows_of(t), near, codes, t.column("err").to_numpy(), _unit(t.column("raw").to_pylist(), size))
            pending.clear()

        for b in batches:
            own, block, asks = (b.column(k).to_numpy() for k in (0, 1, 2))
            cuts = [0, *(np.flatnonzero((own[1:] != own[:-1]) | (block[1:] != block[:-1]) | (asks[1:] != asks[:-1])) + 1).tolist(), b.num_rows]
            for lo, hi in zip(cuts, cuts[1:]):
                if lo == hi:
                    continue
                part, key = b.slice(lo, hi - lo), (int(own[lo]), int(block[lo]))
                if key != state["key"]:
                    state, pending[:] = {"key": key}, []
                if not asks[lo]:
                    pending.append(part)
                    continue
                if pending:
                    finish()
                if "index" not in state:  # an empty block
                    continue
                for k in range(0, hi - lo, QUERIES):
                    p = part.slice(k, QUERIES)
                    out = answer(state, (*rows_of(p), p.column("home").to_numpy(), _unit(p.column("raw").to_pylist(), size)))
                    if out is not None:
                        yield out

    dealt = held.unionByName(asking).repartition("own", "block").sortWithinPartitions("own", "block", "asks", "rep")
    inside = coded.filter("core").join(F.broadcast(lists_of), F.col("own") == F.col("l"))
    counted = inside.select(F.lit(False).alias("edge"), F.col("rep").alias("a"), (F.col("core_n") - F.col("n")).alias("b")).filter("b > 0")
    joined = inside.filter("rep <> core_rep").select(F.lit(True).alias("edge"), F.col("rep").alias("a"), F.col("core_rep").alias("b"))
    return map_arrow(dealt, links, FOUND).unionByName(counted).unionByName(joined)


def near_vectors(rows: DataFrame, id_col="vec_id", vec_col="embedding", least=LEAST_COSINE, lists: int | None = None) -> DataFrame:
    """One row per row: vec_id, n_links, component_id, kept.

    Vectors that are null, empty, zero or hold null or non-finite components, and rows
    without id, link with nothing: n_links 0, a component of their own (null without id).
    Vectors of different lengths never link. Rows with equal vectors link with each other.
    `lists` sets the number of inverted lists (none: about the square root of the vectors).
    """
    all_rows = stored(vectors(rows, id_col, vec_col), "pq-vectors")
    classes = stored(all_rows.filter("size is not null").groupBy("key").agg(F.min("id").alias("rep"), F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("raw").alias("raw")), "pq-classes")
    found = None
    for r in classes.select("size").distinct().orderBy("size").collect():
        part = _search(classes.filter(F.col("size") == r["size"]), r["size"], least, lists)
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.sparkSession.createDataFrame([], FOUND)
    found = stored(found, "pq-found")
    counts = stored(found.filter("not edge").groupBy(F.col("a").alias("rep")).agg(F.sum("b").alias("links")), "pq-counts")
    roots = stored(components(found.filter("edge").select("a", "b"), "pq-links"), "pq-roots")
    named = classes.select("key", "rep", "n").join(counts, "rep", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    by_key = stored(named.select(F.col("key").alias("k"), (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id")), "pq-named")
    out = all_rows.select("id", "key").join(by_key, F.col("key") == F.col("k"), "left")
    comp = F.coalesce("component_id", "id")
    return out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), comp.alias("component_id"), F.coalesce(F.col("id") == comp, F.lit(False)).alias("kept"))


def op4(spark, sf_dir: str) -> DataFrame:
    """Links, component and representative of every embedding."""
    return near_vectors(table(spark, sf_dir, "embeddings"))
