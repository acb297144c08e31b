"""SimHash near-duplicates by meet-in-the-middle ball hashing.

A fingerprint is the bitwise majority over the XXH64 values of a text's word
shingles. Two fingerprints link if they differ in RADIUS = 3 bits at most.

Candidates: of three differing bits at least one lies in one of four blocks of 16 bits, so
two at most lie in the other 48 bits. Every distinct fingerprint therefore emits, for each
block, the other 48 bits and their 48 variants within half the radius (one bit): 196 rows,
shuffled on (block, variant). A pair meets where one side's bits, unchanged or with one
flipped, equal the other's. No link is missed, and all links are verified on 64 bits.

Equal fingerprints are one node, so a bucket holds distinct fingerprints that agree on its
48 bits but for one flip: 49 * 65536 at most, whatever the table holds, and nearly always a
few. In a bucket, members that agree on the block differ in two bits at most and are linked
to one of them; only those (65536 at most) stand for the block's value, and of a bucket with
many values each looks up the 696 values within three bits of its own. So neither memory nor
time of a bucket grows with the square of its size. Each task sends a spanning forest of the
links that it verified, not the pairs.

near_duplicates() links by fingerprints alone. similar_documents() takes these links, from
several fingerprints over distinct words, as candidates and keeps those whose texts share
enough word shingles. Pairs that fingerprints miss, or that a forest of unverified links has
passed over, meet in buckets of MinHash bands, where every pair of texts that aren't in one
group yet is verified.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import components, forest
from .common import map_arrow, stored, table

RADIUS = 3
SEED = 42
BLOCKS, WIDTH = 4, 16
REST = 64 - WIDTH
#: Variants of the bits beside a block: themselves and each of their bits flipped.
BALL = REST + 1
#: Rows of complete buckets that a task links at a time.
CHUNK = 1 << 20
#: Block values of a bucket up to which all pairs of them are compared; of more, neighbours are looked up.
STEP = 1024
#: Values within RADIUS bits of a block's value, as masks.
NEIGHBOURS = np.array([sum(1 << i for i in c) for k in range(1, RADIUS + 1) for c in combinations(range(WIDTH), k)], np.int64)


def shingle_hashes(text: str | None, size: int) -> np.ndarray:
    """XXH64 of the word shingles of `text` (A-Z lowered), repeats included."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: ASCII only, both
    if not words:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([digest(joined, SEED)], np.uint64)
    gaps = np.flatnonzero(np.frombuffer(joined, np.uint8) == 32)
    starts = [0, *(gaps[: len(words) - size] + 1).tolist()]
    ends = [*gaps[size - 1 :].tolist(), len(joined)]
    return np.array([digest(joined[i:j], SEED) for i, j in zip(starts, ends)], np.uint64)


def fingerprint(text: str | None, size: int = 3) -> int:
    """64-bit SimHash, unsigned; 0 for a text without words."""
    h = shingle_hashes(text, size)
    n = len(h)
    if not n:
        return 0
    octets = h.view(np.uint8).reshape(n, 8)
    counts = np.zeros(64, np.int64)
    whole = n // 255 * 255
    for at in range(0, whole, 255 * 64):  # sums of 255 bits fit in a byte
        part = np.unpackbits(octets[at : min(at + 255 * 64, whole)], axis=1, bitorder="little")
        counts += np.add.reduce(part.reshape(-1, 255, 64), axis=1, dtype=np.uint8).sum(0, dtype=np.int64)
    counts += np.unpackbits(octets[whole:], axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > n, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col="doc_id", text_col="text", size=3) -> DataFrame:
    """id, fp (long: the unsigned fingerprint's bits)."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t, size) for t in b.column(1).to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fps)], names=["id", "fp"])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "id long, fp long")


def link_buckets(key: np.ndarray, info: np.ndarray, forests: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Links of complete buckets (rows of near_links() with equal keys next to each other):
    pairs within RADIUS bits that connect exactly what all such pairs within buckets connect.
    With more forests, that many spanning forests without a common link: other ways between
    the same nodes, for callers that drop links afterwards."""
    none = np.empty(0, np.int64)
    if not len(key):
        return none, none
    new = np.r_[True, key[1:] != key[:-1]]
    run = np.cumsum(new) - 1
    many = np.bincount(run)[run] > 1
    if not many.any():
        return none, none
    key, run, r, left = key[many], run[many], info[many].astype(np.int64) >> WIDTH, info[many].astype(np.int64) & ((1 << WIDTH) - 1)
    order = np.lexsort((r, left, run))
    key, run, r, left = (x[order] for x in (key, run, r, left))
    low, own = (np.int64(1) << (key >> REST) * WIDTH) - 1, (key & ((1 << REST) - 1)) ^ np.where(r > 0, np.int64(1) << np.maximum(r - 1, 0), 0)
    u = ((own & low) | left << (key >> REST) * WIDTH | (own & ~low) << WIDTH).view(np.uint64)
    first = np.r_[True, (run[1:] != run[:-1]) | (left[1:] != left[:-1])]
    stands = np.flatnonzero(first)[np.cumsum(first) - 1]
    xs, ys = [np.flatnonzero(~first)], [stands[~first]]
    reps = np.flatnonzero(first)
    rep_run = run[reps]
    begins = np.flatnonzero(np.r_[True, rep_run[1:] != rep_run[:-1]])
    sizes = np.diff(np.r_[begins, len(reps)])
    small = np.repeat(sizes <= 64, sizes)

    def near(a, b):
        ok = np.bitwise_count(u[a] ^ u[b]) <= RADIUS
        xs.append(a[ok])
        ys.append(b[ok])

    for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
        i = np.flatnonzero(small[:-d] & (rep_run[:-d] == rep_run[d:]))
        near(reps[i], reps[i + d])
    for s, k in zip(begins[sizes > 64], sizes[sizes > 64]):
        members = reps[s : s + k]
        if k <= STEP:
            i, j = np.nonzero(np.triu(np.bitwise_count(u[members, None] ^ u[None, members]) <= RADIUS, 1))
            xs.append(members[i])
            ys.append(members[j])
            continue
        place = np.full(1 << WIDTH, -1)
        place[left[members]] = np.arange(k)
        for mask in NEIGHBOURS:
            j = place[left[members] ^ mask]
            i = np.flatnonzero(j > np.arange(k))
            near(members[i], members[j[i]])
    values, at = np.unique(u.view(np.int64), return_inverse=True)
    x, y = at[np.concatenate(xs)], at[np.concatenate(ys)]
    out = []
    for _ in range(forests):
        kept = forest(len(values), x, y)
        out.append((values[x[kept]], values[y[kept]]))
        x, y = np.delete(x, kept), np.delete(y, kept)
    return tuple(np.concatenate(z) for z in zip(*out))


def _link_stream(batches, forests):
    for key, info in _whole(batches):
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in link_buckets(key, info, forests)], names=["a", "b"])


def near_links(fps: DataFrame, forests: int = 1) -> DataFrame:
    """fps: distinct longs `fp`. Links a, b within RADIUS bits whose components are those of all such pairs."""
    each = fps.select("fp", F.explode(F.sequence(F.lit(0), F.lit(BLOCKS * BALL - 1))).alias("i")).selectExpr("fp", f"cast(i div {BALL} as int) * {WIDTH} as at", f"cast(i % {BALL} as int) as r")
    # a key holds the block's number and, closed up, the bits beside it; info the flipped bit and the block's own value
    rows = each.selectExpr(
        f"(shiftleft(cast(at div {WIDTH} as bigint), {REST}) | (fp & (shiftleft(1L, at) - 1)) | shiftleft(shiftrightunsigned(shiftrightunsigned(fp, at), {WIDTH}), at)) ^ (case when r = 0 then 0L else shiftleft(1L, r - 1) end) as key",
        f"shiftleft(r, {WIDTH}) | cast(shiftrightunsigned(fp, at) & {(1 << WIDTH) - 1}L as int) as info",
    )
    return map_arrow(rows.repartition("key").sortWithinPartitions("key"), lambda batches: _link_stream(batches, forests), "a long, b long")


def near_duplicates(docs: DataFrame, id_col="doc_id", text_col="text", size=3) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id
    (smallest id reachable by links, itself included).

    Null or empty text, or one of blanks: fingerprint zero, linked like any other.
    A null id never names a component: such a row has the component of the other
    rows with its fingerprint, or null. Repeated rows: one result each.
    """
    rows = stored(fingerprints(docs, id_col, text_col, size), "simhash-rows")
    # one node for each fingerprint
    nodes = stored(rows.groupBy("fp").agg(F.min("id").alias("rep")), "simhash-nodes")
    roots = stored(components(near_links(nodes.select("fp")), "simhash-links"), "simhash-roots")
    named = stored(roots.join(nodes.withColumnRenamed("fp", "node"), "node"), "simhash-named")
    least = stored(named.groupBy("root").agg(F.min("rep").alias("least")), "simhash-least")
    linked = named.join(least, "root").select(F.col("node").alias("fp"), "least")
    by_fp = stored(nodes.join(linked, "fp", "left").select("fp", F.coalesce("least", "rep").alias("component_id")), "simhash-components")
    return rows.join(by_fp, "fp").select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


#: Fingerprints of a text in similar_documents(): one, as MinHash bands find what it misses (on
#: check_h a second one changed no group). Odd multipliers make their word hashes independent.
VIEWS = 1
#: Spanning forests of candidate links that a task sends on to be verified.
FORESTS = 1
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))
_S33 = np.uint64(33)


#: MinHash bands of a text, and minima in each. Texts of similarity s share no bucket with a
#: chance of (1 - s ** BAND_ROWS) ** BANDS: 5e-6 at 0.8, 5e-14 at 0.9.
BANDS, BAND_ROWS = 40, 6
_DRAWN = np.random.default_rng(SEED).integers(0, 1 << 64, (2, BANDS * BAND_ROWS, 1), np.uint64)
#: Pivot rounds at most, and pairs left per bucket row up to which all are verified at once.
PIVOTS, FEW = 2, 4
#: Longs of a set's bitmap, by which pairs that can't be similar are told without their sets.
LONGS = 16
#: Bits of the bitmap of ids whose texts are read again.
SLOTS = 1 << 22


def word_fingerprints(text: str | None, views: int = VIEWS) -> list[int]:
    """Signed 64-bit SimHashes over the distinct words of `text`, each over hashes of its own."""
    h, out = np.unique(shingle_hashes(text, 1)), []
    for v in range(views):
        g = h + np.uint64(v)
        for m in _MIX:
            g = (g ^ (g >> _S33)) * m
        octets, n = (g ^ (g >> _S33)).view(np.uint8).reshape(-1, 8), len(h)
        counts = np.zeros(64, np.int64)
        for at in range(0, n, 65536):
            counts += np.unpackbits(octets[at : at + 65536], axis=1, bitorder="little").sum(0, dtype=np.int64)
        out.append(int(np.packbits(2 * counts > n, bitorder="little").view(np.int64)[0]))
    return out


def bands(grams: np.ndarray) -> np.ndarray:
    """Bucket (long) of each MinHash band of a set of shingle hashes; none for an empty set."""
    if not len(grams):
        return np.empty(0, np.int64)
    least = np.full(BANDS * BAND_ROWS, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(grams), 256):
        np.minimum(least, ((grams[None, at : at + 256] ^ _DRAWN[0]) * (_DRAWN[1] | np.uint64(1))).min(axis=1), out=least)
    out = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, BAND_ROWS).T:
        out = (out ^ column) * _MIX[0]
        out = (out ^ (out >> _S33)) * _MIX[1]
    return (out ^ (out >> _S33)).view(np.int64)


def bitmap(grams: np.ndarray) -> np.ndarray:
    """Bits of a set of shingle hashes: a bit that only one of two sets has is a shingle that the other lacks."""
    out = np.zeros(64 * LONGS, np.uint8)
    out[(grams % np.uint64(64 * LONGS)).astype(np.int64)] = 1
    return np.packbits(out, bitorder="little").view(np.int64)


def _slices(batches, rows=1024):
    """Batches of a bounded number of rows, so that a task holds few texts at a time."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _whole(batches, chunk=CHUNK):
    """Columns of rows sorted by the first one, cut only where it changes."""
    held, n = [], 0

    def joined():
        return [np.concatenate(x) for x in zip(*held)]

    for batch in batches:
        if batch.num_rows:
            held.append([c.to_numpy(zero_copy_only=False) for c in batch.columns])
            n += batch.num_rows
        if n < chunk:
            continue
        cols = joined()
        changes = np.flatnonzero(cols[0][1:] != cols[0][:-1])
        cut = changes[-1] + 1 if len(changes) else 0  # the last bucket may go on in the next batch
        if cut:
            yield [x[:cut] for x in cols]
        held, n = [[x[cut:] for x in cols]], n - cut
    if n:
        yield joined()


def _runs(bucket: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begin of each run of equal values, and the run of each row."""
    new = np.r_[True, bucket[1:] != bucket[:-1]]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _shared(batches):
    """Rows bucket, node, size, sorted: those of buckets with several nodes, and the bucket's first node."""
    for bucket, node, size in _whole(batches, CHUNK // 4):
        begins, run = _runs(bucket)
        many = np.bincount(run)[run] > 1
        yield pa.RecordBatch.from_arrays([pa.array(x[many]) for x in (bucket, node, size, node[begins][run])], names=["bucket", "node", "size", "first"])


def crossing(bucket, node, size, group, bits, least: float, pivot: int | None = None):
    """Pairs of nodes of complete buckets that are in different groups and can be similar by
    their sizes and bitmaps (a bound: no similar pair is left out), in parts; with `pivot`, those of one node of each bucket only, another for
    another value."""
    begins, run = _runs(bucket)
    sizes = np.bincount(run)

    def fit(i, j):
        ok = (group[i] != group[j]) & (np.minimum(size[i], size[j]) >= least * np.maximum(size[i], size[j]) - 1e-9)
        i, j = i[ok], j[ok]
        both = np.minimum(size[i] - np.bitwise_count(bits[i] & ~bits[j]).sum(1, dtype=np.int64), size[j] - np.bitwise_count(bits[j] & ~bits[i]).sum(1, dtype=np.int64))
        ok = both >= least * (size[i] + size[j] - both) - 1e-9
        return node[i[ok]], node[j[ok]]

    if pivot is not None:
        drawn = (bucket[begins].view(np.uint64) ^ np.uint64(pivot)) * _MIX[0]
        yield fit((begins + ((drawn ^ (drawn >> _S33)) % sizes.astype(np.uint64)).astype(np.int64))[run], np.arange(len(node)))
        return
    small = sizes[run] <= 64
    for d in range(1, int(sizes[sizes <= 64].max(initial=1))):
        i = np.flatnonzero(small[:-d] & (run[:-d] == run[d:]))
        yield fit(i, i + d)
    step = 512
    for s, k in zip(begins[sizes > 64], sizes[sizes > 64]):
        for p in range(0, k, step):
            for q in range(p, k, step):
                i, j = (x.ravel() for x in np.meshgrid(np.arange(p, min(p + step, k)), np.arange(q, min(q + step, k)), indexing="ij"))
                yield fit(s + i[i < j], s + j[i < j])


def _crossing_stream(batches, least, pivot):
    for bucket, node, size, group, *bits in _whole(batches, CHUNK // LONGS):
        for x, y in crossing(bucket, node, size, group, np.stack(bits, axis=1).view(np.uint64), least, pivot):
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(x, y)), pa.array(np.maximum(x, y))], names=["a", "b"])


def _candidates(texts: DataFrame, fp: str) -> DataFrame:
    """texts: node, and a fingerprint column. Pairs a, b of nodes to verify: fingerprints within
    RADIUS bits, by one node of each fingerprint, and the other nodes of a fingerprint with that one."""
    classes = stored(texts.groupBy(F.col(fp).alias("fp")).agg(F.min("node").alias("rep"), F.count(F.lit(1)).alias("n")), "similar-classes")
    links = stored(near_links(classes.select("fp"), FORESTS).distinct(), "similar-links")
    ends = classes.select("fp", "rep")
    pairs = links.join(ends.select(F.col("fp").alias("a"), F.col("rep").alias("ra")), "a").join(ends.select(F.col("fp").alias("b"), F.col("rep").alias("rb")), "b").select(F.col("ra").alias("a"), F.col("rb").alias("b"))
    shared = classes.filter("n > 1").select(F.col("fp").alias("f"), "rep")
    same = texts.select("node", F.col(fp).alias("fp")).join(shared, F.col("fp") == F.col("f")).filter("node <> rep").select(F.col("rep").alias("a"), F.col("node").alias("b"))
    return pairs.unionByName(same).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))


def similar_documents(docs: DataFrame, id_col="doc_id", text_col="text", size=5, least=0.8, views=VIEWS) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash (xxhash64 of the text), component_id (smallest
    id reachable by links), head (the row has that id and, of its texts, the one that stands
    for the group).

    Texts link if their sets of `size`-word shingles have a Jaccard similarity of `least` or
    more; equal texts always do. Candidates are SimHash links in any of the views and pairs
    that share a bucket of a MinHash band. After a first round (forest links, each bucket's
    first node with the others), every pair in a bucket whose texts are still in different
    groups is verified. So a similar pair can be missed only if it shares no bucket (see
    BANDS), and no dissimilar pair links. Texts are told apart by 64 bits of their hash, so rows
    that share an id are grouped by their own texts. Rows without id are in no group:
    component_id null, head false. Texts without words link only if they are equal.
    """
    fps, longs = [f"fp{v}" for v in range(views)], [f"bits{k}" for k in range(LONGS)]

    def prints(batches):
        for b in _slices(batches):
            texts = b.column(1).to_pylist()
            cols = np.array([word_fingerprints(t, views) for t in texts], np.int64).reshape(-1, views)
            th = [xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) for t in texts]
            grams = [np.unique(shingle_hashes(t, size)) for t in texts]
            bits = np.array([bitmap(g) for g in grams], np.int64).reshape(-1, LONGS)
            more = [pa.array([bands(g).tobytes() for g in grams], pa.binary()), pa.array([len(g) for g in grams], pa.int64())]
            prints = [pa.array(np.ascontiguousarray(x)) for x in (*cols.T, *bits.T)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(th, pa.binary()), *prints, *more], names=["id", "h", "th", *fps, *longs, "bands", "size"])

    def banded(batches):
        for b in _slices(batches):
            per = [np.frombuffer(x, np.int64) for x in b.column(1).to_pylist()]
            n = [len(x) for x in per]
            out = [np.concatenate([np.empty(0, np.int64), *per]), *(np.repeat(b.column(k).to_numpy(), n) for k in (0, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in out], names=["bucket", "node", "size"])

    def sets(batches):
        for b in _slices(batches):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([np.unique(shingle_hashes(t, size)).tobytes() for t in b.column(1).to_pylist()], pa.binary())], names=["n", "grams"])

    def similar(batches):
        for b in _slices(batches, 64):
            keep = []
            for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist()):
                p, q = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(p, q, assume_unique=True))
                keep.append(len(p) > 0 and both >= least * (len(p) + len(q) - both) - 1e-9)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_()))

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    hashed = rows.select("id", "text", F.xxhash64("text").alias("h"))
    printed = stored(map_arrow(hashed, prints, "id long, h long, th binary, " + ", ".join(f"{f} long" for f in (*fps, *longs)) + ", bands binary, size long"), "similar-rows")
    # one node for each text
    node = F.conv(F.hex(F.substring("th", 1, 8)), 16, -10).cast("long")
    texts = stored(printed.filter("id is not null").groupBy("th").agg(F.min("id").alias("low"), *[F.first(f).alias(f) for f in (*fps, *longs, "bands", "size")]).withColumn("node", node), "similar-texts")
    dealt = map_arrow(texts.select("node", "bands", "size"), banded, "bucket long, node long, size long").repartition("bucket").sortWithinPartitions("bucket", "node")
    buckets = stored(map_arrow(dealt, _shared, "bucket long, node long, size long, first long"), "similar-buckets")
    found = buckets.filter("node <> first").select(F.col("first").alias("a"), F.col("node").alias("b")).distinct()
    for f in fps:
        found = found.unionByName(stored(_candidates(texts, f), "similar-candidates"))
    pairs = stored(found.distinct(), "similar-pairs")
    # sizes and bitmaps, small beside the sets, rule out most pairs that only a band has brought together
    sketch = texts.select("node", "size", *longs)
    of_end = lambda e: sketch.select(F.col("node").alias(e), F.col("size").alias(f"size_{e}"), *[F.col(x).alias(f"{x}_{e}") for x in longs])
    alone = lambda x, y: F.expr(f"size_{x} - (" + " + ".join(f"bit_count({z}_{x} & ~{z}_{y})" for z in longs) + ")")
    shared = F.least(alone("a", "b"), alone("b", "a"))  # shingles that both can have, at most
    likely = pairs.join(of_end("a"), "a").join(of_end("b"), "b").filter(shared >= least * (F.col("size_a") + F.col("size_b") - shared) - 1e-9).select("a", "b")

    def fetched(pairs):
        """n, grams: the sets of the pairs' ends, from texts that are read again. A bitmap of the
        asked ids keeps nearly all other texts out of the shuffle."""
        ends = pairs.select(F.col("a").alias("n")).unionByName(pairs.select(F.col("b").alias("n"))).distinct()
        wanted = stored(ends.join(texts.select("node", "low", F.col("th").alias("want")), F.col("n") == F.col("node")).select("n", "low", "want"), "similar-wanted")
        slot = lambda c: F.pmod(F.xxhash64(c), F.lit(SLOTS))
        asked = wanted.select(slot("low").alias("s")).groupBy(F.expr("s div 64").alias("w")).agg(F.expr("bit_or(shiftleft(1L, cast(s % 64 as int)))").alias("m"))  # SLOTS / 64 rows at most
        few = rows.withColumn("s", slot("id")).join(F.broadcast(asked), F.expr("s div 64") == F.col("w")).filter(F.expr("(m & shiftleft(1L, cast(s % 64 as int))) <> 0")).select("id", "text")
        # ids may repeat: a node's text is the one whose hash made it
        mine = few.join(wanted, F.col("id") == F.col("low")).mapInArrow(_text_of, "n long, text string")
        return stored(map_arrow(mine, sets, "n long, grams binary"), "similar-grams")

    def verified(pairs):
        grams = fetched(pairs)
        one = pairs.join(grams.select(F.col("n").alias("a"), F.col("grams").alias("x")), "a")
        two = one.join(grams.select(F.col("n").alias("b"), F.col("grams").alias("y")), "b").select("a", "b", "x", "y")
        return stored(map_arrow(two, similar, "a long, b long"), "similar-links")

    links, pivot = verified(stored(likely, "similar-pairs")), 0
    roots = stored(components(links, "similar-components"), "similar-roots")
    while pivot is not None:
        grouped = stored(buckets.join(roots, "node", "left").select("bucket", "node", "size", F.coalesce("root", "node").alias("group")), "similar-grouped")
        shares = grouped.groupBy("bucket", "group").agg(F.count(F.lit(1)).alias("k")).groupBy("bucket").agg(F.sum("k").alias("n"), F.sum(F.expr("k * k")).alias("own"))
        n, left = shares.filter("own < n * n").agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum(F.expr("cast(n * n - own as double)")), F.lit(0.0)) / 2).first()
        if not left:
            break
        # many pairs: a node of each bucket first, which joins most of what belongs together; then all pairs left
        pivot = pivot + 1 if left > FEW * n and pivot < PIVOTS else None
        open_ones = grouped.join(shares.filter("own < n * n").select(F.col("bucket").alias("_b")), F.col("bucket") == F.col("_b"), "left_semi")
        dealt = open_ones.join(texts.select(F.col("node").alias("n"), *longs), F.col("node") == F.col("n")).select("bucket", "node", "size", "group", *longs).repartition("bucket").sortWithinPartitions("bucket", "node")
        drawn = map_arrow(dealt, lambda batches, pivot=pivot: _crossing_stream(batches, least, pivot), "a long, b long")
        links = links.unionByName(verified(stored(drawn.distinct(), "similar-pairs")))
        roots = stored(components(links, "similar-components"), "similar-roots")
    named = stored(texts.select("th", "low", "node").join(roots, "node", "left").select("th", "low", F.coalesce("root", "node").alias("root")), "similar-named")
    heads = stored(named.groupBy("root").agg(F.min(F.struct("low", "th")).alias("head")), "similar-heads")
    of = stored(named.join(heads, "root").select(F.col("th").alias("t"), F.col("head.low").alias("component_id"), (F.col("th") == F.col("head.th")).alias("stands")), "similar-groups")
    known = F.col("id").isNotNull()
    return printed.join(of, F.col("th") == F.col("t"), "left").select(
        F.col("id").alias("doc_id"), F.col("h").alias("text_hash"), F.when(known, F.col("component_id")).alias("component_id"), (known & F.col("stands") & (F.col("id") == F.col("component_id"))).alias("head")
    )


def _text_of(batches):
    """Rows id, text, n, want: those whose text has the wanted hash, once per node and task."""
    seen = set()
    for b in batches:
        cols = dict(zip(b.schema.names, b.columns))
        n, text = [], []
        for i, t, w in zip(cols["n"].to_pylist(), cols["text"].to_pylist(), cols["want"].to_pylist()):
            if i not in seen and xxhash.xxh3_128_digest((t or "").encode("utf-8", "surrogatepass")) == w:
                seen.add(i)
                n.append(i)
                text.append(t)
        yield pa.RecordBatch.from_arrays([pa.array(n, pa.int64()), pa.array(text, pa.string())], names=["n", "text"])


def op7(spark, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    return near_duplicates(table(spark, sf_dir, "documents"))
