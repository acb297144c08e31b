import base64
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pandas as pd
import pytest
import xxhash
from pyspark.sql import functions as F

from tidebook.llm import components, embedding_dedup, quality_classifier, sharding, simhash, warc

from .data import awkward, documents, prose


class Union:
    def __init__(self):
        self.p = {}

    def find(self, x):
        self.p.setdefault(x, x)
        while self.p[x] != x:
            x = self.p[x]
        return x

    def link(self, a, b):
        a, b = self.find(a), self.find(b)
        self.p[max(a, b)] = min(a, b)


def test_components_of_paths_stars_and_random_links(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(1, 60)] + [(1000, 1000 + i) for i in range(1, 80)] + [(r.randrange(2000, 2200), r.randrange(2000, 2200)) for _ in range(150)] + [(7, 7), (None, 3)]
    u = Union()
    for a, b in edges:
        if a is not None and a != b:
            u.link(a, b)
    got = {x.node: x.root for x in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {n: u.find(n) for n in u.p}
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_local_roots():
    r = random.Random(4)
    for _ in range(50):
        n, m = r.randrange(1, 40), r.randrange(0, 50)
        x, y = np.array([r.randrange(n) for _ in range(m)], int), np.array([r.randrange(n) for _ in range(m)], int)
        u = Union()
        for a, b in zip(x, y):
            u.link(int(a), int(b))
        assert components.local_roots(n, x, y).tolist() == [u.find(i) for i in range(n)]


def slow_fingerprint(text):
    t = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\v\f\r":
        t = t.replace(c, " ")
    w = [x for x in t.split(" ") if x]
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_fingerprints_and_components_match_brute_force(spark):
    r = random.Random(6)
    rows = awkward() + [(100 + i, prose(50, 400 - r.randrange(3)) + " tail" * r.randrange(2), "en", "s", 0) for i in range(40)] + [(200 + i, prose(i, 3), "en", "s", 0) for i in range(20)]
    got = simhash.near_duplicates(documents(spark, rows)).collect()
    fp = {r[1]: slow_fingerprint(r[1]) for r in rows}
    u = Union()
    for a in rows:
        for b in rows:
            if a[0] is not None and b[0] is not None and (fp[a[1]] ^ fp[b[1]]).bit_count() <= 3:
                u.link(a[0], b[0])
    named = {f"{fp[t]:016x}": u.find(i) for i, t, *_ in rows if i is not None}
    assert Counter((x.doc_id, x.fingerprint, x.component_id) for x in got) == Counter((i, f"{fp[t]:016x}", named.get(f"{fp[t]:016x}")) for i, t, *_ in rows)
    assert simhash.near_duplicates(documents(spark, [])).count() == 0


def test_every_link_of_three_bits_is_found_and_none_of_four(spark):
    r = random.Random(9)
    seeds = [r.getrandbits(64) for _ in range(150)]
    fps = set(seeds)
    for s in seeds:
        for n in (1, 2, 3, 3, 3, 4, 5):
            fps.add(s ^ sum(1 << b for b in r.sample(range(64), n)))
        block = r.randrange(4)
        fps.add(s ^ sum(1 << (16 * block + b) for b in r.sample(range(16), 3)))
    dense = r.getrandbits(64)  # one crowded neighbourhood: more values than are compared pair by pair at once
    fps |= {dense ^ sum(1 << b for b in r.sample(range(24), r.randrange(4))) for _ in range(1500)}
    for block in range(4):  # buckets with so many values of one block that neighbours are looked up
        fps |= {dense ^ v << (16 * block) for v in r.sample(range(1 << 16), 1500)}
    signed = [x - (1 << 64) if x >> 63 else x for x in fps]
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long")).collect()
    got = {x.node: x.root for x in components.components(spark.createDataFrame([(x.a, x.b) for x in links], "a long, b long")).collect()}
    arr, u = np.array(sorted(fps), np.uint64), Union()
    for i in range(len(arr)):
        for j in np.flatnonzero(np.bitwise_count(arr[i] ^ arr[i + 1 :]) <= 3) + i + 1:
            u.link(int(arr[i].view(np.int64)), int(arr[j].view(np.int64)))
    assert got == {n: u.find(n) for n in u.p}


def test_a_crowded_half_is_linked_in_bounded_time(spark):
    """100,000 fingerprints that share 32 bits: every planted link is found, and no bucket is compared pair by pair."""
    import time

    r = np.random.default_rng(3)
    half = r.choice(1 << 32, 99_000, replace=False).astype(np.uint64)
    near = half[:1000] ^ np.array([sum(1 << int(b) for b in r.choice(32, 3, replace=False)) for _ in range(1000)], np.uint64)
    fps = np.unique(np.r_[half, near] | np.uint64(0x5A5A1234) << np.uint64(32)).view(np.int64)
    began = time.monotonic()
    rows = spark.createDataFrame(pd.DataFrame({"fp": fps})).repartition(4)
    got = {x.node: x.root for x in components.components(simhash.near_links(rows)).collect()}
    assert time.monotonic() - began < 120
    for a, b in zip(half[:1000], near):
        x, y = (int((v | np.uint64(0x5A5A1234) << np.uint64(32)).view(np.int64)) for v in (a, b))
        assert got[x] == got[y]
    assert all(bin((n ^ q) & 0xFFFFFFFF00000000).count("1") == 0 for n, q in got.items())


def test_vectors_match_brute_force(spark):
    g = np.random.default_rng(3)
    centres = g.normal(size=(40, 32))
    rows = [(i, (centres[i % 40] + 0.12 * g.normal(size=32) * (i % 3)).tolist(), i % 5) for i in range(600)]
    rows += [(600 + i, (centres[0] + 0.01 * g.normal(size=32)).tolist(), 0) for i in range(500)] + [(2000 + i, rows[5][1], 1) for i in range(30)]
    odd = [(3000, None, 0), (3001, [], 0), (3002, [0.0] * 32, 0), (3003, [float("nan")] * 32, 0), (3004, [None] + [1.0] * 31, 0), (3005, [float("inf")] + [1.0] * 31, 0), (3006, [1.0, 2.0], 0), (3007, [2.0, 4.0], 0), (None, rows[5][1], 0)]
    df = spark.createDataFrame([(i, v, k, 1) for i, v, k in rows + odd], "vec_id long, embedding array<double>, label int, n long")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in embedding_dedup.near_vectors(df).collect()}
    x = np.array([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    near, u = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool), Union()
    for i, j in zip(*np.nonzero(near)):
        u.link(rows[i][0], rows[j][0])
    found = sum(got[i][0] for i, *_ in rows)
    assert found >= 0.9 * near.sum() and all(got[i][0] <= near[k].sum() for k, (i, *_) in enumerate(rows))
    assert [got[i] for i, *_ in rows] == [(int(near[k].sum()), u.find(i), u.find(i) == i) for k, (i, *_) in enumerate(rows)]
    for i in range(3000, 3006):
        assert got[i] == (0, i, True)
    assert got[3006] == (1, 3006, True) and got[3007] == (1, 3006, False) and got[None] == (0, None, False)
    assert embedding_dedup.near_vectors(df.limit(0)).count() == 0


def test_a_crowd_of_near_copies_costs_no_pairs(spark, monkeypatch):
    """12,000 near copies of one vector, some odd ones among them: counts are exact, and the crowd is not compared with itself."""
    g = np.random.default_rng(2)
    centre = g.normal(size=32)
    x = centre + 0.04 * g.normal(size=(12_000, 32))
    x[::100] = centre + 0.33 * g.normal(size=(120, 32))  # on the edge of a link
    x = np.concatenate([x, g.normal(size=(500, 32))])
    df = embedding_dedup.stored(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(4), "crowd")
    asked, real = [], embedding_dedup.map_arrow

    def watched(rows, run, schema):
        if schema == embedding_dedup.FOUND:
            asked.append(rows.filter("asks = 1").count())
        return real(rows, run, schema)

    monkeypatch.setattr(embedding_dedup, "map_arrow", watched)
    got = {r.vec_id: (r.n_links, r.component_id) for r in embedding_dedup.near_vectors(df).collect()}
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    want = np.concatenate([(x[i : i + 2000] @ x.T >= 0.9).sum(1) - 1 for i in range(0, len(x), 2000)])
    assert [got[i][0] for i in range(len(x))] == want.tolist() and 0 < (want[:12_000:100] > 0).sum()
    assert all(got[i][1] == 1 or got[i][0] == 0 or got[i][1] == 0 for i in range(12_000)) and asked[0] < 40 * len(x)


def test_recall_over_a_thousand_lists(spark):
    """Pairs close to the least cosine, dealt over 1024 lists: at least 0.99 of them are found."""
    g = np.random.default_rng(8)
    x = g.normal(size=(9000, 24)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    u = g.normal(size=x[:3000].shape)
    u -= (u * x[:3000]).sum(1, keepdims=True) * x[:3000]
    cos = g.uniform(0.901, 0.93, (3000, 1))
    y = (cos * x[:3000] + np.sqrt(1 - cos**2) * u / np.linalg.norm(u, axis=1, keepdims=True)).astype(np.float32)
    both = np.concatenate([x, y])
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(both)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r.n_links for r in embedding_dedup.near_vectors(df, lists=1024).collect()}
    z = both.astype(np.float64)
    z /= np.linalg.norm(z, axis=1, keepdims=True)
    want = np.concatenate([(z[i : i + 2000] @ z.T >= 0.9).sum(1) - 1 for i in range(0, len(z), 2000)])
    have = np.array([got[i] for i in range(len(z))])
    assert (have <= want).all() and want.sum() >= 6000 and have.sum() >= 0.99 * want.sum()


def test_shards_are_even_and_match_the_mixture(spark):
    rows = [(i, prose(i % 50, 5), "en", ["hot", "a", "b", None][min(3, i % 10 // 5 + (i % 17 == 0) + (i % 31 == 0))], 0) for i in range(3000)] + [(5, "x", "en", "a", 0)] * 3 + [(None, None, None, None, None)]
    size = {"size": (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long")}
    out = sharding.interleave(documents(spark, rows), 8, "doc_id", "source", size).collect()
    assert Counter(r.doc_id for r in out) == Counter(r[0] for r in rows)
    slots = defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    counts = [len(v) for v in slots.values()]
    assert len(counts) == 8 and max(counts) - min(counts) <= 1 and all(sorted(v) == list(range(len(v))) for v in slots.values())
    source = {r[0]: r[3] for r in rows}
    for s, n in Counter(r[3] for r in rows).items():
        per = Counter(r.shard for r in out if source[r.doc_id] == s)
        assert all(abs(per[k] - n / 8) <= 2 for k in range(8))
    again = {(r.doc_id, r.shard, r.slot) for r in sharding.interleave(documents(spark, rows).repartition(7), 8, "doc_id", "source", size).collect() if r.doc_id != 5}
    assert again == {(r.doc_id, r.shard, r.slot) for r in out if r.doc_id != 5}
    assert sharding.interleave(documents(spark, []), 8, "doc_id", "source", size).count() == 0


def test_sources_of_one_row_spread_over_the_table(spark, monkeypatch):
    """Single-row sources have no common fractional rank: no bucket, and no window, holds many of them."""
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 32)
    rows = [(i, "t" * (50_000 if i == 9 else 1), "en", f"host{i}", 0) for i in range(6000)] + [(10_000 + i, "u", "en", "hot", 0) for i in range(3000)]
    seen, number = [], sharding._number

    def watched(df, keys, bucket, order, name):
        seen.append(df.groupBy(*keys, bucket).count().agg(F.max("count")).first()[0])
        return number(df, keys, bucket, order, name)

    monkeypatch.setattr(sharding, "_number", watched)
    df = documents(spark, rows).withColumn("_b", F.lit(1)).withColumn("_stratum", F.lit("x")).withColumn("_rank", F.lit(2))
    out = sharding.interleave(df, 8, "doc_id", "source", {"size": F.length("text")}).collect()
    assert max(seen) < 100
    per = Counter((r.shard, r.doc_id < 10_000) for r in out)
    assert all(abs(per[k, True] - 750) < 120 and abs(per[k, True] + per[k, False] - 1125) <= 1 for k in range(8))
    assert sorted(r.slot for r in out if r.shard == 3) == list(range(1125))


@pytest.mark.parametrize("url,key", [("http://www.Example.com:80/a?b=1#f", "com,example,www)/a?b=1"), ("https://u:p@x.org", "org,x)/"), (None, ")/"), ("", ")/"), ("x.org?q", "org,x)?q")])
def test_reversed_host_key(url, key):
    assert warc.reversed_host_key(url) == key


def test_pages_come_back_from_archives(spark, monkeypatch):
    monkeypatch.setattr(warc, "BLOCK_LINES", 16)
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 4000)
    rows = [(i, f"http://h{i % 7}.example.org/p{i % 50}", prose(i % 90, 30), 1) for i in range(400)]
    rows += [(400 + i, "http://hot.example.org/", "<p>same</p>", 1) for i in range(120)] + [(600, None, None, 1), (601, "", "", 1), (602, "http://x.org/a\r\nb", "\r\n\r\né\x00", 1), (None, "http://n.org", "<p>none</p>", 1)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, key long")
    got = Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.archive_and_read(df).collect())
    first = {}
    for i, _, h, _ in rows:
        if i is not None:
            first[h or ""] = min(first.get(h or "", i), i)
    want = Counter()
    for i, _, h, _ in rows:
        raw, f = (h or "").encode(), first.get(h or "", i)
        want[(i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if f == i else "revisit", None if f == i else f)] += 1
    assert got == want
    assert warc.archive_and_read(df.limit(0)).count() == 0


def test_pages_with_control_characters_in_the_host_come_back(spark):
    urls = ["a\nb", "http://a\tb.org/x", "http://c\r\nd.org", "e f", "\x00\x7f", "http://u\n@g.org:80/", "http://plain.org/"]
    df = spark.createDataFrame([(i, u, f"<p>{i}</p>") for i, u in enumerate(urls)], "page_id long, url string, html string")
    assert sorted(r.page_id for r in warc.archive_and_read(df).collect()) == list(range(len(urls)))


def test_lookup_reads_payloads_and_misses(spark):
    rows = [(i, f"http://a.org/{i}", prose(i, 9)) for i in range(50)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = warc.new_path(spark, "t")
    lines = warc.stored(warc.write_archives(warc.captures(df), folder), "t")
    blocks, directory = warc.build_index(lines, 50)
    got = warc.lookup(spark.createDataFrame([(3, "http://a.org/3"), (9, "http://a.org/404")], "page_id long, url string"), blocks, directory, folder).collect()
    assert [(r.page_id, bytes(r.payload).decode()) for r in got] == [(3, rows[3][2])]


def test_many_askers_of_one_block_and_stretches_of_one_archive(spark, monkeypatch):
    """A block goes once to the task of its askers; one archive is read by several tasks."""
    rows = [(i, f"http://one.host.org/{i % 97}", prose(i, 12)) for i in range(1500)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    folder = warc.new_path(spark, "t")
    lines = warc.stored(warc.write_archives(warc.captures(df), folder), "t")
    blocks, directory = warc.build_index(lines, 1500)
    assert lines.select("file").distinct().count() == 1 and blocks.count() <= 4
    asked = df.select("page_id", "url")
    got = warc.lookup(asked, blocks, directory, folder, True, 6, 4096)
    assert {(r.page_id, bytes(r.payload).decode()) for r in got.collect()} == {(i, h) for i, _, h in rows}
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan and sum(n > 0 for n in got.rdd.mapPartitions(lambda x: [sum(1 for _ in x)]).collect()) > 3


def plain_score(text, w):
    """Sparse dot product feature by feature, with Python's own integers."""
    m, words = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9), []
    for t in re.findall(r"\w+|[^\w\s]+", text or ""):
        if t[0].isalpha():
            shape = (1 if t.islower() else 2 if len(t) > 1 and t.isupper() else 3) if t.isalpha() else 4
        else:
            shape = 5 if t.isdigit() else 6 if len(t) == 1 else 7
        words.append((zlib.crc32(t.lower().encode()), shape))
    place = lambda g: ((g * m[2]) % 2**64) >> (64 - 18)
    x, n = defaultdict(float, {0: 0.3}), len(words)
    for a, _ in words:
        x[place((a + 1) * m[0] % 2**64)] += 1 / n
    for (a, _), (b, _) in zip(words, words[1:]):
        x[place((a * m[0] % 2**64) ^ ((b + 7) * m[1] % 2**64))] += 1 / (n - 1)
        x[2] += (a == b) / (n - 1)
    triples = list(zip(words, words[1:], words[2:]))
    for a, b, c in triples:
        x[place((a[1] * 64 + b[1] * 8 + c[1] + (1 << 40)) * m[1] % 2**64)] += 1 / len(triples)
    if triples:
        x[1] += 1 - len({tuple(y[0] for y in t) for t in triples}) / len(triples)
    return x, 1 / (1 + math.exp(-sum(w.get(k, 0.0) * v for k, v in x.items())))


def test_classifier_matches_a_plain_one(spark):
    """FTRL over a dict, in the operator's order of rows, and scores as plain sparse dot products."""
    docs = [(i, prose(i, 40) if i % 3 else prose(i, 20).upper() + " !! 12", "en", "s", 0) for i in range(60)] + [(4, "a repeated id", "en", "s", 0), (61, prose(3, 4000), "en", "s", 0)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(62)]
    df = documents(spark, docs)
    w = quality_classifier.train(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    least = {}
    for i, t, *_ in docs:
        least[i] = min(t, least.get(i, t))
    ids = [i for i, _, _ in labels if i in least and zlib.crc32(str(i).encode()) % 5]
    order = [r.id for r in spark.createDataFrame([(i,) for i in ids], "id long").orderBy(F.xxhash64("id"), "id").collect()]
    z, n, weights = defaultdict(float), defaultdict(float), {}
    for _ in range(quality_classifier.EPOCHS):
        for i in order:
            x, p = plain_score(least[i], weights)
            for k, v in x.items():
                g = (p - int(i % 3 > 0)) * v
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / quality_classifier.ALPHA * weights.get(k, 0.0)
                n[k] += g * g
                l1 = quality_classifier.L1
                weights[k] = 0.0 if abs(z[k]) <= l1 else -(z[k] - math.copysign(l1, z[k])) / ((quality_classifier.BETA + math.sqrt(n[k])) / quality_classifier.ALPHA + quality_classifier.L2)
    for r in quality_classifier.score(df, w).collect():
        texts = [t for i, t, *_ in docs if i == r.id]
        assert min(abs(r.score - plain_score(t, weights)[1]) for t in texts) < 1e-4


def test_classifier_learns_held_out_and_ignores_other_columns(spark):
    docs = [(i, prose(i, 60) if i % 3 else prose(i, 30).upper().replace(" ", "!! "), "en", "s", 0) for i in range(400)] + [(900, None, "en", "s", 0), (901, "", "en", "s", 0), (None, prose(1, 50), "en", "s", 0)]
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(400)] + [(5000, 1, 0), (None, 1, 0), (7, None, 0), (8, 9, 0)], "doc_id long, quality int, toxic int")
    df = documents(spark, docs)
    w = quality_classifier.train(df, labels)
    out = {r.id: r.score for r in quality_classifier.score(df, w).collect()}
    held = [i for i in range(400) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert len(held) > 40 and sum((out[i] >= 0.3) == (i % 3 > 0) for i in held) >= 0.97 * len(held)
    assert all(0 <= s <= 1 for s in out.values()) and out[900] == out[901]
    shuffled = documents(spark, [(i, t, "xx", f"o{i}", 9) for i, t, *_ in docs])
    assert out == {r.id: r.score for r in quality_classifier.score(shuffled, quality_classifier.train(shuffled, labels)).collect()}
    assert not quality_classifier.train(df, labels.limit(0)).any()
    assert quality_classifier.score(documents(spark, []), w).count() == 0
