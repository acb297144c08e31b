import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidebook.functions import digest, lines, routing
from tidebook.operators import matching
from tidebook.plans import recovery
from tidebook.schemas import BOOK_CONFIG
from tidebook.sources import config, journal, snapshot

from .test_matching import flow, frame

M = (1 << 64) - 1


def test_hash_partition_and_group(spark):
    r = random.Random(1)
    symbols = [0, 1, 2, 10, (1 << 32) - 1, *[r.randrange(1 << 32) for _ in range(300)]]
    df = spark.createDataFrame([(s,) for s in symbols], "symbol long")
    for p in (1, 2, 7, 1024):
        got = {x.symbol: (x.p, x.g) for x in df.select("symbol", routing.hash_partition(F.col("symbol"), p).alias("p"), routing.group_of(F.col("symbol"), p).alias("g")).collect()}
        for s in symbols:
            z = (s + routing.GOLDEN) & M
            z = ((z ^ z >> 30) * routing.MIX[0]) & M
            z = ((z ^ z >> 27) * routing.MIX[1]) & M
            assert got[s] == (((s * routing.GOLDEN & M) >> 32) * p >> 32, (z ^ z >> 31) % p)


def test_overrides_win_and_are_checked(spark):
    df = spark.createDataFrame([(1,), (2,)], "symbol long")
    t = spark.createDataFrame([(2, 3)], "symbol long, partition long")
    assert {r.symbol: r.partition for r in routing.with_partition(df, 4, t).collect()}[2] == 3
    bad = spark.createDataFrame([(1, 1), (1, 2), (3, 9)], "symbol long, partition long")
    assert sorted(map(tuple, routing.table_problems(bad, 4).collect())) == [(1, "twice"), (3, "range")]


def test_ids(spark):
    r = spark.range(1).select(routing.order_id(F.lit(5).cast("long"), F.lit(9)).alias("o"), routing.order_id(F.lit(0x8001).cast("long"), F.lit(1)).alias("s")).select("o", routing.shard_of_order(F.col("o")).alias("a"), routing.shard_of_order(F.col("s")).alias("b"), routing.is_slice_order(F.col("s")).alias("c"))
    assert tuple(r.first()) == (5 << 48 | 9, 5, 0x8001, True)


def test_crc32c_check_value():
    assert journal.crc32c(np.frombuffer(b"123456789", np.uint8)[None, :])[0] == 0xE3069283


def written(spark, tmp_path, binary, n=400, parts=2):
    c = frame(spark, flow(3, n, 6))
    e = routing.with_partition(matching.match(c), parts)
    d = str(tmp_path / ("bin" if binary else "jsonl"))
    cols = [] if binary else [lines.command_line(True, True).alias("line")]
    journal.write(routing.with_partition(c, parts).select("*", *cols), d, "cmd", parts, binary=binary).collect()
    journal.write(e.select("*", *([] if binary else [lines.event_line().alias("line")])), d, "evt", parts, binary=binary).collect()
    return c, e, d


@pytest.mark.parametrize("binary", [False, True])
def test_journal_round_trip(spark, tmp_path, binary):
    c, e, d = written(spark, tmp_path, binary)
    rows = journal.read(spark, d)
    assert journal.problems(rows).count() == 0
    assert sorted(map(tuple, journal.commands(rows).collect())) == sorted(map(tuple, c.select("iseq", "symbol", "cmd", "order_id", "side", "otype", "price", "qty", "tif").collect()))
    cols = ["symbol", "seq", "ev", "order_id", "maker", "taker", "price", "qty", "leaves_qty", "reason"]
    assert sorted(map(repr, rows.filter("kind = 'evt' and place >= 0").select(*cols).collect())) == sorted(map(repr, e.select(*cols).collect()))
    state = recovery.recover(spark, d)
    assert sorted(map(tuple, matching.events_of(state).collect()), key=lambda x: x[:3]) == sorted(map(tuple, matching.match(c).collect()), key=lambda x: x[:3])


@pytest.mark.parametrize("binary", [False, True])
def test_torn_ends_are_refused_or_repaired(spark, tmp_path, binary):
    c, _, d = written(spark, tmp_path, binary, 120)
    f = tmp_path / ("bin/cmd-0.bin" if binary else "jsonl/cmd-0.journal")
    whole = f.read_bytes()
    f.write_bytes(whole + (b"\0" * 100 if binary else b'{"cmd":"canc'))
    assert journal.problems(journal.read(spark, d)).count() > 0
    with pytest.raises(recovery.Corrupt):
        recovery.recover(spark, d)
    rows = journal.read(spark, d, "repair")
    assert journal.problems(rows, "repair").count() == 0 and journal.commands(rows).count() == 120
    f.write_bytes(whole[:-9])
    assert journal.commands(journal.read(spark, d, "repair")).count() == 119


def test_damage_before_the_last_segment_stays_an_error(spark, tmp_path):
    _, _, d = written(spark, tmp_path, False, 60)
    f = tmp_path / "jsonl/cmd-0.journal"
    head, *rest = f.read_text().splitlines()
    f.write_text("\n".join([head, *rest[:5]]) + '\n{"cmd":')
    (tmp_path / "jsonl/cmd-0.50.journal").write_text("\n".join([head, *rest[5:]]) + "\n")
    assert [r.problem for r in journal.problems(journal.read(spark, d, "repair"), "repair").collect()] == ["damage before the last segment"]


def test_binary_middle_damage_and_version_one(spark):
    rows = [{"iseq": i, "symbol": 1, "cmd": "cancel", "order_id": i} for i in range(1, 6)]
    cfg = {"pmin": 0, "pmax": 9, "max_orders": 5, "index": "tree"}
    data = bytearray(journal.encode("cmd", rows, 0, 1, cfg))
    data[64 + 48 + 16] ^= 1
    assert journal.decode("cmd-0.bin", bytes(data), True)[2] == "checksum of record 1"
    head, got, problem, _ = journal.decode("cmd-0.bin", journal.encode("cmd", rows, 0, 1, cfg, 1), False)
    assert problem is None and [r["order_id"] for r in got] == [1, 2, 3, 4, 5] and head["index"] == "tree"


@pytest.mark.parametrize("name", ["cmd-0.bin", "cmd-0.journal"])
def test_a_journal_is_read_a_part_at_a_time(monkeypatch, name):
    import pyarrow as pa

    monkeypatch.setattr(journal, "PART", 600)
    rows = [{"iseq": i, "symbol": 1, "cmd": "cancel", "order_id": i} for i in range(1, 301)]
    line = lambda i: b'{"cmd":"cancel","symbol":1,"order_id":%d,"iseq":%d}\n' % (i, i)
    data = journal.encode("cmd", rows, 0, 1, BOOK_CONFIG) if name.endswith("bin") else (journal.header_line("cmd", 0, 1) + "\n").encode() + b"".join(line(i) for i in range(1, 301))
    r = journal.Reading(name, pa.BufferReader(data), False)
    some = r.rows()
    assert next(some)["order_id"] == 1 and r.file.tell() <= 1200 < len(data)
    assert [x["order_id"] for x in some] == list(range(2, 301)) and r.problem is None and r.header["partition"] == 0
    # torn, then zeros over more than a part: all of it is cut, and nothing but it
    for tail in (b"{" * 1500,) if name.endswith("journal") else (b"\0" * 1500, b"\0" * 1499):
        _, got, problem, cut = journal.decode(name, data + tail, True)
        assert problem is None and len(got) == 300 and cut == len(tail)


def test_snapshot_round_trip_and_validation(spark, tmp_path):
    c = frame(spark, flow(9, 500))
    s = matching.match_with_state(c)
    text = [r.line for r in lines.snapshot_lines(matching.books_of(s), matching.resting_of(s)).orderBy("n1", "n2", "n3").collect()]
    f = tmp_path / "a.snap"
    f.write_text("\n".join(text) + "\n")
    p = snapshot.parse(snapshot.lines(spark, str(f)))
    assert snapshot.problems(p).count() == 0
    assert [r.line for r in lines.snapshot_lines(snapshot.books(p), snapshot.orders(p)).orderBy("n1", "n2", "n3").collect()] == text
    o = '{"rec":"order","order_id":%d,"side":"%s","otype":"limit","tif":"gtc","price":%d,"qty":%d}'
    b = '{"rec":"book","symbol":%d,"seq":1}'
    f.write_text("\n".join(["{}", o % (1, "bid", 5, 1), b % 1, o % (2, "bid", 9, 1), o % (2, "ask", 8, 0), o % (3, "ask", -5, 1), b % 1]) + "\n")
    assert {r.problem for r in snapshot.problems(snapshot.parse(snapshot.lines(spark, str(f)))).collect()} == {"order before book", "book twice", "id twice", "no quantity", "price", "crossed"}
    assert snapshot.meta(None) == (0, 1) and snapshot.meta('{"format":"x","iseq":7,"partitions":2}') == (7, 2)


def test_checkpoint_and_resume(spark, tmp_path):
    c = frame(spark, flow(4, 300))
    recovery.checkpoint(spark, c, 150, str(tmp_path))
    tail = matching.events_of(recovery.resume_from(spark, c, 150, str(tmp_path)))
    want = matching.match(c).filter("iseq > 150")
    assert sorted(map(repr, tail.collect())) == sorted(map(repr, want.collect()))


def test_event_chain(spark):
    c = frame(spark, flow(2, 300))
    e = routing.with_partition(matching.match(c), 3)
    got = {r.partition: r.chain for r in digest.event_chains(e.repartition(6)).collect()}
    by = {}
    for r in sorted(e.collect(), key=lambda r: (r.iseq, r.ordinal)):
        h = by.get(r.partition, 0)
        for w in digest.event_words(r.asDict()):
            h = ((h ^ (w & M)) * 0x9E3779B97F4A7C15) & M
            h = (h << 31 | h >> 33) & M
        by[r.partition] = h
    assert got == {k: f"{v:016x}" for k, v in by.items()}
    one, two = digest.state_digest(e).first(), digest.state_digest(e.repartition(5)).first()
    assert one == two and one.lane0 != digest.state_digest(e.filter("seq > 1")).first().lane0


def test_config():
    text = "ledger_shards = 2 # two\nmatching_groups=1\npartitions = 4\nfee_ppm = 500\nsymbol = 11 base=3 quote=2 lot=10 maker_ppm=1 taker_ppm=2\nsymbol = 10 base=1 quote=2 lot=1000\n"
    c = config.parse(text)
    assert config.canonical(c).splitlines()[-2] == "symbol=10 base=1 quote=2 lot=1000"
    assert config.checksum(c) == config.checksum(config.parse(config.canonical(c).replace("exchange-config/1\n", "")))
    for bad in ("ledger_shards = x", "fee_ppm = 1\nfee_ppm = 2", "what = 1", "plain", "credit_group = 1, 1", "symbol = 1 base=1"):
        with pytest.raises(config.ConfigError):
            config.parse(bad)
