"""Slices and the lending policy, digests, byte codecs, checkpoints, numbering: against plain Python."""

import hashlib
import random
import struct
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidebook.functions import digest, routing
from tidebook.functions.numbering import number, running, running_sum
from tidebook.functions.tables import released, shared_dir, stored
from tidebook.operators import ledger, matching, ordering, slices
from tidebook.operators.ledger import Ledger
from tidebook.plans import recovery, scripts
from tidebook.plans.ledger_queries import DEFAULT_PPM, SYMBOLS, cmds
from tidebook.schemas import COMMANDS
from tidebook.sources import journal, ledger_codec
from tidebook.streaming.checkpoints import checkpoint_every

from .test_matching import flow, frame


def plain_plan(group, wanted, facts, policy, seen, now, idle, most):
    """The policy demand by demand, for one group."""
    acts, given = [], Counter()
    lent = {k: v["lent"] for k, v in facts.items() if v["lent"]}
    total = Counter()
    for (_, s), v in lent.items():
        total[s] += v
    for key in dict.fromkeys(wanted):
        rule, f = policy.get(key[1]), facts.get(key, {"free": 0, "lent": 0, "credit": None})
        if rule is None or len(acts) == most:
            continue
        if f["lent"] and (f["credit"] is None or f["credit"] >= rule["chunk"] // 100 * rule["low"] + rule["chunk"] % 100 * rule["low"] // 100):
            continue
        bounds = [rule["chunk"], f["free"]]
        if rule["cap"] is not None:
            bounds.append(max(0, rule["cap"] - f["lent"]))
        if rule["all"] is not None:
            bounds.append(max(0, rule["all"] - total[key[1]] - given[key[1]]))
        if min(bounds) > 0:
            given[key[1]] += min(bounds)
            acts.append(("lend", *key, min(bounds)))
    memory, lenders = {}, {a[1:3] for a in acts}
    for key in sorted(lent):
        credit = facts[key]["credit"]
        if credit is None:
            if key in seen:
                memory[key] = seen[key]
            continue
        old = seen.get(key)
        if old is None or old[:2] != (lent[key], credit):
            memory[key] = (lent[key], credit, now, None)
            continue
        memory[key] = old
        quiet = idle and credit and now - old[2] >= idle and (old[3] is None or now - old[3] >= idle)
        if quiet and len(acts) < most and key not in lenders:
            memory[key] = (*old[:3], now)
            acts.append(("recall", *key, credit))
    return acts, memory


def test_policy_equals_one_demand_after_another(spark):
    r = random.Random(4)
    wanted, facts, policy, seen, want = [], [], [], [], {}
    for g in range(12):
        rules = {s: {"chunk": r.randrange(1, 300), "low": r.choice([0, 20, 50]), "cap": r.choice([None, 100, 400]), "all": r.choice([None, 500, 1500])} for s in (1, 2)}
        have = {(a, s): {"free": r.randrange(400), "lent": r.choice([0, 50, 200]), "credit": r.choice([None, 0, 40, 200])} for a in range(8) for s in (1, 2, 3) if r.random() < 0.8}
        asks = [(r.randrange(9), r.randrange(1, 4)) for _ in range(r.randrange(25))]
        known = {k: (f["lent"], r.choice([f["credit"] or 0, 7]), r.choice([0, 60, 95]), r.choice([None, 10, 97])) for k, f in have.items() if f["lent"] and r.random() < 0.7}
        want[g] = plain_plan(g, asks, have, rules, known, 100, 50, 6)
        wanted += [(g, i, *k) for i, k in enumerate(asks)]
        facts += [(g, *k, f["free"], f["lent"], f["credit"]) for k, f in have.items()]
        policy += [(g, s, x["chunk"], x["low"], x["cap"], x["all"]) for s, x in rules.items()]
        seen += [(g, *k, *v) for k, v in known.items()]
    acts, memory = slices.plan_credit(
        spark.createDataFrame(wanted, "grp long, place long, account long, asset long"), spark.createDataFrame(facts, "grp long, account long, asset long, free long, lent long, credit long"),
        spark.createDataFrame(policy, "grp long, asset long, chunk long, low_water_pct long, account_cap long, group_cap long"), spark.createDataFrame(seen, slices.SEEN), 100, 50, 6,
    )
    got = {g: [] for g in want}
    for x in acts.orderBy("grp", "turn").collect():
        got[x.grp].append((x.cmd, x.account, x.asset, x.amount))
    kept = {g: {} for g in want}
    for x in memory.collect():
        kept[x.grp][x.account, x.asset] = (x.lent, x.credit, x.since, x.recalled)
    assert got == {g: w[0] for g, w in want.items()} and kept == {g: w[1] for g, w in want.items()}
    assert sum(a[0] == "recall" for w in want.values() for a in w[0]) > 3 and sum(a[0] == "lend" for w in want.values() for a in w[0]) > 20


def mixed(z):
    m = (1 << 64) - 1
    z = (z + 0x9E3779B97F4A7C15) & m
    z = ((z ^ z >> 30) * 0xBF58476D1CE4E5B9) & m
    z = ((z ^ z >> 27) * 0x94D049BB133111EB) & m
    return z ^ z >> 31


def plain_lane(tag, words):
    m, turn = (1 << 64) - 1, lambda z, n: (z << n | z >> 64 - n) & (1 << 64) - 1
    a, b = mixed(tag ^ 0x243F6A8885A308D3), mixed(tag ^ 0x13198A2E03707344)
    for w in words:
        a = (mixed(a ^ w & m) + turn(a, 17)) & m
        b = mixed(turn((b + w) & m, 13) ^ a)
    return mixed(a ^ turn(b, 7)), mixed(b ^ turn(a, 41))


def script(spark, sql, n=40, fold=None):
    """Commands of the first events of a script, as a DataFrame without a table."""
    events = spark.range(n).selectExpr("id as event_id")
    return spark.sql(sql.replace("FROM events", "FROM {events} AS events"), events=events)


def test_ledger_digest_equals_a_plain_one(spark):
    c = cmds(script(spark, scripts.LEDGER_COMMANDS))
    state = ledger.run_ledger(c.filter("lsn < 3924"), SYMBOLS, DEFAULT_PPM).cache()  # a script is left in its middle
    got = {r.shard: r.digest for r in digest.ledger_digest(state, "t/1").collect()}
    halves, still_open = lambda v: (v & (1 << 64) - 1, v >> 64), 0
    for s in range(3):
        led = Ledger(s, SYMBOLS, DEFAULT_PPM)
        for r in c.filter(f"shard = {s} and lsn < 3924").orderBy("lsn").collect():
            led.apply(r.asDict() | {"amount": None if r.amount is None else int(r.amount)})
        cells = {
            "balances": [(1, [a, x, *halves(led.free[a, x]), *halves(led.held[a, x])]) for a, x in {*led.free, *led.held}],
            "orders": [(2, [i, o["account"], o["symbol"], o["side"] == "sell", o["price"], o["remaining"], *halves(o["held"]), o["cancelling"], o["born"], o["cancel_at"]]) for i, o in led.orders.items()],
            "lent": [(3, [a, x, *halves(v)]) for (a, x), v in {k[:2]: led.lent_of(*k[:2]) for k in led.lent}.items()],
            "lent_by_group": [(5, [a, x, g, *halves(v)]) for (a, x, g), v in led.lent.items()],
            "pending": [(4, [i, a, x, *halves(v)]) for i, (a, x, v) in led.pending.items()],
            "outbox": [],
            "deposit_ids": [(100, [i]) for i in led.ids["deposit"]], "withdraw_ids": [(101, [i]) for i in led.ids["withdraw"]], "adjust_ids": [(102, [i]) for i in led.ids["adjust"]],
        }
        for k, msg in enumerate(led.outbox):
            code = {"submit": 1, "submit_ioc": 6, "cancel": 2, "grant": 3, "recall": 4}[msg["kind"]]
            more = [msg["group"], msg["account"], msg["asset"], *halves(msg["amount"])] if code in (3, 4) else [msg["order"], msg["symbol"]] + ([msg["side"] == "sell", msg["price"], msg["qty"]] if code != 2 else [])
            cells["outbox"].append((5, [led.outbox_base + k, code, *more]))
        lanes = [[sum(x) % (1 << 64) for x in zip(*[plain_lane(t, map(int, w)) for t, w in v])] if v else [0, 0] for v in cells.values()]
        out = b"t/1" + struct.pack("<HQQQQI", s, led.next_order, led.outbox_base, led.anomalies, led.clock, len(led.marks)) + b"".join(struct.pack("<IQ", *m) for m in sorted(led.marks.items()))
        for name in ("fees", "deposited", "withdrawn", "settled_in", "settled_out", "adjusted_in", "adjusted_out", "lent_granted", "lent_returned", "slice_in", "slice_out"):
            per = sorted((k[1], v) for k, v in led.flow.items() if k[0] == name)
            out += struct.pack("<I", len(per)) + b"".join(struct.pack("<IQQ", a, *halves(v)) for a, v in per)
        pairs = sorted({k[1:] for k in led.group_flow})
        out += struct.pack("<I", len(pairs))
        for p in pairs:
            out += struct.pack("<IH", *p) + b"".join(struct.pack("<QQ", *halves(led.group_flow[n, *p])) for n in ("granted", "returned", "slice_in", "slice_out"))
        out += struct.pack("<I", len(led.adjustments)) + b"".join(struct.pack("<QQIBQQI", i, a, x, credit, *halves(v), why) for i, a, x, credit, v, why in led.adjustments)
        out += b"".join(struct.pack("<QQ", *x) for x in lanes) + b"".join(struct.pack("<Q", len(v)) for v in cells.values())
        assert got[s] == hashlib.sha256(out).hexdigest() and led.outbox and led.adjustments
        still_open += len(led.orders)
    assert still_open
    other = state.withColumn("amount", F.when((F.col("rec") == "balance") & (F.col("account") == 7), F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(38,0)"))
    assert {r.shard: r.digest for r in digest.ledger_digest(other, "t/1").collect()} != got
    assert {r.shard: r.digest for r in digest.ledger_digest(state.repartition(5), "t/1").collect()} == got


def test_a_resumed_ledger_is_the_same_and_a_broken_state_is_refused(spark):
    c = cmds(script(spark, scripts.LEDGER_COMMANDS, 12))
    whole = ledger.run_ledger(c, SYMBOLS, DEFAULT_PPM)
    half = ledger.run_ledger(c.filter("lsn < 624"), SYMBOLS, DEFAULT_PPM).cache()
    late = ledger.resume_ledger(half, c.filter("lsn >= 624"), SYMBOLS, DEFAULT_PPM)
    text = lambda df: sorted(map(repr, df.filter("rec <> 'outcome' or lsn >= 624").collect()))
    assert text(late) == text(whole)
    broken = half.withColumn("amount", F.when(F.col("rec") == "balance", F.col("amount") + 1).otherwise(F.col("amount")).cast("decimal(38,0)"))
    with pytest.raises(Exception, match="conservation"):
        ledger.resume_ledger(broken, c.filter("lsn >= 624"), SYMBOLS, DEFAULT_PPM).count()
    with pytest.raises(Exception, match="assets of 10"):
        ledger.run_ledger(c, {10: {"base": 1, "quote": 1, "lot": 5}}).count()


def test_commands_survive_their_bytes():
    r = random.Random(8)
    for _ in range(400):
        name, fields = r.choice(list(ledger_codec.COMMANDS.values()))
        event, more = r.choice(list(ledger_codec.EVENTS.values()))
        row = {"cmd": name} | ({"event": event} if name == "settle" else {}) | ({"ts_ns": r.randrange(1 << 63)} if r.random() < 0.3 else {})
        for f in (fields + " " + (more if name == "settle" else "")).split():
            field, kind = f.split(":")
            row[field] = {"S": r.choice(["buy", "sell"]), "B": r.random() < 0.5, "A": r.randrange(1 << 100), "Q": r.randrange(-(1 << 63), 1 << 63), "I": r.randrange(1 << 32), "H": r.randrange(1 << 16)}[kind]
        data = ledger_codec.encode(row)
        assert ledger_codec.decode(data) == row
        for bad in (data + b"\0", data[:-1], b"", b"\x63" + data[1:]):
            with pytest.raises(ledger_codec.Undecodable):
                ledger_codec.decode(bad)
    assert ledger_codec.encode({"cmd": "cancel", "account": 2, "order_id": 3}) == b"\3" + struct.pack("<QQ", 2, 3)
    for bad in ({"cmd": "dance"}, {"cmd": "clock", "now_ns": None}, {"cmd": "lend", "grp": 70000, "account": 1, "asset": 1, "amount": 1}, {"cmd": "settle", "source": 1, "prev": 0, "idx": 1, "event": "x"}):
        with pytest.raises(ledger_codec.Undecodable):
            ledger_codec.encode(bad)


# Commands on four symbols and the chains that their events must give, by number of partitions.
GOLDEN = """
new 10 1 bid limit 100 10 gtc
new 20 1 bid limit 100 10 gtc
new 10 2 ask limit 100 4 gtc
cancel 20 2
new 30 1 bid limit 90 5 gtc
new 30 7 ask limit 50 3 gtc
new 20 3 ask limit 100 6 gtc
new 30 8 bid market 0 3 ioc
replace 10 2 105 7
new 10 2 ask limit 105 7 gtc
replace 20 1 99 4
new 20 4 ask limit 99 4 ioc
cancel 30 1
cancel 30 1
new 40 1 bid limit 5 1 post_only
"""
CHAINS = {
    1: ["1b894d531e2b57da"],
    2: ["52fe56efaff6d7ce", "5c6f46ac06d3928f"],
    4: ["b2dc6eb29a360fdd", "1ad28038527df2ef", "5c6f46ac06d3928f", "0000000000000000"],
}


@pytest.mark.parametrize("index", ["ladder", "tree"])
def test_golden_chains(spark, index):
    rows = []
    for i, line in enumerate(GOLDEN.split("\n")[1:-1], 1):
        cmd, symbol, oid, *rest = line.split()
        side, otype, price, qty, tif = rest if cmd == "new" else (None, None, *(rest or (None, None)), None)
        rows.append((i, int(symbol), cmd, int(oid), side, otype, price and int(price), qty and int(qty), tif))
    events = matching.match(spark.createDataFrame(rows, COMMANDS), {"index": index})
    for parts, want in CHAINS.items():
        got = {r.partition: r.chain for r in digest.event_chains(routing.with_partition(events, parts)).collect()}
        assert [got.get(p, f"{0:016x}") for p in range(parts)] == want


def test_tier_digest_depends_on_every_part():
    base = ("t", "00" * 32, 2, {0: 5, 1: 6}, [7, 8], 9)
    variants = [("u", *base[1:]), ("t", "01" + "00" * 31, *base[2:]), (*base[:2], 3, *base[3:]), (*base[:3], {0: 5, 1: 7}, *base[4:]), (*base[:4], [7, 9], 9), (*base[:5], 1)]
    assert len({digest.tier_digest(*v) for v in [base, *variants]}) == 7
    want = hashlib.sha256(b"t" + bytes(32) + struct.pack("<IIHQHQQQQ", 2, 2, 0, 5, 1, 6, 7, 8, 9)).hexdigest()
    assert digest.tier_digest(*base) == want


def test_checkpoints_rotate_segments_and_drop_older_ones(spark, tmp_path):
    c, folder, journals = frame(spark, flow(5, 200)), f"file://{tmp_path}/ck", f"file://{tmp_path}/j"
    from tidebook.functions import lines

    parts = routing.with_partition(c, 2)
    tagged = lambda df: df.withColumn("line", lines.command_line(True, True))
    journal.write(tagged(parts.filter("iseq <= 120")), journals, "cmd", 2).collect()
    recovery.checkpoint(spark, c, 60, folder)
    assert recovery.latest(spark, folder) == 60
    recovery.checkpoint(spark, c.filter("iseq > 60"), 120, folder, None, journals, 2)
    names = sorted(p.name for p in (tmp_path / "j").iterdir() if not p.name.startswith("."))
    assert names == ["cmd-0.120.journal", "cmd-1.120.journal", "evt-0.120.journal", "evt-1.120.journal"]
    assert [p.name for p in (tmp_path / "ck").iterdir()] == ["checkpoint-120"] and recovery.latest(spark, folder) == 120
    journal.write(tagged(parts.filter("iseq > 120")), journals, "cmd", 2, start=120).collect()
    tail = journal.commands(journal.read(spark, journals), 120)
    got = matching.events_of(recovery.resume_from(spark, tail, recovery.latest(spark, folder), folder))
    assert sorted(map(tuple, got.collect()), key=lambda x: x[:3]) == sorted(map(tuple, matching.match(c).filter("iseq > 120").collect()), key=lambda x: x[:3])
    (tmp_path / "ck" / "checkpoint-500").mkdir()  # never completed
    assert recovery.latest(spark, folder) == 120
    recovery.checkpoint(spark, c, 100, folder)  # behind: nothing happens
    assert recovery.latest(spark, folder) == 120


def test_periodic_checkpoints_of_a_stream(spark, tmp_path):
    c, src, folder = frame(spark, flow(6, 150)), str(tmp_path / "in"), f"file://{tmp_path}/ck"
    for lo, hi in ((0, 70), (50, 110), (110, 150)):
        c.filter(f"iseq > {lo} and iseq <= {hi}").coalesce(1).write.mode("append").parquet(src)
    stream = spark.readStream.schema(COMMANDS).option("maxFilesPerTrigger", 1).parquet(src)
    checkpoint_every(stream, folder, str(tmp_path / "progress")).awaitTermination()
    assert recovery.latest(spark, folder) == 150 and [p.name for p in (tmp_path / "ck").iterdir()] == ["checkpoint-150"]
    got = spark.read.parquet(f"{folder}/checkpoint-150")
    want = matching.match_with_state(c)
    assert sorted(map(tuple, matching.resting_of(got).collect())) == sorted(map(tuple, matching.resting_of(want).collect()))
    assert sorted(map(tuple, matching.books_of(got).collect())) == sorted(map(tuple, matching.books_of(want).collect()))


def test_running_sums_and_numbers_with_a_hot_key(spark):
    r = random.Random(3)
    rows = [(None if i % 50 == 0 else "hot" if i % 3 else f"k{i % 7}", i, r.randrange(-5, 9)) for i in range(4000)]
    df = spark.createDataFrame(r.sample(rows, len(rows)), "k string, i long, v long").repartition(6)
    want, at = {}, Counter()
    for k, i, v in rows:
        at[k] += v
        at["n", k] += 1
        want[i] = (at[k], at["n", k])
    got = {x.i: (x.s, x.n) for x in number(running_sum(df, ["k"], ["i"], "v", "s"), ["k"], ["i"], "n").collect()}
    assert got == want
    assert [x.n for x in number(df, [], ["i"], "n").orderBy("i").collect()] == list(range(1, 4001))
    assert number(df.limit(0), ["k"], ["i"], "n").count() == 0
    top, most = {}, {}
    for k, i, v in rows:
        most[i] = (top.get(k), max(v, top.get(k, v)))
        top[k] = most[i][1]
    got = {x.i: (x.b, x.m) for x in running(running(df, ["k"], ["i"], "v", "b", "max", True), ["k"], ["i"], "v", "m", "max").collect()}
    assert got == most


def test_percentiles_of_many_distinct_values_by_key(spark):
    r = random.Random(5)
    rows = [(i % 3, r.choice([r.randrange(10**12), r.randrange(-50, 50)])) for i in range(3000)]
    df = spark.createDataFrame([*rows, (9, 4), (10, None)], "k long, v long")
    got = {(x.k, x.share): x.value for x in ordering.percentiles(df, "v", ["0.5", "0.999", "1"], "nearest", "k", 16).collect()}
    for k in range(3):
        s = sorted(v for q, v in rows if q == k)
        assert [got[k, p] for p in ("0.5", "0.999", "1")] == [s[-(-len(s) * m // 1000) - 1] for m in (500, 999, 1000)]
    assert got[9, "0.5"] == 4 and not any(k[0] == 10 for k in got)


def test_replayed_sessions_forget_the_oldest(spark):
    asks = [(0, 1, "a"), (1, 2, "b"), (0, 1, "c"), (0, 0, "d"), (2, 1, "e"), (0, 1, "f"), (1, 2, "g")]
    df = spark.createDataFrame([(7, i, c, s, i) for i, (c, s, _) in enumerate(asks)], "node long, idx long, client long, seq long, result long")
    assert [(x.reply, x.result) for x in ordering.sessions(df, 2).orderBy("idx").collect()] == [("applied", 0), ("applied", 1), ("repeat", 0), ("stale", None), ("applied", 4), ("applied", 5), ("applied", 6)]


def test_books_pass_over_what_they_cannot_decode(spark):
    good = (1, 1, "new", 1, "bid", "limit", 5, 2, "gtc")
    rows = [good, *[(k, 1, *x) for k, x in enumerate([
        ("emit", 2, "bid", "limit", 5, 2, "gtc"), (None, 2, "bid", "limit", 5, 2, "gtc"), ("new", None, "bid", "limit", 5, 2, "gtc"), ("new", 2, None, "limit", 5, 2, "gtc"), ("new", 2, "bid", "limit", None, 2, "gtc"),
        ("new", 2, "bid", "limit", 5, None, "gtc"), ("new", 2, "bid", "limit", 5, 2, "gtx"), ("replace", 1, None, None, None, 2, None), ("cancel", None, None, None, None, None, None), ("cross", 1, None, None, None, None, None),
    ], 2)]]
    df = spark.createDataFrame(rows, COMMANDS)
    assert [(x.iseq, x.ev) for x in matching.match(df).collect()] == [(1, "accepted")]
    assert sorted(x.iseq for x in matching.undecodable(df).collect()) == list(range(2, 12))
    led = Ledger(0, SYMBOLS)
    for c in ({"cmd": "deposit", "account": 1, "asset": 2, "amount": None, "external_id": 1}, {"cmd": "violations"}, {"cmd": None}, {"cmd": "reserve", "account": 1, "symbol": 10, "side": "up", "price": 1, "qty": 1}, {"cmd": "settle", "source": 0, "prev": 0, "idx": 1, "event": "take_in"}):
        assert led.apply(c) == ("anomaly", None, {})
    assert led.anomalies == 5 and not led.marks


def test_intermediate_tables_need_a_shared_folder_on_a_cluster():
    class Conf:
        def get(self, *a):
            return None

    class Context:
        def __init__(self, master):
            self.master = master

        def getCheckpointDir(self):
            return None

    class Session:
        conf = Conf()

        def __init__(self, master):
            self.sparkContext = Context(master)

    assert shared_dir(Session("local[4]")) and shared_dir(Session("local"))
    for master in ("local-cluster[2,1,1024]", "spark://host:7077", "yarn", "k8s://host"):
        with pytest.raises(RuntimeError):
            shared_dir(Session(master))


def test_tables_are_released_but_for_the_last(spark):
    with released(spark):
        a = stored(spark.range(5), "a")
        b = stored(a.selectExpr("id + 1 as id"), "b")
    paths = [p.split("/part-")[0].removeprefix("file:").replace("///", "/") for p in (*a.inputFiles(), *b.inputFiles())]
    import os

    assert b.count() == 5 and not os.path.exists(paths[0]) and os.path.exists(paths[-1])


def test_event_store_reports_gaps_and_adds_nothing_twice(spark, tmp_path):
    from tidebook.sources import event_store

    folder = f"file://{tmp_path}/store"
    rows = lambda *r: spark.createDataFrame(list(r), "source long, idx long, event string")
    assert event_store.read(spark, folder) is None and event_store.window(spark, folder) is None and event_store.retain(spark, folder, 5) == []
    assert event_store.append(spark, folder, rows((1, 1, "a"), (1, 2, "b"), (1, 2, "b"), (2, 1, "x")), 4).count() == 0
    gaps = event_store.append(spark, folder, rows((1, 2, "b"), (1, 3, "c"), (2, 3, "z"), (3, 2, "late")), 4)
    assert sorted(map(tuple, gaps.collect())) == [(2, 3, 2), (3, 2, 1)]
    assert [(r.idx, r.event) for r in event_store.stream(spark, folder, 1, 2, 10).collect()] == [(2, "b"), (3, "c")]
    event_store.append(spark, folder, rows(*[(1, i, str(i)) for i in range(4, 20)]), 4)
    assert event_store.retain(spark, folder, 5, 4) == ["source=1/segment=0", "source=1/segment=1", "source=1/segment=2"]
    assert sorted(map(tuple, event_store.window(spark, folder).collect())) == [(1, 12, 20), (2, 1, 2)]


def test_a_segment_of_the_event_store_is_one_file(spark, tmp_path):
    from tidebook.sources import event_store

    folder, one = f"file://{tmp_path}/store", "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(one, "false")  # tables of more than one partition stay so
    try:
        event_store.append(spark, folder, spark.range(400).selectExpr("id % 2 as source", "1 + id div 2 as idx"), 50)
    finally:
        spark.conf.unset(one)
    files = [str(f.parent.relative_to(tmp_path / "store")) for f in (tmp_path / "store").glob("*/*/part-*.parquet")]
    assert sorted(files) == sorted(f"source={s}/segment={k}" for s in (0, 1) for k in range(5))


def test_the_credit_loop_counts_grants_on_their_way(spark):
    """A grant that a group has not taken in yet is its credit: the pair is not lent to again."""
    long = lambda rows, ddl: spark.createDataFrame(rows, ddl)
    c = [{"cmd": "deposit", "account": a, "asset": 2, "amount": 1000, "external_id": a} for a in (1, 2)] + [{"cmd": "lend", "grp": 1, "account": 1, "asset": 2, "amount": 400}]
    fields = ["cmd", "account", "asset", "amount", "external_id", "grp"]
    state = ledger.run_ledger(cmds(long([(0, i, *[x.get(f) for f in fields]) for i, x in enumerate(c)], "shard long, lsn long, cmd string, account long, asset long, amount long, external_id long, grp long")), SYMBOLS).cache()
    rows = slices.run_slices(long([(1, 0, "status")], "grp long, idx long, cmd string").selectExpr(*[f"{n} as {n}" if n in ("grp", "idx", "cmd") else f"cast(null as {t}) as {n}" for n, t in (x.split(" ", 1) for x in slices.ENTRIES.split(", "))]), SYMBOLS)
    wanted, policy = long([(1, 0, 1, 2), (1, 1, 2, 2)], "grp long, place long, account long, asset long"), long([(1, 2, 300, 50, None, None)], "grp long, asset long, chunk long, low_water_pct long, account_cap long, group_cap long")
    seen = long([], slices.SEEN)
    plan = lambda cursor: sorted((x.cmd, x.account, x.amount) for x in slices.drive(rows, state, long([(1, 0, cursor)], "grp long, shard long, cursor long"), wanted, policy, seen, 5, 10, 9)[0].collect())
    assert plan(0) == [("lend", 2, 300)]  # 400 are on their way to account 1
    assert plan(1) == [("lend", 1, 300), ("lend", 2, 300)]  # taken in, and nothing of them is left
