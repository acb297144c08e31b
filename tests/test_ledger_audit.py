import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tidebook.functions import money
from tidebook.operators import audit, flow, ledger, ordering, replication, slices
from tidebook.operators.ledger import FEE_ACCOUNT, MOST, Ledger
from tidebook.plans.ledger_queries import DEFAULT_PPM, SYMBOLS, cmds, symbols_table

SYM = SYMBOLS


def dep(account, asset, amount, i):
    return {"cmd": "deposit", "account": account, "asset": asset, "amount": amount, "external_id": i}


def res(account, side, price, qty, symbol=10):
    return {"cmd": "reserve", "account": account, "symbol": symbol, "side": side, "price": price, "qty": qty}


def trade(idx, buy, sell, price, qty, taker_is_buy=True):
    return {"cmd": "settle", "source": 0, "prev": idx - 1, "idx": idx, "event": "trade", "buy": buy, "sell": sell, "price": price, "qty": qty, "taker_is_buy": taker_is_buy}


def test_command_rules():
    led = Ledger(1, SYM, DEFAULT_PPM)
    do = lambda c: led.apply(c)[:2]
    assert do(dep(1, 2, 0, 1)) == ("rejected", "bad_amount")
    assert do(dep(1, 2, 10_000, 1)) == ("deposited", None) and do(dep(1, 2, 5, 1)) == ("duplicate", None)
    assert do(dep(FEE_ACCOUNT, 2, 5, 9)) == ("rejected", "reserved_account") and do(dep(1, 2, MOST, 8)) == ("rejected", "overflow")
    assert do(dep(2, 1, 100_000, 2)) == ("deposited", None)
    assert [do(res(1, "buy", 10, 5, 99)), do(res(1, "buy", 10, 0)), do(res(1, "buy", 0, 5)), do(res(1, "buy", 10_001, 1))] == [("rejected", x) for x in ("unknown_symbol", "bad_quantity", "bad_price", "insufficient")]
    out, _, f = led.apply(res(1, "buy", 100, 50))
    buy = f["order_id"]
    assert out == "reserved" and buy >> 48 == 1 and led.held[1, 2] == 5000
    sell = led.apply(res(2, "sell", 90, 50))[2]["order_id"]
    assert do({"cmd": "cancel", "account": 2, "order_id": buy}) == ("rejected", "not_owner") and do({"cmd": "cancel", "account": 1, "order_id": 5}) == ("rejected", "unknown_order")
    assert do(trade(2, buy, sell, 95, 20)) == ("rejected", "gap")
    assert do(trade(1, buy, sell, 95, 20)) == ("settled", None) and do(trade(1, buy, sell, 95, 20)) == ("duplicate", None)
    # the buyer held 100 each, paid 95 each; both pay a fee on what they receive
    assert (led.free[1, 2], led.held[1, 2], led.free[1, 1]) == (5000 + 20 * 5, 3000, 20_000 - 20_000 * DEFAULT_PPM // 10**6)
    assert led.free[2, 2] == 1900 - 1900 * DEFAULT_PPM // 10**6 and led.violations() == []
    assert do(trade(2, buy, sell, 101, 5)) == ("anomaly", None) and led.marks[0] == 2 and led.anomalies == 1
    led.anomalies = 0
    assert do({"cmd": "cancel", "account": 1, "order_id": buy}) == ("cancel_queued", None) and do({"cmd": "cancel", "account": 1, "order_id": buy}) == ("rejected", "already_cancelling")
    assert led.held[1, 2] == 3000
    assert do({"cmd": "settle", "source": 0, "prev": 2, "idx": 3, "event": "closed", "order_id": buy}) == ("settled", None) and led.held[1, 2] == 0
    w = {"cmd": "withdraw", "account": 1, "asset": 2, "amount": 100, "external_id": 5}
    assert [do(w), do(w), do({"cmd": "finalize", "external_id": 6, "paid": True}), do({"cmd": "finalize", "external_id": 5, "paid": False}), do({"cmd": "finalize", "external_id": 5, "paid": True})] == [("withdraw_held", None), ("rejected", "duplicate_id"), ("rejected", "unknown_id"), ("withdraw_done", None), ("duplicate", None)]
    assert do({"cmd": "fee_withdraw", "asset": 1, "amount": 10**9, "external_id": 7}) == ("rejected", "insufficient")
    assert do({"cmd": "fee_withdraw", "asset": 1, "amount": 100, "external_id": 7}) == ("withdraw_held", None) and led.violations() == []
    assert do({"cmd": "adjust", "account": 1, "asset": 2, "amount": 10**9, "credit": False, "reason": 1, "external_id": 1}) == ("rejected", "insufficient")
    assert do({"cmd": "adjust", "account": 1, "asset": 2, "amount": 7, "credit": True, "reason": 1, "external_id": 1}) == ("adjusted", None)
    assert do({"cmd": "outbox_ack", "upto": 99}) == ("acked", None) and not led.outbox and led.outbox_base == 3
    assert do({"cmd": "nonsense", "account": 1}) == ("anomaly", None)


def test_sweep_takes_old_retries_first():
    led = Ledger(0, SYM)
    led.apply(dep(1, 2, 10**6, 1))
    ids = []
    for t in (10, 20, 30, 40):
        led.apply({"cmd": "clock", "now_ns": t})
        ids.append(led.apply(res(1, "buy", 1, 1))[2]["order_id"])
    led.apply({"cmd": "cancel", "account": 1, "order_id": ids[3], "ts_ns": 50})
    led.outbox.clear()
    assert led.apply({"cmd": "sweep", "max_age_ns": 60, "retry_ns": 30, "max": 2, "ts_ns": 80})[2] == {"queued": 2}
    assert [m["order"] for m in led.outbox] == [ids[3], ids[0]] and led.orders[ids[0]]["cancel_at"] == 80
    assert led.apply({"cmd": "sweep", "max_age_ns": 50, "retry_ns": 0, "max": 9})[2] == {"queued": 2}


def test_lending_and_slices_keep_their_identity():
    led, sl = Ledger(0, SYM, DEFAULT_PPM), slices.Slice(3, SYM, DEFAULT_PPM)
    idx = [0]

    def feed(events):
        for e in events:
            idx[0] += 1
            assert led.apply({"cmd": "settle", "source": 9, "prev": idx[0] - 1, "idx": idx[0]} | e)[0] == "settled"

    for account, asset, i in ((1, 2, 1), (2, 1, 2)):
        led.apply(dep(account, asset, 10**6, i))
        assert led.apply({"cmd": "lend", "grp": 3, "account": account, "asset": asset, "amount": 400_000})[0] == "lent"
        sl.grant(account, asset, 400_000)
    buy, sell = sl.enter(1, 10, "buy", 100, 50)[2]["order_id"], sl.enter(2, 10, "sell", 100, 50)[2]["order_id"]
    assert sl.enter(1, 10, "buy", 10**9, 1)[1] == "insufficient"
    sl.settle([{"event": "trade", "buy": buy, "sell": sell, "price": 100, "qty": 50, "taker_is_buy": True}, {"event": "closed", "order_id": 77}])
    assert sl.unreported()
    feed(sl.report())
    assert not sl.unreported() and sl.violations() == [] and led.violations() == []
    feed(sl.recall(1, 2, 10**9))
    assert led.free[1, 2] == 600_000 + 395_000 and led.violations() == [] and led.apply({"cmd": "recall", "grp": 4, "account": 1, "asset": 2, "amount": 1})[:2] == ("rejected", "insufficient")
    assert led.apply({"cmd": "lend", "grp": 0x8000, "account": 1, "asset": 2, "amount": 1})[:2] == ("rejected", "bad_group")


@pytest.mark.parametrize("seed", range(12))
def test_identities_hold_after_every_random_command(seed):
    r = random.Random(seed)
    led, idx = Ledger(0, SYM, DEFAULT_PPM), 0
    for n in range(500):
        acc, asset, live = r.randrange(1, 5), r.randrange(1, 4), list(led.orders)
        kind = r.randrange(9)
        if kind < 2:
            led.apply(dep(acc, asset, r.randrange(0, 10**6), r.randrange(400)))
        elif kind < 4:
            led.apply(res(acc, r.choice(["buy", "sell"]), r.randrange(0, 50), r.randrange(0, 20), r.choice([10, 11, 12])))
        elif kind == 4:
            led.apply({"cmd": "withdraw", "account": acc, "asset": asset, "amount": r.randrange(1000), "external_id": r.randrange(90)})
        elif kind == 5:
            led.apply({"cmd": "finalize", "external_id": r.randrange(90), "paid": r.random() < 0.5})
        elif kind == 6:
            led.apply({"cmd": r.choice(["lend", "recall"]), "grp": 1, "account": acc, "asset": asset, "amount": r.randrange(500)})
        elif live:
            a, b = r.choice(live), r.choice(live)
            price = led.orders[a]["price"]
            e = trade(idx + 1, a, b, price, r.randrange(0, 9), r.random() < 0.5) if kind == 7 else {"cmd": "settle", "source": 0, "prev": idx, "idx": idx + 1, "event": "closed", "order_id": a}
            if led.apply(e)[0] in ("settled", "anomaly"):
                idx += 1
        led.anomalies = 0
        assert led.violations() == []


def test_fold_equals_plain_python_and_audits_are_clean(spark):
    r = random.Random(1)
    rows = []
    for n in range(300):
        c = dep(r.randrange(5), r.randrange(1, 4), r.randrange(10**6), r.randrange(200)) if n < 150 else res(r.randrange(5), r.choice(["buy", "sell"]), r.randrange(1, 30), r.randrange(1, 9))
        rows.append({"shard": r.randrange(3), "lsn": n} | c)
    fields = ["shard", "lsn", "cmd", "account", "asset", "amount", "external_id", "symbol", "side", "price", "qty"]
    df = spark.createDataFrame([tuple(x.get(f) for f in fields) for x in r.sample(rows, len(rows))], "shard long, lsn long, cmd string, account long, asset long, amount long, external_id long, symbol long, side string, price long, qty long")
    state = ledger.run_ledger(cmds(df), SYM, DEFAULT_PPM).cache()
    leds = {s: Ledger(s, SYM, DEFAULT_PPM) for s in range(3)}
    want = {(x["shard"], x["lsn"]): leds[x["shard"]].apply(x)[:2] for x in rows}
    assert {(x.shard, x.lsn): (x.outcome, x.reject) for x in state.filter("rec = 'outcome'").collect()} == want
    assert {(x.shard, x.account, x.asset): (int(x.amount), int(x.held)) for x in state.filter("rec = 'balance'").collect()} == {(s, *k): (led.free[k], led.held[k]) for s, led in leds.items() for k in {*led.free, *led.held}}
    syms = symbols_table(spark).select("symbol", "base", "quote", "lot")
    assert audit.full_round(state, syms).count() == 0
    # each rule sees the fault that it is for
    hurt = lambda cond, c, by: state.withColumn(c, F.when(F.expr(cond), F.col(c) + by).otherwise(F.col(c)).cast(dict(state.dtypes)[c]))
    rules = lambda df: {x.rule for x in audit.full_round(df, syms).collect()}
    assert rules(hurt("rec = 'balance' and shard = 0", "amount", 1)) == {"conservation"}
    assert rules(hurt("rec = 'order' and shard = 1", "qty", 1)) == {"order hold"}
    assert "balance hold" in rules(hurt("rec = 'order' and shard = 1", "held", 1))
    assert "settled flows" in rules(state.unionByName(state.filter("rec = 'flow' and name = 'deposited'").limit(1).withColumn("name", F.lit("settled_in"))))
    gf = state.filter("rec = 'flow'").limit(1).withColumn("rec", F.lit("group_flow")).withColumn("name", F.lit("granted")).withColumn("grp", F.lit(1).cast("long"))
    assert {"group flow", "group totals"} <= rules(state.unionByName(gf))


def test_order_and_money_audits_name_the_fault(spark):
    acked = spark.createDataFrame([(i, 5) for i in range(1, 7)], "order_id long, qty long")
    rows = [("trade", 1, 2, None, 5), ("trade", 3, 99, None, 6), ("closed", None, None, 4, None), ("closed", None, None, 4, None)]
    archive = spark.createDataFrame(rows, "kind string, buy long, sell long, order_id long, qty long")
    opened = spark.createDataFrame([(5,)], "order_id long")
    got = {(r.rule, r.key) for r in audit.order_audit(acked, archive, opened).collect()}
    assert got == {("overfilled", "3"), ("closed twice", "4"), ("still open", "5"), ("released unfilled", "6"), ("never acknowledged", "99")}


def test_logs_of_more_than_a_million_entries_are_compared(spark):
    """Sums of this many digests pass the range of a long; a short log of another node differs in its second entry."""
    whole = spark.range(1_300_000).selectExpr("0L as node", "id as idx", "1L as term", "'p' as payload")
    short = spark.range(3).selectExpr("1L as node", "id as idx", "1L as term", "if(id = 1, 'other', 'p') as payload")
    assert sorted(r.key for r in replication.log_matching(whole.unionByName(short)).collect()) == ["1/1", "2/1"]


def test_replica_and_cursor_audits(spark):
    d = spark.createDataFrame([(0, 1, "a"), (1, 1, "a"), (2, 1, "b"), (0, 2, "a"), (1, 2, "b"), (2, 2, "c"), (0, 3, "a"), (1, 3, "b")], "node long, idx long, digest string")
    assert {(r.node, r.idx): r.halt for r in audit.divergence(d, 3).collect()} == {(0, 1): False, (1, 1): False, (2, 1): True, (0, 2): True, (1, 2): True, (2, 2): True, (0, 3): False, (1, 3): False}
    logs = spark.createDataFrame([(0, 1, 1, "x"), (0, 2, 2, "y"), (1, 1, 1, "x"), (1, 2, 2, "z"), (1, 2, 3, "x")], "replica long, idx long, place long, batch string")
    ack, maybe = spark.createDataFrame([("x",), ("y",)], "batch string"), spark.createDataFrame([("q",)], "batch string")
    assert {r.rule for r in audit.applied_log_audit(logs, ack, maybe).collect()} == {"applied twice", "index order", "missing", "invented", "replicas differ"}
    led = spark.createDataFrame([(0, 5, 9), (1, 0, 3)], "shard long, base long, next long")
    cur = spark.createDataFrame([(0, 0, 4), (0, 1, 8), (1, 0, 4)], "shard long, grp long, cursor long")
    assert {(r.rule, r.key) for r in audit.cursor_audit(led, cur).collect()} == {("trimmed unread", "0"), ("cursor ahead", "1")}
    nodes = spark.createDataFrame([(5, 5, "a", False), (5, 5, "a", False)], "applied long, committed long, digest string, halted boolean")
    assert audit.settled(nodes).first().settled and not audit.settled(nodes.withColumn("applied", F.col("applied") - 1)).first().settled


def test_archive_follows_each_lifetime_of_an_id(spark):
    ev = "source long, symbol long, iseq long, ordinal int, ev string, order_id long, maker long, taker long, price long, qty long, reason string"
    rows = [
        (0, 1, 3, 0, "trade", None, 1, 2, 10, 4, None), (0, 1, 3, 1, "closed", 1, None, None, None, None, "filled"), (0, 1, 5, 0, "closed", 2, None, None, None, None, "cancelled"), (0, 1, 6, 0, "rejected", 2, None, None, None, None, "unknown_order_id"),
        (0, 1, 8, 0, "trade", None, 9, 1, 10, 1, None), (0, 1, 9, 0, "trade", None, 1, 77, 10, 1, None), (0, 1, 10, 0, "rejected", 5, None, None, None, None, "invalid_qty"),
    ]
    sent = spark.createDataFrame([(1, 1, 1, "sell"), (1, 3, 2, "buy"), (1, 7, 1, "buy"), (1, 4, 9, "sell"), (1, 10, 5, "buy")], "symbol long, iseq long, order_id long, side string")
    got = sorted((r.iseq, r.kind, r.buy, r.sell, r.taker_is_buy, r.order_id) if r.kind == "trade" else (r.iseq, r.kind, r.order_id) for r in flow.archive_events(spark.createDataFrame(rows, ev), sent).collect())
    assert got == [(3, "trade", 2, 1, True, None), (5, "closed", 2), (8, "trade", 1, 9, True, None), (9, "unmapped", None), (10, "closed", 5)]


def test_intake_and_spans(spark):
    a = spark.createDataFrame([(0, i, x) for i, x in enumerate([0, 2, 1, 1, 2, 3])], "shard long, arrival long, idx long")
    assert [r.outcome for r in flow.intake(a).orderBy("arrival").collect()] == ["applied", "gap", "applied", "duplicate", "applied", "applied"]
    s = spark.createDataFrame([(0, 0, 0, 5), (0, 1, 3, 8), (0, 2, 9, 12), (0, 3, 2, 4)], "shard long, arrival long, first long, end long")
    assert [(r.outcome, r.skip, r.cursor) for r in flow.span_intake(s).orderBy("arrival").collect()] == [("applied", 0, 5), ("applied", 2, 8), ("gap", None, 8), ("duplicate", None, 8)]


def test_lending_to_many_accounts_takes_time_in_proportion():
    """Sums over groups are kept, not made anew from all that is lent."""
    import pickle
    import time

    led, began = Ledger(0, SYM, DEFAULT_PPM), time.process_time()
    for a in range(20_000):
        led.apply(dep(a, 2, 100, a))
        assert [led.apply({"cmd": "lend", "grp": g, "account": a, "asset": 2, "amount": 7})[0] for g in (1, 2)] == ["lent", "lent"]
    assert time.process_time() - began < 20
    led = pickle.loads(pickle.dumps(led))  # as a stream keeps it
    assert led.lent_of(5, 2) == 14 and led.lent_of(5, 1) == 0 and led.violations() == []
    led.lent[5, 2, 1] -= 3
    assert led.lent_of(5, 2) == 11 and led.lent[5, 2, 2] == 7


def test_fee_is_exact(spark):
    r = random.Random(2)
    rows = [(r.randrange(10**18), r.randrange(10**6 + 1)) for _ in range(200)]
    got = spark.createDataFrame(rows, "a long, p long").select("a", "p", money.fee(F.col("a"), F.col("p")).alias("f"), money.percent(F.col("a"), 37).alias("c")).collect()
    assert all(int(x.f) == x.a * x.p // 10**6 and x.c == x.a // 100 * 37 + x.a % 100 * 37 // 100 for x in got)


def test_percentile_rules(spark):
    v = [5, 1, 1, 9, 7, 7, 7, 2]
    df = spark.createDataFrame([(x,) for x in v], "v long")
    s = sorted(v)
    near = {r.share: r.value for r in ordering.percentiles(df, "v", ["0.001", "0.5", "0.9", "1"], "nearest").collect()}
    at = {r.share: r.value for r in ordering.percentiles(df, "v", ["0.001", "0.5", "0.9", "1"], "index").collect()}
    for p in ("0.001", "0.5", "0.9", "1"):
        m = round(float(p) * 1000)
        assert near[p] == s[max(1, -(-m * len(s) // 1000)) - 1] and at[p] == s[-(-m * (len(s) - 1) // 1000)]


def test_counter_is_not_shared():
    assert Ledger(0, SYM).free is not Ledger(0, SYM).free and isinstance(Ledger(0, SYM).free, Counter)
