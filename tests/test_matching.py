import random
from collections import defaultdict

import pytest

from tidebook.functions import lines
from tidebook.operators import bookviews, matching, sweep
from tidebook.operators.book import Book
from tidebook.schemas import COMMANDS, names


def new(oid, side, price, qty, tif="gtc", otype="limit"):
    return {"cmd": "new", "order_id": oid, "side": side, "otype": otype, "price": price, "qty": qty, "tif": tif}


def cancel(oid):
    return {"cmd": "cancel", "order_id": oid, "side": None, "otype": None, "price": None, "qty": None, "tif": None}


def replace(oid, price, qty):
    return cancel(oid) | {"cmd": "replace", "price": price, "qty": qty}


def short(events):
    """seq is dropped; fields that an event lacks are dropped."""
    return [tuple(x for x in e[1:] if x is not None) for e in events]


def run(cmds, **config):
    book, out = Book(**config), []
    for c in cmds:
        out += book.apply(c)
        assert book.problems() == []
    assert [e[0] for e in out] == list(range(1, len(out) + 1))
    return short(out)


CASES = {
    "sweep in price-time order": ([new(1, "ask", 100, 5), new(2, "ask", 99, 2), new(3, "ask", 100, 4), new(4, "bid", 100, 8)],
        [("accepted", 1, 5), ("accepted", 2, 2), ("accepted", 3, 4), ("trade", 2, 4, 99, 2), ("closed", 2, "filled"), ("trade", 1, 4, 100, 5), ("closed", 1, "filled"), ("trade", 3, 4, 100, 1), ("closed", 4, "filled")]),
    "remainder rests": ([new(1, "bid", 50, 3), new(2, "ask", 50, 5)], [("accepted", 1, 3), ("trade", 1, 2, 50, 3), ("closed", 1, "filled"), ("accepted", 2, 2)]),
    "ioc and market expire": ([new(1, "bid", 50, 3), new(2, "ask", 51, 5, "ioc"), new(3, "ask", 0, 5, "fok", "market")], [("accepted", 1, 3), ("closed", 2, "expired"), ("trade", 1, 3, 50, 3), ("closed", 1, "filled"), ("closed", 3, "expired")]),
    "fok needs all": ([new(1, "ask", 50, 3), new(2, "ask", 52, 3), new(3, "bid", 51, 4, "fok"), new(4, "bid", 52, 6, "fok")],
        [("accepted", 1, 3), ("accepted", 2, 3), ("rejected", 3, "fok_cannot_fill"), ("trade", 1, 4, 50, 3), ("closed", 1, "filled"), ("trade", 2, 4, 52, 3), ("closed", 2, "filled"), ("closed", 4, "filled")]),
    "post only": ([new(1, "ask", 50, 3), new(2, "bid", 50, 1, "post_only"), new(3, "bid", 49, 1, "post_only")], [("accepted", 1, 3), ("rejected", 2, "post_only_would_cross"), ("accepted", 3, 1)]),
    "validation order": ([new(1, "bid", -1, 0), new(1, "bid", 10**7, 1), new(1, "bid", 5, 1), new(1, "bid", 5, 1), cancel(9), replace(9, 5, 1), replace(1, 5, 0), replace(1, -4, 1)],
        [("rejected", 1, "invalid_qty"), ("rejected", 1, "invalid_price"), ("accepted", 1, 1), ("rejected", 1, "duplicate_order_id"), ("rejected", 9, "unknown_order_id"), ("rejected", 9, "unknown_order_id"), ("rejected", 1, "invalid_qty"), ("rejected", 1, "invalid_price")]),
    "replace keeps place when smaller": ([new(1, "bid", 50, 5), new(2, "bid", 50, 5), replace(1, 50, 3), new(3, "ask", 50, 1)], [("accepted", 1, 5), ("accepted", 2, 5), ("replaced", 1, 50, 3), ("trade", 1, 3, 50, 1), ("closed", 3, "filled")]),
    "replace loses place when larger": ([new(1, "bid", 50, 5), new(2, "bid", 50, 5), replace(1, 50, 6), new(3, "ask", 50, 1)], [("accepted", 1, 5), ("accepted", 2, 5), ("replaced", 1, 50, 6), ("trade", 2, 3, 50, 1), ("closed", 3, "filled")]),
    "replace crosses": ([new(1, "bid", 50, 5), new(2, "ask", 60, 5), replace(1, 60, 7), replace(1, 61, 1), new(3, "ask", 70, 1), replace(1, 70, 1)],
        [("accepted", 1, 5), ("accepted", 2, 5), ("trade", 2, 1, 60, 5), ("closed", 2, "filled"), ("replaced", 1, 60, 2), ("replaced", 1, 61, 1), ("accepted", 3, 1), ("trade", 3, 1, 70, 1), ("closed", 3, "filled"), ("closed", 1, "filled")]),
    "closed ids are free": ([new(1, "bid", 50, 5), cancel(1), new(1, "ask", 50, 2)], [("accepted", 1, 5), ("closed", 1, "cancelled"), ("accepted", 1, 2)]),
}


@pytest.mark.parametrize("name", CASES)
def test_rules(name):
    cmds, want = CASES[name]
    assert run(cmds) == want


def test_full_book_and_tree_prices():
    assert run([new(1, "bid", 5, 1), new(2, "ask", 5, 1, "gtc", "market")], max_orders=1)[-1] == ("rejected", 2, "book_full")
    assert run([new(1, "bid", 10**9, 1), new(2, "bid", 0, 1)], index="tree") == [("accepted", 1, 1), ("rejected", 2, "invalid_price")]


def flow(seed, n, symbols=4):
    r = random.Random(seed)
    out = []
    for i in range(1, n + 1):
        oid, kind = r.randrange(1, 60), r.random()
        c = new(oid, r.choice(["bid", "ask"]), r.randrange(95, 106), r.randrange(0, 9), r.choice(["gtc", "gtc", "ioc", "fok", "post_only"]), r.choice(["limit"] * 5 + ["market"])) if kind < 0.7 else cancel(oid) if kind < 0.85 else replace(oid, r.randrange(94, 107), r.randrange(0, 9))
        out.append(c | {"iseq": i, "symbol": r.randrange(symbols)})
    return out


def frame(spark, rows):
    return spark.createDataFrame([tuple(r.get(f) for f in names(COMMANDS)) for r in rows], COMMANDS)


def plain(rows):
    books, out = defaultdict(Book), []
    for c in rows:
        out += [(c["symbol"], c["iseq"], i, *e) for i, e in enumerate(books[c["symbol"]].apply(c))]
    return sorted(out, key=lambda x: x[:3]), books


@pytest.mark.parametrize("parts", [1, 3, 8])
def test_result_does_not_depend_on_partitions(spark, parts):
    rows = flow(parts, 600)
    want, books = plain(rows)
    r = random.Random(0)
    shuffled = rows[:]
    r.shuffle(shuffled)
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        state = matching.match_with_state(frame(spark, shuffled).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)
    got = sorted((tuple(x[:12]) for x in state if x.rec is None), key=lambda x: x[:3])
    assert [(*g[:4], *g[4:]) for g in got] == [(s, i, o, *e) for s, i, o, *e in want]
    rest = sorted((x.symbol, x.book_pos, x.side, x.order_id, x.otype, x.tif, x.price, x.qty) for x in state if x.rec == "order")
    assert rest == sorted((s, k, *o) for s, b in books.items() for k, o in enumerate(b.resting()))


def test_book_from_events_equals_state(spark):
    c = frame(spark, flow(11, 1500))
    state = matching.match_with_state(c)
    cols = ["symbol", "side", "book_pos", "order_id", "otype", "tif", "price", "qty"]
    a = {tuple(r) for r in matching.resting_of(state).select(*cols).collect()}
    assert a == {tuple(r) for r in bookviews.from_events(c, matching.events_of(state)).select(*cols).collect()} and a
    assert bookviews.problems(matching.resting_of(state)).count() == 0


@pytest.mark.parametrize("cut", [0, 1, 300, 599, 600])
def test_resume_from_a_snapshot_is_the_whole_run(spark, cut):
    rows = flow(21, 600)
    c = frame(spark, rows)
    s = matching.match_with_state(matching.cut(c, cut))
    tail = matching.events_of(matching.resume(matching.books_of(s), matching.resting_of(s), c.filter(f"iseq > {cut}")))
    want = [tuple(x) for x in plain(rows)[0] if x[1] > cut]
    assert sorted((tuple(x) for x in tail.collect()), key=lambda x: x[:3]) == want


def test_lines_round_trip(spark):
    c = frame(spark, flow(5, 200))
    back = lines.parse_commands(c.select(lines.command_line(True, True).alias("value")))
    ok = {tuple(r) for r in back.filter("ok").select(*names(COMMANDS)).collect()}
    kept = {tuple(r) for r in c.collect()}
    assert ok == kept
    bad = spark.createDataFrame([('{"cmd":"new","order_id":1}',), ("nonsense",), ('{"cmd":"cancel","order_id":2,"more":1}',), ('{"cmd":"new","order_id":1,"side":"up","otype":"limit","price":1,"qty":1,"tif":"gtc"}',)], "value string")
    assert [r.ok for r in lines.parse_commands(bad).collect()] == [False, False, True, False]


def test_canonical_event_lines(spark):
    e = matching.match(frame(spark, [new(1, "ask", 100, 5) | {"iseq": 1, "symbol": 7}, new(2, "bid", 100, 5) | {"iseq": 2, "symbol": 7}]))
    got = [r.line for r in e.orderBy("seq").select(lines.event_line(True).alias("line")).collect()]
    assert got == ['{"seq":1,"ev":"accepted","symbol":7,"order_id":1,"leaves_qty":5}', '{"seq":2,"ev":"trade","symbol":7,"maker":1,"taker":2,"price":100,"qty":5}', '{"seq":3,"ev":"closed","symbol":7,"order_id":1,"reason":"filled"}', '{"seq":4,"ev":"closed","symbol":7,"order_id":2,"reason":"filled"}']


def test_closed_form_sweep_is_the_fold(spark):
    r = random.Random(8)
    rows = [new(i, "ask", r.randrange(90, 99), r.randrange(1, 200)) | {"iseq": i, "symbol": i % 3} for i in range(1, 150)]
    rows += [new(i, "bid", 0, r.randrange(1, 300), "ioc", "market") | {"iseq": i, "symbol": i % 3} for i in range(150, 260)]
    c = frame(spark, rows)
    want = matching.match(c).filter("ev = 'trade'").select("symbol", "maker", "taker", "price", "qty")
    got = sweep.sweep_trades(c.filter("side = 'ask'"), c.filter("side = 'bid'"), step=37)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))
