"""Scripted sessions: every event of the table plays one fixed script of commands on a book, or on
accounts and orders, of its own. What a script leads to is known step by step, so the folds are
compared with closed forms that cover every command, every refusal and every kind of event.

A step's fields are SQL expressions over the event's parameters; inputs are built from them in
Spark as in DuckDB. Expected results are stated beside the steps, not derived from them."""

from __future__ import annotations


def _steps(n: int) -> str:
    return "(VALUES " + ", ".join(f"({k})" for k in range(1, n + 1)) + ") AS steps(k)"


def _column(rows: list[dict], name: str, kind: str, alias: str | None = None) -> str:
    when = " ".join(f"WHEN {k} THEN {r[name]}" for k, r in enumerate(rows, 1) if r.get(name) is not None)
    return f"CAST({f'CASE k {when} END' if when else 'NULL'} AS {kind}) AS {alias or name}"


def _q(text: str) -> str:
    return f"'{text}'"


# --- books: one per event; p, a, b are its price and quantities ---

_BOOK = "(SELECT event_id, 1000 + event_id % 50 AS p, 2 + event_id % 7 AS a, 1 + event_id % 3 AS b FROM events) AS s"


def _new(o, side, price, qty, tif, otype="limit"):
    return {"cmd": "'new'", "order_id": f"event_id * 20 + {o}", "side": _q(side), "otype": _q(otype), "price": price, "qty": qty, "tif": _q(tif)}


def _replace(o, price, qty):
    return {"cmd": "'replace'", "order_id": f"event_id * 20 + {o}", "price": price, "qty": qty}


def _cancel(o):
    return {"cmd": "'cancel'", "order_id": f"event_id * 20 + {o}"}


_COMMANDS = [
    _new(1, "bid", "p", "a", "gtc"),
    _new(2, "ask", "p + 5", "a + b", "gtc"),
    _new(3, "bid", "p + 5", "1", "post_only"),
    _new(4, "bid", "p + 1", "b", "post_only"),
    _new(5, "bid", "p + 5", "a + b + 1", "fok"),
    _new(6, "bid", "p + 5", "b", "fok"),
    _replace(1, "p", "a - 1"),  # keeps its place
    _new(8, "bid", "p", "1", "gtc"),
    _replace(1, "p", "a + 3"),  # goes behind order 8
    _new(10, "ask", "p", "b + 2", "ioc"),
    _replace(2, "p", "a + 4"),  # crosses, the rest rests
    _new(12, "bid", "p", "0", "gtc"),
    _new(13, "bid", "-1", "1", "gtc"),
    _new(2, "ask", "p + 9", "1", "gtc"),
    _replace(19, "p", "1"),
    _replace(2, "p", "0"),
    _replace(2, "1000001", "1"),
    _cancel(2),
    _new(18, "ask", "0", "b", "ioc", "market"),
]


def _ev(k, ordinal, ev, o=None, reason=None, price=None, qty=None, leaves=None, maker=None, taker=None):
    of = lambda n: None if n is None else f"event_id * 20 + {n}"
    return {"step": str(k), "ordinal": str(ordinal), "ev": _q(ev), "order_id": of(o), "maker": of(maker), "taker": of(taker), "price": price, "qty": qty, "leaves_qty": leaves, "reason": None if reason is None else _q(reason)}


_EVENTS = [
    _ev(1, 0, "accepted", 1, leaves="a"),
    _ev(2, 0, "accepted", 2, leaves="a + b"),
    _ev(3, 0, "rejected", 3, "post_only_would_cross"),
    _ev(4, 0, "accepted", 4, leaves="b"),
    _ev(5, 0, "rejected", 5, "fok_cannot_fill"),
    _ev(6, 0, "trade", maker=2, taker=6, price="p + 5", qty="b"),
    _ev(6, 1, "closed", 6, "filled"),
    _ev(7, 0, "replaced", 1, price="p", qty="a - 1"),
    _ev(8, 0, "accepted", 8, leaves="1"),
    _ev(9, 0, "replaced", 1, price="p", qty="a + 3"),
    _ev(10, 0, "trade", maker=4, taker=10, price="p + 1", qty="b"),
    _ev(10, 1, "closed", 4, "filled"),
    _ev(10, 2, "trade", maker=8, taker=10, price="p", qty="1"),
    _ev(10, 3, "closed", 8, "filled"),
    _ev(10, 4, "trade", maker=1, taker=10, price="p", qty="1"),
    _ev(10, 5, "closed", 10, "filled"),
    _ev(11, 0, "trade", maker=1, taker=2, price="p", qty="a + 2"),
    _ev(11, 1, "closed", 1, "filled"),
    _ev(11, 2, "replaced", 2, price="p", qty="2"),
    _ev(12, 0, "rejected", 12, "invalid_qty"),
    _ev(13, 0, "rejected", 13, "invalid_price"),
    _ev(14, 0, "rejected", 2, "duplicate_order_id"),
    _ev(15, 0, "rejected", 19, "unknown_order_id"),
    _ev(16, 0, "rejected", 2, "invalid_qty"),
    _ev(17, 0, "rejected", 2, "invalid_price"),
    _ev(18, 0, "closed", 2, "cancelled"),
    _ev(19, 0, "closed", 18, "expired"),
]
#: A book of two orders at most whose prices are any above zero.
FULL = {"max_orders": 2, "index": "tree"}
_FULL_COMMANDS = [
    _new(1, "bid", "5000000 + p", "a", "gtc"),
    _new(2, "bid", "0", "1", "gtc"),
    _new(3, "bid", "10", "1", "gtc"),
    _new(4, "ask", "10", "1", "ioc"),  # would trade, but the book is full
    _cancel(3),
    _new(6, "ask", "5000000 + p", "a + 1", "ioc"),
    _new(7, "ask", "5000000 + p", "b", "gtc"),
]
_FULL_EVENTS = [
    _ev(1, 0, "accepted", 1, leaves="a"),
    _ev(2, 0, "rejected", 2, "invalid_price"),
    _ev(3, 0, "accepted", 3, leaves="1"),
    _ev(4, 0, "rejected", 4, "book_full"),
    _ev(5, 0, "closed", 3, "cancelled"),
    _ev(6, 0, "trade", maker=1, taker=6, price="5000000 + p", qty="a"),
    _ev(6, 1, "closed", 1, "filled"),
    _ev(6, 2, "closed", 6, "expired"),
    _ev(7, 0, "accepted", 7, leaves="b"),
]


def _commands(rows: list[dict]) -> str:
    kinds = {"cmd": "VARCHAR(20)", "order_id": "BIGINT", "side": "VARCHAR(20)", "otype": "VARCHAR(20)", "price": "BIGINT", "qty": "BIGINT", "tif": "VARCHAR(20)"}
    return f"SELECT event_id * 20 + k AS iseq, event_id AS symbol, {', '.join(_column(rows, c, t) for c, t in kinds.items())} FROM {_BOOK} CROSS JOIN {_steps(len(rows))}".replace("VARCHAR(20)", "STRING")


def _events(rows: list[dict]) -> str:
    kinds = {"ordinal": "INTEGER", "ev": "VARCHAR", "order_id": "BIGINT", "maker": "BIGINT", "taker": "BIGINT", "price": "BIGINT", "qty": "BIGINT", "leaves_qty": "BIGINT", "reason": "VARCHAR"}
    return f"SELECT event_id AS symbol, event_id * 20 + {_column(rows, 'step', 'BIGINT').removesuffix(' AS step')} AS iseq, CAST(k AS BIGINT) AS seq, {', '.join(_column(rows, c, t) for c, t in kinds.items())} FROM {_BOOK} CROSS JOIN {_steps(len(rows))}"


BOOK_COMMANDS, BOOK_EVENTS = _commands(_COMMANDS), _events(_EVENTS)
FULL_COMMANDS, FULL_EVENTS = _commands(_FULL_COMMANDS), _events(_FULL_EVENTS)


# --- ledgers: accounts a (buyer) and b (seller) of the event; n is the event's place in its shard ---

_PARTIES = """event_id AS e, 2 * event_id + 1 AS a, 2 * event_id + 2 AS b, 10 + event_id % 2 AS sym, CASE WHEN event_id % 2 = 0 THEN 1 ELSE 3 END AS base,
  CASE WHEN event_id % 2 = 0 THEN 1000 ELSE 10 END AS lot, 100 + event_id % 7 AS p, 99 + event_id % 7 AS t, 2 + event_id % 5 AS q, event_id % 4 < 2 AS tib,
  CASE WHEN event_id % 2 = 0 THEN 15000 WHEN event_id % 4 < 2 THEN 25000 ELSE 5000 END AS buy_ppm, CASE WHEN event_id % 2 = 0 THEN 15000 WHEN event_id % 4 < 2 THEN 5000 ELSE 25000 END AS sell_ppm"""
LEDGER = f"(SELECT event_id % 3 AS shard, CAST(row_number() OVER (PARTITION BY event_id % 3 ORDER BY event_id) - 1 AS BIGINT) AS n, {_PARTIES} FROM events) AS s"
#: Orders, messages and settlements that a script adds to its shard, and a number that no order has.
ORDERS, MESSAGES, SETTLES, NOBODY = 4, 9, 11, (1 << 48) - 1


def _order(j: int) -> str:
    return f"(shard * {1 << 48} + n * {ORDERS} + {j})"


def _step(cmd, outcome, reject=None, order=None, box=None, queued=None, **fields):
    out = {"cmd": _q(cmd), "outcome": _q(outcome), "reject": None if reject is None else _q(reject)}
    out["made"] = None if order is None else _order(order)
    out["outbox_idx"] = None if box is None else f"n * {MESSAGES} + {box}"
    out["queued"] = None if queued is None else str(queued)
    return out | fields


def _money(cmd, outcome, reject, who, asset, amount, external):
    return _step(cmd, outcome, reject, account=who, asset=asset, amount=amount, external_id=f"10 * e + {external}")


def _reserve(who, side, price, qty, outcome="reserved", reject=None, order=None, box=None, symbol="sym", cmd="reserve"):
    return _step(cmd, outcome, reject, order, box, account=who, symbol=symbol, side=_q(side), price=price, qty=qty)


def _settle(event, at, outcome="settled", reject=None, prev=None, **fields):
    return _step("settle", outcome, reject, source="7", prev=f"n * {SETTLES} + {at - 1 if prev is None else prev}", idx=f"n * {SETTLES} + {at}", event=_q(event), **fields)


def _fill(at, outcome="settled"):
    return _settle("trade", at, outcome, buy=_order(1), sell=_order(2), price="t", qty="1", taker_is_buy="tib")


def _slice(event, at, amount):
    return _settle(event, at, grp="3", account="a", asset="2", amount=amount)


_LEDGER_STEPS = [
    _money("deposit", "deposited", None, "a", "2", "1000000 + e", 1),
    _money("deposit", "deposited", None, "b", "base", "100000 + e", 2),
    _money("deposit", "duplicate", None, "b", "base", "5", 2),
    _money("deposit", "rejected", "bad_amount", "a", "2", "0", 3),
    _money("deposit", "rejected", "reserved_account", "-1", "2", "5", 4),
    _reserve("a", "buy", "p", "q", order=1, box=0),
    _reserve("b", "sell", "t", "q", order=2, box=1),
    _reserve("a", "buy", "1000000000", "q", "rejected", "insufficient"),
    _reserve("a", "buy", "p", "q", "rejected", "unknown_symbol", symbol="99"),
    _reserve("a", "buy", "p", "0", "rejected", "bad_quantity"),
    _reserve("a", "buy", "0", "q", "rejected", "bad_price"),
    _fill(1),
    _fill(1, "duplicate"),
    _settle("closed", 6, "rejected", "gap", prev=5, order_id=_order(2)),
    _settle("closed", 2, order_id=_order(2)),
    _step("cancel", "rejected", "not_owner", account="b", order_id=_order(1)),
    _step("cancel", "cancel_queued", box=2, account="a", order_id=_order(1)),
    _step("cancel", "rejected", "already_cancelling", account="a", order_id=_order(1)),
    _step("cancel", "rejected", "unknown_order", account="a", order_id=str(NOBODY)),
    _step("clock", "ticked", now_ns="(e + 1) * 1000"),
    _step("sweep", "swept", queued=1, max_age_ns="1000000000000000", retry_ns="1", max="5"),  # order 1 once more
    _settle("closed", 3, order_id=_order(1)),
    _reserve("b", "sell", "t", "1", order=3, box=4, cmd="reserve_ioc"),
    _reserve("a", "buy", "p", "1", order=4, box=5),
    _step("clock", "ticked", now_ns="(e + 1) * 1000 + 10"),
    _step("sweep", "swept", queued=1, max_age_ns="5", retry_ns="0", max="1"),  # the older of orders 3 and 4
    _settle("closed", 4, order_id=_order(3)),
    _settle("closed", 5, order_id=_order(4)),
    _money("withdraw", "withdraw_held", None, "a", "2", "1000", 1),
    _money("withdraw", "rejected", "duplicate_id", "a", "2", "1000", 1),
    _money("withdraw", "rejected", "insufficient", "a", "2", "1000000000", 2),
    _step("finalize", "withdraw_done", external_id="10 * e + 1", paid="TRUE"),
    _step("finalize", "duplicate", external_id="10 * e + 1", paid="TRUE"),
    _step("finalize", "rejected", "unknown_id", external_id="10 * e + 9", paid="TRUE"),
    _money("withdraw", "withdraw_held", None, "b", "2", "1", 3),
    _step("finalize", "withdraw_done", external_id="10 * e + 3", paid="FALSE"),
    _money("adjust", "adjusted", None, "a", "base", "77", 1) | {"credit": "TRUE", "reason": "4"},
    _money("adjust", "duplicate", None, "a", "base", "77", 1) | {"credit": "TRUE", "reason": "4"},
    _money("adjust", "adjusted", None, "b", "base", "50", 2) | {"credit": "FALSE", "reason": "4"},
    _money("adjust", "rejected", "insufficient", "b", "base", "1000000000", 3) | {"credit": "FALSE", "reason": "4"},
    _step("lend", "lent", box=7, grp="3", account="a", asset="2", amount="500"),
    _step("lend", "rejected", "bad_group", grp="32768", account="a", asset="2", amount="500"),
    _slice("slice_out", 6, "100"),
    _slice("slice_in", 7, "40"),
    _slice("returned", 8, "60"),
    _settle("slice_fee", 9, asset="2", amount="9"),
    _step("recall", "recall_queued", box=8, grp="3", account="a", asset="2", amount="1000000000"),
    _step("recall", "rejected", "insufficient", grp="4", account="a", asset="2", amount="1"),
    _step("fee_withdraw", "withdraw_held", asset="2", amount="2", external_id="10 * e + 4"),
    _step("finalize", "withdraw_done", external_id="10 * e + 4", paid="TRUE"),
    _settle("closed", 10, "anomaly", order_id=str(NOBODY)),
    _settle("trade", 11, "anomaly", buy=str(NOBODY), sell=str(NOBODY - 1), price="1", qty="1", taker_is_buy="TRUE"),
    _step("outbox_ack", "acked", upto=f"n * {MESSAGES}"),  # the messages of the scripts before
    _step("dance", "anomaly"),
    _money("deposit", "anomaly", None, "a", "2", None, 5),
]


def _inputs(rows: list[dict], kinds: dict) -> str:
    return ", ".join(_column(rows, c, t) for c, t in kinds.items())


_LEDGER_KINDS = {
    "cmd": "STRING", "account": "BIGINT", "asset": "BIGINT", "symbol": "BIGINT", "side": "STRING", "price": "BIGINT", "qty": "BIGINT", "amount": "BIGINT", "external_id": "BIGINT", "paid": "BOOLEAN",
    "source": "BIGINT", "prev": "BIGINT", "idx": "BIGINT", "event": "STRING", "buy": "BIGINT", "sell": "BIGINT", "taker_is_buy": "BOOLEAN", "order_id": "BIGINT", "upto": "BIGINT", "now_ns": "BIGINT",
    "max_age_ns": "BIGINT", "retry_ns": "BIGINT", "max": "INT", "credit": "BOOLEAN", "reason": "INT", "grp": "BIGINT",
}
LEDGER_COMMANDS = f"SELECT shard, e * 100 + k AS lsn, {_inputs(_LEDGER_STEPS, _LEDGER_KINDS)} FROM {LEDGER} CROSS JOIN {_steps(len(_LEDGER_STEPS))}"
_OUTCOMES = [{**r, "order_id": r["made"]} for r in _LEDGER_STEPS]
LEDGER_OUTCOMES = f"""SELECT shard, e * 100 + k AS lsn, {_inputs(_OUTCOMES, {"outcome": "VARCHAR", "reject": "VARCHAR", "order_id": "BIGINT", "outbox_idx": "BIGINT", "queued": "INTEGER"})} FROM {LEDGER} CROSS JOIN {_steps(len(_OUTCOMES))}"""
LEDGER_BALANCES = f"""
  SELECT shard, a AS account, CAST(2 AS BIGINT) AS asset, CAST(1000000 + e - t - 1000 - 500 + 60 AS BIGINT) AS available, CAST(0 AS BIGINT) AS held FROM {LEDGER}
  UNION ALL SELECT shard, a, CAST(base AS BIGINT), CAST(lot - lot * buy_ppm // 1000000 + 77 AS BIGINT), CAST(0 AS BIGINT) FROM {LEDGER}
  UNION ALL SELECT shard, b, CAST(base AS BIGINT), CAST(100000 + e - lot - 50 AS BIGINT), CAST(0 AS BIGINT) FROM {LEDGER}
  UNION ALL SELECT shard, b, CAST(2 AS BIGINT), CAST(t - t * sell_ppm // 1000000 AS BIGINT), CAST(0 AS BIGINT) FROM {LEDGER}"""
_ZERO = ["deposited", "withdrawn", "settled_in", "settled_out", "adjusted_in", "adjusted_out", "fees", "lent_granted", "lent_returned", "slice_in", "slice_out"]


def _totals(asset: str, where: str, **sums: str) -> str:
    return f"SELECT shard, {asset} AS asset, " + ", ".join(f"CAST({f'sum({sums[c]})' if c in sums else 0} AS BIGINT) AS {c}" for c in _ZERO) + f" FROM {LEDGER} {where} GROUP BY shard, {asset}"


LEDGER_FLOWS = (
    _totals("CAST(2 AS BIGINT)", "", deposited="1000000 + e", withdrawn="1002", settled_in="t + 49", settled_out="t + 100", fees="t * sell_ppm // 1000000 + 7", lent_granted="500", lent_returned="60", slice_in="40", slice_out="100")
    + " UNION ALL "
    + _totals("CAST(base AS BIGINT)", "", deposited="100000 + e", settled_in="lot", settled_out="lot", adjusted_in="77", adjusted_out="50", fees="lot * buy_ppm // 1000000")
)
#: The messages that are left: those of each shard's last script.
_BOX = [
    ("submit", _order(1), "sym", "'buy'", "p", "q", None, None, None, None), ("submit", _order(2), "sym", "'sell'", "t", "q", None, None, None, None),
    ("cancel", _order(1), "sym", None, None, None, None, None, None, None), ("cancel", _order(1), "sym", None, None, None, None, None, None, None),
    ("submit_ioc", _order(3), "sym", "'sell'", "t", "1", None, None, None, None), ("submit", _order(4), "sym", "'buy'", "p", "1", None, None, None, None),
    ("cancel", _order(3), "sym", None, None, None, None, None, None, None), ("grant", None, None, None, None, None, "3", "a", "2", "500"), ("recall", None, None, None, None, None, "3", "a", "2", "380"),
]
_BOX_ROWS = [dict(zip(("name", "order_id", "symbol", "side", "price", "qty", "grp", "account", "asset", "amount"), (_q(x[0]), *x[1:]))) for x in _BOX]
LEDGER_OUTBOX = f"""
  SELECT shard, n * {MESSAGES} + k - 1 AS outbox_idx, {_inputs(_BOX_ROWS, {"name": "VARCHAR", "order_id": "BIGINT", "symbol": "BIGINT", "side": "VARCHAR", "price": "BIGINT", "qty": "BIGINT", "grp": "BIGINT", "account": "BIGINT", "asset": "BIGINT", "amount": "BIGINT"})}
  FROM (SELECT *, max(n) OVER (PARTITION BY shard) AS last FROM {LEDGER}) s CROSS JOIN {_steps(len(_BOX))} WHERE n = last"""


# --- credit slices: groups of events; n is the event's place in its group ---

SLICES = f"(SELECT event_id % 4 AS grp, CAST(row_number() OVER (PARTITION BY event_id % 4 ORDER BY event_id) - 1 AS BIGINT) AS n, {_PARTIES} FROM events) AS s"


def _slice_order(j: int) -> str:
    return f"(CAST(-9223372036854775807 AS BIGINT) - 1 + grp * {1 << 48} + n * 2 + {j})"


def _entry(cmd, outcome, reject=None, made=None, **fields):
    return {"cmd": _q(cmd), "outcome": _q(outcome), "reject": None if reject is None else _q(reject), "made": made} | fields


_BUY = {"account": "a", "symbol": "sym", "side": "'buy'", "price": "p", "qty": "q"}
_SLICE_STEPS = [
    _entry("grant", "granted", account="a", asset="2", amount="1000000"),
    _entry("grant", "granted", account="b", asset="base", amount="100000"),
    _entry("grant", "rejected", "bad_amount", account="b", asset="base", amount="0"),
    _entry("enter", "reserved", made=_slice_order(1), **_BUY),
    _entry("enter", "reserved", made=_slice_order(2), account="b", symbol="sym", side="'sell'", price="t", qty="q"),
    _entry("enter", "rejected", "insufficient", **(_BUY | {"price": "1000000000"})),
    _entry("cancel", "rejected", "not_owner", account="b", order_id=_slice_order(1)),
    _entry("settle", "settled", event="'trade'", buy=_slice_order(1), sell=_slice_order(2), price="t", qty="1", taker_is_buy="tib"),
    _entry("settle", "ignored", event="'trade'", buy=str((1 << 48) + 5), sell=str((1 << 48) + 6), price="t", qty="1", taker_is_buy="tib"),
    _entry("status", "unreported"),
    _entry("report", "reported"),
    _entry("status", "at rest"),
    _entry("cancel", "cancel_queued", account="a", order_id=_slice_order(1)),
    _entry("settle", "settled", event="'closed'", order_id=_slice_order(1)),
    _entry("settle", "settled", event="'closed'", order_id=_slice_order(2)),
    _entry("recall", "recalled", account="a", asset="2", amount="1000000000"),
    _entry("recall", "recalled", account="b", asset="base", amount="100"),
    _entry("recall", "recalled", account="a", asset="2", amount="5"),
    _entry("settle", "undecodable", event="'trade'", buy=_slice_order(1)),
    _entry("report", "reported"),
]
_SLICE_KINDS = {
    "cmd": "STRING", "account": "BIGINT", "asset": "BIGINT", "symbol": "BIGINT", "side": "STRING", "price": "BIGINT", "qty": "BIGINT", "amount": "BIGINT", "order_id": "BIGINT", "event": "STRING",
    "buy": "BIGINT", "sell": "BIGINT", "taker_is_buy": "BOOLEAN",
}
SLICE_ENTRIES = f"SELECT grp, e * 100 + k AS idx, {_inputs(_SLICE_STEPS, _SLICE_KINDS)} FROM {SLICES} CROSS JOIN {_steps(len(_SLICE_STEPS))}"
SLICE_OUTCOMES = f"""SELECT grp, e * 100 + k AS idx, {_inputs([{**r, "order_id": r["made"]} for r in _SLICE_STEPS], {"outcome": "VARCHAR", "reject": "VARCHAR", "order_id": "BIGINT"})} FROM {SLICES} CROSS JOIN {_steps(len(_SLICE_STEPS))}"""
#: The report (step 11) and the recalls (16, 17) send these.
_SENT = f"""
  SELECT grp, e, 11 AS k, 'slice_out' AS event, a AS account, 2 AS asset, t AS amount FROM {SLICES}
  UNION ALL SELECT grp, e, 11, 'slice_in', a, base, lot - lot * buy_ppm // 1000000 FROM {SLICES}
  UNION ALL SELECT grp, e, 11, 'slice_out', b, base, lot FROM {SLICES}
  UNION ALL SELECT grp, e, 11, 'slice_in', b, 2, t - t * sell_ppm // 1000000 FROM {SLICES}
  UNION ALL SELECT grp, e, 11, 'slice_fee', NULL, base, lot * buy_ppm // 1000000 FROM {SLICES} WHERE lot * buy_ppm // 1000000 > 0
  UNION ALL SELECT grp, e, 11, 'slice_fee', NULL, 2, t * sell_ppm // 1000000 FROM {SLICES} WHERE t * sell_ppm // 1000000 > 0
  UNION ALL SELECT grp, e, 16, 'returned', a, 2, 1000000 - t FROM {SLICES}
  UNION ALL SELECT grp, e, 17, 'returned', b, base, 100 FROM {SLICES}"""
SLICE_EVENTS = f"""SELECT grp, CAST(e * 100 + k AS BIGINT) AS idx, CAST(row_number() OVER (PARTITION BY grp, e, k ORDER BY account NULLS LAST, asset) - 1 AS INTEGER) AS ordinal, event, CAST(account AS BIGINT) AS account,
  CAST(asset AS BIGINT) AS asset, CAST(amount AS BIGINT) AS amount FROM ({_SENT})"""
SLICE_CREDIT = f"""
  SELECT grp, account, asset, CAST(free AS BIGINT) AS available, CAST(0 AS BIGINT) AS held, CAST(gained AS BIGINT) AS gained, CAST(given AS BIGINT) AS given FROM (
    SELECT grp, a AS account, CAST(2 AS BIGINT) AS asset, 0 AS free, 1000000 AS gained, 1000000 AS given FROM {SLICES}
    UNION ALL SELECT grp, a, CAST(base AS BIGINT), lot - lot * buy_ppm // 1000000, lot - lot * buy_ppm // 1000000, 0 FROM {SLICES}
    UNION ALL SELECT grp, b, CAST(base AS BIGINT), 100000 - lot - 100, 100000, lot + 100 FROM {SLICES}
    UNION ALL SELECT grp, b, CAST(2 AS BIGINT), t - t * sell_ppm // 1000000, t - t * sell_ppm // 1000000, 0 FROM {SLICES})"""
