"""A multi-asset balance ledger as keyed state, and its fold over ordered commands.

Money lives in counters: `free` and `held` by (account, asset), `lent` by (account, asset,
group), `flow` by (name, asset) and `group_flow` by (name, asset, group). Every command is a
method that either refuses with a reason and changes nothing, or changes the counters so that
the identities of violations() go on holding. Ids of a shard carry it in their upper bits.
"""

from __future__ import annotations

from collections import Counter, deque
from itertools import chain

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .fold import fold

# Bits of an order id below its shard, the bit of a slice's shard, the fee pool's
# account, the largest amount, parts per million, kept adjustments.
SHARD_BITS, SLICE_BIT, FEE_ACCOUNT, MOST, PPM, ADJUSTMENTS = 48, 0x8000, (1 << 64) - 1, (1 << 128) - 1, 1_000_000, 256

CMDS = (
    "shard long, lsn long, cmd string, account long, asset long, symbol long, side string, price long, qty long, amount decimal(38,0), external_id long, paid boolean, "
    "source long, prev long, idx long, event string, buy long, sell long, taker_is_buy boolean, order_id long, upto long, now_ns long, max_age_ns long, retry_ns long, "
    "max int, credit boolean, reason int, grp long, ts_ns long"
)
ROWS = (
    "shard long, lsn long, rec string, outcome string, reject string, order_id long, outbox_idx long, queued int, account long, asset long, grp long, name string, "
    "amount decimal(38,0), held decimal(38,0), symbol long, side string, price long, qty long, cancelling boolean, born long, cancel_at long"
)
_FIELDS = [x.split()[0] for x in ROWS.split(", ")]


class Refused(Exception):
    """A command's reason for changing nothing."""


def fee_of(amount: int, ppm: int) -> int:
    return amount * ppm // PPM


def need(ok: bool, reason: str) -> None:
    if not ok:
        raise Refused(reason)


def config_problems(shard: int, symbols: dict, default_ppm: int) -> list[str]:
    out = [] if 0 <= shard < SLICE_BIT else ["shard"]
    out += [] if 0 <= default_ppm <= PPM else ["default fee"]
    for s, c in symbols.items():
        if c["lot"] == 0:
            out.append(f"lot of {s}")
        if c["base"] == c["quote"]:
            out.append(f"assets of {s}")
        if any(f is not None and f > PPM for f in (c.get("maker_ppm"), c.get("taker_ppm"))):
            out.append(f"fee of {s}")
    return out


class Lent(Counter):
    """Amounts by (account, asset, group) that keep their sums over the groups in step."""

    def __init__(self):
        self.all_groups = Counter()
        super().__init__()

    def __setitem__(self, key, amount):
        self.all_groups[key[:2]] += amount - self[key]
        super().__setitem__(key, amount)

    def __reduce__(self):
        return _lent, (dict(self),)


def _lent(amounts: dict) -> Lent:
    out = Lent()
    for key, amount in amounts.items():
        out[key] = amount
    return out


class Ledger:
    def __init__(self, shard: int, symbols: dict[int, dict], default_ppm: int = 0):
        self.shard, self.symbols, self.default_ppm = shard, symbols, default_ppm
        self.free, self.held, self.lent, self.flow, self.group_flow = Counter(), Counter(), Lent(), Counter(), Counter()
        self.orders: dict[int, dict] = {}
        self.ids: dict[str, set] = {"deposit": set(), "withdraw": set(), "adjust": set()}
        self.pending: dict[int, tuple] = {}
        self.marks = Counter()
        self.outbox: deque = deque()
        self.outbox_base, self.next_order, self.clock, self.anomalies = 0, 1, 0, 0
        self.adjustments: deque = deque(maxlen=ADJUSTMENTS)

    # --- parts shared by commands ---

    def fees(self, asset):
        return self.flow["fees", asset]

    def _room(self, amount, *totals):
        need(all(t + amount <= MOST for t in totals), "overflow")

    def _push(self, kind, **fields) -> int:
        self.outbox.append({"kind": kind} | fields)
        return self.outbox_base + len(self.outbox) - 1

    def _hold_asset(self, o):
        return self.symbols[o["symbol"]]["quote" if o["side"] == "buy" else "base"]

    def _release(self, order_id):
        o = self.orders.pop(order_id)
        key = (o["account"], self._hold_asset(o))
        self.held[key] -= o["held"]
        self.free[key] += o["held"]

    def _rate(self, symbol, taker: bool):
        own = self.symbols[symbol].get("taker_ppm" if taker else "maker_ppm")
        return self.default_ppm if own is None else own

    # --- one method per command: returns (outcome, fields) or raises Refused ---

    def deposit(self, c):
        a, key = c["amount"], (c["account"], c["asset"])
        need(a > 0, "bad_amount")
        if c["external_id"] in self.ids["deposit"]:
            return "duplicate", {}
        self._room(a, self.free[key], self.flow["deposited", c["asset"]])
        self.ids["deposit"].add(c["external_id"])
        self.free[key] += a
        self.flow["deposited", c["asset"]] += a
        return "deposited", {}

    def reserve(self, c, kind="submit"):
        sym = self.symbols.get(c["symbol"])
        need(sym is not None, "unknown_symbol")
        need(c["qty"] > 0, "bad_quantity")
        need(c["price"] > 0, "bad_price")
        need(self.next_order < 1 << SHARD_BITS, "overflow")
        buy = c["side"] == "buy"
        amount = (c["price"] if buy else sym["lot"]) * c["qty"]
        need(amount <= MOST, "overflow")
        key = (c["account"], sym["quote"] if buy else sym["base"])
        need(self.free[key] >= amount, "insufficient")
        oid = self.shard << SHARD_BITS | self.next_order
        self.next_order += 1
        self.free[key] -= amount
        self.held[key] += amount
        self.orders[oid] = {"account": c["account"], "symbol": c["symbol"], "side": c["side"], "price": c["price"], "remaining": c["qty"], "held": amount, "cancelling": False, "born": self.clock, "cancel_at": 0}
        return "reserved", {"order_id": oid, "outbox_idx": self._push(kind, order=oid, symbol=c["symbol"], side=c["side"], price=c["price"], qty=c["qty"])}

    def reserve_ioc(self, c):
        return self.reserve(c, "submit_ioc")

    def cancel(self, c):
        o = self.orders.get(c["order_id"])
        need(o is not None, "unknown_order")
        need(o["account"] == c["account"], "not_owner")
        need(not o["cancelling"], "already_cancelling")
        return "cancel_queued", {"outbox_idx": self._queue_cancel(c["order_id"])}

    def _queue_cancel(self, oid):
        o = self.orders[oid]
        o["cancelling"], o["cancel_at"] = True, self.clock
        return self._push("cancel", order=oid, symbol=o["symbol"])

    def withdraw(self, c):
        need(c["amount"] > 0, "bad_amount")
        need(c["external_id"] not in self.ids["withdraw"], "duplicate_id")
        key = (c["account"], c["asset"])
        need(self.free[key] >= c["amount"], "insufficient")
        self.free[key] -= c["amount"]
        return self._withheld(c, c["account"])

    def fee_withdraw(self, c):
        need(c["amount"] > 0, "bad_amount")
        need(c["external_id"] not in self.ids["withdraw"], "duplicate_id")
        need(self.fees(c["asset"]) >= c["amount"], "insufficient")
        self.flow["fees", c["asset"]] -= c["amount"]
        return self._withheld(c, FEE_ACCOUNT)

    def _withheld(self, c, account):
        self.ids["withdraw"].add(c["external_id"])
        self.pending[c["external_id"]] = (account, c["asset"], c["amount"])
        return "withdraw_held", {}

    def finalize(self, c):
        if c["external_id"] not in self.pending:
            need(c["external_id"] in self.ids["withdraw"], "unknown_id")
            return "duplicate", {}
        account, asset, amount = self.pending.pop(c["external_id"])
        if c["paid"]:
            self.flow["withdrawn", asset] += amount
        elif account == FEE_ACCOUNT:
            self.flow["fees", asset] += amount
        else:
            self.free[account, asset] += amount
        return "withdraw_done", {}

    def adjust(self, c):
        need(c["amount"] > 0, "bad_amount")
        if c["external_id"] in self.ids["adjust"]:
            return "duplicate", {}
        key, name = (c["account"], c["asset"]), "adjusted_in" if c["credit"] else "adjusted_out"
        if c["credit"]:
            self._room(c["amount"], self.free[key], self.flow[name, c["asset"]])
        else:
            need(self.free[key] >= c["amount"], "insufficient")
        self.free[key] += c["amount"] if c["credit"] else -c["amount"]
        self.flow[name, c["asset"]] += c["amount"]
        self.ids["adjust"].add(c["external_id"])
        self.adjustments.append((c["external_id"], *key, c["credit"], c["amount"], c["reason"]))
        return "adjusted", {}

    def outbox_ack(self, c):
        while self.outbox and self.outbox_base < c["upto"]:
            self.outbox.popleft()
            self.outbox_base += 1
        return "acked", {}

    def clock_tick(self, c):
        self.clock = max(self.clock, c["now_ns"])
        return "ticked", {}

    def sweep(self, c):
        now, most = self.clock, c["max"]
        again = sorted((o["cancel_at"], i) for i, o in self.orders.items() if o["cancelling"] and o["cancel_at"] <= now - c["retry_ns"]) if c["retry_ns"] > 0 else []
        old = sorted((o["born"], i) for i, o in self.orders.items() if not o["cancelling"] and o["born"] <= now - c["max_age_ns"])
        todo = [i for _, i in (again + old)[:most]]
        for i in todo:
            self._queue_cancel(i)
        return "swept", {"queued": len(todo)}

    def lend(self, c):
        g, a, key = c["grp"], c["amount"], (c["account"], c["asset"])
        need(g < SLICE_BIT, "bad_group")
        need(a > 0, "bad_amount")
        need(self.free[key] >= a, "insufficient")
        self._room(a, self.lent_of(*key), self.flow["lent_granted", c["asset"]], self.lent[(*key, g)], self.group_flow["granted", c["asset"], g])
        self.free[key] -= a
        self.lent[(*key, g)] += a
        self.flow["lent_granted", c["asset"]] += a
        self.group_flow["granted", c["asset"], g] += a
        return "lent", {"outbox_idx": self._push("grant", group=g, account=c["account"], asset=c["asset"], amount=a)}

    def recall(self, c):
        need(c["grp"] < SLICE_BIT, "bad_group")
        need(c["amount"] > 0, "bad_amount")
        have = self.lent[c["account"], c["asset"], c["grp"]]
        need(have > 0, "insufficient")
        return "recall_queued", {"outbox_idx": self._push("recall", group=c["grp"], account=c["account"], asset=c["asset"], amount=min(c["amount"], have))}

    def lent_of(self, account, asset):
        return self.lent.all_groups[account, asset]

    def settle(self, c):
        mark = self.marks[c["source"]]
        if c["idx"] <= mark:
            return "duplicate", {}
        need(c["prev"] == mark and c["idx"] > c["prev"], "gap")
        ok = self.EVENTS[c["event"]][0](self, c)
        self.marks[c["source"]] = c["idx"]  # also after an anomaly: a replay must not try it again
        return ("settled", {}) if ok else self.anomaly()

    def anomaly(self):
        self.anomalies += 1
        return "anomaly", {}

    # --- settled events: False is an anomaly that changed nothing ---

    def local(self, order_id):
        return (order_id % (1 << 64)) >> SHARD_BITS == self.shard

    def _side_ok(self, oid, side, c):
        o = self.orders.get(oid)
        return o is not None and o["side"] == side and 0 < c["qty"] <= o["remaining"] and (c["price"] <= o["price"] if side == "buy" else c["price"] >= o["price"])

    def _on_trade(self, c):
        sides = [(i, s) for i, s in ((c["buy"], "buy"), (c["sell"], "sell")) if self.local(i)]
        if not sides or c["buy"] == c["sell"] or not all(self._side_ok(i, s, c) for i, s in sides):
            return False
        terms = [{k: self.symbols[self.orders[i]["symbol"]][k] for k in ("base", "quote", "lot")} for i, _ in sides]
        if any(t != terms[0] for t in terms):
            return False
        base, quote, lot = terms[0]["base"], terms[0]["quote"], terms[0]["lot"]
        money, goods = c["price"] * c["qty"], lot * c["qty"]
        for i, side in sides:
            o = self.orders[i]
            buy, who = side == "buy", o["account"]
            gives, gave, gets, got = (quote, money, base, goods) if buy else (base, goods, quote, money)
            used = o["price"] * c["qty"] if buy else goods
            fee = fee_of(got, self._rate(o["symbol"], c["taker_is_buy"] == buy))
            self.held[who, gives] -= used
            self.free[who, gives] += used - gave
            self.free[who, gets] += got - fee
            self.flow["fees", gets] += fee
            self.flow["settled_out", gives] += gave
            self.flow["settled_in", gets] += got
            o["remaining"] -= c["qty"]
            o["held"] -= used
            if not o["remaining"]:
                self._release(i)
        return True

    def _on_closed(self, c):
        if not self.local(c["order_id"]) or c["order_id"] not in self.orders:
            return False
        self._release(c["order_id"])
        return True

    def _on_slice_in(self, c):
        key, a = (c["account"], c["asset"], c["grp"]), c["amount"]
        if c["grp"] >= SLICE_BIT or a == 0 or c["account"] in (FEE_ACCOUNT, -1) or max(self.lent[key], self.group_flow["slice_in", c["asset"], c["grp"]]) + a > MOST:
            return False
        self.lent[key] += a
        self._moved("slice_in", "settled_in", c)
        return True

    def _on_slice_out(self, c):
        if not self._take_lent(c):
            return False
        self._moved("slice_out", "settled_out", c)
        return True

    def _moved(self, name, total, c):
        self.flow[name, c["asset"]] += c["amount"]
        self.group_flow[name, c["asset"], c["grp"]] += c["amount"]
        self.flow[total, c["asset"]] += c["amount"]

    def _take_lent(self, c):
        key = (c["account"], c["asset"], c["grp"])
        if c["grp"] >= SLICE_BIT or c["amount"] == 0 or self.lent[key] < c["amount"]:
            return False
        self.lent[key] -= c["amount"]
        return True

    def _on_slice_fee(self, c):
        self.flow["fees", c["asset"]] += c["amount"]
        self.flow["settled_in", c["asset"]] += c["amount"]
        return c["amount"] > 0

    def _on_returned(self, c):
        if not self._take_lent(c):
            return False
        self.free[c["account"], c["asset"]] += c["amount"]
        self.flow["lent_returned", c["asset"]] += c["amount"]
        self.group_flow["returned", c["asset"], c["grp"]] += c["amount"]
        return True

    # --- entry points ---

    #: Commands that name an account, which must not be the fee pool's.
    USER = {"deposit", "reserve", "reserve_ioc", "withdraw", "adjust", "lend", "recall"}
    #: command -> its method and the fields that it can't do without.
    COMMANDS = {
        "deposit": (deposit, "account asset amount external_id"), "reserve": (reserve, "account symbol side price qty"), "reserve_ioc": (reserve_ioc, "account symbol side price qty"),
        "cancel": (cancel, "account order_id"), "withdraw": (withdraw, "account asset amount external_id"), "fee_withdraw": (fee_withdraw, "asset amount external_id"),
        "finalize": (finalize, "external_id paid"), "adjust": (adjust, "account asset amount credit external_id"), "outbox_ack": (outbox_ack, "upto"), "clock": (clock_tick, "now_ns"),
        "sweep": (sweep, "max_age_ns retry_ns max"), "lend": (lend, "grp account asset amount"), "recall": (recall, "grp account asset amount"), "settle": (settle, "source prev idx event"),
    }
    #: settled event -> the same.
    EVENTS = {
        "trade": (_on_trade, "buy sell price qty taker_is_buy"), "closed": (_on_closed, "order_id"), "slice_in": (_on_slice_in, "grp account asset amount"),
        "slice_out": (_on_slice_out, "grp account asset amount"), "slice_fee": (_on_slice_fee, "asset amount"), "returned": (_on_returned, "grp account asset amount"),
    }

    #: The fields of a command, and of a settled event under its name in a tuple.
    FIELDS = {k: tuple(v[1].split()) for k, v in COMMANDS.items()} | {(k,): tuple(v[1].split()) for k, v in EVENTS.items()}

    def decodable(self, c: dict) -> bool:
        """Whether a command is known and holds its fields, and its side and event are known ones."""
        fields = self.FIELDS.get(c["cmd"])
        if fields is None:
            return False
        for f in fields:
            if c.get(f) is None:
                return False
        if c["cmd"] == "settle":
            return c["event"] in self.EVENTS and all(c.get(f) is not None for f in self.FIELDS[c["event"],])
        return c.get("side") in ("buy", "sell") if "side" in fields else True

    def apply(self, c: dict) -> tuple[str, str | None, dict]:
        """(outcome, reason of a refusal, other fields). What can't be decoded is an anomaly."""
        if not self.decodable(c):
            return (*self.anomaly()[:1], None, {})
        try:
            need(c["cmd"] not in self.USER or c["account"] not in (FEE_ACCOUNT, -1), "reserved_account")
            if c.get("ts_ns") is not None:
                self.clock = max(self.clock, c["ts_ns"])
            outcome, fields = self.COMMANDS[c["cmd"]][0](self, c)
            return outcome, None, fields
        except Refused as e:
            return "rejected", str(e), {}

    def holdings(self, asset):
        own = sum(v for (_, a), v in self.free.items() if a == asset) + sum(v for (_, a), v in self.held.items() if a == asset)
        return own + self.fees(asset) + sum(p[2] for p in self.pending.values() if p[1] == asset) + sum(v for (_, a, _), v in self.lent.items() if a == asset)

    def violations_of_holds(self) -> list[str]:
        """Orders hold exactly what they need, balances what their orders hold."""
        out, held = [], Counter()
        for i, o in self.orders.items():
            want = (o["price"] if o["side"] == "buy" else self.symbols[o["symbol"]]["lot"]) * o["remaining"]
            out += [f"hold of {i}"] * (o["held"] != want) + [f"empty {i}"] * (o["remaining"] <= 0) + [f"foreign {i}"] * (not self.local(i))
            held[o["account"], self._hold_asset(o)] += o["held"]
        return out + [f"held of {k}" for k in sorted({*held, *self.held}) if held[k] != self.held[k]]

    def violations(self) -> list[str]:
        out = self.violations_of_holds()
        f, g = self.flow, self.group_flow
        assets = {k[1] for k in (*self.free, *self.held, *f)} | {k[1] for k in self.lent}
        for a in sorted(assets):
            if self.holdings(a) + f["withdrawn", a] + f["settled_out", a] + f["adjusted_out", a] != f["deposited", a] + f["settled_in", a] + f["adjusted_in", a]:
                out.append(f"conservation of {a}")
            for grp in {k[2] for k in (*g, *self.lent) if k[1] == a}:
                lent = sum(v for (_, s, x), v in self.lent.items() if (s, x) == (a, grp))
                if lent + g["returned", a, grp] + g["slice_out", a, grp] != g["granted", a, grp] + g["slice_in", a, grp]:
                    out.append(f"group flow of {a} {grp}")
        return out + ["anomalies"] * bool(self.anomalies)

    def export(self):
        """State rows as dicts of ROWS' columns."""
        for (account, asset) in sorted({*self.free, *self.held}):
            yield {"rec": "balance", "account": account, "asset": asset, "amount": self.free[account, asset], "held": self.held[account, asset]}
        for i, o in self.orders.items():
            yield {"rec": "order", "order_id": i, "account": o["account"], "symbol": o["symbol"], "side": o["side"], "price": o["price"], "qty": o["remaining"], "held": o["held"], "cancelling": o["cancelling"], "born": o["born"], "cancel_at": o["cancel_at"]}
        for (name, asset), v in self.flow.items():
            yield {"rec": "flow", "name": name, "asset": asset, "amount": v}
        for (name, asset, g), v in self.group_flow.items():
            yield {"rec": "group_flow", "name": name, "asset": asset, "grp": g, "amount": v}
        for (account, asset, g), v in self.lent.items():
            yield {"rec": "lent", "account": account, "asset": asset, "grp": g, "amount": v}
        for i, (account, asset, amount) in self.pending.items():
            yield {"rec": "pending", "order_id": i, "account": -1 if account == FEE_ACCOUNT else account, "asset": asset, "amount": amount}
        for source, hw in self.marks.items():
            yield {"rec": "mark", "grp": source, "outbox_idx": hw}
        for k, m in enumerate(self.outbox):
            yield {"rec": "outbox", "outbox_idx": self.outbox_base + k, "name": m["kind"], "order_id": m.get("order"), "symbol": m.get("symbol"), "side": m.get("side"), "price": m.get("price"), "qty": m.get("qty"), "grp": m.get("group"), "account": m.get("account"), "asset": m.get("asset"), "amount": m.get("amount")}
        for name, ids in self.ids.items():
            yield from ({"rec": "id", "name": name, "order_id": i} for i in ids)
        for k, (external_id, account, asset, credit, amount, reason) in enumerate(self.adjustments):
            yield {"rec": "adjustment", "outbox_idx": k, "order_id": external_id, "account": account, "asset": asset, "cancelling": credit, "amount": amount, "queued": reason}
        yield {"rec": "state", "outbox_idx": self.outbox_base, "born": self.clock, "queued": self.anomalies, "qty": len(self.orders), "order_id": self.next_order}

    def take_in(self, r: dict) -> None:
        """One row of export() into this ledger; outbox and adjustment rows in order, the state row last."""
        rec, key = r["rec"], (r["account"], r["asset"])
        amount = None if r["amount"] is None else int(r["amount"])
        if rec == "balance":
            self.free[key], self.held[key] = amount, int(r["held"])
        elif rec == "order":
            self.orders[r["order_id"]] = {"account": r["account"], "symbol": r["symbol"], "side": r["side"], "price": r["price"], "remaining": r["qty"], "held": int(r["held"]), "cancelling": r["cancelling"], "born": r["born"], "cancel_at": r["cancel_at"]}
        elif rec == "flow":
            self.flow[r["name"], r["asset"]] = amount
        elif rec == "group_flow":
            self.group_flow[r["name"], r["asset"], r["grp"]] = amount
        elif rec == "lent":
            self.lent[(*key, r["grp"])] = amount
        elif rec == "pending":
            self.pending[r["order_id"]] = (FEE_ACCOUNT if r["account"] == -1 else r["account"], r["asset"], amount)
        elif rec == "mark":
            self.marks[r["grp"]] = r["outbox_idx"]
        elif rec == "outbox":
            message = {"kind": r["name"], "order": r["order_id"], "symbol": r["symbol"], "side": r["side"], "price": r["price"], "qty": r["qty"], "group": r["grp"], "account": r["account"], "asset": r["asset"], "amount": amount}
            self.outbox.append({k: v for k, v in message.items() if v is not None})
        elif rec == "id":
            self.ids[r["name"]].add(r["order_id"])
        elif rec == "adjustment":
            self.adjustments.append((r["order_id"], *key, r["cancelling"], amount, r["queued"]))
        elif rec == "state":
            self.outbox_base, self.clock, self.anomalies, self.next_order = r["outbox_idx"], r["born"], r["queued"], r["order_id"]


def run_ledger(cmds: DataFrame, symbols: dict[int, dict], default_ppm: int = 0, state: bool = True) -> DataFrame:
    """ROWS: an `outcome` row per command and, with `state`, the state after the last.

    `symbols` is the exchange's reference data: base, quote, lot and own fees of each symbol.
    A money column is an exact decimal; amounts beyond 38 digits fail the job rather than wrap.
    """


    def step(shard, rows):
        _refuse(config_problems(shard, symbols, default_ppm))
        ledger = Ledger(shard, symbols, default_ppm)
        yield from _applied(ledger, rows)
        if state:
            yield from _exported(ledger)

    return fold(cmds, "shard", ["lsn"], step, ROWS, [x.split()[0] for x in CMDS.split(", ")])


def _refuse(problems: list[str]) -> None:
    if problems:
        raise ValueError("refused: " + ", ".join(problems[:5]))


def _applied(ledger: Ledger, rows):
    shard, rest = ledger.shard, (None,) * (len(_FIELDS) - 8)
    for r in rows:
        if r["amount"] is not None:
            r["amount"] = int(r["amount"])
        outcome, reason, fields = ledger.apply(r)
        of = fields.get
        yield (shard, r["lsn"], "outcome", outcome, reason, of("order_id"), of("outbox_idx"), of("queued"), *rest)


def _exported(ledger: Ledger):
    for out in ledger.export():
        yield tuple(({"shard": ledger.shard} | out).get(f) for f in _FIELDS)


def resume_ledger(state: DataFrame, cmds: DataFrame, symbols: dict[int, dict], default_ppm: int = 0) -> DataFrame:
    """ROWS of a run that goes on from the exported state of run_ledger(). A state that breaks an
    identity (its count of anomalies aside), or whose orders are another shard's, is refused: the job fails.

    State rows and commands meet in one stream per shard: the state in an order that rebuilds
    it, then the commands by lsn."""
    width = [x.split(" ", 1) for x in CMDS.split(", ")]
    nil = lambda t: F.lit(None).cast(t)
    kept = state.filter("rec <> 'outcome'").select("shard", F.lit(0).alias("stage"), F.when(F.col("rec") == "state", 2).when(F.col("rec").isin("outbox", "adjustment"), 1).otherwise(0).alias("turn"), F.col("outbox_idx").alias("place"), F.struct(*[x for x in _FIELDS if x != "shard"]).alias("s"), nil("struct<" + ",".join(f"{n}:{'bigint' if t == 'long' else t}" for n, t in width if n != "shard") + ">").alias("c"))
    late = cmds.select("shard", F.lit(1).alias("stage"), F.lit(0).alias("turn"), F.col("lsn").alias("place"), nil(kept.schema["s"].dataType).alias("s"), F.struct(*[F.col(n) for n, _ in width if n != "shard"]).cast(kept.schema["c"].dataType).alias("c"))

    def step(shard, rows):
        ledger = Ledger(shard, symbols, default_ppm)
        rest = iter(rows)
        first = None
        for r in rest:
            if r["stage"]:
                first = r
                break
            ledger.take_in(r["s"])
        counted, ledger.anomalies = ledger.anomalies, 0
        _refuse(config_problems(shard, symbols, default_ppm) + ledger.violations())
        ledger.anomalies = counted
        if first is not None:
            yield from _applied(ledger, (r["c"] for r in chain([first], rest)))
        yield from _exported(ledger)

    return fold(kept.unionByName(late), "shard", ["stage", "turn", "place"], step, ROWS)
