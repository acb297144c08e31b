"""A price-time priority book as plain Python state (no Spark here).

Orders of a side are held by price level, each level an insertion-ordered dict of
order ids, with a heap of the side's prices from which emptied prices are dropped
when they reach the top. apply() takes one command and returns the events that it
causes; the book is the accumulator of an ordered fold over one symbol's commands.
"""

from __future__ import annotations

import heapq

from ..schemas import BOOK_CONFIG, CMD_CODES, OTYPE_CODES, SIDE_CODES, TIF_CODES


def decodable(c: dict) -> bool:
    """Whether a command names a known variant and holds that variant's fields."""
    if c["cmd"] not in CMD_CODES or c["order_id"] is None:
        return False
    if c["cmd"] == "new":
        return c["side"] in SIDE_CODES and c["otype"] in OTYPE_CODES and c["tif"] in TIF_CODES and c["qty"] is not None and (c["otype"] == "market" or c["price"] is not None)
    return c["cmd"] == "cancel" or (c["price"] is not None and c["qty"] is not None)


class Side:
    """One side: sign +1 for asks (least price first), -1 for bids (greatest first)."""

    def __init__(self, sign: int):
        self.sign, self.levels, self.totals, self.heap = sign, {}, {}, []

    def best(self):
        while self.heap and self.heap[0] * self.sign not in self.levels:
            heapq.heappop(self.heap)
        return self.heap[0] * self.sign if self.heap else None

    def reaches(self, price: int, limit: int | None) -> bool:
        """Whether an aggressor with this limit (None: any) trades at a level of this side."""
        return limit is None or self.sign * price <= self.sign * limit

    def add(self, order_id: int, price: int, qty: int) -> None:
        if price not in self.levels:
            self.levels[price], self.totals[price] = {}, 0
            heapq.heappush(self.heap, price * self.sign)
        self.levels[price][order_id] = None
        self.totals[price] += qty

    def take(self, order_id: int, price: int, qty: int, gone: bool) -> None:
        self.totals[price] -= qty
        if gone:
            del self.levels[price][order_id]
            if not self.levels[price]:
                del self.levels[price], self.totals[price]

    def available(self, limit: int | None, enough: int) -> bool:
        total = 0
        for price in sorted(self.levels, key=lambda p: p * self.sign):
            if total >= enough or not self.reaches(price, limit):
                break
            total += self.totals[price]
        return total >= enough

    def ordered(self):
        for price in sorted(self.levels, key=lambda p: p * self.sign):
            yield from self.levels[price]


class Book:
    def __init__(self, pmin=BOOK_CONFIG["pmin"], pmax=BOOK_CONFIG["pmax"], max_orders=BOOK_CONFIG["max_orders"], index=BOOK_CONFIG["index"], seq=0):
        self.pmin, self.pmax, self.max_orders, self.index = pmin, pmax, max_orders, index
        self.seq, self.sides = seq, {"bid": Side(-1), "ask": Side(1)}
        self.orders: dict[int, list] = {}  # id -> [side, price, qty, tif, otype]

    # events are (seq, ev, order_id, maker, taker, price, qty, leaves_qty, reason)
    def _emit(self, out, ev, order_id=None, maker=None, taker=None, price=None, qty=None, leaves=None, reason=None):
        self.seq += 1
        out.append((self.seq, ev, order_id, maker, taker, price, qty, leaves, reason))

    def price_ok(self, price) -> bool:
        if price is None:
            return False
        return price > 0 if self.index == "tree" else self.pmin <= price <= self.pmax

    def apply(self, cmd: dict) -> list[tuple]:
        """Events of one command. A command that can't be decoded (see decodable()) changes
        nothing and has no events."""
        return self.run(cmd) if decodable(cmd) else []

    def run(self, cmd: dict) -> list[tuple]:
        """Events of a command that is known to be decodable."""
        out: list[tuple] = []
        self.COMMANDS[cmd["cmd"]](self, cmd, out)
        return out

    def _reject(self, out, order_id, reason):
        self._emit(out, "rejected", order_id, reason=reason)

    def _new(self, c, out):
        oid, side, price, qty, limit = c["order_id"], c["side"], c["price"], c["qty"], c["otype"] == "limit"
        other = self.sides["ask" if side == "bid" else "bid"]
        if not qty:
            return self._reject(out, oid, "invalid_qty")
        if limit and not self.price_ok(price):
            return self._reject(out, oid, "invalid_price")
        if oid in self.orders:
            return self._reject(out, oid, "duplicate_order_id")
        if len(self.orders) >= self.max_orders:
            return self._reject(out, oid, "book_full")
        if limit and c["tif"] == "post_only" and other.best() is not None and other.reaches(other.best(), price):
            return self._reject(out, oid, "post_only_would_cross")
        if limit and c["tif"] == "fok" and not other.available(price, qty):
            return self._reject(out, oid, "fok_cannot_fill")
        left = self._cross(oid, other, price if limit else None, qty, out)
        if not left:
            self._emit(out, "closed", oid, reason="filled")
        elif limit and c["tif"] in ("gtc", "post_only"):
            self.rest(oid, side, price, left, c["tif"], c["otype"])
            self._emit(out, "accepted", oid, leaves=left)
        else:
            self._emit(out, "closed", oid, reason="expired")

    def _cancel(self, c, out):
        o = self.orders.pop(c["order_id"], None)
        if o is None:
            return self._reject(out, c["order_id"], "unknown_order_id")
        self.sides[o[0]].take(c["order_id"], o[1], o[2], True)
        self._emit(out, "closed", c["order_id"], reason="cancelled")

    def _replace(self, c, out):
        oid, price, qty = c["order_id"], c["price"], c["qty"]
        o = self.orders.get(oid)
        if o is None:
            return self._reject(out, oid, "unknown_order_id")
        if not qty:
            return self._reject(out, oid, "invalid_qty")
        if not self.price_ok(price):
            return self._reject(out, oid, "invalid_price")
        own = self.sides[o[0]]
        if price == o[1] and qty <= o[2]:  # keeps its place
            own.take(oid, price, o[2] - qty, False)
            o[2] = qty
            return self._emit(out, "replaced", oid, price=price, qty=qty)
        del self.orders[oid]
        own.take(oid, o[1], o[2], True)
        left = self._cross(oid, self.sides["ask" if o[0] == "bid" else "bid"], price, qty, out)
        if left:
            self.rest(oid, o[0], price, left, o[3], o[4])
            self._emit(out, "replaced", oid, price=price, qty=left)
        else:
            self._emit(out, "closed", oid, reason="filled")

    def _cross(self, taker, other: Side, limit, qty, out) -> int:
        while qty:
            price = other.best()
            if price is None or not other.reaches(price, limit):
                break
            maker = next(iter(other.levels[price]))
            m = self.orders[maker]
            n = min(qty, m[2])
            qty -= n
            m[2] -= n
            other.take(maker, price, n, m[2] == 0)
            self._emit(out, "trade", maker=maker, taker=taker, price=price, qty=n)
            if m[2] == 0:
                del self.orders[maker]
                self._emit(out, "closed", maker, reason="filled")
        return qty

    def rest(self, oid, side, price, qty, tif, otype="limit"):
        """Appends a resting order at the tail of its level, without matching (also: restore)."""
        self.orders[oid] = [side, price, qty, tif, otype]
        self.sides[side].add(oid, price, qty)

    COMMANDS = {"new": _new, "cancel": _cancel, "replace": _replace}

    def resting(self):
        """(side, order_id, otype, tif, price, qty) in book order: bids, then asks, best first."""
        for side in ("bid", "ask"):
            for oid in self.sides[side].ordered():
                _, price, qty, tif, otype = self.orders[oid]
                yield side, oid, otype, tif, price, qty

    def problems(self) -> list[str]:
        """Broken invariants of the state; empty for a sound book."""
        out = []
        for name, side in self.sides.items():
            for price, ids in side.levels.items():
                if not ids or side.totals[price] != sum(self.orders[i][2] for i in ids):
                    out.append(f"total of {name} {price}")
                out += [f"order {i}" for i in ids if self.orders.get(i, [None] * 3)[:2] != [name, price] or self.orders[i][2] <= 0]
        if sum(len(x) for s in self.sides.values() for x in s.levels.values()) != len(self.orders):
            out.append("count")
        bid, ask = self.sides["bid"].best(), self.sides["ask"].best()
        if bid is not None and ask is not None and bid >= ask:
            out.append("crossed")
        return out
