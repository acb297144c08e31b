"""Schemas of the engine's tables (DDL strings) and the code tables of its enums.

A NULL means that a field does not belong to a row's variant. Ids and quantities are
longs; ids from 2^63 on are held as their two's complement.
"""

from __future__ import annotations

COMMANDS = "iseq long, symbol long, cmd string, order_id long, side string, otype string, price long, qty long, tif string"
EVENTS = "symbol long, iseq long, ordinal int, seq long, ev string, order_id long, maker long, taker long, price long, qty long, leaves_qty long, reason string"
RESTING = "symbol long, side string, book_pos long, order_id long, otype string, tif string, price long, qty long"
BOOKS = "symbol long, seq long"

# Codes of the binary records and of the digest, by token in code order.
CMD_CODES = {"new": 1, "cancel": 2, "replace": 3}
SIDE_CODES = {"bid": 0, "ask": 1}
OTYPE_CODES = {"limit": 0, "market": 1}
TIF_CODES = {"gtc": 0, "ioc": 1, "fok": 2, "post_only": 3}
EV_CODES = {"accepted": 1, "rejected": 2, "trade": 3, "closed": 4, "replaced": 5}
REJECT_REASONS = ["invalid_qty", "invalid_price", "duplicate_order_id", "unknown_order_id", "post_only_would_cross", "fok_cannot_fill", "book_full"]
CLOSE_REASONS = ["filled", "cancelled", "expired"]
# A book's default configuration.
BOOK_CONFIG = {"pmin": 0, "pmax": 1_000_000, "max_orders": 65_536, "index": "ladder"}


def names(ddl: str) -> list[str]:
    return [x.split()[0] for x in ddl.split(", ")]
