"""Matching: commands of each symbol, in order, through its core (a Book unless another is given).

A core is a class whose instances are one symbol's state: `seq`, apply(command) -> events,
resting() and rest(...) as Book has them. Its constructor takes the configuration.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..schemas import CMD_CODES, COMMANDS, EVENTS, OTYPE_CODES, RESTING, SIDE_CODES, TIF_CODES, names
from .book import Book
from .fold import fold

#: Rows of match_with_state(): events, then one `book` row and `order` rows of the state.
STATE = EVENTS + ", rec string, side string, otype string, tif string, book_pos long"


class EchoCore:
    """The core that validates nothing and keeps no orders: one event per command, densely numbered."""

    def __init__(self, **config):
        self.seq = 0

    def apply(self, c: dict) -> list[tuple]:
        ev = {"new": "accepted", "cancel": "closed", "replace": "replaced"}.get(c["cmd"])
        if ev is None:
            return []
        self.seq += 1
        changed = c["cmd"] == "replace"
        return [(self.seq, ev, c["order_id"], None, None, c["price"] if changed else None, c["qty"] if changed else None, c["qty"] if ev == "accepted" else None, "cancelled" if ev == "closed" else None)]

    def rest(self, *order):
        """Nothing rests."""

    def resting(self):
        return ()


def _state_rows(symbol, core):
    yield (symbol, None, None, core.seq, *[None] * 8, "book", *[None] * 4)
    for pos, (side, oid, otype, tif, price, qty) in enumerate(core.resting()):
        yield (symbol, None, None, None, None, oid, None, None, price, qty, None, None, "order", side, otype, tif, pos)


def _run(config: dict, per_symbol: dict, state: bool, make):
    def step(symbol, rows):
        core = make(**(config | per_symbol.get(symbol, {})))
        apply = getattr(core, "run", core.apply)  # the rows are decodable
        for r in rows:
            if r["cmd"] is None:
                continue
            for i, event in enumerate(apply(r)):
                row = (symbol, r["iseq"], i, *event)
                yield row + (None,) * 5 if state else row
        if state:
            yield from _state_rows(symbol, core)

    return step


def match(commands: DataFrame, config: dict | None = None, per_symbol: dict | None = None, core=Book) -> DataFrame:
    """Events of all books. Each symbol has one core with `config`, or its entry of
    `per_symbol`; results do not depend on partitions, batches or task order. Commands that
    can't be decoded have no events: see undecodable()."""
    return fold(commands.filter(_decodable()), "symbol", ["iseq"], _run(config or {}, per_symbol or {}, False, core), EVENTS, names(COMMANDS))


def match_with_state(commands: DataFrame, config: dict | None = None, per_symbol: dict | None = None, core=Book) -> DataFrame:
    """STATE rows: events (rec null) and the books' state after the last command."""
    # a symbol whose every command is passed over still has a book, so its rows stay and have no command
    rows = commands.withColumn("cmd", F.when(_decodable(), F.col("cmd")))
    return fold(rows, "symbol", ["iseq"], _run(config or {}, per_symbol or {}, True, core), STATE, names(COMMANDS))


def undecodable(commands: DataFrame) -> DataFrame:
    """The commands that a book passes over: an unknown variant, or a field or token of it missing."""
    return commands.filter(~_decodable())


def _decodable():
    known = lambda c, t: F.coalesce(F.col(c).isin(*t), F.lit(False))
    sized = F.col("qty").isNotNull() & F.col("price").isNotNull()
    new = known("side", SIDE_CODES) & known("otype", OTYPE_CODES) & known("tif", TIF_CODES) & F.col("qty").isNotNull() & ((F.col("otype") == "market") | F.col("price").isNotNull())
    fields = F.when(F.col("cmd") == "new", new).when(F.col("cmd") == "replace", sized).otherwise(True)
    return known("cmd", CMD_CODES) & F.col("order_id").isNotNull() & fields


def events_of(state: DataFrame) -> DataFrame:
    return state.filter("rec is null").select(*names(EVENTS))


def books_of(state: DataFrame) -> DataFrame:
    return state.filter("rec = 'book'").select("symbol", "seq")


def resting_of(state: DataFrame) -> DataFrame:
    return state.filter("rec = 'order'").select(*names(RESTING))


def restore_commands(snapshot_orders: DataFrame) -> DataFrame:
    """Snapshot orders as rows that resume() reads before any command."""
    return snapshot_orders.select(
        F.lit(None).cast("long").alias("iseq"), "symbol", F.lit("rest").alias("cmd"), "order_id", "side", "otype", "price", "qty", "tif", F.col("book_pos").alias("pos"), F.lit(None).cast("long").alias("seq"),
    )


def resume(books: DataFrame, orders: DataFrame, commands: DataFrame, config: dict | None = None, core=Book) -> DataFrame:
    """STATE rows of a run that goes on from a snapshot: its orders rest in book order,
    each book's sequence is resumed, then the commands are applied."""
    cfg = config or {}

    def step(symbol, rows):
        book = core(**cfg)
        for r in rows:
            if r["cmd"] == "book":
                book.seq = r["seq"]
            elif r["cmd"] == "rest":
                book.rest(r["order_id"], r["side"], r["price"], r["qty"], r["tif"], r["otype"])
            else:
                for i, event in enumerate(book.apply(r)):
                    yield (symbol, r["iseq"], i, *event, *[None] * 5)
        yield from _state_rows(symbol, book)

    nil = lambda t: F.lit(None).cast(t)
    heads = books.select(nil("long").alias("iseq"), "symbol", F.lit("book").alias("cmd"), *[nil(t).alias(c) for c, t in (("order_id", "long"), ("side", "string"), ("otype", "string"), ("price", "long"), ("qty", "long"), ("tif", "string"))], F.lit(-1).cast("long").alias("pos"), "seq")
    tail = commands.select(*names(COMMANDS), nil("long").alias("pos"), nil("long").alias("seq"))
    rows = heads.unionByName(restore_commands(orders)).unionByName(tail).withColumn("stage", F.when(F.col("iseq").isNull(), 0).otherwise(1))
    return fold(rows, "symbol", ["stage", "iseq", "pos"], step, STATE)


def cut(commands: DataFrame, iseq: int) -> DataFrame:
    """The commands up to a cut of the total order, pushed below the fold."""
    return commands.filter(F.col("iseq") <= iseq)
