"""Digests: the order-dependent event chain of a partition, and order-free state digests."""

from __future__ import annotations

import hashlib
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.fold import fold
from ..schemas import CLOSE_REASONS, EV_CODES, REJECT_REASONS
from ..sources.ledger_codec import encode_event
from .routing import MIX, add64, mul64, rotate_left

_M = (1 << 64) - 1
_STEP = 0x9E3779B97F4A7C15  # fixed value of the chain


def chain_step(h: int, x: int) -> int:
    h = ((h ^ (x & _M)) * _STEP) & _M
    return ((h << 31) | (h >> 33)) & _M


def event_words(e: dict) -> list[int]:
    """The words that one event adds to its partition's chain."""
    ev = e["ev"]
    head = [e["iseq"], e["symbol"] << 8 | EV_CODES[ev], e["seq"]]
    if ev == "accepted":
        return head + [e["order_id"], e["leaves_qty"]]
    if ev == "rejected":
        return head + [e["order_id"], REJECT_REASONS.index(e["reason"])]
    if ev == "trade":
        return head + [e["maker"], e["taker"], e["price"], e["qty"]]
    if ev == "closed":
        return head + [e["order_id"], CLOSE_REASONS.index(e["reason"])]
    return head + [e["order_id"], e["price"], e["qty"]]


def _chain(partition, rows):
    h = n = 0
    for e in rows:
        for w in event_words(e):
            h = chain_step(h, w)
        n += 1
    yield partition, f"{h:016x}", n


def event_chains(events: DataFrame) -> DataFrame:
    """partition, chain (16 hex digits), n: one streaming fold per partition, in emission order."""
    cols = ["partition", "iseq", "ordinal", "symbol", "seq", "ev", "order_id", "maker", "taker", "price", "qty", "leaves_qty", "reason"]
    return fold(events, "partition", ["iseq", "ordinal"], _chain, "partition long, chain string, n long", cols)


def chain_digest(tag: str, commands: int, chains: list[str]) -> str:
    """SHA-256 of tag, commands (u64), partitions (u32) and chains (u64), little-endian."""
    return hashlib.sha256(tag.encode() + struct.pack("<QI", commands, len(chains)) + b"".join(struct.pack("<Q", int(c, 16)) for c in chains)).hexdigest()


def state_digest(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """by..., lane0, lane1, rows: sums modulo 2^64 of two independent hashes of each row.
    Commutative, so it is combined before the shuffle and no order or layout changes it."""
    values = [F.coalesce(F.col(c).cast("string"), F.lit("\\N")) for c in rows.columns if c not in (by or [])]
    row = F.concat_ws("|", *values)
    lane = lambda salt: (F.sum(F.xxhash64(F.lit(salt), row).cast("decimal(38,0)")) % F.expr("18446744073709551616BD")).cast("string")
    return rows.groupBy(*(by or [])).agg(lane(1).alias("lane0"), lane(2).alias("lane1"), F.count(F.lit(1)).alias("rows"))


#: Fixed value: an event's id is multiplied by this and its kind's code (EV_CODES) together.
CONTENT = 0x9E3779B0


def content_hash() -> Column:
    """A cheap hash of an event's own fields, as a long's two's complement."""
    code = lambda names: (F.array_position(F.array(*[F.lit(x) for x in names]), F.col("reason")) - 1).cast("long")
    ev, nil = F.col("ev"), F.lit(0).cast("long")
    kind = F.element_at(F.create_map(*[x for k, c in EV_CODES.items() for x in (F.lit(k), F.lit(c).cast("long"))]), ev)
    who = F.coalesce("order_id", "maker")
    low = who.bitwiseAND(F.lit(0xFFFFFFFF)) * kind
    times = add64(F.shiftleft(F.shiftrightunsigned(who, 32) * kind, 32), low)
    turned = F.when(ev == "trade", rotate_left(F.col("price"), 42)).when(ev == "replaced", rotate_left(F.col("price"), 31)).otherwise(nil)
    rest = F.when(ev == "accepted", F.col("leaves_qty")).when(ev == "rejected", code(REJECT_REASONS)).when(ev == "closed", code(CLOSE_REASONS)).otherwise(F.col("qty"))
    parts = [times, F.when(ev == "trade", rotate_left(F.col("taker"), 21)).otherwise(nil), turned, rest]
    out = mul64(who, CONTENT)
    for p in parts:
        out = add64(out, p)
    return out


def group_chain(events: DataFrame) -> DataFrame:
    """grp, chain (hex), n: of each group's stream of reports (grp, idx, event and its fields), the
    hash of the hash before and the event's bytes."""

    def step(group, rows):
        chain, n = bytes(32), 0
        for r in rows:
            chain, n = hashlib.sha256(chain + encode_event(r | {"amount": int(r["amount"])})).digest(), n + 1
        yield group, chain.hex(), n

    return fold(events, "grp", ["idx"], step, "grp long, chain string, n long", ["grp", "idx", "event", "account", "asset", "amount"])


# --- order-free accumulators of a ledger's tables ---

_U = np.uint64


def _mixed(z: np.ndarray) -> np.ndarray:
    z = z + _U(_STEP)
    z = (z ^ (z >> _U(30))) * _U(MIX[0])
    z = (z ^ (z >> _U(27))) * _U(MIX[1])
    return z ^ (z >> _U(31))


def _turn(z: np.ndarray, n: int) -> np.ndarray:
    return (z << _U(n)) | (z >> _U(64 - n))


def lanes(tag: int, words: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each row: its words (unsigned columns) mixed in turn under the table's tag."""
    # What the two halves start from.
    a, b = (_mixed(np.full(len(words[0]), tag ^ x, np.uint64)) for x in (0x243F6A8885A308D3, 0x13198A2E03707344))
    for w in words:
        a = _mixed(a ^ w) + _turn(a, 17)
        b = _mixed(_turn(b + w, 13) ^ a)
    return _mixed(a ^ _turn(b, 7)), _mixed(b ^ _turn(a, 41))


#: Tables of a ledger in the order of its digest: name -> (rows of the state, tag, words; `*` marks an amount of two words).
TABLES = {
    "balances": ("balance", 1, "account asset amount* held*"),
    "orders": ("order", 2, "order_id account symbol side price qty held* cancelling born cancel_at"),
    "lent": ("lent_total", 3, "account asset amount*"),
    "lent_by_group": ("lent", 5, "account asset grp amount*"),
    "pending": ("pending", 4, "order_id account asset amount*"),
    "outbox": ("outbox", 5, "outbox_idx"),
    "deposit_ids": ("id:deposit", 100, "order_id"),
    "withdraw_ids": ("id:withdraw", 101, "order_id"),
    "adjust_ids": ("id:adjust", 102, "order_id"),
}
#: Words of an outbox message after its place: its code, then its fields (fixed values).
MESSAGES = {"submit": (1, "order_id symbol side price qty"), "submit_ioc": (6, "order_id symbol side price qty"), "cancel": (2, "order_id symbol"), "grant": (3, "grp account asset amount*"), "recall": (4, "grp account asset amount*")}


def _words(rows: list[dict], fields: str) -> list[np.ndarray]:
    out = []
    for f in fields.split():
        if f.endswith("*"):
            v = [int(r[f[:-1]]) for r in rows]
            out += [np.array([x & _M for x in v], np.uint64), np.array([x >> 64 for x in v], np.uint64)]
        elif f == "side":
            out.append(np.array([r["side"] == "sell" for r in rows], np.uint64))
        else:
            out.append(np.array([int(r[f]) & _M for r in rows], np.uint64))
    return out


def ledger_lanes(state: DataFrame) -> DataFrame:
    """shard, name, lane0, lane1 (decimals below 2^64), n of each of TABLES: sums modulo 2^64 over the
    exported rows (ledger.ROWS), combined before the shuffle; no order or layout changes them."""
    rows = state.filter("rec <> 'outcome'").withColumn("rec", F.when(F.col("rec") == "id", F.concat(F.lit("id:"), "name")).otherwise(F.col("rec")))
    total = rows.filter("rec = 'lent'").groupBy("shard", "account", "asset").agg(F.sum("amount").cast("decimal(38,0)").alias("amount")).withColumn("rec", F.lit("lent_total"))
    of = {rec: (name, tag, fields) for name, (rec, tag, fields) in TABLES.items()}

    def run(batches):
        for batch in batches:
            by: dict = {}
            for r in batch.to_pylist():
                if r["rec"] in of:
                    by.setdefault((r["rec"], r["name"] if r["rec"] == "outbox" else None), []).append(r)
            shard, name, l0, l1 = [], [], [], []
            for (rec, kind), part in by.items():
                table, tag, fields = of[rec]
                words = _words(part, fields)
                if kind is not None:
                    code, more = MESSAGES[kind]
                    words += [np.full(len(part), code, np.uint64), *_words(part, more)]
                a, b = lanes(tag, words)
                shard += [r["shard"] for r in part]
                name += [table] * len(part)
                l0 += a.view(np.int64).tolist()
                l1 += b.view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(shard, pa.int64()), pa.array(name, pa.string()), pa.array(l0, pa.int64()), pa.array(l1, pa.int64())], names=["shard", "name", "l0", "l1"])

    each = rows.unionByName(total, True).mapInArrow(run, "shard long, name string, l0 long, l1 long")
    word = F.expr("18446744073709551616BD")
    lane = lambda c: F.pmod(F.sum(F.pmod(F.col(c).cast("decimal(38,0)"), word)), word).cast("decimal(38,0)")
    return each.groupBy("shard", "name").agg(lane("l0").alias("lane0"), lane("l1").alias("lane1"), F.count(F.lit(1)).alias("n"))


#: Counters of a ledger by asset, in the order of its digest.
FLOW_ORDER = ["fees", "deposited", "withdrawn", "settled_in", "settled_out", "adjusted_in", "adjusted_out", "lent_granted", "lent_returned", "slice_in", "slice_out"]
GROUP_FLOWS = ["granted", "returned", "slice_in", "slice_out"]


def summary_bytes(shard: int, scalars: tuple, marks: dict, flow: dict, group_flow: dict, adjustments: list) -> bytes:
    """What a digest holds of a ledger besides its large tables, little-endian: counters, marks, totals
    by asset and by asset and group, and the kept adjustments."""
    amount = lambda v: int(v).to_bytes(16, "little")
    out = [struct.pack("<H4QI", shard, *scalars, len(marks))]
    out += [struct.pack("<IQ", s, i) for s, i in sorted(marks.items())]
    for name in FLOW_ORDER:
        per = sorted((a, v) for (n, a), v in flow.items() if n == name)
        out.append(struct.pack("<I", len(per)))
        out += [struct.pack("<I", a) + amount(v) for a, v in per]
    pairs = sorted({k[1:] for k in group_flow})
    out.append(struct.pack("<I", len(pairs)))
    for p in pairs:
        out.append(struct.pack("<IH", *p) + b"".join(amount(group_flow.get((n, *p), 0)) for n in GROUP_FLOWS))
    out.append(struct.pack("<I", len(adjustments)))
    out += [struct.pack("<QQIB", i % (1 << 64), a % (1 << 64), s, credit) + amount(v) + struct.pack("<I", reason or 0) for i, a, s, credit, v, reason in adjustments]
    return b"".join(out)


def digest_of(tag: str, summary: bytes, tables: dict) -> str:
    """tables: name -> (lane0, lane1, rows)."""
    each = [tables.get(t, (0, 0, 0)) for t in TABLES]
    return hashlib.sha256(tag.encode() + summary + b"".join(struct.pack("<QQ", a, b) for a, b, _ in each) + b"".join(struct.pack("<Q", n) for *_, n in each)).hexdigest()


def ledger_digest(state: DataFrame, tag: str = "ledger-digest/1") -> DataFrame:
    """shard, digest: SHA-256 over the small state and the accumulators of the large tables.
    Per shard only counters, marks and the bounded list of adjustments meet in one task."""
    small = state.filter("rec in ('state', 'mark', 'flow', 'group_flow', 'adjustment')").select("shard", "rec", "name", "account", "asset", "grp", "amount", "order_id", "outbox_idx", "queued", "born", "cancelling", F.lit(None).cast("decimal(38,0)").alias("lane1"))
    sums = ledger_lanes(state).select("shard", F.lit("lane").alias("rec"), "name", F.col("lane0").alias("amount"), "lane1", F.col("n").alias("outbox_idx"))

    def step(shard, rows):
        scalars, marks, flow, groups, adjustments, tables = (0, 0, 0, 0), {}, {}, {}, [], {}
        for r in rows:
            if r["rec"] == "state":
                scalars = (r["order_id"], r["outbox_idx"], r["queued"], r["born"])
            elif r["rec"] == "mark":
                marks[r["grp"]] = r["outbox_idx"]
            elif r["rec"] == "flow":
                flow[r["name"], r["asset"]] = r["amount"]
            elif r["rec"] == "group_flow":
                groups[r["name"], r["asset"], r["grp"]] = r["amount"]
            elif r["rec"] == "adjustment":
                adjustments.append((r["order_id"], r["account"], r["asset"], r["cancelling"], r["amount"], r["queued"]))
            else:
                tables[r["name"]] = (int(r["amount"]), int(r["lane1"]), r["outbox_idx"])
        yield shard, digest_of(tag, summary_bytes(shard, scalars, marks, flow, groups, adjustments), tables)

    return fold(small.unionByName(sums, True), "shard", ["rec", "outbox_idx"], step, "shard long, digest string")


def deep_digest(state: DataFrame) -> DataFrame:
    """shard, digest: SHA-256 over the lines of the whole exported state in byte order."""
    columns = [c for c in state.columns if c not in ("shard", "lsn", "outcome", "reject")]
    text = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns])

    def step(shard, rows):
        h = hashlib.sha256()
        for k, r in enumerate(rows):
            h.update((("\n" if k else "") + r["line"]).encode())
        yield shard, h.hexdigest()

    return fold(state.filter("rec <> 'outcome'").select("shard", text.alias("line")), "shard", ["line"], step, "shard long, digest string")


def tier_digest(tag: str, inner: str, partitions: int, cursors: dict[int, int], nexts: list[int], live: int) -> str:
    """SHA-256 over a matching tier: the digest inside it (hex), partitions (u32), next message of each
    shard (count u32; shard u16, cursor u64), next index of each partition (u64) and live orders (u64)."""
    b = tag.encode() + bytes.fromhex(inner) + struct.pack("<II", partitions, len(cursors))
    b += b"".join(struct.pack("<HQ", s, c) for s, c in sorted(cursors.items())) + b"".join(struct.pack("<Q", n) for n in nexts)
    return hashlib.sha256(b + struct.pack("<Q", live)).hexdigest()
