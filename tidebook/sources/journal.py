"""Command and event journals, as JSON lines or fixed binary records.

A directory holds `{kind}-{partition}[.{start}].{ext}` files. Spark lists them, and any store that
Spark reads will do; decoding runs on the executors, a task per file, in parts of bounded size.
Strict mode refuses any damage; repair mode cuts what a crash can leave at the end of a journal's
last segment, and only that.
"""

from __future__ import annotations

import json
import os
import re
import struct
from itertools import groupby, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.tables import as_uri
from ..operators.fold import OUT, batch_of, rows_of
from ..schemas import BOOK_CONFIG, CLOSE_REASONS, CMD_CODES, EV_CODES, OTYPE_CODES, REJECT_REASONS, SIDE_CODES, TIF_CODES

NAME = re.compile(r"(cmd|evt)-(\d+)(?:\.(\d+))?\.(journal|bin)$")
ROWS = (
    "file string, kind string, partition long, start long, place long, iseq long, symbol long, cmd string, order_id long, side string, otype string, price long, qty long, tif string, "
    "seq long, ev string, maker long, taker long, leaves_qty long, reason string, problem string, header string"
)
FIELDS = [x.split()[0] for x in ROWS.split(", ")]
MAGIC, HEADER = b"ORDJ", struct.Struct("<4sHBBIIIIqqQ16x")  # fixed layout
_CMD = np.dtype([("iseq", "<u8"), ("symbol", "<u4"), ("cmd", "u1"), ("side", "u1"), ("otype", "u1"), ("tif", "u1"), ("order_id", "<u8"), ("price", "<i8"), ("qty", "<u8")])
_EVT = np.dtype([("seq", "<u8"), ("symbol", "<u4"), ("ev", "u1"), ("reason", "u1"), ("pad", "<u2"), ("a", "<u8"), ("b", "<u8"), ("c", "<i8"), ("d", "<u8")])
_DTYPES = {"cmd": _CMD, "evt": _EVT}
#: Bytes of a file that are read at a time.
PART = 1 << 22
_REASON_BASE = {2: REJECT_REASONS, 4: CLOSE_REASONS}
# Binary codes of reject reasons are those of the documented record, 1-based.


def crc_table() -> np.ndarray:
    """The 256 entries of CRC-32C from its reflected polynomial."""
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> 1) ^ np.uint32(0x82F63B78), t >> 1).astype(np.uint32)
    return t


_TABLE = crc_table()


def crc32c(rows: np.ndarray) -> np.ndarray:
    """CRC-32C of each row of a (n, width) array of bytes."""
    crc = np.full(len(rows), 0xFFFFFFFF, np.uint32)
    for j in range(rows.shape[1]):
        crc = _TABLE[(crc ^ rows[:, j]) & 0xFF] ^ (crc >> np.uint32(8))
    return crc ^ np.uint32(0xFFFFFFFF)


_CMDS, _SIDES, _OTYPES, _TIFS, _EVS = ({n: k for k, n in codes.items()} for codes in (CMD_CODES, SIDE_CODES, OTYPE_CODES, TIF_CODES, EV_CODES))


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def _binary_row(kind: str, r: dict) -> dict:
    if kind == "cmd":
        cmd = _CMDS.get(r["cmd"])
        new, sized = cmd == "new", cmd in ("new", "replace")
        return {"iseq": _signed(r["iseq"]), "symbol": r["symbol"], "cmd": cmd, "order_id": _signed(r["order_id"]),
                "side": _SIDES.get(r["side"]) if new else None, "otype": _OTYPES.get(r["otype"]) if new else None, "tif": _TIFS.get(r["tif"]) if new else None,
                "price": r["price"] if sized else None, "qty": _signed(r["qty"]) if sized else None}
    ev, out = _EVS.get(r["ev"]), {"seq": _signed(r["seq"]), "symbol": r["symbol"]}
    out["ev"] = ev
    if ev == "trade":
        return out | {"maker": _signed(r["a"]), "taker": _signed(r["b"]), "price": r["c"], "qty": _signed(r["d"])}
    out["order_id"] = _signed(r["a"])
    if ev == "accepted":
        out["leaves_qty"] = _signed(r["d"])
    elif ev == "replaced":
        out |= {"price": r["c"], "qty": _signed(r["d"])}
    else:
        out["reason"] = _REASON_BASE[EV_CODES[ev]][r["reason"] - 1]
    return out


def _binary_head(kind: str, partition: int, partitions: int, config: dict, version: int = 2) -> bytes:
    return HEADER.pack(MAGIC, version, 1 if kind == "cmd" else 2, int(config["index"] == "tree"), partition, partitions, _DTYPES[kind].itemsize + 8 * (version == 2), 0, config["pmin"], config["pmax"], config["max_orders"])


def _binary_body(kind: str, rows: list[dict], version: int = 2) -> bytes:
    dt, extra = _DTYPES[kind], 8 if version == 2 else 0
    out = np.zeros(len(rows), dt)
    u = lambda x: (x or 0) % (1 << 64)
    for o, r in zip(out, rows):
        o["symbol"] = r["symbol"]
        if kind == "cmd":
            o["iseq"], o["cmd"], o["order_id"], o["price"], o["qty"] = u(r["iseq"]), CMD_CODES[r["cmd"]], u(r["order_id"]), r.get("price") or 0, u(r.get("qty"))
            if r["cmd"] == "new":
                o["side"], o["otype"], o["tif"] = SIDE_CODES[r["side"]], OTYPE_CODES[r["otype"]], TIF_CODES[r["tif"]]
        else:
            ev = r["ev"]
            o["seq"], o["ev"] = u(r["seq"]), EV_CODES[ev]
            o["a"], o["b"] = u(r["maker"] if ev == "trade" else r["order_id"]), u(r["taker"]) if ev == "trade" else 0
            o["c"] = r["price"] if ev in ("trade", "replaced") else 0
            o["d"] = u(r["leaves_qty"]) if ev == "accepted" else u(r["qty"]) if ev in ("trade", "replaced") else 0
            o["reason"] = _REASON_BASE[EV_CODES[ev]].index(r["reason"]) + 1 if ev in ("rejected", "closed") else 0
    body = out.view(np.uint8).reshape(len(rows), dt.itemsize) if rows else np.zeros((0, dt.itemsize), np.uint8)
    if extra:
        tail = np.zeros((len(rows), 8), np.uint8)
        tail[:, :4] = crc32c(body).astype("<u4").view(np.uint8).reshape(-1, 4)
        body = np.hstack([body, tail])
    return body.tobytes()


def encode(kind: str, rows: list[dict], partition: int, partitions: int, config: dict, version: int = 2) -> bytes:
    """A binary journal file."""
    return _binary_head(kind, partition, partitions, config, version) + _binary_body(kind, rows, version)


def decode(name: str, data: bytes, repair: bool) -> tuple[dict | None, list[dict], str | None, int]:
    """Header, rows, problem (strict damage) and bytes that repair cuts off the end."""
    r = Reading(name, pa.BufferReader(data), repair)
    rows = list(r.rows())
    return r.header, rows, r.problem, r.cut


class Reading:
    """A journal file (one that can be read at any place) whose records are read a part at a time.
    header, problem (strict damage) and cut (bytes that repair drops off the end) are known once
    rows() has ended."""

    def __init__(self, name: str, file, repair: bool):
        self.kind, partition, _, self.ext = NAME.search(name).groups()
        self.partition, self.file, self.repair, self.size = int(partition), file, repair, file.size()
        self.header, self.problem, self.cut = None, None, 0

    def rows(self):
        yield from self._of_binary() if self.ext == "bin" else self._of_lines()

    def _at(self, start: int, n: int) -> bytes:
        self.file.seek(start)
        return self.file.read(n)

    def _ordered(self, rows):
        """The rows, and a problem if a command's iseq is not above the one before."""
        before = None
        for r in rows:
            if self.kind == "cmd" and before is not None and r["iseq"] <= before:
                self.problem = "iseq order"
            before = r.get("iseq")
            yield r

    # --- lines ---

    def _split(self, size: int):
        rest = b""
        for at in range(0, size, PART):
            *whole, rest = (rest + self._at(at, min(PART, size - at))).split(b"\n")
            yield from whole

    def _of_lines(self):
        size = self.size
        if size and self._at(size - 1, 1) != b"\n":
            if not self.repair:
                self.problem = "torn last line"
                return
            while size and (found := self._at(max(0, size - PART), min(PART, size)).rfind(b"\n")) < 0:
                size = max(0, size - PART)
            size = max(0, size - PART) + found + 1 if size else 0
            self.cut = self.size - size
        if not size:
            self.problem = "no header"
            return
        lines, self.damage = self._split(size), None
        try:
            header = json.loads(next(lines).decode())
        except ValueError:
            self.problem = "record 0"
            return
        sound = header.get("kind") == self.kind and header.get("partition") == self.partition and str(header.get("format", "")).endswith("-journal/1")
        for r in self._ordered(self._parsed(lines)):
            if sound:
                yield r
        self.header = None if self.damage == "json" else header
        self.problem = f"record {self.parsed}" if self.damage else "header" if not sound else self.problem

    def _parsed(self, lines):
        needs = {"cmd", "iseq", "order_id"} if self.kind == "cmd" else {"seq", "ev"}
        self.parsed = 0
        for line in lines:
            try:
                r = json.loads(line.decode())
            except ValueError:
                self.damage = "json"
                return
            if not needs <= set(r):
                self.damage = "fields"
                return
            yield r
            self.parsed += 1

    # --- fixed records ---

    def _of_binary(self):
        data = self._at(0, HEADER.size)
        if len(data) < HEADER.size or data[:4] != MAGIC:
            self.problem = "header" if any(any(self._at(at, PART)) for at in range(HEADER.size, self.size, PART)) else "no header"
            return
        _, version, k, index, p, parts, size, _, pmin, pmax, most = HEADER.unpack(data)
        dt = _DTYPES[self.kind]
        self.header = {"kind": self.kind, "partition": p, "partitions": parts, "pmin": pmin, "pmax": pmax, "max_orders": most, "index": "tree" if index else "ladder"}
        if version not in (1, 2) or k != (1 if self.kind == "cmd" else 2) or p != self.partition or size != dt.itemsize + (8 if version == 2 else 0):
            self.problem = "header"
            return
        n, torn = divmod(self.size - HEADER.size, size)
        if torn:
            if not self.repair:
                self.problem = "torn record"
                return
            self.cut = torn
        each = max(1, PART // size)
        part = lambda at, n: np.frombuffer(self._at(HEADER.size + at * size, min(each, n - at) * size), np.uint8).reshape(-1, size)
        while self.repair and n:  # records of zeros at the end
            begin = max(0, n - each)
            full = np.flatnonzero(part(begin, n).any(axis=1))
            keep = begin + int(full[-1]) + 1 if len(full) else begin
            self.cut, n = self.cut + (n - keep) * size, keep
            if len(full):
                break
        if version == 2:
            good_at = lambda rows: crc32c(rows[:, : dt.itemsize]) == np.ascontiguousarray(rows[:, dt.itemsize : dt.itemsize + 4]).view("<u4")[:, 0]
            if self.repair and n and not good_at(part(n - 1, n))[0]:
                n, self.cut = n - 1, self.cut + size
            for at in range(0, n, each):  # all sums before the first record is given out
                good = good_at(part(at, n))
                if not good.all():
                    self.problem = f"checksum of record {at + int(np.argmin(good))}"
                    return
        records = (r for at in range(0, n, each) for r in np.ascontiguousarray(part(at, n)[:, : dt.itemsize]).view(dt)[:, 0].tolist())
        yield from self._ordered(_binary_row(self.kind, dict(zip(dt.names, r))) for r in records)


def _opened(path: str):
    """A file of the store, to be read at any place."""
    from pyarrow import fs

    if path.startswith("file:"):
        return fs.LocalFileSystem().open_input_file("/" + path.removeprefix("file:").lstrip("/"))
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


def _opens(folder: str) -> bool:
    """Whether pyarrow's file systems have the folder's store."""
    from pyarrow import fs

    try:
        fs.FileSystem.from_uri(as_uri(folder))
    except (pa.ArrowException, OSError):
        return False
    return True


def read(spark: SparkSession, folder: str, mode: str = "strict") -> DataFrame:
    """ROWS of every journal file: its records in order, or one row with `problem`.

    In repair mode each file's end is cut as the last segment's may be; last_segments() tells
    which files that is lawful for, and checked() refuses the others. A task reads a file a part
    at a time; only from a store that pyarrow doesn't know it is sent whole."""
    repair = mode == "repair"
    columns = ["path"] if _opens(folder) else ["path", "content"]

    def records(path, content):
        name = os.path.basename(path)
        m = NAME.search(name)
        base = {"file": name, "kind": m[1], "partition": int(m[2]), "start": int(m[3] or 0)}
        with _opened(path) if content is None else pa.BufferReader(content.as_buffer()) as file:
            r = Reading(name, file, repair)
            for n, row in enumerate(r.rows()):
                yield base | {"place": n} | row
            head = json.dumps({k: r.header[k] for k in ("partitions", "pmin", "pmax", "max_orders", "index") if k in r.header}, sort_keys=True) if r.header else None
            yield base | {"place": -1, "problem": r.problem, "header": head, "qty": r.cut}

    def run(batches):
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1) if b.num_columns > 1 else [None] * b.num_rows):
                if not NAME.search(os.path.basename(path)):
                    continue
                rows = records(path, content)
                while part := [tuple(r.get(f) for f in FIELDS) for r in islice(rows, OUT)]:
                    yield batch_of(part, ROWS)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*-*.{journal,bin}").load(folder).select(*columns)
    return files.mapInArrow(run, ROWS)


def files_of(rows: DataFrame) -> DataFrame:
    """One row per file: file, kind, partition, start, problem, header, cut (bytes that repair drops), records, last."""
    heads = rows.filter("place = -1").select("file", "kind", "partition", "start", "problem", "header", F.col("qty").alias("cut"))
    n = rows.filter("place >= 0").groupBy("file").agg(F.count(F.lit(1)).alias("records"))
    w = Window.partitionBy("kind", "partition").orderBy(F.desc("start"))
    f = heads.join(n, "file", "left").na.fill(0, ["records"])
    # a segment without a header and start above 0 never held anything: the one before it is the last
    gone = (F.col("problem") == "no header") & (F.col("start") > 0)
    f = f.withColumn("gone", F.coalesce(gone, F.lit(False)))
    # ends are repaired from the newest segment back to the first that holds a record
    newer = F.sum(F.when(F.col("records") > 0, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return f.withColumn("last", F.coalesce(newer, F.lit(0)) == 0)


def problems(rows: DataFrame, mode: str = "strict") -> DataFrame:
    """file, problem of a directory that must be refused in this mode."""
    f = files_of(rows)
    repair = mode == "repair"
    own = f.filter(F.col("problem").isNotNull() & ~(F.col("gone") & F.col("last") & F.lit(repair))).select("file", "problem")
    early = f.filter("cut > 0 and not last").select("file", F.lit("damage before the last segment").alias("problem"))
    heads = f.filter("header is not null").agg(F.count_distinct("header").alias("n")).filter("n > 1").select(F.lit("*").alias("file"), F.lit("headers differ").alias("problem"))
    have = f.filter("header is not null").groupBy("kind").agg(F.count_distinct("partition").alias("n"), F.max(F.get_json_object("header", "$.partitions")).cast("long").alias("p"))
    absent = have.filter("n <> p").select("kind", F.lit("partitions missing").alias("problem")).withColumnRenamed("kind", "file")
    return own.unionByName(early).unionByName(heads).unionByName(absent)


def commands(rows: DataFrame, cut: int = 0) -> DataFrame:
    """All partitions' commands after a snapshot's cut."""
    return rows.filter((F.col("kind") == "cmd") & (F.col("place") >= 0) & (F.col("iseq") > cut)).select("iseq", "symbol", "cmd", "order_id", "side", "otype", "price", "qty", "tif")


def header_line(kind: str, partition: int, partitions: int, config: dict | None = None, prefix: str = "stream") -> str:
    c = BOOK_CONFIG | (config or {})
    return json.dumps({"format": f"{prefix}-journal/1", "kind": kind, "partition": partition, "partitions": partitions, "pmin": c["pmin"], "pmax": c["pmax"], "max_orders": c["max_orders"], "index": c["index"]}, separators=(",", ":"))


def open_segment(folder: str, kind: str, partition: int, partitions: int, start: int, config: dict | None = None) -> None:
    """A segment of lines that holds its header only."""
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(as_uri(folder))
    name = f"{kind}-{partition}.{start}.journal"
    with system.open_output_stream(f"{path}/.{name}", compression=None) as f:
        f.write((header_line(kind, partition, partitions, config) + "\n").encode())
    system.move(f"{path}/.{name}", f"{path}/{name}")


def write(rows: DataFrame, folder: str, kind: str, partitions: int, config: dict | None = None, binary: bool = False, start: int = 0, prefix: str = "stream") -> DataFrame:
    """Writes one file per partition of `rows` (columns partition, line or record fields, and the
    order iseq, ordinal) through pyarrow's file systems; returns file, records when run."""
    from pyarrow import fs

    c = BOOK_CONFIG | (config or {})

    def run(batches):
        system, path = fs.FileSystem.from_uri(as_uri(folder))
        system.create_dir(path, recursive=True)
        out = []
        for p, group in groupby(rows_of(batches), lambda r: r["partition"]):
            name = f"{kind}-{p}" + (f".{start}" if start else "") + (".bin" if binary else ".journal")
            with system.open_output_stream(f"{path}/.{name}", compression=None) as f:
                n = 0
                f.write(_binary_head(kind, p, partitions, c) if binary else (header_line(kind, p, partitions, c, prefix) + "\n").encode())
                while part := list(islice(group, OUT)):
                    f.write(_binary_body(kind, part) if binary else "".join(r["line"] + "\n" for r in part).encode())
                    n += len(part)
            system.move(f"{path}/.{name}", f"{path}/{name}")
            out.append((name, n))
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.string()), pa.array([x[1] for x in out], pa.int64())], names=["file", "records"])

    order = [c for c in ("iseq", "ordinal") if c in rows.columns]
    return rows.repartition("partition").sortWithinPartitions("partition", *order).mapInArrow(run, "file string, records long")
