"""WARC archives with a two-level capture index.

Writing: every task writes its pages as one archive of gzip members, one record
each. Pages with equal payloads become one response and revisits of it.

Index: capture lines `<reversed host>)<path> <record id>` are sorted over the whole
table and cut to compressed blocks of many lines (second level, a table). The first
key of each block is the sparse directory (first level). The block size grows with
the table, so the directory never has more than MAX_BLOCKS entries and can go to
every task. A lookup searches the directory by bisection, opens one block, finds
its line by bisection and reads one range of one archive.

Archives live in the folder that all executors share and are read and written
through pyarrow's file systems (local, HDFS, S3, GCS), never as whole files.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, new_path, stored, table

#: Capture lines of an index block, at least.
BLOCK_LINES = 1024
#: Entries of the directory, at most; larger tables get larger blocks.
MAX_BLOCKS = 1 << 15
#: Payloads of an archive file before it is closed, about.
ARCHIVE_BYTES = 64 << 20
#: Bytes of archives that a task reads, about, and of a stretch of an archive that one task reads, at most.
READ_BYTES, STRETCH = 16 << 20, 4 << 20
LEVEL = 1
NO_ID = "-"


def reversed_host_key(url: str | None) -> str:
    """Sort key of a URL: `com,example,www)/path?query`; scheme, port, user and fragment go."""
    rest = re.sub(r"^[A-Za-z][A-Za-z0-9+.-]*://", "", url or "").split("#", 1)[0]
    cut = min((i for i in (rest.find("/"), rest.find("?")) if i >= 0), default=len(rest))
    host, path = rest[:cut].rsplit("@", 1)[-1].lower(), rest[cut:] or "/"
    host = re.sub(r":\d*$", "", host)
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", ",".join(reversed(host.split("."))) + ")" + path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _one_line(value: str | None) -> str:
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value or "")


def record(page_id, url, payload: bytes, kind: str, refers_to, digest: str, size: int) -> bytes:
    """One WARC/1.1 record, uncompressed; a revisit carries no payload."""
    body = payload if kind == "response" else b""
    head = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{NO_ID if page_id is None else page_id}>",
        f"WARC-Target-URI: {_one_line(url)}", "WARC-Date: 1970-01-01T00:00:00Z", f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {size}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    head += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {len(body)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and body of one uncompressed record."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    headers = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines[1:])
    return headers, rest[: int(headers["Content-Length"])]


def file_system(uri: str):
    """pyarrow file system and path of a folder's URI; a bare path is a local one."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + uri)


def _page(urn: str):
    value = urn[len("<urn:page:") : -1]
    return None if value == NO_ID else int(value)


def captures(pages: DataFrame, least_bytes=0, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Pages with digest, payload_bytes, record_type and refers_to. Of equal payloads of
    at least `least_bytes`, the smallest id is the response, the others revisits. A null
    payload is empty. A row without id is a response unless its payload has one with an
    id; of rows that share the smallest id, each is a response."""

    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), F.col(html_col).cast("string").alias("html"))
    keyed = rows.select("page_id", "url", F.coalesce("html", F.lit("")).alias("html")).select("page_id", "url", F.encode("html", "UTF-8").alias("payload"), F.sha1(F.encode("html", "UTF-8")).alias("sha"))
    keyed = keyed.withColumn("payload_bytes", F.length("payload").cast("long"))
    first = stored(keyed.filter(F.col("payload_bytes") >= least_bytes).groupBy("sha", "payload_bytes").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("sha").alias("s"), F.col("payload_bytes").alias("b"), "first_id"), "warc-first")
    joined = keyed.join(first, (F.col("sha") == F.col("s")) & (F.col("payload_bytes") == F.col("b")), "left")
    again = F.col("first_id").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return joined.select("page_id", "url", "payload", "sha", "payload_bytes", F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first_id")).alias("refers_to"))


INDEX = "key string, file string, at long, length long"


def write_archives(rows: DataFrame, folder: str) -> DataFrame:
    """Writes the rows of captures() and returns the capture lines (INDEX), lazily. A file
    gets its final name when it is whole; a repeated task writes files of its own."""

    def run(batches):
        system, path = file_system(folder)
        system.create_dir(path, recursive=True)
        out = name = None
        size = held = 0
        lines: list[tuple] = []

        def close():
            out.close()
            system.move(f"{path}/.{name}", f"{path}/{name}")
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*lines), (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["key", "file", "at", "length"])

        for b in batches:
            for page_id, url, payload, sha, n, kind, refers in zip(*(c.to_pylist() for c in b.columns)):
                if out is None:
                    name = f"{uuid.uuid4().hex}.warc.gz"
                    out, size, held, lines = system.open_output_stream(f"{path}/.{name}", compression=None), 0, 0, []
                digest = base64.b32encode(bytes.fromhex(sha)).decode()
                z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                member = z.compress(record(page_id, url, payload, kind, refers, digest, n)) + z.flush()
                out.write(member)
                lines.append((f"{reversed_host_key(url)} {NO_ID if page_id is None else page_id}", name, size, len(member)))
                size += len(member)
                held += len(payload)
                if held >= ARCHIVE_BYTES:
                    yield close()
                    out = None
        if out is not None:
            yield close()

    return map_arrow(rows.select("page_id", "url", "payload", "sha", "payload_bytes", "record_type", "refers_to"), run, INDEX)


def build_index(lines: DataFrame, total: int) -> tuple[DataFrame, list[tuple[str, int]]]:
    """The block table (block long, lines binary) and the directory [(first key, block)].

    Lines are dealt by ranges of their keys and sorted; equal lines may meet in several
    blocks. A block is JSON-free text under zlib: key, file, offset, length, tab-separated."""
    per_block = max(BLOCK_LINES, -(-2 * total // MAX_BLOCKS))

    def run(batches):
        from pyspark import TaskContext

        held: list[str] = []
        first, n = None, TaskContext.get().partitionId() << 32
        for b in batches:
            for key, file, at, length in zip(*(c.to_pylist() for c in b.columns)):
                first = key if not held else first
                held.append(f"{key}\t{file}\t{at}\t{length}")
                if len(held) == per_block:
                    yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([first]), pa.array([zlib.compress("\n".join(held).encode())], pa.binary())], names=["block", "first", "lines"])
                    held, n = [], n + 1
        if held:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([first]), pa.array([zlib.compress("\n".join(held).encode())], pa.binary())], names=["block", "first", "lines"])

    parts = max(1, min(lines.sparkSession.sparkContext.defaultParallelism * 4, total // per_block + 1, MAX_BLOCKS // 2))
    dealt = lines.repartitionByRange(parts, "key", "file", "at").sortWithinPartitions("key", "file", "at")
    blocks = stored(map_arrow(dealt, run, "block long, first string, lines binary"), "warc-blocks")
    directory = sorted((r["first"], r["block"]) for r in blocks.select("first", "block").collect())  # MAX_BLOCKS entries at most
    return blocks.select("block", "lines"), directory


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, payload binary"


def lookup(wanted: DataFrame, blocks: DataFrame, directory: list[tuple[str, int]], folder: str, with_payload=True, parts: int | None = None, stretch=STRETCH) -> DataFrame:
    """wanted: page_id, url. The records of these captures, read by ranges from the archives (READ)
    in `parts` tasks (none: four for each core), each stretch of an archive by one of them.

    A block of the index is sent once, to the task of its askers. A capture that the index doesn't have gives no row; one that was asked for twice, or
    written twice, comes once for each pair of asking and archived row."""
    firsts, numbers = [k for k, _ in directory], [n for _, n in directory]

    def route(batches):
        for b in batches:
            keys = [f"{reversed_host_key(u)} {NO_ID if i is None else i}" for i, u in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
            out_k, out_b = [], []
            for k in keys:
                hi = bisect.bisect_right(firsts, k)
                lo = max(0, bisect.bisect_left(firsts, k) - 1)  # equal lines may begin in the block before
                out_k += [k] * (hi - lo)
                out_b += numbers[lo:hi]
            yield pa.RecordBatch.from_arrays([pa.array(out_b, pa.int64()), pa.array(out_k, pa.string())], names=["b", "k"])

    def find(batches):
        keys, lines = [], []
        for b in batches:
            found = []
            for raw, k in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                if raw is not None:  # the block, before its askers
                    lines = zlib.decompress(raw).decode().split("\n")
                    keys = [x.split("\t", 1)[0] for x in lines]
                    continue
                i = bisect.bisect_left(keys, k)
                while i < len(keys) and keys[i] == k:
                    found.append(lines[i].split("\t")[1:])
                    i += 1
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([int(x[1]) for x in found], pa.int64()), pa.array([int(x[2]) for x in found], pa.int64())], names=["file", "at", "length"])

    def read(batches):
        system, path = file_system(folder)
        opened = source = None
        for b in batches:
            rows = []
            for file, at, length in zip(*(c.to_pylist() for c in b.columns)):
                if file != opened:
                    if source is not None:
                        source.close()
                    source, opened = system.open_input_file(f"{path}/{file}"), file
                source.seek(at)
                h, body = parse(zlib.decompress(source.read(length), 31))
                kind = h["WARC-Type"]
                whole = kind == "response"
                rows.append((
                    _page(h["WARC-Record-ID"]), h["WARC-Target-URI"], kind,
                    len(body) if whole else int(h["X-Payload-Length"]), digest_of(body) if whole else h["WARC-Payload-Digest"].removeprefix("sha1:"),
                    None if whole else _page(h["WARC-Refers-To"]), body if with_payload and whole else None,
                ))
            types = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows) if rows else [()] * 7, types)], names=[x.split()[0] for x in READ.split(", ")])
        if source is not None:
            source.close()

    parts = parts or 4 * wanted.sparkSession.sparkContext.defaultParallelism
    asked = map_arrow(wanted.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url")), route, "b long, k string")
    rows = blocks.select(F.col("block").alias("b"), "lines", F.lit(None).cast("string").alias("k")).unionByName(asked.select("b", F.lit(None).cast("binary").alias("lines"), "k"))
    places = map_arrow(rows.repartition(parts, "b").sortWithinPartitions("b", F.col("lines").isNull(), "k"), find, "file string, at long, length long")
    dealt = places.repartition(parts, F.col("file"), F.expr(f"at div {stretch}")).sortWithinPartitions("file", "at")
    return map_arrow(dealt, read, READ)


def archive_and_read(pages: DataFrame, least_bytes=0, id_col="page_id", url_col="url", html_col="html") -> DataFrame:
    """Writes a record per row of `pages` and reads every one back through the index:
    page_id, url, record_type, payload_bytes, payload_digest, refers_to.

    Null ids, URLs and payloads are written as such; an empty table gives an empty result."""
    spark = pages.sparkSession
    folder = new_path(spark, "warc-archives")
    rows = captures(pages, least_bytes, id_col, url_col, html_col)
    lines = stored(write_archives(rows, folder), "warc-lines")
    total, size = lines.agg(F.count(F.lit(1)), F.coalesce(F.sum("length"), F.lit(0))).first()
    blocks, directory = build_index(lines, total)
    # each archived capture is asked for once
    asked = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url")).distinct()
    # small archives are still read by all cores, in as short stretches as that takes
    parts = max(1, min(2 * spark.sparkContext.defaultParallelism, total // 256), -(-size // READ_BYTES))
    return lookup(asked, blocks, directory, folder, False, parts, max(1 << 16, min(STRETCH, size // (8 * parts)))).drop("payload")


def op9(spark, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back through the index."""
    return archive_and_read(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
