"""Byte-level BPE encoding and decoding with tiktoken and a local rank file.

The rank file's path is a parameter and is opened on the executors, where the
vocabulary is loaded once for each Python worker. Long texts are split before
the library sees them, at places where its pattern always ends a match, so the
ids are those of the whole text; a text without such a place (no ASCII letter,
digit or full stop before a blank) is one piece however long it is. Decoding
gives raw bytes: ids need not be whole characters.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, table

#: Texts above so many characters are encoded in pieces of about that length.
PIECE = 1 << 16
#: A match of the pattern never goes on from a letter, digit or full stop over a
#: blank: between them it always ends. (The pattern has no look-behind, and its only
#: look-ahead concerns runs of blanks, which such a place precedes as a whole.)
SAFE = re.compile(r"(?<=[A-Za-z0-9.])(?=[ \n])")


def pieces(text: str, size: int = PIECE):
    """`text` cut at the first safe boundary after every `size` characters."""
    start = 0
    while len(text) - start > size:
        m = SAFE.search(text, start + size)
        if not m:
            break
        yield text[start : m.start()]
        start = m.start()
    yield text[start:]


@lru_cache(maxsize=4)
def encoding(rank_file: str, pattern: str):
    import tiktoken

    with open(rank_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


@lru_cache(maxsize=4)
def _decimals(rank_file: str, pattern: str) -> list[bytes]:
    return [str(i).encode() for i in range(encoding(rank_file, pattern).n_vocab)]


def encode_text(text: str | None, rank_file: str, pattern: str, size: int = PIECE) -> list[int]:
    enc, out = encoding(rank_file, pattern), []
    for p in pieces(text or "", size):
        out += enc.encode_ordinary(p)
    return out


def encode(docs: DataFrame, rank_file: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """id, ids (array<int>) for each row. A null text is empty: no ids."""

    def run(batches):
        for b in batches:
            ids = pa.array([encode_text(t, rank_file, pattern) for t in b.column(1).to_pylist()], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], names=["id", "ids"])

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")), run, "id long, ids array<int>")


def decode(rows: DataFrame, rank_file: str, pattern: str, id_col="id", ids_col="ids") -> DataFrame:
    """id, raw (binary): the bytes that the ids stand for. Null ids: null."""

    def run(batches):
        enc = encoding(rank_file, pattern)
        for b in batches:
            raw = pa.array([None if x is None else enc.decode_bytes(x) for x in b.column(1).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column(0), raw], names=["id", "raw"])

    return rows.select(F.col(id_col).cast("long").alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, "id long, raw binary")


def round_trip(docs: DataFrame, rank_file: str, pattern: str, id_col="doc_id", text_col="text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encoding and decoding in one pass,
    so that ids cross to the JVM as digests only."""

    def run(batches):
        enc, names = encoding(rank_file, pattern), _decimals(rank_file, pattern)
        for b in batches:
            n, ids_sha, raw_sha = [], [], []
            for t in b.column(1).to_pylist():
                count, ids_hash, raw_hash = 0, hashlib.sha256(), hashlib.sha256()
                for p in pieces(t or ""):
                    ids = enc.encode_ordinary(p)
                    if ids:
                        ids_hash.update((b"," if count else b"") + b",".join([names[i] for i in ids]))
                        raw_hash.update(enc.decode_bytes(ids))
                        count += len(ids)
                n.append(count)
                ids_sha.append(ids_hash.hexdigest())
                raw_sha.append(raw_hash.hexdigest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(ids_sha), pa.array(raw_sha)], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10(spark, sf_dir: str) -> DataFrame:
    """All documents encoded and decoded: counts and digests."""
    import public_tokenizers as P

    return round_trip(table(spark, sf_dir, "documents"), P.path("byte_bpe_multi_50k.tiktoken"), P.PATTERN)
