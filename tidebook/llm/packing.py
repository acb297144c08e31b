"""Hierarchical multi-length packing of tokenised documents into training sequences.

Documents become token ids and an end id. Each is routed by its length: whole
windows of the longest tier are cut off a longer document as sequences of their
own; what is left of it, or a shorter document, goes to the smallest tier (256,
512, 1024, 2048) that holds it. Every tier is packed in windows of its own size,
the longest tier first: a window is opened with the tier's longest piece, and its
gap is filled with the longest pieces that fit, from the tier of the gap and the
shorter ones. A gap that no whole piece fits is closed by cutting one. So a
document is trained on at the smallest context that holds it, short ones also in
the gaps of longer windows, and all sequences are full windows of a tier: powers
of two, without padding. What is left when the rows end is cut to powers of two.

Packing runs inside each task over a bounded buffer of tokens: no shuffle, no
token crosses the network, memory does not follow the table or a document's
length beyond its own ids, and a lost task packs its own split again to the
same result. Sequences of each buffer are dealt to step groups so that groups
have nearly equal tokens, tiers and attention cost.
"""

from __future__ import annotations

import bisect
import json
import re
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_task_end, map_arrow, table

TIERS = (256, 512, 1024, 2048)
#: Tokens that a task packs at a time.
BUFFER = 1 << 21
#: Windows of the longest tier whose tokens make a step group; shorter windows count by their share.
STEP_SIZE = 64
END_ID = 1
#: Words and pieces that a task keeps at hand, for each of its tables.
CACHE = 1 << 18


_PACK = [struct.Struct(f"<{n}I").pack for n in range(16)]


def _packed(ids: list[int]) -> bytes:
    return _PACK[len(ids)](*ids) if len(ids) < len(_PACK) else np.array(ids, "<u4").tobytes()


class WordTokens:
    """Ids of texts under a `tokenizers` file. If its normalizer and pre-tokenizer are those
    stated here, which drop white space and never cross it, the ids of a text are those of
    its words in turn, so each distinct word is encoded once: a word of Latin letters takes
    its pieces straight to the model, any other goes through the whole tokenizer. Texts under
    any other file go through the whole tokenizer as they are."""

    # Fixed values of the vocabulary whose words are encoded one by one.
    NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
    PRE_TOKENIZER = {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    }

    #: The pre-tokenizer's pattern on lower-case text whose letters are Latin-1 (a fixed value of the vocabulary).
    PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")
    #: Words that the quick way may take: ASCII and the accented letters of Latin-1.
    PLAIN = re.compile(r"[!-~À-ÖØ-öø-ÿ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        spec = json.loads(self.whole.to_str())
        self.by_word = (spec["normalizer"], spec["pre_tokenizer"], spec["model"]["type"], all(t["special"] for t in spec["added_tokens"])) == (self.NORMALIZER, self.PRE_TOKENIZER, "BPE", True)
        self.model = self.whole.model
        printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        rest = [b for b in range(256) if b not in printable]
        self.as_char = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(rest)}
        self.words: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}

    def part(self, piece: str) -> bytes:
        """Ids of one lower-case piece of the pre-tokenizer."""
        out = self.parts.get(piece)
        if out is None:
            mapped = piece if piece.isascii() else "".join(map(self.as_char.__getitem__, piece.encode()))
            out = _packed([t.id for t in self.model.tokenize(mapped)])
            if len(self.parts) >= CACHE:
                self.parts = {}
            self.parts[piece] = out
        return out

    def word(self, raw: bytes) -> bytes:
        if raw.isalpha():  # ASCII letters only
            return self.part(raw.lower().decode())
        text = raw.decode()
        if not self.PLAIN.fullmatch(text):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        text = text.lower()
        return self.part(text) if text.isalpha() else b"".join(map(self.part, self.PIECES.findall(text)))

    def ids(self, text: str | None) -> bytes:
        """Little-endian unsigned 32-bit ids."""
        if not self.by_word:
            return np.array(self.whole.encode(text or "", add_special_tokens=False).ids, "<u4").tobytes()
        if len(self.words) >= CACHE:  # words still in use come back from the older half
            self.older, self.words = self.words, {}
        words, older = self.words, self.older
        raws = (text or "").encode("utf-8", "replace").split()  # at ASCII blanks
        out = list(map(words.get, raws))
        for i in [i for i, ids in enumerate(out) if ids is None]:
            raw = raws[i]
            got = older.get(raw)
            if got is None:
                got = self.word(raw)
            out[i] = got
            if len(raw) <= 64:
                words[raw] = got
        return b"".join(out)


_LOADED: dict[str, WordTokens] = {}


def tokens_of(path: str) -> WordTokens:
    if path not in _LOADED:
        _LOADED[path] = WordTokens(path)
    return _LOADED[path]


@at_task_end
def _forget() -> None:
    for t in _LOADED.values():
        t.words, t.older, t.parts = {}, {}, {}


class _Waiting:
    """Pieces by length, in tiers: the longest that fits a gap is found by bisection."""

    def __init__(self, pieces, tiers):
        self.tiers, self.lists = tiers, [[] for _ in tiers]
        for p in sorted(pieces, key=lambda p: (p[2], p[0], p[1])):
            self.lists[bisect.bisect_left(tiers, p[2])].append(p)
        self.keys = [[p[2] for p in x] for x in self.lists]
        self.left = sum(map(len, self.lists))

    def longest_within(self, gap: int):
        for k in range(bisect.bisect_left(self.tiers, gap) if gap <= self.tiers[-1] else len(self.tiers) - 1, -1, -1):
            i = bisect.bisect_right(self.keys[k], gap) - 1
            if i >= 0:
                self.left -= 1
                self.keys[k].pop(i)
                return self.lists[k].pop(i)
        return None

    def put(self, p):
        k = bisect.bisect_left(self.tiers, p[2])
        i = bisect.bisect_left(self.keys[k], p[2])
        self.keys[k].insert(i, p[2])
        self.lists[k].insert(i, p)
        self.left += 1


def pack(lengths: list[int], tiers=TIERS, last=True):
    """Sequences, each a list of pieces (document index, start, length).

    Every document is covered once. Sequences are full windows of a tier, except that
    with `last` the remainder is cut to powers of two. Without it, the pieces that did
    not fill a window are returned as the second value.
    """
    window = tiers[-1]
    full, rest = [], []
    for d, n in enumerate(lengths):
        for s in range(0, n - window + 1, window):
            full.append([(d, s, window)])
        if n % window:
            rest.append((d, n - n % window, n % window))
    waiting, total = _Waiting(rest, list(tiers)), sum(p[2] for p in rest)

    def fill(room: int):
        seq = []
        while room:
            p = waiting.longest_within(room)
            if p is None:  # close the gap by cutting the shortest piece of the shortest tier in use
                k = next(k for k, x in enumerate(waiting.lists) if x)
                waiting.keys[k].pop(0)
                d, s, n = waiting.lists[k].pop(0)
                waiting.left -= 1
                waiting.put((d, s + room, n - room))
                p = (d, s, room)
            seq.append(p)
            room -= p[2]
        return seq

    for k in range(len(tiers) - 1, -1, -1):  # what stands above is packed, so the longest piece that fits is this tier's
        while waiting.lists[k] and total >= tiers[k]:
            full.append(fill(tiers[k]))
            total -= tiers[k]
    if not last:
        return full, [p for x in waiting.lists for p in x]
    while total:
        room = 1 << (total.bit_length() - 1)
        full.append(fill(room))
        total -= room
    return full, []


def step_groups(sequences: list[tuple[int, int]], step_tokens: int = STEP_SIZE * TIERS[-1]) -> list[int]:
    """Group of each sequence (tokens, cost). Sequences are dealt in rounds from the longest, one to
    each group, in a round the costliest to the group with the least cost so far: groups differ
    by one sequence at most, by two of a tier, and their costs are levelled."""
    n = max(1, -(-sum(t for t, _ in sequences) // step_tokens))
    cost_so_far, out = [0] * n, [0] * len(sequences)
    order = sorted(range(len(sequences)), key=lambda j: (-sequences[j][0], -sequences[j][1], j))
    for at in range(0, len(order), n):
        least = sorted(range(n), key=lambda g: (cost_so_far[g], g))
        for j, g in zip(sorted(order[at : at + n], key=lambda j: (-sequences[j][1], j)), least):
            out[j] = g
            cost_so_far[g] += sequences[j][1]
    return out


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, sequence_tokens long, tier int, step_group long"


def pack_documents(docs: DataFrame, tokenizer_path: str, id_col="doc_id", text_col="text", tiers=TIERS, with_ids=False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id,
    offset, sequence_tokens, tier (smallest tier that holds the sequence), step_group
    and, on request, ids (array<int>).

    A null or empty text has its end id only. Rows are told apart by place, so
    repeated or null ids are packed like others. Empty table: empty result.
    """
    schema = PIECES + (", ids array<int>" if with_ids else "")

    def run(batches):
        from pyspark import TaskContext

        tok, ctx = tokens_of(tokenizer_path), TaskContext.get()
        base = (ctx.partitionId() if ctx else 0) << 32
        end = np.array([END_ID], "<u4").tobytes()
        state = {"seq": base, "group": base}

        def flush(held, last):
            sequences, left = pack([len(x[1]) // 4 for x in held], tiers, last)
            groups = step_groups([(sum(p[2] for p in seq), sum(p[2] ** 2 for p in seq)) for seq in sequences], STEP_SIZE * tiers[-1])
            rows = []
            for seq, g in zip(sequences, groups):
                at, size = 0, sum(p[2] for p in seq)
                tier = next(t for t in tiers if t >= size)
                for d, s, n in seq:
                    doc, ids, s0, total = held[d]
                    part = memoryview(ids)[4 * s : 4 * (s + n)]
                    rows.append((doc, s0 + s, n, zlib.crc32(part), total, state["seq"], at, size, tier, state["group"] + g, *([np.frombuffer(part, "<u4").tolist()] if with_ids else [])))
                    at += n
                state["seq"] += 1
            state["group"] += max(groups, default=-1) + 1
            # what filled no window waits for the next documents, as tails of its documents
            again = [(held[d][0], held[d][1][4 * s : 4 * (s + n)], held[d][2] + s, held[d][3], n) for d, s, n in left]
            cols = list(zip(*rows)) if rows else [()] * (10 + with_ids)
            types = [pa.int64()] * 8 + [pa.int32(), pa.int64()] + [pa.list_(pa.int32())] * with_ids
            names = [x.split()[0] for x in schema.split(", ")]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names), again

        held, size = [], 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = tok.ids(text) + end
                held.append((doc, ids, 0, len(ids) // 4))
                size += len(ids) // 4
                if size >= BUFFER:
                    out, again = flush(held, False)
                    yield out
                    held, size = [x[:4] for x in again], sum(x[4] for x in again)
        yield flush(held, True)[0]

    return map_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def op5(spark, sf_dir: str) -> DataFrame:
    """All documents packed: a row for each piece of a sequence."""
    import public_tokenizers as P

    return pack_documents(table(spark, sf_dir, "documents"), P.path("word_bpe_49k.json"))
