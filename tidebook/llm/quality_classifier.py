"""Quality classifier: logistic regression over hashed word n-grams, trained with
follow-the-regularised-leader (FTRL-proximal) updates.

Features of a whole text, each a share of its tokens: hashed tokens, hashed pairs of
tokens, hashed triples of token shapes, the share of pairs that say one token twice, and
the share of token triples that the text has said before. A score is the logistic of a sparse dot product with the weights.

Training reads a bounded sample of labelled rows (MAX_TRAIN, taken by a hash of the id),
streams it through one task, and leaves one vector of 2^BITS weights, which every
scoring task gets. Everything else covers all rows.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import at_task_end, map_arrow, stored, table

BITS = 18
#: Labelled rows that training reads, at most.
MAX_TRAIN = 6000
#: Times that the sample is read.
EPOCHS = 2
ALPHA, BETA, L1, L2 = 1.0, 0.1, 1e-4, 1e-3
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Distinct tokens that a task keeps hashed.
CACHE = 1 << 18
_U = np.uint64
#: Odd multipliers of the n-gram hashes.
_M = (_U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9))
_DOWN = _U(64 - BITS)


class _Hashes(dict):
    """token -> hash of its lower case, with its shape in the low three bits."""

    def __missing__(self, token: str) -> int:
        if token[0].isalpha():
            shape = (1 if token.islower() else 2 if len(token) > 1 and token.isupper() else 3) if token.isalpha() else 4
        else:
            shape = 5 if token.isdigit() else 6 if len(token) == 1 else 7
        if len(self) >= CACHE:
            self.clear()
        out = self[token] = zlib.crc32(token.lower().encode("utf-8", "replace")) << 3 | shape
        return out


_HASHES = _Hashes()
at_task_end(_HASHES.clear)
_BIAS, _AGAIN, _ECHO = 0, 1, 2  # fixed places of the vector


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Places (repeats allowed) and values of a text's features."""
    h = np.array([_HASHES[t] for t in TOKEN.findall(text or "")], _U)
    n = len(h)
    idx, val = [np.array([_BIAS], _U)], [np.array([0.3])]
    if n:
        word, shape = h >> _U(3), h & _U(7)
        grams = [(word + _U(1)) * _M[0]]
        if n > 1:
            grams.append((word[:-1] * _M[0]) ^ (word[1:] + _U(7)) * _M[1])
            idx.append(np.array([_ECHO], _U))
            val.append(np.array([np.count_nonzero(word[:-1] == word[1:]) / (n - 1)]))
        if n > 2:
            triple = (word[:-2] * _M[0]) ^ (word[1:-1] * _M[1]) ^ (word[2:] * _M[2])
            grams.append((shape[:-2] * _U(64) + shape[1:-1] * _U(8) + shape[2:] + _U(1 << 40)) * _M[1])
            idx.append(np.array([_AGAIN], _U))
            val.append(np.array([1 - len(np.unique(triple)) / len(triple)]))
        for g in grams:
            idx.append((g * _M[2]) >> _DOWN)
            val.append(np.full(len(g), 1 / len(g)))
    return np.concatenate(idx).astype(np.int64), np.concatenate(val)


def logistic(z: float) -> float:
    return float(1 / (1 + np.exp(-min(max(z, -35.0), 35.0))))


class Ftrl:
    """FTRL-proximal logistic regression; weights are those of the per-place closed form."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at=slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, idx: np.ndarray, val: np.ndarray, label: int) -> None:
        at, back = np.unique(idx, return_inverse=True)
        x = np.bincount(back, val)
        w = self.weights(at)
        g = (logistic(float(w @ x)) - label) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / ALPHA * w
        self.n[at] = n + g * g


def crc_fold(id_col):
    """Column: crc32 of the id as text, modulo 5 (null id: that of the empty text)."""
    return F.pmod(F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), F.lit(5))


def train(docs: DataFrame, labels: DataFrame, id_col="doc_id", text_col="text", label_col="quality", max_train=MAX_TRAIN, epochs=EPOCHS) -> np.ndarray:
    """Weights (float32) learned from labelled rows whose fold is not 0. Labels other than
    0 and 1, and null ids, teach nothing; of rows that repeat an id the least text does. No
    labels at all give weights of zero."""
    known = labels.select(F.col(id_col).cast("long").alias("i"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1) and i is not null").filter(crc_fold(F.col("i")) != 0)
    known = known.groupBy("i").agg(F.max("y").alias("y")).orderBy(F.xxhash64("i"), "i").limit(max_train)
    sample = docs.select(F.col(id_col).cast("long").alias("i"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(known), "i")  # max_train rows of two numbers
    sample = sample.groupBy("i", "y").agg(F.min("text").alias("text"))  # an id that repeats teaches once
    sample = stored(sample.select("y", F.xxhash64("i").alias("h"), "i", "text"), "classifier-sample")
    turns = sample.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs))))

    def run(batches):
        model = Ftrl(1 << BITS)
        for b in batches:
            for y, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                model.learn(*features(text), y)
        yield pa.RecordBatch.from_arrays([pa.array([model.weights().astype("<f4").tobytes()], pa.binary())], names=["w"])

    ordered = turns.repartition(1).sortWithinPartitions("epoch", "h", "i", "text").select("y", "text")
    learned = ordered.mapInArrow(run, "w binary").first()  # none if there is no row to learn from
    return np.frombuffer(learned["w"], "<f4") if learned else np.zeros(1 << BITS, "<f4")


def score(docs: DataFrame, weights: np.ndarray, id_col="doc_id", text_col="text", keep=()) -> DataFrame:
    """id, score (double, 0 to 1) and the columns `keep`. A null text is scored as an empty one."""
    sent = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))  # 2^BITS numbers

    def run(batches):
        w = sent.value
        for b in batches:
            out = []
            for text in b.column(1).to_pylist():
                idx, val = features(text)
                out.append(logistic(float(np.dot(w[idx], val))))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.float64()), *b.columns[2:]], names=["id", "score", *keep])

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("_text"), *keep)
    kinds = dict(rows.dtypes)
    return map_arrow(rows, run, ", ".join(["id long", "score double", *[f"`{c}` {kinds[c]}" for c in keep]]))


def op3(spark, sf_dir: str) -> DataFrame:
    """A quality score for every document, learned from labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    scored = score(docs, train(docs, table(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), (crc_fold(F.col("id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
