"""Ordered keyed folds: the one operator that Catalyst can't express.

Rows are dealt by key and sorted once by the fold's order; each task then streams its
rows through one accumulator per key. A group is never collected: memory is that of the
accumulator and one Arrow batch, however many rows a key has. Columns are pruned before
the shuffle and everything after the fold is relational again.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame

from ..schemas import names

_ARROW = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "binary": pa.binary(), "double": pa.float64(), "decimal(38,0)": pa.decimal128(38, 0)}
#: Rows of an output batch.
OUT = 8192


def values_of(c: pa.Array) -> list:
    """c.to_pylist(), quicker for whole numbers (decimals without places are such), for strings of few values and where all is null."""
    n, nulls = len(c), c.null_count
    if nulls == n:
        return [None] * n
    if pa.types.is_decimal(c.type) and c.type.scale == 0:
        try:
            c = c.cast(pa.int64())
        except pa.ArrowInvalid:  # beyond 64 bits
            return [None if v is None else int(v) for v in c.to_pylist()]
    if pa.types.is_integer(c.type):
        if not nulls:
            return c.to_numpy(zero_copy_only=False).tolist()
        known = c.is_valid().to_numpy(zero_copy_only=False).tolist()
        return [v if k else None for v, k in zip(c.fill_null(0).to_numpy(zero_copy_only=False).tolist(), known)]
    if pa.types.is_string(c.type):
        coded = c.dictionary_encode()
        if len(coded.dictionary) <= 64:
            names = [*coded.dictionary.to_pylist(), None]
            return [names[i] for i in coded.indices.fill_null(len(names) - 1).to_numpy(zero_copy_only=False).tolist()]
    return c.to_pylist()


def rows_of(batches) -> Iterator[dict]:
    for b in batches:
        cols, keys = [values_of(c) for c in b.columns], b.schema.names
        for row in zip(*cols):
            yield dict(zip(keys, row))


def batch_of(rows: list[tuple], ddl: str) -> pa.RecordBatch:
    types = [_ARROW[x.split(" ", 1)[1]] for x in ddl.split(", ")]
    cols = list(zip(*rows)) if rows else [()] * len(types)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=names(ddl))


def fold(df: DataFrame, key: str, order: list[str], step: Callable[[object, Iterator[dict]], Iterator[tuple]], out: str, columns: list[str] | None = None) -> DataFrame:
    """`step(key value, its rows in order)` yields the output rows (tuples of `out`) of one key."""

    def run(batches):
        held: list[tuple] = []
        for k, rows in groupby(rows_of(batches), lambda r: r[key]):
            for row in step(k, rows):
                held.append(row)
                if len(held) >= OUT:
                    yield batch_of(held, out)
                    held = []
        yield batch_of(held, out)

    rows = df.select(*columns) if columns else df
    return rows.repartition(key).sortWithinPartitions(key, *order).mapInArrow(run, out)
