"""Aggregation in two stages: each task folds its rows into one small state per group, and only states are shuffled."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ortholake.functions.columns import raise_if_empty
from ortholake.functions.errors import InputError

#: Groups that a task holds before it hands on what it has; states merge, so that is always right.
MOST_GROUPS = 4096


@dataclass
class Rows:
    """What a group has seen: rows, unusable values by column, and weights that can't be used."""

    names: list[str]
    total: int = 0
    bad: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    negative: int = 0

    def check(self, n: int, weight: float, weighted: bool, policy: str) -> None:
        if policy == "raise" and self.bad.any():
            at = int(self.bad.argmax() if self.bad.all() else np.flatnonzero(self.bad)[0])
            raise InputError(f"column {self.names[at]!r} holds {int(self.bad[at])} null or non-finite values; null_policy='drop' leaves their rows out")
        if self.negative:
            raise InputError(f"{self.negative} rows carry a negative weight")
        if not self.total:
            raise InputError("the input has no rows")
        if not n:
            raise InputError(f"all {self.total} rows were dropped, leaving nothing to compute from")
        if weighted and not weight > 0:
            raise InputError("no observation carries any weight")


def key_rows(batch: pa.RecordBatch, keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch, np.ndarray]]:
    """(key, one row of keys, row numbers) of each group in a batch; nulls are a key of their own."""
    if not keys:
        yield (), batch.select([]), np.arange(batch.num_rows)
        return
    table = pa.Table.from_batches([batch.select(keys)]).append_column("_row", pa.array(np.arange(batch.num_rows)))
    for group in table.group_by(keys).aggregate([("_row", "list")]).to_batches():
        rows = group.column("_row_list")
        own = group.select(keys)
        for i, key in enumerate(zip(*(c.to_pylist() for c in own.columns), strict=True)):
            yield key, own.slice(i, 1), rows[i].values.to_numpy()


def matrix_of(batch: pa.RecordBatch, columns: list[str]) -> np.ndarray:
    """Rows as doubles; nulls are NaN."""
    return np.column_stack([batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in columns]) if columns else np.zeros((batch.num_rows, 0))


def two_stage(
    df: DataFrame,
    by: list[str],
    values: list[Column],
    names: list[str],
    weighted: bool,
    new_state: Callable[[], object],
    add: Callable[[object, np.ndarray, np.ndarray | None], None],
    finish: Callable[[object], object],
    result: T.DataType,
    out: str,
    policy: str,
) -> DataFrame:
    """``by`` and ``out``, which is ``finish`` of the merged state of each group; weights are the last of ``values``."""
    columns = [f"_v{i}" for i in range(len(values))]
    key_fields = [df.schema[k] for k in by]
    partial_schema = T.StructType([*key_fields, T.StructField("_state", T.BinaryType()), T.StructField("_total", T.LongType()), T.StructField("_bad", T.ArrayType(T.LongType())), T.StructField("_negative", T.LongType())])
    decode = type(new_state()).decode

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, tuple] = {}

        def rows() -> Iterator[pa.RecordBatch]:
            for one, state, seen in held.values():
                arrays = [*one.columns, pa.array([state.encode()]), pa.array([seen.total]), pa.array([seen.bad.tolist()], pa.list_(pa.int64())), pa.array([seen.negative])]
                yield pa.RecordBatch.from_arrays(arrays, names=partial_schema.names)

        for batch in batches:
            data = matrix_of(batch, columns)
            usable = np.isfinite(data)
            for key, one, at in key_rows(batch, by):
                if key not in held:
                    if len(held) >= MOST_GROUPS:
                        yield from rows()
                        held = {}
                    held[key] = one, new_state(), Rows(names, bad=np.zeros(len(columns), np.int64))
                _, state, seen = held[key]
                good = usable[at].all(1)
                seen.total += len(at)
                seen.bad += (~usable[at]).sum(0)
                own = data[at[good]]
                if weighted:
                    own, w = own[:, :-1], own[:, -1]
                    seen.negative += int((w < 0).sum())
                    add(state, own, np.maximum(w, 0))
                else:
                    add(state, own, None)
        yield from rows()

    def merge(table: pa.Table) -> pa.Table:
        state, seen = new_state(), Rows(names, bad=np.zeros(len(columns), np.int64))
        for data, total, bad, negative in zip(*(table[c].to_pylist() for c in ("_state", "_total", "_bad", "_negative")), strict=True):
            state.merge(decode(data))
            seen.total, seen.bad, seen.negative = seen.total + total, seen.bad + np.array(bad, np.int64), seen.negative + negative
        seen.check(state.n, state.weight, weighted, policy)
        return finished(table, by, finish(state), out, result)

    return grouped(df.select(*by, *(v.alias(c) for v, c in zip(values, columns, strict=True))).mapInArrow(partial, partial_schema), by, merge, key_fields, out, result)


def finished(table: pa.Table, by: list[str], value: object, out: str, kind: T.DataType) -> pa.Table:
    """One row: the keys of ``table`` and ``value``."""
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.Table.from_arrays([*(table[k].slice(0, 1) for k in by), pa.chunked_array([pa.array([value], to_arrow_type(kind))])], names=[*by, out])


def grouped(rows: DataFrame, by: list[str], fold: Callable[[pa.Table], pa.Table], key_fields: list[T.StructField], out: str, result: T.DataType) -> DataFrame:
    """``fold`` of each group of ``rows``; without keys, of all rows, and an error where there are none."""
    schema = T.StructType([*key_fields, T.StructField(out, result)])
    if by:
        return rows.groupBy(*by).applyInArrow(fold, schema)
    return raise_if_empty(rows.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(fold, schema), out)
