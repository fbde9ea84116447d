"""Packed exchanges: many small values as one row of binary columns for each slice of texts and hash range.

A slice of texts has a number ``g`` made of its task and its place in the task, the same whenever the task runs again.
What a task finds goes to the reducers of hash ranges, packed, and what these find comes back to the slice by ``g``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

PACKED = "part int, g long, kind int, a binary, b binary, c binary"


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def squeeze(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=0).astype(np.int32).tobytes())


def unsqueeze(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int32), dtype=np.int64)


def squeeze_long(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.diff(x, prepend=0).astype(np.int64).tobytes())


def unsqueeze_long(x: bytes) -> np.ndarray:
    return np.cumsum(np.frombuffer(zstandard.ZstdDecompressor().decompress(x), np.int64), dtype=np.int64)


def rows_of(schema: pa.Schema, rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(x), f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)


PACKED_ARROW = pa.schema([("part", pa.int32()), ("g", pa.int64()), ("kind", pa.int32()), ("a", pa.binary()), ("b", pa.binary()), ("c", pa.binary())])


def part_of(keys: np.ndarray, parts: int) -> np.ndarray:
    return ((keys >> np.uint64(33)) % np.uint64(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)


def by_part(keys: np.ndarray, parts: int) -> Iterator[tuple[int, np.ndarray]]:
    """(part, positions in order) for each part that ``keys`` fall into."""
    yield from grouped_parts(part_of(keys, parts))


def grouped_parts(part: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(part, kind="stable")
    which, first = np.unique(part[order], return_index=True)
    for p, own in zip(which.tolist(), np.split(order, first[1:]), strict=True):
        yield p, own


def number_of_parts(df: DataFrame) -> int:
    """Hash ranges for packed exchanges: with the input's partitions, so that each stays of the same size."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * df.rdd.getNumPartitions())


def table_bytes(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return sink.getvalue().to_pybytes()


def bytes_table(data: bytes) -> pa.Table:
    return pa.ipc.open_stream(data).read_all()


def key_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of rows with equal keys, from batches that are sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
        starts = np.concatenate([[0], np.flatnonzero((np.diff(columns, axis=1) != 0).any(0)) + 1, [batch.num_rows]])
        for a, b in zip(starts[:-1], starts[1:], strict=True):
            key = columns[:, a].tolist()
            if held and key != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(a, b - a))
            last = key
    if held:
        yield pa.Table.from_batches(held)
