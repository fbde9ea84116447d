"""Ordered groups as streams: rows sorted within tasks go through Arrow batch by batch, with a small state between.

A task never holds a group, only what the operator keeps of it, so a group may be of any length. A group may also be
spread over many tasks: what each makes of its part is then merged in order.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ortholake.plans.shared import shared_dir


def _changes(column: pa.Array) -> np.ndarray:
    """Whether each value but the first differs from the one before; nulls are alike, and so are NaNs."""
    a, b = column.slice(1), column.slice(0, len(column) - 1)
    differs = pc.fill_null(pc.not_equal(a, b), False).to_numpy(zero_copy_only=False)
    if pa.types.is_floating(column.type):
        nan = np.isnan(column.to_numpy(zero_copy_only=False))
        differs = differs & ~(nan[1:] & nan[:-1])
    return differs | (pc.is_null(a).to_numpy(zero_copy_only=False) != pc.is_null(b).to_numpy(zero_copy_only=False))


def segments(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[bool, pa.RecordBatch]]:
    """(begins a group, rows of one group) from batches in which groups are together."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        own = batch.select(keys)
        new = np.zeros(batch.num_rows, bool)
        if last is None:
            new[0] = True
        elif keys:
            both = pa.Table.from_batches([last, own.slice(0, 1)]).combine_chunks()
            new[0] = any(_changes(c.combine_chunks())[0] for c in both.columns)
        for column in own.columns:
            new[1:] |= _changes(column)
        last = own.slice(batch.num_rows - 1, 1)
        starts = np.flatnonzero(new).tolist()
        edges = sorted({0, *starts, batch.num_rows})
        for a, b in zip(edges[:-1], edges[1:], strict=True):
            yield bool(new[a]), batch.slice(a, b - a)


def sorted_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Groups together, each in order; without keys all rows are one group, and one task's."""
    rows = df.repartition(*keys) if keys else df.coalesce(1)
    return rows.sortWithinPartitions(*keys, *order)


def map_groups(rows: DataFrame, keys: list[str], new: Callable[[], object], added: list[T.StructField]) -> DataFrame:
    """``rows`` with the columns that ``new().step`` gives for each piece of a group, in order."""
    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = None
        for begins, rows in segments(batches, keys):
            if begins:
                state = new()
            yield pa.RecordBatch.from_arrays([*rows.columns, *state.step(rows)], names=schema.names)

    return rows.mapInArrow(run, schema)


def fold_groups(rows: DataFrame, keys: list[str], new: Callable[[], object], out: str, result: T.DataType) -> DataFrame:
    """``keys`` and ``out``, which is ``new().finish()`` after each piece of a group went through ``step``."""
    from ortholake.functions.columns import raise_if_empty

    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField(out, result)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        kind = to_arrow_type(result)

        def done(key: pa.RecordBatch, state: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*key.columns, pa.array([state.finish()], kind)], names=schema.names)

        state = key = None
        for begins, rows in segments(batches, keys):
            if begins:
                if state is not None:
                    yield done(key, state)
                state, key = new(), rows.select(keys).slice(0, 1)
            state.step(rows)
        if state is not None:
            yield done(key, state)

    found = rows.mapInArrow(run, schema)
    return found if keys else raise_if_empty(found, out)


# One group over many tasks: rows in ranges, so that the order of tasks is the order of rows.


def spread_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """Rows in ranges of (keys, order), each range in order; a group may go on from one task to the next."""
    return df.repartitionByRange(*(F.col(k) for k in keys), *order).sortWithinPartitions(*keys, *order)


def halo_rows(rows: DataFrame, clock: str, reach: float) -> DataFrame | None:
    """``rows`` with ``_range``, by ranges of the clock, and, marked by ``_halo``, copies of those less than ``reach``
    before a later range in that range too. So each range has all that its rows look back at, and only copies are added
    to what is moved. Null if there is just one range.

    Where ranges begin are quantiles of the clock, from one pass. Doubles are compared, so a range may get a few copies
    more than it needs.
    """
    from pyspark.ml.feature import Bucketizer

    n = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    begin = F.col(clock).cast("double")
    if isinstance(rows.schema[clock].dataType, T.TimestampNTZType):  # microseconds, whatever the session's zone
        day, seconds = F.unix_date(F.to_date(clock)), F.hour(clock) * 3600 + F.minute(clock) * 60 + F.date_part(F.lit("SECOND"), clock)
        begin = (day.cast("double") * 86400 + seconds.cast("double")) * 1e6
    found = rows.select(begin.alias("c")).where("c is not null and not isnan(c)")
    edges = sorted(set(found.approxQuantile("c", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    if not edges:
        return None
    rows = rows.withColumn("_begin", begin).withColumn("_end", begin + F.lit(float(reach)) + 1e-14 * F.abs(begin))
    splits = [-float("inf"), *edges, float("inf")]
    cut = Bucketizer(splitsArray=[splits, splits], inputCols=["_begin", "_end"], outputCols=["_first", "_last"], handleInvalid="keep").transform(rows)
    ranges = F.sequence(F.col("_first").cast("int"), F.greatest("_first", "_last").cast("int"))
    cut = cut.withColumn("_range", F.explode(ranges))
    return cut.withColumn("_halo", F.col("_range") > F.col("_first")).drop("_begin", "_end", "_first", "_last")


def fold_spread(rows: DataFrame, keys: list[str], new: Callable[[], object], out: str, result: T.DataType) -> DataFrame:
    """As ``fold_groups`` over ``spread_rows``: each task's part of a group is folded, and the parts merged in order."""
    from ortholake.plans.two_stage import finished, grouped

    fields = [rows.schema[k] for k in keys]
    schema = T.StructType([*fields, T.StructField("_part", T.LongType()), T.StructField("_state", T.BinaryType())])

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()

        def done(key: pa.RecordBatch, state: object) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*key.columns, pa.array([part]), pa.array([pickle.dumps(state.summary())], pa.binary())], names=schema.names)

        state = key = None
        for begins, piece in segments(batches, keys):
            if begins:
                if state is not None:
                    yield done(key, state)
                state, key = new(), piece.select(keys).slice(0, 1)
            state.step(piece)
        if state is not None:
            yield done(key, state)

    def merge(table: pa.Table) -> pa.Table:
        state = new()
        for data in table.sort_by("_part")["_state"].to_pylist():
            state.absorb(pickle.loads(data))
        return finished(table, keys, state.finish(), out, result)

    return grouped(rows.mapInArrow(partial, schema), keys, merge, fields, out, result)


def map_spread(rows: DataFrame, keys: list[str], new: Callable[[], object], added: list[T.StructField]) -> DataFrame:
    """As ``map_groups`` over ``spread_rows``, in two passes over a checkpoint of the sorted rows.

    The first leaves what each task's last group adds up to, a row for each task; from these the driver makes the state
    with which each task's first group begins. The second pass maps the rows.
    """
    shared_dir(rows.sparkSession)
    rows = rows.checkpoint()

    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = first = last = None
        groups = 0
        for begins, piece in segments(batches, keys):
            if begins:
                state, groups = new(), groups + 1
                last = tuple(c[0].as_py() for c in piece.select(keys).columns)
                first = last if groups == 1 else first
            state.step(piece)
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()]), pa.array([pickle.dumps((first, last, groups == 1, state.summary()))], pa.binary())], names=["part", "end"])

    seeds: dict[int, bytes] = {}
    held = held_key = None
    for r in sorted(rows.mapInArrow(ends, "part long, end binary").collect()):
        first, last, single, summary = pickle.loads(r["end"])
        goes_on = held is not None and held_key == first
        if goes_on:
            seeds[r["part"]] = pickle.dumps(held.summary())
        if not (goes_on and single):
            held = new()
        held.absorb(summary)
        held_key = last

    schema = T.StructType([*rows.schema.fields, *added])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, seed = None, seeds.get(TaskContext.get().partitionId())
        for begins, piece in segments(batches, keys):
            if begins:
                state = new()
                if seed:
                    state.absorb(pickle.loads(seed))
                seed = None
            yield pa.RecordBatch.from_arrays([*piece.columns, *state.step(piece)], names=schema.names)

    return rows.mapInArrow(run, schema)
