"""Clocks and spans: any non-decreasing integer, float, date or timestamp; only distances on it matter."""

from __future__ import annotations

import math
from datetime import timedelta

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ortholake.functions.columns import INTEGRAL, ColumnArg
from ortholake.functions.errors import InputError

MICROS_PER_DAY = 86_400_000_000


def clock_column(df: DataFrame, clock: ColumnArg, operation: str) -> tuple[Column, str]:
    """(the clock as a long or a double, its unit: number, day or micro)."""
    field = df.select(clock).schema[0]
    column = F.col(clock) if isinstance(clock, str) else clock
    if isinstance(field.dataType, INTEGRAL):
        return column.cast("long"), "number"
    if isinstance(field.dataType, T.FloatType | T.DoubleType):
        return column.cast("double"), "number"
    if isinstance(field.dataType, T.DateType):
        return F.unix_date(column).cast("long"), "day"
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(column), "micro"
    if isinstance(field.dataType, T.TimestampNTZType):
        return column, "micro"  # a wall-clock time, of no zone: Arrow holds its microseconds
    raise InputError(f"{operation} received a clock {field.name!r} of type {field.dataType.simpleString()}; a clock must be an integer, a float, a date or a timestamp")


def span(value: float | timedelta, unit: str, parameter: str, operation: str, zero: bool = False) -> float:
    """A span in the clock's own units; a duration for a temporal clock, a number for a numeric one."""
    if isinstance(value, bool) or not isinstance(value, int | float | timedelta):
        raise TypeError(f"{parameter} must be a number or a datetime.timedelta, not {type(value).__name__}")
    if isinstance(value, timedelta):
        if unit == "number":
            raise InputError(f"{operation} received a numeric clock and a duration for {parameter}. Use a number in the units of the clock")
        found = float(value // timedelta(microseconds=1)) / (MICROS_PER_DAY if unit == "day" else 1)
    elif unit != "number":
        raise InputError(f"{operation} received a temporal clock and a number for {parameter}. Use datetime.timedelta")
    else:
        found = float(value)
    if not math.isfinite(found) or found < 0 or (found == 0 and not zero):
        raise InputError(f"{operation} requires {parameter} > 0; received {value!r}")
    return found


def checked_clock(column: pa.Array, last: float | int | None, operation: str) -> np.ndarray:
    """The clock of a piece of a group, after checking it against itself and the piece before."""
    if column.null_count:
        raise InputError(f"{operation} received a null clock")
    if pa.types.is_timestamp(column.type):
        column = column.cast(pa.timestamp("us")).cast(pa.int64())
    clock = column.to_numpy(zero_copy_only=False)
    if clock.dtype.kind == "f" and not np.isfinite(clock).all():
        raise InputError(f"{operation} received a clock value that is not finite")
    if len(clock) > 1 and (clock[1:] < clock[:-1]).any() or last is not None and len(clock) and clock[0] < last:
        raise InputError(f"{operation} requires a non-decreasing clock")
    return clock


def checked_values(column: pa.Array, name: str, operation: str, policy: str) -> np.ndarray:
    """Values with NaN for nulls; a NaN or an infinity in the input is an error."""
    if column.null_count and policy == "raise":
        raise InputError(f"{operation} received a null value in {name!r}; null_policy='skip' lets the state decay past it")
    values = column.to_numpy(zero_copy_only=False).astype(float)
    present = column.is_valid().to_numpy(zero_copy_only=False)
    if not np.isfinite(values[present]).all():
        raise InputError(f"{operation} received a value in {name!r} that is not finite")
    return np.where(present, values, np.nan)
