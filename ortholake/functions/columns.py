"""Column arguments: a name, a Column, or a sequence of these, checked against the schema before anything runs."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ortholake.functions.errors import InputError

ColumnArg = str | Column
NUMERIC = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType)
INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)


def as_list(columns: ColumnArg | Sequence[ColumnArg]) -> list[ColumnArg]:
    found = [columns] if isinstance(columns, str | Column) else list(columns)
    if not found:
        raise ValueError("at least one column is required")
    return found


def names_of(df: DataFrame, columns: Sequence[ColumnArg]) -> list[str]:
    """Names for labels: a name or an alias as it is; else the first column that the expression mentions."""
    names = []
    for i, column in enumerate(columns):
        name = df.select(column).columns[0]
        if name not in df.columns and not re.fullmatch(r"\w+", name):
            name = next((word for word in re.findall(r"\w+", name) if word in df.columns), f"column_{i}")
        names.append(name)
    return names


def numeric(df: DataFrame, columns: Sequence[ColumnArg]) -> list[Column]:
    """The columns as doubles; anything but an integer or a float is refused."""
    found = []
    for column in columns:
        field = df.select(column).schema[0]
        if not isinstance(field.dataType, NUMERIC):
            raise InputError(f"column {field.name!r} of type {field.dataType.simpleString()} is not numeric")
        found.append((F.col(column) if isinstance(column, str) else column).cast("double"))
    return found


def keys_of(by: str | Sequence[str] | None) -> list[str]:
    return [] if by is None else [by] if isinstance(by, str) else list(by)


def one_of(value: str, allowed: Sequence[str], parameter: str) -> str:
    if value not in allowed:
        raise ValueError(f"{parameter} must be one of {', '.join(map(repr, allowed))}, not {value!r}")
    return value


def raise_if_empty(result: DataFrame, out: str) -> DataFrame:
    """A result without groups as exactly one row; without a row, the error for empty input."""
    spark = result.sparkSession
    one = spark.range(1).join(F.broadcast(result.withColumn("_there", F.lit(0).cast("long"))), F.col("id") == F.col("_there"), "left")
    return one.select(F.when(F.col("_there").isNull(), F.raise_error(F.lit("the input has no rows"))).otherwise(F.col(out)).alias(out))


def flat(result: DataFrame, out: str, flatten: bool) -> DataFrame:
    return result.select(*(c for c in result.columns if c != out), f"{out}.*") if flatten else result
