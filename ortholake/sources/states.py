"""Tables of states in shared storage: written once per batch of data, merged when read."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from ortholake.operators.states import merge_covariance_states, merge_least_squares_states

MERGES = {"least_squares": merge_least_squares_states, "covariance": merge_covariance_states}


def write_states(states: DataFrame, path: str, *, mode: str = "append", partition_by: Sequence[str] = ()) -> None:
    """Add rows of keys and state bytes to a Parquet table."""
    states.write.mode(mode).partitionBy(*partition_by).parquet(path)


def read_merged(spark: SparkSession, path: str, kind: str, *, by: str | Sequence[str] | None = None, state: str = "state") -> DataFrame:
    """One state per group of all that the table holds; ``kind`` is "least_squares" or "covariance"."""
    return MERGES[kind](spark.read.parquet(path), state, by=by, out=state)
