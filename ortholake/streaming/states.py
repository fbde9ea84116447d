"""States of a stream: each micro-batch adds its own, and what has been seen so far is their merge.

A micro-batch that runs again overwrites its own partition, so the table holds every row of the stream once.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ortholake.operators.states import covariance_state, least_squares_state


def _write(stream: DataFrame, build: Callable[[DataFrame], DataFrame], path: str, checkpoint: str, **trigger) -> StreamingQuery:
    def batch(rows: DataFrame, number: int) -> None:
        if not rows.isEmpty():
            states = build(rows).withColumn("batch", F.lit(number))
            states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch").parquet(path)

    writer = stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()


def stream_least_squares_states(stream: DataFrame, targets, features, path: str, checkpoint: str, *, by: str | Sequence[str] | None = None, weights=None, intercept: bool = False, null_policy: str = "raise", **trigger) -> StreamingQuery:
    """A running query that adds a state per group and micro-batch to the table at ``path``."""
    return _write(stream, lambda rows: least_squares_state(rows, targets, features, by=by, weights=weights, intercept=intercept, null_policy=null_policy), path, checkpoint, **trigger)


def stream_covariance_states(stream: DataFrame, features, path: str, checkpoint: str, *, by: str | Sequence[str] | None = None, weights=None, null_policy: str = "raise", **trigger) -> StreamingQuery:
    """As ``stream_least_squares_states``, with covariance states."""
    return _write(stream, lambda rows: covariance_state(rows, features, by=by, weights=weights, null_policy=null_policy), path, checkpoint, **trigger)
