"""Connected components of an edge table, without bringing it to the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholake.llm._store import materialize


#: Edges that a task of a step gets, about.
EDGES_A_TASK = 500_000


def _written(edges: DataFrame, n: int) -> tuple[DataFrame, tuple]:
    """``edges`` in as many files as ``n`` of them ask for, and what they add up to."""
    edges = materialize(edges.coalesce(max(1, n // EDGES_A_TASK)), "edges")
    return edges, tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b"))).first())


def components(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(nodes, smallest node of each one's component): roots are hooked to lower ones, then paths are halved."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    root = np.arange(len(nodes))
    while True:
        low = np.minimum(root[x], root[y])
        new = root.copy()
        np.minimum.at(new, root[x], low)
        np.minimum.at(new, root[y], low)
        while (new != new[new]).any():
            new = new[new]
        if (new == root).all():
            return nodes, nodes[root]
        root = new


def _contracted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The task's edges as stars: each node with the smallest of its component there."""
    held = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches]
    if held:
        nodes, roots = components(*(np.concatenate(x) for x in zip(*held, strict=True)))
        yield pa.RecordBatch.from_arrays([pa.array(nodes), pa.array(roots)], names=["a", "b"])


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b: long): root is the smallest node that it is connected with.

    Edges are contracted within each task, then large-star and small-star steps go in turn over all of them: each keeps
    at most one row per edge, so the table never outgrows the input, and the number of rounds grows with the logarithm
    of the longest path. Each step is written, which cuts its lineage, in as many files as its edges ask for.
    """
    edges = edges.where(F.col("a") != F.col("b")).select("a", "b").mapInArrow(_contracted, "a long, b long")
    edges = materialize(edges.where(F.col("a") != F.col("b")), "edges")
    n = edges.count()
    # a contracted edge goes from a node to a smaller one
    edges, state = _written(edges.distinct(), n)
    while state[0]:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        large, _ = _written(large.where(F.col("a") != F.col("b")), state[0])
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(least, "a")
        small = small.where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
        before = state
        edges, state = _written(small.distinct(), state[0])
        if state == before:
            break
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root")).union(edges.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
