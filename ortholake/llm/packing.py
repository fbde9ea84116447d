"""Best-fit decreasing packing of token sequences.

Texts are encoded where they lie and cut into pieces of at most ``capacity`` tokens. What best-fit decreasing does
depends on the lengths alone, so the driver packs their histogram (at most ``capacity`` numbers, whatever the size of
the corpus): bins with the same room left are kept as runs, a segment tree over the room left finds the tightest open
bin in logarithmic time, and a whole run of bins takes items in one step, just as it would one by one. The outcome,
runs of ranks within a length, goes back to the pieces by their rank, which is a number counted within each task plus
the sum of the counts of the tasks before it. No piece moves but for a join on (length, task).

Defined results: a null or empty text is one piece that holds the end id only; a null id stays null; repeated rows are
packed each; an empty table gives no rows; other columns of the input are not looked at. Ties between bins with the
same room go to the run opened or changed last.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ortholake.llm._store import materialize, small_batches
from ortholake.llm._text import once, slices, text_column, tidied, WordIds

SLICE_BYTES = 2 << 20

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long, task int, rank long"


class RoomTree:
    """A segment tree over rooms 0 to ``capacity``: the least room of at least so much that some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << (capacity + 1).bit_length()
        self.some = [False] * (2 * self.leaves)

    def set(self, room: int, some: bool) -> None:
        at = room + self.leaves
        self.some[at] = some
        while at > 1:
            at //= 2
            self.some[at] = self.some[2 * at] or self.some[2 * at + 1]

    def tightest(self, least: int) -> int | None:
        at = least + self.leaves
        if self.some[at]:
            return least
        while at > 1:
            if at % 2 == 0 and self.some[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at if self.some[2 * at] else 2 * at + 1
                return at - self.leaves
            at //= 2
        return None


def best_fit_runs(counts: dict[int, int], capacity: int) -> list[tuple[int, int, int, int, int, int]]:
    """Best-fit decreasing over ``counts`` items of each length.

    Runs (length, first rank, number of items, items a bin, first bin, offset): the item of rank r in its length lies
    in bin ``first bin + (r - first rank) // items a bin`` at ``offset + (r - first rank) % items a bin * length``.
    """
    runs: list[tuple[int, int, int, int, int, int]] = []
    open_bins: dict[int, list[tuple[int, int]]] = {}
    tree, n_bins = RoomTree(capacity), 0

    def put(room: int, first: int, bins: int) -> None:
        if bins and room:
            if not open_bins.setdefault(room, []):
                tree.set(room, True)
            open_bins[room].append((first, bins))

    for length in sorted((x for x in counts if counts[x]), reverse=True):
        left, rank = counts[length], 0
        while left:
            room = tree.tightest(length)
            if room is None:
                room, each = capacity, capacity // length
                first, bins = n_bins, -(-left // each)
                n_bins += bins
            else:
                first, bins = open_bins[room].pop()
                if not open_bins[room]:
                    tree.set(room, False)
                each = room // length
            full = min(bins, left // each)
            if full:
                runs.append((length, rank, full * each, each, first, capacity - room))
                put(room - each * length, first, full)
                rank, left = rank + full * each, left - full * each
            if full < bins:
                some = min(left, each - 1) if left < each else 0
                put(room, first + full + bool(some), bins - full - bool(some))
                if some:
                    runs.append((length, rank, some, some, first + full, capacity - room))
                    put(room - some * length, first + full, 1)
                    rank, left = rank + some, left - some
    return runs


def pieces(df: DataFrame, tokenizer: str, capacity: int, end_id: int = 0) -> DataFrame:
    """Pieces of the texts (columns doc_id, text): see PIECES. ``rank`` counts pieces of a length within the task."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = once(WordIds, tokenizer)
        task, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, np.int64)
        for batch in tidied(batches):
            texts, doc_ids = text_column(batch), batch.column("doc_id")
            for a, b in slices(texts, SLICE_BYTES):
                ids, at = words.encode(texts.slice(a, b - a))
                rows = []
                for k in range(b - a):
                    own = np.append(ids[at[k] : at[k + 1]], np.uint32(end_id)).astype("<u4")
                    for n, start in enumerate(range(0, len(own), capacity)):
                        part = own[start : start + capacity]
                        rows.append((a + k, n, start, len(part), zlib.crc32(part.tobytes()), seen[len(part)]))
                        seen[len(part)] += 1
                row, piece, start, length, crc, rank = (np.array(x, np.int64) for x in zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.take(pa.array(row)).cast(pa.int64()), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc), pa.array(np.full(len(row), task, np.int32)), pa.array(rank)],
                    names=["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank"],
                )

    return df.mapInArrow(cut, PIECES)


def pack(df: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = df.sparkSession
    small_batches(spark)
    cut = materialize(pieces(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), tokenizer, capacity, end_id), "pieces")
    counts = cut.groupBy("length", "task").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("length", "task", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    totals = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    runs = spark.createDataFrame(
        best_fit_runs(totals, capacity), "length long, first_rank long, items long, each long, first_bin long, base_offset long"
    )
    ranked = cut.join(bases, ["length", "task"]).withColumn("rank", F.col("rank") + F.col("base"))
    since = F.col("rank") - F.col("first_rank")
    # the runs are at most a few for each pair of a length and a room, so of a size that the capacity bounds
    return ranked.join(F.broadcast(runs), (ranked["length"] == runs["length"]) & since.between(0, F.col("items") - 1)).select(
        "doc_id",
        "piece",
        "start",
        ranked["length"],
        "ids_crc32",
        (F.col("first_bin") + F.expr("(rank - first_rank) div each")).alias("sequence_id"),
        (F.col("base_offset") + F.pmod(since, F.col("each")) * ranked["length"]).alias("offset"),
    )
