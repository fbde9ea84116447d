"""Nearest neighbours by multi-index hashing: learned rotated binary codes, pigeonhole probing, reranking of floats.

Vectors become binary codes: centred, rotated by principal axes and then, for each table of bits, by a rotation that
brings them close to the corners of a cube (iterative quantisation), learned on a bounded sample. A code is split into
``m`` substrings of 16 bits, each with an index of its own: a table from its value to the rows that have it. A query
looks up the values that differ from its own in at most ``reach`` bits. Where two codes differ in fewer than
``m * (reach + 1)`` bits, one substring at least differs in at most ``reach``, so every code within that radius is found,
and further ones where their bits happen to lie together. All that is found is reranked by distance on the original
vectors. ``m`` and ``reach`` are learned on the sample too: of the pairs that find the share ``recall`` of the sample's
near neighbours, the one that looks at the fewest others. In a sample neighbours lie further away than in all data, so
the neighbours that count there are those of a rank that the share of the sample makes alike.

Equal vectors are one: a class keeps its ``k + 1`` first rows, so a vector with very many copies costs what one does.
Queries and classes are dealt out in blocks, and every block of queries meets every block of classes once; a task holds
one of each, and only the best ``k + 1`` classes of a query leave it. Queries that have found fewer than ``k`` rows in
all blocks together go through all blocks again, with every code looked at.

Defined results: vectors null, empty, of another length than the most frequent one, zero, or with null or non-finite
components take no part; a null id neither; each row is a query or a candidate of its own, so rows with the same id and
vector find one another, and each such query has its own result; with fewer than ``k`` candidates all are returned; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ortholake.llm._store import materialize
from ortholake.llm._text import ragged

RESULT = "q1 long, q2 long, c1 long, c2 long, low long, size long, distance double"
_RESULT = pa.schema([(x, pa.int64()) for x in ("q1", "q2", "c1", "c2", "low", "size")] + [("distance", pa.float64())])
BITS = np.bitwise_count(np.arange(1 << 16, dtype=np.uint16))


@dataclass
class Coder:
    """Codes of ``m`` 16-bit substrings, and how far to probe each."""

    mean: np.ndarray
    axes: np.ndarray
    rotations: list[np.ndarray]
    m: int = 0
    reach: int = 0

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        turned = (vectors - self.mean) @ self.axes
        out = []
        for r in self.rotations:
            bits = turned @ r > 0
            bits = np.pad(bits, ((0, 0), (0, -bits.shape[1] % 16)))
            out.append(np.packbits(bits, axis=1).view(">u2").astype(np.uint16))
        codes = np.concatenate(out, axis=1)
        return codes[:, : self.m] if self.m else codes


def learn(sample: np.ndarray, n: int, tables: int = 20, k: int = 10, recall: float = 0.97, seed: int = 11, rounds: int = 20) -> Coder:
    """A coder from a bounded sample of ``n`` vectors."""
    rng = np.random.default_rng(seed)
    mean = sample.mean(0)
    _, axes = np.linalg.eigh((sample - mean).T @ (sample - mean))
    axes = axes[:, ::-1]
    turned = (sample - mean) @ axes
    rotations = []
    for _ in range(tables):
        r, _ = np.linalg.qr(rng.normal(size=axes.shape))
        for _ in range(rounds):
            u, _, w = np.linalg.svd(np.where(turned @ r > 0, 1.0, -1.0).T @ turned)
            r = (u @ w).T
        rotations.append(r)
    coder = Coder(mean, axes, rotations)
    codes = coder.codes(sample)
    rank = max(1, -(-k * len(sample) // n))
    asked = np.arange(0, len(sample), max(1, len(sample) // 256))
    near, far = [np.zeros((1, codes.shape[1]), np.uint8)], [np.zeros((1, codes.shape[1]), np.uint8)]
    for q in asked:
        order = np.argsort(((sample - sample[q]) ** 2).sum(1), kind="stable")
        near.append(BITS[codes[order[1 : rank + 1]] ^ codes[q]])
        far.append(BITS[codes[rng.integers(len(sample), size=64)] ^ codes[q]])
    near, far = np.concatenate(near), np.concatenate(far)
    best = (np.inf, codes.shape[1], 16)
    for reach in range(17):
        share = np.logical_or.accumulate(near <= reach, axis=1).mean(0)
        if (enough := np.flatnonzero(share >= recall)).size:
            m = int(enough[0]) + 1
            # what is looked at, and a little for each substring and value
            best = min(best, ((far[:, :m] <= reach).any(1).mean() + 1e-6 * m * int((BITS <= reach).sum()), m, reach))
    _, coder.m, coder.reach = best
    return coder


def probe(queries: np.ndarray, codes: np.ndarray, reach: int) -> Iterator[np.ndarray]:
    """For each query code the rows of ``codes`` that differ from it in at most ``reach`` bits of some substring."""
    m = codes.shape[1]
    rows = np.concatenate([np.argsort(codes[:, s], kind="stable") for s in range(m)])
    held = np.concatenate([np.bincount(codes[:, s], minlength=1 << 16) for s in range(m)])
    first = np.cumsum(held) - held
    masks = np.flatnonzero(BITS <= reach).astype(np.uint16)
    tables = (np.arange(m) << 16)[:, None]
    found = np.zeros(len(codes), bool)
    for q in queries:
        at = ((q[:, None] ^ masks).astype(np.int64) + tables).ravel()
        at = at[held[at] > 0]
        found[rows[ragged(first[at], held[at])]] = True
        hit = np.flatnonzero(found)
        found[hit] = False
        yield hit


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), "<f8").reshape(len(column), -1)


def _search(coder: Coder, k: int, every_code: bool):
    def search(queries: pa.Table, base: pa.Table) -> pa.Table:
        if not queries.num_rows or not base.num_rows:
            return _RESULT.empty_table()
        q, b = _matrix(queries["vector"]), _matrix(base["vector"])
        low = base["low"].to_numpy()
        asked, answers, distances = [], [], []
        found = (np.arange(len(b)) for _ in q) if every_code else probe(coder.codes(q), coder.codes(b), coder.reach)
        for i, rows in enumerate(found):
            d = np.sqrt(((b[rows] - q[i]) ** 2).sum(1))
            best = np.lexsort((low[rows], d))[: k + 1]
            asked.append(np.full(len(best), i))
            answers.append(rows[best])
            distances.append(d[best])
        asked, answers = pa.array(np.concatenate(asked)), pa.array(np.concatenate(answers))
        one = queries.select(["h", "h2"]).take(asked)
        other = base.select(["h", "h2", "low", "size"]).take(answers)
        return pa.Table.from_arrays([*one.columns, *other.columns, pa.chunked_array([pa.array(np.concatenate(distances))])], schema=_RESULT)

    return search


def usable(df: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, vector): the rows that take part, as doubles."""
    vector = F.transform(vector_col, lambda x: x.cast("double"))
    rows = df.select(F.col(id_col).cast("long").alias("vec_id"), vector.alias("vector")).where("vec_id is not null and size(vector) > 0")
    finite = F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(finite & F.exists("vector", lambda x: x != 0))
    sizes = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).collect()
    return rows.where(F.size("vector") == (sizes[0]["n"] if sizes else 0))


def nearest(df: DataFrame, k: int = 10, every: int = 100, tables: int = 20, sample_rows: int = 4096, recall: float = 0.97, query_block: int = 4096, base_block: int = 16384, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest of each row whose id is divisible by ``every``.

    The coder is fitted on at most ``sample_rows`` vectors, the distinct ones whose hash is least. Every vector is moved
    once for each ``query_block`` queries.
    """
    spark = df.sparkSession
    rows = usable(df, id_col, vector_col)
    # -0.0 equals 0.0
    rows = rows.withColumn("vector", F.transform("vector", lambda x: x + F.lit(0.0)))
    rows = rows.withColumn("h", F.xxhash64("vector")).withColumn("h2", F.xxhash64(F.lit(1), "vector"))
    classes = rows.groupBy("h", "h2").agg(F.first("vector").alias("vector"), F.min("vec_id").alias("low"), F.max(F.col("vec_id") % every == 0).alias("asks"), F.least(F.count(F.lit(1)), F.lit(k + 1)).alias("size"))
    # the first k + 1 rows of each class
    members = rows.groupBy("h", "h2", "vec_id").agg(F.count(F.lit(1)).alias("copies"))
    of_class = Window.partitionBy("h", "h2").orderBy("vec_id")

    def first_rows(df: DataFrame) -> DataFrame:
        return df.withColumn("n", F.row_number().over(of_class)).where(F.col("n") <= k + 1).drop("n")

    copies = F.explode(F.sequence(F.lit(1).cast("long"), F.least("copies", F.lit(k + 1).cast("long"))))
    firsts = first_rows(first_rows(members).select("h", "h2", "vec_id", copies.alias("copy"))).select(F.col("h").alias("c1"), F.col("h2").alias("c2"), "vec_id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = np.asarray(batch.column("vector").flatten(), "<f8").reshape(batch.num_rows, -1) if batch.num_rows else ()
            vectors = pa.array([x.tobytes() for x in data], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("h", "h2", "low", "asks", "size")), vectors], names=["h", "h2", "low", "asks", "size", "vector"])

    packed = classes.select("h", "h2", "low", "asks", "size", "vector").mapInArrow(pack, "h long, h2 long, low long, asks boolean, size long, vector binary")
    table = materialize(packed, "vectors")
    n = table.agg(F.count(F.lit(1)).alias("all"), F.count_if("asks").alias("asking")).first()
    sample = [np.frombuffer(r["vector"], "<f8") for r in table.orderBy("h2", "h").limit(sample_rows).select("vector").collect()]
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    coder = learn(np.stack(sample), n["all"], tables, k, recall)
    b_blocks = -(-n["all"] // base_block)

    def own(count: int, salt: int):
        return F.pmod(F.xxhash64("h", F.lit(salt)), F.lit(count))

    def every_block(count: int):
        return F.explode(F.sequence(F.lit(0).cast("long"), F.lit(count - 1).cast("long")))

    def through_all_blocks(asking: DataFrame, count: int, every_code: bool) -> DataFrame:
        q_blocks = -(-count // query_block)
        queries = asking.select("h", "h2", "vector", own(q_blocks, 1).alias("q"), every_block(b_blocks).alias("b"))
        base = table.select("h", "h2", "low", "size", "vector", own(b_blocks, 2).alias("b"), every_block(q_blocks).alias("q"))
        found = queries.groupBy("q", "b").cogroup(base.groupBy("q", "b")).applyInArrow(_search(coder, k, every_code), RESULT)
        # of the classes in order of distance and smallest id, any after k + 1 has no member among the first k + 1 rows
        of_query = Window.partitionBy("q1", "q2").orderBy("distance", "low")
        return found.withColumn("n", F.row_number().over(of_query)).where(F.col("n") <= k + 1).drop("n", "low")

    asking = table.where("asks")
    found = materialize(through_all_blocks(asking, max(1, n["asking"]), False), "found")
    enough = found.groupBy("q1", "q2").agg(F.sum("size").alias("rows")).where(F.col("rows") > k).select(F.col("q1").alias("h"), F.col("q2").alias("h2"))
    short = materialize(asking.join(enough, ["h", "h2"], "left_anti"), "short")
    if n_short := short.count():
        found = found.join(enough.toDF("q1", "q2"), ["q1", "q2"], "left_semi").unionByName(through_all_blocks(short, n_short, True))

    is_own = ((F.col("q1") == F.col("c1")) & (F.col("q2") == F.col("c2"))).alias("own")
    of_query = Window.partitionBy("q1", "q2").orderBy("distance", "vec_id")
    candidates = found.join(firsts, ["c1", "c2"]).withColumn("n", F.row_number().over(of_query)).where(F.col("n") <= k + 1)
    lists = candidates.groupBy("q1", "q2").agg(F.sort_array(F.collect_list(F.struct("distance", "vec_id", is_own))).alias("list"))
    queries = members.where(F.col("vec_id") % every == 0).select(F.col("vec_id").alias("query_id"), F.col("h").alias("q1"), F.col("h2").alias("q2"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    itself = F.array_position(F.transform("list", lambda x: x["own"] & (x["vec_id"] == F.col("query_id"))), True)
    others = F.slice(F.filter("list", lambda x, i: i + 1 != F.col("itself")), 1, k)
    return queries.join(lists, ["q1", "q2"]).withColumn("itself", itself).select("query_id", F.posexplode(others).alias("rank", "x")).select(
        "query_id", (F.col("rank") + 1).alias("rank"), "x.vec_id", F.col("x.distance").alias("score")
    )
