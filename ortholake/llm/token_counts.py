"""Exact token-length histogram with suffix sums.

Texts are encoded where they lie; only the histogram of encoded lengths is shuffled, summed first within each task.
Sums over all lengths beyond a limit then answer totals, quantiles and truncated totals for every context limit from a
table that has a row for each length that occurs, at most as many as the longest text has tokens.

Defined results: a null or empty text has length 0; repeated rows count each; an empty table gives an empty histogram;
ids and other columns are not looked at.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ortholake.llm._store import small_batches
from ortholake.llm._text import once, text_column, tidied


def _encoding(path: str, pattern: str):
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def lengths(df: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """(n_tokens, n_docs) summed within each batch. ``ranks``: a file of base64 tokens and ranks; ``pattern``: its split."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once(_encoding, ranks, pattern).encode_ordinary
        for batch in tidied(batches):
            n = np.fromiter((len(encode(x)) for x in (t.as_py() for t in text_column(batch))), np.int64, batch.num_rows)
            length, docs = np.unique(n, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(length), pa.array(docs.astype(np.int64))], names=["n_tokens", "n_docs"])

    small_batches(df.sparkSession)
    return df.select(F.col(text_col).alias("text")).mapInArrow(count, "n_tokens long, n_docs long")


def histogram(df: DataFrame, ranks: str, pattern: str, text_col: str = "text") -> DataFrame:
    """One row for each encoded length: n_tokens, n_docs."""
    return lengths(df, ranks, pattern, text_col).groupBy("n_tokens").agg(F.sum("n_docs").alias("n_docs"))


def suffix_sums(hist: DataFrame) -> DataFrame:
    """For each length L as a context limit: documents and tokens longer than L, tokens kept when texts are cut at L
    and tokens lost by that, the rank of the longest text that fits, and the totals."""
    beyond = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    tokens = F.col("n_tokens") * F.col("n_docs")
    zero = F.lit(0).cast("long")
    return (
        hist.select(
            "n_tokens",
            "n_docs",
            F.coalesce(F.sum("n_docs").over(beyond), zero).alias("docs_longer"),
            F.coalesce(F.sum(tokens).over(beyond), zero).alias("tokens_longer"),
            F.sum("n_docs").over(everything).alias("docs_total"),
            F.sum(tokens).over(everything).alias("tokens_total"),
        )
        .withColumn("tokens_lost", F.col("tokens_longer") - F.col("docs_longer") * F.col("n_tokens"))
        .withColumn("tokens_kept", F.col("tokens_total") - F.col("tokens_lost"))
        .withColumn("docs_fitting", F.col("docs_total") - F.col("docs_longer"))
    )


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """The least length that holds for at least each share of the documents."""
    wanted = F.array(*(F.struct(F.lit(float(q)).alias("share"), F.ceil(F.lit(float(q)) * F.col("docs_total")).alias("need")) for q in shares))
    each = sums.select("n_tokens", "docs_fitting", F.explode(wanted).alias("q")).where(F.col("docs_fitting") >= F.col("q.need"))
    return each.groupBy(F.col("q.share").alias("share")).agg(F.min("n_tokens").alias("n_tokens"))


def truncated_totals(hist: DataFrame, limits: list[int]) -> DataFrame:
    """Tokens kept when every text is cut at each limit; a limit need not be a length that occurs."""
    sums = [
        F.struct(F.lit(int(x)).cast("long").alias("context"), F.coalesce(F.sum(F.least(F.col("n_tokens"), F.lit(int(x)).cast("long")) * F.col("n_docs")), F.lit(0).cast("long")).alias("tokens_kept"))
        for x in limits
    ]
    return hist.agg(F.array(*sums).alias("x")).select(F.inline("x"))
