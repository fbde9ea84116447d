"""Language identification by error-correcting output codes over hashed n-grams.

Every language has a codeword of bits, far from the others'. For each bit a binary classifier (naive Bayes over hashed
grams of 1 to 4 bytes) weighs whether a text's language has that bit. A text gets the language whose codeword has the
least loss: the logistic loss of each bit, so that a bit that the classifier is sure of weighs more, and less and less is
gained by being surer still. A text whose two best codewords are close is ambiguous.

Learning is from a bounded sample: at most ``sample_per_language`` distinct rows of each language, the ones whose id and
text hash lowest; a row found several times counts so often, but is read once. The counts are summed on the executors,
and the driver takes them one language at a time into sums whose size ``log2_features`` and the length of codewords set.
Scoring is a narrow pass over whole texts; the language, source and id of a row are never looked at there.

Defined results: a null text, one without a letter, or any text when nothing was learned is ``und`` with score 0;
rows with a null language teach nothing; rows with a null id do, as any other; repeated rows count each; an empty table
gives no rows; other columns are not looked at. Ties between codewords go to the first language in order of name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholake.llm._store import small_batches
from ortholake.llm._text import as_bytes, slices, text_column, tidied

SLICE_BYTES = 1 << 20
BLOCK = 1 << 17
GRAMS = (1, 2, 3, 4)
UNKNOWN = "und"
SHARPNESS = 4.0


def codewords(n: int, most_bits: int = 63, seed: int = 7) -> np.ndarray:
    """A codeword of -1 and 1 for each of ``n`` classes: every split of the classes where these are few enough, else
    the splits of the random table, out of 200, whose nearest pair of codewords is furthest apart."""
    if n <= 2:
        return np.array([[1], [-1]], np.int8)[:n]
    if (1 << (n - 1)) - 1 <= most_bits:
        splits = np.arange(1, 1 << (n - 1))
        return np.where((splits[None] >> np.arange(n)[:, None]) & 1, 1, -1).astype(np.int8)
    rng, best, far = np.random.default_rng(seed), None, -1
    for _ in range(200):
        table = rng.choice(np.array([-1, 1], np.int8), (n, most_bits))
        apart = ((table[:, None] != table[None]).sum(2) + most_bits * np.eye(n, dtype=int)).min()
        if apart > far and (np.abs(table.sum(0)) < n).all():
            best, far = table, apart
    return best


def features(data: np.ndarray, offsets: np.ndarray, log2_features: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each gram length: hashed grams that lie in one text, and where each text begins among them."""
    code = np.zeros(len(data), np.uint32)
    for n in range(1, max(GRAMS) + 1):
        # the grams of n bytes that end at each byte
        code = (np.concatenate([np.zeros(1, np.uint32), code[:-1]]) << np.uint32(8) if n > 1 else code) | data
        if n not in GRAMS:
            continue
        within = np.ones(len(data), bool)
        for start, end in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
            within[start : min(end, start + n - 1)] = False
        hashed = ((code ^ np.uint32(n * 0x3C6EF372)) * np.uint32(0x9E3779B1)) >> np.uint32(32 - log2_features)
        yield hashed[within], np.concatenate([[0], np.cumsum(within)])[offsets]


def _slices(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    texts = pc.utf8_lower(text_column(batch))
    for i, j in slices(texts, SLICE_BYTES):
        yield i, j, *as_bytes(texts.slice(i, j - i))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray
    log2_features: int

    def margins(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """For each text and bit: the mean over its grams of what they say for the bit."""
        total, n = np.zeros((len(offsets) - 1, self.codes.shape[1])), np.zeros(len(offsets) - 1)
        for hashed, at in features(data, offsets, self.log2_features):
            for s in range(0, len(hashed), BLOCK):
                sums = np.cumsum(self.weights[hashed[s : s + BLOCK]], axis=0, dtype=np.float64)
                inside = np.clip(at - s, 0, len(sums))
                sums = np.concatenate([np.zeros((1, total.shape[1])), sums])[inside]
                total += sums[1:] - sums[:-1]
            n += np.diff(at)
        return total / np.maximum(n, 1)[:, None]

    def decode(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(best language, confidence from 0 to 1, lead over the second best) by loss-weighted distance to codewords."""
        loss = np.logaddexp(0, -SHARPNESS * margins[:, None, :] * self.codes[None]).mean(2)
        best = loss.argmin(1)
        share = np.exp(4 * (loss.min(1, keepdims=True) - loss))
        share /= share.sum(1, keepdims=True)
        ordered = np.sort(share, axis=1)
        lead = ordered[:, -1] - (ordered[:, -2] if share.shape[1] > 1 else 0)
        return best, ordered[:, -1], lead


def _sample(known: DataFrame, sizes: dict[str, int], most: int) -> DataFrame:
    """(lang, text, n): of each language the ``most`` distinct rows (lang, text, h) of least hash, and how often each is found.

    A share of the rows that holds some more than ``most`` is looked through for the hash to cut at, so that no task gets
    more than that of a language.
    """
    spark = known.sparkSession

    def below(limits: dict[str, int]) -> DataFrame:
        table = spark.createDataFrame(list(limits.items()), "lang string, most_h long")
        return known.join(F.broadcast(table), "lang").where("h <= most_h")

    least, all_hashes = -(1 << 63), 1 << 64
    limits = {x: least + min(all_hashes - 1, int(all_hashes * min(1.0, (1.25 * most + 100) / n))) for x, n in sizes.items()}
    # equal rows are one hash, so a language with many of them has fewer in its sample, never more
    ordered = below(limits).groupBy("lang").agg(F.array_sort(F.collect_set("h")).alias("h"))
    cuts = ordered.where(F.size("h") > most).select("lang", F.element_at("h", most).alias("h")).collect()
    return below(limits | {r["lang"]: r["h"] for r in cuts}).groupBy("lang", "h").agg(F.first("text").alias("text"), F.count(F.lit(1)).alias("n"))


def fit(df: DataFrame, sample_per_language: int = 2000, log2_features: int = 16) -> Model | None:
    """A model of (doc_id, text, lang); null without rows that have a language."""
    known = df.where(F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    languages = sorted(sizes)
    if not languages:
        return None
    number = {x: k for k, x in enumerate(languages)}
    size = 1 << log2_features

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[int, np.ndarray] = {}
        for batch in tidied(batches):
            lang, times = np.array([number[x] for x in batch.column("lang").to_pylist()]), batch.column("n").to_numpy()
            for i, j, data, offsets in _slices(batch):
                for hashed, at in features(data, offsets, log2_features):
                    of, weight = (np.repeat(x[i:j], np.diff(at)) for x in (lang, times))
                    for k in np.unique(of).tolist():
                        own = np.bincount(hashed[of == k], weights=weight[of == k], minlength=size)
                        counts[k] = counts[k] + own if k in counts else own
        for k, own in counts.items():
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([own.astype("<f8").tobytes()], pa.binary())], names=["k", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: np.ndarray | float = 0.0
        for batch in batches:
            for x in batch.column("counts"):
                total = total + np.frombuffer(x.as_buffer(), "<f8")
                k = batch.column("k")[0].as_py()
        yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["k", "counts"])

    sample = _sample(known, sizes, sample_per_language)
    codes = codewords(len(languages))
    # languages weigh alike, however many rows each has
    sums = {1: np.zeros((codes.shape[1], size)), -1: np.zeros((codes.shape[1], size))}

    def learn(k: int, counts: np.ndarray) -> None:
        share = (counts + 0.5) / (counts.sum() + 0.5 * size)
        for bit, own in sums.items():
            own[codes[k] == bit] += share

    counted = sample.select("lang", "text", "n").mapInArrow(count, "k int, counts binary").groupBy("k").applyInArrow(add, "k int, counts binary")
    seen = set()
    for r in counted.toLocalIterator():
        learn(r["k"], np.frombuffer(r["counts"], "<f8"))
        seen.add(r["k"])
    for k in set(range(len(languages))) - seen:  # nothing but empty texts
        learn(k, np.zeros(size))
    weights = np.empty((size, codes.shape[1]), np.float32)
    for b in range(codes.shape[1]):
        n_yes, n_no = int((codes[:, b] == 1).sum()), int((codes[:, b] == -1).sum())
        weights[:, b] = np.log(sums[1][b] / n_yes) - np.log(sums[-1][b] / n_no) if n_yes and n_no else (1.0 if n_yes else -1.0)
    return Model(languages, codes, weights, log2_features)


def predict(df: DataFrame, model: Model | None, ambiguous_below: float = 0.1) -> DataFrame:
    """``df`` (doc_id, held_out, text) without its text, with lang_pred, score and ambiguous."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in tidied(batches):
            n = batch.num_rows
            lettered = pc.match_substring_regex(text_column(batch), r"\p{L}").to_numpy(zero_copy_only=False)
            best, score, lead = np.zeros(n, np.int64), np.zeros(n), np.zeros(n)
            if model:
                for i, j, data, offsets in _slices(batch):
                    best[i:j], score[i:j], lead[i:j] = model.decode(model.margins(data, offsets))
            known = lettered & (model is not None)
            names = np.array([*(model.languages if model else []), UNKNOWN], object)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("held_out"), pa.array(np.where(known, names[best], UNKNOWN), pa.string()), pa.array(np.where(known, np.clip(score, 0, 1), 0.0)), pa.array(known & (lead < ambiguous_below))],
                names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"],
            )

    return df.select("doc_id", "held_out", "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, ambiguous boolean")


def language_ids(df: DataFrame, folds: int = 4, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_per_language: int = 2000) -> DataFrame:
    """One row per document; learns from those whose crc32 of the id, as text, isn't ``held_fold`` modulo ``folds``."""
    small_batches(df.sparkSession)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out.alias("held_out"))
    return predict(docs, fit(docs.where(~F.col("held_out")), sample_per_language))
