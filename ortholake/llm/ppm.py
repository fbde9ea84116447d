"""Language-model scores by prediction by partial matching over bytes, pretrained on the corpus.

The model is a trie of byte contexts up to ``order`` long. A byte is predicted in the longest context known; where that
context has not been followed by it, the code escapes to the next shorter one, in which all bytes that the longer one
knew are excluded. A context escapes by the number of distinct bytes that it would newly allow there (at least one
half); below the empty context every byte left is alike. So each text gets a code length that adds up to one over all
texts: ``score`` is its log10 probability, end included.

Every gram of ``order + 1`` bytes of every training text counts, however rare. Grams of up to three bytes, of which there
are at most 256 ** 3 in any corpus, are counted first and broadcast. Longer ones never leave the reducers: each slice of
texts sends its distinct grams, with their counts in its training texts, to the reducers of the hashes of the three bytes
before the last, which so have whole subtries of contexts; these build the trie of their range. A context of three or more
bytes that makes up more than one in ``hot_share`` of a sample would fill one reducer, so its grams are dealt by one more
byte instead, and what follows it (at most 256 bytes for each of at most ``hot_share`` contexts of a length) is counted over
all texts and broadcast too. The sample decides where grams go, never what is counted. What comes back to a slice are
counts of its grams and totals of their contexts, and scores of those grams that training doesn't have. Words go the same
way. The slice's text goes to where these arrive, and is cut into grams and words again there, which takes less room than
to say which gram stands where.

Texts are lower-cased (A-Z). The terminator, which also stands before the start, is byte 255, which UTF-8 doesn't use.

Defined results: a null or empty text has just its end; without training texts all bytes are alike; a null id is scored
as any other and counts as not held out; repeated rows count each; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholake.llm._exchange import PACKED, PACKED_ARROW, by_part, bytes_table, grouped_parts, mix, number_of_parts, part_of, rows_of, squeeze, squeeze_long, table_bytes, unsqueeze, unsqueeze_long
from ortholake.llm._store import materialize, replayable, small_batches
from ortholake.llm._text import as_bytes, folding, slices, split_words, text_column, tidied

SLICE_BYTES = 4 << 20
SENT_BYTES = 8 << 20
SEGMENT = 4 << 20
END = 255
SAMPLE_BYTES = 1 << 20


def _low(k: int) -> np.uint64:
    """A mask of the last ``k`` bytes of a gram."""
    return np.uint64((1 << (8 * k)) - 1)


def framed(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Texts with ``order`` terminators before and one after each: bytes, which of them are coded, where texts begin."""
    before, after, none = (pa.scalar(bytes([END]) * k, pa.large_binary()) for k in (order, 1, 0))
    frame, offsets = as_bytes(pc.binary_join_element_wise(before, texts.cast(pa.large_binary()), after, none))
    coded, starts = np.ones(len(frame), bool), offsets[:-1]
    for k in range(order):
        coded[starts + k] = False
    return frame, coded, starts


def grams(frame: np.ndarray, begin: int, end: int, order: int) -> np.ndarray:
    """For each place from ``begin`` to ``end`` the ``order`` bytes before it and its own, as one number."""
    padded = np.concatenate([np.full(max(0, order - begin), END, np.uint8), frame[max(0, begin - order) : end]])
    code = np.zeros(end - begin, np.uint64)
    for k in range(order + 1):
        code <<= np.uint64(8)
        code |= padded[k : k + end - begin]
    return code


def turned(code: np.ndarray, k: int) -> np.ndarray:
    """Grams with their ``k`` context bytes turned round, the nearest first, so that in order of these the grams of
    every depth are nearly in order too."""
    out = code & np.uint64(255)
    for j in range(1, k + 1):
        out = out | ((code >> np.uint64(8 * j) & np.uint64(255)) << np.uint64(8 * (k + 1 - j)))
    return out


class Trie:
    """Lookups of code lengths: for each depth grams in order with their counts, and contexts with their totals, both
    kept in turned order."""

    def __init__(self, nodes: list[tuple[np.ndarray, np.ndarray]]):
        self.depths = []
        longer = None
        for k in range(len(nodes) - 1, -1, -1):
            gram, n = nodes[k]
            contexts, at = np.unique(gram >> np.uint64(8), return_inverse=True)
            total, kinds = np.bincount(at, weights=n, minlength=len(contexts)), np.bincount(at, minlength=len(contexts))
            if longer is not None and len(longer[0]):  # counts at this depth of the bytes that the longer context knows
                known = n[np.searchsorted(gram, longer[0] & _low(k + 1))]
                self.depths[-1]["shorter"] = np.bincount(longer[1], weights=known, minlength=longer[2])
            self.depths.append({"k": k, "gram": gram, "n": n.astype(float), "context": contexts, "total": total, "kinds": kinds.astype(float)})
            longer = gram, at, len(contexts)
        self.order = len(nodes) - 1
        for t in self.depths:
            grams, contexts = turned(t["gram"], t["k"]), turned(t["context"] << np.uint64(8), t["k"]) >> np.uint64(8)
            by_gram, by_context = np.argsort(grams), np.argsort(contexts)
            t["gram"], t["n"], t["context"] = grams[by_gram], t["n"][by_gram], contexts[by_context]
            t |= {c: t[c][by_context] for c in ("total", "kinds", "shorter") if c in t}

    def score(self, code: np.ndarray) -> np.ndarray:
        """log10 of the probability of each gram's last byte after the others."""
        code = turned(code, self.order)
        back = np.argsort(code)
        code = code[back]
        score = np.zeros(len(code))
        live = np.arange(len(code))
        out_n, out_kinds = np.zeros(len(code)), np.zeros(len(code))  # excluded by the longer context
        for t in self.depths:
            if not len(t["gram"]) or not len(live):
                continue
            context = code[live] >> np.uint64(8 * (1 + self.order - t["k"]))
            own = context << np.uint64(8) | code[live] & np.uint64(255)
            at = np.minimum(np.searchsorted(t["context"], context), len(t["context"]) - 1)
            has = t["context"][at] == context
            place = np.minimum(np.searchsorted(t["gram"], own), len(t["gram"]) - 1)
            hit = has & (t["gram"][place] == own)
            new = np.maximum(t["kinds"][at] - out_kinds[live], 0.5)
            whole = t["total"][at] - out_n[live] + new
            gain = np.where(hit, t["n"][place], new)
            score[live] += np.where(has, np.log10(gain / np.where(has, whole, 1)), 0)
            if "shorter" in t:
                out_n[live], out_kinds[live] = np.where(has, t["shorter"][at], 0), np.where(has, t["kinds"][at], 0)
            elif t["k"] == 0:
                out_kinds[live] = t["kinds"][at]
            else:
                out_n[live], out_kinds[live] = 0, 0
            live = live[~hit]
        score[live] -= np.log10(256 - out_kinds[live])
        found = np.empty(len(code))
        found[back] = score
        return found


#: Bytes of the grams that are broadcast.
SHORT = 3


Contexts = dict[int, np.ndarray]


def _frames(batches: Iterator[pa.RecordBatch], order: int, most: int | None = None) -> Iterator[np.ndarray]:
    """The grams of the texts, segment by segment; with ``most`` until there are so many."""
    seen = 0
    for batch in batches:
        texts = pc.ascii_lower(text_column(batch))
        for i, j in slices(texts, most or SLICE_BYTES):
            frame, coded, _ = framed(texts.slice(i, j - i), order)
            for s in range(0, len(frame), most or SEGMENT):
                e = min(len(frame), s + (most or SEGMENT))
                codes = grams(frame, s, e, order)[coded[s:e]]
                seen += len(codes)
                yield codes
                if most and seen >= most:
                    return


def _grouped(codes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams in order with the sums of their counts."""
    codes, at = np.unique(codes, return_inverse=True)
    return codes, np.bincount(at, weights=n, minlength=len(codes)).astype(np.int64)


def _summed(counts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The same of several that are in order each. Grams are sorted with the number of their source below them."""
    if len(counts) > 256:
        return _summed([_summed(counts[k : k + 256]) for k in range(0, len(counts), 256)])
    keys = np.concatenate([(c << np.uint64(8)) | np.uint64(k) for k, (c, _) in enumerate(counts)])
    keys.sort()
    source, n = keys.astype(np.uint8), np.empty(len(keys), np.int64)
    for k, (_, own) in enumerate(counts):
        n[source == k] = own
    codes = keys >> np.uint64(8)
    first = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)])
    return codes[first], np.add.reduceat(n, first) if len(first) else n


def _distinct(codes: np.ndarray) -> np.ndarray:
    """Grams in order, each once; the given array is sorted in place. Sorting numbers takes a tenth of the time of numpy's table of distinct ones."""
    codes.sort()
    return codes[np.concatenate([[True], codes[1:] != codes[:-1]])[: len(codes)]]


def _tally(codes: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct grams in order; for each pair of one and a number below 256 in ``of``: which gram, the number, how often.

    The given array is overwritten.
    """
    keys = np.left_shift(codes, np.uint64(8), out=codes)
    keys |= of
    keys.sort()
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)])
    times = np.diff(first, append=len(keys)).astype(np.int32)
    keys = keys[first]
    del codes, first
    of = keys.astype(np.uint8)
    keys >>= np.uint64(8)
    new = np.concatenate([[True], keys[1:] != keys[:-1]])[: len(keys)]
    return keys[new], np.cumsum(new, dtype=np.int32) - np.int32(1), of, times


def _among(codes: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which codes are in ``some``, which are few and in order."""
    return some[np.minimum(np.searchsorted(some, codes), len(some) - 1)] == codes if len(some) else np.zeros(len(codes), bool)


def _rows(depth: int, codes: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.full(len(codes), depth, np.int32)), pa.array(codes.view(np.int64)), pa.array(n.astype(np.int64))], names=["depth", "gram", "n"])


COUNTS = "depth int, gram long, n long"


def frequent_contexts(df: DataFrame, order: int, hot_share: int) -> Contexts:
    """By length, from ``SHORT`` on, the contexts that make up more than one in ``hot_share`` of a sample, which is the
    first ``SAMPLE_BYTES`` of each task."""

    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for codes in _frames(batches, order, SAMPLE_BYTES):
            yield _rows(0, np.zeros(1, np.uint64), np.array([len(codes)]))
            for k in range(SHORT, order):
                found, n = np.unique(codes & _low(k), return_counts=True)
                often = n * 2 * hot_share > len(codes)
                yield _rows(k, found[often], n[often])

    if order <= SHORT:
        return {}
    counts = df.select("text").mapInArrow(sample, COUNTS).groupBy("depth", "gram").agg(F.sum("n").alias("n"))
    total = F.sum(F.when(F.col("depth") == 0, F.col("n")))
    all_bytes = counts.agg(total).first()[0] or 0
    found = counts.where((F.col("depth") > 0) & (F.col("n") * hot_share > all_bytes)).toArrow()
    depth, gram = found["depth"].to_numpy(), found["gram"].to_numpy().view(np.uint64)
    hot: Contexts = {}
    for k in range(SHORT, order):
        own = np.sort(gram[depth == k])
        if k > SHORT:  # dealing by another byte goes on from a context that is dealt so itself
            own = own[_among(own & _low(k - 1), hot[k - 1])]
        hot[k] = own
    return hot


def short_grams(df: DataFrame, order: int, hot: Contexts) -> list[tuple[np.ndarray, np.ndarray]]:
    """By depth, grams of the texts of ``df`` with their counts: all of up to ``SHORT`` bytes, and longer ones whose
    context is in ``hot``."""
    width = min(SHORT, order + 1)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for codes in _frames(tidied(batches), order):
            codes, n = np.unique(codes, return_counts=True)
            found = {width - 1: _grouped(codes & _low(width), n)}
            for k, contexts in hot.items():
                often = _among(codes >> np.uint64(8) & _low(k), contexts)
                codes, n = codes[often], n[often]
                found[k] = _grouped(codes & _low(k + 1), n)
            held = {k: _summed([held[k], x] if k in held else [x]) for k, x in found.items()}
        for k, (codes, n) in held.items():
            yield _rows(k, codes, n)

    found = df.select("text").mapInArrow(count, COUNTS).groupBy("depth", "gram").agg(F.sum("n").alias("n")).toArrow()
    depth, gram, n = found["depth"].to_numpy(), found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()

    def of(k: int) -> tuple[np.ndarray, np.ndarray]:
        return _grouped(gram[depth == k], n[depth == k])

    levels = [of(width - 1)]
    for k in range(width - 2, -1, -1):
        codes, counts = levels[0]
        levels.insert(0, _grouped(codes & _low(k + 1), counts))
    return [*levels, *(of(k) for k in range(width, order + 1))]


def context_bytes(codes: np.ndarray, order: int, hot: Contexts) -> np.ndarray:
    """How many bytes before the last say where a gram goes."""
    used = np.full(len(codes), min(SHORT, order), np.uint8)
    at = np.arange(len(codes))
    for k, contexts in hot.items():
        at = at[_among(codes[at] >> np.uint64(8) & _low(k), contexts)]
        used[at] = k + 1
    return used


def _ranges(codes: np.ndarray, order: int, parts: int, hot: Contexts) -> Iterator[tuple[int, np.ndarray]]:
    """Grams by the hash range of the bytes before the last."""
    low = np.array([_low(k) for k in range(order + 1)], np.uint64)
    found = [part_of(np.zeros(0, np.uint64), parts)]
    for s in range(0, len(codes), 1 << 18):
        some = codes[s : s + (1 << 18)]
        used = context_bytes(some, order, hot).astype(np.uint64)
        found.append(part_of(mix((some >> np.uint64(8) & low[used]) | used << np.uint64(56)), parts))
    return grouped_parts(np.concatenate(found))


def pack_counts(x: np.ndarray) -> bytes:
    """Numbers from 0, mostly small."""
    many = x > 254
    return zstandard.ZstdCompressor(level=1).compress(np.where(many, 255, x).astype(np.uint8).tobytes() + x[many].astype("<i8").tobytes() + len(x).to_bytes(8, "little"))


def unpack_counts(data: bytes) -> np.ndarray:
    data = zstandard.ZstdDecompressor().decompress(data)
    n = int.from_bytes(data[-8:], "little")
    x = np.frombuffer(data, np.uint8, n).astype(np.int64)
    x[x == 255] = np.frombuffer(data[n:-8], "<i8")
    return x


def _send(order: int, parts: int, hot):
    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """A slice's distinct words (kind 0) and grams (kind 3), packed by hash range, with how often its training texts
        have them."""
        g = TaskContext.get().partitionId() << 32
        for batch in tidied(batches):
            texts = pc.ascii_lower(text_column(batch))
            held_out = batch.column("held_out")
            for i, j in slices(texts, SENT_BYTES):
                some = texts.slice(i, j - i)
                learns = ~held_out.slice(i, j - i).to_numpy(zero_copy_only=False)
                frame, coded, starts = framed(some, order)
                learnt = np.repeat(learns, np.diff(np.append(starts, len(frame))))
                found = []
                for s in range(0, len(frame), SEGMENT):
                    e = min(len(frame), s + SEGMENT)
                    codes, gram, learns_it, times = _tally(grams(frame, s, e, order)[coded[s:e]], learnt[s:e][coded[s:e]])
                    found.append((codes, np.bincount(gram, weights=times * learns_it, minlength=len(codes)).astype(np.int64)))
                codes, n = found[0] if len(found) == 1 else _summed(found)
                rows = [(p, g, 3, squeeze_long(codes[own].view(np.int64)), pack_counts(n[own]), None) for p, own in _ranges(codes, order, parts, hot.value)]
                words, at, dictionary = split_words(some)
                keys = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in dictionary), np.uint64, len(dictionary))
                n = np.bincount(words[np.repeat(learns, np.diff(at))], minlength=len(keys)).astype(np.int64)
                rows += [(p, g, 0, keys[own].tobytes(), pack_counts(n[own]), squeeze(own)) for p, own in by_part(mix(keys), parts)]
                yield rows_of(PACKED_ARROW, rows)
                g += 1

    return send


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The slices of ``_send`` as texts (kind 1). They need not pass the hash ranges."""
    g = TaskContext.get().partitionId() << 32
    small = zstandard.ZstdCompressor(level=1)
    for batch in tidied(batches):
        texts = pc.ascii_lower(text_column(batch))
        for i, j in slices(texts, SENT_BYTES):
            meta = pa.table({"doc_id": batch.column("doc_id").slice(i, j - i), "held_out": batch.column("held_out").slice(i, j - i), "text": texts.slice(i, j - i)})
            yield rows_of(PACKED_ARROW, [(0, g, 1, small.compress(table_bytes(meta)), None, None)])
            g += 1


def _known(short, hot, order: int):
    def trie(codes: np.ndarray, n: np.ndarray) -> Trie:
        """Of the grams of one hash range; nodes that several ranges have a part in are broadcast."""
        used = context_bytes(codes, order, hot.value)
        levels = [(codes, n)]
        for k in range(order - 1, SHORT - 1, -1):
            whole = used <= k  # all grams after such a context are here
            codes, first, at = np.unique(codes[whole] & _low(k + 1), return_index=True, return_inverse=True)
            n, used = np.bincount(at, weights=n[whole], minlength=len(codes)).astype(np.int64), used[whole][first]
            levels.insert(0, _summed([(codes, n), short.value[k]]))
        return Trie([*short.value[:SHORT], *levels] if order >= SHORT else short.value)

    def known(table: pa.Table) -> pa.Table:
        """Of one hash range: for each slice the counts of its words in all training texts (kind 0); of its grams (kind 3)
        the counts, the sums of counts and of kinds of the contexts, and the scores of grams that no training text has;
        kind 2: distinct words seen."""
        small = zstandard.ZstdCompressor(level=1)
        rows = table.to_pylist()
        out = []
        if came := [r for r in rows if r["kind"] == 0]:
            n = [unpack_counts(r["b"]) for r in came]
            _, at = np.unique(np.concatenate([np.frombuffer(r["a"], np.uint64) for r in came]), return_inverse=True)
            total = np.bincount(at, weights=np.concatenate(n)).astype(np.int64)
            out.append((0, -1 - came[0]["part"], 2, int((total > 0).sum()).to_bytes(8, "little"), None, None))
            for r, own in zip(came, np.split(total[at], np.cumsum([len(x) for x in n])[:-1]), strict=True):
                out.append((0, r["g"], 0, pack_counts(own), None, r["c"]))
        if came := [r for r in rows if r["kind"] == 3]:
            codes = np.zeros(0, np.uint64)
            n = np.zeros(0, np.int64)
            held: list[tuple[np.ndarray, np.ndarray]] = []
            for r in came:  # summed now and then, so that what is held are distinct grams
                held.append((unsqueeze_long(r["a"]).view(np.uint64), unpack_counts(r["b"])))
                if sum(len(c) for c, _ in held) > 1_000_000 + len(codes):
                    codes, n = _summed([(codes, n), *held])
                    held = []
            codes, n = _summed([(codes, n), *held])
            hit, miss = n > 0, np.flatnonzero(n == 0)
            of = np.unique(codes[hit] >> np.uint64(8), return_inverse=True)[1]
            whole, score = np.zeros(len(codes), np.int64), np.zeros(len(codes))
            whole[hit] = (np.bincount(of, weights=n[hit]).astype(np.int64) + np.bincount(of))[of]
            if len(miss):
                model = trie(codes[hit], n[hit])
                for s in range(0, len(miss), 1_000_000):
                    score[miss[s : s + 1_000_000]] = model.score(codes[miss[s : s + 1_000_000]])
            for r in came:
                own = unsqueeze_long(r["a"]).view(np.uint64)
                at = np.searchsorted(codes, own)
                first, _ = _contexts(own[n[at] > 0])
                wholes = whole[at][n[at] > 0][first]
                out.append((0, r["g"], 3, pack_counts(n[at]), pack_counts(wholes), r["part"].to_bytes(8, "little") + small.compress(score[at][n[at] == 0].tobytes())))
        return pa.Table.from_batches([rows_of(PACKED_ARROW, out)] if out else [], schema=PACKED_ARROW)

    return known


def _contexts(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of grams in order: where each context is found first, and which context each has."""
    new = np.concatenate([[True], np.diff(codes >> np.uint64(8)) != 0])[: len(codes)]
    return np.flatnonzero(new), np.cumsum(new) - 1


def _scores(row: dict, codes: np.ndarray) -> np.ndarray:
    """The scores of a slice's grams of one hash range from what came back."""
    n = unpack_counts(row["a"])
    score, hit = np.empty(len(n)), n > 0
    _, of = _contexts(codes[hit])
    score[hit] = np.log10(n[hit] / unpack_counts(row["b"])[of])
    score[~hit] = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["c"][8:]))
    return score


SCORED = "doc_id long, held_out boolean, n_words long, n_known long, sum_log double, score double, distinct_words long"
_SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_words", pa.int64()), ("n_known", pa.int64()), ("sum_log", pa.float64()), ("score", pa.float64()), ("distinct_words", pa.int64())])


def _gather(order: int, parts: int, hot):
    def gather(table: pa.Table) -> pa.Table:
        """Of one slice: a row for each text with the sum of log10(count + 1) of its words and of its grams' scores."""
        expand = zstandard.ZstdDecompressor()
        rows = table.to_pylist()
        if seen := [r for r in rows if r["kind"] == 2]:
            return pa.Table.from_pylist([{"distinct_words": sum(int.from_bytes(r["a"], "little") for r in seen)}], schema=_SCORED)
        meta = bytes_table(expand.decompress(next(r["a"] for r in rows if r["kind"] == 1))).combine_chunks()
        some = pa.concat_arrays(meta["text"].chunks)
        words, at, dictionary = split_words(some)
        counts = np.zeros(len(dictionary), np.int64)
        for r in rows:
            if r["kind"] == 0:
                counts[unsqueeze(r["c"])] = unpack_counts(r["a"])
        n = counts[words]
        sums, known = (np.diff(np.concatenate([np.zeros(1, x.dtype), np.cumsum(x)])[at]) for x in (np.log10(n + 1.0), (n > 0).astype(np.int64)))

        frame, coded, starts = framed(some, order)
        edges = np.append(starts, len(frame))
        segments, s = [], 0
        while s < len(frame):  # of less than 256 texts, and some bytes
            first = int(np.searchsorted(starts, s, side="right")) - 1
            e = min(s + SEGMENT // 2, int(edges[min(len(starts), first + 255)]))
            sizes = np.diff(np.clip(edges[first : first + 256], s, e))
            of = np.repeat(np.arange(len(sizes), dtype=np.uint64), sizes)
            segments.append((first, *_tally(grams(frame, s, e, order)[coded[s:e]], of[coded[s:e]])))
            s = e
        codes = _distinct(np.concatenate([x[1] for x in segments]))
        score = np.empty(len(codes))
        came = {int.from_bytes(r["c"][:8], "little"): r for r in rows if r["kind"] == 3}
        for p, own in _ranges(codes, order, parts, hot.value):
            score[own] = _scores(came[p], codes[own])
        total = np.zeros(len(some))
        for first, distinct, gram, of, times in segments:
            own = np.bincount(of, weights=score[np.searchsorted(codes, distinct)][gram] * times)
            total[first : first + len(own)] += own
        return pa.Table.from_arrays([meta["doc_id"], meta["held_out"], pa.array(np.diff(at)), pa.array(known), pa.array(sums), pa.array(total), pa.nulls(len(some), pa.int64())], schema=_SCORED)

    return gather


def lm_scores(df: DataFrame, order: int = 6, folds: int = 7, held_fold: int = 2, id_col: str = "doc_id", text_col: str = "text", hot_share: int = 2000) -> DataFrame:
    """One row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    The model learns from the documents whose crc32 of the id, as text, isn't ``held_fold`` modulo ``folds``.
    """
    if not 1 <= order <= 6:
        raise ValueError("order must be from 1 to 6")
    spark = df.sparkSession
    small_batches(spark)
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held_fold, F.lit(False))
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), held_out.alias("held_out"))
    docs = replayable(docs)
    learnt = docs.where(~F.col("held_out"))
    hot = spark.sparkContext.broadcast(frequent_contexts(learnt, order, hot_share))
    short = spark.sparkContext.broadcast(short_grams(learnt, order, hot.value))
    parts = number_of_parts(docs)
    sent = docs.select("doc_id", "text", "held_out").mapInArrow(_send(order, parts, hot), PACKED)
    known = sent.groupBy("part").applyInArrow(folding(_known(short, hot, order)), PACKED)
    texts = docs.select("doc_id", "text", "held_out").mapInArrow(_texts, PACKED)
    # texts come first: a task's number there is that of its partition, as in ``sent``
    scored = materialize(texts.union(known).groupBy("g").applyInArrow(folding(_gather(order, parts, hot)), SCORED), "scored")
    learned = scored.agg(F.sum(F.when(~F.col("held_out"), F.col("n_words") + 1)).alias("tokens"), F.count_if(~F.col("held_out")).alias("docs"), F.sum("distinct_words").alias("words")).first()
    tokens, ends, distinct = learned["tokens"] or 0, learned["docs"], (learned["words"] or 0) + (learned["docs"] > 0)
    return scored.where("distinct_words is null").select(
        "doc_id",
        "held_out",
        (F.col("n_words") + 1).alias("n_tokens"),
        (F.col("n_known") + int(ends > 0)).alias("n_known"),
        F.lit(tokens).cast("long").alias("train_tokens"),
        (F.col("sum_log") + F.log10(F.lit(ends + 1.0)) - (F.col("n_words") + 1) * F.log10(F.lit(float(tokens + distinct + 1)))).alias("base_score"),
        "score",
    )
