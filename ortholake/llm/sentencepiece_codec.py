"""SentencePiece encoding and decoding, driven by an Aho-Corasick automaton over the pieces.

One pass over a text feeds the automaton; at each place, following its output links gives every piece that ends there,
and each relaxes the best segmentation that ends there:

* In a unigram model the candidate with the greatest sum of scores stays.
* In a BPE model (by merges) a candidate is admissible if merging it and the best piece before it would leave the two
  as they are; a segmentation is the one that merges give exactly if each of its neighbouring pairs is, so that one
  candidate is admissible at each place, and the ids are those of merging without a merge being done over the text.
  What a pair gives is found once and kept.

``encode(best=True)`` relaxes scores for BPE models as well and adds that segmentation beside the ids of merging.

No piece holds a space mark after another character, so a text falls into words that are encoded apart, each distinct
one once. Characters without a piece become bytes where the model has these, else the unknown id.

Defined results: a null or empty text has no ids, and no ids decode to an empty text; a null list of ids counts as an
empty one, ids that are null or that the model doesn't have are left out; null ids of documents stay; repeated rows are
encoded each; an empty table gives no rows; other columns are not looked at. Of segmentations with the same score the
one stays whose last piece comes first through the output links, the longest; a text without ids has score 0.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Iterator
from itertools import pairwise

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ortholake.llm._store import small_batches
from ortholake.llm._text import WordCache, once, ragged, slices, text_column, tidied

SLICE_BYTES = 4 << 20
IDS = 1 << 19
SPACE = "▁"
#: Fixed values of the model format: kinds of pieces and of models.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM, BPE = 1, 2
UNKNOWN_PENALTY = 10.0


def _fields(data: bytes) -> Iterator[tuple[int, bytes | int]]:
    """(number, value) of the fields of a protocol-buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(key & 7) or varint()
            yield key >> 3, data[at : at + size]
            at += size


def _traced(last: list[str]) -> list[str]:
    """The pieces of the segmentation whose last piece at each place is ``last``."""
    pieces, end = [], len(last) - 1
    while end:
        pieces.append(last[end])
        end -= len(last[end])
    return pieces[::-1]


class _Scored:
    """The greatest score at each place of a word and the piece that reaches it, while they are being relaxed."""

    def __init__(self, codec: Codec, word: str):
        self.best, self.last = [0.0] + [-np.inf] * len(word), [""] * (len(word) + 1)
        self.unknown = codec.least - UNKNOWN_PENALTY
        #: Characters without a piece of their own, those to come, the last first.
        self.lone = [] if codec.alone.issuperset(word) else [i for i in reversed(range(len(word))) if word[i] not in codec.alone]

    def pass_lone(self, word: str, to: int) -> None:
        """Relax by the lone characters before ``to``, once all pieces that end there are in."""
        while self.lone and self.lone[-1] < to:
            at = self.lone.pop()
            if (total := self.best[at] + self.unknown) > self.best[at + 1]:
                self.best[at + 1], self.last[at + 1] = total, word[at]


class Codec(WordCache):
    """A model's pieces with their scores, as an encoder and a decoder."""

    def __init__(self, pieces: list[tuple[str, float, int]], kind: int, add_prefix: bool = True, collapse: bool = False):
        super().__init__(2_000_000, 16_000_000)
        self.kind, self.add_prefix, self.collapse = kind, add_prefix, collapse
        self.scores = np.array([s for _, s, _ in pieces], np.float64)
        self.score = {p: s for p, s, t in pieces if t == NORMAL}
        self.id = {p: i for i, (p, _, t) in enumerate(pieces) if t == NORMAL}
        self.byte_ids = [i for i, (_, _, t) in enumerate(pieces) if t == BYTE]
        self.unknown = next((i for i, (_, _, t) in enumerate(pieces) if t == UNKNOWN), 0)
        if len(self.byte_ids) not in (0, 256) or any(t == USER_DEFINED for _, _, t in pieces):
            raise ValueError("models with user-defined pieces or only some bytes are not supported")
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.score)
        # a line end that no longer piece holds parts words as well
        alone = "".join(c for c in "\n\r\t" if not any(c in p for p in self.score if len(p) > 1))
        self.words = re.compile(f"{SPACE}+[^{SPACE}{alone}]*|[^{SPACE}{alone}]+" + (f"|[{alone}]" if alone else ""))
        self.automaton = ahocorasick.Automaton()
        for p in self.score:
            self.automaton.add_word(p, p)
        if self.score:
            self.automaton.make_automaton()
        self.alone = {p for p in self.score if len(p) == 1}
        self.least = min(self.score.values(), default=0.0)
        self.stable: dict[str, dict[str, bool]] = {}
        self.n_stable = 0
        text = {NORMAL: lambda p: p.encode(), USER_DEFINED: lambda p: p.encode(), BYTE: lambda p: bytes([int(p[3:5], 16)]), UNKNOWN: lambda p: " ⁇ ".encode()}
        self.bytes = [text.get(t, lambda p: b"")(p) for p, _, t in pieces]
        self.byte_data = np.frombuffer(b"".join(self.bytes), np.uint8)
        self.byte_lengths = np.array([*map(len, self.bytes), 0])
        self.byte_starts = np.cumsum(self.byte_lengths) - self.byte_lengths

    @classmethod
    def load(cls, path: str, best: bool = False) -> Codec:
        """The codec of a model file; with ``best`` one that keeps the best-scored segmentation beside the ids."""
        with open(path, "rb") as f:
            model = f.read()
        pieces, kind, prefix, collapse = [], UNIGRAM, True, True
        for number, value in _fields(model):
            if number == 1:
                own = dict(_fields(value))
                pieces.append((own[1].decode(), struct.unpack("<f", own[2])[0] if 2 in own else 0.0, own.get(3, NORMAL)))
            elif number == 2:
                kind = dict(_fields(value)).get(3, UNIGRAM)
            elif number == 3:
                own = dict(_fields(value))
                if own.get(2) or not own.get(5, 1):
                    raise ValueError("models that rewrite characters are not supported")
                prefix, collapse = bool(own.get(3, 1)), bool(own.get(4, 1))
        return (BestCodec if best else cls)(pieces, kind, prefix, collapse)

    def merged(self, text: str) -> list[str]:
        """The pieces of ``text`` by merging its best pair as long as there is one."""
        parts = list(text)
        while True:
            found = [(-self.score[x], i) for i in range(len(parts) - 1) if (x := parts[i] + parts[i + 1]) in self.score]
            if not found:
                return parts
            i = min(found)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def _leaves(self, before: str, piece: str) -> bool:
        """Whether merging leaves the two as they are; kept by ``before``."""
        self.n_stable += 1
        if self.n_stable > 1_000_000:
            self.stable, self.n_stable = {}, 1
        known = self.merged(before + piece) == ([before, piece] if before else [piece])
        self.stable.setdefault(before, {})[piece] = known
        return known

    def _by_merges(self, word: str, scored: _Scored | None = None) -> list[str]:
        """``last``: the piece that ends at each place of the segmentation of what comes before it.

        The same pass relaxes ``scored``, if given.
        """
        last, filled, stable, none = [""] * (len(word) + 1), 0, self.stable, {}
        score = self.score
        if scored:
            best, ends, lone = scored.best, scored.last, scored.lone
        for at, piece in self.automaton.iter(word) if score else ():
            end = at + 1
            begin = end - len(piece)
            if scored:
                if lone and lone[-1] < at:
                    scored.pass_lone(word, at)
                if (total := best[begin] + score[piece]) > best[end]:
                    best[end], ends[end] = total, piece
            if last[end]:
                continue
            while filled < at:  # every place before has its piece by now, or is a character without one
                filled += 1
                if not last[filled]:
                    last[filled] = word[filled - 1]
            before = last[begin]
            known = stable.get(before, none).get(piece)
            if known is None:
                known = self._leaves(before, piece)
                stable = self.stable
            if known:
                last[end] = piece
        for end in range(filled + 1, len(word) + 1):
            if not last[end]:
                last[end] = word[end - 1]
        if scored:
            scored.pass_lone(word, len(word))
        return last

    def _by_scores(self, word: str) -> list[str]:
        """``last``: the last piece of the best-scored segmentation that ends at each place."""
        scored = _Scored(self, word)
        best, last, lone, score = scored.best, scored.last, scored.lone, self.score
        for at, piece in self.automaton.iter(word) if score else ():
            if lone and lone[-1] < at:
                scored.pass_lone(word, at)
            end = at + 1
            if (total := best[end - len(piece)] + score[piece]) > best[end]:
                best[end], last[end] = total, piece
        scored.pass_lone(word, len(word))
        return last

    def segment(self, word: str) -> list[str]:
        """The pieces of a word, in one pass."""
        return _traced(self._by_merges(word) if self.kind == BPE else self._by_scores(word))

    def _ids(self, pieces: list[str]) -> list[int]:
        ids = [*map(self.id.get, pieces)]
        if None not in ids:
            return ids
        out, unknown = [], False
        for piece, known in zip(pieces, ids, strict=True):
            if known is not None:
                out.append(known)
            elif self.byte_ids:
                out += [self.byte_ids[b] for b in piece.encode()]
            elif not unknown:
                out.append(self.unknown)
            unknown = known is None
        return out

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out: list[int] = []
        lengths = np.empty(len(words), np.int64)
        for k, word in enumerate(words):
            before = len(out)
            out += self._ids(self.segment(word))
            lengths[k] = len(out) - before
        return np.arange(len(words)), lengths, np.array(out, np.uint32)

    def marked(self, text: str) -> str:
        """The text with its spaces marked, as pieces hold them."""
        if self.collapse:
            text = re.sub(" +", " ", text).strip(" ")
        return (SPACE if self.add_prefix and text else "") + text.replace(" ", SPACE)

    def _coded(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, pa.Array]:
        """The texts' words by number, where each text begins among them, and the dictionary."""
        words: list[str] = []
        at = [0]
        for text in texts:
            text = self.marked(text)
            words += self.words.findall(text) if self.cuts else [text] * bool(text)
            at.append(len(words))
        coded = pa.array(words, pa.large_string()).dictionary_encode()
        return coded.indices.to_numpy().astype(np.int64), np.array(at), coded.dictionary

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and where each text begins."""
        return self.ids_of(*self._coded(texts))

    def _text(self, data: bytes) -> str:
        text = data.decode(errors="replace").replace(SPACE, " ")
        return text[1:] if self.add_prefix and text.startswith(" ") else text

    def decode(self, ids: list[int]) -> str:
        """The text of ids; bytes that are no character become the replacement character."""
        return self.decode_all(np.array(ids, np.int64), np.array([0, len(ids)]))[0]

    def decode_all(self, ids: np.ndarray, at: np.ndarray) -> list[str]:
        """The texts of ids that lie one after the other and begin at ``at``; ids that the model doesn't have are nothing."""
        known = (ids >= 0) & (ids < len(self.bytes))
        ids = np.where(known, ids, len(self.bytes))
        lengths = self.byte_lengths[ids]
        ends = np.concatenate([[0], np.cumsum(lengths)])
        data = self.byte_data[ragged(self.byte_starts[ids], lengths)].tobytes()
        where = ends[at].tolist()
        return [self._text(data[a:b]) for a, b in zip(where[:-1], where[1:], strict=True)]


class BestCodec(Codec):
    """A codec whose cache holds the ids of each word and then those of its best-scored segmentation."""

    def clear(self) -> None:
        super().clear()
        self.split = np.zeros(0, np.int64)

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        out: list[int] = []
        split, lengths = np.empty(len(words), np.int64), np.empty(len(words), np.int64)
        for k, word in enumerate(words):
            if self.kind == BPE:
                scored = _Scored(self, word)
                ids, best = self._ids(_traced(self._by_merges(word, scored))), self._ids(_traced(scored.last))
            else:
                ids = best = self._ids(self.segment(word))
            out += ids
            out += best
            split[k], lengths[k] = len(ids), len(ids) + len(best)
        self.split = np.concatenate([self.split, split])
        return np.arange(len(words)), lengths, np.array(out, np.uint32)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        return self.encode_both(texts)[0]

    def encode_both(self, texts: list[str]) -> tuple[tuple[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]:
        """As ``encode``, of the ids and of the best-scored segmentation."""
        words, at, dictionary = self._coded(texts)
        number = self.numbers_of(words, dictionary)
        starts, split = self.starts[number], self.split[number]
        return self.gathered(starts, split, at), self.gathered(starts + split, self.lengths[number] - split, at)


def _crc32(ids: np.ndarray) -> int:
    return zlib.crc32(ids.astype("<u4").tobytes())


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def encode(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", best: bool = False) -> DataFrame:
    """(doc_id, text, ids, ids_crc32): ids by the model file, their crc32 over little-endian unsigned 32-bit numbers.

    ``best`` adds best_ids, best_crc32 and best_score: the segmentation with the greatest sum of the pieces' scores (which
    for unigram models is that of the ids), and the sum of the scores that the model has for its ids.
    """
    schema = "doc_id long, text string, ids array<int>, ids_crc32 long" + ", best_ids array<int>, best_crc32 long, best_score double" * best
    names = StructType.fromDDL(schema).names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(Codec.load, model, best)
        for batch in tidied(batches):
            texts = text_column(batch)
            for i, j in slices(texts, SLICE_BYTES):
                own = texts.slice(i, j - i).to_pylist()
                columns = [batch.column("doc_id").slice(i, j - i), batch.column("text").slice(i, j - i)]
                for ids, at in codec.encode_both(own) if best else (codec.encode(own),):
                    columns += [_lists(ids, at), pa.array([_crc32(ids[a:b]) for a, b in pairwise(at)], pa.int64())]
                if best:
                    columns.append(pa.array([float(codec.scores[ids[a:b]].sum()) for a, b in pairwise(at)], pa.float64()))
                yield pa.RecordBatch.from_arrays(columns, names=names)

    small_batches(df.sparkSession)
    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, schema)


def decode(df: DataFrame, model: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded``, the text of its ids."""
    schema = StructType([*df.schema.fields, StructField("decoded", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(Codec.load, model)
        for batch in tidied(batches):
            lists = batch.column(ids_col).fill_null([])
            values, offsets = lists.flatten().fill_null(-1).to_numpy().astype(np.int64), lists.offsets.to_numpy().astype(np.int64)
            texts, k = [], 0
            while k < len(lists):  # some ids at a time
                to = max(k + 1, int(np.searchsorted(offsets, offsets[k] + IDS, side="right")) - 1)
                own = offsets[k : to + 1]
                texts += codec.decode_all(values[own[0] - offsets[0] : own[-1] - offsets[0]], own - own[0])
                k = to
            texts = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, texts], names=[*batch.schema.names, "decoded"])

    return df.mapInArrow(run, schema)
