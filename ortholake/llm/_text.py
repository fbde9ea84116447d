"""Columns of text as flat arrays: slices of bounded size, words, and ids of words by a tokenizer."""

from __future__ import annotations

import contextlib
import ctypes
import os
from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash


def text_column(batch: pa.RecordBatch, name: str = "text") -> pa.LargeStringArray:
    """A column of texts with 64-bit offsets; nulls are empty."""
    return pc.fill_null(batch.column(name).cast(pa.large_string()), "")


def as_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all texts together, and where each begins (one more than there are texts)."""
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    data = texts.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes, or of one row where that is longer."""
    ends = as_bytes(texts)[1][1:]
    at, done = 0, 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(ends, done + most, side="right")))
        yield at, to
        at, done = to, int(ends[to - 1])


def split_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Words between bytes 20 and 09 to 0D: their numbers in the dictionary, where each text begins, the dictionary."""
    lists = pc.ascii_split_whitespace(texts)
    flat, at = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    at = at - at[0]
    full = pc.greater(pc.binary_length(flat), 0)
    kept = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False), dtype=np.int64)])
    coded = flat.filter(full).dictionary_encode()
    return coded.indices.to_numpy().astype(np.int64), kept[at], coded.dictionary


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Positions start, start + 1 ... of each length, one after the other."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


class WordCache:
    """Ids of words that are encoded apart from one another, so that each distinct word is encoded once.

    Words are known by 96 bits of hash, in sorted arrays that take some 40 bytes a word; the cache is of bounded size
    and begun anew when full.
    """

    def __init__(self, most_words: int = 1_500_000, most_ids: int = 8_000_000):
        self.most_words, self.most_ids = most_words, most_ids
        self.clear()

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(the words' places in the order they were encoded in, how many ids each has, all ids)."""
        raise NotImplementedError

    def clear(self) -> None:
        none = (np.zeros(0, np.uint64), np.zeros(0, np.uint32), np.zeros(0, np.int32))
        self.old, self.young = none, none
        self.starts, self.lengths, self.ids = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint32)

    @staticmethod
    def _merged(*parts: tuple) -> tuple:
        keys, checks, numbers = zip(*parts, strict=True)
        order = np.argsort(np.concatenate(keys))
        return tuple(np.concatenate(x)[order] for x in (keys, checks, numbers))  # one after the other, for less at once

    def _find(self, keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        found = np.full(len(keys), -1, np.int64)
        for known, check, numbers in (self.old, self.young):
            if len(known):
                at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
                hit = (known[at] == keys) & (check[at] == checks)
                found[hit] = numbers[at[hit]]
        return found

    def _add(self, words: list[str], keys: np.ndarray, checks: np.ndarray) -> np.ndarray:
        order, lengths, ids = self.encode_words(words)
        numbers = np.empty(len(words), np.int32)
        numbers[order] = len(self.starts) + np.arange(len(words))
        self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(lengths) - lengths])
        self.lengths, self.ids = np.concatenate([self.lengths, lengths]), np.concatenate([self.ids, ids])
        self.young = self._merged(self.young, (keys, checks, numbers))
        if len(self.young[0]) > 50_000 + len(self.old[0]) // 4:
            self.old, self.young = self._merged(self.old, self.young), tuple(x[:0] for x in self.young)
        return numbers

    def numbers_of(self, words: np.ndarray, dictionary: pa.Array) -> np.ndarray:
        """The places of words in the cache, by their numbers in the dictionary; what is new is encoded."""
        if len(self.starts) + len(dictionary) > self.most_words or len(self.ids) > self.most_ids:
            self.clear()
        hashes = np.frombuffer(b"".join([xxhash.xxh3_128_digest(w.as_buffer()) for w in dictionary]), [("key", "<u8"), ("check", "<u4"), ("rest", "<u4")])
        keys, checks = hashes["key"].copy(), hashes["check"].copy()
        number = self._find(keys, checks)
        new = np.flatnonzero(number < 0)
        if len(new):
            number[new] = self._add(dictionary.take(pa.array(new)).to_pylist(), keys[new], checks[new])
        return number[words]

    def gathered(self, starts: np.ndarray, lengths: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids that words hold from ``starts`` on, one after the other, and where each text begins."""
        return self.ids[ragged(starts, lengths)], np.concatenate([[0], np.cumsum(lengths)])[at]

    def ids_of(self, words: np.ndarray, at: np.ndarray, dictionary: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and where each text begins: words by number, where texts begin among them."""
        number = self.numbers_of(words, dictionary)
        return self.gathered(self.starts[number], self.lengths[number], at)


#: Words and white space of several kinds, to see whether a tokenizer takes words apart from one another.
PROBE = "The quick  brown\tfox\njumps \r\nover 42 lazy dogs, d'accord; Ünï 漢字 a\x0bb\x0cc"


class WordIds(WordCache):
    """Ids by a tokenizer: word by word where it never joins text across white space, else of whole texts."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        super().__init__(most_words=1_000_000, most_ids=5_000_000)

        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for token, i in self.tokenizer.get_vocab().items() if suffix and token.endswith(suffix)]] = True
        self.apart = all(self._ids(x) == [i for w in split_words(pa.array([x], pa.large_string()))[2].to_pylist() for i in self._ids(w)] for x in (PROBE, f" {PROBE} "))

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _together(self, words: list[str]) -> tuple[np.ndarray, np.ndarray] | None:
        """(lengths, ids) of words of letters, encoded as one text: each is one run that ends where a word ends.

        Null unless there are as many ends as words; every word has at least one.
        """
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(words)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.ends[ids]) + 1
        return (np.diff(at, prepend=0), ids) if len(at) == len(words) and at[-1] == len(ids) else None

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        plain = [k for k, w in enumerate(words) if w.isalpha() and len(w) < 100] if self.ends.any() else []
        rest, order, done = list(set(range(len(words))).difference(plain)), [], []
        for i in range(0, len(plain), 256):
            some = plain[i : i + 256]
            if (found := self._together([words[k] for k in some])) is None:
                rest += some
            else:
                order += some
                done.append(found)
        apart = [x.ids for i in range(0, len(rest), 4096) for x in self.tokenizer.encode_batch_fast([words[k] for k in rest[i : i + 4096]], add_special_tokens=False)]
        lengths = np.fromiter(map(len, apart), np.int64, len(apart))
        done.append((lengths, np.fromiter(chain.from_iterable(apart), np.uint32, int(lengths.sum()))))
        return np.array(order + rest, np.int64), *(np.concatenate(x) for x in zip(*done, strict=True))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts together, and where each text begins."""
        if self.apart:
            return self.ids_of(*split_words(texts))
        each = [self._ids(x.as_py()) for x in texts]
        ends = np.cumsum([0, *map(len, each)])
        return np.fromiter(chain.from_iterable(each), np.uint32, int(ends[-1])), ends


def tidy() -> None:
    """Give back what Arrow and the C library keep of freed memory; workers outlive their tasks."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def tidied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches, tidied up after every few and at the end."""
    for n, batch in enumerate(batches, 1):
        yield batch
        del batch
        if n % 4 == 0:
            tidy()
    tidy()


def folding(fold: Callable[[pa.Table], pa.Table]) -> Callable[[pa.Table], pa.Table]:
    """``fold``, tidied up after."""

    def run(table: pa.Table) -> pa.Table:
        out = fold(table)
        del table
        tidy()
        return out

    return run


_READY: dict[tuple, object] = {}


def once(make, *args):
    """What ``make(*args)`` gives, made once in each worker."""
    key = (make.__qualname__, *args)
    if key not in _READY:
        _READY[key] = make(*args)
    return _READY[key]
