"""Removal of repeated passages: bytes that a window of ``depth`` bytes covers which a smaller document has too.

Suffixes are ordered only through ``depth`` bytes, by most-significant-digit radix passes, and groups that are still
equal after the last pass are exactly the repeated windows. Passes before the first one keep nearly all suffixes from
having to be sorted, or to be moved, at all:

1. Each window belongs to its anchor, the gram of ``gram`` bytes in it whose hash is least: equal windows have equal
   anchors, and neighbouring windows share one, so that a text has an anchor for about every dozen bytes. Anchors go to
   reducers, packed by hash range (the first digit): 12 bytes for the anchor and for its context, the bytes of all its
   windows (a hash of 64 bits, among equal anchors only). What a slice of texts has twice goes once.
2. An anchor found in one document only is done. Where a smaller document has the anchor with the same context, all of
   its windows are repeated, and done too. Just the contexts that differ though their anchors are equal go on.
3. The bytes of these go to the reducers of their anchors, and their windows are sorted by digits of 8 bytes. A group
   leaves as soon as it lies in one document. Anchors with very many contexts are dealt out window by window instead,
   and each slice sends equal windows once.
4. What is found comes back to the documents as intervals.

Positions are bytes of the UTF-8 text, and windows never cross documents. Everything is judged on the input.

Defined results: a null or empty text has no bytes; a null id takes no part and keeps its text; rows with the same id
don't count as repeats of each other; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StructField, StructType

from ortholake.llm._exchange import PACKED, PACKED_ARROW, by_part, bytes_table, mix, number_of_parts, rows_of, squeeze, squeeze_long, table_bytes, unsqueeze, unsqueeze_long
from ortholake.llm._store import materialize, replayable, small_batches
from ortholake.llm._text import as_bytes, folding, once, ragged, slices, text_column, tidied

SEGMENT = 1 << 18
#: A slice sends a row to each hash range, so what rows cost besides their anchors grows with the square of the input.
SLICE_BYTES = 4 << 20
BATCH_BYTES = 4 << 20
#: Bytes of contexts that are sorted at once; equal windows have equal keys, so any set of keys can be sorted by itself.
BLOCK_BYTES = 2 << 20
PLACE = np.uint64((1 << 22) - 1)
#: Marks an anchor whose contexts are dealt out window by window.
HOT_BIT = np.uint64(1 << 63)

SENT = np.dtype([("key", "<u4"), ("context", "<u8")])
FOUND = "doc_id long, h long, starts binary, ends binary, places binary, spans binary, keys binary"
CONTEXTS = "part int, keys binary, docs binary, hashes binary, places binary, sizes binary, data binary, starts binary, ends binary"
CUT = "doc_id long, h long, starts binary, ends binary"


class Rolling:
    """Hashes of byte strings from prefix sums of byte values times powers, modulo 2 ** 64."""

    def __init__(self, length: int):
        factor = 0x9E3779B97F4A7C15
        self.values = mix(np.arange(1, 257, dtype=np.uint64))
        self.powers = self._powers(factor, length)
        self.inverse = self._powers(pow(factor, -1, 1 << 64), length)

    @staticmethod
    def _powers(x: int, n: int) -> np.ndarray:
        each = np.full(n, x, np.uint64)
        each[0] = 1
        return np.cumprod(each, dtype=np.uint64)

    def sums(self, data: np.ndarray) -> np.ndarray:
        return np.concatenate([np.zeros(1, np.uint64), np.cumsum(self.values[data] * self.powers[: len(data)], dtype=np.uint64)])


def find_anchors(data: np.ndarray, offsets: np.ndarray, depth: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor hash, context hash, first window, number of windows less one) over texts that begin at ``offsets``."""
    rolling = once(Rolling, SEGMENT + depth + 1)
    found = [(np.zeros(0, np.uint64), np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64))]
    whole = np.ones(len(data), bool)
    for end in offsets[1:].tolist():
        whole[max(0, end - depth + 1) : end] = False
    for at in range(0, len(data) - depth + 1, SEGMENT):
        part = data[at : at + SEGMENT + depth - 1]
        sums = rolling.sums(part)
        grams = mix((sums[gram:] - sums[:-gram]) * rolling.inverse[: len(part) - gram + 1])
        least = (grams & ~PLACE) | np.arange(len(grams), dtype=np.uint64)
        n, width = 1, depth - gram + 1
        while 2 * n <= width:
            least = np.minimum(least[:-n], least[n:])
            n *= 2
        if n < width:
            least = np.minimum(least[: len(least) - width + n], least[width - n :])
        window = np.flatnonzero(whole[at : at + len(least)])
        if not len(window):
            continue
        anchor = (least[window] & PLACE).astype(np.int64)
        breaks = np.flatnonzero((np.diff(anchor) != 0) | (np.diff(window) != 1))
        first, last = window[np.concatenate([[0], breaks + 1])], window[np.concatenate([breaks, [len(window) - 1]])]
        anchor = anchor[np.concatenate([[0], breaks + 1])]
        context = (sums[last + depth] - sums[first]) * rolling.inverse[first]
        shape = ((last - first) * depth + anchor - first).astype(np.uint64)
        found.append((grams[anchor], mix(context + mix(shape)), at + first, last - first))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def _pack(x: np.ndarray) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(x).tobytes())


def _unpack(x: bytes, kind) -> np.ndarray:
    return np.frombuffer(zstandard.ZstdDecompressor().decompress(x), kind)


def _send(df: DataFrame, depth: int, gram: int, parts: int) -> DataFrame:
    """Anchors packed by hash range; one row more for each slice of texts holds ids and what the slice itself repeats."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId() << 32
        for batch in tidied(batches):
            texts, ids, hashes = text_column(batch), batch.column("doc_id"), batch.column("h")
            for i, j in slices(texts, SLICE_BYTES):
                data, offsets = as_bytes(texts.slice(i, j - i))
                own = ids.slice(i, j - i).to_numpy(zero_copy_only=False)
                key, context, first, span = find_anchors(data, offsets, depth, gram)
                row = np.searchsorted(offsets, first, side="right") - 1
                doc = own[row]
                order = np.lexsort((doc, context, key))
                begins = np.concatenate([[True], (np.diff(key[order]) != 0) | (np.diff(context[order]) != 0)])[: len(order)]
                leader = doc[order][np.flatnonzero(begins)][np.cumsum(begins) - 1]
                repeated = np.zeros(len(key), bool)
                repeated[order] = doc[order] > leader
                keep = np.flatnonzero(~repeated)
                sent = np.empty(len(keep), SENT)
                sent["key"], sent["context"] = key[keep] >> np.uint64(32), context[keep]
                rows = []
                for p, at in by_part(key[keep] << np.uint64(32), parts):
                    at_rows = row[keep[at]]
                    new = np.concatenate([[True], np.diff(at_rows) != 0])
                    docs = _two(squeeze(at_rows), squeeze_long(own[at_rows[new]] - at_rows[new]))
                    rows.append((p, g, 0, sent[at].tobytes(), docs, _two(squeeze(first[keep[at]]), _pack(span[keep[at]].astype(np.uint8)))))
                meta = pa.table({"doc_id": pa.array(own), "h": hashes.slice(i, j - i), "at": pa.array(offsets[:-1])})
                done = np.flatnonzero(repeated)
                rows.append((g % parts, g, 1, table_bytes(meta), squeeze(first[done]), _pack(span[done].astype(np.uint8))))
                n = 1 + (12 * len(sent)) // BATCH_BYTES
                for k in range(n):
                    if some := rows[k::n]:
                        yield rows_of(PACKED_ARROW, some)
                g += 1

    return df.mapInArrow(send, PACKED)


def _two(a: bytes, b: bytes) -> bytes:
    return len(a).to_bytes(4, "little") + a + b


def _pair(data: bytes) -> tuple[bytes, bytes]:
    n = 4 + int.from_bytes(data[:4], "little")
    return data[4:n], data[n:]


def _classify(hot_contexts: int):
    def classify(table: pa.Table) -> pa.Table:
        """Of one hash range, for each slice: kind 0, anchors whose windows are all repeated; kind 2, anchors to compare."""
        rows = table.to_pylist()
        came = [r for r in rows if r["kind"] == 0]
        out = [(0, r["g"], 1, r["a"], r["b"], r["c"]) for r in rows if r["kind"] == 1]
        if came:
            sent = [np.frombuffer(r["a"], SENT) for r in came]
            docs = []
            for r in came:
                squeezed, ids = _pair(r["b"])
                at_rows = unsqueeze(squeezed)
                docs.append(unsqueeze_long(ids)[np.cumsum(np.diff(at_rows, prepend=at_rows[:1]) != 0)] + at_rows)
            doc, every = np.concatenate(docs), np.concatenate(sent)
            keys = every["key"]
            order = np.argsort(keys, kind="stable")
            same = np.diff(keys[order]) == 0
            order = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]
            full, need, hot = np.zeros(len(every), bool), np.zeros(len(every), bool), np.zeros(len(every), bool)
            if len(order):
                order = order[np.lexsort((doc[order], every["context"][order], keys[order]))]
                k, d, context = keys[order], doc[order], every["context"][order]
                new_key = np.concatenate([[True], np.diff(k) != 0])
                new_context = new_key | np.concatenate([[True], np.diff(context) != 0])
                key_at, key_no = np.flatnonzero(new_key), np.cumsum(new_key) - 1
                several = (np.minimum.reduceat(d, key_at) != np.maximum.reduceat(d, key_at))[key_no]
                least = d[np.flatnonzero(new_context)][np.cumsum(new_context) - 1]
                contexts = np.add.reduceat(new_context.astype(np.int64), key_at)[key_no]
                full[order] = several & (d > least)
                need[order] = several & (d == least) & (contexts > 1)
                hot[order] = contexts > hot_contexts
            at = 0
            for r, own_sent in zip(came, sent, strict=True):
                own = slice(at, at + len(own_sent))
                at = own.stop
                f, n = full[own], need[own]
                if f.any() or n.any():
                    squeezed, spans = _pair(r["c"])
                    first, span = unsqueeze(squeezed), _unpack(spans, np.uint8)
                    if f.any():
                        out.append((0, r["g"], 0, squeeze(first[f]), _pack(span[f]), None))
                    if n.any():
                        key = own_sent["key"][n].astype(np.uint64) | np.uint64(r["part"] << 32) | (hot[own][n].astype(np.uint64) << np.uint64(63))
                        out.append((0, r["g"], 2, squeeze(first[n]), _pack(span[n]), _pack(key)))
        return pa.Table.from_batches([rows_of(PACKED_ARROW, out)] if out else [], schema=PACKED_ARROW)

    return classify


def _runs(first: np.ndarray, end: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs (begin, end, row) of intervals that are in order of row and begin."""
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], (first[1:] > reach[:-1]) | (np.diff(row) != 0)])[: len(first)]
    at = np.flatnonzero(new)
    return first[at], np.maximum.reduceat(end, at) if len(at) else end[:0], row[at]


_FOUND = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), *((x, pa.binary()) for x in ("starts", "ends", "places", "spans", "keys"))])


def _gather(depth: int):
    def gather(table: pa.Table) -> pa.Table:
        """Of one slice: for each document the runs known to be repeated, and the contexts that are to be compared."""
        rows = table.to_pylist()
        head = next(r for r in rows if r["kind"] == 1)
        meta = bytes_table(head["a"])
        at = meta["at"].to_numpy()
        known = [(head["b"], head["c"]), *((r["a"], r["b"]) for r in rows if r["kind"] == 0)]
        first = np.concatenate([unsqueeze(a) for a, _ in known])
        end = first + np.concatenate([_unpack(b, np.uint8) for _, b in known]).astype(np.int64) + depth
        order = np.argsort(first)
        first, end = first[order], end[order]
        first, end, row = _runs(first, end, np.searchsorted(at, first, side="right") - 1)
        open_rows = [r for r in rows if r["kind"] == 2]
        place = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(r["a"]) for r in open_rows)])
        span = np.concatenate([np.zeros(0, np.uint8), *(_unpack(r["b"], np.uint8) for r in open_rows)])
        key = np.concatenate([np.zeros(0, np.uint64), *(_unpack(r["c"], np.uint64) for r in open_rows)])
        order = np.argsort(place)
        place, span, key = place[order], span[order], key[order]
        place_row = np.searchsorted(at, place, side="right") - 1
        ids, hashes, out = meta["doc_id"].to_pylist(), meta["h"].to_pylist(), []
        every = np.arange(len(at) + 1)
        a, b = np.searchsorted(row, every), np.searchsorted(place_row, every)
        for k in np.flatnonzero((np.diff(a) > 0) | (np.diff(b) > 0)).tolist():
            x, y = slice(a[k], a[k + 1]), slice(b[k], b[k + 1])
            some, more = x.start < x.stop, y.start < y.stop
            out.append((
                ids[k], hashes[k],
                squeeze(first[x] - at[k]) if some else None, squeeze(end[x] - at[k]) if some else None,
                squeeze(place[y] - at[k]) if more else None, _pack(span[y]) if more else None, _pack(key[y]) if more else None,
            ))
        return pa.Table.from_batches([rows_of(_FOUND, out)] if out else [], schema=_FOUND)

    return gather


_CONTEXTS = pa.schema([("part", pa.int32()), *((x, pa.binary()) for x in ("keys", "docs", "hashes", "places", "sizes", "data", "starts", "ends"))])
_CUT = pa.schema([("doc_id", pa.int64()), ("h", pa.int64()), ("starts", pa.binary()), ("ends", pa.binary())])


def _expanded(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Runs of rows with their texts: at most ``SLICE_BYTES`` of these, or one longer text, however small compressed ones are."""
    expand = zstandard.ZstdDecompressor()
    for batch in tidied(batches):
        texts: list[bytes] = []
        at = size = 0
        for z in batch.column("z"):
            text = expand.decompress(z.as_buffer())
            if texts and size + len(text) > SLICE_BYTES:
                yield batch.slice(at, len(texts)), texts
                at, size, texts = at + len(texts), 0, []
            texts.append(text)
            size += len(text)
        if texts:
            yield batch.slice(at), texts


def _compress(df: DataFrame) -> DataFrame:
    """(doc_id, h, z): texts as they are moved."""

    def compress(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        small = zstandard.ZstdCompressor(level=3)
        for batch in tidied(batches):
            z = pa.array([small.compress(x.as_buffer()) for x in text_column(batch)], pa.binary())
            yield batch.set_column(batch.schema.get_field_index("text"), pa.field("z", pa.binary()), z)

    schema = StructType([StructField("z", BinaryType()) if f.name == "text" else f for f in df.schema])
    return df.mapInArrow(compress, schema)


def _contexts(depth: int, parts: int):
    def contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bytes of the contexts by hash range; windows of very frequent anchors one by one, equal ones once."""
        for batch, texts in _expanded(batches):
            held: list[tuple] = []
            leaders: dict[bytes, tuple] = {}
            for doc, h, text, places, spans, keys in zip(batch.column("doc_id").to_pylist(), batch.column("h").to_pylist(), texts, *(batch.column(c).to_pylist() for c in ("places", "spans", "keys")), strict=True):
                for key, place, span in zip(_unpack(keys, np.uint64).tolist(), unsqueeze(places).tolist(), _unpack(spans, np.uint8).tolist(), strict=True):
                    if key < int(HOT_BIT):
                        held.append((key, doc, h, place, span, text[place : place + span + depth]))
                        continue
                    for at in range(place, place + span + 1):
                        window = text[at : at + depth]
                        other = leaders.setdefault(window, (doc, []))
                        if doc < other[0]:
                            leaders[window] = other = (doc, other[1])
                        other[1].append((doc, h, at))
            repeated: dict[tuple[int, int], list[int]] = {}
            for window, (least, places) in leaders.items():
                for doc, h, at in places:
                    if doc == least:
                        held.append((xxhash.xxh64_intdigest(window), doc, h, at, 0, window))
                    else:
                        repeated.setdefault((doc, h), []).append(at)
            rows = []
            key = np.array([x[0] for x in held], np.uint64)
            for p, own in by_part(mix(key), parts) if held else ():
                some = [held[k] for k in own.tolist()]
                column = lambda n, kind: _pack(np.array([x[n] for x in some], kind))  # noqa: B023, E731
                rows.append((p, _pack(key[own]), column(1, np.int64), column(2, np.int64), column(3, np.int32), column(4, np.uint8), _pack(np.frombuffer(b"".join(x[5] for x in some), np.uint8)), None, None))
            for (doc, h), places in repeated.items():
                at = np.array(sorted(places))
                first, end, _ = _runs(at, at + depth, np.zeros(len(at), np.int64))
                rows.append((doc % parts, None, _pack(np.array([doc])), _pack(np.array([h])), None, None, None, squeeze(first), squeeze(end)))
            if rows:
                yield rows_of(_CONTEXTS, rows)

    return contexts


def radix_repeats(key: np.ndarray, doc: np.ndarray, first: np.ndarray, data: np.ndarray, depth: int) -> np.ndarray:
    """Positions of the windows (``depth`` bytes of ``data`` from ``first``) that a smaller ``doc`` has too.

    Passes over digits of 8 bytes, the most significant first; only groups that still lie in several documents go on.
    Windows with different ``key`` are known to differ.
    """
    padded = np.concatenate([data, np.zeros(8, np.uint8)]).astype(np.uint64)
    digits = np.zeros(len(data), np.uint64)
    for k in range(8):
        digits |= padded[k : k + len(data)] << np.uint64(56 - 8 * k)
    left, group = np.arange(len(first)), np.unique(key, return_inverse=True)[1]
    for place in [None, *range(0, depth - 8, 8), max(0, depth - 8)]:
        if place is not None:
            digit = digits[first[left] + place]
            order = np.lexsort((digit, group))
            left, group, digit = left[order], group[order], digit[order]
            new = np.concatenate([[True], (np.diff(group) != 0) | (np.diff(digit) != 0)])[: len(left)]
        else:
            order = np.argsort(group, kind="stable")
            left, group = left[order], group[order]
            new = np.concatenate([[True], np.diff(group) != 0])[: len(left)]
        if not len(left):
            return left
        at = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        several = np.minimum.reduceat(doc[left], at) != np.maximum.reduceat(doc[left], at)
        left, group = left[several[group]], group[several[group]]
    if not len(left):
        return left
    at = np.flatnonzero(np.concatenate([[True], np.diff(group) != 0]))
    least = np.minimum.reduceat(doc[left], at)[np.cumsum(np.concatenate([[True], np.diff(group) != 0])) - 1]
    return left[doc[left] > least]


def _radix(depth: int):
    def radix(table: pa.Table) -> pa.Table:
        """Of one hash range: for each document the runs that its compared windows cover."""
        out, rows = [], table.to_pylist()
        for r in rows:
            if r["keys"] is None:
                out.append((int(_unpack(r["docs"], np.int64)[0]), int(_unpack(r["hashes"], np.int64)[0]), r["starts"], r["ends"]))
        rows = [r for r in rows if r["keys"] is not None]
        if rows:
            def column(name: str, kind) -> np.ndarray:
                return np.concatenate([_unpack(r[name], kind) for r in rows])

            key, doc, h, place, data = column("keys", np.uint64), column("docs", np.int64), column("hashes", np.int64), column("places", np.int32).astype(np.int64), column("data", np.uint8)
            n = column("sizes", np.uint8).astype(np.int64) + 1
            begin = np.cumsum(n + depth - 1) - (n + depth - 1)
            blocks = 1 + len(data) // BLOCK_BYTES
            block = mix(key) % np.uint64(blocks)
            found = []
            for k in range(blocks):
                own = np.flatnonzero(block == k)
                which = np.repeat(own, n[own])
                some = data[ragged(begin[own], n[own] + depth - 1)] if blocks > 1 else data
                first = ragged(np.cumsum(n[own] + depth - 1) - (n[own] + depth - 1), n[own])
                at = ragged(place[own], n[own])
                hit = radix_repeats(key[which], doc[which], first, some, depth)
                found.append((doc[which[hit]], h[which[hit]], at[hit]))
            doc, h, start = (np.concatenate(x) for x in zip(*found, strict=True))
            order = np.lexsort((start, h, doc))
            doc, h, start = doc[order], h[order], start[order]
            row = np.cumsum(np.concatenate([[False], (np.diff(doc) != 0) | (np.diff(h) != 0)])[: len(doc)])
            begin, end, own = np.zeros(0, np.int64), np.zeros(0, np.int64), row
            if len(row):
                pieces = [_runs(start[a:b], start[a:b] + depth, row[a:b]) for a, b in zip(*(lambda c: (c[:-1], c[1:]))(np.append(np.searchsorted(row, np.arange(row[-1] + 1)), len(row))), strict=True)]
                heads = np.searchsorted(row, np.arange(row[-1] + 1))
                for k, (begin, end, _) in zip(heads.tolist(), pieces, strict=True):
                    out.append((int(doc[k]), int(h[k]), squeeze(begin), squeeze(end)))
        return pa.Table.from_batches([rows_of(_CUT, out)] if out else [], schema=_CUT)

    return radix


_RESULT = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("starts", pa.list_(pa.int64())), ("ends", pa.list_(pa.int64()))]


def _apply(keep_text: bool):
    schema = pa.schema(_RESULT + [("text", pa.string())] * keep_text)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _expanded(batches):
            out = []
            for doc, text, cuts in zip(batch.column("doc_id").to_pylist(), texts, batch.column("cuts").to_pylist(), strict=True):
                begin, end, kept = np.zeros(0, np.int64), np.zeros(0, np.int64), text
                if cuts:
                    begin, end = (np.concatenate([unsqueeze(c[x]) for c in cuts]) for x in ("starts", "ends"))
                    order = np.argsort(begin)
                    begin, end, _ = _runs(begin[order], end[order], np.zeros(len(order), np.int64))
                    edges = [0, *np.stack([begin, end], 1).ravel().tolist(), len(text)]
                    kept = b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                row = (doc, len(text), len(text) - len(kept), len(begin), hashlib.sha256(kept).hexdigest(), begin, end)
                out.append((*row, kept.decode(errors="ignore")) if keep_text else row)
            rows = rows_of(schema, out)
            yield pa.RecordBatch.from_arrays([*rows.columns, batch.column("carried")], names=[*schema.names, "carried"])

    return apply


def remove_repeats(df: DataFrame, depth: int = 50, gram: int = 24, hot_contexts: int = 2048, keep_text: bool = False, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256, starts and ends of the removed runs.

    An anchor with more than ``hot_contexts`` contexts is dealt out window by window; that changes no result.
    ``keep_text`` adds ``text``, what is left as text; bytes of a character that was cut in two are left out of it.
    The columns in ``carry`` are added.
    """
    small_batches(df.sparkSession)
    carried = F.struct(F.lit(0).alias("_"), *carry).alias("carried")
    every = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.coalesce(text_col, F.lit(""))).alias("h"), carried)
    every = replayable(every)
    docs = every.select("doc_id", "text", "h")
    parts = number_of_parts(docs)
    sent = _send(docs.where(F.col("doc_id").isNotNull()), depth, gram, parts)
    found = materialize(sent.groupBy("part").applyInArrow(folding(_classify(hot_contexts)), PACKED).groupBy("g").applyInArrow(folding(_gather(depth)), FOUND), "anchors")
    open_docs = found.where(F.col("places").isNotNull()).select("doc_id", "h", "places", "spans", "keys").dropDuplicates(["doc_id", "h"])
    moved = _compress(docs)
    contexts = moved.join(open_docs, ["doc_id", "h"]).select("doc_id", "h", "z", "places", "spans", "keys").mapInArrow(_contexts(depth, parts), CONTEXTS)
    compared = materialize(contexts.groupBy("part").applyInArrow(folding(_radix(depth)), CUT), "compared")
    cuts = found.where(F.col("starts").isNotNull()).select("doc_id", "h", "starts", "ends").union(compared)
    cuts = cuts.groupBy("doc_id", "h").agg(F.collect_list(F.struct("starts", "ends")).alias("cuts"))
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, starts array<long>, ends array<long>" + ", text string" * keep_text
    schema = StructType([*StructType.fromDDL(schema), StructField("carried", every.schema["carried"].dataType)])
    done = _compress(every).join(cuts, ["doc_id", "h"], "left").select("doc_id", "z", "cuts", "carried").mapInArrow(_apply(keep_text), schema)
    return done.select(*(c for c in done.columns if c != "carried"), *(F.col("carried")[c].alias(c) for c in carry))
