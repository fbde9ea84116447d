"""N-gram Jaccard join: documents whose sets of word shingles have a Jaccard similarity at or above a threshold.

Exact, by signature trees over candidates that no pair at the threshold can escape:

1. Each task turns its texts into sets of 64-bit shingle hashes, and sends them, packed by hash range and each once for
   a slice of texts, to reducers that count in how many documents each shingle lies. What comes back to each slice is
   only the shingles found elsewhere too. Ordered from rare to frequent, two linked sets share one of their first ``size - need + 1`` members
   (need: the overlap that the threshold asks for); a set in which all of these are found nowhere else is done.
2. Equal sets become one node. Nodes with a shared prefix member are joined to the smallest node of that member (a row
   each, no pairs), and the connected components of that are the clusters: linked nodes never lie in two clusters.
3. Each cluster is searched by a signature tree: nodes hold OR-combined bitmaps of shingles and ranges of sizes, and a
   dual traversal drops pairs of tree nodes by their sizes, by the largest overlap that their bitmaps allow, and when
   both are in one component already. What is left is verified on the sets.
4. A cluster of more than ``chunk`` nodes is dealt into chunks: first each by itself, then the representatives of the
   components found, then, if the cluster isn't one component yet, whatever is outside of its largest component against
   all of it, in pairs of chunks. So a task holds two chunks at most, and tight groups cost a step per member.
5. With ``links``, the links of every document are counted too, those inside a component that the tree leaves out as
   well: every pair of a cluster's sets is compared by lists of which sets hold a member, chunk by chunk and in pairs of
   chunks. Only counts leave a task, a row for each set and pair of chunks, weighted by how many documents a set has.

Texts are lower-cased (A-Z); words lie between bytes 20 and 09 to 0D.

Defined results: a text without words (or null) has an empty set and is linked with nothing; a text with fewer words
than a shingle has its whole sequence as its one member; a null id keeps its row with a null component and is nobody's
link; rows with the same id are one node, and each counts as a link; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ortholake.llm._exchange import PACKED, PACKED_ARROW, by_part, bytes_table, key_groups, mix, number_of_parts, rows_of, squeeze, table_bytes, unsqueeze
from ortholake.llm._graph import connected_components
from ortholake.llm._store import materialize, replayable, small_batches
from ortholake.llm._text import folding, ragged, slices, split_words, text_column, tidied

SLICE_BYTES = 4 << 20
SETS = "doc_id long, n_shingles long, s1 long, s2 long, members binary, prefix array<long>"
LEAF, FAN = 16, 4


def shingle_sets(texts: pa.Array, width: int) -> list[np.ndarray]:
    """For each text the sorted hashes of its distinct shingles of ``width`` words."""
    import pyarrow.compute as pc

    words, at, dictionary = split_words(pc.ascii_lower(texts))
    hashes = np.fromiter((xxhash.xxh64_intdigest(w.as_buffer()) for w in dictionary), np.uint64, len(dictionary))[words]
    factors = mix(np.arange(1, width + 1, dtype=np.uint64)) | np.uint64(1)
    n = len(hashes) - width + 1
    whole = np.zeros(max(n, 0), np.uint64)
    for k in range(width):
        whole += hashes[k : k + max(n, 0)] * factors[k]
    whole = mix(whole)
    sets = []
    for a, b in zip(at[:-1], at[1:], strict=True):
        if b - a >= width:
            sets.append(np.unique(whole[a : b - width + 1]))
        elif b > a:
            sets.append(mix((hashes[a:b] * factors[: b - a]).sum(dtype=np.uint64, keepdims=True) + np.uint64(b - a)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return sets


def _send(df: DataFrame, width: int, parts: int) -> DataFrame:
    """Sets packed by hash range; one row more for each slice of texts holds ids, sizes and hashes of the sets."""

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = TaskContext.get().partitionId() << 32
        for batch in tidied(batches):
            texts, ids = text_column(batch), batch.column("doc_id")
            for i, j in slices(texts, SLICE_BYTES):
                sets = shingle_sets(texts.slice(i, j - i), width)
                digests = [xxhash.xxh3_128_digest(x.tobytes()) for x in sets]
                first: dict[bytes, int] = {}
                own = [k for k, d in enumerate(digests) if first.setdefault(d, k) == k]
                members = np.concatenate([sets[k] for k in own])
                doc = np.repeat(np.array(own, np.int64), [len(sets[k]) for k in own])
                order = np.argsort(members, kind="stable")
                members, doc = members[order], doc[order]
                begin = np.flatnonzero(np.concatenate([[True], np.diff(members) != 0])[: len(members)])
                held = np.diff(np.append(begin, len(members)))
                order = np.argsort(doc[begin], kind="stable")  # texts in turn take the least room
                begin, held = begin[order], held[order]
                rows = [(p, g, 0, members[begin[at]].tobytes(), squeeze(doc[ragged(begin[at], held[at])]), squeeze(held[at])) for p, at in by_part(members[begin], parts)]
                meta = pa.table({"doc_id": ids.slice(i, j - i).cast(pa.int64()), "n": pa.array([len(x) for x in sets], pa.int64()), "digest": pa.array(digests, pa.binary(16))})
                rows.append((g % parts, g, 1, table_bytes(meta), None, None))
                yield rows_of(PACKED_ARROW, rows)
                g += 1

    return df.mapInArrow(send, PACKED)


def _count(table: pa.Table) -> pa.Table:
    """Of one hash range: the members found in more than one set, with in how many, for each slice of texts."""
    rows = table.to_pylist()
    sent = [r for r in rows if r["kind"] == 0]
    out = [(0, r["g"], 1, r["a"], None, None) for r in rows if r["kind"] == 1]
    if sent:
        members = np.concatenate([np.frombuffer(r["a"], np.uint64) for r in sent])
        held = np.concatenate([unsqueeze(r["c"]) for r in sent])
        order = np.argsort(members)
        begin = np.flatnonzero(np.concatenate([[True], np.diff(members[order]) != 0]))
        found = np.empty(len(members), np.int64)
        found[order] = np.repeat(np.add.reduceat(held[order], begin), np.diff(np.append(begin, len(members))))
        at = 0
        for r in sent:
            own = slice(at, at + len(r["a"]) // 8)
            at = own.stop
            if (more := found[own] > 1).any():
                docs = squeeze(unsqueeze(r["b"])[np.repeat(more, held[own])])
                counts = np.stack([held[own][more], found[own][more]]).astype(np.int32)
                out.append((0, r["g"], 0, members[own][more].tobytes(), docs, counts.tobytes()))
    return pa.Table.from_batches([rows_of(PACKED_ARROW, out)] if out else [], schema=PACKED_ARROW)


_SETS = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("members", pa.binary()), ("prefix", pa.list_(pa.int64()))])


def _gather(percent: int):
    def gather(table: pa.Table) -> pa.Table:
        """Of one slice of texts: a row for each, with the members found elsewhere where these could make a link."""
        rows = table.to_pylist()
        meta = bytes_table(next(r["a"] for r in rows if r["kind"] == 1))
        came = [r for r in rows if r["kind"] == 0]
        counts = [np.frombuffer(r["c"], np.int32).reshape(2, -1) for r in came]
        members = np.concatenate([np.zeros(0, np.uint64), *(np.repeat(np.frombuffer(r["a"], np.uint64), held) for r, (held, _) in zip(came, counts, strict=True))])
        doc = np.concatenate([np.zeros(0, np.int64), *(unsqueeze(r["b"]) for r in came)])
        found = np.concatenate([np.zeros(0, np.int32), *(np.repeat(found, held) for held, found in counts)])
        order = np.lexsort((members, found, doc))
        members, doc = members[order], doc[order]
        sizes = meta["n"].to_numpy()
        at = np.searchsorted(doc, np.arange(len(sizes) + 1))
        own_members: list[bytes | None] = []
        prefixes: list[np.ndarray | None] = []
        for k, size in enumerate(sizes.tolist()):
            own = members[at[k] : at[k + 1]]
            prefix = size - -(-percent * size // 100) + 1 - (size - len(own))
            live = len(own) and prefix > 0
            own_members.append(np.sort(own).tobytes() if live else None)
            prefixes.append(own[:prefix].view(np.int64) if live else None)
        digests = np.frombuffer(b"".join(meta["digest"].to_pylist()), np.int64).reshape(-1, 2)
        empty = sizes == 0
        return pa.Table.from_arrays(
            [meta["doc_id"], meta["n"], pa.array(digests[:, 0], mask=empty), pa.array(digests[:, 1], mask=empty), pa.array(own_members, pa.binary()), pa.array(prefixes, pa.list_(pa.int64()))],
            schema=_SETS,
        )

    return gather


def sets_with_prefixes(df: DataFrame, width: int, percent: int) -> DataFrame:
    """SETS of (doc_id, text): ``members`` and ``prefix`` only where a link is possible."""
    small_batches(df.sparkSession)
    df = replayable(df)
    parts = number_of_parts(df)
    counted = _send(df, width, parts).groupBy("part").applyInArrow(folding(_count), PACKED)
    return counted.groupBy("g").applyInArrow(folding(_gather(percent)), SETS)


def link_set(nodes: np.ndarray, sizes: np.ndarray, members: list[np.ndarray], percent: int, labels: np.ndarray | None = None, sides: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links that join the sets into their components, by dual traversal of a signature tree.

    Sets with equal ``labels`` are known to be in one component. With ``sides``, only pairs of two sides count.
    """
    n = len(nodes)
    order = np.lexsort((np.array([m[0] if len(m) else 0 for m in members], np.uint64), sizes))
    nodes, sizes, members = nodes[order], sizes[order], [members[k] for k in order]
    root = np.unique(nodes if labels is None else labels[order], return_inverse=True)[1]
    sides = None if sides is None else sides[order]
    width = min(8192, max(256, 1 << int(2 * max(map(len, members))).bit_length()))
    bits = np.zeros((n, width), bool)
    for k, m in enumerate(members):
        bits[k, ((m ^ (m >> np.uint64(32))) & np.uint64(width - 1)).astype(np.int64)] = True
    maps = np.packbits(bits, axis=1).view(np.uint64)
    over = np.array([len(m) for m in members]) - np.bitwise_count(maps).sum(1).astype(np.int64)

    levels = []
    step = LEAF
    at = np.arange(0, n, LEAF)
    level = (np.bitwise_or.reduceat(maps, at), sizes[at], np.maximum.reduceat(sizes, at), np.maximum.reduceat(over, at))
    while True:
        levels.append((step, *level))
        if len(level[0]) == 1:
            break
        at = np.arange(0, len(level[0]), FAN)
        level = (np.bitwise_or.reduceat(level[0], at), level[1][at], np.maximum.reduceat(level[2], at), np.maximum.reduceat(level[3], at))
        step *= FAN

    links: list[tuple[int, int]] = []
    todo = [(len(levels) - 1, 0, 0)]
    while todo:
        k, i, j = todo.pop()
        step, union, low, high, most = levels[k]
        if percent * low[j] > 100 * high[i]:
            continue
        if int(np.bitwise_count(union[i] & union[j]).sum()) + min(most[i], most[j]) < percent * (low[i] + low[j]) / (100 + percent):
            continue
        a, b = slice(i * step, min(n, (i + 1) * step)), slice(j * step, min(n, (j + 1) * step))
        if (root[a] == root[a.start]).all() and (root[b] == root[a.start]).all():
            continue
        if k:
            below = len(levels[k - 1][1])
            left, right = range(i * FAN, min(below, (i + 1) * FAN)), range(j * FAN, min(below, (j + 1) * FAN))
            pairs = [(k - 1, x, y) for x in left for y in right if x <= y]
            todo += sorted(pairs, key=lambda p: p[1] == p[2])  # a leaf with itself comes first
            continue
        overlap = np.bitwise_count(maps[a, None] & maps[None, b]).sum(2).astype(np.int64) + np.minimum(over[a, None], over[None, b])
        able = (100 + percent) * overlap >= percent * (sizes[a, None] + sizes[None, b])
        able &= root[a, None] != root[None, b]
        if i == j:
            able &= np.triu(np.ones(able.shape, bool), 1)
        if sides is not None:
            able &= sides[a, None] != sides[None, b]
        for x, y in np.argwhere(able):
            x, y = x + a.start, y + b.start
            if root[x] == root[y]:
                continue
            shared = len(np.intersect1d(members[x], members[y], assume_unique=True))
            if 100 * shared >= percent * (sizes[x] + sizes[y] - shared):
                links.append((int(nodes[x]), int(nodes[y])))
                root[root == root[y]] = root[x]
    return links


def _link(members: DataFrame, keys: list[str], percent: int) -> DataFrame:
    """Links (a, b) within each group of ``members``: keys, node, n, members, label, side (null: all pairs count)."""

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(batches, keys):
            sides = group["side"].to_numpy(zero_copy_only=False)
            found = link_set(
                group["node"].to_numpy(), group["n"].to_numpy(), [np.frombuffer(m, np.uint64) for m in group["members"].to_pylist()], percent, group["label"].to_numpy(), None if group["side"].null_count else sides
            ) if group.num_rows > 1 else []
            if found:
                yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], names=["a", "b"])

    rows = members.select(*keys, "node", "n", "members", "label", "side").repartition(*keys).sortWithinPartitions(*keys)
    return rows.mapInArrow(search, "a long, b long")


def _dealt(members: DataFrame, counts: DataFrame, chunk: int) -> DataFrame:
    """``members`` with a chunk number: as many chunks of a cluster as its count asks for."""
    return members.join(counts, "cluster").withColumn("chunk", F.expr(f"pmod(xxhash64(node), ceil(count / {chunk}))").cast("long"))


def component_links(members: DataFrame, percent: int, chunk: int = 1024) -> DataFrame:
    """Links (a, b) that join the nodes of each cluster into their components. ``members``: cluster, node, n, members."""
    members = members.withColumn("label", F.col("node")).withColumn("side", F.lit(None).cast("int"))
    counts = materialize(members.groupBy("cluster").count(), "counts")
    links = materialize(_link(_dealt(members, counts, chunk), ["cluster", "chunk"], percent), "links")
    big = counts.where(F.col("count") > chunk)
    if big.isEmpty():
        return links

    def labelled() -> DataFrame:
        roots = connected_components(links)
        rows = members.drop("label").join(big.select("cluster"), "cluster", "left_semi").join(roots, "node", "left")
        return rows.withColumn("label", F.coalesce("root", "node")).drop("root")

    heads = labelled().where(F.col("node") == F.col("label"))
    more = _link(_dealt(heads, heads.groupBy("cluster").count(), chunk), ["cluster", "chunk"], percent)
    links = materialize(links.union(more), "links")

    rows = materialize(labelled(), "labelled")
    sizes = rows.groupBy("cluster", "label").count()
    largest = sizes.groupBy("cluster").agg(F.max_by("label", "count").alias("largest"), F.max("count").alias("majors"), F.sum("count").alias("all"))
    largest = largest.where(F.col("all") > F.col("majors"))
    number = f"ceil(({{}}) / {chunk})"
    rows = (
        rows.join(largest, "cluster")
        .withColumn("is_minor", F.col("label") != F.col("largest"))
        .withColumn("minor_chunks", F.expr(number.format("all - majors")))
        .withColumn("major_chunks", F.expr(number.format("majors")))
        .withColumn("own", F.expr("pmod(xxhash64(node), if(is_minor, minor_chunks, major_chunks))"))
    )
    # cell (x, y): chunk x of the minor nodes with chunk y of the minor nodes (x <= y) or, after these, of the major
    cells = F.expr(
        """if(is_minor,
              concat(transform(sequence(0L, minor_chunks - 1),
                               c -> struct(least(own, c) as x, greatest(own, c) as y, if(own = c, null, if(own < c, 0, 1)) as side)),
                     transform(sequence(0L, major_chunks - 1), c -> struct(own as x, minor_chunks + c as y, 0 as side))),
              transform(sequence(0L, minor_chunks - 1), c -> struct(c as x, minor_chunks + own as y, 1 as side)))"""
    )
    rows = rows.drop("side").select("cluster", "node", "n", "members", "label", F.inline(cells))
    return materialize(links.union(_link(rows, ["cluster", "x", "y"], percent)), "links")


def link_counts(sizes: np.ndarray, members: list[np.ndarray], weights: np.ndarray, percent: int, sides: np.ndarray | None = None) -> np.ndarray:
    """For each set the sum of the weights of all others that it is linked with. With ``sides``, only of the other side."""
    n = len(sizes)
    lengths = np.array([len(m) for m in members])
    number = np.unique(np.concatenate(members), return_inverse=True)[1]
    holders = np.repeat(np.arange(n), lengths)[np.argsort(number, kind="stable")]
    held = np.bincount(number)
    first = np.cumsum(held) - held
    counts = np.zeros(n, np.int64)
    for k, own in enumerate(np.split(number, np.cumsum(lengths)[:-1])):
        shared = np.zeros(n, np.int64)
        for some in np.split(own, np.flatnonzero(np.diff(np.cumsum(held[own]) >> 22)) + 1):
            shared += np.bincount(holders[ragged(first[some], held[some])], minlength=n)
        linked = (shared > 0) & ((100 + percent) * shared >= percent * (sizes + sizes[k]))
        linked[k] = False
        if sides is not None:
            linked &= sides != sides[k]
        counts[k] = weights[linked].sum()
    return counts


def class_links(members: DataFrame, percent: int, chunk: int = 1024) -> DataFrame:
    """(s1, s2, links) of the sets with links to others. ``members``: cluster, s1, s2, n, members, class_size."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group in key_groups(tidied(batches), ["cluster", "x", "y"]):
            if group.num_rows > 1:
                sides = None if group["side"].null_count else group["side"].to_numpy()
                found = link_counts(group["n"].to_numpy(), [np.frombuffer(m, np.uint64) for m in group["members"].to_pylist()], group["class_size"].to_numpy(), percent, sides)
                own = pa.table({"s1": group["s1"], "s2": group["s2"], "links": pa.array(found)}).filter(pa.array(found > 0))
                yield from own.combine_chunks().to_batches()

    # cell (x, y): chunk x with chunk y, x <= y
    cells = F.expr("transform(sequence(0L, chunks - 1), c -> struct(least(own, c) as x, greatest(own, c) as y, if(own = c, null, if(own < c, 0, 1)) as side))")
    rows = members.join(members.groupBy("cluster").count(), "cluster").withColumn("chunks", F.expr(f"ceil(count / {chunk})"))
    rows = rows.withColumn("own", F.expr("pmod(xxhash64(s1, s2), chunks)")).select("cluster", "s1", "s2", "n", "members", "class_size", F.inline(cells))
    keys = ["cluster", "x", "y"]
    counted = rows.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(count, "s1 long, s2 long, links long")
    return counted.groupBy("s1", "s2").agg(F.sum("links").alias("links"))


def ngram_components(df: DataFrame, width: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", chunk: int = 1024, links: bool = False) -> DataFrame:
    """One row per document: doc_id, n_shingles, class_id (smallest id with the same set), class_size, component_id.

    With ``links`` also n_links: how many other documents the document is linked with, those with the same set included.
    """
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    sets = materialize(sets_with_prefixes(docs, width, percent), "sets")
    known = sets.where("doc_id is not null and s1 is not null")
    classes = known.groupBy("s1", "s2").agg(F.min("doc_id").alias("node"), F.count(F.lit(1)).alias("class_size"))
    classes = materialize(classes, "classes")
    live = known.where("members is not null").dropDuplicates(["s1", "s2"]).select("s1", "s2", F.col("n_shingles").alias("n"), "members", "prefix")
    live = materialize(live.join(classes, ["s1", "s2"]), "live")

    entries = live.select("node", F.explode("prefix").alias("member"))
    least = entries.groupBy("member").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").drop("most")
    stars = entries.join(least, "member").where(F.col("node") != F.col("least")).select(F.col("node").alias("a"), F.col("least").alias("b"))
    clusters = connected_components(stars).select("node", F.col("root").alias("cluster"))
    members = materialize(live.drop("prefix").join(clusters, "node"), "members")
    roots = connected_components(component_links(members.select("cluster", "node", "n", "members"), percent, chunk))
    rows = sets.select("doc_id", "n_shingles", "s1", "s2").join(classes, ["s1", "s2"], "left").join(roots, "node", "left")
    if links:
        rows = rows.join(class_links(members, percent, chunk), ["s1", "s2"], "left")
    own = F.col("doc_id").isNotNull()
    return rows.select(
        "doc_id",
        "n_shingles",
        F.when(own, F.coalesce("node", "doc_id")).alias("class_id"),
        F.when(own, F.coalesce("class_size", F.lit(1))).alias("class_size"),
        F.when(own, F.coalesce("root", "node", "doc_id")).alias("component_id"),
        *([F.when(own, F.coalesce("class_size", F.lit(1)) - 1 + F.coalesce("links", F.lit(0))).alias("n_links")] if links else []),
    )
