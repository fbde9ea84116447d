"""N-gram join, line dedup, suffix dedup, nearest neighbours and the pipeline, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import SCHEMA, prose

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def table(spark, texts, start=0):
    return spark.createDataFrame([(start + i, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)


# N-gram join


def shingles(text, width=5):
    words = WORD.findall((text or "").encode().lower())
    return frozenset(tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))) if words else frozenset()


def components(rows, percent=80):
    rows = [(i, shingles(t)) for i, t in rows if i is not None]
    parent = {i: i for i, _ in rows}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(rows):
        for j, b in rows[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((find(i), find(j)))
                parent[y] = x
    return {i: find(i) for i, _ in rows}


def near_copies(seed, n, words=60, edits=3):
    r = random.Random(seed)
    base = prose(seed, words).split()
    for _ in range(n):
        own = list(base)
        for _ in range(r.randrange(edits + 1)):
            own[r.randrange(len(own))] = "new" + str(r.randrange(10**6))
        yield " ".join(own)


@pytest.mark.parametrize("chunk", [1024, 8])
def test_components_equal_brute_force(spark, chunk):
    from ortholake.llm.ngram_join import ngram_components

    texts = [*near_copies(1, 60), *near_copies(2, 30, 40, 5), *near_copies(3, 25, 12, 1), *(prose(i, 30) for i in range(40)), "a b", "A  b", "a b c", "", None]
    texts += [f"{prose(1, 60)} {prose(100 + i, 20 + i % 9)}" for i in range(40)]  # around the threshold
    random.Random(9).shuffle(texts)
    df = table(spark, texts, 100)
    rows = ngram_components(df, chunk=chunk).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == components([(100 + i, t) for i, t in enumerate(texts)])
    assert {r["doc_id"]: r["n_shingles"] for r in rows} == {100 + i: len(shingles(t)) for i, t in enumerate(texts)}
    assert len(rows) == len(texts)


def test_components_of_odd_tables(odd, odd_rows, empty):
    from ortholake.llm.ngram_join import ngram_components

    rows = ngram_components(odd).collect()
    assert len(rows) == len(odd_rows)
    want = components([(r[0], r[1]) for r in odd_rows])
    for r in rows:
        assert r["component_id"] == (want[r["doc_id"]] if r["doc_id"] is not None else None)
        assert r["class_id"] is None or r["class_id"] <= r["doc_id"]
    assert want[12] == 11 and want[2] == want[1] == -5
    assert ngram_components(empty).count() == 0


@pytest.mark.parametrize("chunk", [1024, 8])
def test_every_link_is_counted(spark, odd, odd_rows, chunk):
    from ortholake.llm.ngram_join import ngram_components

    texts = [*near_copies(1, 40), *near_copies(2, 20, 40, 5), *(prose(i, 30) for i in range(20)), "a b", "A  b", "a b c", "", None, prose(1, 60), prose(5, 30)]
    rows = [(100 + i, t) for i, t in enumerate(texts)]
    for df, rows in ((table(spark, texts, 100), rows), (odd, [r[:2] for r in odd_rows])):
        sets = [(i, shingles(t)) for i, t in rows]
        want = [None if i is None else sum(j is not None and k != m and bool(a & b) and 100 * len(a & b) >= 80 * len(a | b) for m, (j, b) in enumerate(sets)) for k, (i, a) in enumerate(sets)]
        found = ngram_components(df, chunk=chunk, links=True).select("doc_id", "n_links").collect()
        assert sorted(map(str, found)) == sorted(f"Row(doc_id={i}, n_links={n})" for (i, _), n in zip(rows, want, strict=True))
        assert max(filter(None, want)) >= 3


def test_tree_finds_the_components_of_a_set():
    from ortholake.llm.ngram_join import link_set

    r = np.random.default_rng(2)
    for trial in range(30):
        base = [r.integers(0, 2**63, 40, dtype=np.uint64) for _ in range(4)]
        sets = []
        for _ in range(r.integers(2, 90)):
            own = base[r.integers(4)].copy()
            own[: r.integers(0, 9)] = r.integers(0, 2**63, 1, dtype=np.uint64)
            sets.append(np.unique(own[: r.integers(20, 41)]))
        nodes = r.permutation(1000)[: len(sets)]
        labels = nodes if trial % 2 else nodes % 50
        links = link_set(nodes, np.array([len(s) for s in sets]), sets, 80, labels)

        def joined(pairs, labels=labels, nodes=nodes):
            root = {int(n): int(x) for n, x in zip(nodes, labels, strict=True)}
            for a, b in pairs:
                old, new = root[int(b)], root[int(a)]
                root = {k: new if v == old else v for k, v in root.items()}
            groups = defaultdict(set)
            for k, v in root.items():
                groups[v].add(k)
            return {frozenset(g) for g in groups.values()}

        every = [(nodes[i], nodes[j]) for i in range(len(sets)) for j in range(i) if 100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j]))]
        assert joined(links) == joined(every)
        assert {tuple(sorted(x)) for x in links} <= {tuple(sorted(map(int, x))) for x in every}


def test_connected_components(spark):
    from ortholake.llm._graph import connected_components

    r = random.Random(1)
    edges = [(i, i + 1) for i in range(50)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(120)] + [(1000, 1000 + i) for i in range(1, 90)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(7)
    found = {x["node"]: x["root"] for x in connected_components(df).collect()}
    root = {n: n for e in edges for n in e}
    for _ in range(200):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert found == {n: x for n, x in root.items() if any(n in e and e[0] != e[1] for e in edges)}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# Line dedup


def within_one(a, b):
    if a == b or abs(len(a) - len(b)) > 1:
        return a == b
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    j = 0
    while j < min(len(a), len(b)) - i and a[-1 - j] == b[-1 - j]:
        j += 1
    return max(len(a), len(b)) - i - j <= 1


def dedup(rows, least=0, edits=1):
    lines = sorted((i, k, x) for i, t in rows if i is not None and t is not None for k, x in enumerate(t.split("\n")) if len(x) >= least and x.strip(" \t\n\x0b\x0c\r"))
    gone = {(i, k, x) for i, k, x in lines if any((j, m) < (i, k) and (within_one(x, y) if edits else x == y) for j, m, y in lines)}
    return sorted(((i or 0, t if i is None or t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k, x) not in gone)) for i, t in rows), key=str)


def test_lines_equal_brute_force(spark):
    from ortholake.llm.line_dedup import dedup_lines

    r = random.Random(6)
    bases = [prose(i, r.randrange(2, 30)) for i in range(25)] + ["aaaaaaaaaaaa", "ababababababab", "é" * 11 + "ü", prose(77, 400), "", "  ", "é", "ab", "}", "I.", "7"]
    texts = []
    for _ in range(70):
        lines = []
        for _ in range(r.randrange(0, 7)):
            line = r.choice(bases)
            for _ in range(r.choice([0, 0, 1, 1, 2])):
                i = r.randrange(len(line) + 1)
                line = r.choice([line[:i] + r.choice("abé ") + line[i:], line[:i] + line[i + 1 :], line[:i] + r.choice("abé") + line[i + 1 :]])
            lines.append(line)
        texts.append("\n".join(lines))
    df = table(spark, texts)
    for least, edits in ((0, 1), (10, 1), (6, 0)):
        found = dedup_lines(df, least, edits).collect()
        assert sorted(((x["doc_id"], x["text"]) for x in found), key=str) == dedup(list(enumerate(texts)), least, edits)
        assert sum(x["n_dropped"] for x in found) > 20
    with pytest.raises(ValueError, match="edits"):
        dedup_lines(df, edits=2)


def test_frequent_lines_and_marks_that_are_used_up(spark, monkeypatch):
    from ortholake.llm import line_dedup

    r = random.Random(12)
    texts = ["\n".join(["all rights are reserved", f"item {r.randrange(40)}", prose(i, 5), r.choice(["one of a few lines", "one of  few lines"])]) for i in range(60)]
    want = dedup(list(enumerate(texts)))
    for words, share in ((1, 1), (1, 10_000), (1 << 18, 5)):
        monkeypatch.setattr(line_dedup, "MARK_WORDS", words)
        monkeypatch.setattr(line_dedup, "HOT_SHARE", share)
        assert sorted(((x["doc_id"], x["text"]) for x in line_dedup.dedup_lines(table(spark, texts)).collect()), key=str) == want


def test_lines_of_odd_tables(odd, odd_rows, empty):
    from ortholake.llm.line_dedup import dedup_lines

    rows = dedup_lines(odd, carry=("source",)).collect()
    want = dedup([(r[0], r[1]) for r in odd_rows])
    assert sorted(((x["doc_id"] or 0, x["text"]) for x in rows), key=str) == want
    assert dedup_lines(empty).count() == 0
    plan = dedup_lines(odd)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "InArrow" not in plan


# Suffix dedup


def cut(rows, depth=50):
    rows = [(i, (t or "").encode()) for i, t in rows]
    least = {}
    for i, t in sorted((i, t) for i, t in rows if i is not None):
        for k in range(len(t) - depth + 1):
            least.setdefault(t[k : k + depth], i)
    out = []
    for i, t in rows:
        marks = bytearray(len(t))
        for k in range(len(t) - depth + 1):
            if i is not None and least[t[k : k + depth]] < i:
                marks[k : k + depth] = b"\1" * depth
        kept = bytes(b for b, m in zip(t, marks, strict=True) if not m)
        out.append((i or 0, len(t), sum(marks), sum(m and (k == 0 or not marks[k - 1]) for k, m in enumerate(marks)), hashlib.sha256(kept).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("hot", [2048, 0])
def test_passages_equal_brute_force(spark, hot):
    from ortholake.llm.suffix_dedup import remove_repeats

    r = random.Random(8)
    passages = [prose(i, r.randrange(4, 60)) for i in range(12)] + ["ab" * 60, "x" * 140, "é漢" * 30]
    texts = ["".join(r.choice([prose(r.randrange(10**6), r.randrange(1, 12)), r.choice(passages)[r.randrange(9) :], " "]) for _ in range(r.randrange(0, 9))) for _ in range(90)] + [None, "", "short"]
    df = table(spark, texts, -20)
    columns = "doc_id n_bytes n_removed n_spans kept_sha256".split()
    found = remove_repeats(df, hot_contexts=hot, keep_text=True).collect()
    assert sorted(tuple(x[c] for c in columns) for x in found) == cut([(i - 20, t) for i, t in enumerate(texts)])
    for x in found:
        text = (texts[x["doc_id"] + 20] or "").encode()
        edges = [0, *(e for pair in zip(x["starts"], x["ends"], strict=True) for e in pair), len(text)]
        assert b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True)).decode(errors="ignore") == x["text"]


def test_passages_of_odd_tables(odd, odd_rows, empty):
    from ortholake.llm.suffix_dedup import remove_repeats

    columns = "doc_id n_bytes n_removed n_spans kept_sha256".split()
    got = sorted(tuple(x[c] or 0 for c in columns) for x in remove_repeats(odd, carry=("source",)).collect())
    assert got == cut([(r[0], r[1]) for r in odd_rows])
    assert remove_repeats(empty).count() == 0


def test_rows_of_many_hash_ranges_cost_little_besides_their_anchors(spark):
    from ortholake.llm.suffix_dedup import SENT, _send

    df = table(spark, [prose(k, 3000) for k in range(12)]).coalesce(1).selectExpr("doc_id", "text", "xxhash64(text) as h")
    rows = _send(df, 50, 24, 2000).where("kind = 0").selectExpr("length(a) as a", "length(b) + length(c) as rest").collect()
    anchors = sum(r["a"] for r in rows) // SENT.itemsize
    assert len(rows) > 1500 and sum(r["rest"] for r in rows) < 100 * len(rows) + 6 * anchors


def test_compressed_texts_are_expanded_in_bounded_runs():
    import pyarrow as pa
    import zstandard

    from ortholake.llm.suffix_dedup import SLICE_BYTES, _apply

    texts = [bytes([97 + k]) * (3 << 20) for k in range(9)] + [b"", b"z" * (9 << 20), b"y"]
    batch = pa.record_batch({"doc_id": range(len(texts)), "z": [zstandard.compress(t) for t in texts], "cuts": pa.nulls(len(texts)), "carried": [{"_": k} for k in range(len(texts))]})
    found = list(_apply(True)(iter([batch])))
    assert max(b.column("n_bytes").to_numpy().sum() for b in found) <= max(SLICE_BYTES, 9 << 20)
    assert [(x["doc_id"], x["text"].encode(), x["carried"]["_"]) for b in found for x in b.to_pylist()] == [(k, t, k) for k, t in enumerate(texts)]


def test_contexts_of_a_hash_range_are_sorted_in_bounded_memory():
    import tracemalloc

    import pyarrow as pa

    from ortholake.llm.suffix_dedup import _CONTEXTS, _pack, _radix

    r, n, size = np.random.default_rng(3), 150_000, 62
    data = r.integers(97, 123, (n, size), np.uint8)
    key = np.arange(n, dtype=np.uint64)
    key[1::1000], data[1::1000] = key[::1000], data[::1000]  # text 2 k + 1 repeats some of what 2 k has
    column = {"keys": key, "docs": np.arange(n), "hashes": np.zeros(n, np.int64), "places": np.full(n, 7, np.int32), "sizes": np.full(n, size - 50, np.uint8), "data": data.ravel()}
    table = pa.Table.from_pylist([{"part": 0, **{c: _pack(x) for c, x in column.items()}}], schema=_CONTEXTS)
    tracemalloc.start()
    found = _radix(50)(table)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["doc_id"].to_pylist() == list(range(1, n, 1000))
    assert peak < 12 * data.size


def test_written_tables_leave_no_shuffle_files(spark):
    from ortholake.llm._store import materialize

    def shuffles():
        return spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").count("shuffle_")

    before = shuffles()
    df = spark.range(1000).selectExpr("id % 7 as k").repartition(5, "k")
    written = materialize(df, "test")
    assert shuffles() <= before and written.count() == 1000


def test_anchors_do_not_depend_on_where_a_window_lies():
    from ortholake.llm.suffix_dedup import find_anchors

    r = random.Random(2)
    passage = prose(5, 60).encode()
    a, b = prose(1, 40).encode() + passage, prose(2, 90).encode() + passage + prose(3, 9).encode()
    found = []
    for text in (a, b):
        key, _, first, span = find_anchors(np.frombuffer(text, np.uint8), np.array([0, len(text)]), 50, 24)
        by_window = {text[w : w + 50]: k for k, f, s in zip(key.tolist(), first.tolist(), span.tolist(), strict=True) for w in range(f, f + s + 1)}
        assert len(by_window) >= len(set(text[k : k + 50] for k in range(len(text) - 49)))
        found.append(by_window)
    assert all(found[0][w] == found[1][w] for w in set(found[0]) & set(found[1])) and len(set(found[0]) & set(found[1])) >= len(passage) - 49
    assert r


# Nearest neighbours


def brute(rows, k=10, every=100):
    """For each query row, in order of ids: (id, [(distance, id), ...])."""
    rows = [(i, np.array(v, float)) for i, v in rows if i is not None and v is not None and len(v) and None not in v]
    rows = [(i, v) for i, v in rows if np.isfinite(v).all() and v.any()]
    matrix, ids = np.stack([v for _, v in rows]), np.array([i for i, _ in rows])
    out = []
    for n, (q, a) in enumerate(rows):
        if q % every == 0:
            d = np.sqrt(((matrix - a) ** 2).sum(1))
            order = [j for j in np.lexsort((ids, d)).tolist() if j != n][:k]
            out.append((q, [(float(d[j]), int(ids[j])) for j in order]))
    return sorted(out, key=lambda x: x[0])


def answers(found):
    """The results of each query id, by rank."""
    got = defaultdict(lambda: defaultdict(list))
    for x in found.collect():
        got[x["query_id"]][x["rank"]].append((x["score"], x["vec_id"]))
    return got


def test_neighbours(spark):
    from ortholake.llm.ann import nearest

    r = np.random.default_rng(3)
    centres = r.normal(size=(12, 24))
    rows = [(i, (centres[i % 12] + 0.4 * r.normal(size=24)).astype(np.float32).tolist()) for i in range(1500)]
    same = centres[0].tolist()
    rows += [(2000 + i, same) for i in range(300)] + [(5000, None), (5100, []), (5200, [0.0] * 24), (None, same), (5300, [float("nan")] * 24), (5400, [1.0] * 3), (5500, [None] * 24)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("h", F.lit("clash")).repartition(4)
    want = brute([(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows if v is None or len(v) != 3])
    for blocks in ({"base_block": 256, "query_block": 8}, {}):
        got = answers(nearest(df, **blocks))
        assert sorted(got) == [q for q, _ in want]
        hit = 0
        for q, near in want:
            own = [x for n in sorted(got[q]) for x in got[q][n]]
            assert sorted(got[q]) == list(range(1, 11)) and own == sorted(own) and all(i != q for _, i in own)
            hit += len({i for _, i in own} & {i for _, i in near})
        assert hit >= 0.9 * 10 * len(want)
        for q in (2000, 2100, 2200):
            assert [got[q][n][0][1] for n in range(1, 11)] == [i for i in range(2000, 2012) if i != q][:10]


def test_neighbours_of_vectors_without_structure(spark):
    from ortholake.llm.ann import learn, nearest, probe

    r = np.random.default_rng(8)
    x = r.normal(size=(8000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    got = answers(nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)))
    want = brute(rows)
    assert sum(len({got[q][n][0] for n in got[q]} & set(near)) for q, near in want) >= 0.9 * 10 * len(want)
    coder = learn(x[:4096], 8000)
    assert np.mean([len(p) for p in probe(coder.codes(x[:50]), coder.codes(x), coder.reach)]) < 0.5 * len(x)


def test_neighbours_of_repeated_rows_and_small_tables(spark):
    from ortholake.llm.ann import nearest

    def table(rows):
        return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)

    r = np.random.default_rng(5)
    others = [(i, r.normal(size=2).tolist()) for i in range(1, 31)]
    for rows in (
        [(100, [1.0, 2.0])] * 12 + others,
        [(100, [1.0, 2.0])] * 3 + [(100, [1.0, 2.5]), (100, [1.0, 2.5]), (200, [1.0, 2.0]), (7, [1.0, 2.0])] + others,
        [(0, [1.0, 0.0]), (100, [0.0, 1.0]), (7, [-0.0, 1.0]), (200, [1.0, 0.0])],
        [(100, [3.0, 1.0])] * 2,
    ):
        got, want = answers(nearest(table(rows))), defaultdict(lambda: defaultdict(list))
        for q, near in brute(rows):
            for n, x in enumerate(near, 1):
                want[q][n].append(x)
        assert {q: {n: sorted(x) for n, x in own.items()} for q, own in got.items()} == {q: {n: sorted(x) for n, x in own.items()} for q, own in want.items()}
    few = table([(7, [0.0, 1.0])])
    assert nearest(few.where("vec_id > 999")).count() == 0
    assert nearest(few).count() == 0
    assert nearest(table([(100, [0.0, 1.0])])).count() == 0


def test_probing_finds_every_code_in_the_radius():
    from ortholake.llm.ann import BITS, probe

    r = np.random.default_rng(1)
    codes = r.integers(0, 2**16, (3000, 4)).astype(np.uint16)
    queries = codes[:20] ^ np.uint16(5)
    for reach in (0, 1, 3, 16):
        for q, rows in zip(queries, probe(queries, codes, reach), strict=True):
            apart = BITS[codes ^ q]
            assert rows.tolist() == np.flatnonzero((apart <= reach).any(1)).tolist()
            assert set(np.flatnonzero(apart.sum(1) < 4 * (reach + 1)).tolist()) <= set(rows.tolist())


# Pipeline


def packed_pieces(rows):
    import zlib
    from collections import Counter

    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    out = Counter()
    for i, t in rows:
        ids = np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        for n, start in enumerate(range(0, len(ids), 2048)):
            out[i, n, start, zlib.crc32(ids[start : start + 2048].tobytes())] += 1
    return out


def brute_pipeline(rows, stages):
    """(id, text) after each of the stages between the first and the last; rows are what the first keeps."""
    rows = [(i, t) for i, t in dedup(rows, least=10) if t]
    stages.append(rows)
    known = [(i, t) for i, t in rows if i]
    first = components(known)
    rows = [(i, t) for i, t in rows if not i or first[i] == i]
    stages.append(rows)
    least, out = {}, []
    for i, t in sorted(((i, t.encode()) for i, t in rows if i), key=lambda x: x[0]):
        for k in range(len(t) - 49):
            least.setdefault(t[k : k + 50], i)
    for i, t in rows:
        data, gone = t.encode(), bytearray(len(t.encode()))
        for k in range(len(data) - 49):
            if i and least[data[k : k + 50]] < i:
                gone[k : k + 50] = b"\1" * 50
        out.append((i, bytes(b for b, g in zip(data, gone, strict=True) if not g).decode(errors="ignore")))
    stages.append([(i, t) for i, t in out if t])
    return stages


def test_pipeline_equals_brute_force(spark, odd, odd_rows, empty, tmp_path):
    """Ids of 0 stand for null ones in the brute-force version."""
    import corpus_pipeline
    from ortholake.llm.quality_rules import quality

    r = random.Random(21)
    passages = [prose(900 + i, 30) for i in range(4)]
    texts = [*near_copies(31, 12, 90, 4), *("\n".join(r.choice([prose(r.randrange(10**6), 14), r.choice(passages), "all rights are reserved here", f"page {r.randrange(9)} of the whole"]) for _ in range(5)) for _ in range(60)), "a b", None, ""]
    made = spark.createDataFrame([(i + 1, t, "en", "s", 1) for i, t in enumerate(texts)], SCHEMA).repartition(3)
    for k, df in enumerate((made, odd.select("doc_id", "text", "lang", "source", "n_chars"))):
        path = str(tmp_path / str(k))
        df.write.parquet(f"{path}/documents.parquet")
        docs = spark.read.parquet(f"{path}/documents.parquet")
        kept = corpus_pipeline.quality_rules(spark, docs, path)
        rows = [(x["doc_id"] or 0, x["text"]) for x in kept.collect()]
        want = [x for x in quality(docs).where("kept").select("doc_id").collect()]
        assert sorted(i for i, _ in rows) == sorted(x["doc_id"] or 0 for x in want) and rows
        stages = brute_pipeline([(i or None, t) for i, t in rows], [])
        for (_, stage), expected in zip(corpus_pipeline.STAGES[1:-1], stages, strict=True):
            kept = stage(spark, kept, path)
            assert kept.columns == docs.columns
            got = kept.collect()
            assert sorted((x["doc_id"] or 0, x["text"]) for x in got) == sorted(expected)
            assert all(x["n_chars"] == len(x["text"]) or stage is corpus_pipeline.ngram_jaccard for x in got)
        pieces = corpus_pipeline.run(spark, path).collect()
        got = defaultdict(int)
        for x in pieces:
            got[x["doc_id"] or 0, x["piece"], x["start"], x["ids_crc32"]] += 1
        assert got == packed_pieces(stages[-1])
    rest = empty
    for _, stage in corpus_pipeline.STAGES:
        rest = stage(spark, rest, "")
    assert rest.count() == 0


def test_near_duplicates_go_and_rows_without_id_stay(spark, odd, odd_rows):
    import corpus_pipeline

    rows = [tuple(r) for r in corpus_pipeline.ngram_jaccard(spark, odd, "").collect()]
    want = components([(r[0], r[1]) for r in odd_rows])
    assert sorted(rows, key=str) == sorted((r for r in odd_rows if r[0] is None or want[r[0]] == r[0]), key=str)
    assert sum(r[0] is None for r in rows) == 2
    unlike = table(spark, [prose(1, 60), prose(2, 60)]).union(table(spark, [prose(1, 60), prose(3, 60)], 1))
    got = corpus_pipeline.ngram_jaccard(spark, unlike, "").collect()
    assert sorted((r["doc_id"], r["text"]) for r in got) == sorted([(0, prose(1, 60)), (1, prose(2, 60)), (1, prose(1, 60)), (2, prose(3, 60))])
