"""Token counts, SentencePiece, quality rules, language-model scores, languages and packing."""

import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def rows_of(df):
    return [r.asDict() for r in df.collect()]


# Token counts


def lengths(texts):
    from ortholake.llm.token_counts import _encoding

    encode = _encoding(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN).encode_ordinary
    return [len(encode(t or "")) for t in texts]


def test_token_counts(documents, odd, odd_rows, empty):
    from ortholake.llm import token_counts as tc

    vocabulary = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    for df, texts in ((documents, [r["text"] for r in documents.collect()]), (odd, [r[1] for r in odd_rows])):
        want = lengths(texts)
        hist = tc.histogram(df, *vocabulary)
        assert {r["n_tokens"]: r["n_docs"] for r in hist.collect()} == Counter(want)
        sums = tc.suffix_sums(hist)
        for r in sums.collect():
            limit = r["n_tokens"]
            assert r["tokens_kept"] == sum(min(n, limit) for n in want) and r["tokens_lost"] == sum(want) - r["tokens_kept"]
            assert r["docs_longer"] == sum(n > limit for n in want) and r["docs_fitting"] == len(want) - r["docs_longer"]
            assert r["tokens_longer"] == sum(n for n in want if n > limit) and r["tokens_total"] == sum(want)
        shares = {r["share"]: r["n_tokens"] for r in tc.quantiles(sums, [0.1, 0.5, 1.0]).collect()}
        assert shares == {q: sorted(want)[math.ceil(q * len(want)) - 1] for q in (0.1, 0.5, 1.0)}
        cut = {r["context"]: r["tokens_kept"] for r in tc.truncated_totals(hist, [0, 100, 10**6]).collect()}
        assert cut == {c: sum(min(n, c) for n in want) for c in cut}
    assert tc.suffix_sums(tc.histogram(empty, *vocabulary)).count() == 0
    assert tc.truncated_totals(tc.histogram(empty, *vocabulary), [5]).first()["tokens_kept"] == 0


# SentencePiece


def test_sentencepiece_is_what_merging_gives():
    import sentencepiece

    from ortholake.llm.sentencepiece_codec import Codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, other = Codec.load(path), sentencepiece.SentencePieceProcessor(model_file=path)
    r = random.Random(3)
    letters = " ab\n\tZé▁漢字🙂ther,.  09́ing"
    texts = ["".join(r.choice(letters) for _ in range(r.randrange(0, 40))) for _ in range(3000)] + ["", "  ", "a" * 5000, " " * 777, "<s>", "<0x41>"]
    ids, at = codec.encode(texts)
    for k, text in enumerate(texts):
        own = ids[at[k] : at[k + 1]].tolist()
        assert own == other.encode(text), text[:80]
        assert codec.decode(own) == other.decode(own), text[:80]


def best_score(word, score, unknown):
    best = [0.0] + [-math.inf] * len(word)
    for end in range(1, len(word) + 1):
        for start in range(end):
            piece = word[start:end]
            s = score.get(piece, unknown if end - start == 1 else -math.inf)
            best[end] = max(best[end], best[start] + s)
    return best[-1]


def test_unigram_segmentation_is_the_best_of_all():
    from ortholake.llm.sentencepiece_codec import BYTE, NORMAL, UNIGRAM, UNKNOWN, Codec

    r = random.Random(5)
    pieces = {"".join(r.choice("abc") for _ in range(r.randrange(1, 5))): -r.uniform(1, 9) for _ in range(30)}
    pieces.pop("c", None)
    table = [("<unk>", 0.0, UNKNOWN), *((f"<0x{b:02X}>", 0.0, BYTE) for b in range(256)), *((p, s, NORMAL) for p, s in pieces.items())]
    codec = Codec(table, UNIGRAM, add_prefix=False)
    unknown = min(pieces.values()) - 10
    for _ in range(400):
        word = "".join(r.choice("abcd") for _ in range(r.randrange(1, 14)))
        found = codec.segment(word)
        assert "".join(found) == word
        assert math.isclose(sum(pieces.get(p, unknown) for p in found), best_score(word, pieces, unknown), abs_tol=1e-9)
        ids, _ = codec.encode([word])
        assert codec.decode(ids.tolist()) == word


def test_best_segmentation_of_a_model_by_merges():
    from ortholake.llm.sentencepiece_codec import SPACE, Codec

    path = public_tokenizers.path("piece_bpe_32k.model")
    codec, merging = Codec.load(path, True), Codec.load(path)
    r = random.Random(11)
    words = "there is another thing undecided, aaaa  bababa 漢字🙂 interesting\n misunderstandings 1009".split(" ")
    texts = [" ".join(r.choice(words)[: r.randrange(1, 30)] for _ in range(r.randrange(0, 9))) for _ in range(300)] + ["", "x" * 3000]
    (both, both_at), (ids, at) = codec.encode_both(texts)
    own, own_at = merging.encode(texts)
    assert both.tolist() == own.tolist() and both_at.tolist() == own_at.tolist()
    differ = 0
    for k, text in enumerate(texts):
        some, merged = ids[at[k] : at[k + 1]], own[own_at[k] : own_at[k + 1]]
        assert codec.decode(some.tolist()) == text
        differ += some.tolist() != merged.tolist()
        if len(text) < 300 and len(set(some.tolist()) & set(codec.byte_ids)) == 0:
            assert codec.scores[some].sum() == best_score(SPACE + text.replace(" ", SPACE) if text else "", codec.score, codec.least - 10)
            assert codec.scores[some].sum() >= codec.scores[merged].sum()
    assert differ


def test_sentencepiece_tables(spark, odd, empty):
    from ortholake.llm.sentencepiece_codec import decode, encode

    path = public_tokenizers.path("piece_bpe_32k.model")
    rows = rows_of(decode(encode(odd, path), path))
    assert len(rows) == 17
    for r in rows:
        assert r["decoded"] == (r["text"] or "").replace("▁", " ")
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
    assert decode(encode(empty, path), path).count() == 0 and encode(empty, path, best=True).count() == 0
    best = rows_of(encode(odd, path, best=True))
    assert sorted((str(r["doc_id"]), r["ids_crc32"]) for r in best) == sorted((str(r["doc_id"]), r["ids_crc32"]) for r in rows)
    assert all(r["best_crc32"] == zlib.crc32(np.array(r["best_ids"], "<u4").tobytes()) for r in best)
    assert all((r["best_score"] == 0 and not r["best_ids"]) for r in best if not r["text"])
    given = spark.createDataFrame([(None,), ([],), ([None, 10**6, 300],)], "ids array<int>")
    assert [r["decoded"] for r in decode(given, path).collect()][:2] == ["", ""]


# Quality rules


def measure(text):
    words = WORD.findall(text.encode())
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    seen = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x.encode())]
    return len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(documents, odd, empty):
    from ortholake.llm import quality_rules as q

    for df in (documents, odd):
        texts = sorted((r["doc_id"] or 0, r["text"] or "") for r in df.collect())
        want = sorted((i, *measure(t)) for i, t in texts)
        book = q.quality(df)
        rows = rows_of(book)
        columns = "n_words word_chars n_symbols n_dup_lines n_repeat_words".split()
        assert sorted((r["doc_id"] or 0, *(r[c] for c in columns)) for r in rows) == want
        for r in rows:
            assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"])
            assert r["kept"] == (r["failure_bits"] == 0)
        report = {r["rule"]: r for r in q.ablations(q.ledger(df)).collect()}
        for name, bit in q.BITS.items():
            assert report[name]["n_failed"] == sum(bool(r["failure_bits"] & bit) for r in rows)
            assert report[name]["n_only"] == sum(r["failure_bits"] == bit for r in rows)
        kept = q.kept_documents(df)
        assert kept.columns == df.columns and kept.count() == sum(r["kept"] for r in rows)
        plan = book._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and (df is odd or "Exchange" not in plan)
    assert q.quality(empty).count() == 0 and q.ablations(q.ledger(empty)).count() == len(q.RULES)


# Language-model scores


def test_a_cache_of_words_grows_in_bounded_memory():
    import tracemalloc

    from ortholake.llm._text import WordCache

    some = [(np.arange(k, n, 2, dtype=np.uint64), np.zeros((n - k + 1) // 2, np.uint32), np.arange(k, n, 2)) for k, n in ((0, 1_000_000), (1, 250_001))]
    tracemalloc.start()
    keys, checks, numbers = WordCache._merged(*some)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (np.diff(keys.astype(np.int64)) > 0).all() and (keys == numbers).all() and len(checks) == len(keys)
    assert peak < 44 * len(keys), peak / len(keys)


def test_ppm_slices_are_sent_in_bounded_memory(monkeypatch):
    import tracemalloc
    from types import SimpleNamespace

    from ortholake.llm import ppm
    from tests.llm.conftest import prose

    monkeypatch.setattr(ppm, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    hot = SimpleNamespace(value={k: np.zeros(0, np.uint64) for k in range(3, 6)})
    texts = [prose(k, 30_000) for k in range(36)]
    size = sum(map(len, texts))
    batch = pa.record_batch({"doc_id": range(len(texts)), "text": texts, "held_out": [False] * len(texts)})
    assert 5_000_000 < size < ppm.SENT_BYTES
    tracemalloc.start()
    rows = [r for b in ppm._send(6, 64, hot)(iter([batch])) for r in b.to_pylist()]
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(ppm.unpack_counts(r["b"]).sum() for r in rows if r["kind"] == 3) == size + len(texts)
    assert peak < 18 * size, peak / size


def test_ppm(spark, documents, odd, empty):
    from ortholake.llm import ppm

    for df in (documents, odd):
        texts = [(r["doc_id"], (r["text"] or "").encode().lower()) for r in df.collect()]
        held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in texts]
        counts = Counter(w for (_, t), h in zip(texts, held, strict=True) if not h for w in [*WORD.findall(t), None])
        total, distinct = sum(counts.values()), len(counts)
        want = sorted(
            (i or 0, h, len(WORD.findall(t)) + 1, sum(counts[w] > 0 for w in [*WORD.findall(t), None]), total, round(sum(math.log10((counts[w] + 1) / (total + distinct + 1)) for w in [*WORD.findall(t), None]), 6))
            for (i, t), h in zip(texts, held, strict=True)
        )
        rows = rows_of(ppm.lm_scores(df))
        assert sorted((r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in rows) == want
        assert all(r["score"] < 0 for r in rows)
    assert ppm.lm_scores(empty).count() == 0
    alike = rows_of(ppm.lm_scores(documents.where("crc32(cast(doc_id as string)) % 7 = 2")))
    for r in alike:
        assert math.isclose(r["score"], -math.log10(256) * (len(documents.where(f"doc_id = {r['doc_id']}").first()["text"].encode()) + 1))
        break


def followers(framed, order):
    """For each depth: context -> byte -> count."""
    seen = [{} for _ in range(order + 1)]
    for f in framed:
        for q in range(order, len(f)):
            for k in range(order + 1):
                own = seen[k].setdefault(f[q - k : q], {})
                own[f[q]] = own.get(f[q], 0) + 1
    return seen


def ppm_log10(seen, order, history, symbol):
    out, total = set(), 0.0
    for k in range(order, -1, -1):
        own = seen[k].get(history[len(history) - k :])
        if own is None:
            out = set()
            continue
        new = max(len(own) - len(out), 0.5)
        base = sum(own.values()) - sum(own[x] for x in out) + new
        if symbol in own and symbol not in out:
            return total + math.log10(own[symbol] / base)
        total += math.log10(new / base)
        out = set(own)
    return total - math.log10(256 - len(out))


@pytest.mark.parametrize("order", [1, 3, 5])
def test_ppm_trie_is_the_naive_one(order):
    from ortholake.llm import ppm

    r = random.Random(4)
    docs = [bytes(r.choice(b"abcd ") for _ in range(r.randrange(0, 60))) for _ in range(40)]
    seen = followers([b"\xff" * order + d + b"\xff" for d in docs], order)
    nodes = []
    for own in seen:
        grams = sorted((int.from_bytes(c + bytes([x]), "big"), n) for c, after in own.items() for x, n in after.items())
        nodes.append((np.array([g for g, _ in grams], np.uint64), np.array([n for _, n in grams])))
    trie = ppm.Trie(nodes)
    for _ in range(60):
        f = b"\xff" * order + r.choice(docs) + b"\xff"
        q = r.randrange(order, len(f))
        history = f[q - order : q] if r.random() < 0.7 else bytes(r.choice(b"abxy") for _ in range(order))
        scores = trie.score(np.array([int.from_bytes(history + bytes([b]), "big") for b in range(256)], np.uint64))
        assert math.isclose((10**scores).sum(), 1, abs_tol=1e-9)
        for x in (f[q], ord("d"), 7):
            assert math.isclose(scores[x], ppm_log10(seen, order, history, x), abs_tol=1e-9)


@pytest.mark.parametrize(("order", "share"), [(4, 2000), (6, 200), (6, 1000), (2, 2000)])
def test_ppm_scores_use_every_gram(spark, order, share):
    from ortholake.llm import ppm

    r = random.Random(5)
    rare = "qzxjkvw qjzkxv"
    texts = ["".join(r.choice("ab cd") for _ in range(20_000)) for _ in range(30)] + [rare] * 3
    rows = list(enumerate(texts)) + [(1000 + i, rare + r.choice(" ab") * (i % 9) + "cab dab cqb") for i in range(30)]
    rows = [(i, t) for i, t in rows if i < 1000 or zlib.crc32(str(i).encode()) % 7 == 2] + [(63, ""), (64, "é漢 A")]
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in rows}
    assert sum(not held[i] for i, t in rows if t == rare) in (1, 2, 3) and any(i >= 1000 for i, _ in rows)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: x["score"] for x in ppm.lm_scores(df, order, hot_share=share).collect()}
    framed = {i: b"\xff" * order + t.lower().encode() + b"\xff" for i, t in rows}
    seen = followers([f for i, f in framed.items() if not held[i]], order)
    for i, f in framed.items():
        if len(f) < 1000:
            assert math.isclose(got[i], sum(ppm_log10(seen, order, f[q - order : q], f[q]) for q in range(order, len(f))), abs_tol=1e-9), i
    if order == 6:
        hot = ppm.frequent_contexts(df, order, share)
        assert len(hot[3]) and (share == 200 or len(hot[4]))


def test_counts_are_packed():
    from ortholake.llm.ppm import pack_counts, unpack_counts

    for x in ([], [0], [254, 255, 256, 10**12, 0, 3], list(range(1000))):
        assert unpack_counts(pack_counts(np.array(x, np.int64))).tolist() == x


# Languages


def test_languages(documents, odd, empty):
    from ortholake.llm import language_id as li

    truth = {r["doc_id"]: r["lang"] for r in documents.collect()}
    rows = rows_of(li.language_ids(documents))
    held = [r for r in rows if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in rows) and held
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.95 * len(held)
    assert all(0 <= r["score"] <= 1 for r in rows)
    swapped = documents.selectExpr("doc_id", "text", "case when crc32(cast(doc_id as string)) % 4 = 2 then 'xx' else lang end as lang", "source")
    assert {r["doc_id"]: r["lang_pred"] for r in rows_of(li.language_ids(swapped))} == {r["doc_id"]: r["lang_pred"] for r in rows}
    rows = rows_of(li.language_ids(odd))
    assert len(rows) == 17 and {r["lang_pred"] for r in rows if r["doc_id"] in (3, 4, 9)} == {"und"}
    assert li.language_ids(empty).count() == 0
    assert {r["lang_pred"] for r in rows_of(li.language_ids(odd.drop("lang").selectExpr("*", "cast(null as string) as lang")))} == {"und"}


def naive_ecoc(rows, held, codes, log2=16, sharpness=4.0):
    """(language, score) of every text, gram by gram; rows: (lang, text)."""

    def hashed(text):
        data = text.lower().encode()
        for n in (1, 2, 3, 4):
            for i in range(len(data) - n + 1):
                code = int.from_bytes(data[i : i + n], "big") ^ (n * 0x3C6EF372 & 0xFFFFFFFF)
                yield (code * 0x9E3779B1 & 0xFFFFFFFF) >> (32 - log2)

    names = sorted({x for (x, _), h in zip(rows, held, strict=True) if x is not None and not h})
    counts = {x: Counter() for x in names}
    for (x, t), h in zip(rows, held, strict=True):
        if x is not None and not h:
            counts[x].update(hashed(t or ""))
    size = 1 << log2
    shares = [lambda g, c=counts[x], n=sum(counts[x].values()): (c[g] + 0.5) / (n + 0.5 * size) for x in names]

    def margin(t, b):
        total = n = 0
        for g in hashed(t):
            yes = [s(g) for s, c in zip(shares, codes, strict=True) if c[b] == 1]
            no = [s(g) for s, c in zip(shares, codes, strict=True) if c[b] == -1]
            total += math.log(sum(yes) / len(yes)) - math.log(sum(no) / len(no)) if yes and no else (1 if yes else -1)
            n += 1
        return total / max(n, 1)

    for _, t in rows:
        if not any(c.isalpha() for c in t or ""):
            yield "und", 0.0
            continue
        margins = [margin(t, b) for b in range(len(codes[0]))]
        loss = [sum(math.log1p(math.exp(-sharpness * m * c)) for m, c in zip(margins, code, strict=True)) / len(margins) for code in codes]
        yield names[loss.index(min(loss))], 1 / sum(math.exp(4 * (min(loss) - x)) for x in loss)


def test_languages_equal_a_naive_decoder(spark):
    from ortholake.llm import language_id as li

    r = random.Random(2)
    alphabets = {"aa": "abcde ", "bb": "cdefg ", "cc": "efghé ", "dd": "xyzab "}
    rows = [(i if i % 9 else None, x, "".join(r.choice(alphabets[x]) for _ in range(r.randrange(0, 40)))) for i in range(60) for x in [r.choice(sorted(alphabets))]]
    rows += [(700, "aa", "abacus badge")] * 40 + [(700, "bb", "egg fed"), (701, None, "cede"), (702, "cc", None)]
    held = [i is not None and zlib.crc32(str(i).encode()) % 4 == 2 for i, *_ in rows]
    want = list(naive_ecoc([(x, t) for _, x, t in rows], held, li.codewords(4)))
    assert len({x for x, _ in want}) == 5 and not held[rows.index((700, "bb", "egg fed"))]
    df = spark.createDataFrame([(i, x, t) for i, x, t in rows], "doc_id long, lang string, text string").repartition(3)
    got = sorted((str(x["doc_id"]), x["lang_pred"], round(x["score"], 4)) for x in li.language_ids(df).collect())
    assert got == sorted((str(i), x, round(score, 4)) for (i, *_), (x, score) in zip(rows, want, strict=True))


def test_sample_of_languages_is_bounded(spark):
    from pyspark.sql import functions as F

    from ortholake.llm import language_id as li

    rows = [(i, "aa", f"text {i}") for i in range(900)] + [(-1, "aa", "often")] * 300 + [(i, "bb", "x") for i in range(7)]
    known = spark.createDataFrame(rows, "doc_id long, lang string, text string").select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    for most in (5, 100, 2000):
        got = li._sample(known, {"aa": 1200, "bb": 7}, most).collect()
        own = {r["text"]: r["n"] for r in got if r["lang"] == "aa"}
        assert len(own) == min(most, 901) and own.get("often", 300) == 300 and sum(r["lang"] == "bb" for r in got) == min(most, 7)


def test_many_languages(spark):
    from ortholake.llm import language_id as li

    rows = [(i, f"l{i % 600:03}", f"{chr(0x4E00 + i % 600)} {chr(0x5E00 + i % 600)} word") for i in range(1800)]
    got = li.language_ids(spark.createDataFrame(rows, "doc_id long, lang string, text string")).collect()
    assert sum(x["lang_pred"] == f"l{x['doc_id'] % 600:03}" for x in got) > 0.5 * len(rows)


def test_codewords_are_apart():
    from ortholake.llm.language_id import codewords

    for n in (1, 2, 4, 6, 7, 20, 100):
        codes = codewords(n)
        assert len({tuple(c) for c in codes.tolist()}) == n
    apart = (codewords(20)[:, None] != codewords(20)[None]).sum(2)
    assert apart[~np.eye(20, dtype=bool)].min() >= 15


# Packing


@pytest.mark.parametrize("seed", range(40))
def test_best_fit_is_what_one_item_at_a_time_gives(seed):
    from ortholake.llm.packing import best_fit_runs

    r = random.Random(seed)
    capacity = r.choice([5, 16, 31, 64])
    counts = {n: r.choice([0, 1, 2, 3, 7, 20]) for n in range(1, capacity + 1) if r.random() < 0.6}
    bins: dict[int, list] = {}
    for length, _, items, each, first, offset in best_fit_runs(counts, capacity):
        for i in range(items):
            bins.setdefault(first + i // each, []).append((offset + i % each * length, length))
    rooms = []
    for n in sorted(counts, reverse=True):
        for _ in range(counts[n]):
            if fits := [x for x in rooms if x >= n]:
                rooms.remove(min(fits))
                rooms.append(min(fits) - n)
            else:
                rooms.append(capacity - n)
    for own in bins.values():
        own.sort()
        assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist()
    assert sorted(capacity - sum(n for _, n in own) for own in bins.values()) == sorted(rooms)
    assert Counter(n for own in bins.values() for _, n in own) == Counter({n: c for n, c in counts.items() if c})


def test_packing(documents, odd, empty):
    from tokenizers import Tokenizer

    from ortholake.llm.packing import pack

    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    for df, capacity in ((documents, 2048), (odd, 64)):
        want = Counter()
        for r in df.collect():
            ids = np.array([*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 0], "<u4")
            for n, start in enumerate(range(0, len(ids), capacity)):
                part = ids[start : start + capacity]
                want[r["doc_id"], n, start, len(part), zlib.crc32(part.tobytes())] += 1
        rows = rows_of(pack(df, path, capacity))
        assert Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
        places: dict[int, list] = {}
        for r in rows:
            places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        for own in places.values():
            own.sort()
            assert [o for o, _ in own] == np.cumsum([0, *(n for _, n in own)])[:-1].tolist() and sum(n for _, n in own) <= capacity
        assert len(places) <= 1.03 * sum(r["length"] for r in rows) / capacity + 2
    assert pack(empty, path).count() == 0


def test_tokenizers_that_join_words_get_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    from ortholake.llm._text import WordIds

    assert WordIds(public_tokenizers.path("word_bpe_49k.json")).apart
    letters = sorted(pre_tokenizers.ByteLevel.alphabet())
    vocab = {x: i for i, x in enumerate([*letters, "Ġa", "Ġb"])}
    other = Tokenizer(models.BPE(vocab, [("Ġ", "a"), ("Ġ", "b")]))
    other.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False)
    other.save(str(tmp_path / "t.json"))
    words = WordIds(str(tmp_path / "t.json"))
    texts = ["a b  c\na", "", " b", "é a"]
    ids, at = words.encode(pa.array(texts, pa.large_string()))
    assert not words.apart and [ids[i:j].tolist() for i, j in zip(at[:-1], at[1:], strict=True)] == [other.encode(t).ids for t in texts]


def test_words_are_found_as_bytes_part_them():
    from ortholake.llm._text import slices, split_words

    texts = ["", " a\x0bb\x0c\x1cc d\n", "x", "\t\t", "a  b"]
    words, at, dictionary = split_words(pa.array(texts, pa.large_string()))
    found = [[dictionary[w].as_py() for w in words[a:b]] for a, b in zip(at[:-1], at[1:], strict=True)]
    assert found == [[w.decode() for w in WORD.findall(t.encode())] for t in texts]
    assert list(slices(pa.array(["aaa", "b", "", "cc"], pa.large_string()), 3)) == [(0, 1), (1, 4)]
