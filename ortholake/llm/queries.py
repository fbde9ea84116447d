"""The queries of this subpackage, each over its whole table, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _vocabulary(name: str) -> str:
    """The place of a public vocabulary file; operators take it as a parameter."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from ortholake.llm.token_counts import histogram, suffix_sums

    return suffix_sums(histogram(_documents(spark, sf_dir), _vocabulary("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ortholake.llm.sentencepiece_codec import decode, encode

    model = _vocabulary("piece_bpe_32k.model")
    coded = encode(_documents(spark, sf_dir), model, best=True)
    best = F.size("best_ids").cast("long").alias("n_best"), "best_crc32", "best_score"
    return decode(coded.select("doc_id", "text", "ids", "ids_crc32", *best), model).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_ids"),
        "ids_crc32",
        "n_best",
        "best_crc32",
        "best_score",
        (F.col("decoded") == F.coalesce("text", F.lit(""))).alias("round_trip"),
    )


def op3_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ortholake.llm.ngram_join import ngram_components

    return ngram_components(_documents(spark, sf_dir), links=True).select("doc_id", "n_shingles", "component_id", "class_id", "class_size", "n_links")


OP3_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), member AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)
), size AS (
  SELECT doc_id, count(*) AS n FROM member GROUP BY doc_id
), pair AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM member a JOIN member b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY ALL
), link AS (
  SELECT a, b, k = x.n AND k = y.n AS same FROM pair JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b
  WHERE 100 * k >= 80 * (x.n + y.n - k)
), linked AS (
  SELECT a AS doc_id, count(*) AS n_links, count(*) FILTER (same) AS n_same, min(b) FILTER (same) AS least FROM link GROUP BY a
), reached AS (
  SELECT doc_id, doc_id AS c FROM documents UNION SELECT link.b, c FROM reached JOIN link ON link.a = reached.doc_id
), component AS (
  SELECT doc_id, min(c) AS c FROM reached GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, c AS component_id, least(d.doc_id, coalesce(least, d.doc_id)) AS class_id,
       CAST(1 + coalesce(n_same, 0) AS BIGINT) AS class_size, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM d JOIN component USING (doc_id) LEFT JOIN size USING (doc_id) LEFT JOIN linked USING (doc_id)
"""


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ortholake.llm.quality_rules import quality

    columns = "doc_id n_words word_chars n_symbols n_dup_lines n_repeat_words base_failed kept failure_bits"
    return quality(_documents(spark, sf_dir)).select(*columns.split())


OP4_SQL = r"""
WITH d AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS l
  FROM documents
), windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM d)
), repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, s) AS c FROM windows) WHERE c > 1
), covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeated, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), m AS (
  SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
         CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars,
         CAST(len(regexp_extract_all(text, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
         CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(c.n, 0) AS BIGINT) AS n_repeat_words,
         len(l) AS n_lines, len(regexp_extract_all(text, '\p{Lu}')) AS n_upper, len(regexp_extract_all(text, '\p{L}')) AS n_letters
  FROM d LEFT JOIN covered c ON c.doc_id = d.doc_id
), b AS (
  SELECT *, CAST(
    CASE WHEN n_words < 10 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 20 * n_words THEN 2 ELSE 0 END
    + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
    + CASE WHEN word_chars < 2 * n_words OR word_chars > 12 * n_words THEN 8 ELSE 0 END
    + CASE WHEN 100 * n_dup_lines > 50 * n_lines THEN 16 ELSE 0 END
    + CASE WHEN 100 * n_upper > 60 * n_letters THEN 32 ELSE 0 END
    + CASE WHEN 10 * n_letters < 4 * word_chars THEN 64 ELSE 0 END AS BIGINT) AS failure_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failure_bits & 3 <> 0 AS base_failed, failure_bits = 0 AS kept, failure_bits FROM b
"""


def op5_ppm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ortholake.llm.ppm import lm_scores

    return lm_scores(_documents(spark, sf_dir))


def op6_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ortholake.llm.language_id import language_ids

    return language_ids(_documents(spark, sf_dir))


def op7_multi_index_hashing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ortholake.llm.ann import nearest

    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ortholake.llm.suffix_dedup import remove_repeats

    return remove_repeats(_documents(spark, sf_dir)).drop("starts", "ends")


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, CAST(len(hex(encode(coalesce(text, '')))) // 2 AS BIGINT) AS n FROM documents
), place AS (
  SELECT doc_id, c + i AS i, substr(y, 2 * i + 1, 100) AS s
  FROM (SELECT doc_id, c, y, unnest(range(least(500, n - 49 - c))) AS i FROM (
    SELECT doc_id, n, c, substr(x, 2 * c + 1, 1098) AS y FROM (SELECT *, unnest(range(0, n - 49, 500)) AS c FROM d WHERE n >= 50)))
), first AS (
  SELECT s, min(doc_id) AS least FROM place GROUP BY s HAVING min(doc_id) < max(doc_id)
), hit AS (
  SELECT doc_id, i FROM place JOIN first USING (s) WHERE doc_id > least
), begun AS (
  SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM hit
), run AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM begun
), span AS (
  SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM run GROUP BY doc_id, r
), cut AS (
  SELECT doc_id, count(*) AS k, sum(b - a) AS gone, list_concat([0], list(b ORDER BY a)) AS after, list(a ORDER BY a) AS before FROM span GROUP BY doc_id
)
SELECT doc_id, n AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, CAST(coalesce(k, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN k IS NULL THEN x ELSE array_to_string(list_transform(range(1, k + 2),
         lambda j: substr(x, 2 * after[j] + 1, 2 * (coalesce(before[j], n) - after[j]))), '') END)) AS kept_sha256
FROM d LEFT JOIN cut USING (doc_id)
"""


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ortholake.llm.line_dedup import dedup_lines

    kept = dedup_lines(_documents(spark, sf_dir))
    return kept.select(
        "doc_id", F.col("n_lines").cast("long").alias("n_lines"), F.col("n_dropped").cast("long").alias("n_dropped"), F.sha2("text", 256).alias("kept_sha256")
    )


OP9_SQL = r"""
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
occurrence AS (
  SELECT doc_id, i, line FROM (SELECT doc_id, unnest(l) AS line, unnest(range(len(l))) AS i FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), line AS (
  SELECT line, min({'d': doc_id, 'i': i}) AS place, len(line) AS n FROM occurrence GROUP BY line
), half AS (
  SELECT line, place, n, h, unnest([{'side': 0, 'part': left(line, h)}, {'side': 1, 'part': right(line, h)}]) AS k
  FROM (SELECT *, unnest(list_distinct([n // 2, (n - 1) // 2])) AS h FROM line)
), pair AS (
  SELECT DISTINCT a.line AS a, b.line AS b, a.n AS n
  FROM half a JOIN half b ON a.h = b.h AND a.k = b.k AND b.place < a.place AND abs(a.n - b.n) <= 1
), common AS (
  SELECT a, b, least(len(a), len(b)) AS low, greatest(len(a), len(b)) AS high,
         list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: a[i] <> b[i] OR i > least(len(a), len(b))), true) - 1 AS head,
         list_position(list_transform(range(1, greatest(len(a), len(b)) + 1), lambda i: a[-i] <> b[-i] OR i > least(len(a), len(b))), true) - 1 AS tail
  FROM pair
), near AS (
  SELECT DISTINCT a AS line FROM common WHERE head + tail >= high - 1
), gone AS (
  SELECT o.doc_id, o.i FROM occurrence o JOIN line USING (line) LEFT JOIN near ON near.line = o.line
  WHERE near.line IS NOT NULL OR place <> {'d': o.doc_id, 'i': o.i}
), dropped AS (
  SELECT doc_id, list(i) AS g FROM gone GROUP BY doc_id
)
SELECT d.doc_id, CAST(coalesce(len(l), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(g), 0) AS BIGINT) AS n_dropped,
       sha256(CASE WHEN g IS NULL THEN text ELSE coalesce(array_to_string(
         list_transform(list_filter(range(len(l)), lambda i: NOT list_contains(g, i)), lambda i: l[i + 1]), chr(10)), '') END) AS kept_sha256
FROM d LEFT JOIN dropped ON dropped.doc_id = d.doc_id
"""


def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ortholake.llm.packing import pack

    return pack(_documents(spark, sf_dir), _vocabulary("word_bpe_49k.json"), capacity=2048, end_id=0)


def queries() -> dict[str, Query]:
    """Each of the ten operators by its query."""
    every = (
        op1_token_counts,
        op2_sentencepiece,
        op3_ngram_jaccard_join,
        op4_quality_rules,
        op5_ppm_scoring,
        op6_language_id,
        op7_multi_index_hashing,
        op8_suffix_dedup,
        op9_line_dedup,
        op10_best_fit_packing,
    )
    return {f.__name__: f for f in every}


def oracle_sql() -> dict[str, str]:
    """DuckDB SQL for the rows of the queries that SQL can express."""
    return {"op3_ngram_jaccard_join": OP3_SQL, "op4_quality_rules": OP4_SQL, "op8_suffix_dedup": OP8_SQL, "op9_line_dedup": OP9_SQL}
