"""Quality rules as a bitmask ledger.

Every rule is evaluated once per document. The ledger keeps the measurements and one ``failure_bits`` value in which
bit *i* says that rule *i* failed. Policies are versioned masks over those bits, so a new policy, or the question what
one rule costs, is a bitwise expression over the ledger and never reads the texts again.

Everything is a narrow projection of built-in functions: no shuffle, no Python, nothing that meets in one task.

Defined results: a null or empty text has no words and fails ``too_few_words``; a null id stays null; repeated rows
each get their own row; an empty table gives an empty ledger; other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bytes that part words; everything else belongs to a word.
WORD_BREAK = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"
WINDOW = 5

#: Rule names in the order of their bits, with the condition under which a document fails, over the measurements.
RULES: dict[str, Callable[[Column], Column]] = {
    "too_few_words": lambda m: m["n_words"] < 10,
    "repeated_windows": lambda m: 100 * m["n_repeat_words"] > 20 * m["n_words"],
    "symbols": lambda m: 10 * m["n_symbols"] > m["n_words"],
    "word_length": lambda m: (m["word_chars"] < 2 * m["n_words"]) | (m["word_chars"] > 12 * m["n_words"]),
    "repeated_lines": lambda m: 100 * m["n_dup_lines"] > 50 * m["n_lines"],
    "upper_case": lambda m: 100 * m["n_upper"] > 60 * m["n_letters"],
    "few_letters": lambda m: 10 * m["n_letters"] < 4 * m["word_chars"],
}
BITS: dict[str, int] = {name: 1 << i for i, name in enumerate(RULES)}

#: Versioned policies: the rules that reject a document.
POLICIES: dict[str, tuple[str, ...]] = {
    "base": ("too_few_words", "repeated_windows"),
    "v1": tuple(RULES),
}


def policy_mask(policy: str | tuple[str, ...]) -> int:
    """The mask of a named policy or of the rules given."""
    return sum(BITS[rule] for rule in (POLICIES[policy] if isinstance(policy, str) else policy))


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` over ``value``, which is computed once instead of at every mention."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash is found twice or more, from the hashes in order."""

    def positions(ordered: Column) -> Column:
        repeated = F.filter(
            ordered,
            lambda e, i: F.get(ordered, i - 1)["h"].eqNullSafe(e["h"]) | F.get(ordered, i + 1)["h"].eqNullSafe(e["h"]),
        )
        return F.sort_array(F.transform(repeated, lambda e: e["p"]))

    def words(at: Column) -> Column:
        steps = F.zip_with(at, F.slice(at, 2, F.size(at)), lambda p, q: F.least(F.lit(WINDOW), F.coalesce(q - p, F.lit(WINDOW))))
        return F.aggregate(steps, F.lit(0).cast("long"), lambda total, step: total + step)

    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("p"))))
    return _let(_let(ordered, positions), words)


def _repeat_words(words: Column) -> Column:
    """Words that lie in five-word windows found at least twice; sorting is only paid for by texts that have one."""

    def windows(h: Column) -> Column:
        return F.when(
            F.size(h) > WINDOW,
            F.transform(F.sequence(F.lit(0), F.size(h) - WINDOW), lambda i: F.xxhash64(*(F.get(h, i + k) for k in range(WINDOW)))),
        ).otherwise(F.array().cast("array<bigint>"))

    def count(w: Column) -> Column:
        return F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0).cast("long")).otherwise(_covered(w))

    return _let(_let(F.transform(words, lambda w: F.xxhash64(w)), windows), count)


def measures(text: Column) -> Column:
    """A struct of all measurements of a text."""

    def of_words(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("long").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("long"), lambda total, w: total + F.char_length(w)).alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"),
        )

    def of_lines(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("long").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
        )

    def flat(m: Column) -> Column:
        words = [m["w"][c].alias(c) for c in ("n_words", "word_chars", "n_repeat_words")]
        return F.struct(*words, *(m["l"][c].alias(c) for c in ("n_lines", "n_dup_lines")), *(m[c].alias(c) for c in ("n_symbols", "n_upper", "n_letters")))

    text = F.coalesce(text, F.lit(""))
    words = F.filter(F.split(text, WORD_BREAK), lambda w: w != "")
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    counts = [F.regexp_count(text, F.lit(p)).cast("long").alias(c) for c, p in (("n_symbols", SYMBOLS), ("n_upper", r"\p{Lu}"), ("n_letters", r"\p{L}"))]
    return _let(F.struct(_let(words, of_words).alias("w"), _let(lines, of_lines).alias("l"), *counts), flat)


def failure_bits(m: Column) -> Column:
    """The bits of the rules that fail, from the measurements."""
    bits = F.lit(0).cast("long")
    for name, fails in RULES.items():
        bits = bits.bitwiseOR(F.when(fails(m), F.lit(BITS[name]).cast("long")).otherwise(F.lit(0).cast("long")))
    return bits


def ledger(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: the id, the measurements and ``failure_bits``."""
    measured = df.select(F.col(id_col).alias("doc_id"), measures(F.col(text_col)).alias("m"))
    return measured.select("doc_id", "m.*", failure_bits(F.col("m")).alias("failure_bits"))


def kept_documents(df: DataFrame, policy: str | tuple[str, ...] = "v1", text_col: str = "text") -> DataFrame:
    """The rows of ``df``, with all of its columns, that no rule of the policy rejects."""
    return df.where(_let(measures(F.col(text_col)), lambda m: failure_bits(m).bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0))


def apply_policy(book: DataFrame, policy: str | tuple[str, ...] = "v1", out: str = "kept") -> DataFrame:
    """Add ``out``: whether no rule of the policy failed."""
    return book.withColumn(out, F.col("failure_bits").bitwiseAND(F.lit(policy_mask(policy)).cast("long")) == 0)


def ablations(book: DataFrame, policy: str | tuple[str, ...] = "v1") -> DataFrame:
    """One row per rule of the policy: documents that fail it, and documents that only it rejects.

    A single aggregation over the bits; its result has as many rows as the policy has rules.
    """
    names = POLICIES[policy] if isinstance(policy, str) else policy
    failed = F.col("failure_bits").bitwiseAND(F.lit(policy_mask(names)).cast("long"))
    sums = [
        F.struct(
            F.lit(name).alias("rule"),
            F.count_if(failed.bitwiseAND(F.lit(BITS[name]).cast("long")) != 0).alias("n_failed"),
            F.count_if(failed == BITS[name]).alias("n_only"),
        )
        for name in names
    ]
    one = book.agg(F.count_if(failed == 0).alias("n_kept"), F.array(*sums).alias("rules"))
    return one.select("n_kept", F.inline("rules"))


def quality(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", policy: str = "v1") -> DataFrame:
    """The ledger with ``base_failed`` and ``kept``: false if a base rule failed, else the policy's verdict."""
    book = apply_policy(apply_policy(ledger(df, id_col, text_col), policy), "base", "_base")
    return book.select("*", (~F.col("_base")).alias("base_failed")).withColumn("kept", F.col("kept") & F.col("_base")).drop("_base")
