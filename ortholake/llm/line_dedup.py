"""Line deduplication by a deletion-neighbourhood join, in built-in functions only.

A line goes if an earlier one, in order of (document id, line number), is equal to it or at most ``edits`` (0 or 1)
edits away: a character inserted, deleted or replaced. Blank lines, and lines under ``min_chars`` characters, take no
part and stay.

Two lines an edit apart become equal when the right character is deleted from one or both, so each line would emit a
hashed key for each of its deletions. That is only needed where another line could match, which two joins find first,
and neither can miss a pair: an edit leaves one half of a line as it is, so a line whose halves are both its own has
no match; and cut into segments, all but one segment stays, so what precedes and follows a segment is a key shared by
both lines. Only lines that share such a key emit deletions, and only those of the segment between:

* keys with the place of the deletion: lines of one length that share one differ in that character at most;
* keys without it: a line is equal to what another, one character longer, becomes.

Within a key only the earliest line counts, so a group of any size costs a row per member and no pairs are formed; the
match found is verified by the edit distance of the whole lines. The longer the line, the more segments, so that a line
of any length emits about as many keys as it has characters.

What moves: hashes of lines; the text of those lines only whose half another line has; the texts of those documents only
that lose a line. Rows that can't be among these stay out of the exchanges by a table of marks (one bit for a hash, at
most ``2 ** 18`` words, broadcast): it lets some others through, which the join behind it settles, and all at a size where
its bits are used up. Lines so frequent that one makes up more than one in 10,000 of all, of which there are fewer than
10,000, meet their verdict by broadcast; all other joins have one row a key on one side and can be split.

Defined results: a null text stays null and has no lines; an empty one has one empty line; a null id takes no part and
keeps its text; equal lines of rows with the same id and the same line number are not earlier than one another; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ortholake.llm._store import materialize

SEGMENTS, SEGMENT_CHARS = 8, 48
MARK_WORDS = 1 << 18
HOT_SHARE = 10_000
PLACE = ["doc_id", "line_no", "th"]


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """(doc_id, th, line_no, line, h1, h2) of the lines that take part; 96 bits for a line."""
    each = docs.where("doc_id is not null and text is not null").select("doc_id", "th", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    each = each.where((F.char_length("line") >= min_chars) & F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    return each.select("*", F.xxhash64("line").alias("h1"), F.shiftrightunsigned(F.xxhash64(F.lit(1), "line"), 32).alias("h2"))


def _half_keys() -> list:
    """Keys of the first and last half; two lengths of halves where the line is even, as a match may be shorter."""

    def keys(half: str) -> list[str]:
        return [f"xxhash64(0, {half}, left(line, {half}))", f"xxhash64(1, {half}, right(line, {half}))"]

    even = [f"if(n % 2 = 0, {k}, null)" for k in keys("cast((n - 1) div 2 as int)")]
    return [F.expr(k).alias(f"k{i}") for i, k in enumerate([*keys("cast(n div 2 as int)"), *even])]


def _marks(hashes: DataFrame) -> DataFrame:
    """(word, bits): a bit set for each hash in column ``h``; at most ``MARK_WORDS`` rows."""
    return hashes.groupBy(F.pmod(F.shiftright("h", 6), F.lit(MARK_WORDS)).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(h & 63 as int)))").alias("bits"))


def _marked(rows: DataFrame, marks: DataFrame, h: Column) -> DataFrame:
    """``rows`` with ``marked``: false only if the hash ``h`` is not among those that ``marks`` was made of."""
    rows = rows.withColumn("_h", h)
    rows = rows.join(F.broadcast(marks), F.pmod(F.shiftright("_h", 6), F.lit(MARK_WORDS)) == F.col("word"), "left")
    return rows.withColumn("marked", F.coalesce(F.expr("shiftrightunsigned(bits, cast(_h & 63 as int)) & 1 = 1"), F.lit(False))).drop("_h", "word", "bits")


#: Keys of what surrounds each segment of a line of ``n`` characters, for matches whose shorter line has ``v``.
_SEGMENT_ROWS = f"""
  explode(flatten(transform(array(n, n - 1), v ->
    transform(array(greatest({SEGMENTS}, cast(ceil(v / {SEGMENT_CHARS}) as int))), s ->
      transform(sequence(0, s - 1), j -> named_struct(
        'extra', n - v,
        'key', xxhash64(v, j, left(line, cast(cast(j as bigint) * v div s as int)), right(line, cast(v - cast(j + 1 as bigint) * v div s as int))),
        'middle', substring(line, cast(cast(j as bigint) * v div s as int) + 1,
                            cast(n - v + cast(j + 1 as bigint) * v div s - cast(j as bigint) * v div s as int))
      )))[0]))) as seg"""

#: Deletions from the middle. Kind 0: of a line of length v, with the place; 1: the line itself; 2: of a longer line.
_DELETIONS = """
  explode(concat(
    if(extra = 0 and n_short > 1, transform(sequence(1, greatest(char_length(middle), 1)), i -> named_struct(
       'kind', 0, 'x', xxhash64(key, i, left(middle, i - 1), substring(middle, i + 1)))), array()),
    if(extra = 0 and n_long > 0, array(named_struct('kind', 1, 'x', xxhash64(key, 0, middle))), array()),
    if(extra = 1 and n_short > 0, transform(sequence(1, char_length(middle)), i -> named_struct(
       'kind', 2, 'x', xxhash64(key, 0, concat(left(middle, i - 1), substring(middle, i + 1))))), array())
  )) as variant"""


def near_matches(lines: DataFrame) -> DataFrame:
    """The places of the distinct lines (place, line) that are one edit away from one with an earlier place."""
    segments = lines.withColumn("n", F.char_length("line")).select("place", F.expr(_SEGMENT_ROWS)).select("place", "seg.*")
    of_key = segments.groupBy("key").agg(F.count_if(F.col("extra") == 0).alias("n_short"), F.count_if(F.col("extra") == 1).alias("n_long"))
    shared = segments.join(of_key.where("n_short > 1 or (n_short = 1 and n_long > 0)"), "key")
    variants = shared.select("place", F.expr(_DELETIONS)).select("place", "variant.*")
    first = [F.min(F.when(F.col("kind") == k, F.col("place"))).alias(f"first{k}") for k in range(3)]
    of_x = variants.groupBy("x").agg(*first, F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    matched = variants.join(of_x, "x").select("place", F.expr("case kind when 0 then first0 when 1 then first2 else first1 end").alias("other"))
    pairs = matched.where(F.col("other") < F.col("place")).distinct()
    own, others = lines.select("place", "line"), lines.select(F.col("place").alias("other"), F.col("line").alias("other_line"))
    return pairs.join(own, "place").join(others, "other").where(F.levenshtein("line", "other_line", 1).between(0, 1)).select("place").distinct()


def dropped_lines(docs: DataFrame, min_chars: int = 0, edits: int = 1) -> DataFrame:
    """(doc_id, th, dropped): the numbers of the lines that go, for documents (doc_id, th, text) that lose any."""
    if edits not in (0, 1):
        raise ValueError("edits must be 0 or 1")
    lines = _lines(docs, min_chars)
    keys = [f"k{i}" for i in range(4)] if edits else []
    hashed = lines.withColumn("n", F.char_length("line")).select(*PLACE, "h1", "h2", *(_half_keys() if edits else []))
    classes = hashed.groupBy("h1", "h2").agg(F.min(F.struct(*PLACE)).alias("place"), F.count(F.lit(1)).alias("found"), *(F.max(k).alias(k) for k in keys))
    classes = materialize(classes, "lines")
    where = F.struct(*PLACE)

    verdicts = classes.select("h1", "h2", "place", "found")
    if edits:
        halves = classes.select("place", F.explode(F.array(*keys)).alias("k")).where("k is not null")
        shared = halves.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("k")
        some = materialize(halves.join(shared, "k", "left_semi").select("place.*").distinct(), "places")
        able = _marked(lines.select(*PLACE, "line"), _marks(some.select(F.xxhash64(*PLACE).alias("h"))), F.xxhash64(*PLACE)).where("marked")
        # a row for each place: rows may be repeated
        texts = able.join(some, PLACE, "left_semi").groupBy(*PLACE).agg(F.first("line").alias("line"))
        near = materialize(near_matches(materialize(texts.select(where.alias("place"), "line"), "candidates")).withColumn("near", F.lit(True)), "near")
        verdicts = _marked(verdicts, _marks(near.select(F.xxhash64("place").alias("h"))), F.xxhash64("place")).where("found > 1 or marked")
        verdicts = verdicts.join(near, "place", "left")
    else:
        verdicts = verdicts.withColumn("near", F.lit(None).cast("boolean"))
    # lines that are found once and near none stay without being looked up
    verdicts = materialize(verdicts.where("found > 1 or near").select("h1", "h2", "place", "found", F.coalesce("near", F.lit(False)).alias("near")), "verdicts")
    total = classes.agg(F.sum("found")).first()[0] or 0
    is_hot = F.col("found") * HOT_SHARE > total
    hot = verdicts.where(is_hot).select("h1", "h2", F.struct("place", "near").alias("hot"))
    cold = verdicts.where(~is_hot).select(F.col("h1").alias("s1"), F.col("h2").alias("s2"), F.struct("place", "near").alias("cold"))

    each = _marked(lines.select(*PLACE, "h1", "h2"), _marks(verdicts.select(F.col("h1").alias("h"))), F.col("h1")).where("marked")
    each = each.join(F.broadcast(hot), ["h1", "h2"], "left")

    def goes(verdict: str) -> Column:
        return F.col(f"{verdict}.near") | (where != F.col(f"{verdict}.place"))

    each = each.where(F.col("hot").isNull() | goes("hot"))
    # frequent lines are settled by now, and pass the join dealt by where they stand
    settled = F.col("hot").isNotNull()
    each = each.select(*PLACE, settled.alias("settled"), F.when(settled, F.xxhash64(*PLACE)).otherwise(F.col("h1")).alias("s1"), F.when(settled, F.lit(-1).cast("long")).otherwise(F.col("h2")).alias("s2"))
    gone = each.join(cold, ["s1", "s2"], "left").where(F.col("settled") | F.coalesce(goes("cold"), F.lit(False)))
    return gone.groupBy("doc_id", "th").agg(F.collect_set("line_no").alias("dropped"))


def dedup_lines(df: DataFrame, min_chars: int = 0, edits: int = 1, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, text without the lines that go, n_lines, n_dropped, and the columns in ``carry``."""
    docs = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("th"), F.struct(F.lit(0).alias("_"), *carry).alias("carried"))
    found = materialize(dropped_lines(docs.select("doc_id", "text", "th"), min_chars, edits), "dropped")
    h = F.xxhash64("doc_id", "th")
    marked = _marked(docs, _marks(found.select(h.alias("h"))), h)
    whole = marked.where(~F.col("marked")).drop("marked").withColumn("dropped", F.lit(None).cast("array<int>"))
    cut = marked.where("marked").drop("marked").join(found, ["doc_id", "th"], "left").select(*whole.columns)
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("dropped")), lambda i: F.get(F.col("lines"), i))
    return (
        whole.union(cut)
        .withColumn("lines", F.split("text", "\n"))
        .select(
            "doc_id",
            F.when(F.col("dropped").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
            F.coalesce(F.size("lines"), F.lit(0)).alias("n_lines"),
            F.coalesce(F.size("dropped"), F.lit(0)).alias("n_dropped"),
            *(F.col("carried")[c].alias(c) for c in carry),
        )
    )
