"""A corpus pipeline: quality rules, line dedup, near duplicates, repeated passages, packing.

Each stage takes every document that the one before it kept, and its decisions take effect in what it returns. All
stages but the last return the columns of ``documents``; ``n_chars`` follows the text where a stage changes it.

Defined results, for all stages: rows without an id are judged by the rules and packed, and the stages between them that
compare documents leave them as they are; rows without text go in the first stage; columns that ``documents`` doesn't
have go too; an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ortholake.llm._store import materialize
from ortholake.llm.line_dedup import dedup_lines
from ortholake.llm.ngram_join import ngram_components
from ortholake.llm.packing import pack
from ortholake.llm.quality_rules import kept_documents
from ortholake.llm.suffix_dedup import remove_repeats

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def _rewritten(docs: DataFrame) -> DataFrame:
    """The columns of documents after a change of texts; documents whose text is left empty go."""
    rows = docs.where(F.length("text") > 0)
    return rows.withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go. Each row is judged by itself, so repeated rows stay or go together."""
    return kept_documents(docs, "v1").select(*COLUMNS)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines of ten characters or more that an earlier line nearly equals go; shorter ones, which give a text its form
    (headings, brackets, numbers), stay. Lines of rows with the same id and line number aren't earlier than one another,
    so repeated rows keep theirs. A document without a line left goes."""
    return _rewritten(dedup_lines(docs, min_chars=10, carry=("lang", "source")))


def ngram_jaccard(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Rows without an id stay: they are in no group. Rows that share an id are one document, which goes with all of its
    rows only where each of them has a near duplicate of a smaller id.
    """
    found = ngram_components(docs).groupBy("doc_id").agg(F.max("component_id").alias("first"))
    return docs.join(found.where(F.col("first") < F.col("doc_id")), "doc_id", "left_anti").select(*COLUMNS)


def suffix_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 bytes or more that a document of a smaller id has too go; rows that share an id don't count as each
    other's. Bytes of a character that was cut in two go with it. A document without a byte left goes."""
    return _rewritten(remove_repeats(docs, keep_text=True, carry=("lang", "source")))


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each piece of a document: token sequences of at most 2048 ids; repeated rows are packed each."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), capacity=2048, end_id=0)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_dedup),
    ("ngram_jaccard", ngram_jaccard),
    ("suffix_dedup", suffix_dedup),
    ("best_fit_packing", best_fit_packing),
]

#: The last stage encodes texts, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, f"stage-{name}")
    return docs
