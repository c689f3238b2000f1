"""From raw documents to packed training sequences, in stages that are each written and read again."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from paceline.llm import mixing, ngram_join, packing, quality, secrets
from paceline.llm.common import corpus, keep, small_batches

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the quality rules, judged by references from this very corpus.

    Null, empty and short texts fail the rules; a null language judges nothing and is judged by all. Repeated rows stay or go
    together. All columns stay as they are, whatever they are called. No rows: no rows.
    """
    own = [c if c in ("lang", "text") else f"_{i}" for i, c in enumerate(docs.columns)]
    return quality.quality(docs.toDF(*own)).where("kept").select(*own).toDF(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the smallest id, of each group of near copies (five-word shingles, similarity 0.8).

    Texts without a word all stay; a null id comes after all others. Of rows alike in id and text one stays. All columns stay
    as they are. No rows: no rows.
    """
    return ngram_join.one_of_each(docs)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with secrets in the text replaced by a mask, and ``n_chars`` counted anew where they were.

    Null and empty texts stay as they are, and so do repeated rows and all other columns. No rows: no rows.
    """
    return secrets.mask_secrets(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out until the sources have their target shares.

    A null source is a source. Null and empty texts have no size; how often they are taken changes no share. Rows alike
    in id, source and text are numbered in any order, which gives the same rows. All columns stay as they are. No rows: no rows.
    """
    return mixing.mix_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in training sequences.

    Null and empty texts are an end mark alone; repeated rows are documents of their own. Columns but doc_id and text are
    not read. No rows: no pieces.
    """
    return packing.pack(docs)


STAGES: list[tuple[str, Stage]] = [
    ("quality_rules", keep_good),
    ("ngram_join", keep_one_of_each),
    ("find_secrets", mask_secrets),
    ("mix_sources", mix_sources),
    ("pack_sequences", pack_sequences),
]
# Tokenizing, string tests and hashed signatures have no form in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, starting from the documents table.

    What a stage leaves is written, its own scratch data deleted, and then that of the stage before it. All stages share one set of
    Python workers, so texts go to them in small batches.
    """
    spark = small_batches(spark)
    docs, last = corpus(spark, sf_dir), None
    for name, step in STAGES[:-1]:
        kept = keep(spark, name, lambda docs=docs, step=step: step(spark, docs, sf_dir))
        if last:
            last.release()
        docs, last = kept.table, kept
    return STAGES[-1][1](spark, docs, sf_dir)
