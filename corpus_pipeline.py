"""A training-data pipeline over documents: STAGES and run().

Each stage takes (spark, docs, sf_dir), works on all that the one before kept, and is written as
Parquet before the next reads it. SQL has no expectation-maximisation or BPE, so there is no
ORACLE_SQL; tests/llm/test_pipeline.py holds the stages against plain Python.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, jaccard, langid, mixing, secrets
from tessera.llm.common import cut, remove, small_batches, table, transient
from tessera.llm.queries import BYTE_BPE


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose languages, one or several, together have half of their words or more; the rest go.

    A word has a language if it is likelier there than in none: numbers, keys, noise and languages not learnt
    count as words without one, signs alone as no words. A null or empty text and one without a letter go;
    repeated rows stay or go alike; of an empty table nothing is learnt and nothing stays. All columns pass,
    whatever their names.
    """
    small_batches(spark)
    model = langid.train(docs.where(~langid.held_out(F.col("doc_id"))))
    return langid.keep(docs, model)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by five-word shingles at a similarity of 0.8 or more.

    The least id of a group stays, once; rows without words or without an id stay. All columns pass,
    whatever their names; an empty table gives no rows.
    """
    small_batches(spark)
    return jaccard.one_of_each(docs, n=5, percent=80)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with their secrets replaced by a mark; all documents stay, null texts as nulls, repeated rows alike.

    n_chars, where there is such a column, follows the text; other columns pass, whatever their names.
    """
    small_batches(spark)
    import public_tokenizers

    words = secrets.vocabulary(public_tokenizers.path(BYTE_BPE))
    clean = docs.withColumn("text", secrets.redacted(F.col("text"), words))
    if "n_chars" in docs.columns:
        clean = clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return clean.select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents repeated or left out so that sources come to their target weights.

    A null source is one of its own, a null text has no words; repeated rows are taken alike. All columns
    pass, whatever their names; an empty table gives no rows.
    """
    small_batches(spark)
    return mixing.mix(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, hashes of ids and of the decoded text, and token_ids, a row for each row; a null text counts as empty."""
    small_batches(spark)
    import public_tokenizers

    return bpe.encode(docs, public_tokenizers.path(BYTE_BPE), ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("secret_scan", secret_scan),
    ("mixture", mixture),
    ("tokens", tokens),
]
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply STAGES to documents, each to the written result of the one before."""
    docs, path = table(spark, sf_dir, "documents"), None
    for k, (name, stage) in enumerate(STAGES):
        if k + 1 == len(STAGES):
            return stage(spark, docs, sf_dir)
        with transient(spark) as keep:
            docs = keep(cut(stage(spark, docs, sf_dir), name))
        if path:
            remove(spark, [path])
        path = docs._cut_at
    return docs
