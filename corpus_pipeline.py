"""From raw documents to token ids: five stages, each one of the text operators.

``STAGES`` lists the stages; each takes ``(spark, docs, sf_dir)`` and returns a
table that the next one gets as ``docs``. All but the last return the columns
of ``documents``; the last returns the counts and digests of the tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import bpe, jaccard_join, mixing, rule_ensemble, suffix_dedup
from rasterloom.llm.common import table, written
from rasterloom.llm.queries import MIX, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    return rule_ensemble.keep_good(docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each group of near copies (five words, 0.8)."""
    return jaccard_join.one_of_each(docs, words=5, percent=80)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that a smaller id has; ``n_chars`` follows the text."""
    cut = suffix_dedup.without_repeats(docs)
    return cut.withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the budget tree takes, once for each epoch."""
    return mixing.mix(docs, **MIX).select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of the ids and of the decoded text."""
    return bpe.encode_decode(docs, tokenizer_file("word_bpe_49k.json"), values=False)


STAGES = [
    ("quality classifier", quality),
    ("n-gram jaccard join", near_duplicates),
    ("suffix-array dedup", passages),
    ("mixing to target weights", mixture),
    ("bpe encoding and decoding", tokens),
]

#: The stages learn a model, join by similarity and encode: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents``; each result is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs = written(docs, "stage")
    return docs
