"""From raw documents to packed training sequences, in five stages.

Each stage takes ``(spark, docs, sf_dir)``, works on every document the one
before kept, and returns a DataFrame that is written and read again as the next
one's input; all but the last return the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from cartcast.llm import exact_dedup, mixing, ngram_join, packing, quality
from cartcast.llm.common import read_table, ship_package, staged
from cartcast.llm.queries import tokenizer_path

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier rejects go."""
    return quality.keep_good(docs, read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts the one of largest doc_id stays."""
    return exact_dedup.drop_exact_duplicates(docs)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, similarity 0.8) stays."""
    return ngram_join.keep_one_of_each(docs, shingle=5, percent=80)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents are repeated or dropped at the rates that bring the domains to their target shares."""
    labels = read_table(spark, sf_dir, "labels")
    return mixing.resample(docs, mixing.domain_labels(labels), mixing.DOMAINS)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of every document and their places in sequences of at most 2048 tokens."""
    return packing.best_fit_packing(docs, tokenizer_path())


def _shipped(stage: Stage) -> Stage:
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        ship_package(spark)
        return stage(spark, docs, sf_dir)

    run_stage.__doc__ = stage.__doc__
    return run_stage


STAGES: list[tuple[str, Stage]] = [
    ("quality classifier", _shipped(quality_stage)),
    ("exact dedup", _shipped(exact_stage)),
    ("n-gram Jaccard join", _shipped(near_stage)),
    ("mixing to target weights", _shipped(mixing_stage)),
    ("best-fit packing", _shipped(packing_stage)),
]

#: Learned scores, hashed dealing and packing have no SQL form; the tests hold
#: the stages against brute force instead.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
