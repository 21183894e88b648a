"""Corpus pipeline: quality filter, line dedup, near-dedup, source mixing, subword encoding.

Each stage takes (spark, docs, sf_dir) and gives what the next one gets, written as Parquet in between.
All but the last return the columns of ``docs``; only `labels` and, for the classifier, `documents` are read besides. The mix
takes some documents more than once, and those rows stand as often.

Defined results, as their operators state them: null and empty texts have the score of no words and no pieces, are one empty line,
are no near duplicates and are never taken by the mix; rows without a doc_id own no lines and are no near duplicates; of rows that
repeat a doc_id near-dedup keeps one; ties go to the smallest doc_id (lines, near-dedup) or by key, doc_id and text (mix); empty
tables give no rows; further columns pass through whatever their names.

Stages bound the batches of the session that they run in (see `plan.bounded_batches`).
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from deltaweave.llm import lines, minhash, mixing, pieces, plan, quality

THRESHOLD = 0.3


def _classifier(spark: SparkSession, sf_dir: str) -> quality.AdditiveModel:
    """Fitted to the labels and texts of all documents: the same in every stage that asks."""
    return quality.fit(plan.table(spark, sf_dir, "documents"), quality.training_labels(spark, sf_dir))


def _bounded(stage: Callable) -> Callable:
    """The stage, with batches of bounded size for Python workers."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        plan.bounded_batches(spark)
        return stage(spark, docs, sf_dir)

    return run


@_bounded
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    return quality.keep_scored(docs, _classifier(spark, sf_dir), THRESHOLD)


@_bounded
def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that an earlier document has."""
    return lines.without_repeated_lines(docs)


@_bounded
def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates (five-word shingles, similarity 0.8)."""
    return minhash.without_near_duplicates(docs, width=5, percent=80)


@_bounded
def mix_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them, weighed by the scores of the first stage's classifier."""
    return mixing.mixed_documents(docs, model=_classifier(spark, sf_dir))


@_bounded
def encode_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id and its pieces."""
    return pieces.encode(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("minhash near-dedup", near_dedup_stage),
    ("source mixing", mix_stage),
    ("subword encoding", encode_stage),
]

#: The first stage is a fitted model, which SQL does not express; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``."""
    docs = plan.table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        before, docs = docs, plan.cut(stage(spark, docs, sf_dir))
        plan.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
