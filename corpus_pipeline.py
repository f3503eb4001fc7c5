"""A corpus pipeline: quality filter, near-duplicate removal, decontamination, mixing, token tables.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as Parquet and read again as the
next stage's docs. All but the last return the columns of ``documents`` (and any further columns of docs).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import common, decontaminate, jaccard_join, mixing, quality, token_table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (score >= 0.3); it learns from the labelled documents among docs.

    Null and empty texts are scored like texts without statistics, rows that are equal go or stay together, and without
    labels of both kinds all documents have one score: the share of label 1 (0.5 without labels, so all stay). Columns
    of any name stay as they are. An empty table gives no rows.
    """
    score = common.fresh(docs.columns, "_score")
    trees = quality.train(docs, common.table(spark, sf_dir, "labels"))
    return quality.scored(docs, trees, score=score).where(F.col(score) >= quality.THRESHOLD).drop(score)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group: the one with the smallest id.

    Null, empty and wordless texts and rows with a null id link to nothing and stay. Of rows that share an id, one of
    each set of shingles stays (the smallest text, then the smallest as JSON), so the result doesn't depend on their
    order. Columns of any name stay as they are. An empty table gives no rows.
    """
    return jaccard_join.deduplicated(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any window of the benchmark: 10 words, or all words of a shorter item.

    Null, empty and wordless texts stay, items without words match nothing, equal rows go or stay together, and an empty
    benchmark keeps all. Columns of any name stay as they are. An empty table gives no rows.
    """
    return decontaminate.decontaminated(docs, common.table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: up to three times, or not at all.

    Null texts and those without words have size 0 and aren't taken; null sources are one source. Rows that are equal
    in id, source and text are taken equally often. Columns of any name stay as they are. An empty table gives no rows.
    """
    return mixing.repeated(docs)


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token tables of the mix, read back: doc_id, start, n_tokens, ids_crc32 of every row in ascending order of ids.

    A null text has the end id alone, a null id comes first, rows that repeat an id have an entry each, in order of a hash
    of their texts. Other columns aren't read. An empty table gives no rows.
    """
    return token_table.token_table(docs)


STAGES = [
    ("quality classifier", quality_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("benchmark decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token tables", token_stage),
]

#: The classifier can't be expressed in SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = common.saved(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
