"""The corpus pipeline: documents through five of the training-data operators, in order.

Every stage but the last takes and returns the columns of ``documents``. Stages work
on all that the stage before kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fjordbook.llm import lines, mixing, neardup, packing, quality
from fjordbook.llm.common import small_batches, table
from fjordbook.llm.tokens import vocabulary_path
from fjordbook.session import durable

#: SQL can express none of: trees, fingerprints, a seeded mix, token ids.
ORACLE_SQL = None


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labels, does not reject."""
    small_batches(spark)
    trees = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.scored(docs, trees).filter(F.col("score") >= quality.THRESHOLD).select("row.*")


def without_boilerplate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that are boilerplate at their source; ``n_chars`` follows the text.

    Copies are still there and count as one page: near-dedup keeps the text of one of them.
    """
    small_batches(spark)
    cleaned = lines.without_boilerplate(docs, F.col("source"), copies=False)
    size = F.when(F.col("n_removed") > 0, F.char_length("text").cast("long")).otherwise(F.col("n_chars"))
    return cleaned.select(*[size.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in docs.columns])


def one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates."""
    small_batches(spark)
    return neardup.deduplicated(docs)


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix of sources at their target sizes, a row for each reading of a document."""
    small_batches(spark)
    return mixing.mixed_documents(docs)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of the mix and their places in full sequences."""
    small_batches(spark)
    return packing.pack(durable(packing.pieces(docs, vocabulary_path())))


STAGES = [
    ("quality classifier", good_quality), ("line dedup", without_boilerplate), ("near-dedup", one_of_each),
    ("mixing", mixed), ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each stored before the next."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = durable(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
