"""A training corpus from raw documents: rules, classifier, near duplicates, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volframe.llm import compression_classifier, ngram_join, packing, quality_rules
from volframe.llm.shared import save


def by_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every quality rule."""
    return quality_rules.keep_good(docs)


def by_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose score reaches the threshold; learnt from the labelled documents of sf_dir."""
    model = compression_classifier.fitted(spark, sf_dir)
    return compression_classifier.score(docs, model, name="_score").where(F.col("_score") >= compression_classifier.THRESHOLD).drop("_score")


def without_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of those alike in four fifths of their five-word shingles."""
    return ngram_join.keep_first(docs, k=5, threshold=80)


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' tokens in sequences, a row for each piece."""
    return packing.pack_documents(docs)


STAGES = [
    ("quality_rules", by_rules),
    ("quality_classifier", by_classifier),
    ("ngram_join", without_near_copies),
    ("packing", packed),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each one's rows are written to the shared folder and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = save(stage(spark, docs, sf_dir), name)
    return docs


#: Scores and packing plans are not SQL; tests hold the result against plain versions of the stages.
ORACLE_SQL = None
