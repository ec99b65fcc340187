"""Ordered lists of any length: a global sort whose rows get their place without meeting in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from volframe.plans.scratch import scratch_path

#: monotonically_increasing_id() has the partition above these bits and the row's place within it below.
PLACE_BITS = 33


def placed(rows: DataFrame, label: str, name: str) -> DataFrame:
    """rows, in the order of their partitions and within these, with column `name`: 0, 1, 2, ... without gaps.

    The rows are written first, with their partition and place, so that no later task can see them in other partitions.
    Counts by partition, a row for each, give where a partition begins; all else is a sum of two columns.
    """
    path = scratch_path(rows.sparkSession, label)
    rows.withColumn("_at", F.monotonically_increasing_id()).write.parquet(path)
    kept = rows.sparkSession.read.parquet(path).withColumn("_part", F.shiftright("_at", PLACE_BITS))
    before = Window.orderBy("_part_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each partition of the sort
    begins = kept.groupBy(F.col("_part").alias("_part_")).agg(F.count("*").alias("_n")).select("_part_", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_begin"))
    at = F.col("_begin") + F.col("_at").bitwiseAND((1 << PLACE_BITS) - 1)
    # begins has as many rows as the sort has partitions, whatever the input
    return kept.join(F.broadcast(begins), F.col("_part") == F.col("_part_")).select(*rows.columns, at.cast("long").alias(name))


def with_ordinal(df: DataFrame, *by: str, name: str = "ordinal") -> DataFrame:
    """df with its rows numbered 0, 1, 2, ... in the order of the columns `by`; nulls come first, and equal rows get
    neighbouring numbers. Spark deals the rows by ranges and sorts each range; no task sees them all."""
    return placed(df.repartitionByRange(*by).sortWithinPartitions(*by), "ordered", name)


def write_list(df: DataFrame, by: str, path: str) -> None:
    """(ordinal, value) in Parquet: the column `by` in its order."""
    with_ordinal(df.select(F.col(by).alias("value")), "value").select("ordinal", "value").write.parquet(path)


def write_text_list(df: DataFrame, by: str, path: str) -> None:
    """The column `by` in its order, one value a line, in as many parts as the sort has ranges; the parts' names are in
    order, so that reading one after the other is the list."""
    df.select(F.col(by).alias("value")).repartitionByRange("value").sortWithinPartitions("value").write.text(path)


def read_text_list(spark: SparkSession, path: str, name: str = "path") -> DataFrame:
    """(ordinal, name) of text files of values that any white space separates, taken as one list: the files by name, then
    by place in the file. Files are split among tasks as Spark does; a stretch's values are counted, not gathered."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"))
    values = lines.select(F.explode(F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")).alias(name), "_file", "_block").where(F.col(name) != "")
    at = scratch_path(spark, "list")
    values.withColumn("_at", F.monotonically_increasing_id()).write.parquet(at)
    kept = spark.read.parquet(at)
    before = Window.orderBy("_file_", "_block_").rowsBetween(Window.unboundedPreceding, -1)  # a row for each stretch of a file
    stretches = kept.groupBy(F.col("_file").alias("_file_"), F.col("_block").alias("_block_")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    stretches = stretches.withColumn("_begin", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    found = kept.join(stretches, (F.col("_file") == F.col("_file_")) & (F.col("_block") == F.col("_block_")))
    return found.select((F.col("_begin") + F.col("_at") - F.col("_first")).cast("long").alias("ordinal"), name)
