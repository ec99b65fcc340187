"""Selection of images from a manifest: labels, quality checks, the first image of each key, and what each step leaves."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volframe.functions.arrays import all_at_least, as_number

# Fixed values of the selection.
ANATOMICAL = ("T1w", "T2w", "FLAIR")
SHELL = (900, 1100)
LEAST_EXTENT_MM = 100.0
KEYS = ("collection", "subject", "sequence")


def b_value(suffix: Column) -> Column:
    """The digits of dwi_bval<digits> as a number; null for any other suffix."""
    return as_number(F.regexp_extract(suffix, r"^dwi_bval(\d+)$", 1))


def in_shell(suffix: Column, dwi_type: Column) -> Column:
    """Whether this is a mean image with a b-value of the shell, both ends included; false where anything is missing."""
    return F.coalesce((dwi_type == "mean") & b_value(suffix).between(*SHELL), F.lit(False))


def sequence_label(suffix: Column, dwi_type: Column) -> Column:
    """dwi_b1000 for the shell, else dwi_b0 for b0 images, else an anatomical suffix, else null."""
    return F.when(in_shell(suffix, dwi_type), "dwi_b1000").when(dwi_type == "b0", "dwi_b0").when(suffix.isin(*ANATOMICAL), suffix)


def label_sequences(images: DataFrame) -> DataFrame:
    return images.withColumn("sequence", sequence_label(F.col("suffix"), F.col("dwi_type")))


def no_warnings(warnings: Column) -> Column:
    """Whether the list is empty. A null list is an error: it means that nobody looked."""
    return F.when(warnings.isNull(), F.raise_error(F.lit("warnings must not be null"))).otherwise(F.size(warnings) == 0)


def large_enough(mask_extent: Column) -> Column:
    return all_at_least(mask_extent, LEAST_EXTENT_MM)


def checks(images: DataFrame) -> DataFrame:
    """images with their label and, for each step of the selection, whether it is passed."""
    return label_sequences(images).withColumns({"labelled": F.col("sequence").isNotNull(), "clean": no_warnings(F.col("warnings")), "extended": large_enough(F.col("mask_extent"))})


def keep_first(df: DataFrame, keys: Sequence[str], by: str) -> DataFrame:
    """The row with the smallest `by` of each combination of keys; null keys are equal, a null `by` comes last.

    An aggregate with a partial step, so that a frequent key is not gathered in one task; it also runs on streams.
    """
    row = F.min_by(F.struct(*df.columns), F.struct(F.col(by).isNull(), F.col(by)))
    return df.groupBy(*(F.col(k).alias(f"_{k}") for k in keys)).agg(row.alias("_row")).select("_row.*")


def selected(images: DataFrame) -> DataFrame:
    """Images that pass every check, the first by path of each collection, subject and sequence."""
    passed = checks(images).where("labelled AND clean AND extended").drop("labelled", "clean", "extended")
    return keep_first(passed, KEYS, "path")


def funnel(images: DataFrame) -> DataFrame:
    """(position, stage, images): how many images each step leaves, from one pass over the manifest."""
    c = checks(images)
    one, two, three = F.col("labelled"), F.col("labelled") & F.col("clean"), F.col("labelled") & F.col("clean") & F.col("extended")
    per_key = c.groupBy(*KEYS).agg(F.count("*").alias("a"), F.count_if(one).alias("b"), F.count_if(two).alias("c"), F.count_if(three).alias("d"))
    total = per_key.agg(*(F.coalesce(F.sum(x), F.lit(0)).alias(x) for x in "abcd"), F.count_if(F.col("d") > 0).alias("e"))
    names = ("all", "sequence", "no_warnings", "extent", "deduplicated")
    rows = ", ".join(f"{i}, '{n}', {x}" for i, (n, x) in enumerate(zip(names, "abcde", strict=True)))
    return total.select(F.expr(f"stack(5, {rows}) AS (position, stage, images)"))


def sequence_counts(df: DataFrame) -> DataFrame:
    """Labels by falling frequency, then by name; rows without a label are left out."""
    return df.where("sequence IS NOT NULL").groupBy("sequence").agg(F.count("*").alias("images")).orderBy(F.desc("images"), "sequence")


def distinct_sequences(df: DataFrame) -> DataFrame:
    return df.where("sequence IS NOT NULL").select("sequence").distinct().orderBy("sequence")


def derivative_path(path: Column) -> Column:
    """Where the prepared volume of an image is: without a leading source/ and a trailing .nii.gz, below derivatives/."""
    return F.concat(F.lit("derivatives/"), F.regexp_replace(F.regexp_replace(path, r"^source/", ""), r"\.nii\.gz\z", ""), F.lit(".npz"))


def write_filelist(df: DataFrame, path: str) -> None:
    """The derivative paths in path order: below path/list in Parquet, with their ordinal, and below path/text one a line,
    in parts whose names are in order. Nothing passes through one task."""
    from volframe.operators.ordering import write_list, write_text_list

    paths = df.select(F.col("path").alias("value"), derivative_path(F.col("path")).alias("path"))
    write_list(paths, "path", f"{path}/list")
    write_text_list(paths, "path", f"{path}/text")
