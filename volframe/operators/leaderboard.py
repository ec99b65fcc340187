"""Evaluation scores: normalisation, group means, seed medians, ranks, and validated submissions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from volframe.functions.arrays import digest10, lower_median

# Fixed values of the published rules.
KINDS = ("classification", "age", "segmentation")
GROUP_ROW = "all"
NAME_MOST = 20
REVIEW_SUFFIXES = (".py", ".yaml", ".yml")


def normalised(kind: Column, raw: Column) -> Column:
    """0 is about chance and 1 perfect: 2 * AUROC - 1 for classification, R2 for age, Dice for segmentation."""
    return F.when(kind == "classification", 2 * raw - 1).otherwise(raw)


def normalise_scores(scores: DataFrame) -> DataFrame:
    return scores.withColumn("score", normalised(F.col("kind"), F.col("raw")))


def score_rows(runs: DataFrame, scores: str = "summary") -> DataFrame:
    """(run, task, score) from a map of task to struct with a score, without the row for all tasks."""
    kept = F.map_filter(scores, lambda k, v: k != GROUP_ROW)
    return runs.select("run", F.explode(kept).alias("task", "_s")).select("run", "task", F.col("_s.score").alias("score"))


def group_scores(scores: DataFrame, tasks: DataFrame) -> DataFrame:
    """(recipe, seed, open, classification, age, segmentation): means over all tasks and over those of a kind.

    tasks: (task, kind), all that are expected. A mean is null while a task of it is missing. tasks is a short list.
    """
    expected = tasks.groupBy().agg(F.count_distinct("task").alias("n_open"), *(F.count_distinct(F.when(F.col("kind") == k, F.col("task"))).alias(f"n_{k}") for k in KINDS))
    own = scores.join(tasks.select("task").distinct(), "task", "left_semi")
    of = lambda k: F.when(F.col("kind") == k, F.col("score"))
    n = lambda k: F.count_distinct(F.when((F.col("kind") == k) & F.col("score").isNotNull(), F.col("task")))
    have = own.groupBy("recipe", "seed").agg(
        F.avg("score").alias("m_open"), F.count_distinct(F.when(F.col("score").isNotNull(), F.col("task"))).alias("h_open"),
        *(x for k in KINDS for x in (F.avg(of(k)).alias(f"m_{k}"), n(k).alias(f"h_{k}"))),
    )
    names = ("open", *KINDS)
    return have.crossJoin(F.broadcast(expected)).select("recipe", "seed", *(F.when(F.col(f"h_{k}") == F.col(f"n_{k}"), F.col(f"m_{k}")).alias(k) for k in names))


def seed_median(groups: DataFrame) -> DataFrame:
    """(recipe, seeds, open, ...): each mean's median over seeds, on its own; the lower of two middles."""
    return groups.groupBy("recipe").agg(F.count("*").alias("seeds"), *(lower_median(F.collect_list(k)).alias(k) for k in ("open", *KINDS)))


def leaderboard(medians: DataFrame) -> DataFrame:
    """medians with rank by open, the greatest first; equal ones share a rank and unscored recipes come last.

    A row for each recipe: the ranking's single partition is as small as the board.
    """
    return medians.withColumn("rank", F.rank().over(Window.orderBy(F.col("open").desc_nulls_last())))


def review_files(members: DataFrame, name: str = "name") -> DataFrame:
    """The archive members a reviewer reads, by suffix."""
    kept = F.lit(False)
    for s in REVIEW_SUFFIXES:
        kept |= F.col(name).endswith(s)
    return members.where(kept)


def assembled(configs: DataFrame, summaries: DataFrame, scores: DataFrame, sources: DataFrame) -> DataFrame:
    """One row for each run that has all four parts, joined on run."""
    return configs.join(summaries, "run").join(scores, "run").join(sources, "run")


def incomplete(configs: DataFrame, *others: DataFrame) -> DataFrame:
    """(run): runs with a config for which some other part is missing."""
    found = None
    for o in others:
        missing = configs.select("run").join(o.select("run"), "run", "left_anti")
        found = missing if found is None else found.unionByName(missing)
    return found.distinct()


def validation_errors(name: Column, group_score: Column) -> Column:
    """What is wrong with a submission, an empty array if nothing is."""
    return F.filter(
        F.array(
            F.when(group_score.isNull(), "task group is not scored"),
            F.when(F.coalesce(F.char_length(name), F.lit(0)) > NAME_MOST, f"name has more than {NAME_MOST} characters"),
        ),
        lambda m: m.isNotNull(),
    )


def sorted_map(m: Column) -> Column:
    return F.map_from_entries(F.array_sort(F.map_entries(m)))


def submissions(runs: DataFrame, metrics: str, ended_at: str | None = None) -> DataFrame:
    """runs (run, name, notes, open, metrics) with notes, validation_errors, valid, payload (JSON with sorted keys) and
    submission_id, ten digits of the payload's SHA-256. The id does not depend on ended_at."""
    checked = runs.withColumns({"notes": F.coalesce("notes", F.lit("")), "validation_errors": validation_errors(F.col("name"), F.col("open"))})
    document = F.to_json(F.struct(sorted_map(F.col(metrics)).alias("metrics"), F.col("name").alias("name"), F.col("notes").alias("notes"), F.col("run").alias("run"), F.col("validation_errors").alias("validation_errors")))
    out = checked.withColumns({"payload": document, "valid": F.size("validation_errors") == 0}).withColumn("submission_id", digest10(F.col("payload")))
    return out.withColumn("ended_at", F.date_format(ended_at, "yyyy-MM-dd'T'HH:mm:ss'Z'")) if ended_at else out


def write_submissions(df: DataFrame, path: str) -> None:
    """A folder of JSON for each run."""
    df.select("run", F.col("payload").alias("value")).write.partitionBy("run").text(path)
