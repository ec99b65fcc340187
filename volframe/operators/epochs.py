"""Epoch plans: shuffled passes over items, batches, and where to go on after a stop."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def epoch_plan(items: DataFrame, key: str, seed: int, epochs: int, batch_size: int, start: int = 0, first_epoch: int = 0) -> DataFrame:
    """(pos, epoch, key, batch) of `epochs` passes from position start on; every pass is a permutation of the items.

    Within an epoch items go by the MD5 of seed, epoch and key, then by key, so a plan is the same whenever it is made
    and its tail is the plan from there. Positions come from a range-partitioned sort: ranks within each range are added
    to the sizes of the ranges before it, so an epoch of very many items is not numbered by one task.
    """
    spark = items.sparkSession
    n = items.count()
    passes = spark.range(first_epoch, first_epoch + epochs).select(F.col("id").cast("int").alias("epoch"))
    drawn = items.select(key).crossJoin(F.broadcast(passes)).withColumn("_draw", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"), F.col(key))))
    bucket = F.conv(F.substring("_draw", 1, 3), 16, 10).cast("int")  # 4096 ranges of the draw
    own = drawn.withColumn("_bucket", bucket)
    sizes = own.groupBy("epoch", "_bucket").count()
    before = sizes.select("epoch", "_bucket", F.coalesce(F.sum("count").over(Window.partitionBy("epoch").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    ranked = own.withColumn("_rank", F.row_number().over(Window.partitionBy("epoch", "_bucket").orderBy("_draw", key)))
    pos = (F.col("epoch").cast("long") * n + F.col("_before") + F.col("_rank") - 1).cast("long")
    plan = ranked.join(before, ["epoch", "_bucket"]).select(pos.alias("pos"), "epoch", key)
    return plan.where(F.col("pos") >= start).withColumn("batch", F.floor(F.col("pos") / batch_size).cast("long"))


def resume_position(step: int, accumulation: int, batch_size: int) -> int:
    """The position of the first item that a run stopped after `step` updates has not seen."""
    return step * accumulation * batch_size


def examples(plan: DataFrame, batch_size: int, n: int) -> DataFrame:
    """The first n items of each batch."""
    return plan.where(F.col("pos") % batch_size < n)
