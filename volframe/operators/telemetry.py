"""Run telemetry: meters over step logs, throughput, remaining time, budgets, restarts, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from volframe.functions.arrays import lower_median

WINDOW = 20


def updates(log: DataFrame, run: str, step: str, meters: Sequence[str]) -> DataFrame:
    """(run, step, metric, value) of the values that are there: a meter counts updates, not rows."""
    pairs = ", ".join(f"'{m}', CAST(`{m}` AS DOUBLE)" for m in meters)
    return log.select(run, step, F.expr(f"stack({len(meters)}, {pairs}) AS (metric, value)")).where("value IS NOT NULL")


def rolling_meters(log: DataFrame, run: str, step: str, meters: Sequence[str], window: int = WINDOW) -> DataFrame:
    """For each update of each meter: lower median, mean, maximum and latest value of the last `window` updates, and the
    mean of all so far. Frames are within (run, metric)."""
    by = Window.partitionBy(run, "metric").orderBy(step)
    last, ever = by.rowsBetween(1 - window, 0), by.rowsBetween(Window.unboundedPreceding, 0)
    return updates(log, run, step, meters).select(
        run, step, "metric", lower_median(F.collect_list("value").over(last)).alias("median"), F.avg("value").over(last).alias("avg"),
        F.max("value").over(last).alias("max"), F.col("value").alias("latest"), F.avg("value").over(ever).alias("global_avg"),
    )


def final_median(log: DataFrame, run: str, step: str, value: str, window: int = WINDOW) -> DataFrame:
    """(run, final): the lower median of a run's last values."""
    late = log.where(F.col(value).isNotNull()).withColumn("_r", F.row_number().over(Window.partitionBy(run).orderBy(F.desc(step)))).where(F.col("_r") <= window)
    return late.groupBy(run).agg(lower_median(F.collect_list(value)).alias("final"))


def throughput(log: DataFrame, run: str, step: str, ts: str, energy: str, every: int, units: float) -> DataFrame:
    """(run, window, steps, seconds, rate, watts) of each window of `every` steps.

    A window is measured from the end of the one before, the first from the run's first reading. rate is steps * units a
    second, watts from millijoules; null where no time passed or, for watts, where energy is missing.
    """
    w = F.floor((F.col(step) - 1) / every).cast("long")
    ends = log.groupBy(run, w.alias("window")).agg(F.count("*").alias("steps"), F.max(ts).alias("_t1"), F.max(energy).alias("_e1"), F.min(ts).alias("_t"), F.min(energy).alias("_e"))
    by = Window.partitionBy(run).orderBy("window")
    t0, e0 = F.coalesce(F.lag("_t1").over(by), F.col("_t")), F.coalesce(F.lag("_e1").over(by), F.col("_e"))
    seconds = (F.unix_micros("_t1") - F.unix_micros(t0)) / F.lit(1e6)
    return ends.withColumns({"seconds": seconds, "_e0": e0}).select(
        run, "window", "steps", "seconds", F.try_divide(F.col("steps") * F.lit(float(units)), F.col("seconds")).alias("rate"), F.try_divide((F.col("_e1") - F.col("_e0")) / 1000.0, F.col("seconds")).alias("watts")
    )


def timing(log: DataFrame, run: str, step: str, ts: str, total_steps: int) -> DataFrame:
    """(run, step, iteration_s, elapsed_s, eta_s): time since the step before, since the first, and what the mean so far
    leaves for the remaining steps, in whole seconds."""
    by = Window.partitionBy(run).orderBy(step)
    micros = F.unix_micros(ts)
    gap = (micros - F.lag(micros).over(by)) / F.lit(1e6)
    own = log.select(run, step, gap.alias("iteration_s"), ((micros - F.first(micros).over(by)) / F.lit(1e6)).alias("elapsed_s"))
    mean = F.avg("iteration_s").over(by.rowsBetween(Window.unboundedPreceding, 0))
    return own.withColumn("eta_s", F.floor(mean * F.greatest(F.lit(total_steps) - F.col(step), F.lit(0))).cast("long"))


def budget_cut(log: DataFrame, run: str, step: str, seconds: str, limit_s: float | None, total_steps: int | None = None) -> DataFrame:
    """The steps of each run up to the first at which its added-up seconds reach the limit, that one included, or the last
    of total_steps. Without a limit, or with 0, time does not end a run. wall_s has the seconds so far."""
    wall = F.sum(seconds).over(Window.partitionBy(run).orderBy(step).rowsBetween(Window.unboundedPreceding, 0))
    out = log.withColumn("wall_s", wall)
    if limit_s:
        out = out.where(F.col("wall_s") - F.col(seconds) < limit_s)
    return out.where(F.col(step) <= total_steps) if total_steps else out


def latest_attempt(log: DataFrame, run: str, step: str, *newest: str) -> DataFrame:
    """One row for each run and step: that of the last attempt, by the columns of newest, the greatest first."""
    row = F.max_by(F.struct(*log.columns), F.struct(*newest))
    return log.groupBy(F.col(run).alias("_run"), F.col(step).alias("_step")).agg(row.alias("_row")).select("_row.*")


def run_summary(log: DataFrame, run: str, step: str, loss: str, ts: str, batch_size: int, accumulation: int, dataset: int, flops_per_batch: float, total_steps: int) -> DataFrame:
    """(run, step, images, epochs, train_flops, final_loss, wall_seconds, done) of each run."""
    end = log.groupBy(run).agg(F.max(step).alias("step"), F.max_by(loss, step).alias("final_loss"), ((F.unix_micros(F.max(ts)) - F.unix_micros(F.min(ts))) / F.lit(1e6)).alias("wall_seconds"))
    images = F.col("step") * accumulation * batch_size
    return end.select(
        run, "step", images.alias("images"), (images / F.lit(float(dataset))).alias("epochs"), (F.col("step") * accumulation * F.lit(float(flops_per_batch))).alias("train_flops"),
        "final_loss", "wall_seconds", (F.col("step") >= total_steps).alias("done"),
    )


def thin(log: DataFrame, run: str, step: str, every: int) -> DataFrame:
    """Each every-th step and each run's last."""
    last = F.max(step).over(Window.partitionBy(run))
    return log.withColumn("_last", last).where((F.col(step) % every == 0) | (F.col(step) == F.col("_last"))).drop("_last")
