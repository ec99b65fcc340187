"""Statistics of packed in-mask values, run-length masks, and the relational form of packing and unpacking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from volframe.functions.arrays import clip

QUANTILES = (0.005, 0.995)
LEAST_STD = 1e-6


def clipped_zscore(df: DataFrame, group: str, value: str, quantiles: tuple[float, float] = QUANTILES, name: str = "z") -> DataFrame:
    """df with each value's z-score in its group, after clipping at two nearest-rank cut points.

    With n values in ascending order the cut points stand at the 0-based ranks q * (n - 1), rounded half to even. Mean
    and population deviation are of the clipped values; the deviation is at least 1e-6. Nulls have no part and get null.
    NaN is an error. A group's values are ranked by one sort of (group, value), which spills; groups are images, so one
    group is bounded by an image's voxels.
    """
    sound = F.when(F.isnan(value), F.raise_error(F.lit(f"{value} must not be NaN"))).otherwise(F.col(value).cast("double"))
    ranked = df.withColumn("_v", sound).withColumn("_rank", F.row_number().over(Window.partitionBy(group).orderBy(F.col("_v").asc_nulls_last())))
    whole = Window.partitionBy(group)
    with_n = ranked.withColumn("_n", F.count("_v").over(whole))
    cut = lambda q: F.min(F.when(F.col("_rank") == 1 + F.rint(F.lit(q) * (F.col("_n") - 1)).cast("long"), F.col("_v"))).over(whole)
    cuts = with_n.withColumns({"_low": cut(quantiles[0]), "_high": cut(quantiles[1])})
    clipped = cuts.withColumn("_c", F.when(F.col("_v").isNotNull(), clip(F.col("_v"), F.col("_low"), F.col("_high"))))
    z = (F.col("_c") - F.avg("_c").over(whole)) / F.greatest(F.stddev_pop("_c").over(whole), F.lit(LEAST_STD))
    return clipped.withColumn(name, z).drop("_v", "_rank", "_n", "_low", "_high", "_c")


def rle_runs(df: DataFrame, key: str, lengths: str, *carried: str) -> DataFrame:
    """(key, run, start, length, inside): the runs of an alternating run-length mask, false first, and where each begins;
    and the columns carried. With some of these, a mask without runs has one row of a null run."""
    explode = F.posexplode_outer if carried else F.posexplode
    runs = df.select(key, *carried, explode(lengths).alias("run", "length"))
    before = Window.partitionBy(key).orderBy("run").rowsBetween(Window.unboundedPreceding, 0)
    return runs.select(key, "run", (F.sum("length").over(before) - F.col("length")).alias("start"), "length", (F.col("run") % 2 == 1).alias("inside"), *carried)


def checked_mask(lengths: Column, voxels: Column) -> Column:
    """The mask of runs whose lengths must add up to the number of voxels."""
    from volframe.functions.arrays import run_mask

    total = F.aggregate(lengths, F.lit(0).cast("long"), lambda a, n: a + n)
    return F.when(total == voxels, run_mask(lengths)).otherwise(F.raise_error(F.lit("run lengths do not add up to the volume")))


def mask_scatter(df: DataFrame, key: str, lengths: str, values: str, scale: str) -> DataFrame:
    """(key, voxel, value): the i-th packed value, times scale, at the i-th voxel inside; zero at all others.

    The plain relational form, for checks and small volumes. Volumes of full size are unpacked within prepare_volumes.
    """
    voxels = df.select(key, values, scale, F.posexplode(checked_mask(F.col(lengths), F.aggregate(F.col(lengths), F.lit(0).cast("long"), lambda a, n: a + n))).alias("voxel", "_in"))
    nth = F.sum(F.col("_in").cast("int")).over(Window.partitionBy(key).orderBy("voxel").rowsBetween(Window.unboundedPreceding, 0))
    value = F.when(F.col("_in"), F.coalesce(F.get(F.col(values), F.col("_nth") - 1) * F.col(scale), F.lit(0.0))).otherwise(0.0)
    return voxels.withColumn("_nth", nth.cast("int")).select(key, F.col("voxel").cast("long").alias("voxel"), value.alias("value"))


def mask_box(df: DataFrame, key: str, lengths: str, shape: str) -> DataFrame:
    """(key, x0, x1, y0, y1, z0, z1): the first voxel inside and the one after the last, by axis.

    Computed from runs, and from their whole rows and planes, not from voxels: one shuffle, by key. An empty mask is an
    error.
    """
    runs = rle_runs(df.select(key, lengths, shape), key, lengths, shape)
    within = F.col("inside") & (F.col("length") > 0)
    y_size, z_size = F.col(shape)[1], F.col(shape)[2]
    first, last = F.col("start"), F.col("start") + F.col("length") - 1
    plane, line = y_size * z_size, z_size
    x = lambda v: F.floor(v / plane)
    y = lambda v: F.floor((v % plane) / line)
    full_plane, full_line = x(first) != x(last), F.floor(first / line) != F.floor(last / line)
    low_y, high_y = F.when(full_plane, 0).otherwise(y(first)), F.when(full_plane, y_size - 1).otherwise(y(last))
    low_z, high_z = F.when(full_line, 0).otherwise(first % line), F.when(full_line, z_size - 1).otherwise(last % line)
    low, high = (lambda v: F.min(F.when(within, v))), (lambda v: F.max(F.when(within, v)) + 1)
    boxes = runs.groupBy(key).agg(low(x(first)).alias("x0"), high(x(last)).alias("x1"), low(low_y).alias("y0"), high(high_y).alias("y1"), low(low_z).alias("z0"), high(high_z).alias("z1"))
    none = F.when(F.col("x0").isNull(), F.raise_error(F.lit("mask is empty"))).otherwise(F.col("x0"))
    return boxes.select(key, none.cast("int").alias("x0"), *(F.col(c).cast("int").alias(c) for c in ("x1", "y0", "y1", "z0", "z1")))
