"""Header geometry: spacing, target shapes, orientation and affines, as column arithmetic over (shape, affine) rows."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volframe.functions.arrays import column_norms, floor_half, shift, times


def target_shape(shape: Column, spacing: Column, target: float) -> Column:
    """Voxels along each axis at the target spacing: the nearest whole number, half to even, at least 1."""
    return F.transform(F.zip_with(shape, spacing, lambda n, s: F.rint(n * s / F.lit(float(target)))), lambda n: F.greatest(n, F.lit(1.0)).cast("int"))


def smoothing_widths(spacing: Column, target: float) -> Column:
    """The Gaussian's width along each axis before sampling down; 0 where voxels do not grow."""
    return F.transform(spacing, lambda s: F.greatest(F.lit(0.0), (F.lit(float(target)) / s - 1) / 2))


def kernel(width: Column) -> Column:
    """Weights of a Gaussian from -ceil(3 width) to ceil(3 width), which add up to 1."""
    radius = F.ceil(width * 3).cast("int")
    raw = F.transform(F.sequence(-radius, radius), lambda o: F.when(width > 0, F.exp(-(o * o) / (F.lit(2.0) * width * width))).otherwise(1.0))
    return F.transform(raw, lambda w: w / F.aggregate(raw, F.lit(0.0), lambda a, x: a + x))


def spacing_plan(headers: DataFrame, target: float = 1.0) -> DataFrame:
    """headers with spacing, new_shape and sigma."""
    return headers.withColumn("spacing", column_norms(F.col("affine"))).withColumns({"new_shape": target_shape(F.col("shape"), F.col("spacing"), target), "sigma": smoothing_widths(F.col("spacing"), target)})


def resample_affine(headers: DataFrame) -> DataFrame:
    """headers (affine, shape, new_shape) with resampled_affine: voxel i of the new grid lies where old (i + 0.5) s - 0.5
    does, with s the ratio of old to new shape along an axis."""
    s = [F.col("shape")[j] / F.col("new_shape")[j] for j in range(3)]
    rows = [F.array(*((s[i] if i == j else F.lit(0.0)) for j in range(3)), s[i] * 0.5 - 0.5) for i in range(3)]
    scale = F.array(*rows, F.array(*(F.lit(x) for x in (0.0, 0.0, 0.0, 1.0))))
    return headers.withColumn("_scale", scale).withColumn("resampled_affine", times(F.col("affine"), F.col("_scale"))).drop("_scale")


def fit_plan(headers: DataFrame, grid: Sequence[int]) -> DataFrame:
    """headers (shape, affine) with before and after, the voxels to add at each end of each axis to fit the grid, negative
    where voxels are cut off, and fitted_affine."""
    more = [F.lit(g) - F.col("shape")[j] for j, g in enumerate(grid)]
    before = [floor_half(m) for m in more]
    plan = headers.withColumns({"before": F.array(*before), "after": F.array(*(m - b for m, b in zip(more, before, strict=True)))})
    return plan.withColumn("fitted_affine", times(F.col("affine"), shift(*(-F.col("before")[j] for j in range(3)))))


def crop_affine(headers: DataFrame, starts: Sequence[str]) -> DataFrame:
    """headers with cropped_affine, that of the box that begins at the columns starts."""
    return headers.withColumn("cropped_affine", times(F.col("affine"), shift(*(F.col(c) for c in starts))))


def axis_codes(affine: np.ndarray) -> list[tuple[int, int]]:
    """For each voxel axis the world axis it follows and its direction, 1 or -1, by the rotation nearest to the affine:
    pairs are taken greedily, the voxel axes in order of their strongest component. This is the public rule of nibabel's
    io_orientation, whose results are to be met."""
    turn = affine[:3, :3]
    zooms = np.sqrt((turn * turn).sum(0))
    zooms[zooms == 0] = 1
    p, s, qs = np.linalg.svd(turn / zooms, full_matrices=False)
    good = s > s.max() * 3 * np.finfo(float).eps
    r = p[:, good] @ qs[good]
    codes: list[tuple[int, int]] = [(0, 1)] * 3
    for axis in np.argsort(-(r * r).max(0), kind="stable"):
        world = int(np.argmax(np.abs(r[:, axis])))
        codes[axis] = world, -1 if r[world, axis] < 0 else 1
        r[world] = 0
    return codes


def orientation(headers: DataFrame) -> DataFrame:
    """headers with world_axis and direction of each voxel axis. A small matrix decomposition a row, in Arrow batches."""
    from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType

    new = [StructField(n, ArrayType(IntegerType())) for n in ("world_axis", "direction")]
    at = headers.columns.index("affine")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = [axis_codes(np.array(a, float)) for a in b.column(at).to_pylist()]
            lists = [pa.array([[c[k] for c in row] for row in codes], pa.list_(pa.int32())) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *lists], [*b.schema.names, "world_axis", "direction"])

    return headers.mapInArrow(run, StructType([*headers.schema.fields, *new]))


def reorient_affine(headers: DataFrame) -> DataFrame:
    """headers (shape, affine, world_axis, direction) with reoriented_affine and reoriented_shape: a flipped axis turns its
    column and moves the origin by its n - 1 steps, then axes go in the order of the world's. Every voxel stays in place."""
    a, n, d = F.col("affine"), F.col("shape"), F.col("direction")
    origin = lambda i: a[i][3] + sum((F.when(d[j] < 0, a[i][j] * (n[j] - 1)).otherwise(0.0) for j in range(3)), F.lit(0.0))
    flipped = F.array(*(F.array(*(F.when(d[j] < 0, -a[i][j]).otherwise(a[i][j]) for j in range(3)), origin(i)) for i in range(3)), a[3])
    where = F.transform(F.sequence(F.lit(0), F.lit(2)), lambda w: (F.array_position(F.col("world_axis"), w.cast("int")) - 1).cast("int"))
    out = headers.withColumns({"_flipped": flipped, "_where": where})
    f, w = F.col("_flipped"), F.col("_where")
    return out.withColumns({
        "reoriented_affine": F.array(*(F.array(*(F.get(f[i], w[j]) for j in range(3)), f[i][3]) for i in range(4))),
        "reoriented_shape": F.array(*(F.get(n, w[j]) for j in range(3))),
    }).drop("_flipped", "_where")
