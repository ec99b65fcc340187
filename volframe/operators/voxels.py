"""Volumes as rows of voxels: the preparation of volumes in DataFrame operations alone.

A row is a voxel inside the mask; all others are zero and have none. Orientation and the fit to a grid are arithmetic on a
row's coordinates, smoothing and spacing are weights that a voxel gives to its neighbours, summed by voxel. It is the same
preparation as operators.volumes, which does it with dense arrays in one job, for masks that fill little of their volume,
for grids that don't fit a task, and for what is to be joined and grouped by voxel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volframe.operators import geometry, values
from volframe.operators.volumes import VolumeSpec

AXES = ("x", "y", "z")


def unpacked(df: DataFrame, key: str, carried: Sequence[str] = ()) -> DataFrame:
    """(key, x, y, z, value, *carried): a row for each packed value (key, values, mask_rle, shape), at its voxel.

    The runs inside, laid end to end, are the voxels of the values in order, so both are unrolled together, row by row,
    without a shuffle. Runs that do not add up to the volume, or hold another number of voxels than there are values, are
    an error.
    """
    total = F.aggregate("mask_rle", F.lit(0).cast("long"), lambda a, n: a + n)
    voxels = F.aggregate("shape", F.lit(1).cast("long"), lambda a, n: a * n)
    inside = F.aggregate(F.filter("mask_rle", lambda n, i: i % 2 == 1), F.lit(0).cast("long"), lambda a, n: a + n)
    sound = F.when(total != voxels, F.raise_error(F.lit("run lengths do not add up to the volume"))).when(inside != F.size("values"), F.raise_error(F.lit("the mask has another number of voxels than there are values"))).otherwise(True)
    begins = F.expr("aggregate(mask_rle, named_struct('at', 0L, 'out', CAST(array() AS array<struct<at:bigint,n:bigint>>)), (a, n) -> named_struct('at', a.at + n, 'out', array_append(a.out, named_struct('at', a.at, 'n', n))), a -> a.out)")
    runs = df.where(sound).select(key, "values", "shape", *carried, begins.alias("_runs"))
    places = F.flatten(F.transform(F.filter("_runs", lambda r, i: (i % 2 == 1) & (r["n"] > 0)), lambda r: F.sequence(r["at"], r["at"] + r["n"] - 1)))
    rows = runs.select(key, "shape", *carried, F.inline(F.arrays_zip(places.alias("_voxel"), F.col("values").alias("value"))))
    y, z = F.col("shape")[1], F.col("shape")[2]
    return rows.select(key, F.floor(F.col("_voxel") / (y * z)).cast("int").alias("x"), (F.floor(F.col("_voxel") / z) % y).cast("int").alias("y"), (F.col("_voxel") % z).cast("int").alias("z"), "value", *carried)


def header_plan(df: DataFrame, key: str, spec: VolumeSpec) -> DataFrame:
    """(key, low, world_axis, direction, box, shape, new_shape, sigma, before, affine): how each volume's voxels move, from its
    header (key, mask_rle, shape, affine). low and box are the box's first voxel and shape before turning, shape is that
    after it, affine that of the grid. A row for each volume; each step's rows are dealt anew, so that its matrices are
    worked out once and not written out in those of the next."""
    narrow = df.select(key, "shape", "affine")
    if spec.crop:
        starts = ("x0", "y0", "z0")
        cut = geometry.crop_affine(narrow.join(values.mask_box(df, key, "mask_rle", "shape"), key), starts)
        size = F.array(*(F.col(f"{a}1") - F.col(f"{a}0") for a in AXES))
        narrow = cut.select(key, size.alias("shape"), F.col("cropped_affine").alias("affine"), F.array(*starts).alias("low"))
    else:
        narrow = narrow.withColumn("low", F.array(*[F.lit(0)] * 3))
    turned = geometry.reorient_affine(geometry.orientation(narrow)).select(key, "low", "world_axis", "direction", F.col("shape").alias("box"), F.col("reoriented_shape").alias("shape"), F.col("reoriented_affine").alias("affine")).repartition(key)
    spaced = geometry.resample_affine(geometry.spacing_plan(turned, spec.spacing)).repartition(key)
    moved = spaced.select(key, "low", "world_axis", "direction", "box", "sigma", F.col("shape").alias("old_shape"), F.col("new_shape").alias("shape"), F.col("resampled_affine").alias("affine"))
    placed = geometry.fit_plan(moved, spec.grid)
    return placed.select(key, "low", "world_axis", "direction", "box", F.col("old_shape").alias("shape"), F.col("shape").alias("new_shape"), "sigma", "before", F.col("fitted_affine").alias("affine"))


def moves(headers: DataFrame, key: str) -> DataFrame:
    """header_plan's rows in plain numbers, worked out once a volume and cheap to carry with its voxels: for each axis w of the
    world _from_w, the voxel axis that follows it, which gives _at_w + _sign_w * its coordinate; _old_w, _new_w and
    _sigma_w, how the axis is spaced anew; and _before_w. _moved: whether any axis is; _affine_ij: the affine."""
    turns, spaces = [], []
    for w in range(3):
        source = F.array_position("world_axis", F.lit(w)).cast("int") - 1
        of = lambda c, source=source: F.get(c, source)
        flipped = of("direction") < 0
        turns += [source.alias(f"_from_{w}"), F.when(flipped, of("box") - 1 + of("low")).otherwise(-of("low")).alias(f"_at_{w}"), F.when(flipped, -1).otherwise(1).alias(f"_sign_{w}")]
        spaces += [F.col(c)[w].alias(f"_{n}_{w}") for n, c in (("old", "shape"), ("new", "new_shape"), ("sigma", "sigma"), ("before", "before"))]
    same = (F.col("shape") == F.col("new_shape")) & F.forall("sigma", lambda s: s <= 0)
    return headers.select(key, *turns, *spaces, (~same).alias("_moved"), *(F.col("affine")[i][j].alias(f"_affine_{i}{j}") for i in range(4) for j in range(4)))


def turned(voxels: DataFrame) -> DataFrame:
    """voxels (x, y, z, moves) in their box, with the axes along the world's."""
    here = lambda w: F.when(F.col(f"_from_{w}") == 0, F.col("x")).when(F.col(f"_from_{w}") == 1, F.col("y")).otherwise(F.col("z"))
    new = [(F.col(f"_at_{w}") + F.col(f"_sign_{w}") * here(w)).cast("int").alias(a) for w, a in enumerate(AXES)]
    return voxels.select(*(c for c in voxels.columns if c not in AXES and not c.startswith(("_from_", "_at_", "_sign_"))), *new)


def _first(axis: int) -> str:
    return f"least(CAST(floor(c) AS INT), _old_{axis} - 1)"


def _reads(axis: int, at: str) -> str:
    """What voxel `at` gives to those of the new grid along an axis: (to, w, m). New voxel i reads (i + 0.5) s - 0.5, not below
    0, from the two voxels around it, s being the ratio of old to new shape; m is 1 where its mask is that of this voxel."""
    old, new = f"_old_{axis}", f"_new_{axis}"
    s = f"({old} / {new})"
    low = f"greatest(CAST(floor(({at} - 0.5D) / {s} - 0.5D) AS INT) - 1, 0)"
    high = f"least(greatest(CAST(ceil(({at} + 1.5D) / {s} - 0.5D) AS INT), CAST(ceil(({at} + 1) / {s}) AS INT)) + 1, {new} - 1)"
    c = f"greatest((i + 0.5D) * {s} - 0.5D, 0D)"
    weight = f"IF({_first(axis)} = {at}, 1 - (c - {_first(axis)}), 0D) + IF(least({_first(axis)} + 1, {old} - 1) = {at}, c - {_first(axis)}, 0D)"
    nearest = f"IF(least(CAST(floor((i + 0.5D) * {s}) AS INT), {old} - 1) = {at}, 1, 0)"
    each = f"transform(sequence({low}, greatest({low}, {high})), i -> named_struct('to', i, 'w', transform(array({c}), c -> {weight})[0], 'm', {nearest}))"
    return f"filter({each}, r -> (r.w <> 0 OR r.m = 1) AND r.to < {new})"


def _gives(axis: int) -> str:
    """What a voxel gives along an axis: (to, w, m). Itself where the axis stays; what the new grid reads of it; and where the
    image is smoothed first, what the grid reads of those around it that it gives to, while its mask stays its own."""
    a, sigma = AXES[axis], f"_sigma_{axis}"
    raw = f"transform(sequence(-CAST(ceil(3 * {sigma}) AS INT), CAST(ceil(3 * {sigma}) AS INT)), o -> named_struct('at', {a} + o, 'k', exp(-(o * o) / (2 * {sigma} * {sigma}))))"
    normed = f"transform(array({raw}), k -> transform(k, r -> named_struct('at', r.at, 'k', r.k / aggregate(k, 0D, (s, v) -> s + v.k))))[0]"
    smoothed = f"filter({normed}, r -> r.at >= 0 AND r.at < _old_{axis})"
    image = f"flatten(transform({smoothed}, t -> transform(filter({_reads(axis, 't.at')}, r -> r.w <> 0), r -> named_struct('to', r.to, 'w', r.w * t.k, 'm', 0))))"
    mask = f"transform(filter({_reads(axis, a)}, r -> r.m = 1), r -> named_struct('to', r.to, 'w', 0D, 'm', 1))"
    return f"CASE WHEN {sigma} > 0 THEN concat({image}, {mask}) WHEN _old_{axis} <> _new_{axis} THEN {_reads(axis, a)} ELSE array(named_struct('to', {a}, 'w', 1D, 'm', 1)) END"


def resampled(voxels: DataFrame, key: str) -> DataFrame:
    """voxels (key, x, y, z, value, moves) on the new shape: the smoothed image read linearly, inside the mask read from the
    nearest voxel. Axes are worked off one by one. What voxels give, of their values and of the mask, is summed by voxel;
    the mask's sum is 1 inside, as each new voxel reads it from one."""
    moved = voxels.withColumn("_mask", F.lit(1))
    for axis, a in enumerate(AXES):
        others = [c for c in moved.columns if c != a]
        rows = moved.select(*others, F.expr(f"inline({_gives(axis)})"))
        done = [f"_{n}_{axis}" for n in ("old", "new", "sigma")]
        carried = [c for c in moved.columns if c.startswith("_") and c not in ("_mask", *done)]  # numbers, which a sum by hash can hold
        rows = rows.select(key, *(c for c in AXES if c != a), F.col("to").alias(a), (F.col("value") * F.col("w")).alias("value"), (F.col("_mask") * F.col("m")).alias("_mask"), *carried)
        moved = rows.groupBy(key, *AXES).agg(F.sum("value").alias("value"), F.sum("_mask").alias("_mask"), *(F.first(c).alias(c) for c in carried))
    value = F.when(F.col("_moved"), F.coalesce("value", F.lit(0.0))).otherwise(F.col("value"))
    return moved.where(F.col("_mask") > 0).withColumn("value", value).drop("_mask", "_moved")


def fitted(voxels: DataFrame, key: str, grid: Sequence[int]) -> DataFrame:
    """(key, x, y, z, value, affine, shape): voxels (x, y, z, moves) moved to the grid, and dropped where they fall outside."""
    moved = voxels.withColumns({a: F.col(a) + F.col(f"_before_{i}") for i, a in enumerate(AXES)})
    within = F.lit(True)
    for a, n in zip(AXES, grid, strict=True):
        within &= F.col(a).between(0, n - 1)
    affine = F.array(*(F.array(*(F.col(f"_affine_{i}{j}") for j in range(4))) for i in range(4)))
    return moved.where(within).select(key, *AXES, "value", affine.alias("affine"), F.array(*map(F.lit, grid)).alias("shape"))


def prepare(df: DataFrame, key: str, spec: VolumeSpec) -> DataFrame:
    """(key, x, y, z, value, affine, shape): the voxels inside the mask of prepared volumes (key, values, scale, mask_rle, shape,
    affine), as volumes.prepare_volumes gives them in dense form. key must be unique. A volume's scores are ranked in one
    sort; its rows are ranked, and its header worked out, once."""
    rows = unpacked(df, key, ["scale"]).withColumn("value", F.col("value") * (F.col("scale") if spec.use_scale else F.lit(1.0))).drop("scale")
    scored = values.clipped_zscore(rows, key, "value", spec.quantiles, name="_score").drop("value").withColumnRenamed("_score", "value")
    placed = scored.join(moves(header_plan(df, key, spec), key), key)
    return fitted(resampled(turned(placed), key), key, spec.grid)
