"""The patch table: volumes as rows of patches, and what is done with them."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A patch with at least this share of its voxels in the mask may be sampled before others.
LEAST_FRACTION = 0.25
VIEWS = {"sag": 0, "cor": 1, "ax": 2}
GRAY = 0.5


def coordinates(patch_id: Column, grid: Sequence[int]) -> dict[str, Column]:
    """gx, gy, gz of a patch number on a grid whose last axis runs fastest."""
    _, y, z = grid
    return {"gx": F.floor(patch_id / (y * z)).cast("int"), "gy": (F.floor(patch_id / z) % y).cast("int"), "gz": (patch_id % z).cast("int")}


def lattice(spark, grid: Sequence[int]) -> DataFrame:
    """(patch_id, gx, gy, gz) of every patch of a grid."""
    x, y, z = grid
    return spark.range(x * y * z).select(F.col("id").cast("int").alias("patch_id"), *(c.alias(n) for n, c in coordinates(F.col("id"), grid).items()))


def cut_patches(dense: np.ndarray, grid: Sequence[int], edge: int) -> np.ndarray:
    """[patch, pixel] of a dense volume in C order, which is a multiple of the edge along each axis."""
    gx, gy, gz = grid
    return dense.reshape(gx, edge, gy, edge, gz, edge).transpose(0, 2, 4, 1, 3, 5).reshape(gx * gy * gz, edge**3)


def whole_grid(shape: Sequence[int], edge: int) -> tuple[int, ...]:
    """Patches along each axis; shape must be a multiple of edge."""
    if any(n % edge for n in shape):
        raise ValueError("shape must be a multiple of the patch edge")
    return tuple(n // edge for n in shape)


def lists(m: np.ndarray) -> pa.ListArray:
    """The rows of a matrix as lists, over its own buffer."""
    return pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1]), pa.array(np.ascontiguousarray(m).ravel()))


def ragged(arrays: Sequence[np.ndarray]) -> pa.ListArray:
    """Flat arrays of one type as lists, over one buffer."""
    offsets = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(arrays)))


def patchify(df: DataFrame, key: str, image: str, mask: str, shape: Sequence[int], edge: int, blocks: int = 4096) -> DataFrame:
    """(key, patch_id, gx, gy, gz, pixels, mask) from dense arrays in C order; shape is one for all rows.

    One Arrow job, a volume at a time. shape must be a multiple of edge. Pixels are floats where the image's are, else
    doubles; the mask is one float for each pixel.
    """
    grid = whole_grid(shape, edge)
    kind = df.schema[key].dataType.simpleString()
    single = df.schema[image].dataType.elementType.simpleString() == "float"
    pixel = "float" if single else "double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = np.arange(int(np.prod(grid)))
        at = np.stack(np.unravel_index(number, grid), 1).astype(np.int32)
        for b in batches:
            for i in range(b.num_rows):
                pixels, inside = (cut_patches(b.column(j)[i].values.to_numpy(), grid, edge) for j in (1, 2))
                for a in range(0, len(number), blocks):
                    z = slice(a, a + blocks)
                    own = b.column(0).take(pa.array(np.full(len(number[z]), i)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(number[z].astype(np.int32)), *(pa.array(at[z, j]) for j in range(3)), lists(pixels[z]), lists(inside[z])], ["key", "patch_id", "gx", "gy", "gz", "pixels", "mask"])

    rows = df.select(F.col(key), F.col(image).cast(f"array<{pixel}>"), F.col(mask).cast("array<float>"))
    return rows.mapInArrow(run, f"key {kind}, patch_id int, gx int, gy int, gz int, pixels array<{pixel}>, mask array<float>").withColumnRenamed("key", key)


def unpatchify(patches: DataFrame, key: str, pixels: str, grid: Sequence[int], edge: int) -> DataFrame:
    """(key, image): dense arrays in C order of patch rows; a patch that is absent is zero. Patch numbers must be unique."""
    gx, gy, gz = grid
    kind = patches.schema[key].dataType.simpleString()

    def build(group: pa.Table) -> pa.Table:
        ids = group.column("patch_id").to_numpy()
        if len(np.unique(ids)) != len(ids):
            raise ValueError("a patch occurs twice")
        out = np.zeros((gx * gy * gz, edge**3))
        out[ids] = group.column(pixels).combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        flat = out.reshape(gx, gy, gz, edge, edge, edge).transpose(0, 3, 1, 4, 2, 5).ravel()
        return pa.table({key: group.column(key).slice(0, 1), "image": lists(flat[None])})

    return patches.select(key, "patch_id", pixels).groupBy(key).applyInArrow(build, f"`{key}` {kind}, image array<double>")


def mask_fraction(mask: Column) -> Column:
    """The share of a patch that lies in the mask; null for an empty patch."""
    return F.try_divide(F.aggregate(mask, F.lit(0.0), lambda a, m: a + m.cast("double")), F.size(mask))


def touches_mask(mask: Column) -> Column:
    """Whether any voxel lies in the mask, the rule for embedding; sampling asks for LEAST_FRACTION."""
    return F.exists(mask, lambda m: m > 0)


def eligible_counts(patches: DataFrame, keys: Sequence[str], fraction: str = "mask_frac") -> DataFrame:
    return patches.groupBy(*keys).agg(F.count_if(F.col(fraction) >= LEAST_FRACTION).alias("eligible"))


def sequence_length(patches: DataFrame, batch: str, key: str, fraction: str = "mask_frac") -> DataFrame:
    """(batch, seq_length): the largest number of eligible patches of an image of the batch."""
    return eligible_counts(patches, [batch, key], fraction).groupBy(batch).agg(F.max("eligible").alias("seq_length"))


def sample_order(seed: int, *parts: Column) -> Column:
    """A draw for each row that is the same in every run: the MD5 of seed and parts."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *(p.cast("string") for p in parts)))


def replicate(df: DataFrame, samples: int) -> DataFrame:
    """df with each row once for each sample number."""
    return df.withColumn("sample", F.explode(F.sequence(F.lit(0), F.lit(samples - 1))))


def sample_patches(patches: DataFrame, key: str, samples: int, length: int, visible: int, seed: int = 0, fraction: str = "mask_frac") -> DataFrame:
    """(key, sample, rank, patch_id, role): for each image and sample, `length` patches in random order.

    Eligible patches come first, others fill up where there are too few. The first `visible` are visible, the rest
    targets. The ranking is within (image, sample), whose rows are an image's patches, and stops at `length`.
    """
    drawn = replicate(patches.select(key, "patch_id", fraction), samples)
    ranked = drawn.withColumn("rank", F.row_number().over(_draw([key], seed, fraction))).where(F.col("rank") <= length)
    return ranked.select(key, "sample", "rank", "patch_id", _role(visible))


def _draw(keys: Sequence[str], seed: int, fraction: str):
    """The order in which an image's patches are taken: eligible ones first, then by draw. The last of keys is the image."""
    first = F.when(F.col(fraction) >= LEAST_FRACTION, 0).otherwise(1)
    return Window.partitionBy(*keys, "sample").orderBy(first, sample_order(seed, F.col(keys[-1]), F.col("sample"), F.col("patch_id")), "patch_id")


def _role(visible: int) -> Column:
    return F.when(F.col("rank") <= visible, "visible").otherwise("target").alias("role")


def sample_batches(patches: DataFrame, batch: str, key: str, samples: int, visible: int, seed: int = 0, fraction: str = "mask_frac") -> DataFrame:
    """(batch, key, sample, rank, patch_id, role, seq_length): sample_patches with the length that each batch needs, its
    largest number of eligible patches of an image; of images with fewer, others fill up, as far as they have any.

    The rows meet once, by batch and image: the counts and the ranking both start from there. The lengths are a row for
    each batch; Spark broadcasts them where they are few and joins by batch where they are not. A batch without eligible
    patches has no rows. Rows with a null batch are a batch, and a null image is an image.
    """
    own = patches.select(batch, key, "patch_id", fraction).repartition(batch, key)
    eligible = own.groupBy(batch, key).agg(F.count_if((F.col(fraction) >= LEAST_FRACTION) & F.col("patch_id").isNotNull()).alias("_n"))
    lengths = eligible.groupBy(F.col(batch).alias("_batch")).agg(F.max("_n").cast("int").alias("seq_length"))
    ranked = replicate(own, samples).withColumn("rank", F.row_number().over(_draw([batch, key], seed, fraction)))
    kept = ranked.join(lengths, F.col(batch).eqNullSafe(F.col("_batch"))).where(F.col("rank") <= F.col("seq_length"))
    return kept.select(batch, key, "sample", "rank", "patch_id", _role(visible), "seq_length")


def gather(samples: DataFrame, patches: DataFrame, key: str) -> DataFrame:
    """The sampled patches with their pixels, masks and coordinates."""
    return samples.join(patches, [key, "patch_id"])


def one_writer(patches: DataFrame, key: str, payload: str, by: Sequence[str] = (), reduce: str = "last") -> DataFrame:
    """(key, patch_id, payload) with one row for each patch, from rows of which several may write the same patch.

    reduce "last" keeps the writer with the greatest `by` (columns, compared in turn; ties and no columns: the greatest
    payload), "first" that with the smallest, "mean" takes the mean of all writers, pixel by pixel. Rows without a
    payload write nothing. All are aggregates with a partial step, so a patch with very many writers is not gathered.
    """
    some = patches.where(F.col(payload).isNotNull())
    if reduce == "mean":
        kind = patches.schema[payload].dataType.elementType.simpleString()
        flat = some.select(key, "patch_id", F.posexplode(payload).alias("_i", "_x")).groupBy(key, "patch_id", "_i").agg(F.avg("_x").alias("_x"))
        rows = flat.groupBy(key, "patch_id").agg(F.array_sort(F.collect_list(F.struct("_i", "_x"))).alias("_v"))
        return rows.select(key, "patch_id", F.col("_v._x").cast(f"array<{kind}>").alias(payload))
    if reduce not in ("first", "last"):
        raise ValueError("reduce must be first, last or mean")
    take = F.max if reduce == "last" else F.min
    return some.groupBy(key, "patch_id").agg(take(F.struct(*by, F.col(payload).alias("_payload"))).alias("_row")).select(key, "patch_id", F.col("_row._payload").alias(payload))


def scatter(images: DataFrame, patches: DataFrame, key: str, grid: Sequence[int], payload: str, width: int, written: str | None = None) -> DataFrame:
    """(key, patch_id, payload) of every patch of the grid for every image; zeros where the patch is absent. written: the
    name of a column that says whether the patch is there.

    images: key. patches: (key, patch_id, payload), unique by key and patch; see one_writer for those that are not.
    """
    every = images.select(key).withColumn("patch_id", F.explode(F.sequence(F.lit(0), F.lit(int(np.prod(grid)) - 1))))
    found = every.join(patches.select(key, "patch_id", payload), [key, "patch_id"], "left")
    kind = patches.schema[payload].dataType.simpleString()
    if written:
        found = found.withColumn(written, F.col(payload).isNotNull())
    return found.withColumn(payload, F.coalesce(payload, F.array_repeat(F.lit(0.0), width).cast(kind)))


def state(samples: DataFrame, patches: DataFrame, predicted: DataFrame, key: str) -> DataFrame:
    """What a pass looked at, for inspection: (key, image_id, sample, rank, patch_id, role, gx, gy, gz, pixels, mask, predicted).

    A row for each sampled patch with its pixels and mask; predicted is null for visible patches and for targets that
    nothing was predicted for. image_id numbers the images by key, from 0: the samples of an image share it. predicted:
    (key, sample, patch_id, predicted). Ids come from ranges of the key, not from one sort of all images.
    """
    from volframe.operators.ordering import with_ordinal

    ids = with_ordinal(samples.select(key).distinct(), key, name="image_id")
    rows = gather(samples, patches, key).join(predicted.select(key, "sample", "patch_id", "predicted"), [key, "sample", "patch_id"], "left").join(ids, key)
    shown = F.when(F.col("role") == "target", F.col("predicted"))
    return rows.select(key, "image_id", "sample", "rank", "patch_id", "role", "gx", "gy", "gz", "pixels", "mask", shown.alias("predicted"))


def rebuilt(cells: DataFrame, key: str, payload: str) -> DataFrame:
    """(key, cells): the payloads of each image in patch order."""
    return cells.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("patch_id", payload))).alias("_c")).select(key, F.col("_c")[payload].alias("cells"))


def masked_mse(pairs: DataFrame, keys: Sequence[str], predicted: str, target: str, mask: str) -> DataFrame:
    """(keys, loss): the masked squared error of all voxels over the mask's sum, a ratio of sums; null where that is 0."""
    parts = F.zip_with(F.arrays_zip(F.col(predicted).alias("p"), F.col(target).alias("t")), F.col(mask), lambda v, m: m * F.pow(v["p"] - v["t"], F.lit(2)))
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    return pairs.groupBy(*keys).agg(F.sum(add(parts)).alias("_s"), F.sum(add(F.col(mask))).alias("_m")).select(*keys, F.when(F.col("_m") > 0, F.col("_s") / F.col("_m")).alias("loss"))


def center_slice(patches: DataFrame, view: str, shape: Sequence[int], edge: int, pixels: str = "pixels") -> DataFrame:
    """patches of the middle slice of a view, with only that slice's pixels."""
    axis, (_, _, _) = VIEWS[view], shape
    middle = shape[axis] // 2
    inside, stride = middle % edge, edge ** (2 - axis)
    keep = patches.where(F.col(("gx", "gy", "gz")[axis]) == middle // edge)
    return keep.withColumn(pixels, F.filter(pixels, lambda v, i: F.floor(i / stride) % edge == inside))


def panels(cells: DataFrame, image: str, predicted: str, in_mask: str, is_visible: str, is_predicted: str, background: float = 0.0) -> DataFrame:
    """cells (a row for each voxel) with the three panels of a comparison: what the model saw, what it made, the original.

    Seen: the image where visible and in the mask, gray where hidden, background outside. Made: the prediction where it
    was predicted in the mask, the image elsewhere in the mask. Original: the image in the mask.
    """
    m, v, p = (F.col(c) for c in (in_mask, is_visible, is_predicted))
    out = F.lit(background)
    return cells.withColumns({
        "panel_visible": F.when(~m, out).when(v, F.col(image)).otherwise(F.lit(GRAY)),
        "panel_predicted": F.when(~m, out).when(p, F.col(predicted)).otherwise(F.col(image)),
        "panel_original": F.when(m, F.col(image)).otherwise(out),
    })
