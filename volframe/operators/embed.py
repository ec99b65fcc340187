"""Batch embedding of patch tables by encoders that users register."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from volframe.operators.patches import cut_patches, lists, scatter, touches_mask, whole_grid
from volframe.operators.volumes import PACKED, VolumeSpec, matrices, prepared, samples_of

#: The encoder that a Python worker has made, by the call that it serves.
_made: dict[str, Callable] = {}
#: Name -> factory(checkpoint) of an encoder: (pixels[N, P], coordinates[N, 3]) -> tokens[N + class tokens, D].
ENCODERS: dict[str, Callable] = {}


def register_encoder(name: str) -> Callable:
    """Make a factory known under a name."""

    def keep(factory: Callable) -> Callable:
        ENCODERS[name] = factory
        return factory

    return keep


@register_encoder("linear")
def linear(checkpoint: dict) -> Callable:
    """A fixed projection, checkpoint['weights'] of shape (P, D)."""
    weights = np.asarray(checkpoint["weights"], float)
    return lambda pixels, coordinates: pixels @ weights


def _made_for(run: str, factory: Callable, checkpoint) -> Callable:
    """The encoder of a call, made where this worker has not made it yet."""
    if run not in _made:
        _made.clear()
        _made[run] = factory(checkpoint.value)
    return _made[run]


def embed_images(patches: DataFrame, key: str, encoder: str, checkpoint, class_tokens: int = 0) -> DataFrame:
    """(key, patch_id, token) of the patches that touch the mask, encoded image by image.

    A Python worker makes the encoder once, from a checkpoint that is broadcast: its size is the model's, not the data's.
    An image's patches are encoded together, as many as it has. Its first class_tokens tokens are dropped.
    """
    spark = patches.sparkSession
    held, factory = spark.sparkContext.broadcast(checkpoint), ENCODERS[encoder]
    kind = patches.schema[key].dataType.simpleString()
    run = uuid.uuid4().hex

    def encode(group: pa.Table) -> pa.Table:
        t = group.sort_by("patch_id")
        own = t.column("pixels").combine_chunks()
        pixels = np.asarray(own.flatten().cast(pa.float64())).reshape(len(own), -1)
        at = np.stack([t.column(c).to_numpy() for c in ("gx", "gy", "gz")], 1)
        model = _made_for(run, factory, held)
        tokens = np.ascontiguousarray(np.asarray(getattr(model, "encode", model)(pixels, at), float)[class_tokens:])
        ends = np.arange(len(tokens) + 1, dtype=np.int32) * tokens.shape[1]
        return pa.table({key: t.column(key), "patch_id": t.column("patch_id"), "token": pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens.ravel()))})

    inside = patches.where(touches_mask(F.col("mask"))).select(key, "patch_id", "gx", "gy", "gz", "pixels")
    return inside.groupBy(key).applyInArrow(encode, f"`{key}` {kind}, patch_id int, token array<double>")


def pool_tokens(tokens: DataFrame, key: str, token: str = "token", class_tokens: int = 0, order: str = "patch_id") -> DataFrame:
    """(key, global_embedding): the mean of an image's tokens, dimension by dimension, without its first class_tokens."""
    rows = tokens
    if class_tokens:
        from pyspark.sql.window import Window

        rows = rows.withColumn("_n", F.row_number().over(Window.partitionBy(key).orderBy(order))).where(F.col("_n") > class_tokens)
    flat = rows.select(key, F.posexplode(token).alias("dim", "x")).groupBy(key, "dim").agg(F.avg("x").alias("x"))
    return flat.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("_v")).select(key, F.col("_v.x").alias("global_embedding"))


def dense_embedding(images: DataFrame, tokens: DataFrame, key: str, grid: Sequence[int], width: int) -> DataFrame:
    """(key, patch_id, token, inside) of every cell of the grid: the token where the image has one, else zeros."""
    return scatter(images, tokens, key, grid, "token", width, written="inside")


#: The record of an image's embedding, beside its key: dense parts are null where they were not asked for.
EMBEDDINGS = "global_embedding array<float>, dense_embedding array<array<float>>, dense_mask array<boolean>, dense_affine array<array<double>>"


def _record(tokens: np.ndarray, inside: np.ndarray, width: int, dense: bool) -> list[pa.Array]:
    """The first three fields of a record. tokens are those of the patches inside, in their order."""
    whole = pa.array([tokens.mean(0).astype(np.float32)] if len(tokens) else [None], pa.list_(pa.float32()))
    if not dense:
        return [whole, pa.nulls(1, pa.list_(pa.list_(pa.float32()))), pa.nulls(1, pa.list_(pa.bool_()))]
    cells = np.zeros((len(inside), width), np.float32)
    cells[inside] = tokens
    return [whole, pa.ListArray.from_arrays(pa.array([0, len(cells)], pa.int32()), lists(cells)), pa.array([inside])]


def embedding_records(images: DataFrame, tokens: DataFrame, key: str, grid: Sequence[int], width: int, dense: bool = True) -> DataFrame:
    """(key, EMBEDDINGS) of images (key, affine) from token rows (key, patch_id, token): the mean of the image's tokens, and
    the tokens in their cells of the grid, zeros elsewhere, with the cells that have one and the affine.

    An image's tokens meet once. An image without tokens has a null mean and empty cells. Several tokens of a cell are an
    error. images must be unique by key.
    """
    n, kind = int(np.prod(grid)), tokens.schema[key].dataType.simpleString()

    def build(group: pa.Table) -> pa.Table:
        t = group.sort_by("patch_id")
        ids, own = t.column("patch_id").to_numpy(), t.column("token").combine_chunks()
        inside = np.zeros(n, bool)
        inside[ids] = True
        if inside.sum() != len(ids):
            raise ValueError("a cell has several tokens")
        fields = _record(own.flatten().to_numpy().reshape(len(own), -1), inside, width, dense)
        return pa.Table.from_arrays([t.column(key).slice(0, 1), *fields], [key, "global_embedding", "dense_embedding", "dense_mask"])

    found = tokens.select(key, "patch_id", "token").groupBy(key).applyInArrow(build, f"`{key}` {kind}, {EMBEDDINGS.rsplit(', ', 1)[0]}")
    rows = images.select(key, "affine").join(found, key, "left")
    if not dense:
        return rows.select(key, "global_embedding", "dense_embedding", "dense_mask", F.lit(None).cast("array<array<double>>").alias("dense_affine"))
    empty = F.array_repeat(F.array_repeat(F.lit(0.0).cast("float"), width), n), F.array_repeat(F.lit(False), n)
    return rows.select(key, "global_embedding", F.coalesce("dense_embedding", empty[0]).alias("dense_embedding"), F.coalesce("dense_mask", empty[1]).alias("dense_mask"), F.col("affine").alias("dense_affine"))


def embed_volumes(df: DataFrame, key: str, spec: VolumeSpec, edge: int, encoder: str, checkpoint, class_tokens: int = 0, dense: bool = True) -> DataFrame:
    """(key, EMBEDDINGS) of packed volumes (key, values, scale, mask_rle, shape, affine): prepared, cut in patches, the
    patches that touch the mask encoded together, pooled and put in their cells. One job without a shuffle: an image's
    patches never leave the task that unpacked it.

    An encoder is a function (pixels, coordinates) -> tokens, or an object whose `encode` is that and whose `prepare`, if it
    has one, takes and gives the prepared (image, mask, affine) first. A Python worker makes it once.
    """
    grid = whole_grid(spec.grid, edge)
    kind, run = df.schema[key].dataType.simpleString(), uuid.uuid4().hex
    held, factory = df.sparkSession.sparkContext.broadcast(checkpoint), ENCODERS[encoder]
    at = np.stack(np.unravel_index(np.arange(int(np.prod(grid))), grid), 1)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _made_for(run, factory, held)
        encode, prepare = getattr(model, "encode", model), getattr(model, "prepare", None)
        for b in batches:
            for i, s in enumerate(samples_of(b)):
                image, mask, affine = prepared(s["values"], s["scale"], s["mask_rle"], s["shape"], s["affine"], spec)
                if prepare:
                    image, mask, affine = prepare(image, mask, affine)
                inside = (cut_patches(mask, grid, edge) > 0).any(1)
                tokens = np.asarray(encode(cut_patches(image, grid, edge)[inside], at[inside]))[class_tokens:]
                fields = _record(tokens, inside, tokens.shape[1], dense)
                affines = matrices([affine]) if dense else pa.nulls(1, pa.list_(pa.list_(pa.float64())))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), *fields, affines], ["key", *(f.split()[0] for f in EMBEDDINGS.split(", "))])

    return df.select(key, *PACKED).mapInArrow(work, f"key {kind}, {EMBEDDINGS}").withColumnRenamed("key", key)


def write_embeddings(df: DataFrame, path: str, key: str, buckets: int = 64) -> None:
    """Records below path, in folders by a hash of the key. Only the folders that df has rows of are replaced, each as a
    whole, so that writing the same records again, after a failure say, changes nothing."""
    by = df.withColumn("bucket", F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int"))
    by.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(path)
