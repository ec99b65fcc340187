"""Registered queries over volumes: shard files, manifests, ordered lists, patches, geometry and embedding records."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volframe.operators import curate, embed, geometry, ordering, patches, values, volumes, voxels
from volframe.plans import fixtures as fx
from volframe.plans.queries import _FRAC2_SQL, _HEAD_SQL, _SAMPLE_SQL, _TOKEN_SQL, ORACLE_SQL, WEIGHTS, _flat, _headers, _patches, _samples, _tokens, _total, query, rounded
from volframe.plans.scratch import scratch_path
from volframe.sources import manifests, shards

# Manifests, ordered lists and shard files


@query(f"WITH {fx.CHECKED_SQL} SELECT path, collection, subject, sequence FROM fin WHERE rn = 1")
def manifest_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The selection from a manifest of many files that was checked against its declared schema."""
    at = scratch_path(spark, "manifest")
    manifests.write_manifest(fx.images(spark, sf_dir).repartition("collection"), at)
    return curate.selected(manifests.read_manifest(spark, at)).select("path", "collection", "subject", "sequence")


_LIST_SQL = f"WITH {fx.CHECKED_SQL}, l AS (SELECT {fx.DERIVED_SQL} AS path FROM fin WHERE rn = 1) SELECT row_number() OVER (ORDER BY path) - 1 AS ordinal, path FROM l"


@query(_LIST_SQL)
def ordered_filelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = scratch_path(spark, "filelist")
    curate.write_filelist(curate.selected(fx.images(spark, sf_dir)), at)
    return spark.read.parquet(f"{at}/list").select("ordinal", F.col("value").alias("path"))


@query(_LIST_SQL)
def filelist_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The list's text, in parts, read back with its places."""
    at = scratch_path(spark, "filelist")
    curate.write_filelist(curate.selected(fx.images(spark, sf_dir)), at)
    return shards.read_filelist(spark, f"{at}/text")


@query(f"WITH {fx.IMAGES_SQL}, t AS (SELECT n_chars, doc_id, path FROM fx_images) SELECT doc_id, n_chars, row_number() OVER (ORDER BY n_chars, doc_id) - 1 AS place FROM t")
def global_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ordering.with_ordinal(fx.images(spark, sf_dir).select("doc_id", "n_chars"), "n_chars", "doc_id", name="place")


_MEMBER_SQL = f"""WITH {fx.VOXELS_SQL}, r AS (SELECT path, i, m, CASE WHEN i = 0 THEN m::INT + 1 ELSE (m <> lag(m) OVER (PARTITION BY path ORDER BY i))::INT END AS d FROM vox)
SELECT path, count(*) FILTER (m) AS n_values, sum(CASE WHEN m THEN round_even(v * 1000, 0)::INT END)::BIGINT AS value_sum, 0.001::DOUBLE AS scale, sum(d)::INT AS n_runs, 64::BIGINT AS voxels
FROM vox JOIN r USING (path, i, m) GROUP BY path"""


def _stored(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, str]:
    """The volumes in shard files: their index, and where they are."""
    root, at = scratch_path(spark, "shards"), scratch_path(spark, "index")
    shards.write_members(fx.volumes(spark, sf_dir), root).write.parquet(at)
    return shards.read_index(spark, at), root


def _member_rows(df: DataFrame) -> DataFrame:
    whole = lambda c: F.aggregate(c, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.select("path", F.size("values").cast("long").alias("n_values"), whole("values").alias("value_sum"), "scale", F.size("mask_rle").alias("n_runs"), whole("mask_rle").alias("voxels"))


@query(_MEMBER_SQL)
def shard_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members through the data source, in stretches small enough that a shard is several."""
    index, root = _stored(spark, sf_dir)
    return _member_rows(shards.load_shards(index, root, ("path", "values", "scale", "mask_rle"), range_bytes=32_000))


@query(_MEMBER_SQL)
def listed_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Members of an ordered list, found in the index and read from their shards."""
    index, root = _stored(spark, sf_dir)
    listed = ordering.with_ordinal(index.select("path"), "path")
    return _member_rows(shards.read_members(shards.strict_lookup(listed, index), root))


# Patches


@query(f"""WITH {_FRAC2_SQL}, b AS (SELECT fr.*, substring(path, 5)::BIGINT // 32 AS batch FROM fr), n AS (SELECT batch, path, count(*) FILTER (frac >= 0.25) AS k FROM b GROUP BY 1, 2),
k AS (SELECT batch, max(k)::INT AS seq_length FROM n GROUP BY 1),
rk AS (SELECT batch, path, sample, patch_id, row_number() OVER (PARTITION BY batch, path, sample ORDER BY CASE WHEN frac >= 0.25 THEN 0 ELSE 1 END, md5('0:' || path || ':' || sample || ':' || patch_id), patch_id) AS rank FROM b, (SELECT unnest([0, 1]) AS sample))
SELECT batch, path, sample::INT AS sample, rank::INT AS rank, patch_id::INT AS patch_id, CASE WHEN rank <= 2 THEN 'visible' ELSE 'target' END AS role, seq_length FROM rk JOIN k USING (batch) WHERE rank <= seq_length""")
def batch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences as long as each batch of 32 images needs them."""
    p = _patches(spark, sf_dir, 0.1).withColumn("batch", F.floor(F.substring("path", 5, 20).cast("long") / 32))
    return patches.sample_batches(p, "batch", "path", samples=2, visible=2)


@query(f"""WITH {_SAMPLE_SQL}, w AS (SELECT path, patch_id, arg_max(CASE WHEN sample = 1 THEN -total ELSE total END, sample) AS total FROM smp GROUP BY 1, 2), c AS (SELECT DISTINCT path, patch_id::INT AS patch_id FROM fr)
SELECT path, patch_id, (round(coalesce(total, 0) + 1e-9, 6) + 0.0) AS pixel_sum FROM c LEFT JOIN w USING (path, patch_id)""")
def scatter_writers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patches that both samples of an image drew, the later sample's negated: the later one is what stays."""
    p = _patches(spark, sf_dir, 0.1)
    drawn = patches.gather(_samples(p), p, "path").withColumn("pixels", F.when(F.col("sample") == 1, F.transform("pixels", lambda x: -x)).otherwise(F.col("pixels")))
    one = patches.one_writer(drawn, "path", "pixels", by=("sample", "rank"))
    cells = patches.scatter(fx.volumes(spark, sf_dir).select("path"), one, "path", (2, 2, 2), "pixels", 8)
    return rounded(cells.select("path", "patch_id", F.aggregate("pixels", F.lit(0.0), lambda a, x: a + x).alias("pixel_sum")), "pixel_sum")


@query(f"""WITH {_SAMPLE_SQL}, ids AS (SELECT path, row_number() OVER (ORDER BY path) - 1 AS image_id FROM (SELECT DISTINCT path FROM smp)), px AS (SELECT path, patch_id, sum(round(v, 1)) AS p FROM vox GROUP BY 1, 2)
SELECT path, image_id, sample, rank, patch_id, role, (round(total + 1e-9, 6) + 0.0) AS pixel_sum, (round(CASE WHEN role = 'target' AND rank <= 4 THEN p END + 1e-9, 6) + 0.0) AS predicted_sum FROM smp JOIN ids USING (path) JOIN px USING (path, patch_id)""")
def patch_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a pass looked at; nothing was predicted for the last target of each sequence."""
    p = _patches(spark, sf_dir, 0.1)
    s = _samples(p)
    made = patches.gather(s.where("rank <= 4"), p, "path").select("path", "sample", "patch_id", F.transform("pixels", lambda x: F.round(x, 1)).alias("predicted"))
    total = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    seen = patches.state(s, p, made, "path")
    return rounded(seen.select("path", "image_id", "sample", "rank", "patch_id", "role", total("pixels").alias("pixel_sum"), total("predicted").alias("predicted_sum")), "pixel_sum", "predicted_sum")


@query(f"""WITH {fx.VOXELS_SQL} SELECT 'sag' AS view, path, patch_id::INT AS patch_id, ((y % 2) * 2 + z % 2)::INT AS place, (round(v + 1e-9, 6) + 0.0) AS pixel FROM vox WHERE x = 2
UNION ALL SELECT 'cor', path, patch_id::INT, ((x % 2) * 2 + z % 2)::INT, (round(v + 1e-9, 6) + 0.0) FROM vox WHERE y = 2 UNION ALL SELECT 'ax', path, patch_id::INT, ((x % 2) * 2 + y % 2)::INT, (round(v + 1e-9, 6) + 0.0) FROM vox WHERE z = 2""")
def center_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The middle slices of all views."""
    p = _patches(spark, sf_dir)
    cut = [patches.center_slice(p, v, (4, 4, 4), 2).select(F.lit(v).alias("view"), "path", "patch_id", F.posexplode("pixels").alias("place", "pixel")) for v in patches.VIEWS]
    return rounded(cut[0].unionByName(cut[1]).unionByName(cut[2]), "pixel")


@query(f"WITH {fx.VOXELS_SQL} SELECT path, patch_id::INT AS patch_id, (patch_id // 4)::INT AS gx, ((patch_id // 2) % 2)::INT AS gy, (patch_id % 2)::INT AS gz, count(*) FILTER (m) AS inside FROM vox GROUP BY path, patch_id")
def coordinate_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every patch of the grid for every image, and how many of its voxels lie in the mask."""
    every = fx.volumes(spark, sf_dir).select("path").crossJoin(F.broadcast(patches.lattice(spark, (2, 2, 2))))  # the grid's patches
    own = _patches(spark, sf_dir).select("path", "patch_id", F.size(F.filter("mask", lambda m: m > 0)).cast("long").alias("inside"))
    return every.join(own, ["path", "patch_id"])


# Geometry

_BOX_SQL = f"{_HEAD_SQL}, {fx.VOXELS_SQL}, bx AS (SELECT path, min(x) AS x0, min(y) AS y0, min(z) AS z0 FROM vox WHERE m GROUP BY path)"


@query(f"WITH {_BOX_SQL} SELECT path, " + ", ".join([f"round(a[{i}][{j}], 6) AS a{i - 1}{j - 1}" for i in (1, 2, 3) for j in (1, 2, 3)] + [f"round(a[{i}][1] * x0 + a[{i}][2] * y0 + a[{i}][3] * z0 + a[{i}][4], 6) AS a{i - 1}3" for i in (1, 2, 3)]) + " FROM h JOIN bx USING (path)")
def crop_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = values.mask_box(fx.volumes(spark, sf_dir), "path", "mask_rle", "shape")
    cropped = geometry.crop_affine(_headers(spark, sf_dir).join(boxes, "path"), ("x0", "y0", "z0"))
    return cropped.select("path", *_flat("cropped_affine", "a"))


@query(f"""WITH {_HEAD_SQL}, s AS (SELECT path, unnest([0, 1, 2]) AS axis, unnest([{", ".join(f"greatest(0, (2.5 / sqrt(a[1][{j}]^2 + a[2][{j}]^2 + a[3][{j}]^2) - 1) / 2)" for j in (1, 2, 3))}]) AS w FROM h),
o AS (SELECT *, unnest(range(-ceil(3 * w)::INT, ceil(3 * w)::INT + 1)) AS o FROM s), e AS (SELECT *, CASE WHEN w > 0 THEN exp(-(o * o) / (2 * w * w)) ELSE 1 END AS e FROM o)
SELECT path, axis::INT AS axis, o::INT AS o, (round(e / sum(e) OVER (PARTITION BY path, axis) + 1e-9, 6) + 0.0) AS weight FROM e""")
def smoothing_kernel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The weights of each axis's Gaussian before sampling down to 2.5."""
    p = geometry.spacing_plan(_headers(spark, sf_dir), 2.5).select("path", F.posexplode("sigma").alias("axis", "w"))
    k = p.withColumn("k", geometry.kernel(F.col("w"))).select("path", "axis", F.size("k").alias("n"), F.posexplode("k").alias("i", "weight"))
    return rounded(k.select("path", "axis", (F.col("i") - F.floor(F.col("n") / 2)).cast("int").alias("o"), "weight"), "weight")


# Prepared volumes against the relational form of every step


def _prepared_sql(scale: str, crop: bool, value: str = "s::FLOAT::DOUBLE") -> str:
    """Scores of packed values, the box, orientation, spacing (label 1 has steps of 2 along x) and sums over the grid; the
    grid is never smaller than a volume here, so the fit moves voxels and drops none."""
    box = "min(x), max(x) - min(x) + 1, min(y), max(y) - min(y) + 1, min(z), max(z) - min(z) + 1" if crop else "0, 4, 0, 4, 0, 4"
    x0, nx, y0, ny, z0, nz = (f"{c} AS {n}" for c, n in zip(box.split(", "), ("x0", "nx", "y0", "ny", "z0", "nz"), strict=True))
    return f"""{fx.VOXELS_SQL}, lb AS (SELECT 'vol-' || vec_id AS path, label % 4 AS turn FROM embeddings),
q AS (SELECT path, x, y, z, round_even(v * 1000, 0)::INT * {scale} AS q, row_number() OVER (PARTITION BY path ORDER BY round_even(v * 1000, 0)) AS rn, count(*) OVER (PARTITION BY path) AS n FROM vox WHERE m),
h AS (SELECT *, min(CASE WHEN rn = 1 + round_even(0.005 * (n - 1), 0) THEN q END) OVER (PARTITION BY path) AS lo, min(CASE WHEN rn = 1 + round_even(0.995 * (n - 1), 0) THEN q END) OVER (PARTITION BY path) AS hi FROM q),
c AS (SELECT *, least(greatest(q, lo), hi) AS c FROM h), s AS (SELECT path, x, y, z, (c - avg(c) OVER (PARTITION BY path)) / greatest(stddev_pop(c) OVER (PARTITION BY path), 1e-6) AS s FROM c),
b AS (SELECT path, {x0}, {nx}, {y0}, {ny}, {z0}, {nz} FROM vox WHERE m GROUP BY path),
d AS (SELECT path, turn, vox.x - x0 AS x, vox.y - y0 AS y, vox.z - z0 AS z, nx, ny, nz, coalesce(s, 0) AS s, m FROM vox JOIN b USING (path) JOIN lb USING (path) LEFT JOIN s USING (path, x, y, z)
  WHERE vox.x BETWEEN x0 AND x0 + nx - 1 AND vox.y BETWEEN y0 AND y0 + ny - 1 AND vox.z BETWEEN z0 AND z0 + nz - 1),
r AS (SELECT path, turn, CASE turn WHEN 2 THEN nx - 1 - x WHEN 3 THEN z ELSE x END AS x, CASE turn WHEN 3 THEN x ELSE y END AS y, CASE turn WHEN 3 THEN y ELSE z END AS z,
  CASE turn WHEN 3 THEN nz ELSE nx END AS nx, CASE turn WHEN 3 THEN nx ELSE ny END AS ny, CASE turn WHEN 3 THEN ny ELSE nz END AS nz, s, m FROM d),
p AS (SELECT path, nx, ny, nz, y, z, i, greatest((i + 0.5) * 0.5 - 0.5, 0) AS c, i // 2 AS near FROM (SELECT DISTINCT path, nx, ny, nz, y, z, unnest(range(0, 2 * nx)) AS i FROM r WHERE turn = 1)),
f AS (SELECT path, nx, ny, nz, x, y, z, s, m FROM r WHERE turn <> 1 UNION ALL
  SELECT p.path, 2 * p.nx, p.ny, p.nz, i, p.y, p.z, CASE WHEN k.m THEN l.s * (1 - (p.c - floor(p.c))) + u.s * (p.c - floor(p.c)) ELSE 0 END, k.m FROM p JOIN r l ON l.path = p.path AND l.y = p.y AND l.z = p.z AND l.x = floor(p.c)
    JOIN r u ON u.path = p.path AND u.y = p.y AND u.z = p.z AND u.x = least(floor(p.c) + 1, p.nx - 1) JOIN r k ON k.path = p.path AND k.y = p.y AND k.z = p.z AND k.x = near),
g AS (SELECT path, ((x + (8 - nx) // 2) * 6 + y + (6 - ny) // 2) * 4 + z + (4 - nz) // 2 AS voxel, {value} AS s, m FROM f)"""


_SUMS_SQL = "SELECT path, round(sum(abs(s)), 3) AS image_sum, count(*) FILTER (m)::DOUBLE AS mask_sum"
_ORIGIN_SQL = ", ".join(f"CASE label % 4 WHEN 1 THEN {a}::DOUBLE ELSE {b}::DOUBLE END AS o{i}" for i, (a, b) in enumerate((("-0.5", "-2"), ("-1", "-1"), ("0", "0"))))
ORACLE_SQL["prepare_volumes"] = f"WITH {_prepared_sql('0.001::DOUBLE', False)}, t AS ({_SUMS_SQL} FROM g GROUP BY path) SELECT t.*, {_ORIGIN_SQL} FROM t JOIN (SELECT 'vol-' || vec_id AS path, label FROM embeddings) USING (path)"
ORACLE_SQL["evaluation_volumes"] = f"WITH {_prepared_sql('1::DOUBLE', True)} {_SUMS_SQL} FROM g GROUP BY path"


@query(f"WITH {_prepared_sql('0.001::DOUBLE', False)} SELECT path, voxel::INT AS voxel, (round(s + 1e-9, 6) + 0.0) AS value FROM g WHERE m")
def prepared_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every voxel of the mask of the prepared grid, and its value."""
    out = volumes.prepare_volumes(fx.volumes(spark, sf_dir), "path", volumes.VolumeSpec(grid=(8, 6, 4)))
    cells = out.select("path", F.posexplode(F.arrays_zip("image", "mask")).alias("voxel", "v")).where("v.mask > 0")
    return rounded(cells.select("path", "voxel", F.col("v.image").cast("double").alias("value")), "value")


@query(f"WITH {_prepared_sql('1::DOUBLE', True)} SELECT path, voxel::INT AS voxel, (round(s + 1e-9, 6) + 0.0) AS value FROM g WHERE m")
def evaluation_voxels(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = volumes.prepare_volumes(fx.volumes(spark, sf_dir), "path", volumes.VolumeSpec(grid=(8, 6, 4), use_scale=False, crop=True))
    cells = out.select("path", F.posexplode(F.arrays_zip("image", "mask")).alias("voxel", "v")).where("v.mask > 0")
    return rounded(cells.select("path", "voxel", F.col("v.image").cast("double").alias("value")), "value")


def _voxel_rows(df: DataFrame) -> DataFrame:
    place = (F.col("x") * F.col("shape")[1] + F.col("y")) * F.col("shape")[2] + F.col("z")
    return rounded(df.select("path", place.cast("int").alias("voxel"), F.col("value").cast("float").cast("double").alias("value")), "value")


@query(ORACLE_SQL["prepared_voxels"])
def voxel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same preparation in DataFrame operations on voxels."""
    return _voxel_rows(voxels.prepare(fx.volumes(spark, sf_dir), "path", volumes.VolumeSpec(grid=(8, 6, 4))))


@query(ORACLE_SQL["evaluation_voxels"])
def evaluation_voxel_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _voxel_rows(voxels.prepare(fx.volumes(spark, sf_dir), "path", volumes.VolumeSpec(grid=(8, 6, 4), use_scale=False, crop=True)))


# Embedding records


def _dense_rows(records: DataFrame) -> DataFrame:
    """(path, cell, inside, token_sum, global_sum, o0, o1, o2): a row for each cell of a record."""
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x.cast("double"))
    cells = records.select("path", "global_embedding", "dense_affine", F.posexplode(F.arrays_zip("dense_embedding", "dense_mask")).alias("cell", "v"))
    return cells.select("path", "cell", F.col("v.dense_mask").alias("inside"), (F.round(add("v.dense_embedding") + 1e-9, 6) + 0.0).alias("token_sum"), (F.round(add("global_embedding") + 1e-9, 6) + 0.0).alias("global_sum"), *(F.col("dense_affine")[i][3].alias(f"o{i}") for i in range(3)))


@query(f"""WITH {_TOKEN_SQL}, {_HEAD_SQL}, cell AS (SELECT DISTINCT path, patch_id FROM vox), t AS (SELECT path, patch_id, sum(x::FLOAT::DOUBLE) AS x FROM tok GROUP BY 1, 2), g AS (SELECT path, sum(x) AS x FROM (SELECT path, d, avg(x)::FLOAT::DOUBLE AS x FROM tok GROUP BY 1, 2) GROUP BY 1)
SELECT path, patch_id::INT AS cell, t.x IS NOT NULL AS inside, (round(coalesce(t.x, 0) + 1e-9, 6) + 0.0) AS token_sum, (round(g.x + 1e-9, 6) + 0.0) AS global_sum, a[1][4] AS o0, a[2][4] AS o1, a[3][4] AS o2 FROM cell JOIN h USING (path) LEFT JOIN t USING (path, patch_id) LEFT JOIN g USING (path)""")
def embedding_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of token rows, written in folders by key and read back."""
    records = embed.embedding_records(_headers(spark, sf_dir), _tokens(spark, sf_dir), "path", (2, 2, 2), 4)
    at = scratch_path(spark, "embeddings")
    embed.write_embeddings(records, at, "path", buckets=4)
    return _dense_rows(spark.read.parquet(at))


#: A prepared volume's tokens: a patch's pixels by place, times the fixed projection.
_VOLUME_TOKEN_SQL = f"""{_prepared_sql('1::DOUBLE', True, "s")}, pt AS (SELECT path, ((voxel // 24) // 2 * 3 + (voxel // 4) % 6 // 2) * 2 + voxel % 4 // 2 AS cell, ((voxel // 24) % 2 * 2 + (voxel // 4) % 6 % 2) * 2 + voxel % 4 % 2 AS place, s, m FROM g),
tk AS (SELECT path, cell, d, sum(s * ((place + d) % 3 - 1)) AS x FROM pt, (SELECT unnest(range(0, 4)) AS d) GROUP BY path, cell, d HAVING bool_or(m)), t AS (SELECT path, cell, sum(x::FLOAT::DOUBLE) AS t FROM tk GROUP BY path, cell)"""


@query(f"""WITH {_VOLUME_TOKEN_SQL}, gl AS (SELECT path, sum(x) AS x FROM (SELECT path, d, avg(x)::FLOAT::DOUBLE AS x FROM tk GROUP BY 1, 2) GROUP BY 1), cl AS (SELECT path, unnest(range(0, 24)) AS cell FROM gl)
SELECT path, cell::INT AS cell, t.t IS NOT NULL AS inside, (round(coalesce(t.t, 0) + 1e-9, 6) + 0.0) AS token_sum, (round(gl.x + 1e-9, 6) + 0.0) AS global_sum FROM cl JOIN gl USING (path) LEFT JOIN t USING (path, cell)""")
def embed_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From packed volumes to embedding records in one job."""
    spec = volumes.VolumeSpec(grid=(8, 6, 4), use_scale=False, crop=True)
    records = embed.embed_volumes(fx.volumes(spark, sf_dir), "path", spec, 2, "linear", {"weights": WEIGHTS})
    return _dense_rows(records).drop("o0", "o1", "o2")
