"""Registered queries: every operator over tables derived from the general ones, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from volframe.operators import curate, embed, epochs, geometry, leaderboard, patches, telemetry, values, volumes
from volframe.plans import fixtures as fx
from volframe.plans.scratch import scratch_path
from volframe.sources import shards
from volframe.streaming import live

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return keep


#: Added before rounding on both sides, so that a mean halfway between two roundings goes the same way in either engine.
NUDGE = 1e-9


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(F.col(n) + NUDGE, 6) + 0.0 for n in names})


# Curation


@query(f"WITH {fx.CHECKED_SQL} SELECT path, collection, subject, sequence FROM fin WHERE rn = 1")
def curate_selected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.selected(fx.images(spark, sf_dir)).select("path", "collection", "subject", "sequence")


@query(f"""WITH {fx.CHECKED_SQL} SELECT 0 AS position, 'all' AS stage, count(*) AS images FROM chk UNION ALL SELECT 1, 'sequence', count(*) FILTER (s1) FROM chk
UNION ALL SELECT 2, 'no_warnings', count(*) FILTER (s1 AND s2) FROM chk UNION ALL SELECT 3, 'extent', count(*) FILTER (s1 AND s2 AND s3) FROM chk
UNION ALL SELECT 4, 'deduplicated', count(*) FROM fin WHERE rn = 1""")
def curate_funnel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.funnel(fx.images(spark, sf_dir))


@query(f"WITH {fx.CHECKED_SQL} SELECT sequence, count(*) AS images FROM fin WHERE rn = 1 GROUP BY sequence")
def sequence_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.sequence_counts(curate.selected(fx.images(spark, sf_dir)))


@query(f"WITH {fx.CHECKED_SQL} SELECT DISTINCT sequence FROM lab WHERE sequence IS NOT NULL")
def distinct_sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return curate.distinct_sequences(curate.label_sequences(fx.images(spark, sf_dir)))


# Shard lookup


def _filelist(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.images(spark, sf_dir).select(F.col("doc_id").alias("ordinal"), curate.derivative_path(F.col("path")).alias("path"))


@query(f"WITH {fx.IMAGES_SQL}, {fx.SHARDS_SQL}, l AS (SELECT doc_id AS ordinal, {fx.DERIVED_SQL} AS path FROM fx_images) SELECT ordinal, path, shard, \"offset\", size FROM l JOIN fx_shards USING (path)")
def strict_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.strict_lookup(_filelist(spark, sf_dir), fx.shards(spark, sf_dir).withColumn("offset", F.col("offset").cast("long")))


@query(f"WITH {fx.IMAGES_SQL}, l AS (SELECT path FROM (SELECT {fx.DERIVED_SQL} AS path FROM fx_images UNION ALL SELECT 'derivatives/absent.npz')), k AS (SELECT {fx.DERIVED_SQL} AS path FROM fx_images) SELECT DISTINCT path FROM l WHERE path NOT IN (SELECT path FROM k)")
def missing_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    listed = _filelist(spark, sf_dir)
    return shards.missing_members(listed.unionByName(spark.sql("SELECT -1L AS ordinal, 'derivatives/absent.npz' AS path")), fx.shards(spark, sf_dir))


# Value statistics


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_suppkey, l_extendedprice AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice) AS rn, count(*) OVER (PARTITION BY l_suppkey) AS n FROM lineitem),
q AS (SELECT *, min(CASE WHEN rn = 1 + round_even(0.005 * (n - 1), 0)::BIGINT THEN v END) OVER (PARTITION BY l_suppkey) AS lo, min(CASE WHEN rn = 1 + round_even(0.995 * (n - 1), 0)::BIGINT THEN v END) OVER (PARTITION BY l_suppkey) AS hi FROM r),
c AS (SELECT *, least(greatest(v, lo), hi) AS c FROM q)
SELECT l_orderkey, l_linenumber, l_suppkey, (round((c - avg(c) OVER (PARTITION BY l_suppkey)) / greatest(stddev_pop(c) OVER (PARTITION BY l_suppkey), 1e-6) + 1e-9, 6) + 0.0) AS z FROM c""")
def clipped_zscore(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_suppkey", "l_extendedprice")
    return rounded(values.clipped_zscore(rows, "l_suppkey", "l_extendedprice"), "z").drop("l_extendedprice")


@query(f"""WITH {fx.VOXELS_SQL}, c AS (SELECT *, CASE WHEN i = 0 THEN m::INT ELSE (m <> lag(m) OVER (PARTITION BY path ORDER BY i))::INT END AS d FROM vox),
g AS (SELECT *, sum(d) OVER (PARTITION BY path ORDER BY i) AS run FROM c)
SELECT path, run::INT AS run, min(i)::BIGINT AS start, count(*)::BIGINT AS length, bool_and(m) AS inside FROM g GROUP BY path, run
UNION ALL SELECT path, 0, 0, 0, false FROM vox WHERE i = 0 AND m""")
def rle_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.rle_runs(fx.volumes(spark, sf_dir), "path", "mask_rle")


@query(f"WITH {fx.VOXELS_SQL} SELECT path, i::BIGINT AS voxel, (round(CASE WHEN m THEN round_even(v * 1000, 0)::INT * 0.001::DOUBLE ELSE 0 END + 1e-9, 6) + 0.0) AS value FROM vox")
def mask_scatter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(values.mask_scatter(fx.volumes(spark, sf_dir), "path", "mask_rle", "values", "scale"), "value")


@query(f"WITH {fx.VOXELS_SQL} SELECT path, min(x)::INT AS x0, (max(x) + 1)::INT AS x1, min(y)::INT AS y0, (max(y) + 1)::INT AS y1, min(z)::INT AS z0, (max(z) + 1)::INT AS z1 FROM vox WHERE m GROUP BY path")
def mask_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    return values.mask_box(fx.volumes(spark, sf_dir), "path", "mask_rle", "shape")


# The patch table


def _patches(spark: SparkSession, sf_dir: str, least: float = -0.1) -> DataFrame:
    """Patches of the 4 x 4 x 4 volumes, edge 2, with mask_frac; the mask is where a voxel is over `least`."""
    v = fx.volumes(spark, sf_dir).withColumn("mask", F.transform("dense", lambda x: (x > least).cast("double")))
    cut = patches.patchify(v, "path", "dense", "mask", (4, 4, 4), 2)
    return cut.withColumn("mask_frac", patches.mask_fraction(F.col("mask")))


def _total(c: str):
    return F.round(F.aggregate(c, F.lit(0.0), lambda a, x: a + x), 6)


_FRAC2_SQL = f"{fx.VOXELS_SQL}, fr AS (SELECT path, patch_id, avg((v > 0.1)::INT) AS frac, sum(v) AS total FROM vox GROUP BY path, patch_id)"
_SAMPLE_SQL = f"""{_FRAC2_SQL}, rk AS (SELECT path, sample, patch_id, total, row_number() OVER (PARTITION BY path, sample ORDER BY CASE WHEN frac >= 0.25 THEN 0 ELSE 1 END, md5('0:' || path || ':' || sample || ':' || patch_id), patch_id) AS rank
  FROM fr, (SELECT unnest([0, 1]) AS sample)), smp AS (SELECT path, sample::INT AS sample, rank::INT AS rank, patch_id::INT AS patch_id, CASE WHEN rank <= 2 THEN 'visible' ELSE 'target' END AS role, total FROM rk WHERE rank <= 5)"""


@query(f"WITH {fx.VOXELS_SQL} SELECT path, patch_id::INT AS patch_id, (patch_id // 4)::INT AS gx, ((patch_id // 2) % 2)::INT AS gy, (patch_id % 2)::INT AS gz, place::INT AS place, round(v, 6) AS pixel, m::INT::DOUBLE AS inside FROM vox")
def patchify(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patches(spark, sf_dir)
    return p.select("path", "patch_id", "gx", "gy", "gz", F.posexplode(F.arrays_zip("pixels", "mask")).alias("place", "v")).select("path", "patch_id", "gx", "gy", "gz", "place", F.round("v.pixels", 6).alias("pixel"), F.col("v.mask").alias("inside"))


@query(f"WITH {fx.VOXELS_SQL} SELECT path, i::INT AS voxel, (round(v + 1e-9, 6) + 0.0) AS value FROM vox")
def unpatchify(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = patches.unpatchify(_patches(spark, sf_dir), "path", "pixels", (2, 2, 2), 2)
    return rounded(back.select("path", F.posexplode("image").alias("voxel", "value")), "value")


@query(f"WITH {fx.VOXELS_SQL} SELECT path, patch_id::INT AS patch_id, avg(m::INT) AS mask_frac FROM vox GROUP BY path, patch_id")
def mask_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _patches(spark, sf_dir).select("path", "patch_id", "mask_frac")


def _samples(p: DataFrame) -> DataFrame:
    return patches.sample_patches(p, "path", samples=2, length=5, visible=2)


@query(f"WITH {_SAMPLE_SQL} SELECT path, sample, rank, patch_id, role FROM smp")
def patch_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _samples(_patches(spark, sf_dir, 0.1))


@query(f"WITH {_SAMPLE_SQL} SELECT path, sample, rank, patch_id, role, (patch_id // 4)::INT AS gx, ((patch_id // 2) % 2)::INT AS gy, (patch_id % 2)::INT AS gz, round(total, 6) AS pixel_sum FROM smp")
def gather_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patches(spark, sf_dir, 0.1)
    return patches.gather(_samples(p), p, "path").select("path", "sample", "rank", "patch_id", "role", "gx", "gy", "gz", _total("pixels").alias("pixel_sum"))


@query(f"WITH {_FRAC2_SQL} SELECT path, patch_id::INT AS patch_id, round(CASE WHEN frac >= 0.25 THEN total ELSE 0 END, 6) AS pixel_sum FROM fr")
def scatter_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _patches(spark, sf_dir, 0.1)
    images = fx.volumes(spark, sf_dir).select("path")
    return patches.scatter(images, p.where(F.col("mask_frac") >= patches.LEAST_FRACTION), "path", (2, 2, 2), "pixels", 8).select("path", "patch_id", _total("pixels").alias("pixel_sum"))


@query("""WITH e AS (SELECT label, unnest(embedding)::DOUBLE AS v FROM embeddings) SELECT label, (round(sum((v > -0.1)::INT * pow(round(v, 1) - v, 2)) / sum((v > -0.1)::INT) + 1e-9, 6) + 0.0) AS loss FROM e GROUP BY label""")
def masked_mse(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.volumes(spark, sf_dir).select("path", "label")
    p = _patches(spark, sf_dir).join(labels, "path").withColumn("predicted", F.transform("pixels", lambda x: F.round(x, 1)))
    return rounded(patches.masked_mse(p, ["label"], "predicted", "pixels", "mask"), "loss")


@query(f"WITH {_FRAC2_SQL}, l AS (SELECT 'vol-' || vec_id AS path, label FROM embeddings), n AS (SELECT label, path, count(*) FILTER (frac >= 0.25) AS k FROM fr JOIN l USING (path) GROUP BY label, path) SELECT label, max(k) AS seq_length FROM n GROUP BY label")
def seq_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = fx.volumes(spark, sf_dir).select("path", "label")
    return patches.sequence_length(_patches(spark, sf_dir, 0.1).join(labels, "path"), "label", "path")


@query(f"WITH {fx.VOXELS_SQL} SELECT path, patch_id::INT AS patch_id, ((x % 2) * 2 + y % 2)::INT AS place, (round(v + 1e-9, 6) + 0.0) AS pixel FROM vox WHERE z = 2")
def center_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = patches.center_slice(_patches(spark, sf_dir), "ax", (4, 4, 4), 2)
    return rounded(cut.select("path", "patch_id", F.posexplode("pixels").alias("place", "pixel")), "pixel")


@query(f"""WITH {fx.VOXELS_SQL} SELECT path, i::INT AS voxel, (round(CASE WHEN NOT m THEN 0 WHEN patch_id % 2 = 0 THEN v ELSE 0.5 END + 1e-9, 6) + 0.0) AS panel_visible,
(round(CASE WHEN NOT m THEN 0 WHEN patch_id % 2 = 1 THEN round(v, 1) ELSE v END + 1e-9, 6) + 0.0) AS panel_predicted, (round(CASE WHEN m THEN v ELSE 0 END + 1e-9, 6) + 0.0) AS panel_original FROM vox""")
def panels(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = fx.volumes(spark, sf_dir).select("path", F.posexplode(F.arrays_zip("dense", "mask")).alias("voxel", "v"))
    parity = (F.floor(F.col("voxel") % 4 / 2) % 2).cast("int")  # the last axis runs fastest in patch numbers
    cells = v.select("path", "voxel", F.col("v.dense").alias("image"), F.col("v.mask").alias("inside"), F.round("v.dense", 1).alias("predicted"), (parity == 0).alias("seen"), (parity == 1).alias("made"))
    out = patches.panels(cells, "image", "predicted", "inside", "seen", "made")
    return rounded(out.select("path", "voxel", "panel_visible", "panel_predicted", "panel_original"), "panel_visible", "panel_predicted", "panel_original")


# Header geometry


def _headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fx.volumes(spark, sf_dir).select("path", "label", "shape", "affine")


def _flat(c: str, name: str):
    return [F.round(F.col(c)[i][j], 6).alias(f"{name}{i}{j}") for i in range(3) for j in range(4)]


_HEAD_SQL = f"h AS (SELECT 'vol-' || vec_id AS path, label, {fx.AFFINE_SQL} AS a FROM embeddings)"
_SP_SQL = ", ".join(f"sqrt(a[1][{j}]^2 + a[2][{j}]^2 + a[3][{j}]^2) AS s{j - 1}" for j in (1, 2, 3))
_NEW_SQL = ", ".join(f"greatest(round_even(4 * s{j} / 1.0, 0), 1)::INT AS n{j}" for j in range(3))


@query(f"WITH {_HEAD_SQL}, s AS (SELECT path, {_SP_SQL} FROM h) SELECT path, {', '.join(f'round(s{j}, 6) AS s{j}' for j in range(3))}, {_NEW_SQL}, {', '.join(f'round(greatest(0, (1.0 / s{j} - 1) / 2), 6) AS w{j}' for j in range(3))} FROM s")
def spacing_shape(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.spacing_plan(_headers(spark, sf_dir))
    return p.select("path", *(F.round(F.col("spacing")[j], 6).alias(f"s{j}") for j in range(3)), *(F.col("new_shape")[j].alias(f"n{j}") for j in range(3)), *(F.round(F.col("sigma")[j], 6).alias(f"w{j}") for j in range(3)))


@query(f"WITH {_HEAD_SQL}, s AS (SELECT path, a, {_SP_SQL} FROM h), n AS (SELECT path, a, {_NEW_SQL} FROM s), k AS (SELECT path, a, [4.0 / n0, 4.0 / n1, 4.0 / n2] AS r FROM n) SELECT path, "
       + ", ".join([f"round(a[{i}][{j}] * r[{j}], 6) AS a{i - 1}{j - 1}" for i in (1, 2, 3) for j in (1, 2, 3)] + [f"round(a[{i}][1] * (0.5 * r[1] - 0.5) + a[{i}][2] * (0.5 * r[2] - 0.5) + a[{i}][3] * (0.5 * r[3] - 0.5) + a[{i}][4], 6) AS a{i - 1}3" for i in (1, 2, 3)]) + " FROM k")
def resample_affine(spark: SparkSession, sf_dir: str) -> DataFrame:
    return geometry.resample_affine(geometry.spacing_plan(_headers(spark, sf_dir))).select("path", *_flat("resampled_affine", "a"))


@query(f"WITH {_HEAD_SQL} SELECT path, 0 AS b0, -1 AS b1, 2 AS b2, 1 AS e0, 0 AS e1, 2 AS e2, " + ", ".join(f"round(a[{i}][1] * 0 + a[{i}][2] * 1 + a[{i}][3] * -2 + a[{i}][4], 6) AS o{i - 1}" for i in (1, 2, 3)) + " FROM h")
def fit_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = geometry.fit_plan(_headers(spark, sf_dir), (5, 3, 8))
    return p.select("path", *(F.col("before")[j].alias(f"b{j}") for j in range(3)), *(F.col("after")[j].alias(f"e{j}") for j in range(3)), *(F.round(F.col("fitted_affine")[i][3], 6).alias(f"o{i}") for i in range(3)))


@query(f"""WITH {_HEAD_SQL} SELECT path, CASE label % 4 WHEN 3 THEN 1 ELSE 0 END AS w0, CASE label % 4 WHEN 3 THEN 2 ELSE 1 END AS w1, CASE label % 4 WHEN 3 THEN 0 ELSE 2 END AS w2,
CASE label % 4 WHEN 2 THEN -1 ELSE 1 END AS d0, """ + ", ".join(f"CASE label % 4 WHEN 1 THEN a[{i}][{j}] ELSE {1.0 if i == j else 0.0}::DOUBLE END AS a{i - 1}{j - 1}" for i in (1, 2, 3) for j in (1, 2, 3, 4)) + " FROM h")
def orientation(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = geometry.reorient_affine(geometry.orientation(_headers(spark, sf_dir)))
    return o.select("path", *(F.col("world_axis")[j].alias(f"w{j}") for j in range(3)), F.col("direction")[0].alias("d0"), *_flat("reoriented_affine", "a"))


# Epoch plans

_PLAN_SQL = f"""{fx.IMAGES_SQL}, pl AS (SELECT epoch * (SELECT count(*) FROM fx_images) + row_number() OVER (PARTITION BY epoch ORDER BY md5('0:' || epoch || ':' || path), path) - 1 AS pos, epoch::INT AS epoch, path FROM fx_images, (SELECT unnest([0, 1, 2]) AS epoch))"""


def _plan(spark: SparkSession, sf_dir: str, start: int = 0) -> DataFrame:
    return epochs.epoch_plan(fx.images(spark, sf_dir), "path", seed=0, epochs=3, batch_size=32, start=start)


@query(f"WITH {_PLAN_SQL} SELECT pos, epoch, path, pos // 32 AS batch FROM pl")
def epoch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir)


@query(f"WITH {_PLAN_SQL} SELECT pos, epoch, path, pos // 32 AS batch FROM pl WHERE pos >= 224")
def resume_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir, epochs.resume_position(step=7, accumulation=1, batch_size=32))


@query(f"WITH {_PLAN_SQL} SELECT pos // 32 AS batch, count(*) AS images, min(path) AS first_path FROM pl GROUP BY 1")
def batch_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _plan(spark, sf_dir).groupBy("batch").agg(F.count("*").alias("images"), F.min("path").alias("first_path"))


@query(f"WITH {_PLAN_SQL} SELECT pos, path FROM pl WHERE pos % 32 < 4")
def batch_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return epochs.examples(_plan(spark, sf_dir), 32, 4).select("pos", "path")


# Telemetry


@query(f"""WITH {fx.STEPS_SQL}, u AS (SELECT run, step, 'loss' AS metric, loss AS value FROM fx_steps WHERE loss IS NOT NULL UNION ALL SELECT run, step, 'grad', grad FROM fx_steps WHERE grad IS NOT NULL),
w AS (SELECT *, list(value) OVER l AS vs, avg(value) OVER l AS a, max(value) OVER l AS mx, avg(value) OVER (PARTITION BY run, metric ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS g FROM u WINDOW l AS (PARTITION BY run, metric ORDER BY step ROWS BETWEEN 19 PRECEDING AND CURRENT ROW))
SELECT run, step, metric, (round(list_sort(vs)[(len(vs) - 1) // 2 + 1] + 1e-9, 6) + 0.0) AS median, (round(a + 1e-9, 6) + 0.0) AS avg, (round(mx + 1e-9, 6) + 0.0) AS max, (round(value + 1e-9, 6) + 0.0) AS latest, (round(g + 1e-9, 6) + 0.0) AS global_avg FROM w""")
def rolling_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.rolling_meters(fx.steps(spark, sf_dir), "run", "step", ["loss", "grad"]), "median", "avg", "max", "latest", "global_avg")


@query(f"""WITH {fx.STEPS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY run ORDER BY step DESC) AS k FROM fx_steps WHERE loss IS NOT NULL), l AS (SELECT run, list_sort(list(loss)) AS v FROM r WHERE k <= 20 GROUP BY run)
SELECT run, (round(v[(len(v) - 1) // 2 + 1] + 1e-9, 6) + 0.0) AS final FROM l""")
def final_loss(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.final_median(fx.steps(spark, sf_dir), "run", "step", "loss"), "final")


@query(f"""WITH {fx.STEPS_SQL}, g AS (SELECT run, (step - 1) // 20 AS w, count(*) AS steps, max(ts) AS t1, max(energy_mj) AS e1, min(ts) AS t0, min(energy_mj) AS e0 FROM fx_steps GROUP BY 1, 2),
p AS (SELECT *, coalesce(lag(t1) OVER (PARTITION BY run ORDER BY w), t0) AS tp, coalesce(lag(e1) OVER (PARTITION BY run ORDER BY w), e0) AS ep FROM g), s AS (SELECT *, (epoch_us(t1) - epoch_us(tp)) / 1e6 AS sec FROM p)
SELECT run, w AS "window", steps, (round(sec + 1e-9, 6) + 0.0) AS seconds, (round(CASE WHEN sec <> 0 THEN steps * 32.0 / sec END + 1e-9, 6) + 0.0) AS rate, (round(CASE WHEN sec <> 0 THEN (e1 - ep) / 1000.0 / sec END + 1e-9, 6) + 0.0) AS watts FROM s""")
def throughput_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.throughput(fx.steps(spark, sf_dir), "run", "step", "ts", "energy_mj", every=20, units=32), "seconds", "rate", "watts")


@query(f"""WITH {fx.STEPS_SQL}, d AS (SELECT run, step, ts, (epoch_us(ts) - lag(epoch_us(ts)) OVER w) / 1e6 AS it, (epoch_us(ts) - first_value(epoch_us(ts)) OVER w) / 1e6 AS el FROM fx_steps WINDOW w AS (PARTITION BY run ORDER BY step))
SELECT run, step, (round(it + 1e-9, 6) + 0.0) AS iteration_s, (round(el + 1e-9, 6) + 0.0) AS elapsed_s FROM d""")
def timing_eta(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = telemetry.timing(fx.steps(spark, sf_dir), "run", "step", "ts", total_steps=20_000)
    return rounded(t.select("run", "step", "iteration_s", "elapsed_s"), "iteration_s", "elapsed_s")


@query(f"""WITH {fx.STEPS_SQL}, d AS (SELECT run, step, (epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY run ORDER BY step)) / 1e6 AS it FROM fx_steps)
SELECT run, step, floor(avg(it) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) * greatest(20000 - step, 0))::BIGINT AS eta_s FROM d""")
def timing_left(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.timing(fx.steps(spark, sf_dir), "run", "step", "ts", total_steps=20_000).select("run", "step", "eta_s")


_COST_SQL = f"{fx.STEPS_SQL}, cost AS (SELECT run, step, 1 + (event_id % 3)::BIGINT AS seconds FROM fx_steps), wl AS (SELECT *, sum(seconds) OVER (PARTITION BY run ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS wall_s FROM cost)"


@query(f"WITH {_COST_SQL} SELECT run, step, seconds, wall_s FROM wl WHERE wall_s - seconds < 300")
def budget_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = fx.steps(spark, sf_dir).select("run", "step", (1 + F.col("event_id") % 3).alias("seconds"))
    return telemetry.budget_cut(log, "run", "step", "seconds", limit_s=300)


@query(f"WITH {fx.STEPS_SQL}, k AS (SELECT *, row_number() OVER (PARTITION BY run, step_raw ORDER BY attempt DESC, event_id DESC) AS n FROM fx_steps) SELECT run, step_raw, attempt, event_id, (round(loss + 1e-9, 6) + 0.0) AS loss FROM k WHERE n = 1")
def latest_attempt(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.latest_attempt(fx.steps(spark, sf_dir), "run", "step_raw", "attempt", "event_id").select("run", "step_raw", "attempt", "event_id", "loss"), "loss")


@query(f"""WITH {fx.STEPS_SQL} SELECT run, max(step) AS step, max(step) * 64 AS images, (round(max(step) * 64 / 87000.0 + 1e-9, 6) + 0.0) AS epochs, (round(max(step) * 2 * 5e9 + 1e-9, 6) + 0.0) AS train_flops, (round(arg_max(loss, step) + 1e-9, 6) + 0.0) AS final_loss,
(round((epoch_us(max(ts)) - epoch_us(min(ts))) / 1e6 + 1e-9, 6) + 0.0) AS wall_seconds, max(step) >= 500 AS done FROM fx_steps GROUP BY run""")
def run_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = telemetry.run_summary(fx.steps(spark, sf_dir), "run", "step", "loss", "ts", batch_size=32, accumulation=2, dataset=87_000, flops_per_batch=5e9, total_steps=500)
    return rounded(s, "epochs", "train_flops", "final_loss", "wall_seconds")


@query(f"WITH {fx.STEPS_SQL} SELECT run, step, (round(loss + 1e-9, 6) + 0.0) AS loss FROM fx_steps f WHERE step % 20 = 0 OR step = (SELECT max(step) FROM fx_steps g WHERE g.run = f.run)")
def thin_steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(telemetry.thin(fx.steps(spark, sf_dir).select("run", "step", "loss"), "run", "step", 20), "loss")


# Leaderboard

_NORM_SQL = f"{fx.SCORES_SQL}, nm AS (SELECT *, CASE WHEN kind = 'classification' THEN 2 * raw - 1 ELSE raw END AS score FROM fx_scores)"
#: Recipe r0 has not done the task NO.
_DONE_SQL = f"{_NORM_SQL}, dn AS (SELECT * FROM nm WHERE NOT (recipe = 'r0' AND task = 'NO')), tk AS (SELECT DISTINCT task, kind FROM nm)"
_KINDS_SQL = ", ".join(f"CASE WHEN count(DISTINCT CASE WHEN kind = '{k}' THEN task END) = (SELECT count(*) FROM tk WHERE kind = '{k}') THEN avg(CASE WHEN kind = '{k}' THEN score END) END AS {k}" for k in leaderboard.KINDS)
_GROUP_SQL = f"{_DONE_SQL}, gr AS (SELECT recipe, seed, CASE WHEN count(DISTINCT task) = (SELECT count(*) FROM tk) THEN avg(score) END AS open, {_KINDS_SQL} FROM dn GROUP BY recipe, seed)"
_FOUR = ("open", *leaderboard.KINDS)
_MEDIAN_SQL = f"{_GROUP_SQL}, md AS (SELECT recipe, count(*) AS seeds, {', '.join(f'list_sort(list({k}) FILTER ({k} IS NOT NULL))[(count({k}) - 1) // 2 + 1] AS {k}' for k in _FOUR)} FROM gr GROUP BY recipe)"
_ROUND4 = ", ".join(f"(round({k} + 1e-9, 6) + 0.0) AS {k}" for k in _FOUR)


def _normal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.normalise_scores(fx.scores(spark, sf_dir))


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _normal(spark, sf_dir)
    return leaderboard.group_scores(s.where("NOT (recipe = 'r0' AND task = 'NO')"), s.select("task", "kind").distinct())


@query(f"WITH {_NORM_SQL} SELECT recipe, seed, task, kind, (round(raw + 1e-9, 6) + 0.0) AS raw, (round(score + 1e-9, 6) + 0.0) AS score FROM nm")
def score_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_normal(spark, sf_dir).select("recipe", "seed", "task", "kind", "raw", "score"), "raw", "score")


@query(f"WITH {_GROUP_SQL} SELECT recipe, seed, {_ROUND4} FROM gr")
def group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_groups(spark, sf_dir), *_FOUR)


@query(f"WITH {_MEDIAN_SQL} SELECT recipe, seeds, {_ROUND4} FROM md")
def seed_median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leaderboard.seed_median(_groups(spark, sf_dir)), *_FOUR)


@query(f"WITH {_MEDIAN_SQL} SELECT recipe, (rank() OVER (ORDER BY open DESC NULLS LAST))::INT AS rank, (round(open + 1e-9, 6) + 0.0) AS open FROM md")
def leaderboard_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(leaderboard.leaderboard(leaderboard.seed_median(_groups(spark, sf_dir))).select("recipe", "rank", "open"), "open")


@query(f"WITH {_NORM_SQL} SELECT recipe || '-' || seed AS run, task, (round(score + 1e-9, 6) + 0.0) AS score FROM nm")
def score_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _normal(spark, sf_dir).unionByName(_normal(spark, sf_dir).groupBy("recipe", "seed").agg(F.avg("raw").alias("raw"), F.avg("score").alias("score")).withColumns({"task": F.lit("all"), "kind": F.lit(None).cast("string")}))
    maps = s.groupBy(F.concat_ws("-", "recipe", "seed").alias("run")).agg(F.map_from_entries(F.collect_list(F.struct("task", F.struct("score")))).alias("summary"))
    return rounded(leaderboard.score_rows(maps), "score")


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = _groups(spark, sf_dir)
    name = F.concat(F.lit("recipe number "), F.substring("recipe", 2, 9), F.when(F.col("seed") == 2, " of seeds").otherwise(""))
    # in thousandths, which both engines write without an exponent
    metrics = F.map_from_arrays(F.array(*map(F.lit, _FOUR)), F.array(*(F.round(F.col(k) * 1000 + NUDGE, 3) for k in _FOUR)))
    return g.select(F.concat_ws("-", "recipe", "seed").alias("run"), name.alias("name"), F.lit(None).cast("string").alias("notes"), "open", metrics.alias("metrics"))


@query(f"""WITH {_GROUP_SQL}, rn AS (SELECT recipe || '-' || seed AS run, 'recipe number ' || substring(recipe, 2) || CASE WHEN seed = 2 THEN ' of seeds' ELSE '' END AS name, open FROM gr)
SELECT run, name, open IS NULL AS unscored, length(name) > 20 AS long_name, NOT (open IS NULL OR length(name) > 20) AS valid FROM rn""")
def submission_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = leaderboard.submissions(_runs(spark, sf_dir), "metrics")
    has = lambda text: F.exists("validation_errors", lambda m: m.contains(text))
    return s.select("run", "name", has("scored").alias("unscored"), has("characters").alias("long_name"), "valid")


_KEYS_SQL = " || ".join(f"""CASE WHEN {k} IS NULL THEN '"{k}":null' ELSE '"{k}":' || round({k} * 1000 + 1e-9, 3) END || '{"," if k != "segmentation" else ""}'""" for k in sorted(_FOUR))


@query(f"""WITH {_GROUP_SQL}, rn AS (SELECT *, recipe || '-' || seed AS run, 'recipe number ' || substring(recipe, 2) || CASE WHEN seed = 2 THEN ' of seeds' ELSE '' END AS name FROM gr),
d AS (SELECT run, '{{"metrics":{{' || {_KEYS_SQL} || '}},"name":"' || name || '","notes":"","run":"' || run || '","validation_errors":['
  || array_to_string(list_filter([CASE WHEN open IS NULL THEN '"task group is not scored"' END, CASE WHEN length(name) > 20 THEN '"name has more than 20 characters"' END], lambda e: e IS NOT NULL), ',') || ']}}' AS payload FROM rn)
SELECT run, payload, substring(sha256(payload), 1, 10) AS submission_id FROM d""")
def submission_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.submissions(_runs(spark, sf_dir), "metrics").select("run", "payload", "submission_id")


# Volumes and embeddings


@query()
def prepare_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = volumes.prepare_volumes(fx.volumes(spark, sf_dir), "path", volumes.VolumeSpec(grid=(8, 6, 4)))
    total = lambda c: F.round(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + F.abs(x)), 3)
    return out.select("path", total("image").alias("image_sum"), total("mask").alias("mask_sum"), *(F.round(F.col("affine")[i][3], 6).alias(f"o{i}") for i in range(3)))


@query()
def evaluation_volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = volumes.prepare_volumes(fx.volumes(spark, sf_dir), "path", volumes.VolumeSpec(grid=(8, 6, 4), use_scale=False, crop=True))
    total = lambda c: F.round(F.aggregate(F.col(c), F.lit(0.0), lambda a, x: a + F.abs(x)), 3)
    return out.select("path", total("image").alias("image_sum"), total("mask").alias("mask_sum"))


#: Columns of the fixed projection that tests the encoder interface.
WEIGHTS = [[float((p + d) % 3 - 1) for d in range(4)] for p in range(8)]
_TOKEN_SQL = f"""{fx.VOXELS_SQL}, tch AS (SELECT path, patch_id FROM vox GROUP BY path, patch_id HAVING bool_or(v > 0.1)),
tok AS (SELECT path, patch_id, d, sum(v * ((place + d) % 3 - 1)) AS x FROM vox JOIN tch USING (path, patch_id), (SELECT unnest(range(0, 4)) AS d) GROUP BY path, patch_id, d)"""


def _tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed.embed_images(_patches(spark, sf_dir, 0.1), "path", "linear", {"weights": WEIGHTS})


@query(f"WITH {_TOKEN_SQL} SELECT path, patch_id::INT AS patch_id, d::INT AS dim, (round(x + 1e-9, 6) + 0.0) AS x FROM tok")
def embed_linear(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_tokens(spark, sf_dir).select("path", "patch_id", F.posexplode("token").alias("dim", "x")), "x")


@query(f"WITH {_TOKEN_SQL} SELECT path, d::INT AS dim, (round(avg(x) + 1e-9, 6) + 0.0) AS x FROM tok GROUP BY path, d")
def pool_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    pooled = embed.pool_tokens(_tokens(spark, sf_dir), "path")
    return rounded(pooled.select("path", F.posexplode("global_embedding").alias("dim", "x")), "x")


@query(f"WITH {_TOKEN_SQL}, cell AS (SELECT DISTINCT path, patch_id FROM vox), s AS (SELECT path, patch_id, sum(x) AS x FROM tok GROUP BY 1, 2) SELECT path, patch_id::INT AS patch_id, x IS NOT NULL AS inside, round(coalesce(x, 0), 6) AS token_sum FROM cell LEFT JOIN s USING (path, patch_id)")
def dense_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = embed.dense_embedding(fx.volumes(spark, sf_dir).select("path"), _tokens(spark, sf_dir), "path", (2, 2, 2), 4)
    return cells.select("path", "patch_id", "inside", _total("token").alias("token_sum"))


# Streams: what a stream leaves after all rows have come


def _streamed(spark: SparkSession, df: DataFrame, label: str, files: int = 4) -> DataFrame:
    """df's rows as a stream of files."""
    path = scratch_path(spark, label)
    df.repartition(files).write.parquet(path)
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(path)


def _run(spark: SparkSession, stream: DataFrame, mode: str, label: str) -> DataFrame:
    out = scratch_path(spark, label)
    live.finished(stream, mode, out, scratch_path(spark, f"{label}-state"))
    return spark.read.parquet(out)


@query(f"""WITH {fx.STEPS_SQL} SELECT run, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS steps, (round(count(*) * 32.0 / 3600 + 1e-9, 6) + 0.0) AS rate FROM fx_steps GROUP BY 1, 2""")
def stream_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _streamed(spark, fx.steps(spark, sf_dir).select("run", "ts"), "throughput")
    out = _run(spark, live.live_throughput(log, "1 hour", "365 days", 32), "update", "throughput-out")
    last = out.groupBy("run", "start").agg(F.max_by(F.struct("steps", "rate"), "batch").alias("r"))
    return rounded(last.select("run", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "r.steps", "r.rate"), "rate")


@query(f"WITH {fx.CHECKED_SQL} SELECT path, collection, subject, sequence FROM fin WHERE rn = 1")
def stream_curate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _run(spark, live.live_selection(_streamed(spark, fx.images(spark, sf_dir), "manifest")), "update", "selection-out")
    last = out.groupBy("collection", "subject", "sequence").agg(F.max_by("path", "batch").alias("path"))
    return last.select("path", "collection", "subject", "sequence")


#: Rows of an instalment, about, and how many there are at least.
INSTALMENT_ROWS, INSTALMENTS = 1_000_000, 2


def _in_instalments(spark: SparkSession, df: DataFrame, through, by: str, label: str) -> DataFrame:
    """What a stream leaves of df's rows, which arrive in instalments in the order of `by`; the stream stops after each and
    goes on with the next, so a micro-batch is an instalment, however many rows there are in all."""
    kept, path, out, state = (scratch_path(spark, f"{label}{x}") for x in ("-kept", "", "-out", "-state"))
    saved = scratch_path(spark, f"{label}-rows")
    df.write.parquet(saved)
    rows = spark.read.parquet(saved)
    n = max(INSTALMENTS, -(-rows.count() // INSTALMENT_ROWS))
    rows.repartitionByRange(n, by).withColumn("_part", F.spark_partition_id()).write.partitionBy("_part").parquet(kept)
    for part in range(n):
        some = spark.read.schema(StructType([*df.schema.fields, StructField("_part", IntegerType())])).parquet(kept).where(F.col("_part") == part).drop("_part")
        some.write.mode("append").parquet(path)
        live.finished(through(spark.readStream.schema(df.schema).parquet(path)), "append", out, state)
    return spark.read.parquet(out)


@query(ORACLE_SQL["rolling_meters"])
def stream_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        flat = telemetry.updates(fx.steps(spark, sf_dir), "run", "step", ["loss", "grad"])
        out = _in_instalments(spark, flat, live.live_meters, "step", "meters")
    finally:
        spark.conf.set(provider, before)
    return rounded(out.select("run", "step", "metric", "median", "avg", "max", "latest", "global_avg"), "median", "avg", "max", "latest", "global_avg")
