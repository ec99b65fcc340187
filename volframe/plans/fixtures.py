"""The library's tables, derived from general ones, for its registered queries: each in Spark SQL and in plain SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


SUFFIX = """CASE doc_id % 7 WHEN 1 THEN 'T2w' WHEN 2 THEN 'FLAIR' WHEN 3 THEN 'dwi' WHEN 4 THEN concat('dwi_bval', CAST(800 + ((doc_id * 37) % 400) AS VARCHAR(20)))
  WHEN 5 THEN 'bold' ELSE 'T1w' END AS suffix"""
DWI_TYPE = "CASE WHEN doc_id % 7 = 3 THEN 'b0' WHEN doc_id % 7 = 4 AND doc_id % 2 = 0 THEN 'mean' WHEN doc_id % 7 = 4 THEN 'single' END AS dwi_type"


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars").join(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "left")
    return docs.selectExpr(
        "doc_id", "n_chars", "concat('source/', source, '/', lang, '/', lpad(CAST(doc_id AS STRING), 8, '0'), '.nii.gz') AS path", "source AS collection",
        "concat('sub-', (doc_id div 20) % 6) AS subject", SUFFIX, DWI_TYPE, "CASE WHEN toxic = 1 THEN array('toxic') ELSE CAST(array() AS array<string>) END AS warnings",
        "array(200D, 150D, 80D + least(n_chars % 97, (n_chars div 7) % 89 + 10)) AS mask_extent",
    )


IMAGES_SQL = f"""fx_images AS (SELECT doc_id, n_chars, 'source/' || source || '/' || lang || '/' || lpad(doc_id::VARCHAR, 8, '0') || '.nii.gz' AS path, source AS collection,
  'sub-' || ((doc_id // 20) % 6) AS subject, {SUFFIX}, {DWI_TYPE}, CASE WHEN toxic = 1 THEN ['toxic'] ELSE [] END AS warnings,
  [200::DOUBLE, 150::DOUBLE, 80 + least(n_chars % 97, (n_chars // 7) % 89 + 10)::DOUBLE] AS mask_extent FROM documents LEFT JOIN labels USING (doc_id))"""
#: Label, checks and key of the selection in plain SQL.
CHECKED_SQL = f"""{IMAGES_SQL}, bv AS (SELECT *, TRY_CAST(regexp_extract(suffix, '^dwi_bval(\\d+)$', 1) AS DOUBLE) AS b FROM fx_images),
lab AS (SELECT *, CASE WHEN coalesce(dwi_type = 'mean' AND b BETWEEN 900 AND 1100, false) THEN 'dwi_b1000' WHEN dwi_type = 'b0' THEN 'dwi_b0' WHEN suffix IN ('T1w', 'T2w', 'FLAIR') THEN suffix END AS sequence FROM bv),
chk AS (SELECT *, sequence IS NOT NULL AS s1, len(warnings) = 0 AS s2, len(list_filter(mask_extent, lambda x: x IS NULL OR isnan(x))) = 0 AND list_min(mask_extent) >= 100 AS s3 FROM lab),
fin AS (SELECT *, row_number() OVER (PARTITION BY collection, subject, sequence ORDER BY path) AS rn FROM chk WHERE s1 AND s2 AND s3)"""
DERIVED_SQL = "'derivatives/' || regexp_replace(regexp_replace(path, '^source/', ''), '\\.nii\\.gz$', '') || '.npz'"


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    from volframe.operators.curate import derivative_path

    i = images(spark, sf_dir)
    before = "coalesce(sum(n_chars) OVER (PARTITION BY doc_id % 16 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)"
    return i.withColumn("path", derivative_path(F.col("path"))).selectExpr("path", "concat('shard-', doc_id % 16) AS shard", f"{before} AS offset", "n_chars AS size")


SHARDS_SQL = f"""fx_shards AS (SELECT {DERIVED_SQL} AS path, 'shard-' || (doc_id % 16) AS shard,
  coalesce(sum(n_chars) OVER (PARTITION BY doc_id % 16 ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS "offset", n_chars AS size FROM fx_images)"""

#: x, y, z, patch and place in the patch of voxel i of a 4 x 4 x 4 volume with patches of edge 2.
VOXELS = 64


def volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packed volumes: (path, label, values, scale, mask_rle, shape, affine) and the dense mask and voxels they come from."""
    e = table(spark, sf_dir, "embeddings").selectExpr("concat('vol-', vec_id) AS path", "label", "inline(transform(array(transform(embedding, x -> CAST(x AS DOUBLE))), d -> struct(d AS dense, transform(d, x -> x > -0.1D) AS mask)))")
    change = "filter(sequence(0, 63), i -> i > 0 AND mask[i] <> mask[i - 1])"
    e = e.select("*", F.expr(f"explode(array(concat(IF(mask[0], array(0, 0), array(0)), {change}, array(64)))) AS edges"))  # each array is made once a row
    return e.selectExpr(
        "path", "label", "dense", "mask", "transform(filter(arrays_zip(dense, mask), v -> v.mask), v -> CAST(rint(v.dense * 1000D) AS INT)) AS values", "0.001D AS scale",
        "transform(sequence(1, size(edges) - 1), i -> CAST(edges[i] - edges[i - 1] AS BIGINT)) AS mask_rle", "array(4, 4, 4) AS shape", f"{AFFINE_SPARK} AS affine",
    )


def _affines(form):
    eye = form([[1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    two = form([[2, 0, 0, 0], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    flip = form([[-1, 0, 0, 3], [0, 1, 0, 0], [0, 0, 1, 0], [0, 0, 0, 1]])
    turn = form([[0, 0, 1, 0], [1, 0, 0, 0], [0, 1, 0, 0], [0, 0, 0, 1]])
    return f"CASE label % 4 WHEN 0 THEN {eye} WHEN 1 THEN {two} WHEN 2 THEN {flip} ELSE {turn} END"


AFFINE_SPARK = _affines(lambda m: "array(" + ", ".join("array(" + ", ".join(f"{x}D" for x in r) + ")" for r in m) + ")")
AFFINE_SQL = _affines(lambda m: "[" + ", ".join("[" + ", ".join(f"{x}::DOUBLE" for x in r) + "]" for r in m) + "]")
#: A row for each voxel.
VOXELS_SQL = """vox AS (SELECT path, i, v, v > -0.1 AS m, i // 16 AS x, (i // 4) % 4 AS y, i % 4 AS z,
  (((i // 16) // 2) * 2 + ((i // 4) % 4) // 2) * 2 + (i % 4) // 2 AS patch_id, (((i // 16) % 2) * 2 + ((i // 4) % 4) % 2) * 2 + (i % 4) % 2 AS place
  FROM (SELECT 'vol-' || vec_id AS path, unnest(range(0, 64)) AS i, unnest(embedding)::DOUBLE AS v FROM embeddings))"""


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A step log: (run, step, ts, loss, grad, energy_mj, attempt, step_raw, event_id)."""
    e = table(spark, sf_dir, "events")
    w = "PARTITION BY event_type ORDER BY ts, event_id"
    s = e.selectExpr("event_type AS run", f"CAST(row_number() OVER ({w}) AS BIGINT) AS step", "CAST(ts AS TIMESTAMP) AS ts", "event_id", "user_id", "value AS loss",
                     f"CAST(sum(CAST(get_json_object(props, '$.k') AS BIGINT) * 1000) OVER ({w} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS energy_mj")
    return s.selectExpr("run", "step", "ts", "loss", "CASE WHEN step % 2 = 0 THEN loss END AS grad", "energy_mj", "1 + user_id % 2 AS attempt", "1 + (step - 1) % 500 AS step_raw", "event_id")


STEPS_SQL = """st0 AS (SELECT event_type AS run, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS step, ts, event_id, user_id, value AS loss,
  sum((json_extract_string(props, '$.k'))::BIGINT * 1000) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)::BIGINT AS energy_mj FROM events),
fx_steps AS (SELECT run, step, ts, loss, CASE WHEN step % 2 = 0 THEN loss END AS grad, energy_mj, 1 + user_id % 2 AS attempt, 1 + (step - 1) % 500 AS step_raw, event_id FROM st0)"""


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw scores: (recipe, seed, task, kind, raw)."""
    g = table(spark, sf_dir, "lineitem").groupBy(F.expr("concat('r', l_suppkey % 8)").alias("recipe"), F.expr("CAST(l_linenumber % 3 AS INT)").alias("seed"), F.expr("concat(l_returnflag, l_linestatus)").alias("task"))
    return g.agg(F.round(F.avg("l_discount") * 10, 6).alias("raw")).withColumn("kind", F.expr("CASE substring(task, 1, 1) WHEN 'R' THEN 'classification' WHEN 'A' THEN 'age' ELSE 'segmentation' END"))


SCORES_SQL = """fx_scores AS (SELECT 'r' || (l_suppkey % 8) AS recipe, (l_linenumber % 3)::INT AS seed, l_returnflag || l_linestatus AS task, round(avg(l_discount) * 10, 6) AS raw,
  CASE l_returnflag WHEN 'R' THEN 'classification' WHEN 'A' THEN 'age' ELSE 'segmentation' END AS kind FROM lineitem GROUP BY 1, 2, 3, l_returnflag)"""
