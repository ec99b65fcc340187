"""What runs leave behind, derived from the general tables: configs, summaries, scores and sources, as rows and as files."""

from __future__ import annotations

import io
import tarfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volframe.plans import fixtures as fx

#: The runs: a recipe and a seed, as in the scores; the number in a recipe's name sets the rest.
RUN_SQL = f"{fx.SCORES_SQL}, rn AS (SELECT DISTINCT recipe || '-' || seed AS run, recipe, seed, substring(recipe, 2)::INT AS k FROM fx_scores)"
#: Documents are texts made in either engine by the same concatenation, keys in no order, nested, with and without parts.
CONFIG = """'{"seed": ' || seed || ', "name": "recipe number ' || k || CASE WHEN seed = 2 THEN ' of seeds' ELSE '' END || '", "model": {"patch": [8, 8, 8], "depth": ' || (k + 1) || '}' || CASE WHEN k % 2 = 0 THEN ', "notes": "h\\u00e9 \\"q\\""' WHEN k % 3 = 0 THEN ', "notes": null' ELSE '' END || '}'"""
SUMMARY = """'{"step": ' || (k * 100 + seed) || ', "done": true, "gpu": "G' || k || '", "cpus": ' || (8 + seed) || CASE WHEN k % 3 < 2 THEN ', "git": {"sha": "abc' || k || '", "dirty": false' || CASE WHEN k % 3 = 0 THEN ', "remote": "r/' || k || '"' ELSE '' END || '}' ELSE ', "git": null' END || '}'"""
SOURCE = "'depth = ' || (k + 1) || chr(10) || '# \"seed\" ' || seed || chr(10)"
#: Which parts a run has: the summary, the scores and the sources are missing here and there.
HAS = {"config": "NOT (k = 1 AND seed = 0)", "summary": "NOT (k = 2 AND seed = 1)", "scores": "NOT (k = 3 AND seed < 2)", "sources": "NOT (k = 3 AND seed = 0)"}


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, recipe, seed, k) of every run."""
    s = fx.scores(spark, sf_dir).select("recipe", "seed").distinct()
    return s.selectExpr("concat(recipe, '-', seed) AS run", "recipe", "seed", "CAST(substring(recipe, 2) AS INT) AS k")


def parts(spark: SparkSession, sf_dir: str, whole: bool = False) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(run, config), (run, summary), (run, scores) and (run, name, text) of the source members; whole: nothing is missing."""
    runs = run_rows(spark, sf_dir)
    of = lambda p: runs if whole else runs.where(HAS[p])
    text = lambda sql: F.expr(sql.replace("\\u", "\\\\u").replace('\\"', '\\\\"'))  # noqa: E731  Spark reads a backslash in a string
    scores = fx.scores(spark, sf_dir).withColumn("run", F.concat_ws("-", "recipe", "seed"))
    maps = scores.groupBy("run").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("task", "raw")))).alias("scores"), F.round(F.avg("raw") + 1e-9, 6).alias("_m"))
    maps = maps.withColumn("scores", F.map_concat("scores", F.create_map(F.lit("open"), F.col("_m"), F.lit("all"), F.col("_m"))))
    maps = maps.withColumn("scores", F.when(F.col("run").endswith("-1") & F.col("run").startswith("r4"), F.map_filter("scores", lambda k, v: k != "open")).otherwise(F.col("scores")))
    members = of("sources").select("run", F.explode(F.expr(f"array(struct('b.py' AS name, {SOURCE} AS text), struct('a.yml' AS name, concat('k: ', k) AS text), struct('data.bin' AS name, 'no' AS text))")).alias("m")).select("run", "m.name", "m.text")
    return of("config").select("run", text(CONFIG).alias("config")), of("summary").select("run", text(SUMMARY).alias("summary")), of("scores").join(maps, "run").select("run", "scores"), members


def write_run_folders(spark: SparkSession, sf_dir: str, root: str) -> None:
    """root/<part>/run=<run>/...: configs and summaries as documents, scores as {"summary": {task: {"score": x}}}, members in a
    tar.gz for each run. The folders are written by tasks."""
    configs, summaries, scores, members = parts(spark, sf_dir)
    configs.select("run", F.col("config").alias("value")).write.partitionBy("run").text(f"{root}/config")
    summaries.select("run", F.col("summary").alias("value")).write.partitionBy("run").text(f"{root}/summary")
    scores.select("run", F.to_json(F.struct(F.transform_values("scores", lambda k, v: F.struct(v.alias("score"))).alias("summary"))).alias("value")).write.partitionBy("run").text(f"{root}/scores")
    files = members.groupBy("run").agg(F.collect_list(F.struct("name", "text")).alias("files"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        where, at = fs.FileSystem.from_uri(f"{root}/sources")
        for b in batches:
            for run, own in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = io.BytesIO()
                with tarfile.open(fileobj=raw, mode="w:gz") as tar:
                    for f in own:
                        info = tarfile.TarInfo(f["name"])
                        info.size = len(f["text"].encode())
                        tar.addfile(info, io.BytesIO(f["text"].encode()))
                where.create_dir(f"{at}/run={run}", recursive=True)
                with where.open_output_stream(f"{at}/run={run}/source.tar.gz", compression=None) as out:
                    out.write(raw.getvalue())
            yield b.select(["run"])

    files.mapInArrow(pack, "run string").count()
