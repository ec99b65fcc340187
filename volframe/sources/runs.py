"""What training and evaluation runs leave behind: step logs, summaries, scores, configs and source archives."""

from __future__ import annotations

import io
import json
import tarfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volframe.operators.leaderboard import REVIEW_SUFFIXES

STEPLOG = "step long, loss double, lr double, grad double, vol_per_sec double, tflop_per_sec double, watts double, run string, attempt int, ts timestamp, energy_mj long"
SUMMARY = """step long, images long, epochs double, train_flops double, wall_seconds double, start_step long, done boolean, stopped_by_signal boolean,
final_loss double, num_params long, peak_memory_gb double, gpu string, cpus int, torch string, cuda string, git struct<sha:string,branch:string,dirty:boolean,remote:string>"""
SCORE_MAP = "summary map<string,struct<score:double>>"


def run_of(path):
    """A file's folder; of one written by partition, what follows `run=`."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -2), "^run=", "")


#: Where a line that is no step goes, whole.
CORRUPT = "corrupt_line"


def read_step_log(spark: SparkSession, path: str, stream: bool = False, files_per_batch: int | None = None) -> DataFrame:
    """(STEPLOG, corrupt_line) of JSON lines; the token NaN is a number. Fields that a line lacks, as of runs from before a
    field was logged, are null. A line that is no JSON, or has a field of another type, keeps its text in corrupt_line,
    where sound lines have null; see sound_steps and corrupt_lines. stream: the same rows as files are added, in
    micro-batches of files_per_batch files."""
    reader = spark.readStream if stream else spark.read
    if stream and files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.schema(f"{STEPLOG}, {CORRUPT} string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", CORRUPT).json(path)


def sound_steps(log: DataFrame) -> DataFrame:
    """The steps of a log: lines that were read and say which run and step they are of."""
    return log.where(F.col(CORRUPT).isNull() & F.col("run").isNotNull() & F.col("step").isNotNull()).drop(CORRUPT)


def corrupt_lines(log: DataFrame) -> DataFrame:
    """(line): the lines that sound_steps leaves out, as they are; what can be read of one without run or step, as JSON."""
    rest = log.where(F.col(CORRUPT).isNotNull() | F.col("run").isNull() | F.col("step").isNull())
    return rest.select(F.coalesce(CORRUPT, F.to_json(F.struct(*(c for c in rest.columns if c != CORRUPT)))).alias("line"))


def read_summaries(spark: SparkSession, path: str) -> DataFrame:
    """(run, ...) of one JSON document for each run; the run is its file's folder."""
    return spark.read.schema(SUMMARY).json(path, multiLine=True).select(run_of(F.col("_metadata.file_path")).alias("run"), "*")


def read_score_maps(spark: SparkSession, path: str) -> DataFrame:
    """(run, summary): a map of task to struct with a score."""
    files = spark.read.text(path, wholetext=True).select(run_of(F.col("_metadata.file_path")).alias("run"), "value")
    return files.select("run", F.from_json("value", SCORE_MAP)["summary"].alias("summary"))


def read_configs(spark: SparkSession, path: str) -> DataFrame:
    """(run, name, notes, config) of YAML files; config is the whole document as JSON with sorted keys."""

    @F.pandas_udf("string")
    def as_json(text: pd.Series) -> pd.Series:
        import yaml

        return text.map(lambda t: json.dumps(yaml.safe_load(t), sort_keys=True, default=str))

    files = spark.read.text(path, wholetext=True).select(run_of(F.col("_metadata.file_path")).alias("run"), as_json("value").alias("config"))
    return files.select("run", F.get_json_object("config", "$.name").alias("name"), F.get_json_object("config", "$.notes").alias("notes"), "config")


def read_sources(spark: SparkSession, path: str, suffixes=REVIEW_SUFFIXES) -> DataFrame:
    """(run, name, text): the regular files with one of the suffixes in each tar.gz archive."""
    files = spark.read.format("binaryFile").load(path).select(run_of(F.col("path")).alias("run"), "content")

    def members(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for run, content in zip(frame["run"], frame["content"], strict=True):
                with tarfile.open(fileobj=io.BytesIO(content), mode="r:gz") as tar:
                    rows += [(run, m.name, tar.extractfile(m).read().decode()) for m in tar if m.isfile() and m.name.endswith(suffixes)]
            yield pd.DataFrame(rows, columns=["run", "name", "text"])

    return files.mapInPandas(members, "run string, name string, text string")
