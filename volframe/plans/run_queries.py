"""Registered queries over what runs leave behind: their files, their assembly and documents, and logs as streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from volframe.operators import leaderboard, submissions, telemetry
from volframe.plans import fixtures as fx
from volframe.plans import run_fixtures as rx
from volframe.plans.queries import ORACLE_SQL, query, rounded
from volframe.plans.scratch import scratch_path
from volframe.sources import runs
from volframe.streaming import live

# Files of runs

_HAS = rx.HAS
#: run, what the files of each part say, for runs that have the part.
_FILES_SQL = f"""WITH {rx.RUN_SQL}, c AS (SELECT run, 'recipe number ' || k || CASE WHEN seed = 2 THEN ' of seeds' ELSE '' END AS name, CASE WHEN k % 2 = 0 THEN 'hé "q"' END AS notes, k + 1 AS depth FROM rn WHERE {_HAS["config"]}),
s AS (SELECT run, (k * 100 + seed)::BIGINT AS step, 8 + seed AS cpus, CASE WHEN k % 3 < 2 THEN 'abc' || k END AS sha FROM rn WHERE {_HAS["summary"]}),
t AS (SELECT recipe || '-' || seed AS run, count(*) AS tasks, round(sum(raw), 6) AS total FROM fx_scores GROUP BY 1), e AS (SELECT run, tasks + CASE WHEN run = 'r4-1' THEN 0 ELSE 1 END AS tasks, total FROM t JOIN rn USING (run) WHERE {_HAS["scores"]}),
f AS (SELECT run, 2::BIGINT AS files, (length({rx.SOURCE}) + 3 + length(k::VARCHAR))::BIGINT AS chars FROM rn WHERE {_HAS["sources"]})"""


def _folders(spark: SparkSession, sf_dir: str) -> str:
    root = scratch_path(spark, "runs")
    rx.write_run_folders(spark, sf_dir, root)
    return root


@query(f"{_FILES_SQL} SELECT run, name, notes, depth::INT AS depth FROM c")
def run_configs(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = runs.read_configs(spark, f"{_folders(spark, sf_dir)}/config/*/*.txt")
    return c.select("run", "name", "notes", F.get_json_object("config", "$.model.depth").cast("int").alias("depth"))


@query(f"{_FILES_SQL} SELECT run, step, cpus::INT AS cpus, sha FROM s")
def run_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.read_summaries(spark, f"{_folders(spark, sf_dir)}/summary/*/*.txt").select("run", "step", "cpus", "git.sha")


@query(f"{_FILES_SQL} SELECT run, tasks FROM e")
def run_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tasks of each run with a score; the row for all of them is left out."""
    return leaderboard.score_rows(runs.read_score_maps(spark, f"{_folders(spark, sf_dir)}/scores/*/*.txt")).groupBy("run").agg(F.count("score").alias("tasks"))


@query(f"{_FILES_SQL} SELECT run, files, chars FROM f")
def run_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of each run's archive that a reviewer reads."""
    members = runs.read_sources(spark, f"{_folders(spark, sf_dir)}/sources/*/*.tar.gz")
    return members.groupBy("run").agg(F.count("*").alias("files"), F.sum(F.char_length("text")).alias("chars"))


# Assembly and documents

_MISSING = ", ".join(f"CASE WHEN NOT ({_HAS[p]}) THEN '{p}' END" for p in submissions.PARTS)


def _assembled(spark: SparkSession, sf_dir: str, whole: bool = False) -> DataFrame:
    configs, summaries, scores, members = rx.parts(spark, sf_dir, whole)
    return submissions.assemble(configs, summaries, scores, submissions.source_maps(members))


@query(f"WITH {rx.RUN_SQL}, m AS (SELECT run, list_filter([{_MISSING}], lambda p: p IS NOT NULL) AS missing FROM rn) SELECT run, array_to_string(missing, ',') AS missing FROM m WHERE len(missing) < 4")
def run_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every run that any part knows of, and the parts it lacks."""
    return _assembled(spark, sf_dir).select("run", F.array_join("missing", ",").alias("missing"))


#: The same documents put together by hand, keys in order.
_NAME = "'recipe number ' || k || CASE WHEN seed = 2 THEN ' of seeds' ELSE '' END"
_DOC_SQL = f"""WITH {rx.RUN_SQL}, sc AS (SELECT recipe || '-' || seed AS run, round(avg(raw) + 1e-9, 6) AS m, list(task || chr(0) || raw ORDER BY task) AS ts FROM fx_scores GROUP BY 1),
x AS (SELECT rn.*, {_NAME} AS name, {_HAS["config"]} AS hc, {_HAS["summary"]} AS hs, {_HAS["scores"]} AS he, {_HAS["sources"]} AS hf, m, ts FROM rn JOIN sc USING (run)),
y AS (SELECT *, CASE WHEN hc AND k % 2 = 0 THEN 'hé \\"q\\"' ELSE '' END AS notes, CASE WHEN hc THEN name ELSE '' END AS title,
  CASE WHEN hs AND k % 3 < 2 THEN '"abc' || k || '"' ELSE 'null' END AS sha, CASE WHEN hs AND k % 3 = 0 THEN '"r/' || k || '"' ELSE 'null' END AS remote, CASE WHEN hs AND k % 3 < 2 THEN 'false' ELSE 'null' END AS dirty,
  {rx.CONFIG} AS config, NOT he OR run = 'r4-1' AS unscored FROM x),
z AS (SELECT *, list_filter([CASE WHEN NOT hc THEN '"config is missing"' END, CASE WHEN NOT hs THEN '"summary is missing"' END, CASE WHEN NOT he THEN '"scores is missing"' END, CASE WHEN NOT hf THEN '"sources is missing"' END,
    CASE WHEN unscored THEN '"no open score, the evaluation is incomplete"' END, CASE WHEN length(title) > 20 THEN '"name ''' || title || ''' is longer than 20 characters"' END], lambda e: e IS NOT NULL) AS errors,
  list_concat(CASE WHEN hf THEN ['"a.yml":"k: ' || k || '"', '"b.py":"depth = ' || (k + 1) || '\\n# \\"seed\\" ' || seed || '\\n"'] ELSE [] END, CASE WHEN hc THEN ['"config.yaml":' || to_json(config)::VARCHAR] ELSE [] END) AS files,
  CASE WHEN he THEN list_transform(list_sort(list_concat(CASE WHEN run = 'r4-1' THEN [] ELSE ['open' || chr(0) || m] END, ts)), lambda t: '"' || string_split(t, chr(0))[1] || '":' || string_split(t, chr(0))[2]) ELSE [] END AS metrics FROM y),
d AS (SELECT run, name, errors, '{{"artifacts":[],"contributor":{{"login":null}},"notes":"' || notes || '","repo":{{"branch":null,"commit":' || sha || ',"dirty":' || dirty || ',"remote":' || remote
  || ',"review_files":{{"files":{{' || array_to_string(files, ',') || '}},"source":"source.tar.gz"}}}},"run":{{"command":"{submissions.COMMAND}","config":'
  || CASE WHEN hc THEN '{{"model":{{"depth":' || (k + 1) || ',"patch":[8,8,8]}},"name":"' || name || '"' || CASE WHEN k % 2 = 0 THEN ',"notes":"' || notes || '"' WHEN k % 3 = 0 THEN ',"notes":null' ELSE '' END || ',"seed":' || seed || '}}' ELSE 'null' END || ',"ended_at":' AS head,
  ',"environment":{{"engine":"spark"}},"family":"{submissions.FAMILY}","hardware":"' || CASE WHEN hs THEN 'G' || k || ' (single GPU, ' || (8 + seed) || ' CPUs)' ELSE 'unknown (single GPU, unknown CPUs)' END || '","label":"' || title || '","metrics":{{' || array_to_string(metrics, ',')
  || '}},"name":"' || run || '","summary":' || CASE WHEN hs THEN '{{"cpus":' || (8 + seed) || ',"done":true,"git":' || CASE WHEN k % 3 < 2 THEN '{{"dirty":false' || CASE WHEN k % 3 = 0 THEN ',"remote":"r/' || k || '"' ELSE '' END || ',"sha":"abc' || k || '"}}' ELSE 'null' END
  || ',"gpu":"G' || k || '","step":' || (k * 100 + seed) || '}}' ELSE 'null' END || ',"tier":"full","validation_errors":[' || array_to_string(errors, ',') || ']}},"status":"completed","title":"' || title || '","version":1}}' AS tail, 2020 + k AS year FROM z WHERE hc OR hs OR he OR hf)
SELECT run, head || '"' || year || '-03-04T05:06:07Z"' || tail AS payload, substring(sha256(head || 'null' || tail), 1, 10) AS submission_id, len(errors) = 0 AS valid FROM d"""


@query(_DOC_SQL)
def submission_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole document of every run, complete or not, with its id."""
    ended = _assembled(spark, sf_dir).withColumn("ended", F.make_timestamp(F.lit(2020) + F.substring("run", 2, 1).cast("int"), F.lit(3), F.lit(4), F.lit(5), F.lit(6), F.lit(7).cast("decimal(8,6)")))
    return submissions.documents(ended, "open", {"engine": "spark"}, "ended").select("run", "payload", "submission_id", "valid")


@query(f"WITH {rx.RUN_SQL} SELECT run, 'recipe number ' || k || CASE WHEN seed = 2 THEN ' of seeds' ELSE '' END AS title, coalesce(CASE WHEN k % 3 = 0 THEN 'r/' || k END, 'none') AS remote, k + 1 AS depth, 8 AS last_edge, 'absent' AS tag FROM rn")
def nested_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of nested documents by path, with defaults where there is nothing."""
    from volframe.functions.arrays import field

    whole = submissions.complete(_assembled(spark, sf_dir, whole=True)).withColumns({"c": F.parse_json("config"), "s": F.parse_json("summary")})
    return whole.select("run", field(F.col("c"), "$.name").alias("title"), field(F.col("s"), "$.git.remote", "none").alias("remote"), field(F.col("c"), "$.model.depth", 0, "int").alias("depth"), field(F.col("c"), "$.model.patch[2]", 0, "int").alias("last_edge"), field(F.col("c"), "$.model.tags[0]", "absent").alias("tag"))


@query(f"WITH {rx.RUN_SQL} SELECT run, 3::BIGINT AS files FROM rn WHERE {_HAS['config']} OR {_HAS['summary']} OR {_HAS['scores']} OR {_HAS['sources']}")
def submission_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written in a folder for each run and read back: objects in each document's repo, run and contributor."""
    at = scratch_path(spark, "submissions")
    leaderboard.write_submissions(submissions.documents(_assembled(spark, sf_dir)), at)
    read = spark.read.text(f"{at}/*/*.txt").select(F.parse_json("value").alias("d"), F.col("_metadata.file_path").alias("f"))
    there = lambda p: F.try_variant_get("d", p, "string").isNotNull().cast("long")
    return read.select(runs.run_of(F.col("f")).alias("run"), (there("$.repo.review_files") + there("$.run.validation_errors") + there("$.contributor")).alias("files"))


# Logs as streams


def _log_folder(spark: SparkSession, sf_dir: str) -> str:
    """The step log as JSON lines in three instalments, in order of step. The first is from before energy was logged; every
    97th event's line broke off."""
    at, log = scratch_path(spark, "steplog"), fx.steps(spark, sf_dir)
    thirds = F.least(F.floor(F.col("step") * 3 / (F.lit(1) + F.lit(log.count()) / 5)), F.lit(2))
    early = F.to_json(F.struct("run", "step", "loss", "grad", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts")))
    late = F.to_json(F.struct("run", "step", "loss", "grad", F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("ts"), "energy_mj"))
    line = F.when(F.col("step") < 100, early).otherwise(late)
    lines = log.select(F.when(F.col("event_id") % 97 == 0, F.concat(F.lit('{"run": "'), "run", F.lit('", "step": '), F.col("step").cast("string"))).otherwise(line).alias("value"), thirds.alias("third"))
    kept = scratch_path(spark, "lines")
    lines.write.parquet(kept)
    for i in range(3):
        spark.read.parquet(kept).where(F.col("third") == i).select("value").repartition(2).write.mode("append").text(at)
    return at


_SOUND_SQL = f"{fx.STEPS_SQL.replace('fx_steps AS', 'all_steps AS')}, fx_steps AS (SELECT * FROM all_steps WHERE event_id % 97 <> 0)"


def _with_rocks(spark: SparkSession, work):
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        return work()
    finally:
        spark.conf.set(provider, before)


@query(ORACLE_SQL["rolling_meters"].replace(fx.STEPS_SQL, _SOUND_SQL))
def stream_log_meters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live log through its meters: instalment by instalment, stopped after the first and gone on with."""
    at, out, state = (scratch_path(spark, x) for x in ("steplog-in", "log-meters", "log-meters-state"))
    at = _log_folder(spark, sf_dir)

    def work() -> None:
        stream = lambda: live.live_meters(telemetry.updates(runs.sound_steps(runs.read_step_log(spark, at, stream=True, files_per_batch=2)), "run", "step", ["loss", "grad"]))
        live.advance(stream(), "append", out, state, most_batches=1)
        live.advance(stream(), "append", out, state)

    _with_rocks(spark, work)
    found = spark.read.parquet(out).select("run", "step", "metric", "median", "avg", "max", "latest", "global_avg")
    return rounded(found, "median", "avg", "max", "latest", "global_avg")


@query(f"""WITH {_SOUND_SQL} SELECT run, strftime(time_bucket(INTERVAL '1 hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS steps, (round(count(*) * 32.0 / 3600 + 1e-9, 6) + 0.0) AS rate FROM fx_steps GROUP BY 1, 2""")
def stream_log_throughput(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A live log through its throughput, stopped between micro-batches and relaunched from its checkpoint until all is read."""
    at, out, state = _log_folder(spark, sf_dir), scratch_path(spark, "log-rate"), scratch_path(spark, "log-rate-state")
    while live.advance(live.live_throughput(runs.sound_steps(runs.read_step_log(spark, at, stream=True, files_per_batch=2)), "1 hour", "3650 days", 32), "update", out, state, most_batches=1):
        pass
    last = spark.read.parquet(out).groupBy("run", "start").agg(F.max_by(F.struct("steps", "rate"), "batch").alias("r"))
    return rounded(last.select("run", F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "r.steps", "r.rate"), "rate")


@query(f"""WITH {fx.STEPS_SQL} SELECT '{{"run": "' || run || '", "step": ' || step AS line FROM fx_steps WHERE event_id % 97 = 0""")
def stream_log_corrupt(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of a live log that are no steps, whole."""
    at, out = _log_folder(spark, sf_dir), scratch_path(spark, "log-corrupt")
    live.finished(runs.corrupt_lines(runs.read_step_log(spark, at, stream=True)), "append", out, scratch_path(spark, "log-corrupt-state"))
    return spark.read.parquet(out).select("line")


@query(f"WITH {_SOUND_SQL} SELECT run, step, energy_mj IS NULL OR step < 100 AS before_energy FROM fx_steps")
def step_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as a batch: a field that early lines lack is null there."""
    return runs.sound_steps(runs.read_step_log(spark, _log_folder(spark, sf_dir))).select("run", "step", F.col("energy_mj").isNull().alias("before_energy"))


@query(f"WITH {fx.STEPS_SQL}, l AS (SELECT run, step FROM fx_steps WHERE step <= 150) SELECT run, max(step) AS step, count(*) AS steps FROM l GROUP BY run")
def stop_at_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs that end at a number of steps, whatever time they took."""
    log = fx.steps(spark, sf_dir).select("run", "step", F.lit(1).alias("seconds"))
    return telemetry.budget_cut(log, "run", "step", "seconds", limit_s=None, total_steps=150).groupBy("run").agg(F.max("step").alias("step"), F.count("*").alias("steps"))
