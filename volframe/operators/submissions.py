"""Submissions: the parts of a run joined strictly, and the whole document of each with its checks and its id."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from volframe.functions.arrays import canonical, digest10, field
from volframe.operators.leaderboard import GROUP_ROW, NAME_MOST, review_files

# Fixed values of the document.
VERSION, STATUS, TIER, FAMILY, COMMAND, ARCHIVE, CONFIG_FILE = 1, "completed", "full", "volframe", "python -m train --config config.yaml", "source.tar.gz", "config.yaml"
PARTS = ("config", "summary", "scores", "sources")


def source_maps(members: DataFrame) -> DataFrame:
    """(run, sources): a map of file name to text of the members (run, name, text) that a reviewer reads, names ascending.
    A run without such files has an empty map; a name that a run has twice is an error."""
    kept = review_files(members).groupBy("run").agg(F.array_sort(F.collect_list(F.struct("name", "text"))).alias("_files"))
    return members.select("run").distinct().join(kept, "run", "left").select("run", F.map_from_entries(F.coalesce("_files", F.array().cast("array<struct<name:string,text:string>>"))).alias("sources"))


def assemble(configs: DataFrame, summaries: DataFrame, scores: DataFrame, sources: DataFrame) -> DataFrame:
    """(run, config, summary, scores, sources, missing): a row for each run that any part knows of, and which of its parts
    are missing, in the order of PARTS; nothing is dropped.

    configs: (run, config), a JSON text. summaries: (run, summary), a JSON text. scores: (run, scores), a map of task to
    score. sources: (run, sources), a map of file to text. The parts meet in one aggregate by run, not in a chain of
    joins. A run that one part has twice is an error, and so is a null run; a part whose value is null is missing.
    """
    parts = dict(zip(PARTS, (configs, summaries, scores, sources), strict=True))
    kinds = {p: df.schema[p].dataType.simpleString() for p, df in parts.items()}
    tagged = [df.select("run", F.lit(p).alias("_part"), *(F.col(c) if c == p else F.lit(None).cast(kinds[c]).alias(c) for c in PARTS)) for p, df in parts.items()]
    rows = reduce(DataFrame.unionByName, tagged)
    rows = rows.where(F.when(F.col("run").isNotNull(), True).otherwise(F.raise_error(F.concat(F.lit("a null run in: "), F.col("_part")))))
    met = rows.groupBy("run").agg(*(F.first(p, ignorenulls=True).alias(p) for p in PARTS), *(F.count_if(F.col("_part") == p).alias(f"_n_{p}") for p in PARTS))
    twice = F.filter(F.array(*(F.when(F.col(f"_n_{p}") > 1, p) for p in PARTS)), lambda p: p.isNotNull())
    once = F.when(F.size(twice) == 0, True).otherwise(F.raise_error(F.concat(F.lit("twice for run "), F.col("run"), F.lit(": "), F.array_join(twice, ", "))))
    missing = F.filter(F.array(*(F.when(F.col(p).isNull(), p) for p in PARTS)), lambda p: p.isNotNull())
    return met.where(once).select("run", *PARTS, missing.alias("missing"))


def complete(assembled: DataFrame) -> DataFrame:
    """assembled without `missing`; a run that lacks a part is an error that names it and what it lacks."""
    said = F.concat(F.lit("run "), F.col("run"), F.lit(" lacks "), F.array_join("missing", ", "))
    return assembled.where(F.when(F.size("missing") == 0, True).otherwise(F.raise_error(said))).drop("missing")


def checked(assembled: DataFrame, group: str) -> Column:
    """What is wrong with a run's submission: a missing part, a task group without a score, a name that is too long."""
    name = field(F.parse_json("config"), "$.name", "")
    return F.filter(
        F.concat(
            F.transform("missing", lambda p: F.concat(p, F.lit(" is missing"))),
            F.array(
                F.when(F.get(F.map_values(F.map_filter("scores", lambda k, v: k == group)), F.lit(0)).isNull(), F.lit(f"no {group} score, the evaluation is incomplete")),
                F.when(F.char_length(name) > NAME_MOST, F.concat(F.lit("name '"), name, F.lit(f"' is longer than {NAME_MOST} characters"))),
            ),
        ),
        lambda m: m.isNotNull(),
    )


def documents(assembled: DataFrame, group: str = "open", environment: dict[str, str] | None = None, ended_at: str | None = None) -> DataFrame:
    """(run, name, payload, submission_id, ended_at, validation_errors, valid) of every assembled run.

    payload is the whole document as JSON, keys sorted at every depth: title and notes from the config, the repository
    from the summary's `git` (each field null where it is absent), sources with the config among them, the config and the
    summary as they are, scores without the row for all tasks, the environment and the errors. submission_id is ten
    digits of its SHA-256, taken while ended_at is null, so that it is the same whenever the document is made. ended_at: a
    timestamp column, now by default; it is stated in UTC. A missing part leaves its fields null and is an error in the
    document, not a lost run.
    """
    config, summary = F.parse_json("config"), F.parse_json("summary")
    name, notes = field(config, "$.name", ""), field(config, "$.notes", "")
    git = lambda f, kind="string": field(summary, f"$.git.{f}", kind=kind)
    hardware = F.concat(field(summary, "$.gpu", "unknown"), F.lit(" (single GPU, "), field(summary, "$.cpus", "unknown"), F.lit(" CPUs)"))
    files = F.map_concat(F.coalesce("sources", F.create_map().cast("map<string,string>")), F.when(F.col("config").isNotNull(), F.create_map(F.lit(CONFIG_FILE), F.col("config"))).otherwise(F.create_map().cast("map<string,string>")))
    of = lambda **x: F.struct(*(c.alias(k) for k, c in x.items()))
    none, text = F.lit(None).cast("string"), lambda c: F.lit(c)
    rows = assembled.withColumns({"name": name, "validation_errors": checked(assembled, group)})
    at = F.date_format(F.to_utc_timestamp(F.col(ended_at) if ended_at else F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    whole = lambda ended: of(
        version=text(VERSION), title=F.col("name"), status=text(STATUS), notes=notes, contributor=of(login=none), artifacts=F.array().cast("array<string>"),
        repo=of(remote=git("remote"), branch=git("branch"), commit=git("sha"), dirty=git("dirty", "boolean"), review_files=of(source=text(ARCHIVE), files=files)),
        run=of(
            name=F.col("run"), label=F.col("name"), tier=text(TIER), family=text(FAMILY), command=text(COMMAND), hardware=hardware, ended_at=ended, config=config, summary=summary,
            metrics=F.map_filter(F.coalesce("scores", F.create_map().cast("map<string,double>")), lambda k, v: k != GROUP_ROW),
            environment=F.create_map(*(F.lit(x) for kv in sorted((environment or {}).items()) for x in kv)) if environment else F.create_map().cast("map<string,string>"),
            validation_errors=F.col("validation_errors"),
        ),
    )
    out = rows.withColumns({"ended_at": at, "submission_id": digest10(canonical(whole(none)))})
    return out.select("run", "name", canonical(whole(F.col("ended_at"))).alias("payload"), "submission_id", "ended_at", "validation_errors", (F.size("validation_errors") == 0).alias("valid"))
