import io
import json
import tarfile

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from volframe.functions.arrays import lower_median
from volframe.operators import embed, epochs, leaderboard, telemetry
from volframe.sources import runs, shards
from volframe.streaming import live


def test_lower_median(spark):
    df = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0],), ([],), ([5.0, None],)], "v array<double>")
    assert [r[0] for r in df.select(lower_median(F.col("v"))).collect()] == [2.0, None, 5.0]


def test_meters(spark):
    log = spark.createDataFrame([("r", i, float(i), None if i % 2 else float(i)) for i in range(1, 31)], "run string, step long, loss double, grad double")
    got = {(r.metric, r.step): r for r in telemetry.rolling_meters(log, "run", "step", ["loss", "grad"]).collect()}
    assert len([k for k in got if k[0] == "grad"]) == 15
    assert got["loss", 30].median == 20 and got["loss", 30].avg == 20.5 and got["loss", 3].median == 2 and got["loss", 4].median == 2
    assert got["grad", 30].global_avg == 16
    assert telemetry.final_median(log, "run", "step", "loss").first().final == 20


def test_budget(spark):
    log = spark.createDataFrame([("r", i, 10.0) for i in range(1, 7)], "run string, step long, seconds double")
    last = lambda **k: telemetry.budget_cut(log, "run", "step", "seconds", **k).agg(F.max("step")).first()[0]
    assert (last(limit_s=30), last(limit_s=31), last(limit_s=0), last(limit_s=None), last(limit_s=1000), last(limit_s=None, total_steps=2)) == (3, 4, 6, 6, 6, 2)


def test_throughput(spark):
    log = spark.sql("SELECT 'r' AS run, id + 1 AS step, timestamp_seconds(id * 2) AS ts, IF(id = 4, NULL, id * 1000) AS mj FROM range(5)")
    got = telemetry.throughput(log, "run", "step", "ts", "mj", every=2, units=10).orderBy("window").collect()
    assert [(r.steps, r.seconds, r.rate) for r in got] == [(2, 2.0, 10.0), (2, 4.0, 5.0), (1, 2.0, 5.0)]
    assert got[0].watts == 0.5 and got[2].watts is None


def test_epochs(spark):
    items = spark.createDataFrame([(f"p{i}",) for i in range(50)], "path string")
    full = epochs.epoch_plan(items, "path", seed=3, epochs=3, batch_size=8).orderBy("pos").collect()
    assert [r.pos for r in full] == list(range(150))
    for e in range(3):
        assert sorted(r.path for r in full if r.epoch == e) == sorted(f"p{i}" for i in range(50))
    assert [r.path for r in full[:50]] != [r.path for r in full[50:100]]
    for start in (0, 24, 50):
        assert epochs.epoch_plan(items, "path", seed=3, epochs=3, batch_size=8, start=start).orderBy("pos").collect() == full[start:]


def test_scores(spark):
    s = spark.createDataFrame([("r", seed, t, k, raw) for seed in (0, 1, 2) for t, k, raw in (("a", "classification", 0.5), ("b", "age", 0.2 + seed), ("c", "segmentation", 0.4)) if not (seed == 2 and t == "b")], "recipe string, seed int, task string, kind string, raw double")
    n = leaderboard.normalise_scores(s)
    assert n.where("task = 'a'").first().score == 0
    g = {r.seed: r for r in leaderboard.group_scores(n, s.select("task", "kind")).collect()}
    assert g[2].open is None and g[2].age is None and g[2].segmentation == 0.4 and g[0].open == pytest.approx(0.2)
    assert leaderboard.seed_median(leaderboard.group_scores(n, s.select("task", "kind"))).first().age == pytest.approx(0.2)


def test_submissions(spark):
    rows = [("a", "n" * 20, None, 0.5, {"open": 0.5}), ("b", "n" * 21, "x", 0.5, {"open": 0.5}), ("c", None, "x", None, {})]
    df = spark.createDataFrame(rows, "run string, name string, notes string, open double, metrics map<string,double>")
    got = {r.run: r for r in leaderboard.submissions(df, "metrics").collect()}
    assert got["a"].valid and got["a"].notes == "" and not got["b"].valid and got["c"].validation_errors == ["task group is not scored"]
    assert [len(r.submission_id) for r in got.values()] == [10] * 3
    assert got["a"].submission_id == {r.run: r for r in leaderboard.submissions(df, "metrics").collect()}["a"].submission_id


def test_run_files(spark, tmp_path):
    for run in ("one", "two"):
        d = tmp_path / run
        d.mkdir()
        (d / "summary.json").write_text(json.dumps({"step": 5, "done": True, "git": {"sha": "x"}}, indent=1))
        (d / "scores.json").write_text(json.dumps({"summary": {"a": {"score": 0.5}, "all": {"score": 1.0}}}))
        (d / "config.yaml").write_text(f"name: {run}\nmodel:\n  depth: 2\n")
        (d / "log.json").write_text('{"step": 1, "loss": NaN}\n{"step": 2, "loss": 0.5}\n')
        with tarfile.open(d / "source.tar.gz", "w:gz") as tar:
            for name, text in (("a.py", "x = 1"), ("b.txt", "no"), ("c.yml", "y: é")):
                data = text.encode()
                info = tarfile.TarInfo(name)
                info.size = len(data)
                tar.addfile(info, io.BytesIO(data))
    at = str(tmp_path)
    s = runs.read_summaries(spark, f"{at}/*/summary.json").orderBy("run").collect()
    assert [(r.run, r.step, r.done, r.git.sha) for r in s] == [("one", 5, True, "x"), ("two", 5, True, "x")]
    maps = runs.read_score_maps(spark, f"{at}/*/scores.json")
    assert leaderboard.score_rows(maps).orderBy("run").collect() == [("one", "a", 0.5), ("two", "a", 0.5)]
    c = runs.read_configs(spark, f"{at}/*/config.yaml").orderBy("run").first()
    assert (c.name, c.notes, json.loads(c.config)["model"]) == ("one", None, {"depth": 2})
    log = runs.read_step_log(spark, f"{at}/*/log.json")
    assert log.where("isnan(loss)").count() == 2
    sources = runs.read_sources(spark, f"{at}/*/source.tar.gz")
    assert sorted((r.name, r.text) for r in sources.where("run = 'one'").collect()) == [("a.py", "x = 1"), ("c.yml", "y: é")]
    parts = [runs.read_configs(spark, f"{at}/*/config.yaml").drop("notes"), runs.read_summaries(spark, f"{at}/one/summary.json").select("run", "step"), maps, sources.groupBy("run").count()]
    assert [r.run for r in leaderboard.assembled(*parts).collect()] == ["one"]
    assert [r.run for r in leaderboard.incomplete(*parts).collect()] == ["two"]
    out = leaderboard.submissions(spark.createDataFrame([("one", "n", None, 0.5, {"open": 0.5})], "run string, name string, notes string, open double, metrics map<string,double>"), "metrics")
    leaderboard.write_submissions(out, f"{at}/out")
    assert json.loads(spark.read.text(f"{at}/out/run=one").first()[0])["run"] == "one"


def test_shards(spark, tmp_path):
    rng, rows, want = np.random.default_rng(1), [], {}
    for s in range(3):
        with open(tmp_path / f"s{s}", "wb") as f:
            for i in range(4):
                mask = rng.random((3, 3, 3)) > 0.5
                n = int(mask.sum())
                values = rng.integers(-99, 99, n).astype(np.int16)
                from volframe.operators.volumes import packed

                runs_ = packed(mask.astype(float), mask)[1]
                raw = io.BytesIO()
                np.savez(raw, values=values, scale=0.5, mask_rle=runs_, shape=np.array([3, 3, 3]), affine=np.eye(4))
                rows.append((f"{s}/{i}.npz", f"s{s}", f.tell(), len(raw.getvalue()), "other"))
                f.write(raw.getvalue())
                want[f"{s}/{i}.npz"] = values.tolist()
    index = spark.createDataFrame(rows, "path string, shard string, offset long, size long, more string")
    index.write.parquet(str(tmp_path / "index"))
    idx = shards.read_index(spark, str(tmp_path / "index"))
    listed = spark.createDataFrame([(0, "1/2.npz"), (1, "0/0.npz"), (2, "1/2.npz")], "ordinal long, path string")
    found = shards.strict_lookup(listed, idx)
    assert [r.path for r in found.collect()] == ["1/2.npz", "0/0.npz", "1/2.npz"]
    got = shards.read_members(found, f"file://{tmp_path}").collect()
    assert sorted((r.path, r["values"]) for r in got) == sorted((p, want[p]) for p in ("1/2.npz", "0/0.npz", "1/2.npz"))
    with pytest.raises(Exception, match="not in the index"):
        shards.strict_lookup(spark.createDataFrame([(0, "no")], "ordinal long, path string"), idx).collect()
    with pytest.raises(Exception, match="twice"):
        shards.strict_lookup(listed, idx.unionByName(idx)).collect()
    some_missing = listed.unionByName(spark.sql("SELECT 3L AS ordinal, 'no' AS path"))
    for read in (lambda df: df.count(), lambda df: df.select("path", "offset").collect(), lambda df: df.select("ordinal").collect()):
        with pytest.raises(Exception, match="not in the index"):
            read(shards.strict_lookup(some_missing, idx))
    source = shards.load_shards(idx, f"file://{tmp_path}")
    assert {r.path: r["values"] for r in source.collect()} == want


def test_pooling(spark):
    rows = [("a", 0, [9.0, 9.0]), ("a", 1, [1.0, 2.0]), ("a", 2, [3.0, 4.0])]
    df = spark.createDataFrame(rows, "path string, patch_id int, token array<double>")
    assert embed.pool_tokens(df, "path", class_tokens=1).first().global_embedding == [2.0, 3.0]
    assert embed.pool_tokens(df.where("patch_id > 0"), "path").first().global_embedding == [2.0, 3.0]


class Handle:
    """A value state in memory."""

    def __init__(self):
        self.value = None

    def getValueState(self, name, schema):
        return self

    def exists(self):
        return self.value is not None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value


@pytest.mark.parametrize("most", [3, 8192])
def test_last_values_in_bounded_frames(monkeypatch, most):
    """The figures of updates in two micro-batches, in no order, are those of the plain rule, in frames of bounded rows."""
    monkeypatch.setattr(live, "ROWS_OUT", most, raising=False)
    rng = np.random.default_rng(4)
    values = rng.normal(size=70)
    processor, out = live.LastValues(20), []
    processor.init(Handle())
    for steps in (np.arange(0, 7), np.arange(7, 70)):
        mixed = rng.permutation(steps)
        frames = [pd.DataFrame({"run": "r", "metric": "m", "step": x, "value": values[x]}) for x in np.array_split(mixed, 3)]
        frames.append(pd.DataFrame({"run": "r", "metric": "m", "step": [1000], "value": [None]}))
        out += list(processor.handleInputRows(("r", "m"), iter(frames), None))
    assert max(map(len, out)) <= most and list(out[0].columns) == ["run", "metric", "step", "median", "avg", "max", "latest", "global_avg"]
    got = pd.concat(out)
    assert got["step"].tolist() == list(range(70))
    for i, r in enumerate(got.itertuples()):
        last = sorted(values[max(0, i - 19) : i + 1])
        assert (r.run, r.metric, r.median, r.max, r.latest) == ("r", "m", last[(len(last) - 1) // 2], last[-1], values[i])
        assert (r.avg, r.global_avg) == pytest.approx((sum(last) / len(last), values[: i + 1].mean()))
