"""Batch lengths, writers of a patch, ordered lists, manifests, the shard source, embedding records, assembly, documents
and streams that stop and go on."""

import hashlib
import io
import json
import subprocess
import sys

import numpy as np
import pytest
from pyspark.sql import functions as F

from volframe.functions.arrays import canonical, field
from volframe.operators import curate, embed, ordering, patches, submissions, volumes
from volframe.sources import manifests, runs, shards
from volframe.streaming import live

rng = np.random.default_rng(3)


def test_batch_lengths(spark):
    """Each batch has its own length; a smaller image fills up as far as it can; a batch without eligible patches is empty."""
    rows = [("one", "a", i, 1.0 if i < 3 else 0.0) for i in range(8)] + [("one", "b", i, 0.3 if i < 5 else 0.2) for i in range(6)] + [("two", "a", i, 0.25 if i == 7 else 0.0) for i in range(8)]
    rows += [("none", "c", i, 0.1) for i in range(4)] + [(None, "d", i, 1.0) for i in range(2)]
    df = spark.createDataFrame(rows, "batch string, path string, patch_id int, mask_frac double")
    got = patches.sample_batches(df, "batch", "path", samples=2, visible=1).collect()
    count = {}
    for r in got:
        count[r.batch, r.path, r["sample"]] = count.get((r.batch, r.path, r["sample"]), 0) + 1
    assert count == {("one", "a", s): 5 for s in (0, 1)} | {("one", "b", s): 5 for s in (0, 1)} | {("two", "a", s): 1 for s in (0, 1)} | {(None, "d", s): 2 for s in (0, 1)}
    assert {r.seq_length for r in got if r.batch == "one"} == {5} and all((r.role == "visible") == (r["rank"] == 1) for r in got)
    assert {r.patch_id for r in got if r.path == "a" and r.batch == "one" and r["rank"] <= 3} == {0, 1, 2}
    fixed = patches.sample_patches(df.where("batch = 'one'"), "path", 2, 5, 1).collect()
    assert sorted((r.path, r["sample"], r["rank"], r.patch_id) for r in got if r.batch == "one") == sorted((r.path, r["sample"], r["rank"], r.patch_id) for r in fixed)


def test_batch_lengths_meet_once(spark):
    df = spark.range(10).selectExpr("id % 2 AS batch", "id % 5 AS path", "CAST(id AS INT) AS patch_id", "0.5D AS mask_frac")
    plan = patches.sample_batches(df, "batch", "path", 2, 1)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("REPARTITION_BY_COL") <= 2 and "SinglePartition" not in plan  # the exchange, and its second use


def test_one_writer(spark):
    rows = [("a", 1, 0, [1.0, 2.0]), ("a", 1, 2, [3.0, 6.0]), ("a", 1, 1, [9.0, 9.0]), ("a", 2, 0, [5.0, 5.0]), ("a", 2, 0, [4.0, 7.0]), ("a", 3, 0, None), ("b", 1, 5, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "path string, patch_id int, turn int, pixels array<double>")
    got = lambda **k: {(r.path, r.patch_id): r.pixels for r in patches.one_writer(df, "path", "pixels", **k).collect()}
    assert got(by=("turn",)) == {("a", 1): [3.0, 6.0], ("a", 2): [5.0, 5.0], ("b", 1): [0.0, 1.0]}
    assert got(by=("turn",), reduce="first") == {("a", 1): [1.0, 2.0], ("a", 2): [4.0, 7.0], ("b", 1): [0.0, 1.0]}
    assert got(reduce="mean") == {("a", 1): [13 / 3, 17 / 3], ("a", 2): [4.5, 6.0], ("b", 1): [0.0, 1.0]}
    cells = patches.scatter(spark.createDataFrame([("a",), ("c",)], "path string"), patches.one_writer(df, "path", "pixels", by=("turn",)), "path", (2, 2, 1), "pixels", 2, written="there").collect()
    assert {(r.path, r.patch_id): (r.pixels, r.there) for r in cells} == {(p, i): ({("a", 1): [3.0, 6.0], ("a", 2): [5.0, 5.0]}.get((p, i), [0.0, 0.0]), (p, i) in {("a", 1), ("a", 2)}) for p in "ac" for i in range(4)}
    with pytest.raises(ValueError):
        patches.one_writer(df, "path", "pixels", reduce="any")


def test_single_precision_patches(spark):
    """Floats stay floats on the way through patches and back."""
    df = spark.createDataFrame([("v", rng.normal(size=64).tolist(), [True] * 64)], "path string, image array<float>, mask array<boolean>")
    p = patches.patchify(df, "path", "image", "mask", (4, 4, 4), 2)
    assert p.schema["pixels"].dataType.elementType.simpleString() == "float"
    assert patches.unpatchify(p, "path", "pixels", (2, 2, 2), 2).first().image == pytest.approx(df.first().image)


def test_order(spark, tmp_path):
    values = [f"p{rng.integers(0, 300):03d}" for _ in range(500)] + [None, "é", "Z"]
    df = spark.createDataFrame([(v, i) for i, v in enumerate(values)], "path string, i int").repartition(7)
    got = ordering.with_ordinal(df, "path").orderBy("ordinal").collect()
    assert [r.ordinal for r in got] == list(range(503)) and got[0].path is None
    assert [r.path for r in got[1:]] == sorted((v for v in values if v is not None), key=str.encode)
    assert ordering.with_ordinal(df.where("false"), "path").collect() == []
    ordering.write_text_list(df.where("path is not null"), "path", f"{tmp_path}/text")
    back = ordering.read_text_list(spark, f"{tmp_path}/text").orderBy("ordinal").collect()
    assert [(r.ordinal, r.path) for r in back] == list(enumerate(r.path for r in got[1:]))


def test_lists_of_several_words_a_line(spark, tmp_path):
    """Any white space separates, in files that are read in several stretches too."""
    lines = [" ".join(f"w{i}-{j}" for j in range(rng.integers(0, 4))) for i in range(3000)]
    (tmp_path / "list.txt").write_text("\n".join(lines) + "\n\n \t\n")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        got = ordering.read_text_list(spark, str(tmp_path / "list.txt")).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert [(r.ordinal, r.path) for r in got] == list(enumerate(" ".join(lines).split()))


def test_manifest(spark, tmp_path):
    rows = [("source/a.nii.gz", "c", "s", "T1w", None, [], [150.0] * 3)]
    images = spark.createDataFrame(rows, manifests.IMAGES).withColumn("extra", F.lit(1))
    for part in ("one", "two"):
        manifests.write_manifest(images, f"{tmp_path}/{part}")
    assert manifests.read_manifest(spark, str(tmp_path)).count() == 2 and "extra" not in manifests.read_manifest(spark, str(tmp_path)).columns
    images.drop("suffix").withColumn("mask_extent", F.lit("x")).write.parquet(f"{tmp_path}/three")
    faults = manifests.schema_faults(spark, str(tmp_path)).collect()
    assert {(r.column, r.expected, r.found) for r in faults} == {("mask_extent", "array<double>", "string"), ("suffix", "string", None)} and all("three" in r.file for r in faults)
    with pytest.raises(ValueError, match="suffix is missing"):
        manifests.read_manifest(spark, str(tmp_path))
    (tmp_path / "four").mkdir()
    (tmp_path / "four" / "x.parquet").write_bytes(b"no")
    assert manifests.schema_faults(spark, f"{tmp_path}/four").first().column is None


def stored(spark, tmp_path, n=40):
    rows = []
    for i in range(n):
        mask = rng.random((3, 4, 5)) > (0.5 if i else 2)
        v, r = volumes.packed(rng.integers(-9, 9, mask.shape).astype(float), mask)
        rows.append((f"m/{i:03d}", [int(x) for x in v], 0.5, r.tolist(), [3, 4, 5], np.eye(4).tolist()))
    df = spark.createDataFrame(rows, shards.VOLUME).coalesce(2)
    shards.write_members(df, f"file://{tmp_path}/shards", shard_bytes=20_000).write.parquet(f"{tmp_path}/index")
    return shards.read_index(spark, f"{tmp_path}/index"), {r[0]: r for r in rows}, f"file://{tmp_path}/shards"


def test_shard_source_by_stretches(spark, tmp_path):
    index, want, root = stored(spark, tmp_path)
    df = shards.load_shards(index, root, range_bytes=4000)
    assert {r.path: tuple(r) for r in df.collect()} == want
    assert df.rdd.getNumPartitions() > index.select("shard").distinct().count() > 2
    assert {r.path: list(r.shape) for r in shards.load_shards(index, root, ("shape", "path")).collect()} == {p: r[4] for p, r in want.items()}
    assert shards.load_shards(index.where("false"), root).collect() == []
    with pytest.raises(Exception, match="has no other"):
        spark.read.format("shards").schema("other string").option("path", root).option("plan", "file:///none").load().collect()
    with pytest.raises(Exception, match="null path"):
        shards.plan_stretches(index.withColumn("size", F.lit(None).cast("long")), f"{tmp_path}/bad")


def test_shard_source_reads_only_what_is_asked(spark, tmp_path):
    """A column that is not asked for is not read, and a filter on path keeps other members from being opened at all."""
    index, want, root = stored(spark, tmp_path)
    broken = index.withColumn("offset", F.when(F.col("path") >= "m/010", F.lit(10**9)).otherwise(F.col("offset")))
    before = spark.conf.get("spark.sql.python.filterPushdown.enabled", "false")
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    try:
        read = lambda: shards.load_shards(broken, root, ("path", "scale"))
        assert sorted(r.path for r in read().where("path IN ('m/003', 'm/005')").collect()) == ["m/003", "m/005"]
        assert [r.path for r in read().where("path = 'm/007' AND scale = 0.5").collect()] == ["m/007"]
        assert read().where("path LIKE 'm/00%'").count() == 10
        with pytest.raises(Exception):
            read().collect()
    finally:
        spark.conf.set("spark.sql.python.filterPushdown.enabled", before)
    raw = io.BytesIO()
    np.savez(raw, values=np.zeros(100_000, np.int32), scale=1.5, shape=np.array([1, 2, 3]))

    class Counted(io.BytesIO):
        taken = 0

        def read(self, n=-1):
            got = super().read(n)
            Counted.taken += len(got)
            return got

    assert shards.decode(Counted(b"x" * 7 + raw.getvalue()), 7, len(raw.getvalue()), ("path", "scale"))["scale"] == 1.5 and Counted.taken < 50_000


def test_box_of_runs():
    for shape in ((3, 4, 5), (1, 1, 7), (4, 1, 3)):
        for p in (0.02, 0.3, 0.97):
            mask = rng.random(shape) < p
            values, r = volumes.packed(rng.normal(size=shape), mask)
            if not mask.any():
                with pytest.raises(ValueError):
                    volumes.run_box(r, shape)
                continue
            at = np.argwhere(mask)
            box = volumes.run_box(r, shape)
            assert box[:, 0].tolist() == at.min(0).tolist() and box[:, 1].tolist() == (at.max(0) + 1).tolist()
            affine = rng.normal(size=(4, 4))
            v, inner, size, moved = volumes.boxed(values, r, shape, affine)
            image, inside = volumes.unpacked(v, inner, size)
            assert (inside == mask[tuple(slice(a, z) for a, z in box)]).all() and image[inside].tolist() == values.tolist()
            assert np.allclose(moved @ [0, 0, 0, 1], affine @ [*box[:, 0], 1]) and np.allclose(moved[:, :3], affine[:, :3])


def test_transform_of_lists(spark):
    """A user's function sees lists of samples of their own shapes, no longer than asked, and must answer for each."""
    rows = [(f"v{i}", [1] * i, 1.0, [0, i, 8 - i] if i else [8], [2, 2, 2] if i % 2 else [1, 2, 4], np.eye(4).tolist()) for i in range(7)]
    df = spark.createDataFrame(rows, shards.VOLUME)

    def transform(samples):
        assert len(samples) <= 3
        return [(np.full(s["shape"][2], len(s["values"])), np.ones(1), s["affine"] * 2) for s in samples]

    got = {r.path: r for r in volumes.map_volumes(df, "path", transform, batch_volumes=3).collect()}
    assert {p: (r.image, r.mask, r.affine[0][0]) for p, r in got.items()} == {f"v{i}": ([float(i)] * (2 if i % 2 else 4), [1.0], 2.0) for i in range(7)}
    with pytest.raises(Exception, match="gave 0 volumes"):
        volumes.map_volumes(df, "path", lambda samples: []).collect()


@embed.register_encoder("prepared twice")
def _encoder(checkpoint):
    class Encoder:
        def prepare(self, image, mask, affine):
            return image * checkpoint["times"], mask, affine

        def encode(self, pixels, coordinates):
            return np.concatenate([np.full((1, 3), 99.0), np.column_stack([pixels.sum(1), coordinates.sum(1), np.arange(len(pixels))])])

    return Encoder()


def test_embedding_of_volumes(spark):
    """One job gives what preparing, patches, encoder and records give one after another."""
    rows = []
    for i in range(5):
        mask = rng.random((4, 4, 4)) > 0.6
        v, r = volumes.packed((rng.normal(size=mask.shape) * 100).round(), mask)
        rows.append((f"v{i}", [int(x) for x in v], 0.01, r.tolist(), [4, 4, 4], np.eye(4).tolist()))
    df = spark.createDataFrame(rows, shards.VOLUME)
    spec = volumes.VolumeSpec(grid=(6, 4, 4))
    got = {r.path: r for r in embed.embed_volumes(df, "path", spec, 2, "prepared twice", {"times": 3.0}, class_tokens=1).collect()}
    for row in rows:
        image, mask, affine = volumes.prepared(*row[1:], spec)
        cut, inside = patches.cut_patches(image * 3, (3, 2, 2), 2), patches.cut_patches(mask, (3, 2, 2), 2).any(1)
        r = got[row[0]]
        assert r.dense_mask == inside.tolist() and np.allclose(r.dense_affine, affine)
        cells = np.array(r.dense_embedding)
        assert np.allclose(cells[inside][:, 0], cut[inside].sum(1), atol=1e-4) and not cells[~inside].any()
        assert np.allclose(r.global_embedding, cells[inside].mean(0), atol=1e-4)
    thin = embed.embed_volumes(df, "path", spec, 2, "prepared twice", {"times": 3.0}, class_tokens=1, dense=False).first()
    assert thin.dense_embedding is None and thin.dense_mask is None and thin.dense_affine is None and len(thin.global_embedding) == 3


def test_embedding_records(spark, tmp_path):
    tokens = spark.createDataFrame([("a", 2, [1.0, 2.0]), ("a", 0, [3.0, 4.0])], "path string, patch_id int, token array<double>")
    images = spark.createDataFrame([("a", np.eye(4).tolist()), ("b", np.eye(4).tolist())], "path string, affine array<array<double>>")
    df = embed.embedding_records(images, tokens, "path", (3, 1, 1), 2)
    got = {r.path: r for r in df.collect()}
    assert got["a"].global_embedding == [2.0, 3.0] and got["a"].dense_embedding == [[3.0, 4.0], [0.0, 0.0], [1.0, 2.0]] and got["a"].dense_mask == [True, False, True]
    assert got["b"].global_embedding is None and got["b"].dense_embedding == [[0.0, 0.0]] * 3 and got["b"].dense_mask == [False] * 3
    with pytest.raises(Exception, match="several tokens"):
        embed.embedding_records(images, tokens.unionByName(tokens), "path", (3, 1, 1), 2).collect()
    many = spark.range(40).select(F.concat(F.lit("k"), "id").alias("path")).crossJoin(df.where("path = 'a'").drop("path"))
    for _ in range(2):  # written again: the same records
        embed.write_embeddings(many, f"{tmp_path}/e", "path", buckets=8)
        assert spark.read.parquet(f"{tmp_path}/e").count() == 40
    one = spark.read.parquet(f"{tmp_path}/e").where("bucket = (SELECT 3)").drop("bucket")
    kept = one.count()
    embed.write_embeddings(spark.createDataFrame(one.collect(), one.schema).withColumn("global_embedding", F.array(F.lit(7.0).cast("float"))), f"{tmp_path}/e", "path", buckets=8)
    after = spark.read.parquet(f"{tmp_path}/e")
    assert after.count() == 40 and after.where("global_embedding[0] = 7").count() == kept


def parts(spark, *runs_):
    of = lambda kind, values: spark.createDataFrame([(r, v) for r, v in values], f"run string, {kind}")
    config = of("config string", [(r, json.dumps({"name": f"n{r}", "notes": None, "z": {"b": 1, "a": [1, {"y": 0.5, "x": "é\"\n"}]}})) for r in runs_ if "c" in r])
    summary = of("summary string", [(r, json.dumps({"gpu": "g", "cpus": 3, "git": {"sha": "s", "dirty": True}})) for r in runs_ if "s" in r])
    scores = of("scores map<string,double>", [(r, {"open": 0.5, "all": 0.5, "t": None}) for r in runs_ if "m" in r])
    sources = of("sources map<string,string>", [(r, {"a.py": "x"}) for r in runs_ if "f" in r])
    return config, summary, scores, sources


def test_assembly(spark):
    known = ("csmf", "csm", "smf", "f", "csmf2")
    got = {r.run: r.missing for r in submissions.assemble(*parts(spark, *known)).collect()}
    assert got == {"csmf": [], "csm": ["sources"], "smf": ["config"], "f": ["config", "summary", "scores"], "csmf2": []}
    assert submissions.complete(submissions.assemble(*parts(spark, "csmf"))).count() == 1
    with pytest.raises(Exception, match="run smf lacks config"):
        submissions.complete(submissions.assemble(*parts(spark, "csmf", "smf"))).collect()
    config, *rest = parts(spark, "csmf", "csm")
    with pytest.raises(Exception, match="twice for run csm: config"):
        submissions.assemble(config.unionByName(config.where("run = 'csm'")), *rest).collect()
    with pytest.raises(Exception, match="a null run in: config"):
        submissions.assemble(config.withColumn("run", F.lit(None).cast("string")), *rest).collect()
    assert submissions.assemble(*parts(spark)).collect() == []


def test_documents(spark):
    df = submissions.assemble(*parts(spark, "csmf", "smf", "csf", "csmf" + "x" * 20)).withColumn("at", F.to_timestamp(F.lit("2024-05-06 07:08:09")))
    got = {r.run: r for r in submissions.documents(df, "open", {"b": "2", "a": "1"}, "at").collect()}
    whole = json.loads(got["csmf"].payload)
    assert whole["run"]["config"]["z"] == {"b": 1, "a": [1, {"y": 0.5, "x": "é\"\n"}]} and whole["run"]["metrics"] == {"open": 0.5, "t": None} and whole["notes"] == "" and whole["title"] == "ncsmf"
    assert whole["repo"] == {"remote": None, "branch": None, "commit": "s", "dirty": True, "review_files": {"source": "source.tar.gz", "files": {"a.py": "x", "config.yaml": parts(spark, "csmf")[0].first().config}}}
    assert whole["run"]["ended_at"] == "2024-05-06T07:08:09Z" and whole["contributor"] == {"login": None} and whole["artifacts"] == []
    order = lambda d: isinstance(d, dict) and list(d) == sorted(d) and all(order(v) for v in d.values() if isinstance(v, dict))
    assert order(whole) and list(whole["run"]["environment"]) == ["a", "b"]
    undated = got["csmf"].payload.replace('"ended_at":"2024-05-06T07:08:09Z"', '"ended_at":null')
    assert got["csmf"].submission_id == hashlib.sha256(undated.encode()).hexdigest()[:10]
    assert got["csmf"].valid and got["smf"].validation_errors == ["config is missing"] and got["csf"].validation_errors == ["scores is missing", "no open score, the evaluation is incomplete"]
    assert got["csmf" + "x" * 20].validation_errors == [f"name 'ncsmf{'x' * 20}' is longer than 20 characters"]
    now = submissions.documents(df, "open", {"b": "2", "a": "1"})
    assert {r.run: r.submission_id for r in now.collect()} == {k: r.submission_id for k, r in got.items()} and now.first().ended_at.endswith("Z")


def test_fields_and_canonical_form(spark):
    df = spark.createDataFrame([('{"b": {"d": null, "c": [1, "x"]}, "a": 2}',), ('{"a": 2, "b": {"c": [1, "x"], "d": null}}',), (None,)], "t string")
    d = F.parse_json("t")
    assert [r[0] for r in df.select(canonical(d)).collect()] == ['{"a":2,"b":{"c":[1,"x"],"d":null}}'] * 2 + [None]
    r = df.select(field(d, "$.b.c[1]"), field(d, "$.b.d", "none"), field(d, "$.b.x.y", 7, "int"), field(d, "$.a", 0, "int"), field(d, "$.b.c[1]", -1, "int")).collect()
    assert tuple(r[0]) == ("x", "none", 7, 2, -1) and tuple(r[2]) == (None, "none", 7, 0, -1)


def test_step_log_lines(spark, tmp_path):
    (tmp_path / "l.json").write_text('{"run": "r", "step": 1, "loss": NaN}\n{"run": "r", "step": 2, "lo\n{"run": "r", "step": "x"}\n{"loss": 1}\n\n{"step": 3, "run": "r", "watts": 5.5, "new": 1}\n')
    log = runs.read_step_log(spark, str(tmp_path))
    assert sorted((r.step, r.watts) for r in runs.sound_steps(log).collect()) == [(1, None), (3, 5.5)]
    lines = [r.line for r in runs.corrupt_lines(log).collect()]
    assert sorted(lines) == sorted(['{"run": "r", "step": 2, "lo', '{"run": "r", "step": "x"}', '{"loss":1.0}'])


def instalments(spark, at, n=4):
    for i in range(n):
        spark.createDataFrame([("r" if j % 3 else "s", i * 10 + j, f"2024-01-01 00:{i * 10 + j:02d}:00") for j in range(10)], "run string, step long, ts string").selectExpr("run", "step", "to_timestamp(ts) AS ts").coalesce(1).write.mode("append").parquet(at)


def throughput(spark, at):
    return live.live_throughput(spark.readStream.schema("run string, step long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(at), "30 minutes", "1 day", 1)


def last(spark, out):
    return sorted((r.run, r.s) for r in spark.read.parquet(out).groupBy("run", "start").agg(F.max_by("steps", "batch").alias("s")).collect())


def test_stop_and_go_on(spark, tmp_path):
    """A stream stopped after each micro-batch, and one that is lost after it wrote but before it was done, leave together
    what one run leaves; state goes on, and no micro-batch is there twice."""
    at = f"{tmp_path}/in"
    instalments(spark, at)
    batches = live.finished(throughput(spark, at), "update", f"{tmp_path}/whole", f"{tmp_path}/whole-state")
    assert batches >= 4  # one for each file, and one in which only the watermark moves
    took = []
    while n := live.advance(throughput(spark, at), "update", f"{tmp_path}/parts", f"{tmp_path}/parts-state", most_batches=1):
        took.append(n)
    assert took == [1] * batches and last(spark, f"{tmp_path}/parts") == last(spark, f"{tmp_path}/whole")
    assert live.advance(throughput(spark, at), "update", f"{tmp_path}/parts", f"{tmp_path}/parts-state") == 0

    def lost(batch, number):
        batch.write.mode("overwrite").parquet(f"{tmp_path}/lost/batch={number}")
        if number == 1:
            raise RuntimeError("the driver is gone")

    query = throughput(spark, at).writeStream.outputMode("update").foreachBatch(lost).option("checkpointLocation", f"{tmp_path}/lost-state").trigger(availableNow=True).start()
    with pytest.raises(Exception, match="gone"):
        query.awaitTermination()
    assert live.finished(throughput(spark, at), "update", f"{tmp_path}/lost", f"{tmp_path}/lost-state") == batches - 1
    assert last(spark, f"{tmp_path}/lost") == last(spark, f"{tmp_path}/whole")


def test_a_failing_stream_still_fails(spark, tmp_path):
    at = f"{tmp_path}/in"
    instalments(spark, at, 1)
    bad = spark.readStream.schema("run string, step long, ts timestamp").parquet(at).selectExpr("raise_error('broken') AS x")
    with pytest.raises(Exception, match="broken"):
        live.finished(bad, "append", f"{tmp_path}/out", f"{tmp_path}/state")


def test_filelist_without_one_task(spark, tmp_path):
    df = spark.createDataFrame([(f"source/{i:04d}.nii.gz",) for i in rng.permutation(400)], "path string").repartition(5)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # or the few rows would be one part
    try:
        curate.write_filelist(df, f"{tmp_path}/l")
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    want = [f"derivatives/{i:04d}.npz" for i in range(400)]
    assert [(r.ordinal, r.value) for r in spark.read.parquet(f"{tmp_path}/l/list").orderBy("ordinal").collect()] == list(enumerate(want))
    assert [r.path for r in shards.read_filelist(spark, f"{tmp_path}/l/text").orderBy("ordinal").collect()] == want
    assert len(list((tmp_path / "l" / "text").glob("part-*"))) > 1


def test_the_rest_stands_alone(tmp_path):
    """Without the text operators' folders, and without the pipeline, the library imports and registers its own queries."""
    import shutil
    from pathlib import Path

    root = Path(__file__).resolve().parents[1]
    for name in ("volframe", "__spark_entry__.py", "corpus_pipeline.py"):
        source = root / name
        if source.is_dir():
            shutil.copytree(source, tmp_path / name, ignore=shutil.ignore_patterns("llm", "__pycache__"))
        elif source.exists():
            shutil.copy(source, tmp_path / name)
    code = "import __spark_entry__ as e; q = e.queries(); o = e.oracle_sql(); assert len(q) > 70 and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q) and 'pipeline' not in q"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={"PYTHONPATH": str(tmp_path), "PATH": "/usr/bin:/bin"}, check=True, timeout=120)


def test_listed_members_are_read_by_many_tasks(spark, tmp_path, monkeypatch):
    """A lookup's few bytes don't put all members in one task."""
    index, _, root = stored(spark, tmp_path)
    monkeypatch.setattr(shards, "STRETCH_BYTES", 5000, raising=False)
    listed = ordering.with_ordinal(index.select("path"), "path")
    got = shards.read_members(shards.strict_lookup(listed, index), root).withColumn("task", F.spark_partition_id()).select("path", "task").collect()
    assert len({r.path for r in got}) == 40 and len({r.task for r in got}) > 1
