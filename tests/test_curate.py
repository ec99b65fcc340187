import pytest
from pyspark.sql import functions as F

from volframe.operators import curate

IMAGES = "path string, collection string, subject string, suffix string, dwi_type string, warnings array<string>, mask_extent array<double>"
BIG = [200.0, 150.0, 120.0]


def labels(spark, rows):
    df = spark.createDataFrame([(f"p{i}", "c", "s", *r, [], BIG) for i, r in enumerate(rows)], IMAGES)
    return [r.sequence for r in curate.label_sequences(df).orderBy("path").collect()]


def test_label_overrides(spark):
    assert labels(spark, [("T1w", "b0"), ("dwi_bval1000", "mean"), ("dwi_bval1000", "single"), ("bold", None), (None, None), ("FLAIR", None)]) == ["dwi_b0", "dwi_b1000", None, None, None, "FLAIR"]


def test_shell_ends(spark):
    rows = [(f"dwi_bval{b}", "mean") for b in ("899", "900", "1100", "1101", "", "1000x")]
    assert [x == "dwi_b1000" for x in labels(spark, rows)] == [False, True, True, False, False, False]


def test_warnings(spark):
    df = spark.createDataFrame([([],), (["x"],)], "w array<string>")
    assert [r[0] for r in df.select(curate.no_warnings(F.col("w"))).collect()] == [True, False]
    with pytest.raises(Exception, match="null"):
        spark.createDataFrame([(None,)], "w array<string>").select(curate.no_warnings(F.col("w"))).collect()


def test_extent(spark):
    rows = [([100.0, 100.0, 100.0],), ([99.999, 150.0, 150.0],), ([float("nan"), 150.0, 150.0],), ([None, 150.0, 150.0],), (None,)]
    df = spark.createDataFrame(rows, "e array<double>")
    assert [r[0] for r in df.select(curate.large_enough(F.col("e"))).collect()] == [True, False, False, False, False]


def test_paths(spark):
    given = ["source/a/b.nii.gz", "a/b.nii.gz", "source/a", "source/x/source/a.nii.gz", "a.nii.gz.txt"]
    df = spark.createDataFrame([(x,) for x in given], "path string")
    assert [r[0] for r in df.select(curate.derivative_path(F.col("path"))).collect()] == [f"derivatives/{x}.npz" for x in ("a/b", "a/b", "a", "x/source/a", "a.nii.gz.txt")]


def test_keep_first(spark):
    rows = [("b", "c", None, "T1w"), ("a", "c", None, "T1w"), (None, "c", None, "T1w"), ("z", "d", "s", "T1w"), ("é", "c", "s", "T1w"), ("f", "c", "s", "T1w")]
    df = spark.createDataFrame(rows, "path string, collection string, subject string, sequence string")
    assert sorted(r.path for r in curate.keep_first(df, curate.KEYS, "path").collect()) == ["a", "f", "z"]


def test_filelist(spark, tmp_path):
    from volframe.sources.shards import read_filelist

    df = spark.createDataFrame([("source/b.nii.gz",), ("source/a.nii.gz",)], "path string")
    curate.write_filelist(df, str(tmp_path / "list"))
    found = read_filelist(spark, str(tmp_path / "list" / "text")).orderBy("ordinal").collect()
    assert [(r.ordinal, r.path) for r in found] == [(0, "derivatives/a.npz"), (1, "derivatives/b.npz")]
    (tmp_path / "odd.txt").write_text("x y\n\nz\n\n")
    assert [r.path for r in read_filelist(spark, str(tmp_path / "odd.txt")).orderBy("ordinal").collect()] == ["x", "y", "z"]


def test_empty_funnel(spark):
    assert [r.images for r in curate.funnel(spark.createDataFrame([], IMAGES)).orderBy("position").collect()] == [0] * 5
