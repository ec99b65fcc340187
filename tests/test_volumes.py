import numpy as np
import pytest
from pyspark.sql import functions as F

from volframe.operators import geometry, patches, values, volumes

rng = np.random.default_rng(0)


def turned(*axes):
    a = np.zeros((4, 4))
    for j, (world, sign, step) in enumerate(axes):
        a[world, j] = sign * step
    a[:3, 3] = (5, -2, 7)
    a[3, 3] = 1
    return a


def world(affine, voxel):
    return (affine @ [*voxel, 1])[:3]


def test_runs_round_trip():
    for mask in (np.zeros((4, 4, 4), bool), np.ones((4, 4, 4), bool), rng.random((3, 4, 5)) > 0.5):
        image = rng.normal(size=mask.shape) * mask
        v, runs = volumes.packed(image, mask)
        back, inside = volumes.unpacked(v, runs, mask.shape)
        assert (back == image).all() and (inside == mask).all()
    with pytest.raises(ValueError):
        volumes.unpacked(np.zeros(0), np.array([63]), (4, 4, 4))


def test_zscore_matches_relational(spark):
    groups = {"one": [3.0], "same": [2.0] * 5, "many": rng.normal(size=101).tolist()}
    df = spark.createDataFrame([(g, i, x) for g, v in groups.items() for i, x in enumerate(v)] + [("many", 200, None)], "g string, i int, v double")
    got = {(r.g, r.i): r.z for r in values.clipped_zscore(df, "g", "v").collect()}
    assert got.pop(("many", 200)) is None
    for g, v in groups.items():
        for i, z in enumerate(volumes.standardised(np.array(v), values.QUANTILES)):
            assert got[g, i] == pytest.approx(z, abs=1e-9)
    with pytest.raises(Exception, match="NaN"):
        values.clipped_zscore(spark.createDataFrame([("a", float("nan"))], "g string, v double"), "g", "v").collect()


def test_mask_box(spark):
    rows = []
    for i in range(40):
        mask = rng.random((3, 4, 5)) > 0.9
        if not mask.any():
            mask[1, 2, 3] = True
        rows.append((i, volumes.packed(mask.astype(float), mask)[1].tolist(), [3, 4, 5], [x for a in range(3) for x in (np.flatnonzero(mask.any(tuple(b for b in range(3) if b != a)))[[0, -1]] + [0, 1]).tolist()]))
    df = spark.createDataFrame(rows, "k int, r array<long>, s array<int>, want array<int>")
    got = {r.k: [r.x0, r.x1, r.y0, r.y1, r.z0, r.z1] for r in values.mask_box(df, "k", "r", "s").collect()}
    assert got == {r[0]: r[3] for r in rows}
    with pytest.raises(Exception, match="empty"):
        values.mask_box(spark.createDataFrame([(1, [60], [3, 4, 5])], "k int, r array<long>, s array<int>"), "k", "r", "s").collect()


def test_bad_runs(spark):
    df = spark.createDataFrame([([1, 2], 4)], "r array<long>, n long")
    with pytest.raises(Exception, match="add up"):
        df.select(values.checked_mask(F.col("r"), F.col("n"))).collect()


def test_shapes_and_fit(spark):
    df = spark.createDataFrame([([5, 7, 1], [0.5, 0.5, 0.2])], "shape array<int>, spacing array<double>")
    assert df.select(geometry.target_shape(F.col("shape"), F.col("spacing"), 1.0)).first()[0] == [2, 4, 1]
    eye = np.eye(4).tolist()
    plan = geometry.fit_plan(spark.createDataFrame([([5, 5, 5], eye)], "shape array<int>, affine array<array<double>>"), (8, 2, 5)).first()
    assert (plan.before, plan.after) == ([1, -2, 0], [2, -1, 0])
    assert [r[3] for r in plan.fitted_affine[:3]] == [-1.0, 2.0, 0.0]


@pytest.mark.parametrize("affine", [np.eye(4), turned((0, -1, 1), (1, 1, 2), (2, 1, 1)), turned((1, 1, 1), (2, -1, 1), (0, 1, 3)), "oblique"])
def test_reorientation_moves_nothing(spark, affine):
    if isinstance(affine, str):
        c, s = np.cos(np.pi / 6), np.sin(np.pi / 6)
        affine = np.array([[c, -s, 0, 1], [s, c, 0, 2], [0, 0, -1, 3], [0, 0, 0, 1]], float)
    image = np.arange(24.0).reshape(2, 3, 4)
    out, mask, turned_affine = volumes.reoriented(image, image > 3, affine)
    for value in image.ravel():
        assert np.allclose(world(affine, np.argwhere(image == value)[0]), world(turned_affine, np.argwhere(out == value)[0]))
    assert [c for c, _ in geometry.axis_codes(turned_affine)] == [0, 1, 2] and all(d > 0 for _, d in geometry.axis_codes(turned_affine))
    header = spark.createDataFrame([([2, 3, 4], affine.tolist())], "shape array<int>, affine array<array<double>>")
    r = geometry.reorient_affine(geometry.orientation(header)).first()
    assert np.allclose(r.reoriented_affine, turned_affine) and tuple(r.reoriented_shape) == out.shape


def test_resampling():
    image = rng.normal(size=(4, 5, 6))
    same, mask, affine = volumes.resampled(image, np.ones_like(image, bool), np.eye(4), 1.0)
    assert np.allclose(same, image) and np.allclose(affine, np.eye(4))
    # the weights table, axis by axis
    a = np.diag([2.0, 1, 1, 1])
    got, _, moved = volumes.resampled(image, np.ones_like(image, bool), a, 1.0)
    want = np.zeros((8, 5, 6))
    for o in range(8):
        c = max((o + 0.5) * 0.5 - 0.5, 0)
        low = int(c)
        want[o] = (1 - (c - low)) * image[low] + (c - low) * image[min(low + 1, 3)]
    assert np.allclose(got, want) and np.allclose(world(moved, (0, 0, 0)), (-0.5, 0, 0))
    assert volumes.smoothed(np.ones((9, 1, 1)), (0.5, 0, 0))[4, 0, 0] == pytest.approx(1)


def test_fit_and_crop():
    image = rng.normal(size=(5, 5, 5))
    big, _, affine = volumes.fitted(image, image > 0, np.eye(4), (8, 2, 5))
    assert big.shape == (8, 2, 5) and (big[1:6] == image[:, 2:4]).all() and not big[0].any() and not big[6:].any()
    assert np.allclose(affine[:3, 3], (-1, 2, 0))
    mask = np.zeros((5, 5, 5), bool)
    mask[2, 3, 4] = True
    _, runs = volumes.packed(image, mask)
    _, _, shape, moved = volumes.boxed(image[mask], runs, mask.shape, np.eye(4))
    assert shape == (1, 1, 1) and np.allclose(moved[:3, 3], (2, 3, 4))
    with pytest.raises(ValueError):
        volumes.boxed(np.zeros(0), np.array([125]), mask.shape, np.eye(4))


def test_prepared_job(spark):
    mask = rng.random((4, 4, 4)) > 0.4
    v, runs = volumes.packed((rng.normal(size=mask.shape) * 100).round() * mask, mask)
    row = ("a", [int(x) for x in v], 0.01, runs.tolist(), [4, 4, 4], np.eye(4).tolist())
    df = spark.createDataFrame([row], "path string, values array<int>, scale double, mask_rle array<long>, shape array<int>, affine array<array<double>>")
    for spec in (volumes.VolumeSpec((5, 4, 3)), volumes.VolumeSpec((5, 4, 3), use_scale=False, crop=True)):
        r = volumes.prepare_volumes(df, "path", spec).first()
        want = volumes.prepared(*row[1:], spec)
        assert np.allclose(r.image, want[0].ravel(), atol=1e-5) and np.allclose(r.mask, want[1].ravel()) and np.allclose(r.affine, want[2])


def test_patches(spark):
    rows = [(f"v{i}", rng.normal(size=64).tolist(), (rng.random(64) > 0.5).tolist()) for i in range(3)]
    df = spark.createDataFrame(rows, "path string, image array<double>, mask array<boolean>")
    p = patches.patchify(df, "path", "image", "mask", (4, 4, 4), 2)
    back = {r.path: r.image for r in patches.unpatchify(p, "path", "pixels", (2, 2, 2), 2).collect()}
    assert all(np.allclose(back[k], image) for k, image, _ in rows)
    with pytest.raises(ValueError):
        patches.patchify(df, "path", "image", "mask", (4, 4, 4), 3)
    with pytest.raises(Exception, match="twice"):
        patches.unpatchify(p.unionByName(p), "path", "pixels", (2, 2, 2), 2).collect()


def test_sampling(spark):
    rows = [("few", i, 1.0 if i < 2 else 0.1) for i in range(8)] + [("none", i, 0.0) for i in range(8)] + [("edge", i, 0.25 if i == 5 else 0.2) for i in range(8)]
    df = spark.createDataFrame(rows, "path string, patch_id int, mask_frac double")
    s = patches.sample_patches(df, "path", 2, 4, 1).collect()
    assert s == patches.sample_patches(df, "path", 2, 4, 1).collect()
    by = {(k, n): [r.patch_id for r in sorted(s, key=lambda r: r.rank) if (r.path, r.sample) == (k, n)] for k in ("few", "none", "edge") for n in (0, 1)}
    assert all(len(set(v)) == 4 for v in by.values()) and by["few", 0] != by["few", 1]
    assert set(by["few", 0][:2]) == {0, 1} and by["edge", 0][0] == 5
    assert sum(r.role == "visible" for r in s) == 6


def test_masked_mse(spark):
    df = spark.createDataFrame([("b", "x", [1.0, 2.0], [0.0, 0.0], [1.0, 1.0]), ("b", "y", [3.0, 9.0], [0.0, 0.0], [1.0, 0.0]), ("n", "z", [1.0], [0.0], [0.0])], "b string, k string, p array<double>, t array<double>, m array<double>")
    got = {r.b: r.loss for r in patches.masked_mse(df, ["b"], "p", "t", "m").collect()}
    assert got == {"b": pytest.approx(14 / 3), "n": None}


def test_two_mask_rules(spark):
    df = spark.createDataFrame([([1.0] + [0.0] * 7,)], "m array<double>")
    r = df.select(patches.touches_mask(F.col("m")).alias("t"), patches.mask_fraction(F.col("m")).alias("f")).first()
    assert r.t and r.f < patches.LEAST_FRACTION


def oblique(step, turn):
    c, s = np.cos(turn), np.sin(turn)
    a = np.eye(4)
    a[:3, :3] = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1]]) @ np.diag(step)
    a[:3, 3] = (1, -2, 3)
    return a


@pytest.mark.parametrize("crop", [False, True])
@pytest.mark.parametrize("spacing", [1.0, 2.5, 0.7])
def test_voxel_rows_are_the_dense_job(spark, crop, spacing):
    """Coarser grids are smoothed first, finer ones read linearly, turned and mirrored axes put right, and both forms agree."""
    from volframe.operators import voxels

    rows = []
    for i, affine in enumerate((np.eye(4), turned((0, -1, 1), (1, 1, 2), (2, 1, 1)), turned((1, 1, 1), (2, -1, 1.5), (0, 1, 0.6)), oblique((1.0, 2.0, 0.8), 0.3))):
        shape = [(5, 4, 6), (3, 7, 2), (6, 5, 4), (4, 4, 5)][i]
        mask = rng.random(shape) > 0.5
        v, runs = volumes.packed((rng.normal(size=shape) * 100).round(), mask)
        rows.append((f"v{i}", [int(x) for x in v], 0.01, runs.tolist(), list(shape), affine.tolist()))
    df = spark.createDataFrame(rows, "path string, values array<int>, scale double, mask_rle array<long>, shape array<int>, affine array<array<double>>")
    spec = volumes.VolumeSpec((5, 6, 4), spacing=spacing, use_scale=not crop, crop=crop)
    got = {}
    for r in voxels.prepare(df, "path", spec).collect():
        got.setdefault(r.path, []).append(r)
    for row in rows:
        image, mask, affine = volumes.prepared(*row[1:], spec)
        own = {(r.x, r.y, r.z): r.value for r in got.get(row[0], [])}  # a coarse grid may miss the mask
        assert set(own) == set(map(tuple, np.argwhere(mask > 0).tolist()))
        assert all(own[at] == pytest.approx(image[at], abs=1e-9) for at in own)
        assert all(np.allclose(r.affine, affine) for r in got.get(row[0], []))


def test_bad_voxel_rows(spark):
    from volframe.operators import voxels

    kind = "path string, values array<int>, scale double, mask_rle array<long>, shape array<int>, affine array<array<double>>"
    for runs, said in (([1, 2], "add up"), ([6, 2], "another number")):
        df = spark.createDataFrame([("v", [1], 1.0, runs, [2, 2, 2], np.eye(4).tolist())], kind)
        with pytest.raises(Exception, match=said):
            voxels.unpacked(df, "path").collect()
    assert voxels.unpacked(spark.createDataFrame([("v", [], 1.0, [8], [2, 2, 2], np.eye(4).tolist())], kind), "path").collect() == []


@pytest.mark.parametrize("crop", [False, True])
def test_voxel_rows_are_made_once(spark, crop):
    """Rows are ranked, and headers worked out, once, and what voxels give is summed by hash, whatever is carried with them."""
    from volframe.operators import voxels

    kind = "path string, values array<int>, scale double, mask_rle array<long>, shape array<int>, affine array<array<double>>"
    df = spark.createDataFrame([("v", [1, 2], 1.0, [6, 2], [2, 2, 2], np.diag([2.0, 1, 0.5, 1]).tolist())], kind)
    made = voxels.prepare(df, "path", volumes.VolumeSpec((4, 2, 2), crop=crop))._jdf.queryExecution()
    assert made.optimizedPlan().toString().count("MapInArrow") == 1
    assert made.optimizedPlan().toString().count("row_number()") == 1
    assert "SortAggregate" not in made.executedPlan().toString()
