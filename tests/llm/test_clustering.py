import hashlib
import random

import numpy as np
import pytest

from volframe.llm import clustering


def brute(rows, k=8, rounds=10, dim=64, scale=1024):
    """{(id, vector): (cluster, distance, cluster_inertia, inertia, sha)} by the plain method in Python's whole numbers."""
    kept = [(i, tuple(int(np.floor(scale * np.float64(c))) for c in v)) for i, v in rows if v is not None and len(v) == dim and all(c is not None and np.isfinite(c) for c in v)]
    by = sorted(kept, key=lambda r: (r[0] is None, hashlib.sha256(f"3:{r[0]}".encode()).hexdigest() if r[0] is not None else "", r[1]))
    centroids = [v for _, v in by[:k]]
    away = lambda v, c: sum((a - b) ** 2 for a, b in zip(v, c, strict=True))
    for t in range(rounds + 1):
        own = [min(range(len(centroids)), key=lambda j: (away(v, centroids[j]), j)) for _, v in kept]
        if t == rounds:
            break
        for j in range(len(centroids)):
            if mine := [v for (_, v), o in zip(kept, own, strict=True) if o == j]:
                centroids[j] = tuple(sum(c) // len(mine) for c in zip(*mine, strict=True))
    d = [away(v, centroids[o]) for (_, v), o in zip(kept, own, strict=True)]
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return [(i, o, x, sum(y for y, p in zip(d, own, strict=True) if p == o), sum(d), sha[o]) for (i, _), o, x in zip(kept, own, d, strict=True)]


def frame(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2, "x") for i, v in rows], "vec_id long, embedding array<float>, cluster int, id long, dist string").repartition(3)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r))


def rows_of(n, dim, seed, groups=5):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, dim))
    return [(i, [float(np.float32(x)) for x in middle[i % groups] + rng.normal(size=dim) * 0.4]) for i in range(n)]


def test_odd_vectors(spark):
    rows = rows_of(150, 64, 1)
    good = rows[0][1]
    rows += [(200, None), (201, []), (202, good[:63]), (203, [*good, 1.0]), (204, [None, *good[1:]]), (205, [float("nan"), *good[1:]]), (206, [float("-inf"), *good[1:]])]
    rows += [(None, good), (None, None), rows[0], rows[0], (3, good), (300, [0.0] * 64), (301, [-0.0] * 64)]
    assert result(clustering.cluster_vectors(frame(spark, rows))) == sorted(brute(rows), key=lambda r: (r[0] is None, r))


@pytest.mark.parametrize("n, k, rounds", [(0, 8, 10), (3, 8, 10), (40, 1, 2), (60, 5, 0), (60, 12, 25)])
def test_sizes(spark, n, k, rounds):
    rows = rows_of(n, 4, n)
    df = clustering.cluster_vectors(frame(spark, rows), k=k, rounds=rounds, dim=4)
    assert result(df) == sorted(brute(rows, k, rounds, 4)) and df.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def test_ties_and_copies(spark):
    """Whole coordinates in a small range: many equal distances, empty clusters and equal first centroids."""
    rng = random.Random(2)
    rows = [(i, [float(rng.randint(-1, 1)), float(rng.randint(0, 1))]) for i in range(80)]
    assert result(clustering.cluster_vectors(frame(spark, rows), k=9, dim=2, scale=1)) == sorted(brute(rows, 9, 10, 2, 1))


def test_bounds_save_distances_and_change_nothing():
    """Against a full scan in each round; bounds use the straight displacement, which is less than the drifts' sum."""
    v = np.array([[int(1024 * c) for c in x] for _, x in rows_of(3000, 64, 4, groups=8)])
    history, state, asked = [v[:8].copy()], None, []
    for _ in range(12):
        *state, evaluated = clustering.assigned(v, state and tuple(state), history)
        full = ((v[:, None] - history[-1]) ** 2).sum(2)
        assert (state[0] == full.argmin(1)).all()
        asked.append(evaluated)
        means = [v[state[0] == j].sum(0) // max(1, (state[0] == j).sum()) for j in range(8)]
        history.append(np.array([m if (state[0] == j).any() else c for j, (m, c) in enumerate(zip(means, history[-1], strict=True))]))
    assert asked[0] == full.size and sum(asked[1:]) < 0.5 * 11 * full.size
    drift = sum(np.sqrt(((b - a).astype(float) ** 2).sum(1)) for a, b in zip(history, history[1:], strict=False))
    assert (clustering.displacements(history)[0] <= drift + 1e-6).all()


def test_too_large(spark):
    with pytest.raises(Exception, match="too large"):
        clustering.cluster_vectors(frame(spark, [(1, [2.0**18] * 2)]), dim=2).collect()
    with pytest.raises(ValueError):
        clustering.cluster_vectors(frame(spark, []), k=0)
