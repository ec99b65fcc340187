"""Exact k-means over whole-number vectors, with bounds that are loosened by the norm of a centroid's total displacement.

A vector keeps its squared distance to each centroid together with the round that distance was worked out in. All earlier
centroids are kept, so the distance to a centroid now differs from the stored one by at most the length of the straight way
from the centroid of that round to the one of this round, which is never more than the sum of its drifts from round to
round. Where the bounds leave no doubt, a vector stays where it is; the distances in doubt are worked out anew, exactly, in
whole numbers.

Vectors lie in blocks, one row each, so that a round is one pass of array work over a table, without a shuffle. A block
says how its own moves change the sums and counts of the clusters; only those numbers, some hundreds, reach the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import discard, giving_back, read, save

#: Vectors of a block at most; the largest whole number a component may become, so that squared distances fit 64 bits.
BLOCK_ROWS, LARGEST = 4096, 2**27
#: What the bounds are widened by, for square roots and sums in floating point.
SLACK = 1e-9

BLOCKS = "ids array<long>, vectors binary, cluster binary, dist binary, tag binary, moved array<long>, evaluated long"


def whole_vectors(df: DataFrame, key: str, vector: str, dim: int, scale: int) -> DataFrame:
    """(id, v array<long>): floor(scale * x) of the vectors with dim components, none null, NaN or infinite; others are left
    out. A component whose number is beyond LARGEST is an error."""
    kept = df.select(F.col(key).cast("long").alias("id"), F.col(vector).cast("array<double>").alias("x"))
    kept = kept.where(f"size(x) = {dim} AND forall(x, c -> c IS NOT NULL AND NOT isnan(c) AND abs(c) < CAST('Infinity' AS DOUBLE))")
    whole = f"transform(x, c -> IF(abs({scale}D * c) < {LARGEST}, CAST(floor({scale}D * c) AS BIGINT), CAST(raise_error('a component is too large for whole distances') AS BIGINT)))"
    return kept.select("id", F.expr(whole).alias("v"))


def first_centroids(vectors: DataFrame, k: int, seed: str) -> np.ndarray:
    """The k vectors with the smallest sha256 of '<seed>:<id>', in ascending order; null ids go last, ties by components."""
    by = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("id").cast("string")), 256)
    rows = vectors.select("v", by.alias("h")).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()  # k rows
    return np.array([r.v for r in rows], np.int64)


def _exact(v: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    away = v - centroid
    return np.einsum("ij,ij->i", away, away)


def displacements(history: list[np.ndarray]) -> np.ndarray:
    """[round, centroid]: how far each centroid is now from where it was in that round."""
    away = (np.stack(history) - history[-1]).astype(np.float64)
    return np.sqrt((away * away).sum(2))


def assigned(v: np.ndarray, state: tuple[np.ndarray, np.ndarray, np.ndarray] | None, history: list[np.ndarray], last: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """(cluster, dist, tag, distances worked out) of vectors for the newest centroids of history; state: the former three.

    dist holds squared distances to all centroids, each as of the round in tag. Ties go to the smaller number. last: the
    own distance is brought up to date too.
    """
    now, k = len(history) - 1, len(history[-1])
    rows = np.arange(len(v))
    if state is None:
        dist = np.stack([_exact(v, c) for c in history[-1]], 1) if len(v) else np.zeros((0, k), np.int64)
        return dist.argmin(1).astype(np.int8), dist, np.full(dist.shape, now, np.int8), dist.size
    cluster, dist, tag = (x.copy() for x in state)
    moved = displacements(history)
    columns = np.arange(k)

    def doubts(some: np.ndarray) -> np.ndarray:
        near, own = np.sqrt(dist[some].astype(np.float64)), cluster[some].astype(np.int64)
        loose = moved[tag[some], columns]
        at = np.arange(len(some))
        upper = (near[at, own] + loose[at, own]) * (1 + SLACK) + SLACK
        lower = (near - loose) * (1 - SLACK) - SLACK
        found = lower <= upper[:, None]
        found[at, own] = False
        return found

    evaluated = 0
    in_doubt = rows if last else rows[doubts(rows).any(1)]
    for j in range(k):  # first the own distance, as of now
        some = in_doubt[(cluster[in_doubt] == j) & (tag[in_doubt, j] != now)]
        dist[some, j] = _exact(v[some], history[-1][j])
        tag[some, j] = now
        evaluated += len(some)
    left = doubts(in_doubt)
    for j in range(k):
        some = in_doubt[left[:, j]]
        stale = some[tag[some, j] != now]
        dist[stale, j] = _exact(v[stale], history[-1][j])
        tag[stale, j] = now
        evaluated += len(stale)
    left[np.arange(len(in_doubt)), cluster[in_doubt].astype(np.int64)] = True
    cluster[in_doubt] = np.where(left, dist[in_doubt], np.iinfo(np.int64).max).argmin(1)
    return cluster, dist, tag, evaluated


def _changes(v: np.ndarray, before: np.ndarray | None, after: np.ndarray, k: int) -> np.ndarray:
    """[cluster, count and sums]: what the moves from before to after add to each cluster; from nowhere where before is None."""
    out = np.zeros((k, v.shape[1] + 1), np.int64)
    some = np.ones(len(v), bool) if before is None else before != after
    for sign, of in ((1, after), *(() if before is None else ((-1, before),))):
        for j in range(k):
            own = v[some & (of == j)]
            out[j, 0] += sign * len(own)
            out[j, 1:] += sign * own.sum(0)
    return out


def _block(ids: pa.Array, v: np.ndarray, before: np.ndarray | None, state: tuple, k: int) -> pa.RecordBatch:
    cluster, dist, tag, evaluated = state
    lists = pa.ListArray.from_arrays(pa.array([0, len(ids)], pa.int32()), ids)
    moved = _changes(v, before, cluster, k).ravel()
    columns = [lists, *(pa.array([x.tobytes()], pa.binary()) for x in (v.astype("<i4"), cluster, dist, tag)), pa.array([moved], pa.list_(pa.int64())), pa.array([evaluated], pa.int64())]
    return pa.RecordBatch.from_arrays(columns, ["ids", "vectors", "cluster", "dist", "tag", "moved", "evaluated"])


def _first(batches: Iterator[pa.RecordBatch], history: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
    k, dim = history[0].shape
    for b in batches:
        for at in range(0, b.num_rows, BLOCK_ROWS):
            part = b.slice(at, BLOCK_ROWS)
            v = part.column(1).flatten().to_numpy().reshape(-1, dim)
            yield _block(part.column(0), v, None, assigned(v, None, history), k)


def _next(batches: Iterator[pa.RecordBatch], history: list[np.ndarray], last: bool) -> Iterator[pa.RecordBatch]:
    k, dim = history[0].shape
    for b in batches:
        for i in range(b.num_rows):
            ids, vectors, cluster, dist, tag = (b.column(b.schema.get_field_index(x)) for x in ("ids", "vectors", "cluster", "dist", "tag"))
            v = np.frombuffer(vectors[i].as_buffer(), "<i4").reshape(-1, dim).astype(np.int64)
            before = np.frombuffer(cluster[i].as_buffer(), np.int8)
            state = before, np.frombuffer(dist[i].as_buffer(), np.int64).reshape(-1, k), np.frombuffer(tag[i].as_buffer(), np.int8).reshape(-1, k)
            yield _block(ids[i].values, v, before, assigned(v, state, history, last), k)


def _rows(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for ids, cluster, dist in zip(*(b.column(b.schema.get_field_index(x)) for x in ("ids", "cluster", "dist")), strict=True):
            own = np.frombuffer(cluster.as_buffer(), np.int8).astype(np.int32)
            away = np.frombuffer(dist.as_buffer(), np.int64).reshape(-1, k)[np.arange(len(own)), own]
            yield pa.RecordBatch.from_arrays([ids.values, pa.array(own), pa.array(away)], ["id", "cluster", "distance"])


def cluster_vectors(df: DataFrame, key: str = "vec_id", vector: str = "embedding", k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024, seed: str = "3") -> DataFrame:
    """(key, cluster, distance, cluster_inertia, inertia, centroid_sha256) of every vector with dim components, none of them
    null or non-finite.

    Vectors are floor(scale * x). The first centroids are the k vectors with the smallest sha256 of '<seed>:<key>' (fewer
    if there are fewer). Each round assigns every vector to the nearest centroid, ties to the smaller number, and moves every
    centroid that has vectors to their floored mean. At the end all are assigned once more. Repeated rows count each;
    a null key is a vector like others, but is among the first centroids only where other keys are too few. A table without
    such vectors has no rows. Other columns are not looked at. k: 1 to 127; rounds: 0 to 126.
    """
    if not (1 <= k <= 127 and 0 <= rounds <= 126):
        raise ValueError("k must be 1 to 127 and rounds 0 to 126")
    vectors = whole_vectors(df, key, vector, dim, scale)
    history = [first_centroids(vectors, k, seed)]
    own = "cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not len(history[0]):
        return df.sparkSession.createDataFrame([], f"`{key}` long, {own}")
    k = len(history[0])
    totals = np.zeros((k, dim + 1), np.int64)
    blocks = save(vectors.mapInArrow(giving_back(lambda it, h=tuple(history): _first(it, list(h))), BLOCKS), "blocks")
    for t in range(rounds):
        for r in blocks.select(F.posexplode("moved").alias("at", "change")).groupBy("at").agg(F.sum("change").alias("change")).collect():  # k * (dim + 1) rows
            totals[divmod(r["at"], dim + 1)] += r["change"]
        counts = totals[:, :1]
        history.append(np.where(counts > 0, totals[:, 1:] // np.maximum(counts, 1), history[-1]))
        settled = (history[-1] == history[-2]).all()  # then later rounds would change nothing
        last = settled or t == rounds - 1
        after = save(blocks.mapInArrow(giving_back(lambda it, h=tuple(history), z=last: _next(it, list(h), z)), BLOCKS), "blocks")
        discard(blocks)
        blocks = after
        if settled:
            break
    found = blocks.select("ids", "cluster", "dist").mapInArrow(giving_back(lambda it: _rows(it, k)), "id long, cluster int, distance long")
    sums = {r["cluster"]: r["s"] for r in found.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # k rows
    shas = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in history[-1].tolist()]
    of = lambda values: F.element_at(F.array(*map(F.lit, values)), F.col("cluster") + 1)
    return found.select(
        F.col("id").alias(key), "cluster", "distance", of([sums.get(j, 0) for j in range(k)]).cast("long").alias("cluster_inertia"),
        F.lit(sum(sums.values())).cast("long").alias("inertia"), of(shas).alias("centroid_sha256"),
    )


def op11(spark, sf_dir: str) -> DataFrame:
    return cluster_vectors(read(spark, sf_dir, "embeddings", "vec_id", "embedding"))


def _oracle(k: int = 8, rounds: int = 10, dim: int = 64, scale: int = 1024) -> str:
    """The plain method: all distances in every round."""
    near = "list_sum(list_transform(range(1, {dim} + 1), lambda i: (v[i] - m[i]) * (v[i] - m[i])))::BIGINT".format(dim=dim)
    out = [
        f"""x AS (SELECT vec_id, list_transform(embedding, lambda e: floor({scale} * e::DOUBLE)::BIGINT) AS v FROM embeddings
        WHERE len(embedding) = {dim} AND len(list_filter(embedding, lambda e: e IS NOT NULL AND isfinite(e))) = {dim})""",
        f"c0 AS (SELECT row_number() OVER (ORDER BY sha256('3:' || vec_id)) - 1 AS j, v AS m FROM x ORDER BY sha256('3:' || vec_id) LIMIT {k})",
    ]
    for t in range(rounds + 1):
        out.append(f"a{t} AS MATERIALIZED (SELECT vec_id, v, min(struct_pack(d := {near}, j := j)) AS b FROM x, c{t} GROUP BY vec_id, v)")
        if t < rounds:
            total = f"SELECT b.j AS j, i, sum(v[i])::BIGINT AS s, count(*) AS n FROM a{t}, (SELECT unnest(range(1, {dim} + 1)) AS i) GROUP BY b.j, i"
            mean = f"SELECT j, list((s - ((s % n) + n) % n) // n ORDER BY i) AS m FROM ({total}) GROUP BY j"
            out.append(f"c{t + 1} AS MATERIALIZED (SELECT j, coalesce(u.m, o.m) AS m FROM c{t} o LEFT JOIN ({mean}) u USING (j))")
    return f"""WITH {", ".join(out)} SELECT vec_id, b.j::INT AS cluster, b.d AS distance, (sum(b.d) OVER (PARTITION BY b.j))::BIGINT AS cluster_inertia,
        (sum(b.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(m, ',')) AS centroid_sha256 FROM a{rounds} JOIN c{rounds} ON j = b.j"""


ORACLE = _oracle()
