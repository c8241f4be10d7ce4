"""Ball k-means, held against plain k-means over whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from newsloom.llm import balls

NAMES = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]


def plain(rows, k=8, rounds=10, dims=64):
    """The same rows by comparing every vector with every centroid, in Python's whole numbers."""
    kept = []
    for i, v in rows:
        if v is not None and len(v) == dims and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(1024 * float(x)) for x in v]))
    order = sorted((hashlib.sha256(f"3:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centres = [v for _, v in order[:k]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), j) for j, c in enumerate(centres)) for _, v in kept]

    for _ in range(rounds if centres else 0):
        found = assign()
        for j in range(len(centres)):
            own = [v for (_, v), f in zip(kept, found, strict=True) if f[1] == j]
            if own:
                centres[j] = [sum(x) // len(own) for x in zip(*own, strict=True)]
    found = assign() if centres else []
    total = sum(d for d, _ in found)
    by = {j: sum(d for d, c in found if c == j) for _, j in found}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centres]
    return sorted(((i, j, d, by[j], total, digest[j]) for (i, _), (d, j) in zip(kept, found, strict=True)), key=str)


def got(frame, **how):
    out = balls.cluster(frame, **how)
    assert out.columns == NAMES
    return sorted((tuple(r) for r in out.collect()), key=str)


def test_whole_table_matches_plain_k_means(spark, sf_dir):
    frame = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding")
    assert got(frame) == plain([tuple(r) for r in frame.collect()])


def test_odd_vectors(spark):
    """Nulls, other lengths, non-finite components, repeats, ties, ids that are null or repeated, clashing names."""
    v = lambda *x: [float(a) for a in x]
    rows = [(1, v(0, 0)), (2, v(0, 1)), (2, v(0, 1)), (2, v(5, 5)), (3, None), (4, v(1)), (5, [1.0, None]), (6, v(1, math.nan)), (7, v(math.inf, 1)), (None, v(0, 0.5)), (8, v(-0.3, -0.2)), (9, v(5, 5)), (10, v(2.5, 2.5)), (11, v(0, 0))]
    frame = spark.createDataFrame([(i, x, "a", 7, 1.5) for i, x in rows], "vec_id long, embedding array<double>, kind string, cluster int, distance double")
    for k in (1, 3, 8, 20):
        assert got(frame, k=k, dims=2) == plain(rows, k=k, dims=2)
    assert balls.cluster(frame.limit(0), dims=2).count() == 0
    assert balls.cluster(frame.where("vec_id is null"), dims=2).count() == 0


@pytest.mark.parametrize("size", [1, 5_000, 100_000])
def test_large_components_stay_exact(spark, size):
    rng = np.random.default_rng(size)
    rows = [(i, [float(x) * size for x in rng.normal(size=3)]) for i in range(60)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    assert got(frame, k=4, dims=3, rounds=4) == plain(rows, k=4, dims=3, rounds=4)


@pytest.mark.parametrize("wide", [60, 6])
def test_cores_and_annuli_pass_over_only_what_cannot_be_nearer(wide):
    """Vectors all over, where every ball has all others as neighbours, and vectors close to their centroids."""
    rng = np.random.default_rng(3)
    centres = [list(map(int, c)) for c in rng.integers(-50, 50, (12, 4))]
    x = rng.integers(-wide, wide + 1, (4000, 4)) + (np.array(centres)[rng.integers(0, 12, 4000)] if wide < 60 else 0)
    everywhere = ((x[:, None, :] - np.array(centres)[None]) ** 2).sum(axis=2)
    want = everywhere.argmin(axis=1)
    start, _ = balls.Balls(centres, [None] * 12).assign(x, np.zeros(len(x), dtype=np.int64))
    assert (start == want).all()
    far = [int(everywhere[want == j, j].max()) for j in range(12)]
    fresh = [[c + int(d) for c, d in zip(row, rng.integers(-3, 4, 4), strict=True)] for row in centres]
    moved = balls.Balls(centres, [None] * 12).moved(fresh, far)
    nearest, distance = moved.assign(x, start)
    everywhere = ((x[:, None, :] - np.array(fresh)[None]) ** 2).sum(axis=2)
    assert (nearest == everywhere.argmin(axis=1)).all() and (distance == everywhere.min(axis=1)).all()
    assert wide == 60 or sum(len(n) for n in moved.neighbours) < 12 * 11 // 2
