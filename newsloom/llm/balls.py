"""Exact k-means over whole numbers by balls.

A cluster is a ball: its centroid and the distance of its farthest member. Only centroids whose
midpoint with the ball's own centroid can lie inside the ball are its neighbours. A member nearer to
its centroid than half the way to the nearest neighbour is in the stable core and stays; the others
lie in annuli between the half-ways to neighbours in order, and are compared with the neighbours of
their annulus and those further in. All comparisons are of squared distances in whole numbers, so what
is passed over can't be nearer, nor tie with a smaller number.

One round is one pass: members are written with their cluster for the next round, and each task
adds one row for each of its clusters (sums, count, radius), of which the driver gets k x d sums.
A round's input is the written table of the round before, so lineage stays short.

Vectors that are null, of another length or with a null or non-finite component are passed over. Vectors
without id are clustered but are no start; repeated rows each count. Of equal hashes the smaller vector
comes first. With fewer than k vectors there are fewer centroids; an empty table gives no rows. Squared
distances must fit a long, else the query fails. Other columns go.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from newsloom.llm.plan import bounded_batches, quoted, release, stored

SCALE = 1024
#: A member's row, or what one task has found of one ball: the sums of its members, how many, the farthest.
STATE = "kind string, vec_id long, cluster int, distance long, vector array<long>"
#: Components below these bounds have squared distances that doubles, or longs, hold exactly.
IN_DOUBLE, IN_LONG = 1 << 22, 1 << 27


def whole(vectors: DataFrame, dims: int, id_col: str, vector_col: str) -> DataFrame:
    """vec_id and vector: components times SCALE rounded down, of vectors that have ``dims`` finite ones."""
    vector = F.col(quoted(vector_col)).cast("array<double>")
    fine = (F.size(vector) == dims) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    kept = vectors.where(F.coalesce(fine, F.lit(False)))
    return kept.select(F.col(quoted(id_col)).cast("long").alias("vec_id"), F.transform(vector, lambda x: F.floor(x * SCALE).cast("long")).alias("vector"))


def starts(rows: DataFrame, k: int, seed: int) -> list[list[int]]:
    """The k vectors whose ids hash lowest."""
    hashed = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    return [r.vector for r in rows.where("vec_id is not null").orderBy(hashed, "vector").select("vector").limit(k).collect()]


def squared(a: list[int], b: list[int]) -> int:
    return sum((x - y) ** 2 for x, y in zip(a, b, strict=True))


class Balls:
    """Centroids, each one's neighbours from near to far and their squared distances, in whole numbers."""

    def __init__(self, centroids: list[list[int]], radii: list[int | None]):
        self.centroids, self.radii = centroids, radii
        self.apart = [[squared(a, b) for b in centroids] for a in centroids]
        self.neighbours = [
            # a midpoint outside the ball: nothing of the ball is nearer to that neighbour
            sorted((d, j) for j, d in enumerate(row) if j != i and (radii[i] is None or d <= 4 * radii[i] ** 2))
            for i, row in enumerate(self.apart)
        ]

    def moved(self, centroids: list[list[int]], farthest: list[int | None]) -> Balls:
        """The balls around new centroids: a member is no farther than it was plus the centroid's way."""
        way = [math.isqrt(squared(a, b) - 1) + 1 if a != b else 0 for a, b in zip(self.centroids, centroids, strict=True)]
        return Balls(centroids, [None if f is None else (math.isqrt(f) + 1 + w) for f, w in zip(farthest, way, strict=True)])

    def assign(self, x: np.ndarray, cluster: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each vector's nearest centroid, given the one it had, and the squared distance; ties go to the smaller number."""
        most = max(int(np.abs(x).max(initial=0)), max(abs(v) for c in self.centroids for v in c))
        kind = np.float64 if most < IN_DOUBLE else np.int64 if most < IN_LONG else object
        x, centres = x.astype(kind), np.array(self.centroids, dtype=object).astype(kind)
        away = lambda rows, j: ((x[rows] - centres[j]) ** 2).sum(axis=1)
        best, nearest = np.zeros(len(x), dtype=kind), cluster.copy()
        for i in np.unique(cluster).tolist():
            rows = np.flatnonzero(cluster == i)
            own = away(rows, i)
            order = np.argsort(-own, kind="stable")
            rows, own = rows[order], own[order]
            best[rows] = own
            for apart, j in self.neighbours[i]:
                outer = int(np.count_nonzero(4 * own >= apart))  # those beyond the half-way, or on it
                if not outer:
                    break  # all that are left are in the core as to further neighbours
                some = rows[:outer]
                there = away(some, j)
                better = (there < best[some]) | (there == best[some]) & (j < nearest[some])
                best[some[better]], nearest[some[better]] = there[better], j
        if kind is object and len(best) and max(best) >= 1 << 63:
            raise ValueError("a squared distance does not fit a long")
        return nearest, best.astype(np.int64)


def _round(rows: DataFrame, balls: Balls, dims: int) -> DataFrame:
    """STATE after one assignment; rows without a cluster are compared with all centroids."""
    sent = rows.sparkSession.sparkContext.broadcast(balls)
    k = len(balls.centroids)

    def run(batches):
        count, sums, farthest = [0] * k, [0] * k, [0] * k
        for batch in batches:
            if not len(batch):
                continue
            x = np.ascontiguousarray(batch.column(1).flatten().to_numpy().reshape(-1, dims))
            nearest, distance = sent.value.assign(x, batch.column(2).to_numpy().astype(np.int64))
            for i in np.unique(nearest).tolist():
                own = nearest == i
                count[i] += int(own.sum())
                # halves of 32 bits, so that no sum of a batch leaves its long
                sums[i] = sums[i] + (x[own] & 0xFFFFFFFF).sum(axis=0).astype(object) + (x[own] >> 32).sum(axis=0).astype(object) * (1 << 32)
                farthest[i] = max(farthest[i], int(distance[own].max()))
            yield pa.RecordBatch.from_arrays([pa.array(["member"] * len(x)), batch.column(0), pa.array(nearest, pa.int32()), pa.array(distance), batch.column(1).cast(pa.list_(pa.int64()))], ["kind", "vec_id", "cluster", "distance", "vector"])
        some = [i for i in range(k) if count[i]]
        if some:
            made = [pa.array(["ball"] * len(some)), pa.array([count[i] for i in some], pa.int64()), pa.array(some, pa.int32()), pa.array([farthest[i] for i in some], pa.int64()), pa.array([[int(s) for s in sums[i]] for i in some], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(made, ["kind", "vec_id", "cluster", "distance", "vector"])

    return stored(rows.select("vec_id", "vector", "cluster").mapInArrow(run, STATE), by=("kind",))


def _found(state: DataFrame, k: int) -> tuple[list[int], list[list[int]], list[int | None]]:
    """Of every ball: members, sums and the farthest's squared distance; k x d numbers in all."""
    balls = state.where("kind = 'ball'")
    count, farthest = [0] * k, [None] * k
    for r in balls.groupBy("cluster").agg(F.sum(F.col("vec_id").cast("decimal(38,0)")).alias("n"), F.max("distance").alias("far")).collect():
        count[r.cluster], farthest[r.cluster] = int(r.n), r.far
    sums = [{} for _ in range(k)]
    each = balls.select("cluster", F.posexplode("vector").alias("place", "x"))
    for r in each.groupBy("cluster", "place").agg(F.sum(F.col("x").cast("decimal(38,0)")).alias("x")).collect():
        sums[r.cluster][r.place] = int(r.x)
    return count, [[s[i] for i in sorted(s)] for s in sums], farthest


def cluster(vectors: DataFrame, k: int = 8, rounds: int = 10, dims: int = 64, seed: int = 3, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """vec_id, cluster, distance (squared), cluster_inertia, inertia and centroid_sha256 of every kept vector."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    rows = whole(vectors, dims, id_col, vector_col)
    centroids = starts(rows, k, seed)
    names = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not centroids:
        return spark.createDataFrame([], names)
    k = len(centroids)
    balls, before = Balls(centroids, [None] * k), None
    state = rows.withColumn("cluster", F.lit(0))
    for n in range(rounds + 1):
        state = _round(state, balls, dims)
        release(before)
        before = state
        if n < rounds:
            count, sums, farthest = _found(state, k)
            # an empty ball stays where it is
            fresh = [[s // c for s in own] if c else old for c, own, old in zip(count, sums, balls.centroids, strict=True)]
            balls = balls.moved(fresh, farthest)
        state = state.where("kind = 'member'")
    total = state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("n")).collect()
    inertia = {r.cluster: int(r.n) for r in total}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in balls.centroids]
    facts = spark.createDataFrame([(c, n, sum(inertia.values()), digest[c]) for c, n in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
