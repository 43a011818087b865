"""Exact k-means over whole numbers with bounds from the history of the centroids (ns-bounds).

A vector keeps, for each centroid, the distance measured last and the round of that measurement. As
long as the centroid has moved from its place of then to its place of now by ``m`` in total (the norm
of the sum of its moves, not the sum of their norms), the distance now lies within ``m`` of the one
measured. Only centroids whose lower bound does not exceed the upper bound of the vector's own one
are measured again, exactly, so assignments equal those of a full scan, ties included.

Rows are written to the shared folder once a round; the sums of the clusters are carried on by the
vectors that changed their cluster. On the driver: places of the centroids of every round.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import discard, importable, stored
from gridloom.llm.vectors import all_squares, kept_vectors, list_column, matrix, pair_squares

STATE = "vec_id long, x array<long>, cluster int, previous int, measured array<float>, measured_in array<byte>, distance long, n_measured int"
COLUMNS = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
# Bounds are kept as 32-bit floats; what they may err by, relative to the numbers they are made of.
SLACK = 1e-6


def seeds(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The ``k`` vectors whose ``seed:id`` has the smallest SHA-256; rows without an id come last, ties by vector."""
    named = vectors.select("vec_id", "x", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256).alias("h"))
    return np.array([r["x"] for r in named.orderBy(F.asc_nulls_last("h"), "x").limit(k).collect()], dtype=np.int64)


def first_scan(x: np.ndarray, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Cluster, its squared distance, and all distances."""
    squares = all_squares(x, centroids)
    cluster = squares.argmin(axis=1)
    return cluster, squares[np.arange(len(x)), cluster], np.sqrt(squares)


def rescan(
    x: np.ndarray, cluster: np.ndarray, measured: np.ndarray, measured_in: np.ndarray, history: np.ndarray
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """New clusters, their squared distances, and how many distances were measured; the bounds change in place.

    ``history`` has the places of all centroids by round, the present one last.
    """
    now, (n, k) = len(history) - 1, measured.shape
    moved = np.sqrt(((history - history[-1]) ** 2).sum(axis=2).astype(np.float64))
    loose = moved[measured_in, np.arange(k)]
    # A float's error is relative to what was measured, so it is taken from and added to both bounds.
    low = measured - loose - SLACK * (measured + loose)
    rows = np.arange(n)
    high = measured[rows, cluster] + loose[rows, cluster]
    high += SLACK * high
    low[rows, cluster] = np.inf
    # The own distance first: it is an exact upper bound for the others.
    own = pair_squares(x, rows, history[-1], cluster)
    count = np.ones(n, dtype=np.int32)
    open_rows = np.flatnonzero((low <= high[:, None]).any(axis=1))
    exact = np.sqrt(own[open_rows].astype(np.float64)) * (1 + SLACK)
    i, j = np.nonzero(low[open_rows] <= exact[:, None])
    i = open_rows[i]
    squares = pair_squares(x, i, history[-1], j)
    measured[rows, cluster], measured_in[rows, cluster] = np.sqrt(own), now
    measured[i, j], measured_in[i, j] = np.sqrt(squares), now
    np.add.at(count, i, 1)
    # The least of (distance, number) among those measured.
    who, which, far = np.concatenate((rows, i)), np.concatenate((cluster, j)), np.concatenate((own, squares))
    order = np.lexsort((which, far, who))
    first = order[np.flatnonzero(np.diff(who[order], prepend=-1))]
    return which[first], far[first], count


def _state_batch(ids: pa.Array, x, cluster, previous, measured, measured_in, distance, count) -> pa.RecordBatch:
    columns = [
        ids, x, pa.array(cluster, pa.int32()), pa.array(previous, pa.int32()), list_column(measured.astype(np.float32)),
        list_column(measured_in.astype(np.int8)), pa.array(distance, pa.int64()), pa.array(count, pa.int32()),
    ]
    return pa.RecordBatch.from_arrays(columns, names=[f.split(" ")[0] for f in STATE.split(", ")])


def assigned(state: DataFrame, history: np.ndarray, first: bool) -> DataFrame:
    """``STATE`` after one more assignment to the last places of ``history``."""
    shared, (k, width) = state.sparkSession.sparkContext.broadcast(history), history.shape[1:]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = matrix(batch.column("x"), width)
            if first:
                cluster, distance, measured = first_scan(x, shared.value[-1])
                yield _state_batch(batch.column("vec_id"), batch.column("x"), cluster, np.full(len(x), -1), measured, np.zeros(measured.shape), distance, np.full(len(x), k))
                continue
            previous = batch.column("cluster").to_numpy().astype(np.int64)
            measured = batch.column("measured").flatten().to_numpy().astype(np.float64).reshape(-1, k)
            measured_in = batch.column("measured_in").flatten().to_numpy().astype(np.int64).reshape(-1, k)
            cluster, distance, count = rescan(x, previous, measured, measured_in, shared.value)
            yield _state_batch(batch.column("vec_id"), batch.column("x"), cluster, previous, measured, measured_in, distance, count)

    return state.mapInArrow(scan, STATE)


def changes(state: DataFrame, width: int) -> DataFrame:
    """``cluster, at, n, s``: what the vectors that changed their cluster add to its count and sums, each task's share added up first."""

    def share(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, list] = {}
        for batch in batches:
            x = matrix(batch.column("x"), width)
            for name, sign in (("cluster", 1), ("previous", -1)):
                numbers = batch.column(name).to_numpy()
                for c in np.unique(numbers[numbers >= 0]):
                    mine = x[numbers == c]
                    total = totals.setdefault(int(c), [0, np.zeros(width, dtype=np.int64)])
                    total[0] += sign * len(mine)
                    total[1] += sign * mine.sum(axis=0)
        for c, (n, s) in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([c] * width, pa.int32()), pa.array(range(width), pa.int32()), pa.array([n] * width, pa.int64()), pa.array(s)], names=["cluster", "at", "n", "s"]
            )

    moved = state.where("cluster <> previous").select("x", "cluster", "previous")
    return moved.mapInArrow(share, "cluster int, at int, n long, s long").groupBy("cluster", "at").agg(F.sum("n").alias("n"), F.sum("s").alias("s"))


def centroid_clusters(
    df: DataFrame, k: int = 40, rounds: int = 5, seed: int = 2, scale: int = 256, width: int = 64, id: str = "vec_id", vector: str = "embedding"
) -> DataFrame:
    """Per kept vector: ``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256``.

    Vectors with another length than ``width``, and those that are NULL or hold NULL or a number that is
    not finite, are left out. The ``k`` seeds have the smallest hashes of their ids; fewer vectors are
    fewer centroids. After ``rounds`` rounds, in which a cluster's new place is the floor of its mean (an
    empty cluster stays), vectors are assigned once more. Equal distances go to the smaller number.
    Rows that share an id are vectors of their own; a NULL id is kept, and a seed only where others do not
    suffice. Other columns are not looked at. An empty table gives an empty result. A component beyond
    2^27 after scaling is an error.
    """
    spark = df.sparkSession
    importable(spark)
    rows = kept_vectors(df.select(F.col(id).cast("long").alias("vec_id"), F.col(vector).alias("embedding")).where(F.size("embedding") == width), "embedding", scale)
    kept = stored(rows.select("vec_id", "x"), "centroid-vectors")
    places = seeds(kept, k, seed)
    if not len(places):
        return spark.createDataFrame([], COLUMNS)
    history, counts, sums = places[None], [0] * len(places), [[0] * width for _ in places]
    state = kept
    for i in range(rounds + 1):
        following = stored(assigned(state, history, i == 0), "centroid-state")
        discard(state)
        state = following
        if i == rounds:
            break
        # One number per centroid and component.
        for c, at, n, s in changes(state, width).collect():
            counts[c] += n if at == 0 else 0
            sums[c][at] += s
        places = [[s // n for s in own] if n else old for own, n, old in zip(sums, counts, history[-1].tolist())]
        history = np.concatenate((history, np.array([places], dtype=np.int64)))
    inertia = {r["cluster"]: int(r["d"]) for r in state.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("d")).collect()}
    names = [hashlib.sha256(",".join(map(str, own)).encode()).hexdigest() for own in history[-1].tolist()]
    # One row per centroid.
    facts = spark.createDataFrame([(c, d, sum(inertia.values()), names[c]) for c, d in inertia.items()], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return state.select("vec_id", "cluster", "distance").join(F.broadcast(facts), "cluster").select(*[f.split(" ")[0] for f in COLUMNS.split(", ")])
