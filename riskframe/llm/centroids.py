"""Centroid clustering of integer vectors, filtered by n-simplex projection.

1. *Cached distances.* Some pivots are chosen among the first centroids, far from one another; the distance of each vector to each pivot is
   found once and kept with the vector.
2. *Apex coordinates.* Pivots span a simplex; a vector's distances to them fix it as the apex of a simplex over that base. Between two apexes
   the plain Euclidean distance is a lower bound of the true one, and with the last coordinate (the height over the base) mirrored
   it is an upper bound.
3. *Filter, then integers.* A centroid whose lower bound exceeds the least upper bound (with room for rounding) is out; the ones
   left are compared exactly in integers, ties going to the smaller number.
4. *Rounds.* Tasks add up their vectors per centroid, Spark adds up the tasks; the driver holds clusters x parts numbers.

Vectors with another number of parts, or with null or non-finite ones, are left out, as are null vectors. Each row is a vector of its own, also where
vec_id or vector repeat; rows without vec_id take part but start no centroid
(unless no row has one: then the smallest vectors start). Fewer vectors than clusters give fewer
centroids, none gives an empty result. Components so large that a squared distance might leave 64 bits are computed in Python's integers and
compared with all centroids; distances or inertias that do not fit a long are null. Other columns, whatever their names, are not read."""

from __future__ import annotations

import hashlib
import math
from fractions import Fraction

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex

#: Scaled components under this keep squared distances of 64 parts and sums of a task within 64 bits.
WIDE = 1 << 26
LIMB = 60
LONG = 1 << 63
#: Rounding of bounds, as a part of the distances they come from.
SLACK = 1e-3
#: A pivot stands at least this part of its distance above the others' base.
HEIGHT = 0.05
RESULT = "vec_id long, cluster int, distance long"


def cells_of(x: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles: 64-bit integers, or Python's where they could overflow."""
    if not x.size or np.abs(x).max() < WIDE / scale:
        return np.floor(scale * x).astype(np.int64)
    return np.array([[math.floor(Fraction(v) * scale) for v in row] for row in x.tolist()], object).reshape(x.shape)


def squared(x: np.ndarray, centroid: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows to one integer vector, or row by row to as many."""
    d = x - centroid
    return (d * d).sum(axis=1)


class Simplex:
    """The base that pivots span; ``project`` turns distances into apex coordinates."""

    def __init__(self, pivots: np.ndarray) -> None:
        self.pivots = pivots
        k = len(pivots)
        self.base = np.zeros((k, max(k - 1, 1)))
        for i in range(1, k):
            apex = self._apex(np.sqrt(np.array([[float(squared(pivots[j:j + 1], pivots[i])[0]) for j in range(i)]])))
            self.base[i, :i] = apex[0]

    def _apex(self, d: np.ndarray) -> np.ndarray:
        k = d.shape[1]
        out = np.zeros((len(d), k))
        for j in range(1, k):
            b = self.base[j, :j]
            dot = (d[:, 0] ** 2 + (b ** 2).sum() - d[:, j] ** 2) / 2
            out[:, j - 1] = (dot - out[:, :j - 1] @ b[:-1]) / b[-1]
        out[:, k - 1] = np.sqrt(np.maximum(d[:, 0] ** 2 - (out[:, :k - 1] ** 2).sum(axis=1), 0))
        return out

    def distances(self, x: np.ndarray) -> np.ndarray:
        return np.sqrt(np.stack([squared(x, p).astype(float) for p in self.pivots], axis=1))

    def project(self, distances: np.ndarray) -> np.ndarray:
        return self._apex(distances)


def simplex_of(candidates: np.ndarray, pivots: int) -> Simplex | None:
    """A simplex of at most ``pivots`` of the candidates, each the one that stands highest over the base so far."""
    if candidates.dtype == object or not len(candidates):
        return None
    chosen = [0]
    while len(chosen) < pivots:
        now = Simplex(candidates[chosen])
        d = now.distances(candidates)
        height = now.project(d)[:, -1] if len(chosen) > 1 else d[:, 0]
        best = int(np.argmax(height))
        if height[best] <= HEIGHT * d.max() or best in chosen:
            break
        chosen.append(best)
    return Simplex(candidates[chosen])


def nearest(x: np.ndarray, d: np.ndarray | None, simplex: Simplex | None, centroids: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """(number of the nearest centroid, squared distance, exact comparisons) of each row; ``d`` holds its distances to the pivots."""
    if d is None or simplex is None or x.dtype == object or centroids.dtype == object:
        every = np.stack([squared(x.astype(object), c.astype(object)) for c in centroids], axis=1)
        best = np.array([min(range(len(r)), key=lambda i, r=r: (r[i], i)) for r in every], np.int64)
        return best, every[np.arange(len(x)), best], every.size
    to = simplex.distances(centroids)
    a, b = simplex.project(d), simplex.project(to)
    flat = sum((a[:, j, None] - b[None, :, j]) ** 2 for j in range(a.shape[1] - 1)) if a.shape[1] > 1 else 0.0
    low = np.sqrt(flat + (a[:, -1, None] - b[None, :, -1]) ** 2)
    high = np.sqrt(flat + (a[:, -1, None] + b[None, :, -1]) ** 2)
    room = SLACK * (d.max(axis=1) + to.max())
    left = low <= (high.min(axis=1) + room)[:, None]
    row, col = np.nonzero(left)
    exact = squared(x[row], centroids[col])
    order = np.lexsort((col, exact, row))
    first = order[np.append(True, row[order][1:] != row[order][:-1])]
    return col[first], exact[first], len(row)


def points(vectors: DataFrame, parts: int) -> DataFrame:
    """(vec_id, x) of the vectors that are kept; ``x`` holds ``parts`` doubles."""
    ex.ready(vectors.sparkSession)

    def run(batches):
        ex.release()
        for batch in batches:
            column = batch.column("embedding")
            size = pc.list_value_length(column).fill_null(-1).to_numpy(zero_copy_only=False)
            rows = np.flatnonzero(size == parts)
            flat = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(rows), parts)  # nulls become NaN
            good = np.isfinite(flat).all(axis=1)
            yield pa.record_batch([batch.column("vec_id").take(pa.array(rows[good])), pa.array([r.tobytes() for r in flat[good]], pa.binary())], names=["vec_id", "x"])

    return vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding")).mapInArrow(run, "vec_id long, x binary")


def cached(kept: DataFrame, simplex: Simplex | None, parts: int, scale: int) -> DataFrame:
    """(vec_id, x, d): with the distances to the pivots, null where a vector is wide."""
    ex.ready(kept.sparkSession)

    def run(batches):
        ex.release()
        for batch in batches:
            x = _doubles(batch, parts)
            d: list[bytes | None] = [None] * len(x)
            rows = np.flatnonzero(np.abs(x).max(axis=1) < WIDE / scale) if simplex is not None and parts else []
            if len(rows):
                for i, own in zip(rows.tolist(), simplex.distances(cells_of(x[rows], scale)), strict=True):
                    d[i] = own.tobytes()
            yield pa.record_batch([batch.column("vec_id"), batch.column("x"), pa.array(d, pa.binary())], names=["vec_id", "x", "d"])

    return kept.mapInArrow(run, "vec_id long, x binary, d binary")


def _doubles(batch: pa.RecordBatch, parts: int) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, parts)


def _assigned(batch: pa.RecordBatch, simplex: Simplex | None, centroids: np.ndarray, parts: int, scale: int):
    """(rows of the batch, their cells, cluster, squared distance) for narrow vectors and for wide ones."""
    x, d = _doubles(batch, parts), batch.column("d").to_pylist()
    wide = np.array([v is None for v in d], bool)
    for rows in (np.flatnonzero(~wide), np.flatnonzero(wide)):
        if len(rows):
            cells = cells_of(x[rows], scale)
            own = None if wide[rows[0]] else np.frombuffer(b"".join(d[i] for i in rows), np.float64).reshape(len(rows), -1)
            cluster, distance, _ = nearest(cells, own, simplex, centroids)
            yield rows, cells, cluster, distance


def sums(table: DataFrame, simplex: Simplex | None, centroids: np.ndarray, parts: int, scale: int) -> dict[int, tuple[int, list[int]]]:
    """cluster -> (vectors, componentwise sums) after assigning every vector to the nearest centroid; exact.

    A task sends a row for each cluster and part, in limbs of LIMB bits."""
    ex.ready(table.sparkSession)

    def run(batches):
        ex.release()
        total: dict[int, list[int]] = {}
        for batch in batches:
            for _, cells, cluster, _ in _assigned(batch, simplex, centroids, parts, scale):
                for c in np.unique(cluster).tolist():
                    mine = cells[cluster == c]
                    old = total.setdefault(c, [0] * (parts + 1))
                    total[c] = [a + int(b) for a, b in zip(old, [len(mine), *mine.sum(axis=0)], strict=True)]
        rows = []
        for c, values in total.items():
            for place, value in enumerate(values):
                sign, left, limb = (-1 if value < 0 else 1), abs(value), 0
                while left or not limb:
                    rows.append((c, place, limb, sign * (left & ((1 << LIMB) - 1))))
                    left, limb = left >> LIMB, limb + 1
        if rows:
            yield pa.record_batch([pa.array(v, t) for v, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int32(), pa.int32(), pa.int64()), strict=True)], names=["cluster", "place", "limb", "value"])

    merged = table.mapInArrow(run, "cluster int, place int, limb int, value long").groupBy("cluster", "place", "limb").agg(F.sum(F.col("value").cast("decimal(38,0)")).alias("value"))
    out: dict[int, list[int]] = {}
    for r in merged.collect():  # clusters x parts x limbs
        out.setdefault(r.cluster, [0] * (parts + 1))[r.place] += int(r.value) << (LIMB * r.limb)
    return {c: (v[0], v[1:]) for c, v in out.items()}


def integers(rows: list[list[int]]) -> np.ndarray:
    """Integer vectors as 64-bit ones, or as Python's where those could overflow."""
    wide = any(abs(v) >= WIDE for r in rows for v in r)
    return np.array(rows, object if wide else np.int64)


def _fitting(values) -> pa.Array:
    return pa.array([int(v) if v < LONG else None for v in values], pa.int64())


def cluster(vectors: DataFrame, clusters: int = 16, rounds: int = 3, parts: int = 64, scale: int = 64, pivots: int = 6) -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256) of each kept vector.

    Centroids start as the ``clusters`` kept vectors with the smallest sha256 of ``1:<vec_id>`` (ties: the vector with the smaller bytes). Each round assigns all
    vectors and replaces the centroids that have any by floor(sum / count); after ``rounds`` of them all are assigned once more."""
    spark = vectors.sparkSession
    kept = ex.written(points(vectors, parts))
    start = kept.filter("vec_id is not null").withColumn("rank", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256)).orderBy("rank", "x").limit(clusters).collect()
    if not start:
        start = kept.orderBy("x").limit(clusters).collect()
    if not start:
        return spark.createDataFrame([], RESULT + ", cluster_inertia long, inertia long, centroid_sha256 string")
    centroids = integers([cells_of(np.frombuffer(r.x, np.float64)[None], scale)[0].tolist() for r in start])
    simplex = simplex_of(centroids, pivots)
    table = ex.written(cached(kept, simplex, parts, scale))
    for _ in range(rounds):
        found = sums(table, simplex, centroids, parts, scale)
        centroids = integers([[v // found[c][0] for v in found[c][1]] if c in found else row for c, row in enumerate(centroids.tolist())])

    def run(batches):
        ex.release()
        for batch in batches:
            for rows, _, own, distance in _assigned(batch, simplex, centroids, parts, scale):
                yield pa.record_batch([batch.column("vec_id").take(pa.array(rows)), pa.array(own.astype(np.int32)), _fitting(distance.tolist())], names=["vec_id", "cluster", "distance"])

    last = ex.written(table.mapInArrow(run, RESULT))
    inertia = {r.cluster: None if r.wide else int(r.total) for r in last.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.max(F.col("distance").isNull()).alias("wide")).collect()}
    whole = None if None in inertia.values() else sum(inertia.values())
    fits = {c: v if v is not None and v < LONG else None for c, v in inertia.items()}
    digest = {c: hashlib.sha256(",".join(map(str, centroids[c].tolist())).encode()).hexdigest() for c in inertia}
    own = spark.createDataFrame([(c, fits[c], whole if whole is not None and whole < LONG else None, digest[c]) for c in sorted(inertia)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return last.join(F.broadcast(own), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
