"""Near-duplicate embeddings by an exact metric range join.

Vectors are compared within a label by cosine; the angle between vectors is a metric. Pivots (a bounded sample
of vectors, more for larger labels) part the vectors of a label into cells by the nearest pivot. By the
triangle inequality a vector can link into another cell only if its angle to that cell's pivot is at most
twice the linking angle more than to its own; it is replicated to just those cells (of the higher number, so
that a pair meets once), and cells join independently. Pivots change the work and never the result.

Equal vectors are one point with a weight. A cell is worked off in tiles of at most ``tile`` by ``tile`` points, so
no task holds a large cell; a tile returns numbers of links and a spanning forest, not pairs.

Vectors that are null, empty, zero or hold null or non-finite components, and rows without label, link with
nothing; vectors of different length don't compare. Rows that repeat a vec_id with the same vector count
once. Rows without vec_id are left out."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .components import components

POINT = "vec_id long, place string, digest binary, vector binary"


def points(vectors: DataFrame) -> DataFrame:
    """POINT rows: the label and length of a vector as its place (null: links with nothing), and its components."""
    ex.ready(vectors.sparkSession)

    def run(batches):
        ex.release()
        for batch in batches:
            rows = []
            for i, e, label in zip(batch.column("vec_id").to_pylist(), batch.column("embedding").to_pylist(), batch.column("label").to_pylist(), strict=True):
                v = np.array([np.nan if x is None else x for x in e or []], np.float64) + 0.0
                if label is None or not len(v) or not np.isfinite(v).all() or not v.any():
                    rows.append((i, None, None, None))
                else:
                    place = f"{label}/{len(v)}"
                    rows.append((i, place, hashlib.blake2b(place.encode() + v.tobytes(), digest_size=16).digest(), v.tobytes()))
            yield pa.record_batch([pa.array([r[j] for r in rows], kind) for j, kind in enumerate((pa.int64(), pa.string(), pa.binary(), pa.binary()))], names=["vec_id", "place", "digest", "vector"])

    return vectors.filter("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.col("label").cast("string").alias("label")).mapInArrow(run, POINT)


def unit(payloads: list[bytes]) -> np.ndarray:
    """Rows of unit length (scaled first, so that no square overflows)."""
    v = np.array([np.frombuffer(p, np.float64) for p in payloads])
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def pivots_of(unique: DataFrame, per_cell: int, most: int, per_label: int) -> dict[str, np.ndarray]:
    """Pivots of the places with more than ``per_cell`` points: at most ``per_label`` each and ``most`` in all."""
    large = unique.groupBy("place").count().filter(f"count > {per_cell}").orderBy(F.desc("count"), "place").limit(max(1, most // per_label)).collect()
    wanted = {r.place: int(min(per_label, -(-r["count"] // per_cell))) for r in large}
    if not wanted:
        return {}
    share = {r.place: min(1.0, 4 * wanted[r.place] / r["count"]) for r in large}
    rule = F.coalesce(*[F.when(F.col("place") == p, F.lit(s)) for p, s in share.items()], F.lit(0.0))
    some = unique.filter(F.pmod(F.xxhash64("digest"), F.lit(1_000_000)) < rule * 1_000_000).select("place", "digest", "vector").orderBy("place", "digest").limit(8 * most).toArrow()
    found: dict[str, list[bytes]] = {}
    for place, vector in zip(some.column("place").to_pylist(), some.column("vector").to_pylist(), strict=True):
        found.setdefault(place, []).append(vector)
    out = {}
    for place, payloads in found.items():
        v = unit(payloads)
        chosen, nearest = [0], v @ v[0]
        while len(chosen) < min(wanted[place], len(v)):  # far from those chosen so far
            chosen.append(int(nearest.argmin()))
            nearest = np.maximum(nearest, v @ v[chosen[-1]])
        out[place] = v[chosen]
    return out


def cells(unique: DataFrame, pivots: dict[str, np.ndarray], angle: float) -> DataFrame:
    """(place, cell, home, rep, weight, vector): each point in its own cell and where it can link into."""
    sent = unique.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        ex.release()
        for batch in batches:
            places, payloads, row, cell, home = batch.column("place").to_pylist(), batch.column("vector").to_pylist(), [], [], []
            groups: dict[str, list[int]] = {}
            for i, p in enumerate(places):
                groups.setdefault(p, []).append(i)
            for place, at in groups.items():
                if place not in sent.value:
                    row += at
                    cell += [0] * len(at)
                    home += [True] * len(at)
                    continue
                far = np.arccos(np.clip(unit([payloads[i] for i in at]) @ sent.value[place].T, -1, 1))
                own = far.argmin(axis=1)
                near = (far - far[np.arange(len(at)), own][:, None] <= 2 * angle + 1e-6) & (np.arange(far.shape[1])[None, :] >= own[:, None])
                i, c = np.nonzero(near)
                row += [at[k] for k in i.tolist()]
                cell += c.tolist()
                home += (c == own[i]).tolist()
            for lo in range(0, len(row), 4096):
                part = batch.take(pa.array(row[lo:lo + 4096], pa.int64()))
                yield pa.record_batch([part.column("place"), pa.array(cell[lo:lo + 4096], pa.int32()), pa.array(home[lo:lo + 4096], pa.bool_()), part.column("rep"), part.column("weight"), part.column("vector")], names=["place", "cell", "home", "rep", "weight", "vector"])

    return unique.select("place", "rep", "weight", "vector").mapInArrow(run, "place string, cell int, home boolean, rep long, weight long, vector binary")


def tile_links(table: pa.Table, least: float, same: bool) -> pa.Table:
    """(rep, links, root) of each point of a tile: weight of what it links with, and the least point it reaches."""
    rep, weight = table.column("rep").to_numpy(), table.column("weight").to_numpy()
    home, side = (np.array(table.column(c).to_pylist()) for c in ("home", "side"))
    payloads = table.column("vector").to_pylist()
    v = unit(payloads)
    links, parent = np.zeros(len(rep), np.int64), np.arange(len(rep))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    def join(a: np.ndarray, b: np.ndarray, triangle: bool) -> None:
        for lo in range(0, len(a), 512):
            part = a[lo:lo + 512]
            cosine = v[part] @ v[b].T
            hit = cosine >= least
            for i, j in zip(*np.nonzero(np.abs(cosine - least) < 1e-9), strict=True):  # too near to trust the order of sums
                x, y = (np.frombuffer(payloads[k], np.float64) for k in (part[i], b[j]))
                hit[i, j] = float(np.dot(x, y)) / (float(np.sqrt(np.dot(x, x))) * float(np.sqrt(np.dot(y, y)))) >= least
            if triangle:
                hit &= np.arange(lo, lo + len(part))[:, None] < np.arange(len(b))[None, :]
            links[part] += hit @ weight[b]
            np.add.at(links, b, weight[part] @ hit)
            for i in np.flatnonzero(hit.any(axis=1)):
                top = root(int(part[i]))
                for j in {root(int(k)) for k in b[hit[i]]}:
                    lo_, hi_ = sorted((top, j), key=lambda k: rep[k])
                    parent[hi_] = lo_
                    top = lo_

    one, two = (np.flatnonzero(home & (side == s)) for s in (0, 1))
    guests_one, guests_two = (np.flatnonzero(~home & (side == s)) for s in (0, 1))
    if same:
        join(one, one, True)
        join(one, guests_one, False)
    else:
        join(one, two, False)
        join(one, guests_two, False)
        join(two, guests_one, False)
    return pa.table({"rep": rep, "links": links, "root": rep[[root(i) for i in range(len(rep))]].astype(np.int64)})


def near_duplicates(vectors: DataFrame, least: float = 0.93, tile: int = 2048, per_cell: int = 2048, max_pivots: int = 4096, pivots_per_label: int = 64) -> DataFrame:
    """(vec_id, n_links, component_id, kept) of each vector; links are cosines of ``least`` or more.

    At most ``max_pivots`` pivots are sent to tasks; labels beyond them are one cell, in tiles."""
    spark = vectors.sparkSession
    every = ex.written(points(vectors.select("vec_id", "embedding", "label")).dropDuplicates(["vec_id", "digest"]))
    unique = ex.written(every.filter("place is not null").groupBy("place", "digest").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("vector").alias("vector")))
    parted = ex.written(cells(unique, pivots_of(unique, per_cell, max_pivots, pivots_per_label), float(np.arccos(least))))
    sizes = parted.groupBy("place", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(tile)).cast("int").alias("chunks"))
    dealt = parted.join(sizes, ["place", "cell"]).withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("chunks")).cast("int"))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select("place", "cell", F.least("chunk", "other").alias("a"), F.greatest("chunk", "other").alias("b"), (F.col("chunk") > F.col("other")).cast("int").alias("side"), "home", "rep", "weight", "vector")
    ex.ready(spark)

    def run(key, table):
        ex.release()
        return tile_links(table, least, key[2].as_py() == key[3].as_py())

    found = ex.written(tiles.groupBy("place", "cell", "a", "b").applyInArrow(run, "rep long, links long, root long"))
    label = components(found.select(F.col("rep").alias("u"), F.col("root").alias("v")).filter("u <> v").distinct())
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    own = unique.select("digest", "rep", "weight").join(links, "rep").join(label.withColumnRenamed("id", "rep"), "rep", "left").select("digest", (F.col("links") + F.col("weight") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = every.select("vec_id", "digest").join(own, "digest", "left").select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.col("vec_id") == F.col("component_id"))
