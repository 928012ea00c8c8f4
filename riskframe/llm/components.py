"""Connected components of a table of links, by stars that Spark joins and groups."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .exchange import ready, release, written


def _local_stars(links: DataFrame) -> DataFrame:
    """Links of one partition as stars around the least id of each of its groups."""
    ready(links.sparkSession)

    def run(batches):
        release()
        parent: dict[int, int] = {}

        def root(x: int) -> int:
            top = x
            while parent.get(top, top) != top:
                top = parent[top]
            while parent.get(x, x) != top:
                parent[x], x = top, parent[x]
            return top

        for batch in batches:
            for u, v in zip(batch.column("u").to_pylist(), batch.column("v").to_pylist(), strict=True):
                parent.setdefault(u, u), parent.setdefault(v, v)
                a, b = root(u), root(v)
                parent[max(a, b)] = min(a, b)
        pairs = [(x, r) for x in list(parent) if (r := root(x)) != x]
        for at in range(0, len(pairs), 10_000):
            u, v = zip(*pairs[at:at + 10_000], strict=True)
            yield pa.record_batch([pa.array(np.array(u, np.int64)), pa.array(np.array(v, np.int64))], names=["u", "v"])

    return links.select("u", "v").mapInArrow(run, "u long, v long")


def _large_star(stars: DataFrame) -> DataFrame:
    both = stars.unionByName(stars.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    return both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))  # the small star drops repeats


def _small_star(stars: DataFrame) -> DataFrame:
    least = stars.groupBy("u").agg(F.min("v").alias("m"))
    moved = stars.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return moved.unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def _open(stars: DataFrame) -> bool:
    """Whether an id hangs on two centres, or on one that hangs on another."""
    ends = stars.select(F.col("u").alias("id"), F.lit(1).alias("up"), F.lit(0).alias("centre")).unionByName(stars.select(F.col("v").alias("id"), F.lit(0).alias("up"), F.lit(1).alias("centre")))
    return bool(ends.groupBy("id").agg(F.sum("up").alias("up"), F.max("centre").alias("centre")).filter("up > 1 or up = 1 and centre = 1").take(1))


def components(links: DataFrame) -> DataFrame:
    """(id, component) of each id in ``links(u, v)``: the least id it can reach. No links give no rows.

    Each partition first reduces its links to stars; then stars of neighbours are joined (large and small
    stars in turn) until every id hangs on one centre, and no centre on another one. Every round is written to the shared folder."""
    links = links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).filter("u <> v")
    stars = written(_local_stars(links).distinct())
    while _open(stars):
        stars = written(_small_star(_large_star(stars)))
    return stars.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component").unionByName(stars.select(F.col("v").alias("id"), F.col("v").alias("component")).distinct())
