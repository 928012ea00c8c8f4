"""Dependency graph: path matching and blast radius."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths
from ..functions.ident import clean_path
from .core import cut_lineage, top_k

# Relations that mean "depends on", and how many dependents a report names.
DEPENDENCY_RELATIONS = ["calls", "indirect_call", "references", "imports", "imports_from", "re_exports", "inherits", "extends", "implements", "uses", "mixes_in", "embeds"]
SAMPLE = 8


def suffix_match(findings: DataFrame, nodes: DataFrame) -> DataFrame:
    """(repo, place, source_file): exact path, else the one file that shares a whole-component suffix, else the one
    file with the same base name. Works on distinct places and files; ambiguity is counted, not listed."""
    places = findings.select("repo", clean_path(F.col("location")).alias("place")).filter("place <> ''").distinct()
    files = nodes.select("repo", clean_path(F.col("source_file")).alias("source_file")).filter("source_file <> ''").distinct()
    exact = places.join(files.withColumn("place", F.col("source_file")), ["repo", "place"]).select("repo", "place", "source_file")
    rest = places.join(exact, ["repo", "place"], "left_anti")
    # A file that ends with the place, or a place that ends with the file: each side exploded once.
    by_file = files.select("repo", "source_file", F.explode(paths.suffixes(F.col("source_file"))).alias("place")).filter("place <> source_file")
    a = by_file.groupBy("repo", "place").agg(F.count(F.lit(1)).alias("n"), F.min("source_file").alias("source_file"))
    hit_a = rest.join(a, ["repo", "place"]).select("repo", "place", "n", "source_file")
    by_place = rest.select("repo", "place", F.explode(paths.suffixes(F.col("place"))).alias("source_file")).filter("place <> source_file")
    hit_b = by_place.join(files, ["repo", "source_file"]).groupBy("repo", "place").agg(F.count(F.lit(1)).alias("n"), F.min("source_file").alias("source_file"))
    both = hit_a.unionByName(hit_b).groupBy("repo", "place").agg(F.sum("n").alias("n"), F.min("source_file").alias("source_file"))
    suffix = both.filter("n = 1").select("repo", "place", "source_file")
    rest2 = rest.join(suffix, ["repo", "place"], "left_anti")
    base = files.groupBy("repo", paths.basename(F.col("source_file")).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.min("source_file").alias("source_file")).filter("n = 1")
    by_base = rest2.withColumn("_b", paths.basename(F.col("place"))).join(base, ["repo", "_b"]).select("repo", "place", "source_file")
    return exact.unionByName(suffix).unionByName(by_base)


def _numbered(seeds: DataFrame) -> DataFrame:
    """(repo, seed, word, bit): seeds numbered so that up to 64 of one repository share a word. Ranges split a repository with many seeds."""
    ordered = seeds.select("repo", "seed").distinct().repartitionByRange("repo", "seed").sortWithinPartitions("repo", "seed")
    number = ordered.withColumn("_n", F.monotonically_increasing_id())
    return cut_lineage(number.select("repo", "seed", F.shiftright("_n", 6).alias("word"), (F.col("_n") % 64).cast("int").alias("bit")))


def dependents(seeds: DataFrame, edges: DataFrame, relations=None) -> tuple[DataFrame, DataFrame]:
    """((repo, seed, word, bit), visited(repo, id, word, bits, depth)) by walking dependency edges backwards from ``seeds(repo, seed, id)``.

    A row holds 64 seeds: the bits of those that first reach the node at this depth. Edges are walked for all of them at
    once, so there are no rows for pairs of a seed and a node. One frontier a round, until no round finds a new bit; cycles end by themselves."""
    rel = cut_lineage(edges.filter(F.col("relation").isin(*(relations or DEPENDENCY_RELATIONS))).select("repo", F.col("target").alias("id"), F.col("source").alias("nxt")).distinct())
    names = _numbered(seeds)
    key = ["repo", "id", "word"]
    start = seeds.select("repo", "seed", "id").distinct().join(names, ["repo", "seed"])
    fresh = cut_lineage(start.groupBy(*key).agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")))
    seen, visited = fresh, fresh.withColumn("depth", F.lit(0))
    for depth in itertools.count(1):
        reached = fresh.join(rel, ["repo", "id"]).groupBy("repo", F.col("nxt").alias("id"), "word").agg(F.bit_or("bits").alias("bits"))
        old = seen.groupBy(*key).agg(F.bit_or("bits").alias("old"))
        fresh = cut_lineage(reached.join(old, key, "left").select(*key, F.expr("bits & ~coalesce(old, 0L)").alias("bits")).filter("bits <> 0"))
        if fresh.isEmpty():
            return names, visited
        seen, visited = seen.unionByName(fresh), visited.unionByName(fresh.withColumn("depth", F.lit(depth)))
        if depth % 8 == 0:
            seen, visited = cut_lineage(seen.groupBy(*key).agg(F.bit_or("bits").alias("bits"))), cut_lineage(visited)


def reached_counts(names: DataFrame, visited: DataFrame) -> DataFrame:
    """(repo, seed, depth, n): nodes that a seed first reaches at a depth. Bits are counted in each task before the shuffle."""
    bits = F.array(*[F.sum(F.shiftrightunsigned("bits", b).bitwiseAND(F.lit(1))) for b in range(64)])
    counted = visited.groupBy("repo", "word", "depth").agg(bits.alias("_c")).select("repo", "word", "depth", F.posexplode("_c").alias("bit", "n")).filter("n > 0")
    return counted.join(names, ["repo", "word", "bit"]).select("repo", "seed", "depth", "n")


def nearest_nodes(names: DataFrame, visited: DataFrame, counts: DataFrame, k: int) -> DataFrame:
    """(repo, seed, id, depth): the nodes of each seed down to the depth at which it has ``k`` besides its own; only these become pairs."""
    w = W.partitionBy("repo", "seed").orderBy("depth").rowsBetween(W.unboundedPreceding, -1)
    wanted = counts.filter("depth > 0").withColumn("_before", F.coalesce(F.sum("n").over(w), F.lit(0))).filter(F.col("_before") < k)
    mask = wanted.join(names, ["repo", "seed"]).groupBy("repo", "word", "depth").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("mask"))
    left = visited.join(mask, ["repo", "word", "depth"]).withColumn("bits", F.expr("bits & mask")).filter("bits <> 0")
    pairs = left.select("repo", "word", "id", "depth", F.explode(F.expr("filter(sequence(0, 63), b -> (shiftrightunsigned(bits, b) & 1L) = 1L)")).alias("bit"))
    return pairs.join(names, ["repo", "word", "bit"]).select("repo", "seed", "id", "depth")


def blast_radius(findings: DataFrame, nodes: DataFrame, edges: DataFrame, cap: int | None = None) -> DataFrame:
    """(repo, place, blast_radius, sample, truncated) per matched place.

    Radius counts all dependents without the seeds themselves, of whatever number; with ``cap`` it stops there (the seeds' own nodes
    counted in) and says ``truncated``. The sample is the nearest eight by label."""
    match = suffix_match(findings, nodes)
    n = nodes.withColumn("source_file", clean_path(F.col("source_file")))
    seeds = match.join(n, ["repo", "source_file"]).select("repo", F.col("source_file").alias("seed"), "id")
    names, visited = dependents(seeds, edges)
    counts = cut_lineage(reached_counts(names, visited))
    total = counts.groupBy("repo", "seed").agg(F.sum("n").alias("_all"), F.sum(F.when(F.col("depth") == 0, F.col("n")).otherwise(0)).alias("_own"))
    near = top_k(nearest_nodes(names, visited, counts, SAMPLE).join(nodes.select("repo", "id", F.coalesce("label", "source_file", "id").alias("label")), ["repo", "id"], "left"),
                 ["repo", "seed"], [F.col("depth"), F.coalesce("label", "id"), F.col("id")], SAMPLE)
    sample = near.groupBy("repo", "seed").agg(F.array_sort(F.collect_list(F.struct("position", F.coalesce("label", "id").alias("label")))).alias("s"))
    out = total.join(sample, ["repo", "seed"], "left")
    shown, cut = (F.col("_all"), F.lit(False)) if cap is None else (F.least(F.col("_all"), F.lit(cap)), F.col("_all") >= cap)
    return (match.withColumnRenamed("source_file", "seed").join(out, ["repo", "seed"])
            .select("repo", "place", (shown - F.col("_own")).alias("blast_radius"), F.coalesce(F.transform("s", lambda x: x["label"]), F.array().cast("array<string>")).alias("sample"), cut.alias("truncated")))
