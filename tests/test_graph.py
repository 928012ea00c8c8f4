"""Blast radius against a walk of every seed."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from riskframe.operators import graph as gr

NODES = "repo string, id string, label string, source_file string"
EDGES = "repo string, source string, target string, relation string"


def brute(nodes, edges, files):
    back = defaultdict(set)
    for repo, s, t, rel in edges:
        if rel in gr.DEPENDENCY_RELATIONS:
            back[repo, t].add(s)
    label = {(r, i): lab or f or i for r, i, lab, f in nodes}
    out = {}
    for repo, file in files:
        own = {i for r, i, _, f in nodes if r == repo and f == file}
        if not own:
            continue
        seen, front, near = set(own), own, []
        while front:
            front = {s for t in front for s in back[repo, t]} - seen
            seen |= front
            near += sorted(label.get((repo, i), i) for i in front)
        out[repo, file] = (len(seen) - len(own), near[:8])
    return out


def test_radius_against_walks(spark):
    rnd = random.Random(2)
    nodes = [(f"r{k % 3}", f"n{k}", f"l{k:03}", f"src/f{k // 2}.py") for k in range(240)]
    by_repo = {r: [x[1] for x in nodes if x[0] == r] for r in ("r0", "r1", "r2")}
    edges = [(r, rnd.choice(ids), rnd.choice(ids), rnd.choice(["calls", "imports", "documents"])) for r, ids in by_repo.items() for _ in range(130)]
    edges += [("r0", by_repo["r0"][k + 1], by_repo["r0"][k], "calls") for k in range(30)] + [("r0", by_repo["r0"][0], by_repo["r0"][30], "calls")]  # a cycle of 31
    files = sorted({(x[0], x[3]) for x in nodes})
    f = spark.createDataFrame(files, "repo string, location string")
    got = {(r.repo, r.place): (r.blast_radius, r["sample"]) for r in gr.blast_radius(f, spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).collect()}
    assert got == brute(nodes, edges, files) and max(v for v, _ in got.values()) >= 31


def test_a_hub_with_many_dependents_is_counted_whole(spark):
    n = 100_000
    nodes = spark.range(n + 1).select(F.lit("r").alias("repo"), F.concat(F.lit("n"), "id").alias("id"), F.format_string("l%06d", "id").alias("label"), F.concat(F.lit("f"), F.col("id"), F.lit(".py")).alias("source_file"))
    edges = spark.range(1, n + 1).select(F.lit("r").alias("repo"), F.concat(F.lit("n"), "id").alias("source"), F.lit("n0").alias("target"), F.lit("imports").alias("relation"))
    f = spark.createDataFrame([("r", "f0.py"), ("r", "f7.py")], "repo string, location string")
    got = {r.place: (r.blast_radius, r["sample"], r.truncated) for r in gr.blast_radius(f, nodes, edges).collect()}
    assert got == {"f0.py": (n, [f"l{k:06}" for k in range(1, 9)], False), "f7.py": (0, [], False)}
    capped = {r.place: (r.blast_radius, r.truncated) for r in gr.blast_radius(f, nodes, edges, cap=20_000).collect()}
    assert capped == {"f0.py": (19_999, True), "f7.py": (0, False)}


def test_many_seeds_of_one_repository(spark):
    n = 150  # a chain: node k is reached by all that come after it
    nodes = [("r", f"n{k}", None, f"f{k}.py") for k in range(n)]
    edges = [("r", f"n{k + 1}", f"n{k // 2 * 2}", "calls") for k in range(n - 1)] + [("r", f"n{k + 2}", f"n{k}", "uses") for k in range(0, n - 2, 25)]
    files = [("r", f"f{k}.py") for k in range(n)]
    got = {(r.repo, r.place): (r.blast_radius, r["sample"]) for r in gr.blast_radius(spark.createDataFrame(files, "repo string, location string"), spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)).collect()}
    assert got == brute(nodes, edges, files)
