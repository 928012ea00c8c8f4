"""Joins by grams against all pairs."""

import fnmatch
import random
import re

import pytest
from pyspark.sql import functions as F
from riskframe.operators import calibration, policy
from riskframe.operators.textjoin import contains_join, longest_literal


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_contains_against_pairs(spark, keys):
    rnd = random.Random(4)
    word = lambda n: "".join(rnd.choice("abé/.") for _ in range(n))
    texts = [(rnd.choice("xy"), word(rnd.randrange(30))) for _ in range(120)] + [("x", None), ("x", "")]
    needles = [(rnd.choice("xy"), word(rnd.randrange(7))) for _ in range(60)] + [("x", None), ("x", ""), ("y", "a" * 40)]
    t, n = spark.createDataFrame(texts, "k string, t string"), spark.createDataFrame(needles, "k string, n string")
    got = {tuple(r) for r in contains_join(t, n, keys, "t", "n").collect()}
    assert got == {(*([k] if keys else []), a, b) for k, a in texts for j, b in needles if a is not None and b is not None and b in a and (k == j or not keys)}
    assert contains_join(t, n.limit(0), keys, "t", "n").count() == 0 and contains_join(t.limit(0), n, keys, "t", "n").count() == 0


def test_no_product_in_the_plans(spark):
    t = spark.createDataFrame([("r", "c", "a/b", "f", "t")], "repo string, category string, location string, file string, title string")
    p = spark.createDataFrame([("r", "src/*", "path")], "repo string, pattern string, kind string")
    plan = policy.suppress(t, p)._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan
    plan = policy.matched_paths(t, p, [], "location")._jdf.queryExecution().executedPlan().toString()
    assert "Cartesian" not in plan and "NestedLoop" not in plan


def test_every_match_holds_the_literal(spark):
    rnd = random.Random(6)
    globs = ["".join(rnd.choice(["a", "b", "/", "*", "?", "[ab]", "[!a]", "**/", "x.py"]) for _ in range(rnd.randrange(1, 7))) for _ in range(150)] + ["*", "[", "a[b", "/", "**/"]
    paths = ["/".join("".join(rnd.choice("abx.") for _ in range(rnd.randrange(1, 4))) for _ in range(rnd.randrange(1, 5))) for _ in range(150)] + ["a/x.py", "x.py"]
    g = spark.createDataFrame([(x,) for x in set(globs)], "pattern string").withColumn("rx", policy.path_regex(F.col("pattern")))
    valid = [(r.pattern, r.rx) for r in g.collect() if r.rx is not None and _compiles(r.rx)]
    g = spark.createDataFrame([(x,) for x, _ in valid], "pattern string")
    p = spark.createDataFrame([(x,) for x in set(paths)], "low string")
    got = {tuple(r) for r in policy.matched_paths(p, g, [], "low").collect()}
    assert got == {(x, pat) for x in set(paths) for pat, rx in valid if re.search(rx, x)} and got
    lits = {r.pattern: r.lit for r in g.withColumn("lit", longest_literal(F.col("pattern"))).collect()}
    assert all(lit in x for pat, lit in lits.items() for x in paths if "[" not in pat and fnmatch.fnmatchcase(x, pat))


def _compiles(rx):
    try:
        re.compile(rx)
    except re.error:
        return False
    return "[]" not in rx and "[^]" not in rx


def test_suppress_with_many_patterns_of_one_repository(spark):
    """A third of all findings and 10,000 patterns in one repository: the product would be 100 million tests."""
    n = 10_000
    f = spark.range(n).select(F.lit("hot").alias("repo"), F.lit("sast").alias("category"), F.concat(F.lit("src/dir"), "id", F.lit("/file.py:1")).alias("location"), F.concat(F.lit("src/dir"), "id", F.lit("/file.py")).alias("file"), F.lit("t").alias("title"))
    p = spark.range(0, 2 * n, 2).select(F.lit("hot").alias("repo"), F.concat(F.lit("/src/dir"), "id", F.lit("/")).alias("pattern"), F.lit("path").alias("kind"))
    got = policy.suppress(f, p)
    assert got.filter("suppressed").count() == n // 2 and got.filter("suppressed and int(regexp_extract(file, 'dir([0-9]+)', 1)) % 2 = 1").count() == 0


def test_truth_with_many_entries_of_one_class(spark):
    n = 10_000
    f = spark.range(n).select(F.col("id").alias("finding_id"), F.lit("hot").alias("repo"), F.lit("xss").alias("attack_class"), F.concat(F.lit("SRC/dir"), "id", F.lit("/f.py")).alias("location"))
    t = spark.range(n).select(F.lit("hot").alias("app"), F.lit("xss").alias("attack_class"), F.concat(F.lit("dir"), "id", F.lit("/")).alias("location_contains"), (F.col("id") % 3 == 0).alias("is_real"))
    got = calibration.truth_match(f, t).groupBy("is_real").count().collect()
    assert {r.is_real: r["count"] for r in got} == {True: 3334, False: 6666}


def test_grams_that_no_needle_asks_for_stay_where_the_text_is(spark, monkeypatch):
    from riskframe.operators import textjoin

    t = spark.createDataFrame([("r", f"src/file{i}/login.js") for i in range(50)], "k string, t string")
    n = spark.createDataFrame([("r", "login"), ("r", "file7/")], "k string, n string")
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = contains_join(t, n, ["k"], "t", "n")
        assert "SortMergeJoin [k" not in out._jdf.queryExecution().executedPlan().toString().split("Generate")[0]
        few = {tuple(r) for r in out.collect()}
        monkeypatch.setattr(textjoin, "FEW", 0)  # many needles: joined by a shuffle, with the same pairs
        assert few == {tuple(r) for r in contains_join(t, n, ["k"], "t", "n").collect()} and len(few) == 51
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)
