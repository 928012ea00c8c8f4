"""Helpers that must stay exact when one key holds most rows, against brute force."""

import random
from collections import defaultdict

from pyspark.sql import functions as F
from riskframe.operators.core import first_row, multiset_digest, number_within, top_k, unique_match
from riskframe.operators.detect import packs
from riskframe.operators.detect.packs import taint_events
from riskframe.sources.files import classify_read


def test_unique_match_against_pairs(spark):
    rnd = random.Random(7)
    opt = [None, "", "a", "b"]
    left = [(i, rnd.choice(["k", "k", "m"]), rnd.choice(opt), rnd.choice(opt)) for i in range(60)] + [(100 + i, f"u{i}", rnd.choice(opt), rnd.choice(opt)) for i in range(40)]
    right = [(i, rnd.choice(["k", "k", "m"]), rnd.choice(opt), rnd.choice(opt)) for i in range(60)] + [(100 + i, f"u{rnd.randrange(40)}", rnd.choice(opt), rnd.choice(opt)) for i in range(40)]
    ok = lambda x, y: not x or not y or x == y
    lc, rc = defaultdict(list), defaultdict(list)
    for a in left:
        for b in right:
            if a[1] == b[1] and ok(a[2], b[2]) and ok(a[3], b[3]):
                lc[a[0]].append(b[0])
                rc[b[0]].append(a[0])
    want = {a[0]: (lc[a[0]][0] if len(lc[a[0]]) == 1 and len(rc[lc[a[0]][0]]) == 1 else None, len(lc[a[0]])) for a in left}
    l = spark.createDataFrame(left, "lid int, key string, s string, c string")
    r = spark.createDataFrame(right, "rid int, key string, s string, c string")
    got = {x.lid: (x.match_id, x.candidate_count) for x in unique_match(l, r, ["key"], "lid", "rid", compatible=["s", "c"]).collect()}
    assert got == want


def test_unique_match_hot_key_emits_no_pairs(spark):
    """Twenty thousand rows of one key on both sides would be 400 million pairs."""
    l = spark.range(20000).select(F.col("id").alias("lid"), F.lit("hot").alias("key"), F.lit(None).cast("string").alias("s"))
    r = spark.range(20000).select(F.col("id").alias("rid"), F.lit("hot").alias("key"), F.lit("x").alias("s"))
    out = unique_match(l, r, ["key"], "lid", "rid", compatible=["s"])
    assert out.filter("match_id IS NOT NULL").count() == 0 and out.filter("candidate_count = 20000").count() == 20000


def test_number_within_hot_group(spark):
    df = spark.range(5000).select(F.when(F.col("id") % 3 == 0, F.lit("hot")).otherwise((F.col("id") % 50).cast("string")).alias("g"), (F.col("id") * 7).alias("o"))
    got = {(r.g, r.o): r.n for r in number_within(df, ["g"], "o", "n", width=512).collect()}
    groups = defaultdict(list)
    for g, o in got:
        groups[g].append(o)
    assert all(got[(g, o)] == i + 1 for g, os in groups.items() for i, o in enumerate(sorted(os)))


def test_digest_is_order_free_and_sensitive(spark):
    df = spark.range(200).select(F.col("id").cast("string").alias("p"), F.md5(F.col("id").cast("string")).alias("h"))
    a = df.agg(multiset_digest(F.col("p"), F.col("h")).alias("d")).first().d
    b = df.repartition(7).orderBy(F.desc("p")).agg(multiset_digest(F.col("p"), F.col("h")).alias("d")).first().d
    c = df.filter("p <> '7'").agg(multiset_digest(F.col("p"), F.col("h")).alias("d")).first().d
    assert a == b != c


def test_first_row_and_top_k(spark):
    df = spark.range(100).select((F.col("id") % 3).alias("g"), F.col("id").alias("v"))
    assert sorted((r.g, r.v) for r in first_row(df, ["g"], ["v"]).collect()) == [(0, 0), (1, 1), (2, 2)]
    assert top_k(df, ["g"], [F.desc("v")], 2).count() == 6
    plan = top_k(df, ["g"], [F.desc("v")], 2)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_byte_budget(spark):
    rows = [("r", f"f{i}", 100 if i % 9 else 5000) for i in range(300)]
    out = classify_read(spark.createDataFrame(rows, "repo string, path string, n_bytes bigint"), 1000, 10_000).groupBy("read_status").count().collect()
    got = {r.read_status: r["count"] for r in out}
    assert got["oversized"] == 34 and got["ok"] == 100 and got["byte_budget_exceeded"] == 166


def test_budget_plan_has_no_repo_sized_window(spark):
    df = spark.createDataFrame([("r", "f", 1)], "repo string, path string, n_bytes bigint")
    plan = classify_read(df)._jdf.queryExecution().optimizedPlan().toString()
    assert "windowspecdefinition(repo" in plan and "_b" in plan


def brute_flows(events):
    """Taint by walking every file and scope in order, with a set of live definitions per variable."""
    out = set()
    for (path, scope), evs in events.items():
        live, tainted = defaultdict(set), set()
        for e in sorted(evs, key=lambda e: (e.pos, e.kind == "sink")):
            here = [f for f in sorted(evs, key=lambda f: f.pos) if f.pos < e.pos and f.kind == "assign"]
            live = defaultdict(set)
            for d in here:
                did = (d.pos, d.var)
                live[d.var] = live[d.var] | {did} if d.conditional else {did}
            reads = set(e.refs) | ({e.var} if e.kind == "assign" and e.conditional else set())
            hot = e.source or any(d in tainted for v in reads for d in live[v])
            if hot and e.kind == "assign":
                tainted.add((e.pos, e.var))
            if hot and e.kind == "sink":
                out.add((path, scope, e.pos, e.var))
    return out


def test_taint_against_walk(spark):
    rnd = random.Random(3)
    names = ["a", "b", "c", "d"]
    rows = []
    for i in range(60):
        lines = []
        for _ in range(14):
            k = rnd.random()
            v, w = rnd.choice(names), rnd.choice(names)
            lines.append("function f() {" if k < 0.06 else f"const {v} = req.query.q;" if k < 0.2 else f"{v} = {w} + 'req.query.x';" if k < 0.5 else f"{v} += {w};" if k < 0.6 else f"        {v} = {w};" if k < 0.7 else f"{v} = 'safe';" if k < 0.8 else f"exec({v});")
        rows.append(("r", f"f{i}.js", "\n".join(lines)))
    f = spark.createDataFrame(rows, "repo string, path string, content string")
    by = defaultdict(list)
    for e in taint_events(f).collect():
        by[(e.path, e.scope)].append(e)
    got = {(r.path, r.scope, r.pos, r.sink) for r in packs.taint_flows(f).collect()}
    assert got == brute_flows(by) and got


def test_every_call_of_a_line_is_a_sink(spark):
    lines = ["query(a); exec(req.body.x)", "x = req.query.q;", "fetch(b); exec(x); query(c); exec(c); exec(x + 1)", "eval(" + "a + " * 200 + "req.body.y)", "redirect(query(x))", "exec(); query(c)"]
    f = spark.createDataFrame([("r", "a.js", "\n".join(lines)), ("r", "b.js", ";".join(["query(a)"] * 500) + ";exec(req.body.x)")], "repo string, path string, content string")
    got = sorted((r.path, r.pos, r.sink, r.hops) for r in packs.taint_flows(f).collect())
    assert got == [("a.js", 0, "exec", 0), ("a.js", 2, "exec", 1), ("a.js", 2, "exec", 1), ("a.js", 3, "eval", 0), ("a.js", 4, "query", 1), ("a.js", 4, "redirect", 1), ("b.js", 0, "exec", 0)]
    assert taint_events(f).filter("path = 'b.js' and kind = 'sink'").count() == 501


def test_nothing_is_cut_off(spark):
    """Many functions in a template, long paths, long arguments, routers of any name."""
    from riskframe.operators import surface
    template = "AWS::Serverless::Function\n" + "".join(f"F{i}:\n  Type: AWS::Serverless::Function\n  Path: /p{i}\n  Method: get\n" for i in range(10_050))
    long = "/" + "a" * 250
    js = f"usersRouter.get('{long}', h)\nadminApp.options('/o', h)\n"
    py = f"@users.get('{long}')\ndef f(): pass\n@things.head('/h')\n"
    files = spark.createDataFrame([("r", "template.yaml", template), ("r", "a.js", js), ("r", "b.py", py)], "repo string, path string, content string")
    assert surface.serverless_routes(files).filter("technology = 'serverless'").count() == 10_050
    found = {(r.code_path, r.method, r.path) for r in surface.extract_routes(files).collect()}
    assert {("a.js", "GET", long), ("a.js", "OPTIONS", "/o"), ("b.py", "GET", long), ("b.py", "HEAD", "/h")} <= found


def test_long_arguments_are_seen(spark):
    from riskframe.operators.detect import packs
    code = "const r = eval(" + "a, " * 150 + "req.body.x)\n"
    files = spark.createDataFrame([("r", "server.js", "const app = express()\napp.listen(3)\n" + code)], "repo string, path string, content string")
    assert packs.sinks(files).filter("rule_id like '%eval%'").count() >= 1


def test_unmatched_rows_do_not_meet_in_one_task(spark):
    """Rows without a match have no match_id; as a join key it would send them all to one task."""
    l = spark.range(4000).select(F.col("id").alias("lid"), F.concat(F.lit("k"), F.col("id") % 1000).alias("key"))
    r = spark.range(4000, 4400).select(F.col("id").alias("rid"), F.concat(F.lit("k"), F.col("id") % 1000).alias("key"), F.lit("yes").alias("verdict"))
    off = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in off}
    try:
        for k, v in off.items():
            spark.conf.set(k, v)
        for both in (True, False):
            sizes = unique_match(l, r, ["key"], "lid", "rid", payload=["verdict"], both_ways=both).groupBy(F.spark_partition_id()).count().collect()
            assert sum(x["count"] for x in sizes) == 4000 and max(x["count"] for x in sizes) < 1500
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_line_windows_shuffle_each_line_once(spark, monkeypatch):
    from riskframe.sources import files as src

    rows = [("r", "a", i, f"t{i}" if i % 7 else None) for i in range(1, 60)] + [("r", "b", 3, "x"), ("r", "b", 3, "w"), ("r", "b", 5, "y"), (None, "b", 1, "n"), ("r", None, 1, "n"), ("r", "b", None, "n")]
    lines = spark.createDataFrame(rows, "repo string, path string, line int, text string").withColumn("more", F.lit(1))
    plan = src.line_window(lines)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1 and "Join" not in plan
    named = [x for x in rows if None not in x[:3]]
    want = sorted((p, n, "\n".join(s for _, s in sorted(((m, s) for _, q, m, s in named if q == p and n - 2 <= m <= n + 1), key=lambda x: (x[0], x[1] or "")) if s is not None)) for _, p, n, _ in named)
    for size in (1, 2, 5, 1 << 14):
        monkeypatch.setattr(src, "WINDOW_LINES", size)
        out = src.line_window(lines)
        assert out.columns == ["repo", "path", "line", "text", "more", "window"]
        assert sorted((x.path, x.line, x.window) for x in out.collect()) == want


def _events(rows):
    return [("r", f, 0, n, n, kind, var, refs, source, cond) for f, n, kind, var, refs, source, cond in rows]


EVENTS = "repo string, path string, scope int, at int, pos int, kind string, var string, refs array<string>, source boolean, conditional boolean"


def test_taint_of_long_chains_needs_no_round_of_jobs_for_each_hop(spark):
    chain = [("f", 0, "assign", "v0", [], True, False)] + [("f", i, "assign", f"v{i}", [f"v{i - 1}"], False, False) for i in range(1, 120)] + [("f", 120, "sink", "exec", ["v119"], False, False)]
    sc = spark.sparkContext
    sc.setJobGroup("long-chain", "")
    got = [(x.pos, x.sink, x.hops) for x in packs.taint_over(spark.createDataFrame(_events(chain), EVENTS)).collect()]
    jobs = len(sc.statusTracker().getJobIdsForGroup("long-chain"))
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert got == [(120, "exec", 120)] and jobs < 30


def test_taint_in_one_task_and_by_joins_agree(spark, monkeypatch):
    rnd = random.Random(8)
    rows = []
    for f in ("a", "b", "c", "d"):
        for n in range(rnd.choice([40, 90])):
            for _ in range(rnd.choice([1, 1, 1, 2])):
                kind = rnd.choice(["assign", "assign", "sink"])
                rows.append((f, n, kind, rnd.choice(["x", "y", "z", None]) if kind == "assign" else "exec", rnd.choice([None, ["x"], ["y", "q"], ["z", None], []]), rnd.choice([None, False, False, False, True]), rnd.choice([True, False, False])))
    rows = list({(f, n, v): (f, n, k, v, r, s, c) for f, n, k, v, r, s, c in rows}.values())
    rows += [rows[0], rows[5]]  # twice the same
    ev = spark.createDataFrame([*_events(rows), (None, "a", 0, 1, 1, "sink", "exec", ["x"], True, False)], EVENTS)
    key = lambda df: sorted(map(str, df.collect()))
    walked = key(packs.taint_over(ev))
    monkeypatch.setattr(packs, "FILE_EVENTS", 0)
    assert walked == key(packs.taint_over(ev)) and len(walked) > 20
    monkeypatch.setattr(packs, "FILE_EVENTS", 60)
    assert walked == key(packs.taint_over(ev))
