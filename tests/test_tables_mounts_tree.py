"""Folds of table statements, chains of mounts, rule dictionaries, listing of trees, packs: against brute force."""

import hashlib
import json
import os
import random

from riskframe import ext
from riskframe.operators import coverage as cov
from riskframe.operators import normalize as nz
from riskframe.operators import surface as sf
from riskframe.operators.detect import packs
from riskframe.sources.tree import read_source_tree

FILES = "repo string, path string, content string"


def brute_states(files):
    """The plain fold, statement after statement."""
    state = {}
    for _path, kind, table, policy, owned in files:
        t = state.setdefault(table, {"exists": False, "owned": False, "rls": False, "policies": set()})
        if kind == "drop":
            t.update(exists=False, owned=False, rls=False, policies=set())
        elif kind == "create":
            t.update(exists=True, owned=t["owned"] or owned)
        elif kind == "column":
            t["owned"] = t["owned"] or owned
        elif kind in ("enable", "disable"):
            t["rls"] = kind == "enable"
        elif kind == "policy":
            t["policies"].add(policy)
        else:
            t["policies"].discard(policy)
    return {n: (t["exists"], t["owned"], t["rls"], len(t["policies"])) for n, t in state.items()}


SQL = {"create": "CREATE TABLE {q}{t}{q} (id int{own})", "drop": "drop table if exists public.{t} cascade", "column": "ALTER TABLE {t}\n ADD COLUMN x{own2} int", "enable": "ALTER TABLE ONLY {t} ENABLE ROW LEVEL SECURITY, FORCE ROW LEVEL SECURITY",
       "disable": "alter table {t} disable row level security", "policy": "CREATE POLICY \"{p}\" ON {t} USING (note = 'DROP TABLE {t}; ')", "unpolicy": "DROP POLICY {p} ON public.{t} /* ; CREATE POLICY {p} ON {t}; */"}


def test_statements_fold_to_the_last_state(spark):
    rng = random.Random(5)
    rows, plain = [], []
    for i in range(60):
        body = []
        for j in range(rng.randint(1, 4)):
            kind, t, p, owned = rng.choice(list(SQL)), f"t{rng.randint(0, 3)}", f"p{rng.randint(0, 2)}", rng.random() < .5
            body.append(SQL[kind].format(t=t, p=p, q=rng.choice(['"', ""]), own=", user_id int" if owned else "", own2=" int, ADD tenant_id" if owned else ""))
            plain.append((f"{i:03d}", kind, f"public.{t}", p, owned and kind in ("create", "column")))
        rows.append(("r", f"{i:03d}.sql", ";\n".join(body) + ";"))
    got = {r.name: (r["exists"], r["owned"], r["rls"], r["policies"]) for r in packs.table_states(spark.createDataFrame(rows, FILES)).collect()}
    assert got == brute_states(plain)


def test_policy_dropped_later_is_missing(spark):
    def missing(*texts):
        return packs.missing_rls(spark.createDataFrame([("r", f"{i}.sql", x) for i, x in enumerate(texts)], FILES)).count()
    make, hold = "CREATE TABLE notes (user_id int);", "CREATE POLICY p ON notes;"
    assert (missing(make), missing(make, hold), missing(make, hold, "DROP POLICY p ON notes;"), missing(make, hold, "DROP TABLE notes;", make)) == (1, 0, 1, 1)
    assert missing(make, "ALTER TABLE notes" + " " * 400 + "ENABLE ROW LEVEL SECURITY;") == 0
    assert missing(make, "DO $$ BEGIN CREATE POLICY p ON notes USING (true); EXCEPTION WHEN duplicate_object THEN NULL; END $$;") == 0
    assert missing(make, None, "") == 1


def brute_mounts(roots, mounts, leaves):
    out, stack = set(), [(n, "", (n,)) for n in roots]
    while stack:
        node, prefix, way = stack.pop()
        out |= {(m, prefix + p, "resolved", len(way) - 1) for n, m, p in leaves if n == node}
        for parent, add, child in mounts:
            if parent == node:
                if child is None or child in way:
                    out.add(("ANY", prefix + add, "candidate", len(way) - 1))
                else:
                    stack.append((child, prefix + add, way + (child,)))
    return out


def mounted(spark, roots, mounts, leaves, **more):
    got = sf.compose_mounts(spark.createDataFrame([("r", n) for n in roots], "repo string, node string"), spark.createDataFrame([("r", *m) for m in mounts], "repo string, parent string, prefix string, child string"),
                            spark.createDataFrame([("r", *x) for x in leaves], "repo string, node string, method string, path string"), **more)
    return {(r.method, r.path, r.status, r.depth) for r in got.collect()}


def test_chain_of_forty_mounts(spark, monkeypatch):
    cuts, cut = [], sf.cut_lineage
    monkeypatch.setattr(sf, "cut_lineage", lambda df: cuts.append(1) or cut(df))
    mounts, leaves = [(f"n{i}", f"/{i}", f"n{i + 1}") for i in range(40)], [("n40", "GET", "/end"), ("n7", "GET", "/seven")]
    want = {("GET", "".join(f"/{i}" for i in range(40)) + "/end", "resolved", 40), ("GET", "/0/1/2/3/4/5/6/seven", "resolved", 7)}
    assert mounted(spark, ["n0"], mounts, leaves) == want
    assert len(cuts) <= 2 + 3 * 7
    short = mounted(spark, ["n0"], mounts, leaves, max_depth=12)
    assert short == {("GET", "/0/1/2/3/4/5/6/seven", "resolved", 7), ("ANY", "".join(f"/{i}" for i in range(13)), "candidate", 12)}


def test_mounts_with_cycles(spark):
    rng = random.Random(3)
    nodes = [f"n{i}" for i in range(9)]
    mounts = [(rng.choice(nodes), f"/e{i}", rng.choice([*nodes, None])) for i in range(14)]
    leaves = [(n, "GET", f"/{n}") for n in nodes]
    assert mounted(spark, ["n0", "n1"], mounts, leaves) == brute_mounts(["n0", "n1"], mounts, leaves)


def test_rules_by_index_and_id(spark):
    rules = [{"id": f"R{i}", "messageStrings": {"m": {"text": f"text {i}"}}} for i in range(300)] + [{"id": "R5"}]
    place = [{"physicalLocation": {"artifactLocation": {"uri": "a.py"}, "region": {"startLine": 1}}}]
    results = [{"ruleId": f"R{i}", "message": {"id": "m"}, "locations": place} for i in range(300)] + [{"ruleIndex": 7, "message": {"id": "m"}, "locations": place}, {"ruleIndex": 999, "message": {"text": "x"}}, {"ruleIndex": 3, "ruleId": "R4", "message": {"text": "x"}}, {"ruleIndex": -1, "message": {"text": "x"}}]
    raw = json.dumps({"runs": [{"tool": {"driver": {"name": "d", "rules": rules}}, "results": results}, {"tool": {"driver": {"name": "e"}}, "results": [{"ruleId": "R1", "message": {"text": "y"}}]}]})
    reports = spark.createDataFrame([("r", "s", "sarif", raw)], "repo string, snapshot string, tool string, raw string")
    got = {(r.run, r.pos): (r.rule_id, r.title, r.reason) for r in nz.norm_sarif(reports).collect()}
    assert len(got) == 305 and all(got[0, i] == (f"R{i}", f"text {i}", None) for i in range(300) if i != 5)
    assert got[0, 5][2] == "duplicate rule definitions" and got[0, 300] == ("R7", "text 7", None) and got[0, 301][2] == got[0, 303][2] == "rule index is out of range" and got[0, 302][2] == "rule id and index disagree"
    assert got[1, 0] == ("R1", "y", None)
    assert nz.norm_sarif(reports.unionByName(reports)).count() == 610


def test_trees_are_listed_in_rounds(spark, tmp_path):
    want = {}
    for i, path in enumerate(["a.txt", ".env", ".github/workflows/x.yml", "p/q/r/s/t/deep.py", "p/__init__.py", "p/empty.txt", "p/odd name é.txt"]):
        full = tmp_path / "app" / path
        full.parent.mkdir(parents=True, exist_ok=True)
        raw = b"" if "empty" in path else b"x" * i + b"\xff\n"
        full.write_bytes(raw)
        want[path] = (hashlib.sha256(raw).hexdigest(), len(raw), "ok")
    (tmp_path / "app" / "big.bin").write_bytes(b"z" * 200)
    want["big.bin"] = (None, 200, "oversized")
    os.symlink(tmp_path / "app" / "a.txt", tmp_path / "app" / "link.txt")
    os.symlink(tmp_path / "app", tmp_path / "app" / "p" / "loop")
    (tmp_path / "none").mkdir()
    got = read_source_tree(spark, [f"{tmp_path}/app", f"{tmp_path}/none/", f"{tmp_path}/absent"], max_bytes=100)
    rows = {(r.repo, r.path): (r.sha256, r.n_bytes, r.read_status) for r in got.collect()}
    assert rows == {("app", p): v for p, v in want.items()} | {("absent", "."): (None, None, "unreadable")}


def test_packs_run_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def counted(frames):
        for f in frames:
            runs.add(len(f))
            yield f[["repo"]]
    files = spark.createDataFrame([("r", "a", "b"), ("q", "a", "b")], FILES)
    ext.register_pack("counted", lambda f: f.mapInPandas(counted, "repo string"))
    ext.register_pack("late", lambda f: f.selectExpr("raise_error('stop') AS repo"))
    ext.register_pack("none", lambda f: f.filter("false").select("repo"))
    out, rows = ext.run_packs(files, ["counted", "late", "none"])
    assert {r.pack: (r.outcome, r.findings) for r in rows.collect()} == {"counted": ("completed", 2), "late": ("error", 0), "none": ("completed", 0)}
    assert sorted(r.repo for r in out["counted"].collect()) == ["q", "r"] and out["none"].count() == 0 and runs.value == 2


def test_secret_default_on_a_later_line(spark):
    f = spark.createDataFrame([("r", "a.js", "const s = process.env.JWT_SECRET\n          || 'change-me-now';")], FILES)
    assert [(r["var"], r.literal) for r in packs.secret_defaults(f).collect()] == [("JWT_SECRET", "change-me-now")]


def evidence(spark, *rows):
    names = [c.split()[0] for c in cov.EVIDENCE.split(", ")]
    return spark.createDataFrame([tuple({"repo": "r", "item": "i", **r}.get(n) for n in names) for r in rows], cov.EVIDENCE)


CLEAN = [{"area": "claim", "outcome": "completed"}, {"area": "gap", "execution": False}, {"area": "read", "amount": 0}, {"area": "bytes", "amount": 5, "allowed": 5}, {"area": "check", "outcome": "completed"},
         {"area": "scanner", "selected": False}, {"area": "scanner", "item": "j", "selected": True, "ran": True, "installed": True, "runnable": True, "outcome": "completed"}, {"area": "import", "outcome": "completed", "ran": True},
         {"area": "route", "amount": 3}, {"area": "profile", "outcome": "manual"}]


def test_each_constraint_has_a_violating_and_a_clean_row(spark):
    assert cov.evidence_errors(evidence(spark, *CLEAN)).count() == 0
    done = {"outcome": "completed", "ran": True, "installed": True, "runnable": True, "selected": True}
    broken = {"not-complete": {"area": "claim"}, "gap-unclassified": {"area": "gap"}, "execution-gap": {"area": "gap", "execution": True}, "read-loss": {"area": "read", "amount": 2}, "selection-truncated": {"area": "read", "amount": 0, "truncated": 1},
              "bytes-invalid": {"area": "bytes", "amount": -1}, "limit-invalid": {"area": "bytes", "allowed": -1}, "bytes-over-limit": {"area": "bytes", "item": "k", "amount": 6, "allowed": 5}, "check-incomplete": {"area": "check", "outcome": "failed"},
              "check-reported-errors": {"area": "check", "outcome": "completed", "errors": 1}, "selection-unknown": {"area": "scanner"}, "scanner-incomplete": {"area": "scanner", **done, "installed": None}, "scanner-reported-errors": {"area": "scanner", **done, "errors": 1},
              "import-incomplete": {"area": "import", "outcome": "completed"}, "import-gap": {"area": "import", **done, "execution": True}, "route-errors": {"area": "route", "errors": 1}, "route-diagnostics-truncated": {"area": "route", "truncated": 1},
              "route-gap": {"area": "route", "execution": True}, "route-count-invalid": {"area": "route", "amount": -1}, "route-limit-invalid": {"area": "route", "allowed": -1}, "profile-check-failed": {"area": "profile", "outcome": "crashed"}, "area-unknown": {"area": None}}
    assert set(broken) == {n for n, _a, _c in cov._constraints()} | {"area-unknown"}
    rows = [{**c, "repo": n} for n in broken for c in CLEAN] + [{**row, "repo": n} for n, row in broken.items()]
    got = {}
    for r in cov.evidence_errors(evidence(spark, *rows)).collect():
        got.setdefault(r.repo, set()).add(r.error)
    assert got == {n: {n, "claims-disagree" if n == "not-complete" else "claimed-complete-despite"} | ({"reads-disagree"} if n == "bytes-invalid" else set()) for n in broken}
    assert [r.error for r in cov.evidence_errors(evidence(spark, CLEAN[1])).collect()] == ["claim-missing"]


def test_routes_of_any_receiver_and_handler_methods(spark):
    f = spark.createDataFrame([("r", "a.js", "users.get('/x', list); cache.get('k'); $v1.delete(`/y/:id`, drop)"), ("r", "s.py", "class H(BaseHTTPRequestHandler):\n  def do_GET(self):\n    if self.path == '/ok': pass\n  def do_POST(self): pass"),
                               ("r", "t.py", "class H(BaseHTTPRequestHandler):\n  def do_PUT(self): pass"), ("r", "u.js", "http.createServer(app)")], FILES)
    assert {(r.method, r.path) for r in sf.extract_routes(f).filter("code_path = 'a.js'").collect()} == {("GET", "/x"), ("DELETE", "/y/{id}")}
    assert {(r.code_path, r.path, tuple(r.methods_seen)) for r in sf.raw_server_routes(f).collect()} == {("s.py", "/ok", ("GET", "POST")), ("t.py", "/*", ("PUT",))}


def test_html_sinks_with_values(spark):
    lines = {"el.innerHTML = userHtml;": 1, "el.innerHTML = '<b>x</b>';": 0, "el.innerHTML === other;": 0, "$('#a').html(reply.text)": 1, "$('#a').html()": 0, "$('#a').html('<i>')": 0, "{@html note}": 1, "document.write(x)": 1, "document.write('x')": 0,
             "el.innerHTML = DOMPurify.sanitize(userHtml);": 0, "<p dangerouslySetInnerHTML={{ __html: note }} />": 1, "<p dangerouslySetInnerHTML={{ __html: '' }} />": 0, "el.insertAdjacentHTML('beforeend', row)": 1}
    f = spark.createDataFrame([("r", f"src/{i}.js", x) for i, x in enumerate(lines)], FILES)
    got = {r.path for r in packs.sinks(f).filter("attack_class = 'xss'").collect()}
    assert got == {f"src/{i}.js" for i, n in enumerate(lines.values()) if n}
