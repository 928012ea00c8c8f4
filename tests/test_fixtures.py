"""Small cases with results worked out by hand."""

import datetime

import pytest
from pyspark.sql import functions as F
from riskframe.functions import ident, paths, stats, tiers
from riskframe.operators import calibration as cal
from riskframe.operators import dynamic as dyn
from riskframe.operators import enrich as en
from riskframe.operators import findings as fnd
from riskframe.operators import graph as gr
from riskframe.operators import lifecycle as life
from riskframe.operators import policy as pol
from riskframe.operators import surface as sf
from riskframe.operators.detect import engine, packs
from riskframe.operators.detect import rules as R
from riskframe.sources import files as src


def one(spark, *cols):
    return spark.range(1).select(*cols).first()


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def files(spark, *rows):
    return frame(spark, [("r", p, c) for p, c in rows], "repo string, path string, content string")


@pytest.mark.parametrize("k, n, lo, hi", [(29, 51, 0.433, 0.695), (1, 8, 0.022, 0.471), (2, 2, 0.342, 1.0), (0, 0, 0.0, 1.0)])
def test_wilson(spark, k, n, lo, hi):
    r = one(spark, F.round(stats.wilson_lo(F.lit(k), F.lit(n)), 3).alias("lo"), F.round(stats.wilson_hi(F.lit(k), F.lit(n)), 3).alias("hi"))
    assert (r.lo, r.hi) == (lo, hi)


@pytest.mark.parametrize("value, want", [("da2-xxxxxxxx", True), ("your-api-key", True), ("abc", False), ("q7Zp-91xK", False), ("aaaaaa", True)])
def test_placeholder(spark, value, want):
    assert one(spark, paths.placeholder_value(F.lit(value)).alias("x")).x is want


def test_secret_tier_keeps_provider_prefix(spark):
    v = F.lit("sk_live_" + "a" * 20)
    r = one(spark, tiers.secret_severity(F.lit("src/x.py"), v, F.lit(""), F.lit("stripe"), F.lit("HIGH")).alias("t")).t
    assert r.severity == "HIGH"
    r = one(spark, tiers.secret_severity(F.lit(".env.example"), v, F.lit(""), F.lit("stripe"), F.lit("HIGH")).alias("t")).t
    assert r.severity == "LOW"


@pytest.mark.parametrize("score, band", [("9.0", "CRITICAL"), ("7.0", "HIGH"), ("4.0", "MEDIUM"), ("0.1", "LOW"), (None, "MEDIUM"), ("0", "UNKNOWN")])
def test_cvss(spark, score, band):
    assert one(spark, tiers.cvss_band(F.lit(score).cast("string")).alias("b")).b == band


@pytest.mark.parametrize("pattern, path, want", [
    ("tests/", "contests/x.py", False), ("tests/", "a/tests/x.py", True), ("tests/", "tests", False), ("/src", "a/src/x", False), ("/src", "src/x", True),
    ("*.js", "src/file.js", True), ("**/b.py", "a/b.py", True), ("src/*.py", "src/a/b.py", True), ("a?c", "x/abc/d", True), ("[ab].py", "b.py", True), ("[!ab].py", "b.py", False), ("a.c", "abc", False)])
def test_path_patterns(spark, pattern, path, want):
    assert one(spark, F.rlike(F.lit(path), pol.path_regex(F.lit(pattern))).alias("m")).m is want


def test_policy_states(spark):
    text = "tests/\n# note\nfingerprint:a expires:2025-01-01 # ok\nfingerprint:b expires:2024-01-01 # old\nfingerprint:c # forever\nfingerprint:d expires:2025-13-01 # bad\nfingerprint:e expires:2030-01-01\ncategory:sca\nlogin"
    sup, acks = pol.read_policy(frame(spark, [("r", "target", text)], "repo string, source string, content string"), F.lit("2025-01-01").cast("date"))
    assert {r.pattern: r.kind for r in sup.collect()} == {"tests/": "path", "category:sca": "category", "login": "word"}
    assert {r.fingerprint: r.state for r in acks.collect()} == {"a": "active", "b": "expired", "c": "legacy-no-expiry", "d": "malformed", "e": "missing-reason"}


LEDGER = "repo string, finding_id bigint, attack_class string, category string, location string, file string, title string, severity string, rule_id string, status string, kev boolean"


def ledger(spark, *rows):
    base = dict(repo="r", finding_id=1, attack_class="xss", category="sast", location="a.js:3", file="a.js", title="t", severity="MEDIUM", rule_id="x", status="open", kev=False)
    return frame(spark, [tuple({**base, **r}[c.split()[0]] for c in LEDGER.split(", ")) for r in rows], LEDGER)


def test_fingerprint_ignores_title_line_severity(spark):
    rows = life.annotate(ledger(spark, {}, {"finding_id": 2, "title": "other", "location": "a.js:99", "severity": "LOW"}, {"finding_id": 3, "rule_id": "y"})).orderBy("finding_id").collect()
    assert rows[0].fingerprint == rows[1].fingerprint != rows[2].fingerprint


def diff(spark, cur, old, version=1):
    def prep(df):
        return life.annotate(df).withColumn("place", F.col("file"))
    c = prep(cur)
    b = prep(old).withColumnRenamed("finding_id", "baseline_id").withColumn("identity_version", F.lit(version))
    m = life.baseline_match(c, b)
    return {r.finding_id: r.baseline_state for r in life.baseline_diff(c, b, m).collect()}, [r.baseline_id for r in life.missing_observations(b, m).collect()]


def test_baseline_states(spark):
    cur = ledger(spark, {}, {"finding_id": 2, "rule_id": "b", "severity": "HIGH"}, {"finding_id": 3, "rule_id": "c"}, {"finding_id": 4, "rule_id": "d"})
    old = ledger(spark, {}, {"finding_id": 2, "rule_id": "b"}, {"finding_id": 3, "rule_id": "c", "status": "acknowledged"}, {"finding_id": 9, "rule_id": "gone"})
    states, missing = diff(spark, cur, old, version=2)
    assert states == {1: "unchanged", 2: "changed", 3: "reopened", 4: "new"}
    assert missing == [9]


def test_ambiguous_legacy_rows_stay_new(spark):
    cur = ledger(spark, {"title": "a", "rule_id": "p", "location": "a.js:5"}, {"finding_id": 2, "title": "b", "rule_id": "q", "location": "a.js:6"})
    old = ledger(spark, {"title": "old", "rule_id": None, "location": "a.js:1"})
    states, missing = diff(spark, cur, old)
    assert set(states.values()) == {"new"} and missing == [1]
    states, missing = diff(spark, cur.filter("finding_id = 1"), old)
    assert states == {1: "unchanged"} and missing == []


def test_expired_ack_reopens(spark):
    f = ledger(spark, {}, {"finding_id": 2, "rule_id": "z"}).withColumn("fingerprint", F.concat(F.lit("f"), F.col("finding_id"))).withColumn("fingerprint_aliases", F.array().cast("array<string>"))
    acks = frame(spark, [("r", "target", 1, "f1", "why", datetime.date(2024, 1, 1), "expired"), ("r", "target", 2, "f2", "why", None, "legacy-no-expiry")],
                 "repo string, source string, line_no int, fingerprint string, reason string, expires date, state string")
    out = {r.finding_id: r for r in pol.acknowledge(f.drop("status"), acks).collect()}
    assert out[1].status == "open" and out[1].reopened_reason == "acknowledgement expired" and out[2].status == "acknowledged"


def test_dedupe_two_tools(spark):
    rows = [("r", "s", 1, "trivy", "LOW", "p.lock", 0, "fp", None, "A"), ("r", "s", 2, "osv-scanner", "HIGH", "p.lock", 0, "fp", "2.0", "B")]
    d = fnd.dedupe_findings(frame(spark, rows, "repo string, snapshot string, seq bigint, tool string, severity string, file string, line int, fingerprint string, fixed string, alias string")).first()
    assert (d.tools, d.severity, d.fixed, d.advisory_aliases, d.copies) == (["osv-scanner", "trivy"], "HIGH", "2.0", ["A", "B"], 2)


def test_scan_modes_merge(spark):
    rows = [("r", "s", 1, "gitleaks", "fp", "git"), ("r", "s", 2, "gitleaks", "fp", "git"), ("r", "s", 3, "gitleaks", "fp", "dir"), ("r", "s", 4, "gitleaks", "g", "dir")]
    out = fnd.merge_scan_modes(frame(spark, rows, "repo string, snapshot string, seq bigint, tool string, fingerprint string, scan_mode string"))
    assert sorted((r.seq, r.scan_mode) for r in out.collect()) == [(1, "git+dir"), (2, "git"), (4, "dir")]


def test_calibration_backoff_and_brier(spark):
    cells = frame(spark, [("class_label", "xss|HIGH", 4, 4, 1.0, 0.5, 1.0), ("label", "HIGH", 51, 29, 0.569, 0.433, 0.695)], "grp string, key string, n bigint, k bigint, p double, ci_lo double, ci_hi double")
    f = frame(spark, [("xss", "HIGH", None), ("xss", "LOW", None)], "attack_class string, confidence string, is_real boolean")
    out = {r.confidence: (r.basis, r.p) for r in cal.calibrate(f, cells).collect()}
    assert out == {"HIGH": ("label", 0.569), "LOW": ("prior", 0.25)}
    assert cal.brier(f, cells).first().brier is None


def test_truth_conflict_is_unknown(spark):
    f = frame(spark, [("r", 1, "xss", "src/a.js:3"), ("r", 2, "sqli", "src/a.js")], "repo string, finding_id int, attack_class string, location string")
    t = frame(spark, [("r", "xss", "*", True), ("r", "xss", "A.JS", False), ("r", "sqli", "src/", True)], "app string, attack_class string, location_contains string, is_real boolean")
    assert {r.finding_id: r.is_real for r in cal.truth_match(f, t).collect()} == {1: None, 2: True}


def test_grading(spark):
    f = frame(spark, [("r", "t", "x", "a.py", 1), ("r", "t", "x", "a.py", 1), ("r", "t", "x", "a.py", 2)], "repo string, tool string, rule string, file string, line int")
    labels = frame(spark, [("r", "a.py", 1, "xss", True), ("r", "a.py", 2, "xss", True), ("r", "a.py", 2, "xss", False)], "repo string, file string, line int, attack_class string, is_real boolean")
    g = cal.grade_reports(f, labels, frame(spark, [("t", "x", "xss")], "tool string, rule string, attack_class string"), frame(spark, [("r", "t", True)], "repo string, tool string, completed boolean")).first()
    assert (g.tp, g.fp, g.unknown, g.label_hits, g.precision) == (2, 0, 1, 1, 1.0)


def test_blast_radius(spark):
    nodes = frame(spark, [("r", n, f"src/{n}.py", n, "c") for n in "abc"], "repo string, id string, source_file string, label string, community string")
    edges = frame(spark, [("r", "a", "b", "imports"), ("r", "b", "c", "imports"), ("r", "c", "a", "contains")], "repo string, source string, target string, relation string")
    f = frame(spark, [("r", "src/c.py:4"), ("r", "src/a.py"), ("r", "pkg/src/b.py")], "repo string, location string")
    out = {r.place: (r.blast_radius, r["sample"], r.truncated) for r in gr.blast_radius(f, nodes, edges).collect()}
    assert out == {"src/c.py": (2, ["b", "a"], False), "src/a.py": (0, [], False), "pkg/src/b.py": (1, ["a"], False)}


def test_ambiguous_basename_matches_nothing(spark):
    nodes = frame(spark, [("r", "1", "x/m.py"), ("r", "2", "y/m.py"), ("r", "3", "z/only.py")], "repo string, id string, source_file string")
    f = frame(spark, [("r", "q/m.py"), ("r", "q/only.py")], "repo string, location string")
    assert [(r.place, r.source_file) for r in gr.suffix_match(f, nodes).collect()] == [("q/only.py", "z/only.py")]


def test_hunks(spark):
    f = frame(spark, [("r", 1, "a.js:12", "a.js"), ("r", 2, "a.js:13", "a.js"), ("r", 3, "b.js:12", "b.js"), ("r", 4, "/api/x", "a.js")], "repo string, finding_id int, location string, file string")
    h = frame(spark, [("r", "a.js", 10, 12)], "repo string, path string, start_line int, end_line int")
    assert {r.finding_id: r.diff_state for r in life.in_hunk(f, h).collect()} == {1: "in-changed-hunk", 2: "in-changed-file", 3: "untouched", 4: "in-changed-file"}


def test_risk_points(spark):
    routes = frame(spark, [("r", 1, None, "POST", "/a/{id}", "s.js", ["id"])], "repo string, route_id int, service_id string, method string, path string, code_path string, params array<string>")
    guards = frame(spark, [("r", 9, None, "POST", "/a/{id}", "s.js", False, True, False)], "repo string, guard_id int, service_id string, method string, path string, code_path string, guarded boolean, analyzed boolean, public_hint boolean")
    sinks = frame(spark, [("r", "s.js", "sqli")], "repo string, path string, attack_class string")
    e = sf.attack_surface(routes, guards, sinks, sf.target_buckets(routes)).first()
    assert (e.auth, e.risk) == ("UNGUARDED", 11)


def test_one_guard_two_services(spark):
    routes = frame(spark, [("r", i, s, "GET", "/a", "", []) for i, s in ((1, "s1"), (2, "s2"))], "repo string, route_id int, service_id string, method string, path string, code_path string, params array<string>")
    guards = frame(spark, [("r", 9, None, "GET", "/a", "", True, True, False)], "repo string, guard_id int, service_id string, method string, path string, code_path string, guarded boolean, analyzed boolean, public_hint boolean")
    none = frame(spark, [], "repo string, path string, attack_class string")
    assert {e.auth for e in sf.attack_surface(routes, guards, none, sf.target_buckets(routes)).collect()} == {"unknown"}


def test_contract(spark):
    spec = frame(spark, [("r", "GET", "/a/{id}")], "repo string, method string, path string")
    code = frame(spark, [("r", "GET", "/a/:id"), ("r", "POST", "/a/:id"), ("r", "GET", "/b")], "repo string, method string, path string")
    assert sorted((r.method, r.path, r.kind) for r in sf.contract_diff(spec, code).collect()) == [("GET", "/b", "shadow-path"), ("POST", "/a/{}", "undocumented-method")]


def test_routes(spark):
    f = files(spark, ("src/r.js", "app.get('/api/users/:id', h);\nrouter.post('/api/groups/:groupId/items', h)"), ("app.py", "@app.route('/api/users/<id>', methods=['GET', 'PUT'])\ndef f(): pass"), ("web/app/(x)/items/[id]/route.ts", "export async function DELETE(r) {}"))
    got = {(r.method, r.path) for r in sf.extract_routes(f).collect()}
    assert got == {("GET", "/api/users/{id}"), ("POST", "/api/groups/{groupId}/items"), ("PUT", "/api/users/{id}"), ("DELETE", "/items/{id}")}


def test_scope(spark):
    f = files(spark, ("src/a.py", ""), ("src2/b.py", ""))
    only = frame(spark, [("r", "src"), ("r", "nope")], "repo string, entry string")
    inside, matched, missed = src.scope_files(f, only)
    assert [r.path for r in inside.collect()] == ["src/a.py"] and [r.entry for r in missed.collect()] == ["nope"] and [r.entry for r in matched.collect()] == ["src"]


def test_password_drift(spark):
    f = files(spark, ("a.js", "password: z.string().min(8).regex(/[A-Z]/).regex(/[a-z]/).regex(/[0-9]/)"), ("b.js", "password: z.string().min(6)"))
    assert {r.path: r.drift for r in packs.password_policy(f).collect()} == {"a.js": False, "b.js": True}


def test_rls(spark):
    a = files(spark, ("1.sql", "CREATE TABLE notes (id int, user_id uuid);\nCREATE TABLE IF NOT EXISTS public.docs (owner_id uuid);"))
    r = packs.missing_rls(a).first()
    assert (r.tables, r.owner_tables) == (2, 2)
    assert packs.missing_rls(a.unionByName(files(spark, ("2.sql", "CREATE POLICY p ON notes;")))).count() == 0


def test_xss_pair(spark):
    bad, good = ("src/a.js", "document.write('<p>' + location.hash)"), ("src/b.js", "document.write(DOMPurify.sanitize('<p>' + location.hash))")
    occ = engine.scan_rules(engine.with_roles(files(spark, bad, good)), R.SINKS).filter("rule_id = 'xss'")
    assert [r.path for r in occ.collect()] == ["src/a.js"]


def test_lines_and_ordinals(spark):
    text = "x\n\neval(req.body.a)\ny\neval(req.body.a)\neval(\n  req.body.b)"
    rows = engine.scan_rules(engine.with_roles(files(spark, ("src/a.js", text))), [r for r in R.SINKS if r.rule_id == "eval-injection"]).orderBy("line").collect()
    assert [(r.line, r.ordinal) for r in rows] == [(3, 0), (5, 1), (6, 0)]


def test_mask_keeps_strings_and_lines(spark):
    text = "a = 'http://x'; // note\n/* one\ntwo */ b = `// no`\n<!-- c -->\nd"
    code = engine.mask_comments(files(spark, ("a.js", text))).first().code
    assert len(code) == len(text) and code.count("\n") == text.count("\n")
    assert "http://x" in code and "`// no`" in code and "note" not in code and "one" not in code and "<!--" not in code
    py = engine.mask_comments(files(spark, ("a.py", "x = '#no'  # yes\ny"))).first().code
    assert py == "x = '#no'       \ny"


@pytest.mark.parametrize("quote", ['"', "'", "`"])
@pytest.mark.parametrize("escapes", [401, 30_000])
def test_strings_of_many_escapes_hide_no_code(spark, quote, escapes):
    literal = quote + "\\n" * escapes + " http://x /* " + quote
    js = f"const t = {literal}; eval(req.body.code); app.get('/live', h); /* gone */ // dead\n"
    py = f"t = {literal.replace('//', '# ')}; eval(request.args['q'])  # dead\n"
    f = files(spark, ("src/a.js", js), *([("src/b.py", py)] if quote != "`" else []))
    code = {r.path: r.code for r in engine.mask_comments(f).collect()}
    assert code["src/a.js"] == js.replace("/* gone */ // dead", " " * 18)
    assert quote == "`" or code["src/b.py"] == py.replace("# dead", " " * 6)
    assert packs.sinks(f).filter("rule_id = 'eval-injection' and path = 'src/a.js'").count() == 1
    assert [r.path for r in sf.extract_routes(f).collect()] == ["/live"]


def test_redirect_and_backdoor_pairs(spark):
    f = engine.with_roles(files(spark, ("src/a.js", "axios.get(url, o)"), ("src/b.js", "axios.get(url, {maxRedirects: 0})\naxios.get(url, o)"), ("src/c.js", "if (token.startsWith('dev-')) ok()")))
    assert {(r.path, r.kind) for r in engine.file_findings(f, R.REDIRECT_LEADS).collect()} == {("src/a.js", "redirect-unguarded")}
    assert {(r.path, r.severity) for r in engine.file_findings(f, R.BACKDOORS).collect()} == {("src/c.js", "CRITICAL")}


def test_reachability_and_fail_open(spark):
    obs = frame(spark, [("r", "t", 200, 10, False)] * 3 + [("r", "u", None, None, False)], "repo string, target string, status int, bytes int, soft_deny boolean")
    s = {r.target: r for r in dyn.reachability_verdicts(obs)[1].collect()}
    assert s["t"].fail_open_suspected and not s["t"].trustworthy and s["u"].unreachable and not s["u"].trustworthy


def test_dast_other_build_is_unjudged(spark):
    c = "application_id string, build_id string, identity string, endpoint string, method string, parameter string"
    f = frame(spark, [("xss", "a", "b1", "anonymous", "/p", "GET", "q"), ("xss", "a", "b2", "anonymous", "/p", "GET", "q")], "attack_class string, " + c)
    al = frame(spark, [("1", None, "a", "b1", "anonymous", "/p", "GET", "q", None)], f"plugin_id string, attack_class string, {c}, auth_verified boolean")
    ch = frame(spark, [], f"plugin_id string, attack_class string, {c}, auth_verified boolean, completed boolean, coverage_complete boolean, outcome string")
    out = {r.build_id: r.verdict for r in dyn.dast_labels(f, al, ch, frame(spark, [("1", "xss")], "plugin_id string, attack_class string")).collect()}
    assert out == {"b1": "confirmed", "b2": "unjudged"}


def test_reassess(spark):
    d = datetime.date
    f = frame(spark, [("r", 1, "CVE-2024-0001", 0.4, False, "acknowledged", True, d(2025, 1, 1), d(2025, 1, 1)), ("r", 2, "CVE-2024-0001", 0.4, False, "acknowledged", True, d(2026, 1, 1), d(2025, 1, 1))],
              "repo string, finding_id int, cve string, epss double, kev boolean, status string, has_intel boolean, intel_epss_date date, intel_kev_date date")
    e = frame(spark, [("CVE-2024-0001", 0.6, 0.9)], "cve string, epss double, percentile double")
    out, events = en.reassess(f, e, frame(spark, [], "cve string"), F.lit(d(2025, 6, 1)), F.lit(d(2025, 6, 1)))
    rows = {r.finding_id: r for r in out.collect()}
    assert rows[1].reopened and rows[1].status == "open" and rows[2].blocked == "older-snapshot" and rows[2].status == "acknowledged"
    assert {r.kind for r in events.filter("finding_id = 1").collect()} == {"epss-changed", "reopened"} and events.filter("finding_id = 2").count() == 0


def test_cve_of(spark):
    assert one(spark, ident.cve_of(F.lit(None).cast("string"), F.lit("x"), F.lit("lib cve-2024-12345 bad")).alias("c")).c == "CVE-2024-12345"


def test_comments_are_not_code(spark):
    f = frame(spark, [("r", "src/a.js", '// app.get("/dead", h)\n/* app.get("/gone", h) */\napp.get("/live", h)\n// eval(req.body.code)\nconst u = "http://x";\neval(req.body.code)\n'),
                      ("r", "src/b.py", '# @app.get("/dead")\n@app.get("/b")\ndef b(): pass\n')], "repo string, path string, content string")
    assert {r.path for r in sf.extract_routes(f).collect()} == {"/live", "/b"}
    assert [r.line for r in packs.sinks(f).filter("rule_id = 'eval-injection'").collect()] == [6]


def test_bucket_names_are_whole(spark):
    names = ["securityId", "url", "curl", "redirect_uri", "file", "valid", "user_id"]
    routes = frame(spark, [("r", "GET", f"/{n}", [n]) for n in names], "repo string, method string, path string, params array<string>")
    got = {(r.path[1:], r.bucket) for r in sf.target_buckets(routes).collect()}
    assert got == {("securityId", "idor"), ("url", "ssrf"), ("redirect_uri", "open_redirect"), ("file", "traversal"), ("user_id", "idor")}


def test_events_keep_their_methods(spark):
    text = ("F:\n  Type: AWS::Serverless::Function\n  Events:\n    A:\n      Type: Api\n      Properties:\n        Path: /a\n    B:\n      Type: HttpApi\n"
            "      Properties:\n        Method: post\n        Path: /b\n")
    f = frame(spark, [("r", "t.yaml", text)], "repo string, path string, content string")
    assert {(r.method, r.path) for r in sf.serverless_routes(f).collect()} == {("ANY", "/a"), ("POST", "/b")}
