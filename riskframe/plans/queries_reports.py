"""Report queries: native scanner documents to normalised rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import standards as std
from ..operators import findings as fnd
from ..operators import normalize as nz
from ..operators.detect import engine
from ..operators.ledger import FAMILIES, families_to_ledger, file_packs, public_key_downgrade, repo_packs
from .catalog import query
from .queries_detect import pack_sql
from .testviews import TOOLS

# Items of one tool: documents that are whole, in the shape the report view writes them.
ITEMS = "items AS (SELECT 'repo' || r::VARCHAR AS repo, 's' || k::VARCHAR AS snapshot, k, i, n, TOOLS[(k % 11 + 1)::INT] AS tool FROM report_items WHERE k % 97 NOT IN (5, 6))".replace(
    "TOOLS[", "(['" + "','".join(TOOLS) + "'])[")
SEV3 = "CASE n % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END"


def of(tool):
    return f"WITH {ITEMS}, x AS (SELECT * FROM items WHERE tool = '{tool}') "


KEEP = ["repo", "snapshot", "category", "severity", "key", "file", "line", "title", "fingerprint"]


@query("n01_norm_trivy", of("trivy") + f"""
SELECT repo, snapshot, 'sca' AS category, {SEV3} AS severity, 'CVE-2024-' || (n % 900 + 10000) AS key, 'src/f' || (n % 50) || '.lock' AS file, 0 AS line,
  'pkg' || (n % 40) || ' 1.' || (n % 7) || ' to 2.' || (n % 3) AS title, 'cve|pkg' || (n % 40) || '|CVE-2024-' || (n % 900 + 10000) AS fingerprint FROM x
UNION ALL SELECT repo, snapshot, 'secret', 'MEDIUM', 'generic-api-key', 'src/f' || (n % 50) || '.lock', n % 80 + 1, 'secret: Generic key generic-rule', 'secret|src/f' || (n % 50) || '.lock|generic-api-key|' || (n % 80 + 1) FROM x
UNION ALL SELECT repo, snapshot, 'iac', 'LOW', 'AVD-' || (n % 30), 'src/f' || (n % 50) || '.lock', 0, 'open port', 'iac|src/f' || (n % 50) || '.lock|AVD-' || (n % 30) FROM x""")
def _(t):
    return nz.norm_trivy(t.reports).select(*KEEP)


@query("n02_norm_osv", of("osv-scanner") + """
SELECT repo, snapshot, 'CVE-2023-' || (n % 900 + 10000) AS cve, CASE WHEN n % 11 >= 9 THEN 'CRITICAL' WHEN n % 11 >= 7 THEN 'HIGH' WHEN n % 11 >= 4 THEN 'MEDIUM' WHEN n % 11 > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS severity,
 'go' || (n % 9) || '.sum' AS file, 'pkg' || (n % 40) AS pkg, '0.' || (n % 5) AS installed, 'pip' AS ecosystem, 'CVE-2023-' || (n % 900 + 10000) || ',GHSA-' || (n % 70) AS aliases FROM x""")
def _(t):
    return nz.norm_osv(t.reports).select("repo", "snapshot", "cve", "severity", "file", "pkg", "installed", "ecosystem", F.array_join("advisory_aliases", ",").alias("aliases"))


@query("n03_norm_gitleaks", of("gitleaks") + """
SELECT repo, snapshot, CASE WHEN n % 2 = 0 THEN 'generic-api-key' ELSE 'aws-access-token' END AS key, 'src/f' || (n % 50) || '.js' AS file, n % 80 + 1 AS line, 'c' || (n % 6) AS commit,
 CASE WHEN n % 2 = 0 THEN 'MEDIUM' WHEN n % 5 = 0 THEN 'INFO' ELSE 'HIGH' END AS severity FROM x""")
def _(t):
    return nz.norm_gitleaks(t.reports).select("repo", "snapshot", "key", "file", "line", "commit", "severity")


@query("n04_norm_trufflehog", of("trufflehog") + """
SELECT repo, snapshot, 'det' || (n % 6) AS key, n % 4 = 0 AS verified, CASE WHEN n % 4 = 0 THEN 'CRITICAL' ELSE 'MEDIUM' END AS severity, 'src/f' || (n % 50) || '.js' AS file, n % 80 + 1 AS line FROM x""")
def _(t):
    # A document of another shape is one JSON line without the fields; it is a gap of n12, not a finding.
    return nz.norm_trufflehog(t.reports.filter("NOT raw LIKE '{\"other%' AND NOT raw LIKE '{\"trunc%'")).select("repo", "snapshot", "key", "verified", "severity", "file", "line")


@query("n05_norm_semgrep", of("semgrep") + """
SELECT repo, snapshot, 'rules.js.r' || (n % 20) AS rule_id, 'r' || (n % 20) AS key, CASE n % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'INFO' END AS severity, n % 80 + 1 AS line, 'm' || (n % 300) AS semantic_id, 'msg ' || (n % 20) AS title FROM x""")
def _(t):
    return nz.norm_semgrep(t.reports).select("repo", "snapshot", "rule_id", "key", "severity", "line", "semantic_id", "title")


@query("n06_norm_gosec", of("gosec") + f"""
SELECT repo, snapshot, 'G' || (n % 20 + 100) AS key, {SEV3} AS severity, n % 80 + 1 AS line, 'detail (CWE-' || (n % 90 + 20) || ')' AS title FROM x""")
def _(t):
    return nz.norm_gosec(t.reports).select("repo", "snapshot", "key", "severity", "line", "title")


@query("n07_norm_bandit", of("bandit") + f""", y AS (SELECT *, 'a' || (n % 25) || '.py' AS file, 'B' || (n % 9 + 100) AS rule, substr(sha256('x = eval(y' || (n % 4) || ')'), 1, 20) AS anchor FROM x)
SELECT repo, snapshot, rule AS key, file, n % 80 + 1 AS line, {SEV3} AS severity, 'HIGH' AS native_confidence,
 'bandit:' || anchor || ':' || row_number() OVER (PARTITION BY repo, snapshot, file, rule, anchor ORDER BY i) AS semantic_id FROM y""")
def _(t):
    return nz.norm_bandit(t.reports).select("repo", "snapshot", "key", "file", "line", "severity", "native_confidence", "semantic_id")


@query("n08_norm_brakeman", of("brakeman") + """
SELECT repo, snapshot, 'C' || (n % 9) AS key, CASE n % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS severity, 'SQL: query ' || (n % 20) AS title,
 CASE WHEN n % 2 = 0 THEN 'fp' ELSE 'sast|app/m' || (n % 50) || '.rb|' || (n % 80 + 1) || '|C' || (n % 9) END AS fingerprint FROM x""")
def _(t):
    return nz.norm_brakeman(t.reports).select("repo", "snapshot", "key", "severity", "title", "fingerprint")


@query("n09_norm_checkov", of("checkov") + """
SELECT repo, snapshot, 'CKV_' || (n % 60) AS key, 'MEDIUM' AS severity, n % 80 + 1 AS line, 'aws_s3.b' || (n % 12) AS resource, 'iac|/main' || (n % 9) || '.tf|CKV_' || (n % 60) || '|aws_s3.b' || (n % 12) || '|' || (n % 80 + 1) AS fingerprint FROM x""")
def _(t):
    return nz.norm_checkov(t.reports).select("repo", "snapshot", "key", "severity", "line", "resource", "fingerprint")


SARIF_ROWS = of("sarif") + """, y AS (SELECT *, CASE n % 13 WHEN 0 THEN NULL WHEN 1 THEN 'src/a b.py' ELSE 'src/c.py' END AS file, 'R' || (n % 3) AS rule_id, CASE WHEN n % 10 = 9 THEN 'pass' ELSE 'fail' END AS kind FROM x),
 z AS (SELECT *, CASE WHEN file IS NULL THEN 'path: escapes-root' END AS reason, CASE WHEN file IS NOT NULL THEN rule_id || '|' || file || '|' || (n % 500) END AS idn FROM y),
 w AS (SELECT *, count(*) OVER (PARTITION BY repo, idn) > 1 AS amb FROM z) """


@query("n10_norm_sarif", SARIF_ROWS + """
SELECT repo, snapshot, i AS pos, CASE WHEN reason IS NOT NULL THEN 'rejected' WHEN kind = 'fail' THEN 'finding' ELSE 'observation' END AS outcome, reason, rule_id, kind, file, n % 80 + 1 AS line,
 CASE WHEN kind = 'pass' THEN 'INFO' WHEN n % 3 = 0 THEN 'MEDIUM' WHEN n % 3 = 1 THEN 'HIGH' ELSE 'CRITICAL' END AS severity,
 CASE n % 3 WHEN 0 THEN 'use of a' WHEN 1 THEN 'bad a' ELSE 'no a' END || (n % 7) AS title, CASE WHEN idn IS NOT NULL THEN amb END AS ambiguous FROM w""")
def _(t):
    return nz.norm_sarif(t.reports).select("repo", "snapshot", "pos", "outcome", "reason", "rule_id", "kind", "file", "line", "severity", "title", "ambiguous")


@query("s07_read_sarif", SARIF_ROWS + "SELECT repo, count(*) AS results, count(*) FILTER (reason IS NOT NULL) AS rejected, count(*) FILTER (reason IS NULL AND kind <> 'fail') AS observations FROM w GROUP BY 1")
def _(t):
    s = nz.norm_sarif(t.reports)
    return s.groupBy("repo").agg(F.count("*").alias("results"), F.count_if(F.col("outcome") == "rejected").alias("rejected"), F.count_if(F.col("outcome") == "observation").alias("observations"))


@query("n11_norm_dast", of("dast") + """
SELECT repo, snapshot, (n % 20 + 10000)::VARCHAR AS plugin_id, 'app' || (k % 5) AS application_id, 'anonymous' AS identity, '/api/p' || (n % 30) AS endpoint, 'GET' AS method, 'q' AS parameter, 'https://h.example' AS origin FROM x
UNION ALL SELECT repo, snapshot, (n % 20 + 10000)::VARCHAR, 'app' || (k % 5), 'alice', '/', 'POST', NULL, 'https://h.example' FROM x""")
def _(t):
    return nz.norm_dast(t.reports).select("repo", "snapshot", "plugin_id", "application_id", "identity", "endpoint", "method", "parameter", "origin")


@query("n12_report_validity", f"""
SELECT snapshot, tool, CASE WHEN k % 97 = 5 THEN 'parse_failed' WHEN k % 97 = 6 THEN 'wrong_shape' WHEN tool = 'semgrep' AND k % 5 = 1 THEN 'error' WHEN tool = 'semgrep' AND k % 5 = 0 THEN 'partial' WHEN tool = 'dast' THEN 'wrong_shape' ELSE 'ok' END AS outcome,
 CASE WHEN tool = 'semgrep' AND k % 5 = 0 AND k % 97 NOT IN (5, 6) THEN 1 ELSE 0 END AS rule_errors
FROM (SELECT DISTINCT 's' || k::VARCHAR AS snapshot, k, (['{"','".join(TOOLS)}'])[(k % 11 + 1)::INT] AS tool FROM report_items) WHERE tool <> 'trufflehog'""")
def _(t):
    return nz.report_validity(t.reports).select("snapshot", "tool", "outcome", "rule_errors")


# Documents with diagnostics of each kind, one per order; counts follow the key.
NATIVE = """SELECT 'repo' || (o_custkey % 40) AS repo, CAST(o_orderkey AS VARCHAR(20)) AS snapshot, CASE o_orderkey % 3 WHEN 0 THEN 'checkov' WHEN 1 THEN 'semgrep' ELSE 'bandit' END AS tool,
 CASE o_orderkey % 3 WHEN 0 THEN '[{"check_type":"terraform","results":{"failed_checks":[1,2],"passed_checks":[3],"skipped_checks":[],"parsing_errors":["m' || (o_custkey % 9) || '.tf"]},"summary":{"failed":' || (o_orderkey % 4) || ',"passed":1,"parsing_errors":' || (o_orderkey % 5) || '}}]'
  WHEN 1 THEN '{"results":[],"errors":[{"type":["PartialParsing",[]],"level":"warn","path":"' || CASE WHEN o_custkey % 2 = 0 THEN 'src/' ELSE 'node_modules/' END || (o_custkey % 50) || '.js"},{"type":"' || CASE WHEN o_orderkey % 4 = 0 THEN 'Timeout' ELSE 'Fatal' END || '","rule_id":"r' || (o_orderkey % 7) || '"}]}'
  ELSE '{"results":[],"errors":[],"metrics":{"_totals":{"nosec":' || (o_custkey % 6 - 1) || ',"skipped_tests":' || (o_orderkey % 5) || '}}}' END AS raw FROM orders"""


@query("n12_report_diagnostics", """
WITH o AS (SELECT 'repo' || (o_custkey % 40) AS repo, o_orderkey::VARCHAR AS snapshot, o_orderkey AS k, o_custkey AS c FROM orders), d AS (
SELECT repo, snapshot, 'checkov' AS tool, 'contradiction' AS kind, 'terraform' AS subject, '' AS path, 'failed' AS reason, 1 AS n FROM o WHERE k % 3 = 0 AND k % 4 <> 2
UNION ALL SELECT repo, snapshot, 'checkov', 'file-limitation', 'terraform', 'm' || (c % 9) || '.tf', 'parse-failed', 1 FROM o WHERE k % 3 = 0
UNION ALL SELECT repo, snapshot, 'checkov', 'scanner-error', 'terraform', '', 'not attributed to a file', k % 5 - 1 FROM o WHERE k % 3 = 0 AND k % 5 > 1
UNION ALL SELECT repo, snapshot, 'semgrep', CASE WHEN c % 2 = 0 THEN 'file-limitation' ELSE 'limitation-excluded' END, '', CASE WHEN c % 2 = 0 THEN 'src/' ELSE 'node_modules/' END || (c % 50) || '.js', 'partial-parse', 1 FROM o WHERE k % 3 = 1
UNION ALL SELECT repo, snapshot, 'semgrep', CASE WHEN k % 4 = 0 THEN 'rule-incomplete' ELSE 'scanner-error' END, 'r' || (k % 7), '', CASE WHEN k % 4 = 0 THEN 'Timeout' ELSE 'Fatal' END, 1 FROM o WHERE k % 3 = 1
UNION ALL SELECT repo, snapshot, 'bandit', 'invalid-count', '', '', 'nosec', 1 FROM o WHERE k % 3 = 2 AND c % 6 = 0
UNION ALL SELECT repo, snapshot, 'bandit', 'skipped', '', '', 'tests', k % 5 FROM o WHERE k % 3 = 2 AND k % 5 > 0) SELECT * FROM d""")
def _(t):
    return nz.report_diagnostics(t.sql(NATIVE))


@query("n13_sca_identity", """
SELECT repo, seq, pkg, installed, 'dependency:' || substr(sha256(concat_ws(chr(1), file, CASE ecosystem WHEN 'python-pkg' THEN 'pip' WHEN 'gobinary' THEN 'gomod' ELSE ecosystem END, pkg, installed, cve)), 1, 24) AS semantic_id
FROM scan_findings WHERE category = 'sca'""")
def _(t):
    from ..functions.ident import sca_identity
    return t.scan_findings.filter("category = 'sca'").select("repo", "seq", "pkg", "installed", sca_identity(
        F.col("file"), F.col("ecosystem"), F.col("pkg"), F.col("installed"), F.col("cve")).alias("semantic_id"))


@query("s06_read_scan_reports", f"""
SELECT (['{"','".join(TOOLS)}'])[(k % 11 + 1)::INT] AS tool, count(*) AS documents, count(*) FILTER (k % 97 = 5) AS parse_failed FROM (SELECT DISTINCT k FROM report_items) GROUP BY 1""")
def _(t):
    from ..sources.reports import classify_reports
    return classify_reports(t.reports).groupBy("tool").agg(F.count("*").alias("documents"), F.count_if(F.col("status") == "parse_failed").alias("parse_failed"))


@query("n14_to_ledger", """
SELECT repo, seq, line, CASE category WHEN 'sca' THEN 'cve' ELSE category END AS attack_class, 'static-' || category AS category, CASE WHEN tool = 'bandit' THEN CASE native_confidence WHEN 'high' THEN 'LOW' WHEN 'low' THEN 'LOW' ELSE 'LOW' END
  WHEN category IN ('secret', 'sca') AND severity IN ('CRITICAL', 'HIGH') THEN 'HIGH' ELSE 'MEDIUM' END AS confidence, key AS rule_id FROM scan_findings""")
def _(t):
    from ..operators.ledger import scan_to_ledger
    return scan_to_ledger(t.scan_findings).select("repo", "seq", "line", "attack_class", "category", "confidence", "rule_id")


# The families as a VALUES table, and what single kinds settle.
def _text(v):
    return "'" + v.replace("'", "''") + "'"


FAMILY = "fam AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_text(n)}, {_text(f.category)}, {_text(f.attack_class)}, {_text(f.severity)}, {_text(f.confidence)}, {_text(f.place)}, {'attack_class' in f.settled}, {'confidence' in f.settled})"
    for n, f in FAMILIES.items()) + ") AS t(family, category, d_class, d_severity, d_confidence, place, own_class, own_confidence)), kinds AS (SELECT * FROM (VALUES " + ", ".join(
    f"({_text(n)}, {_text(k)}, {', '.join(_text(v[c]) if c in v else 'NULL' for c in ('attack_class', 'severity', 'confidence'))})" for n, f in FAMILIES.items() for k, v in f.kinds.items()) + ") AS t(family, kind, k_class, k_severity, k_confidence))"
FAMILY_ROWS = """SELECT x.repo, x.family, category, coalesce(k_class, CASE WHEN NOT own_class THEN x.attack_class END, d_class) AS attack_class, coalesce(k_severity, x.severity, d_severity) AS severity,
 coalesce(k_confidence, d_confidence) AS confidence, coalesce(x.path, place) AS location, x.kind AS rule_id FROM x JOIN fam ON fam.family = x.family LEFT JOIN kinds ON kinds.family = x.family AND kinds.kind = x.kind"""


def _family_sql():
    view = "(SELECT repo, path, content FROM code_files UNION ALL SELECT repo, path, content FROM config_files)"
    arms = [f"SELECT repo, {path} AS path, '{n}' AS family, kind, attack_class, severity FROM ({pack_sql(view, p, level)})"
            for level, path, held in (("file", "path", file_packs()), ("repo", "NULL", repo_packs())) for n, p in held.items()]
    return f"WITH {FAMILY}, x AS (" + " UNION ALL ".join(arms) + f") {FAMILY_ROWS}"


@query("n14_family_ledger", _family_sql())
def _(t):
    """The packs of conditions, thirteen families, in two passes over the texts."""
    files = t.code_files.unionByName(t.config_files)
    rows = engine.all_file_findings(files, file_packs()).unionByName(engine.all_repo_findings(files, repo_packs()), allowMissingColumns=True)
    return families_to_ledger(rows).select("repo", "family", "category", "attack_class", "severity", "confidence", "location", "rule_id")


# Token hits among the scanner rows, and files with a public key (some with a private one too).
TOKENS = "SELECT repo, seq, category, severity, CASE WHEN seq % 3 = 0 THEN 'JSON Web Token' ELSE title END AS title, 'app/' || file AS file FROM scan_findings"
TIERS = " UNION ALL ".join(f"SELECT DISTINCT repo, file AS path, CASE WHEN length(repo || file) % 3 = {r} THEN 'service_role' ELSE 'anon' END AS role FROM scan_findings WHERE length(repo) % 2 = 0" for r in (0, 1))


@query("n14_public_keys", f"""
WITH f AS ({TOKENS}), k AS (SELECT repo, path, bool_or(role = 'anon') AND NOT bool_or(role = 'service_role') AS public FROM ({TIERS}) GROUP BY 1, 2),
 j AS (SELECT f.*, EXISTS (SELECT 1 FROM k WHERE k.repo = f.repo AND k.public AND f.file = 'app/' || k.path) AND contains(lower(title), 'web token') AND category IN ('secret', 'sast') AS down FROM f)
SELECT repo, seq, down AS downgraded, CASE WHEN down THEN 'client-exposure' WHEN category = 'sca' THEN 'cve' ELSE category END AS attack_class, CASE WHEN down THEN 'INFO' ELSE severity END AS severity FROM j""")
def _(t):
    rows = t.sql(TOKENS).select("repo", "seq", F.concat(F.lit("static-"), "category").alias("category"), "severity", "title", "file",
                                F.when(F.col("category") == "sca", F.lit("cve")).otherwise(F.col("category")).alias("attack_class"), F.lit("MEDIUM").alias("confidence"))
    return public_key_downgrade(rows, t.sql(TIERS)).select("repo", "seq", "downgraded", "attack_class", "severity")


STD = "(VALUES " + ", ".join(f"('{n}', '{','.join('CWE-' + c for c in cwe)}', '{asvs}')" for n, cwe, asvs, _r in std.STANDARDS) + ") AS s(attack_class, cwe, asvs)"


@query("n15_attach_standards", f"SELECT l.attack_class, s.cwe, s.asvs, count(*) AS n FROM ledger l LEFT JOIN {STD} ON l.attack_class = s.attack_class GROUP BY ALL")
def _(t):
    return std.attach_standards(t.ledger).groupBy("attack_class", F.array_join("cwe", ",").alias("cwe"), "asvs").agg(F.count("*").alias("n"))


@query("p18_safe_import_path", """
WITH u AS (SELECT l_orderkey AS k, l_linenumber AS i, CASE l_partkey % 10 WHEN 0 THEN 'src/a%20b.py' WHEN 1 THEN '../up.py' WHEN 2 THEN '/abs.py' WHEN 3 THEN 'https://h/x' WHEN 4 THEN 'a/%zz' WHEN 5 THEN 'a/./b/../c.py' WHEN 6 THEN 'x?y' WHEN 7 THEN '' WHEN 8 THEN 'a+b.py' ELSE 'a/%252e' END AS uri FROM lineitem)
SELECT uri, count(*) AS n, CASE uri WHEN 'src/a%20b.py' THEN 'src/a b.py' WHEN 'a/./b/../c.py' THEN 'a/c.py' WHEN 'a+b.py' THEN 'a+b.py' END AS path,
 CASE uri WHEN '../up.py' THEN 'escapes-root' WHEN '/abs.py' THEN 'absolute-or-remote' WHEN 'https://h/x' THEN 'absolute-or-remote' WHEN 'a/%zz' THEN 'bad-escape' WHEN 'x?y' THEN 'absolute-or-remote' WHEN '' THEN 'empty' WHEN 'a/%252e' THEN 'ambiguous-escape' END AS error
FROM u GROUP BY 1""")
def _(t):
    u = t.sql("""SELECT CASE l_partkey % 10 WHEN 0 THEN 'src/a%20b.py' WHEN 1 THEN '../up.py' WHEN 2 THEN '/abs.py' WHEN 3 THEN 'https://h/x' WHEN 4 THEN 'a/%zz' WHEN 5 THEN 'a/./b/../c.py'
      WHEN 6 THEN 'x?y' WHEN 7 THEN '' WHEN 8 THEN 'a+b.py' ELSE 'a/%252e' END AS uri FROM lineitem""")
    return u.withColumn("p", nz.safe_import_path(F.col("uri"))).groupBy("uri", F.col("p.path").alias("path"), F.col("p.error").alias("error")).agg(F.count("*").alias("n"))


@query("f12_expand_message", "SELECT p_partkey, p_name || ' of ' || p_brand || ' and ' || p_name AS text FROM part")
def _(t):
    return t.part.select("p_partkey", nz.expand_message(F.lit("{0} of {1} and {0}"), F.array("p_name", "p_brand")).alias("text"))


@query("f13_json_guard", """
SELECT k, CASE WHEN k % 97 = 5 THEN false ELSE true END AS valid FROM (SELECT DISTINCT k, k % 11 AS t FROM report_items) WHERE t <> 3""")
def _(t):
    return t.reports.filter("tool <> 'trufflehog'").select(F.substring("snapshot", 2, 20).cast("bigint").alias("k"), F.try_parse_json("raw").isNotNull().alias("valid"))


@query("f10_output_levels", """
SELECT severity, count(*) AS n, CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN 'error' WHEN severity = 'MEDIUM' THEN 'warning' WHEN severity = 'LOW' THEN 'note' ELSE 'none' END AS level,
 CASE severity WHEN 'CRITICAL' THEN '9.5' WHEN 'HIGH' THEN '8.0' WHEN 'MEDIUM' THEN '5.5' WHEN 'LOW' THEN '3.0' ELSE '0.0' END AS score, count(*) FILTER (file LIKE '%.%' OR file LIKE '%/%') AS pathlike FROM ledger GROUP BY 1""")
def _(t):
    return t.ledger.groupBy("severity", std.sarif_level(F.col("severity")).alias("level"), std.security_severity(F.col("severity")).alias("score")).agg(
        F.count("*").alias("n"), F.count_if(std.is_pathlike(F.col("file"))).alias("pathlike"))


@query("f11_disposition", "SELECT attack_class, count(*) AS n, 'human-required' AS disposition FROM ledger GROUP BY 1")
def _(t):
    return t.ledger.groupBy("attack_class", std.disposition(F.col("attack_class")).alias("disposition")).agg(F.count("*").alias("n"))


@query("normalize_reports", None)
def _(t):
    """Reports to one de-duplicated, confidence-labelled table."""
    from ..operators.core import scratch_dir
    from ..sources.reports import stage_reports
    rows = nz.normalize_all(stage_reports(t.reports, scratch_dir(t.spark, "reports"))).withColumn("seq", F.xxhash64("snapshot", "file", "line", "key")).withColumn("alias", F.get("advisory_aliases", F.lit(0)))
    return fnd.with_instance_id(fnd.with_confidence(fnd.dedupe_findings(rows))).select("repo", "fingerprint", F.array_join("tools", ",").alias("tools"), "severity", "confidence", "copies", "instance_id")
