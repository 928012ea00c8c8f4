"""Ledger queries: merging, confidence, lifecycle, policy, clusters, calibration."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import ident, stats, tiers
from ..functions.paths import PLACEHOLDER_WORDS, placeholder_value
from ..operators import calibration as cal
from ..operators import findings as fnd
from ..operators import lifecycle as life
from ..operators import policy as pol
from ..operators.core import number_within
from .catalog import query

SEV = "CASE {c} WHEN 'CRITICAL' THEN 4 WHEN 'HIGH' THEN 3 WHEN 'MEDIUM' THEN 2 WHEN 'LOW' THEN 1 WHEN 'UNKNOWN' THEN 1 ELSE 0 END"
CONF = "CASE {c} WHEN 'HIGH' THEN 2 WHEN 'MEDIUM' THEN 1 WHEN 'LOW' THEN 0 ELSE -1 END"


def sev(c):
    return SEV.format(c=c)


def conf(c):
    return CONF.format(c=c)


TEST_RX = r"(^|/)(tests?|spec|specs|e2e|fixtures?|mocks?)/|(^|/)test_[^/]*\.py$"


# Scalar functions -----------------------------------------------------------------------------

W_LO = "CASE WHEN n <= 0 THEN 0 ELSE greatest(0, ((k/n + 3.841458820694124/(2*n)) - 1.959963984540054*sqrt((k/n)*(1-k/n)/n + 3.841458820694124/(4*n*n)))/(1+3.841458820694124/n)) END"
W_HI = "CASE WHEN n <= 0 THEN 1 ELSE least(1, ((k/n + 3.841458820694124/(2*n)) + 1.959963984540054*sqrt((k/n)*(1-k/n)/n + 3.841458820694124/(4*n*n)))/(1+3.841458820694124/n)) END"


@query("f01_wilson_interval", f"""
WITH c AS (SELECT l_partkey, count(*)::DOUBLE AS n, (count(*) FILTER (l_returnflag = 'R'))::DOUBLE AS k FROM lineitem GROUP BY 1)
SELECT l_partkey, round({W_LO}, 6) AS lo, round({W_HI}, 6) AS hi FROM c""")
def _(t):
    c = t.lineitem.groupBy("l_partkey").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("k"))
    return c.select("l_partkey", F.round(stats.wilson_lo(F.col("k"), F.col("n")), 6).alias("lo"),
                    F.round(stats.wilson_hi(F.col("k"), F.col("n")), 6).alias("hi"))


IDENT_JSON = """'{"attack_class":"' || attack_class || '","category":"' || category || '"'
 || CASE WHEN attack_class = 'cve' AND regexp_matches(title, 'CVE-[0-9]{4}-[0-9]+') THEN ',"cve":"' || regexp_extract(title, 'CVE-[0-9]{4}-[0-9]+') || '"' ELSE '' END
 || ',"file":"' || file || '","location":"' || file || '"'
 || CASE WHEN rule_id IS NULL THEN '' ELSE ',"rule_id":"' || rule_id || '"' END
 || CASE WHEN service_id IS NULL THEN '' ELSE ',"service":"' || service_id || '"' END
 || CASE WHEN semantic_id IS NULL THEN '' ELSE ',"sink":"' || semantic_id || '"' END || '}'"""


@query("f02_fingerprint", f"""
SELECT finding_id, substr(sha256({IDENT_JSON}), 1, 16) AS fingerprint,
  substr(sha256(attack_class || '|' || location || '|' || title), 1, 16) AS legacy FROM ledger""")
def _(t):
    df = life.annotate(t.ledger)
    return df.select("finding_id", "fingerprint", F.col("fingerprint_aliases")[0].alias("legacy"))


@query("f03_ids", """
SELECT repo, seq, l AS line, 'place1_' || substr(sha256(category || '|' || file || '|' || key || '|' || l::VARCHAR || '|' || coalesce(cve, pkg, '')), 1, 16) AS instance_id,
  'wc1_rul_' || substr(sha256('rule|' || category || ':' || key), 1, 12) AS cluster_id
FROM (SELECT *, line AS l FROM scan_findings)""")
def _(t):
    df = fnd.with_instance_id(t.scan_findings)
    return df.select("repo", "seq", "line", "instance_id",
                     ident.cluster_id(F.lit("rule"), F.concat_ws(":", "category", "key")).alias("cluster_id"))


@query("f04_strip_line_suffix", """
SELECT finding_id, file AS path, list_aggregate(regexp_extract_all(title || ' (' || location || ')', '\\(([^()\\s]+)\\)', 1), 'string_agg', ',') AS embedded FROM ledger""")
def _(t):
    df = t.ledger
    return df.select("finding_id", ident.strip_line_suffix(F.col("location")).alias("path"),
                     F.array_join(ident.embedded_paths(F.concat("title", F.lit(" ("), "location", F.lit(")"))), ",").alias("embedded"))


@query("f05_cve_of", """
SELECT finding_id, nullif(regexp_extract(title, 'CVE-[0-9]{4}-[0-9]{4,}'), '') AS cve FROM ledger""")
def _(t):
    return t.ledger.select("finding_id", ident.cve_of(F.col("rule_id"), F.col("title")).alias("cve"))


@query("f14_ack_expiry_instant", """
SELECT o_orderkey, strftime(CAST(o_orderdate AS DATE) + INTERVAL 1 DAY, '%Y-%m-%dT00:00:00Z') AS instant FROM orders""")
def _(t):
    return t.orders.select("o_orderkey", pol.ack_expiry_instant(F.to_date("o_orderdate")).alias("instant"))


# Predicates and tiers ---------------------------------------------------------------------------

RUNS = "|".join([c + "{6,}" for c in "abcdefghijklmnopqrstuvwxyz0123456789=*#_ .-".replace(".", "").replace("*", "").replace("-", "")] + [r"\.{6,}", r"\*{6,}", "-{6,}"])


@query("p05_placeholder_value", f"""
WITH v AS (SELECT secret AS value FROM scan_findings WHERE secret IS NOT NULL UNION ALL SELECT replace(c_name, 'Customer#', '') FROM customer UNION ALL SELECT unnest(string_split(text, ' ')) FROM conversations)
SELECT value, count(*) AS n FROM v WHERE length(trim(value)) >= 4 AND (regexp_matches(lower(trim(value)), '{RUNS}') OR regexp_matches(value, '(?i){PLACEHOLDER_WORDS}')) GROUP BY 1""")
def _(t):
    v = t.sql("SELECT secret AS value FROM scan_findings WHERE secret IS NOT NULL UNION ALL SELECT replace(c_name, 'Customer#', '') FROM customer "
              "UNION ALL SELECT explode(split(text, ' ')) FROM conversations")
    return v.filter(placeholder_value(F.col("value"))).groupBy("value").agg(F.count("*").alias("n"))


@query("p06_secret_tier", r"""
WITH x AS (SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'AKIA' || upper(substr(md5(o_orderkey::VARCHAR), 1, 16)) WHEN 1 THEN 'ASIA' || upper(substr(md5(o_orderkey::VARCHAR), 1, 16))
  WHEN 2 THEN 'sk_live_' || md5(o_orderkey::VARCHAR) WHEN 3 THEN 'pk_live_' || md5(o_orderkey::VARCHAR) WHEN 4 THEN 'https://b/x?X-Amz-Signature=' || md5(o_orderkey::VARCHAR)
  WHEN 5 THEN 'ghp_' || md5(o_orderkey::VARCHAR) WHEN 6 THEN 'dop_v1_' || sha256(o_orderkey::VARCHAR) ELSE md5(o_orderkey::VARCHAR) END AS value FROM orders)
SELECT o_orderkey, CASE o_orderkey % 8 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' WHEN 2 THEN 'HIGH' WHEN 3 THEN 'LOW' WHEN 4 THEN 'LOW' WHEN 5 THEN 'HIGH' WHEN 6 THEN 'HIGH' END AS severity,
 CASE o_orderkey % 8 WHEN 0 THEN 'long-lived-access-key' WHEN 1 THEN 'temporary-token' WHEN 2 THEN 'payment-live-secret' WHEN 3 THEN 'publishable-key' WHEN 4 THEN 'presigned-url'
  WHEN 5 THEN 'github-token' WHEN 6 THEN 'digitalocean-token' END AS note FROM x""")
def _(t):
    k = F.col("o_orderkey").cast("string")
    m, n = F.md5(k), F.col("o_orderkey") % 8
    value = (F.when(n == 0, F.concat(F.lit("AKIA"), F.upper(F.substring(m, 1, 16))))
             .when(n == 1, F.concat(F.lit("ASIA"), F.upper(F.substring(m, 1, 16))))
             .when(n == 2, F.concat(F.lit("sk_live_"), m)).when(n == 3, F.concat(F.lit("pk_live_"), m))
             .when(n == 4, F.concat(F.lit("https://b/x?X-Amz-Signature="), m)).when(n == 5, F.concat(F.lit("ghp_"), m))
             .when(n == 6, F.concat(F.lit("dop_v1_"), F.sha2(k, 256))).otherwise(m))
    return t.orders.select("o_orderkey", tiers.secret_tier(value).alias("x")).select("o_orderkey", "x.severity", "x.note")


@query("p07_generic_secret_tier", """
SELECT key, count(*) AS n, bool_or(regexp_matches(key, 'generic|entropy')) AS generic FROM scan_findings GROUP BY 1""")
def _(t):
    return t.scan_findings.groupBy("key").agg(F.count("*").alias("n"), F.bool_or(tiers.generic_rule(F.col("key"))).alias("generic"))


PLACEHOLDER = "secret IN ('changeme-please', 'xxxxxxxxxxxx', 'your-api-key-1', 'aaaaaaaaaaaa')"
LIKE = "(category = 'secret' OR regexp_matches(key, 'api-key|token'))"
PH_TIER = f"""CASE WHEN {LIKE} AND {PLACEHOLDER} THEN 'INFO'
  WHEN {LIKE} AND (file LIKE '%.example' OR file LIKE '%.md' OR file = 'no') THEN 'LOW' END"""


@query("p08_placeholder_tier", f"""
WITH x AS (SELECT *, {PH_TIER} AS tier FROM scan_findings)
SELECT repo, seq, CASE WHEN tier IS NOT NULL AND {sev('severity')} > {sev('tier')} THEN tier ELSE severity END AS severity,
  CASE WHEN tier IS NOT NULL AND {sev('severity')} > {sev('tier')} THEN CASE WHEN file LIKE '%.example' THEN 'example-file' ELSE 'doc-file' END END AS placeholder_tier FROM x""")
def _(t):
    return fnd.placeholder_demote(t.scan_findings).select("repo", "seq", "severity", "placeholder_tier")


@query("p09_fixture_demote", f"""
SELECT repo, seq, category = 'secret' AND regexp_matches(file, '{TEST_RX}') AND {sev('severity')} >= 2 AS in_fixture,
 tool = 'trivy' AND category = 'secret' AND file = 'config/.env.example' AND substr(repo, 5)::INT % 2 = 0 AND {sev('severity')} >= 2 AS local_only,
 CASE WHEN category = 'secret' AND {sev('severity')} >= 2 AND (regexp_matches(file, '{TEST_RX}')
   OR tool = 'trivy' AND file = 'config/.env.example' AND substr(repo, 5)::INT % 2 = 0) THEN 'LOW' ELSE severity END AS severity FROM scan_findings""")
def _(t):
    ignored = t.sql("SELECT 'repo' || cast(s_suppkey AS string) AS repo, 'config/.env.example' AS path FROM supplier WHERE s_suppkey % 2 = 0")
    return fnd.fixture_demote(fnd.local_only_demote(t.scan_findings, ignored)).select("repo", "seq", "in_fixture", "local_only", "severity")


@query("p10_derive_confidence", f"""
SELECT repo, seq, line, CASE WHEN native_confidence IN ('high', 'low') THEN upper(native_confidence) WHEN native_confidence IS NOT NULL THEN 'LOW'
 WHEN category = 'secret' THEN CASE WHEN verified THEN 'HIGH' WHEN severity = 'INFO' OR {PLACEHOLDER} OR file LIKE '%.example' OR file LIKE '%.md'
    OR regexp_matches(file, '{TEST_RX}') OR key LIKE '%generic%' THEN 'LOW' ELSE 'HIGH' END
 WHEN category = 'sca' THEN 'HIGH' WHEN category = 'iac' THEN 'MEDIUM'
 ELSE CASE WHEN regexp_matches(file, '{TEST_RX}') OR file LIKE '%.md' OR file LIKE '%.example' THEN 'LOW' ELSE 'MEDIUM' END END AS confidence,
 CASE WHEN native_confidence IN ('high', 'low') THEN 'reported' WHEN native_confidence IS NOT NULL THEN 'unrecognised-native'
 WHEN category = 'secret' THEN CASE WHEN verified THEN 'verified-live' WHEN severity = 'INFO' OR {PLACEHOLDER} THEN 'placeholder-value' WHEN file LIKE '%.example' THEN 'example-file'
    WHEN file LIKE '%.md' THEN 'doc-file' WHEN regexp_matches(file, '{TEST_RX}') THEN 'test-file' WHEN key LIKE '%generic%' THEN 'generic-rule' ELSE 'provider-rule' END
 WHEN category = 'sca' THEN 'pinned-version' WHEN category = 'iac' THEN 'config-policy'
 ELSE CASE WHEN regexp_matches(file, '{TEST_RX}') OR file LIKE '%.md' OR file LIKE '%.example' THEN 'test-or-doc' WHEN semantic_id IS NOT NULL THEN 'semantic-rule' ELSE 'syntactic-pattern' END END AS confidence_basis
FROM scan_findings""")
def _(t):
    return fnd.with_confidence(t.scan_findings).select("repo", "seq", "line", "confidence", "confidence_basis")


@query("p11_likely_filtered", r"""
SELECT finding_id, CASE attack_class WHEN 'redos' THEN 'regex-complexity' WHEN 'open-redirect' THEN 'open-redirect-alone' WHEN 'llm-unbounded' THEN 'cost-concern'
  ELSE CASE WHEN regexp_matches(file, '(^|/)tests?/') THEN 'test-file' WHEN attack_class = 'buffer-overflow' AND substr(repo, 5)::INT % 3 = 0 AND substr(repo, 5)::INT IN (SELECT s_suppkey % 60 FROM supplier) THEN 'memory-safe-stack' END END AS filter_reason
FROM ledger""")
def _(t):
    langs = t.sql("SELECT DISTINCT 'repo' || cast(s_suppkey % 60 AS string) AS repo, CASE WHEN s_suppkey % 3 = 0 THEN 'Python' ELSE 'c' END AS language FROM supplier")
    return fnd.likely_filtered(t.ledger, langs).select("finding_id", "filter_reason")


@query("p12_pattern_match", r"""
WITH f AS (SELECT DISTINCT file FROM ledger), p(pattern, kind, rx) AS (VALUES
 ('tests/', 'path', '(^|/)tests/.'), ('category:sca', 'category', NULL), ('*.md', 'path', '\.md(/|$)'), ('issue 7', 'word', NULL), ('/src/app', 'path', '^src/app(/|$)'),
 ('src/server/db.py', 'path', '(^|/)src/server/db\.py(/|$)'), ('login', 'word', NULL), ('category:Secret', 'category', NULL), ('/infra/*.tf', 'path', '^infra/.*\.tf(/|$)'),
 ('scripts', 'word', NULL), ('docs/**', 'path', '(^|/)docs/'), ('x?z.py', 'path', '(^|/)x.z\.py$'), ('contests/', 'path', '(^|/)contests/.'))
SELECT pattern, kind, count(file) FILTER (regexp_matches(file, rx)) AS hits FROM p CROSS JOIN f
WHERE pattern IN (SELECT unnest(string_split(content, chr(10))) FROM policy_files) GROUP BY 1, 2""")
def _(t):
    sup, _acks = pol.read_policy(t.policy_files)
    pats = sup.select("pattern", "kind").distinct()
    files = t.ledger.select("file", F.lower("file").alias("low")).distinct()
    found = pol.matched_paths(files, pats.filter("kind = 'path'"), [], "low")
    hit = files.join(found, "low").groupBy("pattern").agg(F.count("*").alias("hits"))
    return pats.join(hit, "pattern", "left").select("pattern", "kind", F.coalesce("hits", F.lit(0)).alias("hits"))


ACKS = """a AS (SELECT 'repo' || (s_suppkey % 60)::VARCHAR AS repo, CASE WHEN s_suppkey % 5 = 0 THEN 'explicit-legacy-cwd' ELSE 'target' END AS source, 'fp' || (s_suppkey % 30)::VARCHAR AS fingerprint,
  CASE s_suppkey % 5 WHEN 0 THEN DATE '2024-06-30' WHEN 1 THEN DATE '2031-01-01' END AS expires,
  CASE s_suppkey % 3 WHEN 0 THEN 'accepted risk' WHEN 1 THEN 'see ticket' ELSE '' END AS reason,
  CASE WHEN s_suppkey % 3 = 2 THEN 'missing-reason' ELSE CASE s_suppkey % 5 WHEN 0 THEN 'expired' WHEN 1 THEN 'active' WHEN 2 THEN 'legacy-no-expiry' ELSE 'malformed' END END AS state FROM supplier)"""


@query("p13_ack_state", f"WITH {ACKS} SELECT repo, fingerprint, state, expires::VARCHAR AS expires, count(*) AS n FROM a GROUP BY ALL")
def _(t):
    _sup, acks = pol.read_policy(t.policy_files, F.lit("2025-06-01").cast("date"))
    return acks.groupBy("repo", "fingerprint", "state", F.col("expires").cast("string").alias("expires")).agg(F.count("*").alias("n"))


@query("s10_read_policy", """
WITH l AS (SELECT repo, u.x AS x, u.o AS line_no FROM policy_files, unnest(string_split(content, chr(10))) WITH ORDINALITY AS u(x, o))
SELECT repo, line_no, x AS pattern, CASE WHEN x LIKE 'category:%' THEN 'category' WHEN x LIKE '%/%' OR x LIKE '%*%' OR x LIKE '%?%' THEN 'path' ELSE 'word' END AS kind
FROM l WHERE x NOT LIKE 'fingerprint:%' AND x NOT LIKE '#%'""")
def _(t):
    return pol.read_policy(t.policy_files)[0].select("repo", "line_no", "pattern", "kind")


@query("w07_latest_ack", """
WITH p AS (SELECT s_suppkey % 7 AS fingerprint, s_suppkey AS line_no, CASE WHEN s_suppkey % 5 = 0 THEN 'explicit-legacy-cwd' ELSE 'target' END AS source, 'r' AS repo FROM supplier)
SELECT repo, fingerprint, max_by(line_no, CASE WHEN source = 'target' THEN 1000000000 ELSE 0 END + line_no) AS line_no FROM p GROUP BY 1, 2""")
def _(t):
    a = t.sql("SELECT s_suppkey % 7 AS fingerprint, s_suppkey AS line_no, CASE WHEN s_suppkey % 5 = 0 THEN 'explicit-legacy-cwd' ELSE 'target' END AS source, 'r' AS repo FROM supplier")
    return pol.latest_ack(a).select("repo", "fingerprint", "line_no")


@query("p14_cvss_band", """
WITH x AS (SELECT p_partkey, CASE p_partkey % 6 WHEN 0 THEN (p_size / 5.0)::VARCHAR WHEN 1 THEN 'n/a' WHEN 2 THEN '9.0' WHEN 3 THEN '7.0' WHEN 4 THEN '0' ELSE NULL END AS score FROM part)
SELECT p_partkey, CASE WHEN try_cast(score AS DOUBLE) IS NULL THEN 'MEDIUM' WHEN score::DOUBLE >= 9 THEN 'CRITICAL' WHEN score::DOUBLE >= 7 THEN 'HIGH' WHEN score::DOUBLE >= 4 THEN 'MEDIUM'
  WHEN score::DOUBLE > 0 THEN 'LOW' ELSE 'UNKNOWN' END AS band FROM x""")
def _(t):
    m = F.col("p_partkey") % 6
    score = (F.when(m == 0, (F.col("p_size") / 5.0).cast("string")).when(m == 1, "n/a").when(m == 2, "9.0").when(m == 3, "7.0").when(m == 4, "0"))
    return t.part.select("p_partkey", tiers.cvss_band(score).alias("band"))


@query("p15_gate_filter", f"""
SELECT repo, count(*) AS blocking FROM ledger WHERE {sev('severity')} >= 2 AND {conf('confidence')} >= 1 GROUP BY 1""")
def _(t):
    return life.gate_filter(t.ledger, "MEDIUM", "MEDIUM").groupBy("repo").agg(F.count("*").alias("blocking"))


# De-duplication and aggregation -----------------------------------------------------------------

@query("a01_dedupe_findings", f"""
SELECT repo, fingerprint, count(*) AS copies, array_to_string(list_sort(list_distinct(list(tool))), ',') AS tools,
  max_by(severity, {sev('severity')} * 10000000000 - seq) AS severity, min_by(file, seq) AS file, min(seq) AS seq,
  nullif(array_to_string(list_sort(list_distinct(list(fixed) FILTER (fixed IS NOT NULL))), ', '), '') AS fixed,
  coalesce(array_to_string(list_sort(list_distinct(list(alias) FILTER (alias IS NOT NULL))), ','), '') AS aliases
FROM scan_findings GROUP BY 1, 2""")
def _(t):
    d = fnd.dedupe_findings(t.scan_findings)
    return d.select("repo", "fingerprint", "copies", F.array_join("tools", ",").alias("tools"), "severity", "file", "seq", "fixed",
                    F.array_join("advisory_aliases", ",").alias("aliases"))


@query("a02_merge_scan_modes", """
WITH g AS (SELECT * FROM scan_findings WHERE tool = 'gitleaks'),
 m AS (SELECT repo, fingerprint, min(seq) FILTER (scan_mode = 'git') AS g, min(seq) FILTER (scan_mode = 'dir') AS d FROM g GROUP BY 1, 2)
SELECT s.repo, s.seq, s.fingerprint, CASE WHEN g + d IS NOT NULL AND s.seq = least(g, d) THEN 'git+dir' ELSE s.scan_mode END AS scan_mode
FROM g s JOIN m ON s.repo = m.repo AND s.fingerprint = m.fingerprint WHERE g + d IS NULL OR s.seq < greatest(g, d)
UNION ALL SELECT repo, seq, fingerprint, scan_mode FROM scan_findings WHERE tool <> 'gitleaks'""")
def _(t):
    return fnd.merge_scan_modes(t.scan_findings).select("repo", "seq", "fingerprint", "scan_mode")


@query("a03_merge_imports", f"""
WITH i AS (SELECT 'repo' || (l_suppkey)::VARCHAR AS repo, 'sem' || (l_partkey % 50)::VARCHAR AS semantic_id, CASE WHEN l_orderkey % 3 = 0 THEN 'fail' ELSE 'review' END AS kind,
   CASE l_linenumber % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS severity, l_orderkey::VARCHAR || '-' || l_linenumber::VARCHAR AS raw FROM lineitem),
 r AS (SELECT *, row_number() OVER (PARTITION BY repo, semantic_id ORDER BY kind = 'fail' DESC, {sev('severity')} DESC, raw DESC) AS rn, FROM i),
 n AS (SELECT repo, semantic_id, count(DISTINCT raw) AS occurrences FROM i GROUP BY 1, 2)
SELECT r.repo, r.semantic_id, r.severity, r.raw, n.occurrences, NULL::BIGINT AS seq FROM r JOIN n USING (repo, semantic_id) WHERE rn = 1
UNION ALL SELECT repo, semantic_id, severity, NULL, NULL, seq FROM scan_findings""")
def _(t):
    i = t.sql("""SELECT 'repo' || cast(l_suppkey AS string) AS repo, 'sem' || cast(l_partkey % 50 AS string) AS semantic_id, CASE WHEN l_orderkey % 3 = 0 THEN 'fail' ELSE 'review' END AS kind,
      CASE l_linenumber % 3 WHEN 0 THEN 'HIGH' WHEN 1 THEN 'LOW' ELSE 'MEDIUM' END AS severity, cast(l_orderkey AS string) || '-' || cast(l_linenumber AS string) AS raw FROM lineitem""")
    scan = t.scan_findings.select("repo", "semantic_id", "severity", "seq")
    return fnd.merge_imports(scan, i).select("repo", "semantic_id", "severity", "raw", "occurrences", "seq")


@query("a04_summarize", """
SELECT repo, 'severity' AS dimension, severity AS value, count(*) AS n FROM ledger GROUP BY 1, 3
UNION ALL SELECT repo, 'category', category, count(*) FROM ledger GROUP BY 1, 3
UNION ALL SELECT repo, 'confidence', confidence, count(*) FROM ledger GROUP BY 1, 3
UNION ALL SELECT repo, 'total', 'all', count(*) FROM ledger GROUP BY 1""")
def _(t):
    return fnd.summarize(t.ledger)


CELLS = f"""c0 AS (SELECT 'class_label' AS grp, attack_class || '|' || confidence AS key, count(*)::DOUBLE AS n, (count(*) FILTER (is_real))::DOUBLE AS k FROM finding_labels WHERE is_real IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'label', confidence, count(*), count(*) FILTER (is_real) FROM finding_labels WHERE is_real IS NOT NULL GROUP BY 2),
 cells AS (SELECT grp, key, n::BIGINT AS n, k::BIGINT AS k, round(k / n, 3) AS p, round({W_LO}, 3) AS ci_lo, round({W_HI}, 3) AS ci_hi FROM c0)"""


@query("a05_wilson_cells", f"WITH {CELLS} SELECT * FROM cells")
def _(t):
    return cal.wilson_cells(t.finding_labels)


CALIBRATED = """e AS (SELECT f.doc_id, f.attack_class, f.confidence, f.is_real,
  coalesce(c.p, l.p, CASE f.confidence WHEN 'HIGH' THEN 0.85 WHEN 'MEDIUM' THEN 0.5 WHEN 'LOW' THEN 0.25 ELSE 0.5 END) AS p,
  coalesce(c.ci_lo, l.ci_lo, 0) AS ci_lo, coalesce(c.ci_hi, l.ci_hi, 1) AS ci_hi, coalesce(c.n, l.n, 0) AS n,
  CASE WHEN c.p IS NOT NULL THEN 'class+label' WHEN l.p IS NOT NULL THEN 'label' ELSE 'prior' END AS basis
 FROM finding_labels f LEFT JOIN cells c ON c.grp = 'class_label' AND c.key = f.attack_class || '|' || f.confidence AND c.n >= 5
 LEFT JOIN cells l ON l.grp = 'label' AND l.key = f.confidence AND l.n >= 5)"""


@query("a06_calibrate", f"WITH {CELLS}, {CALIBRATED} SELECT doc_id, p, ci_lo, ci_hi, n, basis FROM e")
def _(t):
    return cal.calibrate(t.finding_labels, cal.wilson_cells(t.finding_labels)).select("doc_id", "p", "ci_lo", "ci_hi", "n", "basis")


@query("a07_brier", f"""WITH {CELLS}, {CALIBRATED}
SELECT round(avg((p - CASE WHEN is_real THEN 1 ELSE 0 END) ** 2), 4) AS brier, count(*) AS n FROM e WHERE is_real IS NOT NULL""")
def _(t):
    return cal.brier(t.finding_labels, cal.wilson_cells(t.finding_labels))


@query("a08_merge_cells", f"""
WITH {CELLS}, m AS (SELECT grp, key, sum(n) AS n, sum(k) AS k FROM (SELECT grp, key, n, k FROM cells UNION ALL SELECT grp, key, n * 2, k FROM cells WHERE n >= 3) GROUP BY 1, 2),
 m2 AS (SELECT grp, key, n::DOUBLE AS n, k::DOUBLE AS k FROM m)
SELECT grp, key, n::BIGINT AS n, k::BIGINT AS k, round(k / n, 3) AS p, round({W_LO}, 3) AS ci_lo, round({W_HI}, 3) AS ci_hi FROM m2""")
def _(t):
    cells = cal.wilson_cells(t.finding_labels)
    return cal.merge_cells(cells, cells.filter("n >= 3").withColumn("n", F.col("n") * 2))


@query("a09_reviewed_classes", """
SELECT attack_class FROM truth GROUP BY 1 HAVING bool_and(review_status = 'reviewed' AND is_real IS NOT NULL)""")
def _(t):
    return cal.reviewed_classes(t.truth)


@query("a10_synthetic_cells", f"""
WITH h AS (SELECT p.attack_class, p.vulnerable, f.confidence FROM pairs p LEFT JOIN fired f USING (case_id)),
 c0 AS (SELECT 'class_label' AS grp, attack_class || '|' || confidence AS key, count(*)::DOUBLE AS n, (count(*) FILTER (vulnerable))::DOUBLE AS k FROM h WHERE confidence IS NOT NULL GROUP BY 2
  UNION ALL SELECT 'label', confidence, count(*), count(*) FILTER (vulnerable) FROM h WHERE confidence IS NOT NULL GROUP BY 2)
SELECT grp, key, n::BIGINT AS n, k::BIGINT AS k, round(k / n, 3) AS p, round({W_LO}, 3) AS ci_lo, round({W_HI}, 3) AS ci_hi FROM c0
UNION ALL SELECT 'error', attack_class, count(*), 0, NULL, 0, 1 FROM h WHERE confidence IS NULL AND vulnerable GROUP BY 2""")
def _(t):
    return cal.synthetic_cells(t.pairs, t.fired)


@query("a11_confusion", """
WITH s AS (SELECT content_hash FROM cases GROUP BY 1 HAVING count(DISTINCT partition) > 1),
 n AS (SELECT partition, count(DISTINCT content_hash) AS shared FROM cases WHERE content_hash IN (SELECT content_hash FROM s) GROUP BY 1),
 c AS (SELECT partition, count(*) FILTER (vulnerable AND detected) AS tp, count(*) FILTER (vulnerable AND NOT detected) AS fn, count(*) FILTER (NOT vulnerable AND NOT detected) AS tn,
  count(*) FILTER (NOT vulnerable AND detected) AS fp, count(*) FILTER (detected IS NULL) AS unknown FROM cases GROUP BY 1)
SELECT partition, tp, fn, tn, fp, unknown, coalesce(shared, 0) AS shared_contents, coalesce(shared, 0) = 0 AND unknown = 0 AND fn = 0 AND fp = 0 AS eligible FROM c LEFT JOIN n USING (partition)""")
def _(t):
    return cal.confusion(t.cases)


CLU = """k AS (SELECT *, CASE WHEN history_only AND commit IS NOT NULL THEN 'incident' ELSE 'rule' END AS kind,
 CASE WHEN history_only AND commit IS NOT NULL THEN 'deleted-in:' || substr(commit, 1, 12) ELSE category || ':' || rule_id END AS disc FROM ledger)"""


@query("a12_clusters", f"""
WITH {CLU} SELECT repo, 'wc1_' || substr(kind, 1, 3) || '_' || substr(sha256(kind || '|' || disc), 1, 12) AS cluster_id, kind, disc, count(*) AS site_count,
 CASE max({sev('severity')}) WHEN 4 THEN 'CRITICAL' WHEN 3 THEN 'HIGH' WHEN 2 THEN 'MEDIUM' WHEN 1 THEN 'LOW' ELSE 'INFO' END AS severity,
 CASE max({conf('confidence')}) WHEN 2 THEN 'HIGH' WHEN 1 THEN 'MEDIUM' ELSE 'LOW' END AS confidence,
 arg_min(finding_id, (-({sev('severity')}), file, line, finding_id)) AS representative
FROM k GROUP BY repo, kind, disc HAVING count(*) >= 2""")
def _(t):
    return life.clusters(t.ledger)


@query("a12_cluster_sites", f"""
WITH {CLU}, b AS (SELECT repo, kind, disc FROM k GROUP BY ALL HAVING count(*) >= 2)
SELECT repo, 'wc1_' || substr(kind, 1, 3) || '_' || substr(sha256(kind || '|' || disc), 1, 12) AS cluster_id, finding_id, file, line, severity, confidence FROM k JOIN b USING (repo, kind, disc)""")
def _(t):
    return life.cluster_sites(t.ledger)


@query("a12_cluster_summary", f"""
WITH {CLU}, g AS (SELECT repo, count(*) AS n FROM k GROUP BY repo, kind, disc)
SELECT repo, count(*) FILTER (n >= 2) AS clusters, coalesce(sum(n) FILTER (n >= 2), 0)::BIGINT AS clustered_findings, count(*) AS distinct_issues, sum(n)::BIGINT AS total_findings,
 coalesce(max(n) FILTER (n >= 2), 0) AS largest FROM g GROUP BY 1""")
def _(t):
    return life.cluster_summary(t.ledger)


# Matching joins --------------------------------------------------------------------------------

@query("j15_truth_match", """
WITH t AS (SELECT app, attack_class, lower(location_contains) AS sub, is_real FROM truth WHERE is_real IS NOT NULL)
SELECT l.finding_id, CASE WHEN bool_and(t.is_real) = bool_or(t.is_real) THEN bool_or(t.is_real) END AS is_real FROM ledger l
LEFT JOIN t ON t.app = l.repo AND t.attack_class = l.attack_class AND (t.sub IN ('', '*') OR contains(lower(l.location), t.sub)) GROUP BY 1""")
def _(t):
    return cal.truth_match(t.ledger, t.truth).select("finding_id", "is_real")


@query("j16_grade_reports", """
WITH v AS (SELECT repo, file, line, attack_class, CASE WHEN bool_and(is_real) = bool_or(is_real) THEN bool_or(is_real) END AS verdict FROM review_labels WHERE is_real IS NOT NULL GROUP BY 1, 2, 3, 4),
 g AS (SELECT f.tool, f.repo, f.file, f.line, m.attack_class, v.verdict FROM graded_rows f LEFT JOIN rule_map m ON f.tool = m.tool AND f.rule = m.rule
   LEFT JOIN v ON v.repo = f.repo AND v.file = f.file AND v.line = f.line AND v.attack_class = m.attack_class),
 d AS (SELECT tool, bool_and(completed) AS completed FROM capture_scope GROUP BY 1),
 a AS (SELECT tool, count(*) FILTER (verdict) AS tp, count(*) FILTER (NOT verdict) AS fp, count(*) FILTER (verdict IS NULL) AS unknown,
   count(DISTINCT CASE WHEN verdict IS NOT NULL THEN repo || '|' || file || '|' || line || '|' || attack_class END) AS label_hits FROM g GROUP BY 1)
SELECT a.*, completed, CASE WHEN completed AND tp + fp > 0 THEN round(tp / (tp + fp), 4) END AS "precision" FROM a LEFT JOIN d USING (tool)""")
def _(t):
    return cal.grade_reports(t.graded_rows, t.review_labels, t.rule_map, t.capture_scope)


@query("j04_in_hunk", """
WITH h AS (SELECT DISTINCT repo, path, start_line, end_line FROM hunks)
SELECT l.finding_id, CASE WHEN bool_or(l.line BETWEEN h.start_line AND h.end_line) THEN 'in-changed-hunk' WHEN count(h.path) > 0 THEN 'in-changed-file' ELSE 'untouched' END AS diff_state
FROM ledger l LEFT JOIN h ON h.repo = l.repo AND h.path = l.file GROUP BY 1""")
def _(t):
    return life.in_hunk(t.ledger, t.hunks).select("finding_id", "diff_state")


KIND = "CASE WHEN x LIKE 'category:%' THEN 'category' WHEN x LIKE '%/%' OR x LIKE '%*%' OR x LIKE '%?%' OR x LIKE '%.py' THEN 'path' ELSE 'word' END"


@query("j05_suppress", f"""
WITH p AS (SELECT DISTINCT repo, unnest(string_split(content, chr(10))) AS x FROM policy_files),
 q AS (SELECT repo, x, CASE x WHEN 'tests/' THEN '(^|/)tests/.' WHEN '*.md' THEN '\\.md$' WHEN '/src/app' THEN '^src/app(/|$)' WHEN 'src/server/db.py' THEN '(^|/)src/server/db\\.py$' WHEN '/infra/*.tf' THEN '^infra/.*\\.tf$'
   WHEN 'docs/**' THEN '(^|/)docs/' WHEN 'x?z.py' THEN '(^|/)x.z\\.py$' WHEN 'contests/' THEN '(^|/)contests/.' END AS rx FROM p WHERE x NOT LIKE '#%' AND x NOT LIKE 'fingerprint:%'),
 m AS (SELECT l.finding_id, lower(l.category) = lower(substr(q.x, 10)) AND q.x LIKE 'category:%' OR (rx IS NOT NULL AND regexp_matches(l.file, rx)) AS strict,
   contains(lower(l.category || ' ' || l.location || ' ' || l.title), lower(q.x)) OR lower(l.location) GLOB lower(q.x) AS legacy
   FROM ledger l JOIN q ON q.repo = l.repo),
 v AS (SELECT finding_id, bool_or(strict) AS strict, count(*) FILTER (legacy) AS legacy FROM m WHERE strict OR legacy GROUP BY 1)
SELECT l.finding_id, v.legacy IS NOT NULL AS suppressed, coalesce(NOT v.strict, false) AS legacy_only, CASE WHEN NOT v.strict THEN v.legacy ELSE 0 END AS legacy_patterns FROM ledger l LEFT JOIN v USING (finding_id)""")
def _(t):
    return pol.suppress(t.ledger, pol.read_policy(t.policy_files)[0]).select("finding_id", "suppressed", "legacy_only", "legacy_patterns")


@query("j06_acknowledge", f"""
WITH {ACKS}, o AS (SELECT *, row_number() OVER () AS rn FROM a),
 la AS (SELECT repo, fingerprint, state, reason FROM (SELECT *, row_number() OVER (PARTITION BY repo, fingerprint ORDER BY source = 'target' DESC, state, reason) AS r FROM (SELECT DISTINCT repo, fingerprint, source, state, reason FROM a)) WHERE r = 1),
 f AS (SELECT finding_id, repo, 'fp' || (finding_id % 90)::VARCHAR AS fp, 'fp' || (finding_id % 25)::VARCHAR AS al FROM ledger),
 k AS (SELECT DISTINCT repo, fp, 0 AS prio, fp AS key FROM f UNION SELECT DISTINCT repo, fp, 1, al FROM f),
 n AS (SELECT repo, key, count(DISTINCT fp) AS fan FROM k GROUP BY 1, 2),
 amb AS (SELECT DISTINCT k.repo, k.fp FROM k JOIN la ON la.repo = k.repo AND la.fingerprint = k.key JOIN n ON n.repo = k.repo AND n.key = k.key WHERE prio = 1 AND fan > 1),
 h AS (SELECT k.repo, k.fp, min_by(la.state, k.prio::VARCHAR || k.key) AS state, min_by(la.reason, k.prio::VARCHAR || k.key) AS reason FROM k JOIN la ON la.repo = k.repo AND la.fingerprint = k.key JOIN n ON n.repo = k.repo AND n.key = k.key
   WHERE prio = 0 OR fan = 1 GROUP BY 1, 2)
SELECT f.finding_id, CASE WHEN h.state IN ('active', 'legacy-no-expiry') THEN 'acknowledged' ELSE 'open' END AS status,
 CASE WHEN h.state NOT IN ('active', 'legacy-no-expiry') THEN 'acknowledgement ' || h.state WHEN h.state IS NULL AND amb.fp IS NOT NULL THEN 'acknowledgement ambiguous' END AS reopened_reason
FROM f LEFT JOIN h ON h.repo = f.repo AND h.fp = f.fp LEFT JOIN amb ON amb.repo = f.repo AND amb.fp = f.fp""")
def _(t):
    _sup, acks = pol.read_policy(t.policy_files, F.lit("2025-06-01").cast("date"))
    # The lines of one repo come from several files here, so a line number is not an order; state is.
    acks = acks.withColumn("line_no", -F.dense_rank().over(_by_state()))
    f = t.ledger.select("finding_id", "repo", F.concat(F.lit("fp"), F.col("finding_id") % 90).alias("fingerprint"),
                        F.array(F.concat(F.lit("fp"), F.col("finding_id") % 25)).alias("fingerprint_aliases"))
    return pol.acknowledge(f, acks).select("finding_id", "status", "reopened_reason")


def _by_state():
    from pyspark.sql import Window
    return Window.partitionBy("repo", "fingerprint").orderBy("state", "reason")


# Baseline ----------------------------------------------------------------------------------------

# A key equal exactly when fingerprints are equal.
IDK = """concat_ws('|', repo, attack_class, category, file, coalesce(rule_id, '~'), coalesce(service_id, '~'), coalesce(semantic_id, '~'),
  CASE WHEN attack_class = 'cve' THEN regexp_extract(title, 'CVE-[0-9]{4}-[0-9]+') ELSE '' END)"""
LEG = "concat_ws('|', repo, attack_class, location, title)"
OKP = " AND ".join(f"(f.{c} IS NULL OR b.{c} IS NULL OR f.{c} = b.{c})" for c in ("rule_id", "service_id", "semantic_id"))
MATCH = f"""f0 AS (SELECT *, {IDK} AS fp, {LEG} AS leg FROM ledger), b0 AS (SELECT *, {IDK} AS fp, {LEG} AS leg FROM baseline),
 sole AS (SELECT fp, min(baseline_id) AS baseline_id FROM b0 GROUP BY 1 HAVING count(*) = 1),
 m1 AS (SELECT finding_id, baseline_id, 'fingerprint' AS matched_by FROM f0 JOIN sole USING (fp)),
 f1 AS (SELECT * FROM f0 WHERE finding_id NOT IN (SELECT finding_id FROM m1)),
 b1 AS (SELECT * FROM b0 WHERE identity_version < 2 AND (repo, baseline_id) NOT IN (SELECT (f0.repo, m1.baseline_id) FROM m1 JOIN f0 USING (finding_id))),
 fl AS (SELECT leg, min(finding_id) AS finding_id FROM f1 GROUP BY 1 HAVING count(*) = 1), bl AS (SELECT leg, min(baseline_id) AS baseline_id FROM b1 GROUP BY 1 HAVING count(*) = 1),
 m2 AS (SELECT f.finding_id, b.baseline_id, 'alias' AS matched_by FROM fl JOIN bl USING (leg) JOIN f1 f USING (finding_id) JOIN b1 b USING (baseline_id) WHERE f.repo = b.repo AND {OKP}),
 f2 AS (SELECT * FROM f1 WHERE finding_id NOT IN (SELECT finding_id FROM m2)),
 b2 AS (SELECT * FROM b1 WHERE (repo, baseline_id) NOT IN (SELECT (f0.repo, m2.baseline_id) FROM m2 JOIN f0 USING (finding_id))),
 pr AS (SELECT f.finding_id, b.baseline_id, count(*) OVER (PARTITION BY f.finding_id) AS nf, count(*) OVER (PARTITION BY b.repo, b.baseline_id) AS nb
   FROM f2 f JOIN b2 b ON f.repo = b.repo AND f.attack_class = b.attack_class AND f.category = b.category AND f.file = b.file AND {OKP}),
 m AS (SELECT * FROM m1 UNION ALL SELECT * FROM m2 UNION ALL SELECT finding_id, baseline_id, 'coarse' FROM pr WHERE nf = 1 AND nb = 1)"""


def _lifecycle(t):
    cur = life.annotate(t.ledger.drop("commit")).withColumn("place", F.col("file"))
    old = life.annotate(t.baseline).withColumn("place", F.col("file"))
    return cur, old, life.baseline_match(cur, old)


@query("j11_baseline_diff", f"""
WITH {MATCH} SELECT f.finding_id, m.baseline_id, m.matched_by, CASE WHEN m.baseline_id IS NULL THEN 'new' WHEN b.status = 'acknowledged' AND f.status <> 'acknowledged' THEN 'reopened'
  WHEN {sev('f.severity')} > {sev('b.severity')} OR f.kev THEN 'changed' ELSE 'unchanged' END AS baseline_state
FROM f0 f LEFT JOIN m USING (finding_id) LEFT JOIN b0 b ON b.repo = f.repo AND b.baseline_id = m.baseline_id""")
def _(t):
    cur, old, m = _lifecycle(t)
    return life.baseline_diff(cur, old, m).select("finding_id", "baseline_id", "matched_by", "baseline_state")


@query("j11_change_events", f"""
WITH {MATCH}, j AS (SELECT f.repo, f.finding_id, f.severity, b.severity AS s0, f.kev, b.kev AS k0 FROM m JOIN f0 f USING (finding_id) JOIN b0 b ON b.repo = f.repo AND b.baseline_id = m.baseline_id)
SELECT repo, finding_id, 'severity-changed' AS event, s0 AS previous, severity AS current FROM j WHERE s0 <> severity
UNION ALL SELECT repo, finding_id, 'kev-changed', k0::VARCHAR, kev::VARCHAR FROM j WHERE k0 <> kev""")
def _(t):
    cur, old, m = _lifecycle(t)
    return life.change_events(cur, old, m)


@query("u02_missing_observations", f"""
WITH {MATCH} SELECT b.repo, b.baseline_id, 'no-longer-observed' AS state FROM b0 b WHERE NOT EXISTS (SELECT 1 FROM m JOIN f0 USING (finding_id) WHERE f0.repo = b.repo AND m.baseline_id = b.baseline_id)""")
def _(t):
    _cur, old, m = _lifecycle(t)
    return life.missing_observations(old, m).select("repo", "baseline_id", "state")


@query("u04_two_role_diff", """
WITH a AS (SELECT DISTINCT repo, file, rule_id FROM ledger WHERE confidence = 'HIGH'), b AS (SELECT DISTINCT repo, file, rule_id FROM ledger WHERE confidence = 'LOW')
SELECT coalesce(a.repo, b.repo) AS repo, coalesce(a.file, b.file) AS file, coalesce(a.rule_id, b.rule_id) AS rule_id,
 CASE WHEN a.repo IS NULL THEN 'only-b' WHEN b.repo IS NULL THEN 'only-a' ELSE 'both' END AS seen_by FROM a FULL JOIN b ON a.repo = b.repo AND a.file = b.file AND a.rule_id = b.rule_id""")
def _(t):
    return life.two_role_diff(t.ledger.filter("confidence = 'HIGH'"), t.ledger.filter("confidence = 'LOW'"), ["repo", "file", "rule_id"])


# Ranking -----------------------------------------------------------------------------------------

@query("w03_rank_findings", f"""
SELECT finding_id, repo, severity, confidence FROM ledger ORDER BY {sev('severity')} DESC, {conf('confidence')} DESC, finding_id""")
def _(t):
    return fnd.rank_findings(t.ledger.select("finding_id", "repo", "severity", "confidence"))


@query("w04_top_findings", f"""
SELECT repo, finding_id, position FROM (SELECT repo, finding_id, row_number() OVER (PARTITION BY repo ORDER BY {sev('severity')} DESC, {conf('confidence')} DESC, finding_id) AS position FROM ledger) WHERE position <= 15""")
def _(t):
    return fnd.top_findings(t.ledger).select("repo", "finding_id", "position")


@query("w02_identity_occurrence", """
SELECT repo, seq, row_number() OVER (PARTITION BY repo, fingerprint ORDER BY seq) AS occurrence, count(*) OVER (PARTITION BY repo, fingerprint) > 1 AS ambiguous
FROM (SELECT DISTINCT repo, fingerprint, seq FROM scan_findings)""")
def _(t):
    rows = t.scan_findings.select("repo", "fingerprint", "seq").distinct()
    n = rows.groupBy("repo", "fingerprint").agg((F.count("*") > 1).alias("ambiguous"))
    return number_within(rows, ["repo", "fingerprint"], "seq", "occurrence").join(n, ["repo", "fingerprint"]).select("repo", "seq", "occurrence", "ambiguous")


