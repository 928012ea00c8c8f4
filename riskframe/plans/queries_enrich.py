"""Enrichment, graph, coverage, gate, repair and export queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import standards as std
from ..operators import coverage as cov
from ..operators import enrich as en
from ..operators import export as ex
from ..operators import findings as fnd
from ..operators import graph as gr
from ..operators import lifecycle as life
from ..operators import repairs as rep
from ..operators.calibration import calibrate, wilson_cells
from ..operators.ledger import pack_to_ledger, scan_to_ledger, sinks_to_ledger, union_ledger
from ..sources import files as src
from ..sources import intel
from .catalog import query
from .queries_ledger import conf, sev


@query("j07_enrich_exploitability", """
WITH f AS (SELECT finding_id, nullif(regexp_extract(title, 'CVE-[0-9]{4}-[0-9]{4,}'), '') AS cve_id FROM ledger)
SELECT f.finding_id, f.cve_id, round(e.epss, 6) AS epss, CASE WHEN f.cve_id IS NOT NULL THEN k.cve IS NOT NULL END AS kev, CASE WHEN k.cve IS NOT NULL THEN 'known-exploited' WHEN e.epss >= 0.5 THEN 'high' WHEN e.epss IS NOT NULL THEN 'scored' END AS exploit_level
FROM f LEFT JOIN epss_feed e ON e.cve = f.cve_id LEFT JOIN kev_feed k ON k.cve = f.cve_id""")
def _(t):
    return en.enrich_exploitability(t.ledger, t.epss_feed, t.kev_feed).select("finding_id", "cve_id", F.round("epss", 6).alias("epss"), "kev", "exploit_level")


@query("j08_enrich_reachability", """
WITH f AS (SELECT o_orderkey AS finding_id, 'repo' || (o_custkey % 45) AS repo, CASE o_orderkey % 5 WHEN 0 THEN 'pkg1' WHEN 1 THEN '@s/pkg2' WHEN 2 THEN 'PyYAML' WHEN 3 THEN 'python-dateutil' ELSE 'gone' END AS pkg, CASE o_orderkey % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'npm' WHEN 2 THEN 'pip' WHEN 3 THEN 'pip' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'npm' ELSE 'gomod' END END AS ecosystem FROM orders),
 k AS (SELECT DISTINCT 'repo' || (c_custkey % 40) AS repo, c_custkey % 40 AS r FROM customer)
SELECT finding_id, CASE WHEN k.repo IS NULL OR ecosystem = 'gomod' THEN 'n/a' WHEN pkg = 'pkg1' AND r % 4 = 0 OR pkg = '@s/pkg2' AND r % 4 = 1 OR pkg = 'PyYAML' AND r % 4 = 2 OR pkg = 'python-dateutil' AND r % 4 = 3 THEN 'imported' ELSE 'no-import-found' END AS reachability FROM f LEFT JOIN k ON k.repo = f.repo""")
def _(t):
    f = t.sql("""SELECT o_orderkey AS finding_id, 'repo' || cast(o_custkey % 45 AS string) AS repo, 'sca' AS category, CASE o_orderkey % 5 WHEN 0 THEN 'pkg1' WHEN 1 THEN '@s/pkg2' WHEN 2 THEN 'PyYAML' WHEN 3 THEN 'python-dateutil' ELSE 'gone' END AS pkg,
      CASE o_orderkey % 5 WHEN 0 THEN 'npm' WHEN 1 THEN 'npm' WHEN 2 THEN 'pip' WHEN 3 THEN 'pip' ELSE CASE o_orderkey % 2 WHEN 0 THEN 'npm' ELSE 'gomod' END END AS ecosystem FROM orders""")
    k, m = F.col("c_custkey").cast("string"), F.col("c_custkey") % 40 % 4
    text = (F.when(m == 0, F.lit("const a = require('pkg1/sub');")).when(m == 1, F.lit("import b from '@s/pkg2/x';\nimport './local';")).when(m == 2, F.lit("import yaml\n")).otherwise(F.lit("from dateutil.parser import parse\n")))
    files = t.customer.select(F.concat(F.lit("repo"), F.col("c_custkey") % 40).alias("repo"), F.concat(F.lit("f"), k, F.when(m < 2, F.lit(".js")).otherwise(F.lit(".py"))).alias("path"), text.alias("content"))
    return en.enrich_reachability(f, en.import_roots(files)).select("finding_id", "reachability")


@query("f06_package_roots", """
WITH x AS (SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '@a/b/c' WHEN 1 THEN 'lodash/fp' WHEN 2 THEN './x' WHEN 3 THEN 'node:fs' ELSE 'python-' || replace(p_name, ' ', '-') END AS spec, p_name FROM part)
SELECT p_partkey, CASE p_partkey % 5 WHEN 0 THEN '@a/b' WHEN 1 THEN 'lodash' WHEN 2 THEN '' WHEN 3 THEN '' ELSE 'python-' || replace(p_name, ' ', '-') END AS js,
 CASE WHEN p_partkey % 5 = 4 THEN 'python-' || replace(p_name, ' ', '-') || ',python_' || replace(p_name, ' ', '_') || ',' || replace(p_name, ' ', '_') END AS py FROM x""")
def _(t):
    spec = (F.when(F.col("p_partkey") % 5 == 0, F.lit("@a/b/c")).when(F.col("p_partkey") % 5 == 1, F.lit("lodash/fp")).when(F.col("p_partkey") % 5 == 2, F.lit("./x")).when(F.col("p_partkey") % 5 == 3, F.lit("node:fs"))
            .otherwise(F.concat(F.lit("python-"), F.replace("p_name", F.lit(" "), F.lit("-")))))
    return t.part.select("p_partkey", en.js_root(spec).alias("js"), F.when(F.col("p_partkey") % 5 == 4, F.array_join(en.py_candidates(spec), ",")).alias("py"))


@query("f08_valid_registry_name", r"""
WITH x AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN lower(replace(p_brand, '#', '-')) WHEN 2 THEN '@Org/x' ELSE '@org/' || lower(p_type) END AS name FROM part)
SELECT p_partkey, p_partkey % 4 IN (1, 3) AS npm, p_partkey % 4 = 1 AS pip FROM x""")
def _(t):
    m = F.col("p_partkey") % 4
    name = F.when(m == 0, F.col("p_name")).when(m == 1, F.lower(F.replace("p_brand", F.lit("#"), F.lit("-")))).when(m == 2, F.lit("@Org/x")).otherwise(F.concat(F.lit("@org/"), F.lower("p_type")))
    return t.part.select("p_partkey", en.valid_registry_name(F.lit("npm"), name).alias("npm"), en.valid_registry_name(F.lit("pip"), name).alias("pip"))


REASSESS = """j AS (SELECT f.*, e.epss AS ne, k.cve IS NOT NULL AS nk, CASE WHEN has_intel AND intel_epss_date IS NULL THEN 'incomplete-provenance' WHEN has_intel AND intel_epss_date > DATE '2025-06-01' THEN 'older-snapshot' END AS blocked
 FROM intel_findings f LEFT JOIN epss_feed e ON e.cve = f.cve LEFT JOIN kev_feed k ON k.cve = f.cve),
 r AS (SELECT *, blocked IS NULL AND status = 'acknowledged' AND (nk OR coalesce(ne, 0) >= 0.5 AND epss < 0.5) AS reopened FROM j)"""


@query("j18_reassess", f"""WITH {REASSESS} SELECT finding_id, blocked, CASE WHEN reopened THEN 'open' ELSE status END AS status, round(CASE WHEN blocked IS NULL THEN ne ELSE epss END, 6) AS epss, CASE WHEN blocked IS NULL THEN nk ELSE kev END AS kev, reopened FROM r""")
def _(t):
    out, _ev = en.reassess(t.intel_findings, t.epss_feed, t.kev_feed, F.lit("2025-06-01").cast("date"), F.lit("2025-06-01").cast("date"))
    return out.select("finding_id", "blocked", "status", F.round("epss", 6).alias("epss"), "kev", "reopened")


@query("j18_reassess_events", f"""WITH {REASSESS} SELECT finding_id, 'newly-exploited' AS kind FROM r WHERE blocked IS NULL AND nk UNION ALL SELECT finding_id, 'epss-changed' FROM r WHERE blocked IS NULL AND ne IS DISTINCT FROM epss UNION ALL SELECT finding_id, 'reopened' FROM r WHERE reopened""")
def _(t):
    return en.reassess(t.intel_findings, t.epss_feed, t.kev_feed, F.lit("2025-06-01").cast("date"), F.lit("2025-06-01").cast("date"))[1].select("finding_id", "kind")


@query("f15_freshness", """
SELECT o_orderkey, date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') AS age, CASE WHEN date_diff('day', CAST(o_orderdate AS DATE), DATE '1998-08-01') > 7 THEN 'stale' ELSE 'fresh' END AS freshness FROM orders""")
def _(t):
    d, today = F.to_date("o_orderdate"), F.lit("1998-08-01").cast("date")
    return t.orders.select("o_orderkey", en.feed_age_days(d, today).alias("age"), en.freshness(d, today).alias("freshness"))


@query("s08_read_epss", """
SELECT 'CVE-2024-' || lpad(p_partkey::VARCHAR, 5, '0') AS cve, round(p_size / 50.0, 4) AS epss, '2025-05-01' AS feed_date, 'v2025.03.14' AS model_version FROM part""")
def _(t):
    body = t.part.select(F.concat_ws(",", F.concat(F.lit("CVE-2024-"), F.lpad(F.col("p_partkey").cast("string"), 5, F.lit("0"))), F.round(F.col("p_size") / 50.0, 4).cast("string"), F.lit("0.5")).alias("value"))
    head = t.region.filter("r_regionkey = 0").select(F.explode(F.array(F.lit("#model_version:v2025.03.14,score_date:2025-05-01T00:00:00+0000"), F.lit("cve,epss,percentile"))).alias("value"))
    rows, _p = intel.parse_epss(head.unionByName(body), F.lit("2025-06-01").cast("date"))
    return rows.select("cve", F.round("epss", 4).alias("epss"), F.col("feed_date").cast("string").alias("feed_date"), "model_version")


@query("s08_epss_problems", """
SELECT (count(*) FILTER (p_size > 40))::BIGINT AS invalid_rows, count(*) - count(DISTINCT p_partkey % 1000) AS duplicates, 0 AS empty, 0 AS missing_metadata, 1 AS bad_dates FROM part""")
def _(t):
    body = t.part.select(F.concat_ws(",", F.concat(F.lit("CVE-2024-"), F.lpad((F.col("p_partkey") % 1000).cast("string"), 5, F.lit("0"))), (F.col("p_size") / 40.0).cast("string"), F.lit("0.5")).alias("value"))
    head = t.region.filter("r_regionkey = 0").select(F.lit("#model_version:v2025.05.14,score_date:2025-05-01T00:00:00+0000").alias("value"))
    return intel.parse_epss(head.unionByName(body), F.lit("2025-06-01").cast("date"))[1]


KEVDOC = "d AS (SELECT floor(p_partkey / 20)::BIGINT AS doc_id, count(*) AS n, count(DISTINCT p_size) AS u FROM part GROUP BY 1)"


@query("s09_read_kev", f"""WITH {KEVDOC} SELECT doc_id, concat_ws(',', CASE WHEN doc_id % 7 = 3 THEN 'count-mismatch' END, CASE WHEN u < n THEN 'duplicate-cve' END, CASE WHEN doc_id % 5 = 1 THEN 'bad-date' END) AS problems FROM d""")
def _(t):
    docs = (t.part.groupBy(F.floor(F.col("p_partkey") / 20).alias("doc_id")).agg(F.count("*").alias("n"), F.collect_list(F.struct(
        F.concat(F.lit("CVE-2023-"), F.lpad(F.col("p_size").cast("string"), 5, F.lit("0"))).alias("cveID"),
        F.when(F.floor(F.col("p_partkey") / 20) % 5 == 1, F.lit("2030-01-01")).otherwise(F.lit("2024-01-01")).alias("dateAdded"))).alias("v"))
        .select("doc_id", F.to_json(F.struct(F.lit("v1").alias("catalogVersion"), F.lit("2025-01-01T00:00:00Z").alias("dateReleased"), (F.col("n") + F.when(F.col("doc_id") % 7 == 3, 1).otherwise(0)).alias("count"), F.col("v").alias("vulnerabilities"))).alias("raw")))
    return intel.parse_kev(docs, F.lit("2025-06-01").cast("date"))[1].select("doc_id", F.array_join("problems", ",").alias("problems"))


@query("s11_read_graph", """
SELECT 'g' || floor(c_custkey / 20)::BIGINT AS repo, 'c' || c_custkey AS source, 'c' || (c_custkey + 1) AS target, 'imports' AS relation FROM customer WHERE c_custkey % 3 <> 0""")
def _(t):
    k = F.col("c_custkey")
    docs = (t.customer.groupBy(F.concat(F.lit("g"), F.floor(k / 20)).alias("repo")).agg(
        F.collect_list(F.struct(F.concat(F.lit("c"), k).alias("id"), F.lit("f").alias("source_file"))).alias("nodes"),
        F.collect_list(F.struct(F.concat(F.lit("c"), k).alias("source"), F.concat(F.lit("c"), k + 1).alias("target"), F.when(k % 3 == 0, F.lit("contains")).otherwise(F.lit("imports")).alias("relation"))).alias("links"))
        .select("repo", F.to_json(F.struct("nodes", "links")).alias("raw")))
    return intel.parse_graph(docs)[1]


@query("j02_suffix_match", """
SELECT DISTINCT repo, CASE finding_id % 4 WHEN 0 THEN 'src/lib' || (finding_id % 90) || '/m' || finding_id || '.py' WHEN 1 THEN 'repo/src/lib' || (finding_id % 90) || '/m' || finding_id || '.py' ELSE 'other/m' || finding_id || '.py' END AS place,
 'src/lib' || (finding_id % 90) || '/m' || finding_id || '.py' AS source_file FROM graph_findings WHERE finding_id % 4 < 3""")
def _(t):
    return gr.suffix_match(t.graph_findings, t.graph_nodes)


@query("j10_blast_radius", """
WITH RECURSIVE e AS (SELECT DISTINCT repo, source, target FROM graph_edges WHERE relation <> 'contains'), s AS (SELECT DISTINCT repo, 'c' || finding_id AS id FROM graph_findings WHERE finding_id % 4 < 3),
 w AS (SELECT repo, id AS seed, id FROM s UNION SELECT w.repo, w.seed, e.source FROM w JOIN e ON e.repo = w.repo AND e.target = w.id)
SELECT repo, seed, count(*) - 1 AS blast_radius, false AS truncated FROM w GROUP BY 1, 2""")
def _(t):
    b = gr.blast_radius(t.graph_findings, t.graph_nodes, t.graph_edges)
    return b.select("repo", F.concat(F.lit("c"), F.regexp_extract("place", r"m(\d+)\.py", 1)).alias("seed"), "blast_radius", "truncated")


@query("j17_registry_plan", """
WITH d AS (SELECT 'repo' || (l_suppkey % 30) AS repo, CASE l_partkey % 2 WHEN 0 THEN 'npm' ELSE 'pip' END AS ecosystem, CASE l_partkey % 6 WHEN 0 THEN '@priv/x' || (l_partkey % 9) WHEN 1 THEN 'Lib' || (l_partkey % 9) WHEN 2 THEN 'local' || (l_partkey % 5) WHEN 3 THEN 'Bad Name' ELSE 'lib' || (l_partkey % 50) END AS name FROM lineitem),
 u AS (SELECT DISTINCT repo, ecosystem, lower(name) AS name FROM d)
SELECT repo, ecosystem, name, CASE WHEN name LIKE 'local%' AND substr(name, 6)::INT % 2 = 0 THEN 'local' WHEN name LIKE '@priv%' AND substr(repo, 5)::INT % 2 = 0 THEN 'private-scope' WHEN ecosystem = 'pip' AND substr(repo, 5)::INT % 3 = 0 THEN 'private-index' WHEN name = 'bad name' THEN 'invalid-name' END AS suppressed_reason FROM u""")
def _(t):
    return _registry(t).select("repo", "ecosystem", F.lower("name").alias("name"), "suppressed_reason")


def _registry(t):
    d = t.sql("""SELECT 'repo' || cast(l_suppkey % 30 AS string) AS repo, CASE l_partkey % 2 WHEN 0 THEN 'npm' ELSE 'pip' END AS ecosystem, CASE l_partkey % 6 WHEN 0 THEN '@priv/x' || cast(l_partkey % 9 AS string) WHEN 1 THEN 'Lib' || cast(l_partkey % 9 AS string)
      WHEN 2 THEN 'local' || cast(l_partkey % 5 AS string) WHEN 3 THEN 'Bad Name' ELSE 'lib' || cast(l_partkey % 50 AS string) END AS name, 'f' AS file FROM lineitem""")
    repos = t.sql("SELECT DISTINCT 'repo' || cast(s_suppkey % 30 AS string) AS repo, s_suppkey % 30 AS k FROM supplier")
    local = repos.select("repo", F.explode(F.array(F.lit("local0"), F.lit("local2"), F.lit("local4"))).alias("name"))
    return en.registry_plan(d, local, repos.filter("k % 2 = 0").select("repo", F.lit("priv").alias("scope")), repos.filter("k % 3 = 0").select("repo"))


@query("j17_registry_class", """
WITH d AS (SELECT DISTINCT 'repo' || (l_suppkey % 30) AS repo, l_suppkey % 30 AS r, CASE l_partkey % 2 WHEN 0 THEN 'npm' ELSE 'pip' END AS ecosystem, 'lib' || (l_partkey % 50) AS name, l_partkey % 50 AS k FROM lineitem WHERE l_partkey % 6 IN (4, 5)),
 o AS (SELECT * FROM d WHERE NOT (ecosystem = 'pip' AND r % 3 = 0) AND NOT (ecosystem = 'pip' AND EXISTS (SELECT 1 FROM lineitem WHERE l_suppkey % 30 = r AND l_partkey % 6 = 1 AND l_partkey % 9 = k)))
SELECT repo, ecosystem, name, CASE k % 3 WHEN 0 THEN 'exists' WHEN 1 THEN 'missing' ELSE 'unknown' END AS state, CASE WHEN k % 3 = 1 THEN CASE WHEN r % 2 = 0 THEN 'unpublished-or-removed' ELSE 'nonexistent' END END AS class FROM o""")
def _(t):
    index = t.sql("SELECT DISTINCT x.e AS ecosystem, 'lib' || cast(p_partkey % 50 AS string) AS name, p_partkey % 50 % 3 = 0 AS known FROM part CROSS JOIN (VALUES ('npm'), ('pip')) AS x(e) WHERE p_partkey % 50 % 3 < 2")
    locks = t.sql("SELECT DISTINCT 'repo' || cast(s_suppkey % 30 AS string) AS repo, 'lib' || cast(p_partkey % 50 AS string) AS name, s_suppkey % 30 % 2 = 0 AS resolved FROM supplier CROSS JOIN part WHERE p_partkey < 50")
    plan = _registry(t).filter("lower(name) LIKE 'lib%' AND NOT name LIKE 'Lib%'")
    return en.registry_class(plan, index, locks).select("repo", "ecosystem", "name", "state", "class")


# Coverage and gate -------------------------------------------------------------------------------

@query("a14_input_digest", """
WITH h AS (SELECT repo, sha256(concat_ws(chr(1), path, sha256)) AS h FROM sized_files), s AS (SELECT repo, count(*) AS n, sum(('0x' || substr(h, 1, 15))::HUGEINT) AS a, sum(('0x' || substr(h, 16, 15))::HUGEINT) AS b, sum(('0x' || substr(h, 31, 15))::HUGEINT) AS c, sum(('0x' || substr(h, 46, 15))::HUGEINT) AS d FROM h GROUP BY 1)
SELECT repo, sha256(concat_ws('|', n, a, b, c, d)) AS input_digest, n AS inputs FROM s""")
def _(t):
    return cov.input_digest(t.sized_files)


@query("a14_scope_digest", """
SELECT repo, sha256('{"detector_revision":"r1","excludes":"' || (repo LIKE '%1') || '","profile":"static"}') AS digest FROM (SELECT DISTINCT repo FROM sized_files)""")
def _(t):
    c = t.sized_files.select("repo").distinct().select("repo", F.lit("static").alias("profile"), F.lit("r1").alias("detector_revision"), F.endswith("repo", F.lit("1")).cast("string").alias("excludes"))
    return c.select("repo", cov.scope_digest(c).alias("digest"))


COVERAGE = """f AS (SELECT repo, analysable, CASE WHEN n_bytes > 400000 THEN 'oversized' ELSE 'ok' END AS st FROM sized_files), o AS (SELECT repo, count(*) AS n FROM detector_outcomes WHERE outcome <> 'completed' GROUP BY 1),
 g AS (SELECT repo, 'oversized' AS kind, count(*) AS affected, true AS execution FROM f WHERE st <> 'ok' GROUP BY 1 UNION ALL SELECT repo, 'detector', n, true FROM o UNION ALL SELECT repo, 'unsupported_source', count(*), false FROM f WHERE st = 'ok' AND NOT analysable GROUP BY 1)"""


def _coverage(t):
    return cov.coverage_rows(src.classify_read(t.sized_files, 400_000, 1 << 60), t.detector_outcomes)


@query("a13_coverage_row", f"""WITH {COVERAGE}, x AS (SELECT repo, bool_or(execution) AS x FROM g GROUP BY 1)
SELECT f.repo, count(*) AS seen, count(*) FILTER (st = 'ok') AS read, count(*) FILTER (st = 'ok' AND analysable) AS scanned, NOT coalesce(any_value(x.x), false) AS execution_complete, count(*) FILTER (st = 'ok' AND analysable) = 0 AS no_analyzable_source FROM f LEFT JOIN x ON x.repo = f.repo GROUP BY 1""")
def _(t):
    return _coverage(t)[0]


@query("a13_coverage_gaps", f"WITH {COVERAGE} SELECT * FROM g")
def _(t):
    return _coverage(t)[1]


@query("a15_execution_errors", """
WITH c AS (SELECT c_custkey AS repo, c_custkey % 2 = 0 AS done, c_custkey % 3 AS gaps, c_custkey % 5 AS seen, c_custkey % 7 AS read, c_custkey % 4 AS scanned FROM customer)
SELECT repo, concat_ws(',', CASE WHEN done AND gaps > 0 THEN 'complete-with-execution-gap' END, CASE WHEN NOT done AND gaps = 0 THEN 'incomplete-without-gap' END, CASE WHEN read > seen THEN 'read-exceeds-seen' END, CASE WHEN scanned > read THEN 'scanned-exceeds-read' END,
 CASE WHEN read > 0 AND repo % 11 = 0 THEN 'digest-missing' END, CASE WHEN NOT done THEN 'not-complete' END) AS errors FROM c""")
def _(t):
    c = t.sql("SELECT c_custkey AS repo, c_custkey % 2 = 0 AS execution_complete, c_custkey % 3 AS execution_gaps, c_custkey % 5 AS seen, c_custkey % 7 AS read, c_custkey % 4 AS scanned, CASE WHEN c_custkey % 11 <> 0 THEN 'd' END AS input_digest FROM customer")
    return cov.execution_errors(c).select("repo", F.array_join("errors", ",").alias("errors"))


# Evidence of 400 repos, a row for each order; every constraint has rows that violate it and rows that do not.
COVERAGE_EVIDENCE = f"""SELECT o_custkey % 400 AS repo, CASE WHEN o_orderkey % 5 = 0 THEN 'claim' WHEN o_orderkey % 37 = 0 THEN NULL ELSE element_at(array('gap', 'read', 'bytes', 'check', 'scanner', 'import', 'route', 'profile', 'other'), cast(o_orderkey % 9 + 1 AS int)) END AS area, 'i' || (o_orderkey % 23) AS item,
 CASE WHEN o_orderkey % 3 > 0 THEN 'completed' WHEN o_orderkey % 7 = 1 THEN 'manual' WHEN o_orderkey % 7 > 1 THEN 'failed' END AS outcome, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 4 = 0 END AS execution, CASE WHEN o_orderkey % 13 > 0 THEN o_orderkey % 2 = 0 END AS selected,
 o_orderkey % 17 > 0 AS installed, CASE WHEN o_orderkey % 19 > 0 THEN TRUE END AS runnable, o_orderkey % 29 > 0 AS ran, CASE WHEN o_orderkey % 31 > 0 THEN CASE WHEN o_orderkey % 6 = 0 THEN 2 ELSE 0 END END AS errors, CASE WHEN o_orderkey % 8 > 0 THEN o_orderkey % 10 - 1 END AS amount,
 CASE WHEN o_orderkey % 14 > 0 THEN o_orderkey % 12 - 1 END AS allowed, CASE WHEN o_orderkey % 15 = 0 THEN 1 ELSE 0 END AS truncated FROM orders"""
GOOD = "coalesce(outcome = 'completed', false)"


@query("a15_evidence_errors", f"""
WITH e AS ({COVERAGE_EVIDENCE.replace("element_at(array('gap', 'read', 'bytes', 'check', 'scanner', 'import', 'route', 'profile', 'other'), cast(o_orderkey % 9 + 1 AS int))", "(['gap', 'read', 'bytes', 'check', 'scanner', 'import', 'route', 'profile', 'other'])[o_orderkey % 9 + 1]")}),
 h AS (SELECT repo, item, 'not-complete' AS error FROM e WHERE area = 'claim' AND NOT {GOOD}
  UNION ALL SELECT repo, item, 'gap-unclassified' FROM e WHERE area = 'gap' AND execution IS NULL UNION ALL SELECT repo, item, 'execution-gap' FROM e WHERE area = 'gap' AND execution
  UNION ALL SELECT repo, item, 'read-loss' FROM e WHERE area = 'read' AND (amount IS NULL OR amount <> 0) UNION ALL SELECT repo, item, 'selection-truncated' FROM e WHERE area = 'read' AND truncated <> 0
  UNION ALL SELECT repo, item, 'bytes-invalid' FROM e WHERE area = 'bytes' AND amount < 0 UNION ALL SELECT repo, item, 'limit-invalid' FROM e WHERE area = 'bytes' AND allowed < 0 UNION ALL SELECT repo, item, 'bytes-over-limit' FROM e WHERE area = 'bytes' AND amount > allowed
  UNION ALL SELECT repo, item, 'check-incomplete' FROM e WHERE area = 'check' AND NOT {GOOD} UNION ALL SELECT repo, item, 'check-reported-errors' FROM e WHERE area = 'check' AND errors <> 0
  UNION ALL SELECT repo, item, 'selection-unknown' FROM e WHERE area = 'scanner' AND selected IS NULL UNION ALL SELECT repo, item, 'scanner-incomplete' FROM e WHERE area = 'scanner' AND selected AND NOT ({GOOD} AND ran AND installed AND coalesce(runnable, false))
  UNION ALL SELECT repo, item, 'scanner-reported-errors' FROM e WHERE area = 'scanner' AND selected AND errors <> 0
  UNION ALL SELECT repo, item, 'import-incomplete' FROM e WHERE area = 'import' AND NOT ({GOOD} AND ran) UNION ALL SELECT repo, item, 'import-gap' FROM e WHERE area = 'import' AND {GOOD} AND ran AND (coalesce(execution, false) OR coalesce(errors, 0) <> 0)
  UNION ALL SELECT repo, item, 'route-errors' FROM e WHERE area = 'route' AND errors <> 0 UNION ALL SELECT repo, item, 'route-diagnostics-truncated' FROM e WHERE area = 'route' AND truncated <> 0 UNION ALL SELECT repo, item, 'route-gap' FROM e WHERE area = 'route' AND execution
  UNION ALL SELECT repo, item, 'route-count-invalid' FROM e WHERE area = 'route' AND amount < 0 UNION ALL SELECT repo, item, 'route-limit-invalid' FROM e WHERE area = 'route' AND allowed < 0
  UNION ALL SELECT repo, item, 'profile-check-failed' FROM e WHERE area = 'profile' AND coalesce(outcome, 'none') NOT IN ('completed', 'manual') UNION ALL SELECT repo, item, 'area-unknown' FROM e WHERE area IS NULL OR area = 'other'),
 r AS (SELECT repo, count(*) FILTER (area = 'claim') AS claims, count(*) FILTER (area = 'claim' AND {GOOD}) AS yes FROM e GROUP BY 1), bad AS (SELECT DISTINCT repo FROM h WHERE error <> 'not-complete'),
 x AS (SELECT * FROM h UNION ALL SELECT repo, NULL, 'claim-missing' FROM r WHERE claims = 0 UNION ALL SELECT repo, NULL, 'claims-disagree' FROM r WHERE yes > 0 AND yes < claims UNION ALL SELECT repo, NULL, 'claimed-complete-despite' FROM r SEMI JOIN bad USING (repo) WHERE yes > 0
  UNION ALL SELECT repo, item, 'reads-disagree' FROM e WHERE area = 'bytes' GROUP BY repo, item HAVING min(amount) < max(amount))
SELECT repo, error, count(*) AS items, min(item) AS example FROM x GROUP BY 1, 2""")
def _(t):
    return cov.evidence_errors(t.sql(COVERAGE_EVIDENCE))


@query("a16_scanner_outcomes", """
WITH b AS (SELECT c_custkey AS repo, 't' AS tool, c_custkey % 2 = 0 AS i, c_custkey % 3 <> 0 AS q, c_custkey % 5 <> 0 AS r, c_custkey % 7 AS m, c_custkey % 11 AS v FROM customer), x AS (SELECT * FROM b WHERE i OR q OR r)
SELECT repo, tool, CASE WHEN NOT q THEN CASE WHEN i THEN 'not_selected' ELSE 'unavailable' END WHEN NOT i THEN 'unavailable' WHEN repo % 13 = 0 THEN 'unsupported_adapter' WHEN NOT r THEN 'not_run' WHEN m = 0 THEN 'timeout' WHEN m = 1 OR v = 1 THEN 'error' WHEN v = 2 THEN 'parse_failed'
 WHEN v = 4 THEN 'missing_output' WHEN v = 3 THEN 'partial' ELSE 'completed' END AS outcome FROM x""")
def _(t):
    inst = t.sql("SELECT c_custkey AS repo, 't' AS tool, c_custkey % 13 <> 0 AS runnable FROM customer WHERE c_custkey % 2 = 0")
    req = t.sql("SELECT c_custkey AS repo, 't' AS tool FROM customer WHERE c_custkey % 3 <> 0")
    res = t.sql("SELECT c_custkey AS repo, 't' AS tool, CASE c_custkey % 7 WHEN 0 THEN 'timeout' WHEN 1 THEN 'crash' END AS status FROM customer WHERE c_custkey % 5 <> 0")
    val = t.sql("SELECT c_custkey AS repo, 't' AS tool, CASE c_custkey % 11 WHEN 1 THEN 'error' WHEN 2 THEN 'wrong_shape' WHEN 3 THEN 'partial' ELSE 'ok' END AS outcome FROM customer WHERE c_custkey % 11 <> 4")
    return cov.scanner_outcomes(inst, req, res, val)


@query("a17_thin_languages", "SELECT DISTINCT 'repo' || (o_custkey % 40) AS repo, 'rust' AS language FROM orders WHERE o_orderkey % 17 = 3")
def _(t):
    s = t.sql("SELECT 'repo' || cast(o_custkey % 40 AS string) AS repo, CASE WHEN o_orderkey % 17 = 3 THEN 'rust' ELSE 'python' END AS language FROM orders")
    return cov.thin_languages(s, t.sql("SELECT * FROM (VALUES ('python'), ('java')) AS c(language)"))


@query("a18_profile_status", """
WITH s AS (SELECT 'r' || (c_custkey % 50) AS repo, 's' || c_custkey AS service_id, c_custkey % 3 <> 0 AS examined FROM customer), c(check_id, automated) AS (VALUES ('a', true), ('b', false)),
 o AS (SELECT 's' || (l_orderkey % 1500) AS service_id, count(*) AS n FROM lineitem WHERE l_partkey % 9 = 0 GROUP BY 1)
SELECT s.repo, s.service_id, check_id, CASE WHEN NOT automated THEN 'manual' WHEN examined THEN 'completed' ELSE 'unknown' END AS status, CASE WHEN check_id = 'a' THEN coalesce(n, 0) ELSE 0 END AS findings FROM s CROSS JOIN c LEFT JOIN o ON o.service_id = s.service_id""")
def _(t):
    s = t.sql("SELECT 'r' || cast(c_custkey % 50 AS string) AS repo, 's' || cast(c_custkey AS string) AS service_id, 'node' AS profile, c_custkey % 3 <> 0 AS examined FROM customer")
    c = t.sql("SELECT * FROM (VALUES ('a', 'node', true), ('b', 'node', false)) AS c(check_id, profile, automated)")
    o = t.sql("SELECT 'r' || cast((l_orderkey % 1500) % 50 AS string) AS repo, 's' || cast(l_orderkey % 1500 AS string) AS service_id, 'a' AS check_id FROM lineitem WHERE l_partkey % 9 = 0")
    return cov.profile_status(s, c, o)


@query("a19_proof_score", """
WITH e AS (SELECT s_suppkey % 40 AS app, 'm' || s_suppkey AS metric, s_nationkey AS minimum FROM supplier), f AS (SELECT s_suppkey % 40 AS app, 'm' || s_suppkey AS metric, 12 AS value, s_suppkey % 40 % 7 <> 0 AS complete FROM supplier WHERE s_suppkey % 9 <> 8),
 j AS (SELECT e.app, coalesce(value >= minimum, false) AS ok, coalesce(complete, false) AS complete FROM e LEFT JOIN f USING (app, metric)), g AS (SELECT app, count(*) FILTER (ok) AS passed, count(*) AS total, bool_and(complete) AS c FROM j GROUP BY 1)
SELECT app, passed, total, CASE WHEN NOT c THEN 'unknown' WHEN passed = total THEN 'passed' ELSE 'failed' END AS state FROM g""")
def _(t):
    e = t.sql("SELECT s_suppkey % 40 AS app, 'm' || cast(s_suppkey AS string) AS metric, s_nationkey AS minimum FROM supplier")
    f = t.sql("SELECT s_suppkey % 40 AS app, 'm' || cast(s_suppkey AS string) AS metric, 12 AS value, s_suppkey % 40 % 7 <> 0 AS complete FROM supplier WHERE s_suppkey % 9 <> 8")
    return cov.proof_score(e, f)


SCOPE = """w AS (SELECT DISTINCT repo, rtrim(entry, '/') AS entry FROM requested_paths), k AS (SELECT DISTINCT repo FROM w), e AS (SELECT DISTINCT repo, file FROM ledger WHERE finding_id % 4 = 0),
 sc AS (SELECT l.*, CASE WHEN k.repo IS NULL OR EXISTS (SELECT 1 FROM w WHERE w.repo = l.repo AND (l.file = w.entry OR starts_with(l.file, w.entry || '/'))) THEN 'in-scope' WHEN e.file IS NOT NULL THEN 'outside-scope' ELSE 'unattributed' END AS scope
   FROM ledger l LEFT JOIN k ON k.repo = l.repo LEFT JOIN e ON e.repo = l.repo AND e.file = l.file)"""


def _scoped(t):
    req = t.requested_paths.select("repo", F.regexp_replace("entry", "/+$", "").alias("path"))
    files = t.ledger.filter("finding_id % 4 = 0").select("repo", F.col("file").alias("path")).distinct()
    return cov.gate_scope(t.ledger, req, files)


@query("j21_gate_scope", f"WITH {SCOPE} SELECT finding_id, scope FROM sc")
def _(t):
    return _scoped(t).select("finding_id", "scope")


@query("a25_gate_verdict", f"""WITH {SCOPE}, g AS (SELECT repo, count(*) FILTER (status <> 'acknowledged' AND scope <> 'outside-scope' AND {sev('severity')} >= 3) AS blocking, count(*) FILTER (status <> 'acknowledged' AND scope = 'outside-scope') AS outside_scope,
  count(*) FILTER (status = 'acknowledged') AS acknowledged FROM sc GROUP BY 1), c AS (SELECT DISTINCT repo, CASE WHEN repo LIKE '%7' THEN 1 ELSE 0 END AS execution_errors FROM ledger),
 m AS (SELECT repo, count(*) AS missed FROM w WHERE entry = 'nope' GROUP BY 1)
SELECT c.repo, execution_errors, coalesce(blocking, 0) AS blocking, coalesce(outside_scope, 0) AS outside_scope, coalesce(acknowledged, 0) AS acknowledged, coalesce(missed, 0) AS missed, coalesce(blocking, 0) = 0 AND execution_errors = 0 AS passed FROM c LEFT JOIN g USING (repo) LEFT JOIN m USING (repo)""")
def _(t):
    c = t.ledger.select("repo").distinct().select("repo", F.when(F.endswith("repo", F.lit("7")), F.array(F.lit("not-complete"))).otherwise(F.array().cast("array<string>")).alias("errors"))
    missed = t.requested_paths.filter("entry = 'nope'").select("repo", F.col("entry").alias("path")).distinct()
    return cov.gate_verdict(_scoped(t), c, missed, "HIGH")


@query("a21_evidence_inventory", """
WITH r AS (SELECT c_custkey AS repo, c_custkey % 2 = 0 AS a, c_custkey % 3 = 0 AS b, c_custkey % 5 = 0 AS c FROM customer)
SELECT repo, unnest(['secure-development', 'dependency-review', 'secret-scanning', 'dynamic-testing', 'change-attribution', 'exception-review']) AS control,
 unnest([CASE WHEN a THEN 'present' ELSE 'gap' END, CASE WHEN b THEN 'present' ELSE 'gap' END, CASE WHEN c THEN 'present' ELSE 'gap' END, 'gap', 'gap', CASE WHEN a THEN 'present' ELSE 'gap' END]) AS state FROM r""")
def _(t):
    r = t.sql("SELECT c_custkey AS repo, c_custkey % 2 = 0 AS static_analysis, c_custkey % 3 = 0 AS sca_scan, c_custkey % 5 = 0 AS secret_scan, cast(NULL AS boolean) AS dynamic_run, false AS attribution, c_custkey % 2 = 0 AS acknowledgements FROM customer")
    return cov.evidence_inventory(r)


@query("a22_scope_proposal", """
WITH d AS (SELECT repo, CASE WHEN file LIKE 'docs/%' THEN 'docs/' WHEN file LIKE 'tests/%' THEN 'tests/' WHEN file LIKE 'scripts/%' THEN 'scripts/' END AS path, category, finding_id FROM ledger)
SELECT repo, path, count(*) AS files, count(*) AS findings, CASE WHEN bool_and(category = 'secret') THEN 'acknowledge' ELSE 'glob' END AS mode FROM d WHERE path IS NOT NULL GROUP BY 1, 2""")
def _(t):
    return cov.scope_proposal(t.ledger.select("repo", F.col("file").alias("path")), t.ledger)


# Repairs -----------------------------------------------------------------------------------------

@query("p19_repair_plans", """
SELECT l.finding_id, sha256('{"application_id":"app","attack_class":"' || attack_class || '","build_id":"b1","disposition":"human-required","file":"' || file || '","fingerprint":"f' || finding_id || '","scope_digest":"s","source_digest":"d' || repo || '"}') AS plan_id FROM ledger l""")
def _(t):
    ctx = t.ledger.select("repo").distinct().select("repo", F.lit("app").alias("application_id"), F.lit("b1").alias("build_id"), F.concat(F.lit("d"), "repo").alias("source_digest"), F.lit("s").alias("scope_digest"))
    p = rep.repair_plans(t.ledger.withColumn("fingerprint", F.concat(F.lit("f"), F.col("finding_id").cast("string"))), ctx)
    return p.select(F.substring("fingerprint", 2, 20).cast("bigint").alias("finding_id"), "plan_id")


@query("j22_verify_repair", """
WITH p AS (SELECT o_orderkey AS k, 'r' || (o_custkey % 9) AS repo FROM orders)
SELECT repo, 'p' || k AS plan_id, concat_ws(',', CASE WHEN k % 19 = 0 THEN 'application-changed' END, CASE WHEN k % 17 = 0 THEN 'source-unchanged' END, CASE WHEN k % 17 = 0 OR substr(repo, 2)::INT = 3 THEN 'coverage-incomplete' END, CASE WHEN k % 17 = 0 OR substr(repo, 2)::INT = 4 THEN 'scope-differs' END,
 CASE WHEN k % 13 = 0 AND k % 17 <> 0 THEN 'still-observed' END, CASE WHEN k % 11 = 0 THEN 'positive-test-missing' END, CASE WHEN k % 7 = 0 OR k % 5 = 0 THEN 'negative-test-missing' END, CASE WHEN k % 5 = 0 THEN 'failing-test' END) AS errors FROM p""")
def _(t):
    k = "cast(o_orderkey AS string)"
    plans = t.sql(f"SELECT 'r' || cast(o_custkey % 9 AS string) AS repo, 'p' || {k} AS plan_id, 'f' || {k} AS fingerprint, 'app' AS application_id, 'old' AS source_digest, 's' AS scope_digest FROM orders")
    rec = t.sql(f"SELECT 'r' || cast(o_custkey % 9 AS string) AS repo, 'p' || {k} AS plan_id, CASE WHEN o_orderkey % 19 = 0 THEN 'x' ELSE 'app' END AS application_id, 'b2' AS build_id, CASE WHEN o_orderkey % 17 = 0 THEN 'old' ELSE 'new' END AS source_digest FROM orders")
    rerun = t.sql(f"SELECT 'r' || cast(o_custkey % 9 AS string) AS repo, 'new' AS source_digest, 'z' || {k} AS fingerprint, array('f' || {k}) AS fingerprint_aliases FROM orders WHERE o_orderkey % 13 = 0")
    c = t.sql("SELECT DISTINCT 'r' || cast(o_custkey % 9 AS string) AS repo, 'new' AS source_digest, CASE WHEN o_custkey % 9 = 4 THEN 'other' ELSE 's' END AS scope_digest, o_custkey % 9 <> 3 AS execution_complete FROM orders")
    tests = t.sql(f"""SELECT 'r' || cast(o_custkey % 9 AS string) AS repo, 'p' || {k} AS plan_id, 't' AS test_id, x.kind, x.build, CASE WHEN x.build = 'original' THEN 'failed' ELSE 'passed' END AS status, CASE WHEN x.build = 'original' OR (x.kind = 'negative' AND o_orderkey % 5 = 0) THEN 1 ELSE 0 END AS failed, 3 AS test_count
      FROM orders CROSS JOIN (VALUES ('positive', 'fixed'), ('negative', 'fixed'), ('negative', 'original')) AS x(kind, build)
      WHERE NOT (x.kind = 'positive' AND o_orderkey % 11 = 0) AND NOT (x.build = 'original' AND o_orderkey % 7 = 0)""")
    return rep.verify_repair(plans, rec, rerun, c, tests).select("repo", "plan_id", F.array_join("errors", ",").alias("errors"))


# Export ------------------------------------------------------------------------------------------

@query("s15_write_sarif", f"""
SELECT repo, count(*) AS results, count(*) FILTER ({sev('severity')} >= 3) AS errors, count(*) FILTER (status = 'acknowledged') AS suppressed, count(DISTINCT attack_class) AS classes FROM ledger GROUP BY 1""")
def _(t):
    """Every log is parsed again, so the totals prove that the logs are valid and whole."""
    logs = ex.sarif_logs(life.annotate(t.ledger), size=50)
    d = logs.select("repo", F.from_json("json", "runs array<struct<results array<struct<ruleId string, level string, suppressions array<struct<kind string>>>>>>").alias("d"))
    r = d.select("repo", F.explode(F.col("d.runs")[0]["results"]).alias("r"))
    return r.groupBy("repo").agg(F.count("*").alias("results"), F.count_if(F.col("r.level") == "error").alias("errors"), F.count_if(F.size("r.suppressions") > 0).alias("suppressed"), F.count_distinct("r.ruleId").alias("classes"))


@query("s16_write_envelope", "SELECT repo, count(*) AS findings, count(*) AS total, count(*) FILTER (severity = 'CRITICAL') AS critical FROM ledger GROUP BY 1")
def _(t):
    e = ex.envelopes(life.annotate(t.ledger), size=50).select("repo", F.from_json("json", "summary struct<total: bigint, critical: bigint>, findings array<struct<finding_id: bigint>>").alias("d"))
    return e.groupBy("repo").agg(F.sum(F.size("d.findings")).alias("findings"), F.max("d.summary.total").alias("total"), F.max("d.summary.critical").alias("critical"))


@query("s17_grades_csv", r"""
SELECT CASE WHEN regexp_matches(cell, '^[=+\-@]') THEN '''' || cell ELSE cell END AS cell, count(*) AS n FROM (SELECT CASE l_linenumber % 4 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN '-1+2' WHEN 2 THEN '@x' ELSE 'plain ' || l_returnflag END AS cell FROM lineitem) GROUP BY 1""")
def _(t):
    c = t.sql("SELECT CASE l_linenumber % 4 WHEN 0 THEN '=SUM(A1)' WHEN 1 THEN '-1+2' WHEN 2 THEN '@x' ELSE 'plain ' || l_returnflag END AS cell FROM lineitem")
    return ex.grades_csv(c).groupBy("cell").agg(F.count("*").alias("n"))


@query("p17_redact", "SELECT attack_class, severity, CASE WHEN file LIKE '%.env.example' THEN '.example' ELSE regexp_extract(file, '(\\.[a-z]+)$', 1) END AS extension, count(*) AS n FROM ledger GROUP BY 1, 2, 3")
def _(t):
    return ex.redact(t.ledger).groupBy("attack_class", "severity", "extension").agg(F.count("*").alias("n"))


@query("f16_extension_hint", r"SELECT path, coalesce(nullif(lower(regexp_extract(path, '(\.[A-Za-z0-9]+)$', 1)), ''), '(none)') AS hint FROM sized_files")
def _(t):
    return t.sized_files.select("path", ex.extension_hint(F.col("path")).alias("hint"))


@query("f17_attribution_assurance", "SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN 'ci-verified' WHEN c_custkey % 3 = 0 THEN 'vcs-recorded' WHEN c_custkey % 5 = 0 THEN 'self-declared' ELSE 'unattributed' END AS assurance FROM customer")
def _(t):
    k = F.col("c_custkey")
    return t.customer.select("c_custkey", ex.attribution_assurance(k % 2 == 0, k % 3 == 0, k % 5 == 0).alias("assurance"))


RANKED = f"r AS (SELECT *, row_number() OVER (PARTITION BY repo ORDER BY {sev('severity')} DESC, {conf('confidence')} DESC, finding_id) AS position FROM ledger)"


@query("w06_fix_queue", f"WITH {RANKED} SELECT repo, position, finding_id, 'Fix ' || attack_class || ' (' || severity || ') at ' || location || ': ' || title || '. Verify the change before closing.' AS prompt FROM r WHERE position <= 12")
def _(t):
    return ex.fix_queue(t.ledger)


@query("w05_triage_order", "SELECT finding_id, severity, CASE confidence WHEN 'HIGH' THEN 0.85 WHEN 'MEDIUM' THEN 0.5 ELSE 0.25 END::DOUBLE AS p FROM ledger")
def _(t):
    cells = wilson_cells(t.finding_labels).filter("false")
    f = calibrate(t.ledger, cells).withColumn("disposition", std.disposition(F.col("attack_class")))
    return fnd.triage_order(f).select("finding_id", "severity", "p")


# Whole flows ---------------------------------------------------------------------------------------

@query("ledger_end_to_end", None)
def _(t):
    """Scanner rows, sink leads and a pack to one ledger: merged, demoted, suppressed, calibrated, ranked per repo."""
    from ..operators import policy as pol
    from ..operators.core import cut_lineage
    from ..operators.detect import engine, packs
    from ..operators.detect import rules as R
    gates = packs.datastore_gates(packs.stack(t.manifest_files))
    scan = fnd.dedupe_findings(fnd.fixture_demote(fnd.placeholder_demote(fnd.merge_scan_modes(t.scan_findings))).drop("placeholder_tier", "in_fixture"))
    scan = scan_to_ledger(scan.withColumn("tool", F.get("tools", F.lit(0)))).withColumn("location", F.concat_ws(":", "file", F.col("line").cast("string"))).drop("fingerprint", "advisory_aliases", "tools")
    sinks = sinks_to_ledger(packs.sinks(t.code_files, gates), gates)
    crypto = pack_to_ledger(engine.file_findings(engine.with_roles(t.code_files), R.CRYPTO), "authn")
    keep = ["repo", "attack_class", "category", "severity", "confidence", "location", "file", "line", "rule_id", "semantic_id", "title", "status", "cve", "pkg"]
    ledger = union_ledger([df.select(*[c for c in keep if c in df.columns]) for df in (scan, sinks, crypto)])
    # Where suppression reads its input several times, the narrow ledger is written once instead of scanning texts again.
    ledger = pol.suppress(life.annotate(ledger), pol.read_policy(t.policy_files)[0], cut_lineage).filter("NOT suppressed")
    ledger = calibrate(ledger, wilson_cells(t.finding_labels))
    return fnd.top_findings(ledger, 15, tiebreak=("fingerprint", "location")).select("repo", "position", "fingerprint", "attack_class", "severity", "confidence", "p", "basis", "location")


def _flagship_sql():
    from ..operators.detect import rules as R
    from .queries_detect import rules_sql
    from .queries_ledger import CALIBRATED, CELLS
    est = CALIBRATED.replace("FROM finding_labels f", "FROM v f").replace("f.doc_id, f.attack_class", "f.doc_id, f.rule_id, f.severity, f.value_digest, f.copies, f.first_doc, f.attack_class").replace("f.is_real,", "")
    return f"""WITH {CELLS}, occ AS ({rules_sql("doc_texts", R.TEXT_SHAPES)}),
 g AS (SELECT repo, rule_id, severity, sha256(expression) AS value_digest, count(*) AS copies, min(path) AS first_doc FROM occ GROUP BY 1, 2, 3, 4),
 n AS (SELECT attack_class, confidence, count(*) AS n FROM finding_labels GROUP BY 1, 2), b AS (SELECT attack_class, arg_max(confidence, (n, confidence)) AS confidence FROM n GROUP BY 1),
 v AS (SELECT g.repo AS doc_id, g.rule_id, g.severity, g.value_digest, g.copies, g.first_doc, g.repo AS attack_class, b.confidence FROM g LEFT JOIN b ON b.attack_class = g.repo), {est},
 r AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY {sev('severity')} DESC, {conf('confidence')} DESC, value_digest, rule_id) AS position FROM e)
SELECT doc_id AS repo, position, rule_id, severity, value_digest, copies, first_doc, p, ci_lo, ci_hi, basis FROM r WHERE position <= 15"""


@query("flagship_value_leaks", _flagship_sql())
def _(t):
    """Sources ranked by de-duplicated value leaks with the probability that a leak is real."""
    from ..operators.detect import packs
    occ = packs.text_leaks(t.doc_texts)
    dedup = occ.groupBy("repo", "rule_id", "severity", F.sha2("expression", 256).alias("value_digest")).agg(F.count("*").alias("copies"), F.min("path").alias("first_doc"))
    by_source = t.finding_labels.groupBy("attack_class", "confidence").agg(F.count("*").alias("_n")).groupBy("attack_class").agg(F.max_by("confidence", F.struct("_n", "confidence")).alias("confidence"))
    f = dedup.withColumn("attack_class", F.col("repo")).join(by_source, "attack_class", "left")
    f = calibrate(f, wilson_cells(t.finding_labels))
    return fnd.top_findings(f, 15, tiebreak=("value_digest", "rule_id")).select("repo", "position", "rule_id", "severity", "value_digest", "copies", "first_doc", "p", "ci_lo", "ci_hi", "basis")
