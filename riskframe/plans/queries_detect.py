"""Detector queries over derived source files, documents and pages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import paths
from ..operators.detect import engine, packs
from ..operators.detect import rules as R
from .catalog import query


def q(text):
    return text.replace("'", "''")


ROLES = f"""is_test AS is_test, is_script, is_client, is_doc, is_example, NOT is_test AS not_test, NOT (is_test OR is_script OR is_client) AS is_server"""
PREP = f"""p AS (SELECT repo, path, content, {ROLES} FROM (SELECT repo, path, content, regexp_matches(path, '(?i){q(paths.TEST_PATH)}') AS is_test, regexp_matches(path, '(?i){q(paths.SCRIPT_PATH)}') AS is_script,
  regexp_matches(path, '(?i){q(paths.CLIENT_PATH)}') OR contains(substr(content, 1, 300), '''use client''') OR contains(substr(content, 1, 300), '"use client"') AS is_client,
  regexp_matches('/' || lower(path), '{q(paths.DOC_PATH)}') AND NOT regexp_matches('/' || lower(path), '{q(paths.NEVER_DOC)}') AS is_doc, regexp_matches(path, '{q(paths.EXAMPLE_NAME)}') AS is_example FROM FILES))"""


def prep(view):
    return PREP.replace("FILES", view)


def rules_sql(view, rules, out="repo, path, line, rule_id, severity, expression, ordinal"):
    """Line-by-line twin of scan_rules: each rule on each line."""
    arms = []
    for r in rules:
        cond = "true"
        if r.suffixes:
            cond = "(" + " OR ".join(f"path LIKE '%{x}'" for x in r.suffixes) + ")"
        if r.where:
            cond += f" AND {r.where}"
        keep = f" WHERE NOT regexp_matches(e, '{q(r.exclude)}')" if r.exclude else ""
        arms.append(f"SELECT * FROM (SELECT repo, path, line, o, '{r.rule_id}' AS rule_id, '{r.severity}' AS severity, e FROM (SELECT *, regexp_extract_all(x, '{q(r.pattern)}') AS m FROM l WHERE {cond}) s, unnest(m) WITH ORDINALITY AS u(e, o)){keep}")
    return (f"WITH {prep(view)}, l AS (SELECT p.* EXCLUDE (content), u.x, u.line FROM p, unnest(string_split(content, chr(10))) WITH ORDINALITY AS u(x, line)), h AS (" + " UNION ALL ".join(arms)
            + f"), z AS (SELECT repo, path, line, rule_id, severity, e AS expression, row_number() OVER (PARTITION BY repo, path, rule_id, e ORDER BY line, o) - 1 AS ordinal FROM h) SELECT {out} FROM z")


OCC = ["repo", "path", "line", "rule_id", "severity", "expression", "ordinal"]


@query("d00_scan_rules", rules_sql("code_files", R.SINKS + R.SECRET_SHAPES + R.NESTED_QUANTIFIER))
def _(t):
    return engine.scan_rules(engine.with_roles(t.code_files), R.SINKS + R.SECRET_SHAPES + R.NESTED_QUANTIFIER).select(*OCC)


STORES = "(CASE name WHEN 'pg' THEN 'postgres' WHEN 'mongoose' THEN 'mongodb' END)"
DEPS = """deps AS (SELECT repo, path, CASE (substr(path, 4, length(path) - 16)::INT % 5) WHEN 0 THEN 'express' WHEN 1 THEN 'react' WHEN 2 THEN 'next' WHEN 3 THEN 'pg' ELSE 'mongoose' END AS name FROM manifest_files WHERE path LIKE '%/package.json')"""


@query("d01_sinks", f"WITH {DEPS}, g AS (SELECT repo, bool_or(name = 'pg') AS has_sql, bool_or(name = 'mongoose') AS has_nosql FROM deps WHERE name IN ('pg', 'mongoose') GROUP BY 1), o AS ("
       + rules_sql("code_files", R.SINKS) + f"), r AS (SELECT repo, path, regexp_matches(content, '{q(R.REQUEST)}') AS req FROM code_files) "
       "SELECT o.* FROM o JOIN r ON r.repo = o.repo AND r.path = o.path LEFT JOIN g ON g.repo = o.repo WHERE req OR (rule_id <> 'sql-injection' OR coalesce(has_sql, false)) AND (rule_id <> 'nosql-injection' OR coalesce(has_nosql, false))")
def _(t):
    return packs.sinks(t.code_files, packs.datastore_gates(packs.stack(t.manifest_files))).select(*OCC)


def pack_sql(view, pack, level="file"):
    flags = ", ".join(f"regexp_matches(content, '{q(p)}') AS {n}" for n, p in pack["flags"].items())
    base = f"WITH {prep(view)}, f AS (SELECT repo, path, is_test, is_client, is_server, {flags} FROM p)"
    cols = "repo, path"
    if level == "repo":
        derive = pack.get("derive") or {n: n for n in pack["flags"]}
        base += ", g AS (SELECT repo, " + ", ".join(f"coalesce(bool_or({e}), false) AS {n}" for n, e in derive.items()) + " FROM f GROUP BY 1)"
        cols = "repo"
    src = "g" if level == "repo" else "f"
    return base + " " + " UNION ALL ".join(f"SELECT {cols}, '{k}' AS kind, '{c}' AS attack_class, '{s}' AS severity FROM {src} WHERE {cond}" for k, c, s, cond in pack["findings"])


def pack_query(name, pack, level="file", view="code_files"):
    def run(t):
        src = engine.with_roles(getattr(t, view))
        return (engine.repo_findings if level == "repo" else engine.file_findings)(src, pack)
    query(name, pack_sql(view, pack, level))(run)


pack_query("d02_redirect_leads", R.REDIRECT_LEADS)
pack_query("d08_auth_backdoors", R.BACKDOORS)
pack_query("d11_crypto_usage", R.CRYPTO)
pack_query("d12_authz_data", R.AUTHZ_DATA)
pack_query("d13_transport_headers", R.TRANSPORT, "repo")
pack_query("d14_uploads", R.UPLOADS)
pack_query("d15_infrastructure", R.IAC, view="config_files")
pack_query("d16_graphql", R.GRAPHQL, "repo")
pack_query("d17_integrations", R.INTEGRATIONS)
pack_query("d18_model_surface", R.MODEL_SURFACE)
pack_query("d19_web_extension", R.EXTENSION)
pack_query("d20_client_integrity", R.CLIENT_INTEGRITY, "repo", "config_files")
pack_query("d22_agent_config", R.AGENT_CONFIG, view="config_files")
pack_query("d13_page_headers", R.TRANSPORT, "repo", "page_texts")


@query("d03_nested_quantifier", rules_sql("code_files", R.NESTED_QUANTIFIER))
def _(t):
    return engine.scan_rules(engine.with_roles(t.code_files), R.NESTED_QUANTIFIER).select(*OCC)


@query("d04_language_sinks", rules_sql("code_files", R.LANGUAGE_SINKS))
def _(t):
    return engine.scan_rules(engine.with_roles(t.code_files), R.LANGUAGE_SINKS).select(*OCC)


@query("d05_client_exposure", f"""
WITH n AS (SELECT DISTINCT repo, path, unnest(regexp_extract_all(content, '{q(R.PUBLIC_ENV)}')) AS name FROM placed_files WHERE path NOT LIKE '%package.json')
SELECT n.repo, n.path, n.name, CASE WHEN regexp_matches(name, 'SENTRY_DSN') THEN 'analytics-public' ELSE 'public-name' END AS kind, CASE WHEN regexp_matches(name, 'SENTRY_DSN') THEN 'INFO' ELSE 'HIGH' END AS severity
FROM n JOIN placed_files k ON k.repo = n.repo AND k.path LIKE '%package.json' AND starts_with(n.path, regexp_replace(k.path, 'package.json$', '')) AND regexp_matches(k.content, '"(next|react)"')""")
def _(t):
    return packs.client_exposure(t.placed_files)


@query("d06_token_tiers", """
SELECT 'repo' || (o_custkey % 40)::VARCHAR AS repo, o_orderkey::VARCHAR AS path, CASE o_orderkey % 6 WHEN 0 THEN 'anon' WHEN 1 THEN 'service_role' WHEN 2 THEN 'anon' ELSE 'service_role' END AS role,
 CASE o_orderkey % 6 WHEN 0 THEN 'INFO' WHEN 1 THEN 'CRITICAL' WHEN 2 THEN 'INFO' ELSE 'CRITICAL' END AS tier FROM orders WHERE o_orderkey % 6 < 4""")
def _(t):
    k = F.col("o_orderkey").cast("string")

    def token(role, rest):
        body = F.concat(F.lit('{"iss":"'), F.lit(rest), F.lit('","role":"'), F.lit(role), F.lit('","n":'), k, F.lit("}"))
        seg = F.translate(F.rtrim(F.base64(F.encode(body, "utf-8")), F.lit("=")), "+/", "-_")
        return F.concat(F.lit("k = eyJhbGciOiJIUzI1NiJ9."), seg, F.lit(".c2lnbmF0dXJl"))
    m = F.col("o_orderkey") % 6
    text = (F.when(m == 0, token("anon", "supabase")).when(m == 1, token("service_role", "supabase")).when(m == 2, F.concat(F.lit("sb_publishable_"), F.lpad(k, 12, F.lit("0"))))
            .when(m == 3, F.concat(F.lit("sb_secret_"), F.lpad(k, 12, F.lit("0")))).when(m == 4, token("anon", "other")).otherwise(F.lit("none")))
    files = t.orders.select(F.concat(F.lit("repo"), F.col("o_custkey") % 40).alias("repo"), k.alias("path"), text.alias("content"))
    return packs.token_tiers(files)


@query("d07_secret_defaults", f"""
WITH {prep('code_files')}, l AS (SELECT DISTINCT repo, path, CASE WHEN contains(content, 'process.env.JWT_SECRET ||') THEN 'JWT_SECRET' END AS a, CASE WHEN contains(content, 'process.env.SESSION_SECRET ??') THEN 'SESSION_SECRET' END AS b FROM p WHERE NOT is_test),
 d AS (SELECT repo, path, a AS var, 'dev-secret-key' AS literal, true AS dev_ish FROM l WHERE a IS NOT NULL UNION ALL SELECT repo, path, b, 'q8w7e6r5t4', false FROM l WHERE b IS NOT NULL),
 g AS (SELECT DISTINCT repo FROM code_files WHERE contains(content, 'assertEnv(process.env.JWT_SECRET)') AND regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$')), j AS (SELECT DISTINCT repo FROM code_files WHERE regexp_matches(content, '{q(R.JWT_USE)}'))
SELECT d.*, var = 'JWT_SECRET' AND g.repo IS NOT NULL AS guarded, CASE WHEN var = 'JWT_SECRET' AND g.repo IS NOT NULL THEN 'LOW' WHEN dev_ish AND j.repo IS NOT NULL THEN 'CRITICAL' WHEN dev_ish THEN 'HIGH' ELSE 'MEDIUM' END AS severity,
 CASE WHEN dev_ish OR var = 'JWT_SECRET' AND g.repo IS NOT NULL THEN 'MEDIUM' ELSE 'LOW' END AS confidence FROM d LEFT JOIN g USING (repo) LEFT JOIN j ON j.repo = d.repo""")
def _(t):
    return packs.secret_defaults(t.code_files)


@query("d08_auth_scheme", "WITH c AS (SELECT repo, " + ", ".join(f"count(*) FILTER (regexp_matches(content, '{q(p)}')) AS \"{n}\"" for n, p in R.AUTH_SCHEMES) + " FROM code_files GROUP BY 1) SELECT repo, CASE "
       + " ".join(f"WHEN \"{n}\" > 0 THEN '{n}'" for n, _p in R.AUTH_SCHEMES) + " ELSE 'none' END AS scheme, CASE " + " ".join(f"WHEN \"{n}\" > 0 THEN \"{n}\"" for n, _p in R.AUTH_SCHEMES) + " ELSE 0 END AS files_seen FROM c")
def _(t):
    return packs.auth_scheme(t.code_files)


@query("d10_password_policy", """
WITH b AS (SELECT DISTINCT repo, path, CASE WHEN x LIKE '%min(8)%' THEN 'min,upper,lower,digit' ELSE 'min' END AS enforces FROM (SELECT repo, path, unnest(string_split(content, chr(10))) AS x FROM code_files) WHERE x LIKE 'password: z.string().min%'),
 s AS (SELECT repo, max_by(enforces, length(enforces)) AS strongest FROM b GROUP BY 1)
SELECT b.repo, b.path, b.enforces, strongest, enforces = 'min' AND strongest <> 'min' AS drift FROM b JOIN s USING (repo)""")
def _(t):
    # Files that hold both forms on neighbouring lines have two windows.
    p = packs.password_policy(t.code_files)
    return p.select("repo", "path", F.array_join("enforces", ",").alias("enforces"), F.array_join("strongest", ",").alias("strongest"), "drift")


@query("d15_workflow_injection", """
SELECT repo, path, 5 AS line, '${{ github.event.' || CASE k % 3 WHEN 0 THEN 'issue.title' ELSE 'pull_request.body' END || ' }}' AS expression
FROM (SELECT repo, path, substr(path, 20, length(path) - 23)::INT AS k FROM manifest_files WHERE path LIKE '.github/%') WHERE k % 3 <> 1""")
def _(t):
    return packs.workflow_injection(t.manifest_files)


@query("d15_unpinned_actions", """
SELECT repo, 'actions/checkout' AS action, 'v4' AS ref, count(*) AS files FROM manifest_files WHERE path LIKE '.github/%' AND content LIKE '%checkout@v4%' GROUP BY 1""")
def _(t):
    return packs.unpinned_actions(t.manifest_files)


@query("d17_repeated_secret_fetch", """
SELECT repo, path, 'prod/db' AS secret, count(*) AS n FROM (SELECT repo, path, unnest(regexp_extract_all(content, 'getSecretValue\\(')) FROM code_files) GROUP BY 1, 2 HAVING count(*) > 1""")
def _(t):
    return packs.repeated_secret_fetch(t.code_files)


@query("d21_pii_boundary", f"""
WITH {prep('code_files')}, f AS (SELECT * FROM p WHERE NOT is_test), n AS (SELECT repo, count(*) AS n FROM (SELECT repo, unnest(regexp_extract_all(content, 'maskPhone')) FROM f) GROUP BY 1)
SELECT f.repo, 'maskPhone' AS name, 'masking-unused' AS kind, min(path) AS place FROM f JOIN n ON n.repo = f.repo AND n.n <= 1 WHERE contains(content, 'function maskPhone') GROUP BY 1
UNION ALL SELECT repo, 'res.json(user)', 'raw-entity-returned', path FROM f WHERE contains(content, 'res.json(user)') AND NOT contains(content, 'maskPhone(')""")
def _(t):
    return packs.pii_boundary(t.code_files)


MF = "m AS (SELECT repo, path AS file, substr(path, 4, length(path) - 16)::INT AS k FROM manifest_files WHERE path LIKE 'pkg%/package.json'), w AS (SELECT repo, path AS file, substr(path, 4, length(path) - 20)::INT AS k FROM manifest_files WHERE path LIKE '%requirements.txt')"
DEP_NAME = "(['express', 'react', 'next', 'pg', 'mongoose'])[k % 5 + 1]"
DEP_SPEC = "(['1.2.3', '^1.0.0', 'latest', 'workspace:*'])[k % 4 + 1]"
DECL = f"""d AS (SELECT repo, 'npm' AS ecosystem, {DEP_NAME} AS name, {DEP_SPEC} AS spec, file, k FROM m UNION ALL SELECT repo, 'npm', '@org' || (k % 7) || '/lib', '2.0.0', file, k FROM m
 UNION ALL SELECT repo, 'npm', '@types/node', '20.x', file, k FROM m UNION ALL SELECT repo, 'pip', 'flask', '==2.0', file, k FROM w UNION ALL SELECT repo, 'pip', 'requests', '>=2', file, k FROM w UNION ALL SELECT repo, 'pip', 'lib' || (k % 9), '*', file, k FROM w)"""


@query("s13_manifest_dependencies", f"WITH {MF}, {DECL} SELECT repo, ecosystem, name, spec, file FROM d")
def _(t):
    return packs.manifest_dependencies(t.manifest_files)


@query("s13_read_lockfiles", """
WITH l AS (SELECT repo, regexp_replace(path, '/[^/]*$', '') AS folder, substr(path, 4, length(path) - 21)::INT AS k FROM manifest_files WHERE path LIKE '%package-lock.json')
SELECT repo, folder, '@types/node' AS name, true AS resolved FROM l UNION ALL SELECT repo, folder, (['express', 'react', 'other', 'pg', 'mongoose'])[k % 5 + 1], false FROM l""")
def _(t):
    return packs.lock_entries(t.manifest_files)


@query("d23_dependency_hygiene", f"""WITH {MF}, {DECL}
SELECT repo, file, 'postinstall' AS name, 'malicious-install-script' AS kind, 'MEDIUM' AS severity FROM m WHERE k % 3 = 1
UNION ALL SELECT repo, file, name, 'unpinned', 'INFO' FROM d WHERE spec IN ('^1.0.0', 'latest', '20.x', '>=2') OR (ecosystem = 'pip' AND spec = '*')
UNION ALL SELECT repo, file, name, 'scope-confusion', 'INFO' FROM d WHERE name LIKE '@org%'
UNION ALL SELECT repo, file, name, 'lockfile-drift', 'LOW' FROM d WHERE ecosystem = 'npm' AND k % 2 = 0 AND name <> '@types/node' AND (name LIKE '@org%' OR name = 'next')""")
def _(t):
    return packs.dependency_hygiene(t.manifest_files)


@query("f07_pin_states", f"WITH {MF}, {DECL} SELECT name, spec, count(*) AS n, spec IN ('^1.0.0', 'latest', '20.x') AS npm_floating, 'unresolved' AS runner FROM d WHERE ecosystem = 'npm' GROUP BY ALL")
def _(t):
    d = packs.manifest_dependencies(t.manifest_files).filter("ecosystem = 'npm'")
    return d.groupBy("name", "spec", packs.npm_unpinned(F.col("spec")).alias("npm_floating"), packs.package_pin_state(F.col("name"), F.lit("npx")).alias("runner")).agg(F.count("*").alias("n"))


@query("d24_missing_rls", "SELECT repo, 2 AS tables, 1 AS owner_tables FROM sql_files WHERE NOT contains(content, 'POLICY') AND regexp_matches(content, 'user_id|owner_id')")
def _(t):
    return packs.missing_rls(t.sql_files)


@query("d24_table_states", """
WITH f AS (SELECT repo, path, lower(split_part(content, chr(10), 2)) AS s FROM migration_files),
 e AS (SELECT repo, path, unnest(CASE WHEN s LIKE 'drop table%' THEN string_split(regexp_replace(regexp_replace(s, 'drop table (if exists )?', ''), '( cascade)?;', ''), ', ') ELSE [regexp_extract(s, '(?:public[.])?([tu][0-9])', 0)] END) AS n,
   CASE WHEN s LIKE 'drop table%' THEN 'drop' WHEN s LIKE 'create table%' THEN 'create' WHEN s LIKE 'create policy%' THEN 'policy' WHEN s LIKE 'drop policy%' THEN 'unpolicy' WHEN s LIKE '%enable row%' THEN 'enable' WHEN s LIKE '%disable row%' THEN 'disable' ELSE 'column' END AS kind,
   regexp_extract(s, 'policy (?:if exists )?(p[0-9])', 1) AS policy, regexp_matches(s, 'user_id|tenant_id|owner_id') AS owned FROM f),
 k AS (SELECT repo, path, 'public.' || replace(n, 'public.', '') AS name, kind, policy, owned FROM e), l AS (SELECT * FROM k WHERE path > coalesce((SELECT max(path) FROM k d WHERE d.repo = k.repo AND d.name = k.name AND d.kind = 'drop'), '')),
 p AS (SELECT repo, name, policy, last(kind ORDER BY path) = 'policy' AS held FROM l WHERE policy <> '' GROUP BY 1, 2, 3)
SELECT a.repo, a.name, coalesce(bool_or(l.kind = 'create'), false) AS "exists", coalesce(bool_or(l.owned), false) AS owned, coalesce(last(l.kind ORDER BY l.path) FILTER (l.kind IN ('enable', 'disable')) = 'enable', false) AS rls,
 (SELECT count(*) FROM p WHERE p.repo = a.repo AND p.name = a.name AND held) AS policies FROM (SELECT DISTINCT repo, name FROM k) a LEFT JOIN l ON l.repo = a.repo AND l.name = a.name GROUP BY 1, 2""")
def _(t):
    return packs.table_states(t.migration_files)


@query("d24_entities", "SELECT repo, path, 'zod' AS kind, 'el' AS name FROM code_files WHERE contains(content, 'const el = z.object(')")
def _(t):
    return packs.entities(t.code_files)


@query("d25_tenant_keys", f"""
WITH {prep('code_files')}, k(key) AS (VALUES ('tenantId'), ('organizationId'), ('tenant_id')), h AS (SELECT repo, path, key, len(regexp_extract_all(content, key)) - CASE WHEN key = 'organizationId' THEN len(regexp_extract_all(content, 'organizationIdentif')) ELSE 0 END AS n FROM p CROSS JOIN k WHERE NOT is_test),
 t AS (SELECT repo, key, sum(n)::BIGINT AS occurrences FROM h WHERE n > 0 GROUP BY 1, 2), f AS (SELECT repo, key, path, row_number() OVER (PARTITION BY repo, key ORDER BY path) AS r FROM h WHERE n > 0),
 g AS (SELECT repo, key, string_agg(path, ',' ORDER BY path) AS files FROM f WHERE r <= 5 GROUP BY 1, 2)
SELECT t.repo, t.key, occurrences, row_number() OVER (PARTITION BY t.repo ORDER BY occurrences DESC, t.key) AS position, files FROM t JOIN g ON g.repo = t.repo AND g.key = t.key""")
def _(t):
    return packs.tenant_keys(t.code_files).withColumn("files", F.array_join("files", ","))


@query("d26_stack", f"""WITH {MF}, {DECL}
SELECT DISTINCT repo, 'framework' AS kind, CASE name WHEN 'flask' THEN 'flask' ELSE name END AS label FROM d WHERE name IN ('express', 'react', 'next', 'flask')
UNION SELECT repo, 'datastore', CASE name WHEN 'pg' THEN 'postgres' ELSE 'mongodb' END FROM d WHERE name IN ('pg', 'mongoose') UNION SELECT repo, 'package-manager', ecosystem FROM d""")
def _(t):
    return packs.stack(t.manifest_files)


@query("d27_text_leaks", rules_sql("doc_texts", R.TEXT_SHAPES))
def _(t):
    return packs.text_leaks(t.doc_texts).select(*OCC)


@query("d27_page_leaks", rules_sql("page_texts", R.TEXT_SHAPES))
def _(t):
    return packs.text_leaks(t.page_texts).select(*OCC)


@query("d28_taint_over_events", """
WITH RECURSIVE d AS (SELECT * FROM flow_events WHERE kind = 'assign'),
edge AS (SELECT d.repo, d.path, d.n AS src, u.n AS dst FROM d JOIN flow_events u ON d.repo = u.repo AND d.path = u.path AND d.n < u.n AND (u.ref1 = d.var OR u.ref2 = d.var)
  WHERE NOT EXISTS (SELECT 1 FROM d p WHERE p.repo = d.repo AND p.path = d.path AND p.var = d.var AND NOT p.conditional AND p.n > d.n AND p.n < u.n)),
walk AS (SELECT repo, path, n, 0 AS hops FROM flow_events WHERE source UNION SELECT w.repo, w.path, e.dst, w.hops + 1 FROM walk w JOIN edge e ON e.repo = w.repo AND e.path = w.path AND e.src = w.n)
SELECT w.repo, w.path, f.pos, f.var AS sink, min(hops) AS hops FROM walk w JOIN flow_events f ON f.repo = w.repo AND f.path = w.path AND f.n = w.n WHERE f.kind = 'sink' GROUP BY w.repo, w.path, w.n, f.pos, f.var""")
def _(t):
    events = t.flow_events.select("repo", "path", F.lit(0).alias("scope"), F.col("n").alias("at"), "pos", "kind", "var", F.array("ref1", "ref2").alias("refs"), "source", "conditional")
    return packs.taint_over(events).select("repo", "path", "pos", "sink", "hops")


@query("d28_taint_flows", None)
def _(t):
    return packs.taint_flows(t.code_files)


@query("d29_config_checks", """
SELECT 'repo' || (o_custkey % 40)::VARCHAR AS repo, CASE o_orderkey % 3 WHEN 0 THEN 'a/' || o_orderkey || '.xml' WHEN 1 THEN 'i/' || o_orderkey || '.plist' ELSE 'r/' || o_orderkey || '.rs' END AS path, 2 AS line,
 CASE o_orderkey % 3 WHEN 0 THEN 'android-cleartext' WHEN 1 THEN 'ios-ats-exception' ELSE 'rust-invalid-certs' END AS rule_id FROM orders WHERE o_custkey % 2 = 0""")
def _(t):
    m, k = F.col("o_orderkey") % 3, F.col("o_orderkey").cast("string")
    bad = F.col("o_custkey") % 2 == 0
    text = (F.when(m == 0, F.when(bad, F.lit('<application\n android:usesCleartextTraffic="true">')).otherwise(F.lit('<application\n android:usesCleartextTraffic="false">')))
            .when(m == 1, F.when(bad, F.lit("<dict>\n<key>NSAllowsArbitraryLoads</key><true/>")).otherwise(F.lit("<dict>\n<key>NSAllowsArbitraryLoads</key><false/>")))
            .otherwise(F.when(bad, F.lit("let c =\n b.danger_accept_invalid_certs(true)")).otherwise(F.lit("let c =\n b.danger_accept_invalid_certs(false)"))))
    path = F.when(m == 0, F.concat(F.lit("a/"), k, F.lit(".xml"))).when(m == 1, F.concat(F.lit("i/"), k, F.lit(".plist"))).otherwise(F.concat(F.lit("r/"), k, F.lit(".rs")))
    files = t.orders.select(F.concat(F.lit("repo"), F.col("o_custkey") % 40).alias("repo"), path.alias("path"), text.alias("content"))
    return packs.config_checks(files).select("repo", "path", "line", "rule_id")


@query("d16_subscription_authz", """
WITH s AS (SELECT 'repo' || (c_custkey % 90)::VARCHAR AS repo, 'on' || c_custkey AS field, c_custkey % 3 = 0 AS bound FROM customer) SELECT repo, field FROM s WHERE NOT bound""")
def _(t):
    k = F.col("c_custkey").cast("string")
    repo = F.concat(F.lit("repo"), F.col("c_custkey") % 90)
    schema = t.customer.select(repo.alias("repo"), F.concat(F.lit("schema/"), k).alias("path"), F.concat(F.lit("type Subscription {\n on"), k, F.lit("(groupId: ID!): Event\n}")).alias("content"))
    resolver = t.customer.filter("c_custkey % 3 = 0").select(repo.alias("repo"), F.concat(F.lit("resolvers/"), k).alias("path"), F.concat(F.lit("on"), k, F.lit(" { $ctx.identity.sub }")).alias("content"))
    return packs.subscription_authz(schema.unionByName(resolver))


# File predicates ---------------------------------------------------------------------------------

@query("p01_file_role", f"WITH {prep('all_files')} SELECT repo, path, is_test, is_script, is_client, is_doc, is_example FROM p")
def _(t):
    return engine.with_roles(t.all_files).select("repo", "path", "is_test", "is_script", "is_client", "is_doc", "is_example")


@query("p02_is_vendored", r"""
WITH x AS (SELECT path, content, regexp_matches(substr(content, 1, 4096), '^\s*/\*!') AS b, (SELECT bool_or(length(u) > 1000 AND length(regexp_replace(u, '\s', '', 'g')) / length(u) > 0.9) FROM unnest(string_split(content, chr(10))) AS q(u)) AS d FROM page_texts)
SELECT path, coalesce(d, false) OR b AS vendored FROM x""")
def _(t):
    return t.page_texts.select("path", engine.is_vendored(F.col("path"), F.col("content")).alias("vendored"))


@query("p03_unanalyzed_languages", """
SELECT language, count(*) AS files FROM (SELECT CASE o_orderkey % 5 WHEN 0 THEN 'rust' WHEN 1 THEN 'swift' WHEN 2 THEN 'kotlin' WHEN 3 THEN 'python' END AS language FROM orders) WHERE language IN ('rust', 'swift', 'kotlin') GROUP BY 1""")
def _(t):
    ext = F.element_at(F.array(*[F.lit(e) for e in (".rs", ".swift", ".kt", ".py", ".unknown")]), (F.col("o_orderkey") % 5 + 1).cast("int"))
    return packs.unanalyzed_languages(t.orders.select(F.concat(F.lit("src/f"), F.col("o_orderkey").cast("string"), ext).alias("path")))


@query("p04_mask_comments", """
SELECT repo, path, regexp_replace(content, '// email', '        ', 'g') AS code FROM code_files WHERE path NOT LIKE '%.py'
UNION ALL SELECT repo, path, content FROM code_files WHERE path LIKE '%.py'""")
def _(t):
    return engine.mask_comments(t.code_files).select("repo", "path", "code")


@query("w01_occurrence_ordinal", rules_sql("code_files", R.SINKS, "repo, path, rule_id, max(ordinal) AS last_ordinal") + " GROUP BY 1, 2, 3")
def _(t):
    return engine.scan_rules(engine.with_roles(t.code_files), R.SINKS).groupBy("repo", "path", "rule_id").agg(F.max("ordinal").alias("last_ordinal"))


@query("j09_nearest_ancestor", """
WITH f AS (SELECT repo, path FROM placed_files), r AS (SELECT repo, regexp_replace(path, '/package.json$', '') AS root FROM placed_files WHERE path LIKE '%/package.json')
SELECT f.repo, f.path, max_by(r.root, length(r.root)) AS root FROM f LEFT JOIN r ON r.repo = f.repo AND (f.path = r.root OR starts_with(f.path, r.root || '/')) GROUP BY 1, 2""")
def _(t):
    roots = t.placed_files.filter(F.endswith("path", F.lit("/package.json"))).select("repo", F.regexp_replace("path", "/package.json$", "").alias("root"))
    return packs.nearest_ancestor(t.placed_files.select("repo", "path"), roots)


@query("j19_env_fallback_demote", """
WITH s AS (SELECT f.repo, f.path AS file, u.o AS line, u.x FROM code_files f, unnest(string_split(content, chr(10))) WITH ORDINALITY AS u(x, o)),
 v AS (SELECT repo, file, line, CASE WHEN x LIKE '%process.env.JWT_SECRET ||%' THEN 'JWT_SECRET' WHEN x LIKE '%process.env.SESSION_SECRET ??%' THEN 'SESSION_SECRET' END AS var FROM s),
 c AS (SELECT repo, path AS file, 2 AS line FROM code_files), g AS (SELECT DISTINCT repo FROM code_files WHERE contains(content, 'assertEnv(process.env.JWT_SECRET)') AND regexp_matches(path, '\\.(ts|tsx|js|jsx|mjs|cjs)$')),
 w AS (SELECT c.repo, c.file, min_by(v.var, v.line) AS var FROM c JOIN v ON v.repo = c.repo AND v.file = c.file AND v.line BETWEEN c.line - 1 AND c.line + 1 AND v.var IS NOT NULL GROUP BY 1, 2)
SELECT c.repo, c.file, CASE WHEN w.var = 'JWT_SECRET' AND g.repo IS NOT NULL THEN 'LOW' ELSE 'HIGH' END AS severity, CASE WHEN w.var = 'JWT_SECRET' AND g.repo IS NOT NULL THEN w.var END AS guarded_env
FROM c LEFT JOIN w ON w.repo = c.repo AND w.file = c.file LEFT JOIN g ON g.repo = c.repo""")
def _(t):
    from ..operators.findings import env_fallback_demote
    scan = t.code_files.select("repo", F.col("path").alias("file"), F.lit(2).alias("line"), F.lit("sast").alias("category"), F.lit("insecure-default-signing-secret").alias("key"), F.lit("HIGH").alias("severity"))
    return env_fallback_demote(scan, t.code_files).select("repo", "file", "severity", "guarded_env")


@query("j20_history_only", """
SELECT s.repo, s.seq, s.line, CASE WHEN s.tool = 'gitleaks' AND s.category = 'secret' THEN s.scan_mode = 'dir' OR substr(s.repo, 5)::INT % 3 = 0 OR s.file LIKE 'src/%' END AS in_tree FROM scan_findings s""")
def _(t):
    from ..operators.findings import history_only
    files = t.sql("SELECT DISTINCT repo, file AS path FROM scan_findings WHERE cast(substring(repo, 5) AS int) % 3 = 0 OR file LIKE 'src/%'")
    return history_only(t.scan_findings, files).select("repo", "seq", "line", "in_tree")
