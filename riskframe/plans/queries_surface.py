"""Attack-surface, contract and observation queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import dynamic as dyn
from ..operators import surface as sf
from ..operators.core import scratch_dir, unique_match
from ..sources import files as src
from ..sources import intel
from ..sources.tree import read_source_tree
from .catalog import query


def _routes(t):
    return t.routes.withColumn("params", sf.path_params(F.col("path")))


# Pairs counted the slow way: compatible when equal or missing on one side.
PAIRS = """pr AS (SELECT r.route_id, g.guard_id FROM routes r JOIN guards g ON r.repo = g.repo AND r.method = g.method AND r.path = g.path
  AND (r.service_id IS NULL OR g.service_id IS NULL OR r.service_id = g.service_id) AND (r.code_path = '' OR g.code_path = '' OR r.code_path = g.code_path)),
 nl AS (SELECT route_id, count(*) AS n, min(guard_id) AS guard_id FROM pr GROUP BY 1), nr AS (SELECT guard_id, count(*) AS n FROM pr GROUP BY 1),
 um AS (SELECT nl.route_id, nl.n, CASE WHEN nl.n = 1 AND nr.n = 1 THEN nl.guard_id END AS guard_id FROM nl JOIN nr USING (guard_id))"""


@query("j01_unique_match", f"WITH {PAIRS} SELECT r.route_id, um.guard_id AS match_id, coalesce(um.n, 0) AS candidate_count FROM routes r LEFT JOIN um USING (route_id)")
def _(t):
    m = unique_match(t.routes, t.guards, ["repo", "method", "path"], "route_id", "guard_id", compatible=["service_id", "code_path"])
    return m.select("route_id", "match_id", "candidate_count")


BUCKET = """b AS (SELECT repo, method, path, 'write' AS bucket FROM route_params WHERE method IN ('POST', 'PUT', 'DELETE') UNION SELECT repo, method, path, 'idor' FROM route_params WHERE param IN ('fileId', 'itemId')
 UNION SELECT repo, method, path, 'ssrf' FROM route_params WHERE param = 'url' UNION SELECT repo, method, path, 'open_redirect' FROM route_params WHERE param = 'redirect' UNION SELECT repo, method, path, 'upload' FROM route_params WHERE path LIKE '%upload%'
 UNION SELECT repo, method, path, 'auth' FROM route_params WHERE path LIKE '%signup%')"""


@query("t06_target_buckets", f"WITH {BUCKET} SELECT repo, bucket, method, path, method || ' ' || path AS signature FROM b")
def _(t):
    return sf.target_buckets(_routes(t))


SURFACE = f"""{PAIRS}, {BUCKET}, h AS (SELECT repo, path AS code_path, string_agg(DISTINCT attack_class, ',' ORDER BY attack_class) AS hot FROM file_sinks WHERE attack_class IN ('sqli', 'ssrf') GROUP BY 1, 2),
 a AS (SELECT r.*, CASE WHEN coalesce(g.analyzed, false) = false OR g.guarded IS NULL THEN 'unknown' WHEN g.guarded THEN 'guarded' WHEN g.public_hint THEN 'public' ELSE 'UNGUARDED' END AS auth, coalesce(h.hot, '') AS hot_sinks, r.method IN ('POST', 'PUT', 'PATCH', 'DELETE') AS is_write
   FROM route_params r LEFT JOIN um USING (route_id) LEFT JOIN guards g ON g.guard_id = um.guard_id LEFT JOIN h ON h.repo = r.repo AND h.code_path = r.code_path),
 s AS (SELECT *, CASE WHEN auth = 'UNGUARDED' THEN CASE WHEN is_write THEN 4 ELSE 3 END ELSE 0 END + CASE WHEN param IN ('fileId', 'itemId') THEN 3 ELSE 0 END + CASE WHEN hot_sinks <> '' THEN 3 ELSE 0 END + CASE WHEN path LIKE '%upload%' THEN 2 ELSE 0 END
   + CASE WHEN param = 'url' THEN 2 ELSE 0 END + CASE WHEN param = 'redirect' THEN 1 ELSE 0 END + CASE WHEN path LIKE '%signup%' THEN 1 ELSE 0 END + CASE WHEN auth = 'UNGUARDED' AND param IS NOT NULL THEN 1 ELSE 0 END AS risk FROM a)"""


def _surface(t):
    r = _routes(t)
    return sf.attack_surface(r, t.guards, t.file_sinks, sf.target_buckets(r))


@query("t09_attack_surface", f"WITH {SURFACE} SELECT repo, route_id, auth, hot_sinks, risk FROM s")
def _(t):
    return sf.surface_order(_surface(t)).select("repo", "route_id", "auth", F.array_join("hot_sinks", ",").alias("hot_sinks"), "risk")


@query("t09_surface_summary", f"""WITH {SURFACE} SELECT repo, count(*) AS endpoints, count(*) FILTER (auth = 'UNGUARDED') AS unguarded, count(*) FILTER (auth = 'UNGUARDED' AND is_write) AS unguarded_writes,
 count(*) FILTER (hot_sinks <> '') AS with_hot_sink, max(risk) AS top_risk FROM s GROUP BY 1""")
def _(t):
    return sf.surface_summary(_surface(t))


@query("t12_probe_plan", f"""WITH {BUCKET} SELECT repo, CASE bucket WHEN 'idor' THEN 'cross-tenant-read' WHEN 'write' THEN 'write-verbs' WHEN 'auth' THEN 'credential-endpoints' WHEN 'ssrf' THEN 'outbound-url' WHEN 'upload' THEN 'upload-types' ELSE 'redirect-target' END AS probe,
 CASE bucket WHEN 'idor' THEN 1 WHEN 'write' THEN 2 WHEN 'auth' THEN 3 WHEN 'ssrf' THEN 4 WHEN 'upload' THEN 5 ELSE 6 END AS priority, count(DISTINCT method || ' ' || path) AS targets FROM b GROUP BY repo, bucket""")
def _(t):
    return sf.probe_plan(t.routes, sf.target_buckets(_routes(t)))


@query("t13_test_plan", f"""WITH {SURFACE}, o AS (SELECT *, 'object-ownership' AS phase, 12 AS k FROM s WHERE param IN ('fileId', 'itemId') UNION ALL SELECT *, 'unguarded-writes', 6 FROM s WHERE auth = 'UNGUARDED' AND is_write UNION ALL SELECT *, 'sink-backed', 12 FROM s WHERE hot_sinks <> ''),
 n AS (SELECT *, row_number() OVER (PARTITION BY repo, phase ORDER BY risk DESC, path, method, route_id) AS position FROM o) SELECT repo, phase, position, method, path FROM n WHERE position <= k""")
def _(t):
    return sf.test_plan(_surface(t), sf.target_buckets(_routes(t)))


@query("t14_invariants", """
WITH g AS (SELECT DISTINCT repo, method, path, guarded, analyzed FROM guards), e AS (SELECT repo, method, path, count(DISTINCT service_id) AS n FROM routes WHERE route_id % 9 = 0 GROUP BY 1, 2, 3 HAVING count(DISTINCT service_id) <= 1),
 x AS (SELECT g.*, CASE WHEN method IN ('POST', 'PUT', 'DELETE') THEN 'authenticated-writes' ELSE 'authenticated-reads' END AS principle, CASE WHEN e.repo IS NOT NULL THEN 'VIOLATED' WHEN NOT analyzed THEN 'UNKNOWN' WHEN guarded THEN 'HOLDS' ELSE 'UNVERIFIED' END AS status
   FROM g LEFT JOIN e USING (repo, method, path)), n AS (SELECT *, row_number() OVER (PARTITION BY repo, principle ORDER BY status DESC, path, method) AS position FROM x)
SELECT repo, principle, status, method, path FROM n WHERE position <= 25""")
def _(t):
    ev = t.routes.filter("route_id % 9 = 0").select("repo", "method", "path", "service_id", F.lit("missing-auth").alias("attack_class"), F.lit(True).alias("confirmed"))
    return sf.invariants(t.guards, ev).select("repo", "principle", "status", "method", "path")


@query("t05_dedupe_routes", """
WITH k AS (SELECT *, CASE source WHEN 'router' THEN 1 WHEN 'decorator' THEN 2 WHEN 'raw' THEN 6 ELSE 7 END AS prio, coalesce(service_id, '') AS svc FROM routes),
 b AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY repo, svc, method, path ORDER BY prio, code_path) AS rn FROM k) WHERE rn = 1),
 x AS (SELECT DISTINCT repo, svc, path FROM b WHERE method <> 'ANY')
SELECT repo, svc AS service, method, path, source, code_path, CASE WHEN source = 'spec' THEN 'spec' ELSE 'endpoint' END AS listed FROM b WHERE method <> 'ANY' OR (repo, svc, path) NOT IN (SELECT (repo, svc, path) FROM x)""")
def _(t):
    return sf.dedupe_routes(t.routes.drop("route_id")).select("repo", F.coalesce("service_id", F.lit("")).alias("service"), "method", "path", "source", "code_path", "listed")


@query("u01_union_engines", """
SELECT repo, method, path, min_by(source, CASE source WHEN 'router' THEN 1 WHEN 'decorator' THEN 2 WHEN 'raw' THEN 6 ELSE 7 END) AS source FROM routes GROUP BY 1, 2, 3""")
def _(t):
    from ..functions.ranks import lookup
    from ..operators.core import first_row
    a, b = t.routes.filter("source IN ('router', 'raw')"), t.routes.filter("source NOT IN ('router', 'raw')")
    both = a.unionByName(b).select("repo", "method", "path", "source").withColumn("prio", lookup(F.col("source"), sf.ENGINE_PRIORITY, 9))
    return first_row(both, ["repo", "method", "path"], ["prio"]).drop("prio")


@query("t04_normalize_path", r"""
SELECT path, regexp_replace(CASE WHEN path LIKE '/only%' THEN path ELSE regexp_replace(path, ':id', '{id}') END, 'Q', 'Q') AS normal, CASE WHEN length(lower(path)) > 1 THEN regexp_replace(regexp_replace(lower(path), ':id', '{}'), '/+$', '') END AS contract, count(*) AS n FROM spec_ops GROUP BY 1""")
def _(t):
    return t.spec_ops.groupBy("path", sf.normalize_path(F.col("path")).alias("normal"), sf.contract_path(F.col("path")).alias("contract")).agg(F.count("*").alias("n"))


@query("f09_route_signature", "SELECT route_id, upper(method) || ' ' || regexp_replace(path, '\\{[^}]*\\}', '{}') AS signature FROM routes")
def _(t):
    return t.routes.select("route_id", F.concat_ws(" ", F.upper("method"), F.regexp_replace("path", r"\{[^}]*\}", "{}")).alias("signature"))


@query("t10_contract_diff", r"""
WITH o AS (SELECT DISTINCT repo, upper(method) AS method, regexp_replace(regexp_replace(lower(path), ':id', '{}'), '/+$', '') AS path FROM spec_ops), c AS (SELECT DISTINCT repo, method, lower(regexp_replace(path, '\{[^}]*\}', '{}')) AS path FROM routes),
 x AS (SELECT c.* FROM c WHERE method <> 'ANY' AND NOT EXISTS (SELECT 1 FROM o WHERE o.repo = c.repo AND o.method = c.method AND o.path = c.path))
SELECT repo, method, path, CASE WHEN EXISTS (SELECT 1 FROM o WHERE o.repo = x.repo AND o.path = x.path) THEN 'undocumented-method' ELSE 'shadow-path' END AS kind FROM x
UNION ALL SELECT repo, method, path, 'shadow-path' FROM c WHERE method = 'ANY' AND NOT EXISTS (SELECT 1 FROM o WHERE o.repo = c.repo AND o.path = c.path)
UNION ALL SELECT repo, method, path, 'stale-operation' FROM o WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.repo = o.repo AND c.path = o.path AND (c.method = o.method OR c.method = 'ANY'))""")
def _(t):
    return sf.contract_diff(t.spec_ops, t.routes)


@query("t01_extract_routes", r"""
WITH l AS (SELECT repo, path AS code_path, unnest(string_split(content, chr(10))) AS x FROM code_files)
SELECT DISTINCT repo, code_path, CASE WHEN x LIKE 'app.get%' THEN 'GET' WHEN x LIKE 'router.delete%' THEN 'DELETE' ELSE 'POST' END AS method, CASE WHEN x LIKE 'app.get%' THEN '/api/users/{id}' WHEN x LIKE 'router.post%' THEN '/api/orders/{orderId}/items' WHEN x LIKE 'router.delete%' THEN '/api/files/{fileId}'
  WHEN x LIKE '%/upload%' THEN '/upload' ELSE '/webhooks/stripe' END AS path, 'router' AS source FROM l WHERE regexp_matches(x, '^(app|router)\.(get|post|delete)\(') AND regexp_matches(code_path, '\.(js|jsx|ts|tsx|mjs|cjs)$')
UNION ALL SELECT DISTINCT repo, code_path, 'GET', '/' || regexp_extract(code_path, 'app/(p[0-9]+)/route', 1), 'filesystem' FROM l WHERE x LIKE 'export async function GET%' AND code_path LIKE 'web/app/%'""")
def _(t):
    return sf.extract_routes(t.code_files).select("repo", "code_path", "method", "path", "source")


@query("t11_coverage_warning", r"""
WITH h AS (SELECT repo, count(*) AS handlers FROM code_files WHERE contains(content, '(req, res) =>') GROUP BY 1), h2 AS (SELECT repo, sum(len(regexp_extract_all(content, '\(req, res\)')))::BIGINT AS handlers FROM code_files GROUP BY 1)
SELECT repo, handlers, 1 AS routes FROM h2 WHERE handlers >= 5""")
def _(t):
    one = t.code_files.select("repo").distinct()
    return sf.coverage_warning(one, t.code_files)


@query("t02_serverless_routes", """
WITH b AS (SELECT 'repo' || (c_custkey % 30)::VARCHAR AS repo, 'infra/' || c_custkey || '.yaml' AS code_path, c_custkey AS k FROM customer)
SELECT repo, code_path, 'GET' AS method, '/a' || k || '/{id}' AS path, NULL AS auth_type FROM b UNION ALL SELECT repo, code_path, 'ANY', '/', CASE WHEN k % 2 = 0 THEN 'NONE' ELSE 'AWS_IAM' END FROM b""")
def _(t):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("R:\n  Type: AWS::Serverless::Function\n  Events:\n      Path: /a"), k, F.lit("/:id\n      Method: get\n  S:\n  Type: AWS::Serverless::Function\n  FunctionUrlConfig:\n    AuthType: "), F.when(F.col("c_custkey") % 2 == 0, F.lit("NONE")).otherwise(F.lit("AWS_IAM")))
    f = t.customer.select(F.concat(F.lit("repo"), F.col("c_custkey") % 30).alias("repo"), F.concat(F.lit("infra/"), k, F.lit(".yaml")).alias("path"), text.alias("content"))
    return sf.serverless_routes(f).select("repo", "code_path", "method", "path", "auth_type")


@query("t03_raw_server_routes", """
SELECT 'repo' || (c_custkey % 30)::VARCHAR AS repo, 's' || c_custkey || '.js' AS code_path, u AS path, 'GET,POST' AS methods FROM customer, unnest(['/x' || c_custkey, '/health']) AS q(u)""")
def _(t):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("http.createServer((req) => { if (req.method === 'POST' && req.url === '/x"), k, F.lit("') a(); if (req.method === 'GET' && req.url === '/health') b(); })"))
    f = t.customer.select(F.concat(F.lit("repo"), F.col("c_custkey") % 30).alias("repo"), F.concat(F.lit("s"), k, F.lit(".js")).alias("path"), text.alias("content"))
    return sf.raw_server_routes(f).select("repo", "code_path", "path", F.array_join("methods_seen", ",").alias("methods"))


# Mount forest: node k is mounted by node k/2 of its repo; every fifth has no resolvable child.
@query("t07_compose_mounts", """
WITH RECURSIVE m AS (SELECT c_nationkey AS repo, floor(c_custkey / 50)::BIGINT AS k FROM customer), n AS (SELECT DISTINCT repo, k FROM m), e AS (SELECT a.repo, b.k AS parent, '/s' || a.k AS prefix, CASE WHEN a.k % 5 <> 4 THEN a.k END AS child FROM n a JOIN n b ON a.repo = b.repo AND b.k = floor(a.k / 2)::BIGINT AND a.k > 0),
 w AS (SELECT repo, 0::BIGINT AS node, '' AS prefix, 0 AS depth FROM n WHERE k = 0 UNION ALL SELECT w.repo, e.child, w.prefix || e.prefix, w.depth + 1 FROM w JOIN e ON e.repo = w.repo AND e.parent = w.node AND e.child IS NOT NULL)
SELECT repo, 'GET' AS method, prefix || '/leaf' AS path, 'resolved' AS status, depth FROM w UNION ALL SELECT w.repo, 'ANY', w.prefix || e.prefix, 'candidate', w.depth FROM w JOIN e ON e.repo = w.repo AND e.parent = w.node AND e.child IS NULL""")
def _(t):
    n = t.sql("SELECT DISTINCT c_nationkey AS repo, cast(floor(c_custkey / 50) AS bigint) AS k FROM customer")
    a, b = n.alias("a"), n.alias("b")
    mounts = (a.join(b, (F.col("a.repo") == F.col("b.repo")) & (F.col("b.k") == F.floor(F.col("a.k") / 2)) & (F.col("a.k") > 0))
              .select(F.col("a.repo").alias("repo"), F.col("b.k").alias("parent"), F.concat(F.lit("/s"), F.col("a.k")).alias("prefix"), F.when(F.col("a.k") % 5 != 4, F.col("a.k")).alias("child")))
    return sf.compose_mounts(n.filter("k = 0").select("repo", F.col("k").alias("node")), mounts, n.select("repo", F.col("k").alias("node"), F.lit("GET").alias("method"), F.lit("/leaf").alias("path")))


@query("t08_mount_auth_coverage", """
WITH RECURSIVE m AS (SELECT 'r' || (c_custkey % 9) AS repo, 'app' || (c_custkey % 40) AS path, c_custkey AS o, CASE c_custkey % 4 WHEN 0 THEN '/api' WHEN 1 THEN '/api/v1' WHEN 2 THEN '/pub' ELSE '/api/v1/x' END AS prefix, c_custkey % 17 = 0 AS auth, 'f' || c_custkey AS target FROM customer),
 h AS (SELECT a.repo, a.target, bool_or(a.auth OR coalesce(g.o < a.o, false)) AS authed FROM m a LEFT JOIN m g ON g.repo = a.repo AND g.path = a.path AND g.auth AND (a.prefix = g.prefix OR starts_with(a.prefix, g.prefix || '/')) GROUP BY 1, 2),
 i AS (SELECT 'r' || (c_custkey % 9) AS repo, 'f' || c_custkey AS path, CASE WHEN c_custkey % 5 = 0 THEN 'f' || (c_custkey + 9) ELSE 'h' || c_custkey END AS target FROM customer),
 w AS (SELECT repo, target AS path FROM h WHERE authed UNION SELECT i.repo, i.target FROM w JOIN i ON i.repo = w.repo AND i.path = w.path WHERE NOT EXISTS (SELECT 1 FROM h WHERE h.repo = i.repo AND h.target = i.target AND NOT h.authed))
SELECT repo, path FROM w""")
def _(t):
    mounts = t.sql("""SELECT 'r' || cast(c_custkey % 9 AS string) AS repo, 'app' || cast(c_custkey % 40 AS string) AS path, c_custkey AS offset, CASE c_custkey % 4 WHEN 0 THEN '/api' WHEN 1 THEN '/api/v1' WHEN 2 THEN '/pub' ELSE '/api/v1/x' END AS prefix,
      c_custkey % 17 = 0 AS auth, 'f' || cast(c_custkey AS string) AS target FROM customer""")
    imports = t.sql("SELECT 'r' || cast(c_custkey % 9 AS string) AS repo, 'f' || cast(c_custkey AS string) AS path, CASE WHEN c_custkey % 5 = 0 THEN 'f' || cast(c_custkey + 9 AS string) ELSE 'h' || cast(c_custkey AS string) END AS target FROM customer")
    return sf.mount_auth_coverage(mounts, imports)


@query("d09_endpoint_guards", """
WITH r AS (SELECT DISTINCT repo, path AS code_path FROM code_files), g AS (SELECT repo, path, regexp_matches(content, 'getServerSession|verifyToken') OR contains(content, 'deny(') AND right(repo, 1) = '1' OR path LIKE 'src/ext/%' AS guarded FROM code_files)
SELECT r.repo, r.code_path, g.guarded, g.guarded IS NOT NULL AS analyzed FROM r LEFT JOIN g ON g.repo = r.repo AND g.path = r.code_path UNION ALL SELECT 'repo0', 'gone' || r_regionkey, NULL, false FROM region""")
def _(t):
    routes = t.code_files.select("repo", F.col("path").alias("code_path")).unionByName(t.region.select(F.lit("repo0").alias("repo"), F.concat(F.lit("gone"), F.col("r_regionkey").cast("string")).alias("code_path"))).withColumn("path", F.lit("/x"))
    covered = t.code_files.filter("path LIKE 'src/ext/%'").select("repo", "path")
    aliases = t.code_files.filter("right(repo, 1) = '1'").select("repo", F.lit("deny").alias("alias")).distinct()
    return sf.endpoint_guards(routes, t.code_files, covered, aliases).select("repo", "code_path", "guarded", "analyzed")


@query("j03_resolve_import", """
WITH i AS (SELECT 'r' || (c_custkey % 9) AS repo, 'src/a/f' || c_custkey || '.ts' AS path, CASE c_custkey % 4 WHEN 0 THEN '../b/m' || c_custkey WHEN 1 THEN './n' || c_custkey WHEN 2 THEN './dir' || c_custkey ELSE '../../gone' END AS spec, c_custkey AS k FROM customer)
SELECT repo, path, spec, CASE k % 4 WHEN 0 THEN 'src/b/m' || k || '.ts' WHEN 1 THEN 'src/a/n' || k || '.js' WHEN 2 THEN 'src/a/dir' || k || '/index.js' END AS target FROM i""")
def _(t):
    i = t.sql("""SELECT 'r' || cast(c_custkey % 9 AS string) AS repo, 'src/a/f' || cast(c_custkey AS string) || '.ts' AS path,
      CASE c_custkey % 4 WHEN 0 THEN '../b/m' || cast(c_custkey AS string) WHEN 1 THEN './n' || cast(c_custkey AS string) WHEN 2 THEN './dir' || cast(c_custkey AS string) ELSE '../../gone' END AS spec FROM customer""")
    f = t.sql("""SELECT 'r' || cast(c_custkey % 9 AS string) AS repo, x.p || cast(c_custkey AS string) || x.e AS path FROM customer CROSS JOIN (VALUES (0, 'src/b/m', '.js'), (0, 'src/b/m', '.ts'), (1, 'src/a/n', '.js'), (2, 'src/a/dir', '/index.js')) AS x(m, p, e) WHERE c_custkey % 4 = x.m""")
    return sf.resolve_import(i, f)


@query("j23_resolve_operation", """
SELECT 'r' || (c_custkey % 9) AS repo, '/op' || c_custkey AS path, CASE c_custkey % 3 WHEN 0 THEN 'api/users' || c_custkey || '.py' WHEN 1 THEN 'api/__init__.py' END AS code_path, c_custkey % 3 < 2 AS analyzed FROM customer""")
def _(t):
    k = F.col("c_custkey").cast("string")
    repo = F.concat(F.lit("r"), F.col("c_custkey") % 9)
    ops = t.customer.select(repo.alias("repo"), F.lit("get").alias("method"), F.concat(F.lit("/op"), k).alias("path"),
                            F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit("api.users"), k, F.lit(".get_user"))).when(F.col("c_custkey") % 3 == 1, F.lit("api.other.get")).otherwise(F.lit("none.get")).alias("operation_id"))
    f = t.customer.select(repo.alias("repo"), F.explode(F.array(F.lit("api/__init__.py"), F.concat(F.lit("api/users"), k, F.lit(".py")))).alias("path"))
    return sf.contract_security(ops, f).select("repo", "path", "code_path", "analyzed")


@query("s14_read_openapi", """
SELECT 'repo' || (c_custkey % 30) AS repo, CASE WHEN c_custkey % 3 = 0 THEN 'a' || c_custkey || '.json' ELSE 'a' || c_custkey || '.yaml' END AS file, method, '/x' || c_custkey || '/{id}' AS path, CASE WHEN method = 'GET' THEN 'get' || c_custkey END AS operation_id, method = 'GET' AS secured
FROM customer, (VALUES ('GET'), ('POST')) AS m(method) WHERE c_custkey % 3 < 2""")
def _(t):
    k = F.col("c_custkey").cast("string")
    m = F.col("c_custkey") % 3
    js = F.concat(F.lit('{"openapi":"3.0","paths":{"/x'), k, F.lit('/{id}":{"get":{"operationId":"get'), k, F.lit('","security":[{"k":[]}]},"post":{}}}}'))
    ya = F.concat(F.lit("openapi: 3.0.0\ninfo:\n  title: t\npaths:\n  /x"), k, F.lit("/{id}:\n    get:\n      operationId: get"), k, F.lit("\n      security:\n        - k: []\n    post:\n      summary: s\n    parameters:\n      - name: q\ncomponents:\n  x: y"))
    f = t.customer.select(F.concat(F.lit("repo"), F.col("c_custkey") % 30).alias("repo"), F.concat(F.lit("a"), k, F.when(m == 0, F.lit(".json")).otherwise(F.lit(".yaml"))).alias("path"),
                          F.when(m == 0, js).when(m == 1, ya).otherwise(F.lit("openapi: 3.0.0\ninfo: {}\n")).alias("content"))
    return intel.read_openapi(f)[0]


# Observations ------------------------------------------------------------------------------------

@query("p16_side_effect_free", """
SELECT route_id, CASE WHEN method = 'GET' AND path LIKE '%upload%' THEN 'skipped-side-effect' WHEN method = 'GET' AND path NOT LIKE '%{%' THEN 'read' ELSE 'not-eligible' END AS probe FROM routes""")
def _(t):
    return dyn.side_effect_free(t.routes).select("route_id", "probe")


VERDICT = """CASE WHEN status IN (401, 403) THEN 'protected' WHEN status = 302 THEN 'redirect' WHEN status IN (200, 206) AND bytes IS NULL THEN 'open-unreadable' WHEN status IN (200, 206) AND soft_deny THEN 'soft-deny' WHEN status IN (200, 206) AND bytes > 2 THEN 'open'
 WHEN status IN (200, 206) THEN 'open-empty' WHEN status = 404 THEN '404' ELSE 'http-' || coalesce(status::VARCHAR, 'none') END"""


@query("a20_reachability_verdicts", f"""
WITH v AS (SELECT * EXCLUDE (verdict), {VERDICT} AS verdict, coalesce(status IN (401, 403) OR status IN (200, 206) AND bytes IS NOT NULL, false) AS obs FROM observations WHERE method = 'GET'),
 g AS (SELECT repo, target, count(*) AS tested, count(*) FILTER (verdict = 'open') AS open, count(*) FILTER (verdict IN ('protected', 'redirect')) AS p, bool_and(status IS NULL) AS unreachable, bool_and(obs) AS o FROM v GROUP BY 1, 2)
SELECT repo, target, tested, open, unreachable, tested >= 3 AND p = 0 AND open > 0 AS fail_open_suspected, NOT (tested >= 3 AND p = 0 AND open > 0) AND NOT unreachable AND o AS trustworthy FROM g""")
def _(t):
    return dyn.reachability_verdicts(t.observations.filter("method = 'GET'"))[1]


@query("a20_reachability_rows", f"SELECT obs_id, {VERDICT} AS verdict FROM observations WHERE method = 'GET'")
def _(t):
    return dyn.reachability_verdicts(t.observations.filter("method = 'GET'"))[0].select("obs_id", "verdict")


@query("a23_write_verdicts", """
WITH v AS (SELECT * EXCLUDE (verdict), CASE WHEN status IN (401, 403) THEN 'auth-enforced' WHEN status = 200 THEN 'candidate' ELSE 'other' END AS verdict FROM observations WHERE method IN ('POST', 'PUT', 'DELETE')),
 g AS (SELECT repo, target, count(*) AS tested, count(*) FILTER (verdict = 'auth-enforced') AS enforced, count(*) FILTER (verdict = 'candidate') AS candidates, bool_and(status IS NULL) AS unreachable FROM v GROUP BY 1, 2)
SELECT *, tested >= 3 AND enforced = 0 AND candidates > 0 AS fail_open_suspected FROM g""")
def _(t):
    return dyn.write_verdicts(t.observations.filter("method IN ('POST', 'PUT', 'DELETE')"))[1]


@query("a24_cross_tenant_verdicts", """
WITH g AS (SELECT repo, path, direction, max(status) FILTER (role = 'owner') AS os, bool_or(role = 'owner' AND marker_match) AS om, max(status) FILTER (role = 'anonymous') AS ans, max(status) FILTER (role = 'attacker') AS st,
   bool_or(role = 'attacker' AND marker_match) AS am, max(status) FILTER (role = 'repeat') AS rs, bool_or(role = 'repeat' AND marker_match) AS rm FROM tenant_probes GROUP BY 1, 2, 3),
 c AS (SELECT *, substr(repo, 5)::INT % 2 = 0 AND os = 200 AND om AND ans IN (401, 403, 404) AS ok FROM g),
 v AS (SELECT *, CASE WHEN st IN (401, 403, 404) THEN 'blocked' WHEN st = 200 AND ok AND am AND rs = 200 AND rm THEN 'leak' WHEN st = 200 AND ok AND am THEN 'repeat-inconclusive' WHEN st = 200 THEN 'candidate' ELSE 'investigate' END AS verdict FROM c)
SELECT repo, path, direction, verdict, CASE WHEN verdict = 'leak' THEN 'confirmed-vulnerable' WHEN verdict = 'blocked' AND ok THEN 'blocked' ELSE 'inconclusive' END AS state FROM v""")
def _(t):
    controls = t.tenant_probes.select("repo").distinct().select("repo", F.lit("app").alias("application_id"), F.lit("b1").alias("build_id"), (F.substring("repo", 5, 9).cast("int") % 2 == 0).alias("identity_ok"))
    return dyn.cross_tenant_verdicts(t.tenant_probes, controls).drop("sample_id")


@query("j12_correlate_dynamic", """
WITH g AS (SELECT * FROM guards WHERE analyzed AND NOT guarded), o AS (SELECT * FROM observations), pr AS (SELECT g.guard_id, o.obs_id FROM g JOIN o ON g.repo = o.repo AND g.method = o.method AND g.path = o.path
   AND (g.service_id IS NULL OR o.service_id IS NULL OR g.service_id = o.service_id) AND (g.code_path = '' OR g.code_path = o.code_path)),
 a AS (SELECT guard_id, count(*) AS n, min(obs_id) AS obs_id FROM pr GROUP BY 1), b AS (SELECT obs_id, count(*) AS n FROM pr GROUP BY 1)
SELECT g.guard_id, CASE WHEN g.method IN ('POST', 'PUT', 'DELETE') THEN 'HIGH' ELSE 'MEDIUM' END AS severity, CASE WHEN a.n = 1 AND b.n = 1 THEN 'observed' WHEN a.n > 0 THEN 'unjudged' ELSE 'none' END AS association FROM g LEFT JOIN a USING (guard_id) LEFT JOIN b USING (obs_id)""")
def _(t):
    # Public pages are kept here so that the paths of both tables meet.
    return dyn.correlate_dynamic(t.guards.withColumn("public_hint", F.lit(False)), t.observations).select("guard_id", "severity", "association")


CTX = "application_id, build_id, identity, endpoint, method, parameter"
SAME = " AND ".join(f"f.{c} = e.{c}" for c in CTX.split(", "))


@query("j13_dast_labels", f"""
WITH fan AS (SELECT plugin_id, count(*) AS fan FROM class_map GROUP BY 1), p AS (SELECT DISTINCT m.attack_class, {', '.join('a.' + c for c in CTX.split(', '))} FROM dast_alerts a JOIN class_map m USING (plugin_id) JOIN fan USING (plugin_id)
   WHERE (a.attack_class IS NULL AND fan = 1 OR a.attack_class = m.attack_class) AND CASE WHEN identity = 'anonymous' THEN coalesce(auth_verified, true) ELSE coalesce(auth_verified, false) END),
 n AS (SELECT DISTINCT attack_class, {CTX} FROM dast_checks WHERE completed AND coverage_complete AND auth_verified AND outcome = 'not-vulnerable' AND (plugin_id, attack_class) IN (SELECT (plugin_id, attack_class) FROM class_map))
SELECT finding_id, CASE WHEN pos AND neg THEN 'conflict' WHEN pos THEN 'confirmed' WHEN neg THEN 'refuted' ELSE 'unjudged' END AS verdict
FROM (SELECT finding_id, EXISTS (SELECT 1 FROM p e WHERE e.attack_class = f.attack_class AND {SAME}) AS pos, EXISTS (SELECT 1 FROM n e WHERE e.attack_class = f.attack_class AND {SAME}) AS neg FROM dast_findings f)""")
def _(t):
    return dyn.dast_labels(t.dast_findings, t.dast_alerts, t.dast_checks, t.class_map).select("finding_id", "verdict")


@query("j14_dast_predict", """
WITH m(attack_class, alert_id) AS (VALUES ('xss', '40012'), ('sqli', '40018'), ('xss', '40014'), ('path-traversal', '6'))
SELECT repo, alert_id, count(*) AS findings, array_to_string(list_sort(list_distinct(list(attack_class))), ',') AS classes, min(file) AS first_file FROM ledger JOIN m USING (attack_class) GROUP BY 1, 2""")
def _(t):
    m = t.sql("SELECT * FROM (VALUES ('xss', '40012'), ('sqli', '40018'), ('xss', '40014'), ('path-traversal', '6')) AS m(attack_class, alert_id)")
    blind = t.sql("SELECT * FROM (VALUES ('idor', 'needs two identities')) AS b(attack_class, reason)")
    return dyn.dast_predict(t.ledger, m, blind)[0].withColumn("classes", F.array_join("classes", ","))


@query("j14_blind_spots", "SELECT repo, attack_class, 'needs two identities' AS reason, count(*) AS findings FROM ledger WHERE attack_class = 'idor' GROUP BY 1, 2")
def _(t):
    m = t.sql("SELECT * FROM (VALUES ('xss', '40012')) AS m(attack_class, alert_id)")
    blind = t.sql("SELECT * FROM (VALUES ('idor', 'needs two identities')) AS b(attack_class, reason)")
    return dyn.dast_predict(t.ledger, m, blind)[1]


# Files -------------------------------------------------------------------------------------------

@query("s02_classify_read", """
WITH r AS (SELECT *, sum(CASE WHEN n_bytes <= 400000 THEN n_bytes ELSE 0 END) OVER (PARTITION BY repo ORDER BY md5(path), path) AS run FROM sized_files)
SELECT repo, path, CASE WHEN n_bytes > 400000 THEN 'oversized' WHEN run > 30000000 THEN 'byte_budget_exceeded' ELSE 'ok' END AS read_status FROM r""")
def _(t):
    return src.classify_read(t.sized_files, 400_000, 30_000_000).select("repo", "path", "read_status")


def _write_files(folder):
    """Task function that writes (repo, path, text) rows as files below a shared folder; a task run again writes the same."""
    def write(frames):
        import os

        import pandas as pd
        for frame in frames:
            for repo, path, text in zip(frame["repo"], frame["path"], frame["text"]):
                full = os.path.join(folder, repo, path)
                os.makedirs(os.path.dirname(full), exist_ok=True)
                with open(full, "wb") as f:
                    f.write(text.encode("utf-8"))
            yield pd.DataFrame({"n": [len(frame)]})
    return write


# Every document is a file of one of two trees, some of them below hidden folders, and is read again.
@query("s01_read_source_tree", """
SELECT 'app' || (doc_id % 2) AS repo, '.d' || (doc_id % 7) || '/' || CASE WHEN doc_id % 3 = 0 THEN 'sub/' ELSE '' END || '_' || doc_id || '.txt' AS path, CASE WHEN octet_length(encode(text)) <= 2000000 THEN sha256(text) END AS sha256,
 octet_length(encode(text))::BIGINT AS n_bytes, CASE WHEN octet_length(encode(text)) <= 2000000 THEN 'ok' ELSE 'oversized' END AS read_status FROM documents WHERE text IS NOT NULL""")
def _(t):
    folder = scratch_dir(t.spark, "tree").removeprefix("file://").removeprefix("file:")
    k = F.col("doc_id")
    rows = t.documents.filter("text IS NOT NULL").select(F.concat(F.lit("app"), k % 2).alias("repo"), F.concat(F.lit(".d"), k % 7, F.when(k % 3 == 0, F.lit("/sub/_")).otherwise(F.lit("/_")), k, F.lit(".txt")).alias("path"), "text")
    rows.mapInPandas(_write_files(folder), "n bigint").agg(F.sum("n")).collect()
    return read_source_tree(t.spark, [f"{folder}/app0", f"{folder}/app1"]).select("repo", "path", "sha256", "n_bytes", "read_status")


@query("s03_prune_paths", """
SELECT repo, path, CASE WHEN path LIKE '.local/%' THEN 'private' WHEN path LIKE '%node_modules/%' OR path LIKE '%/build/%' THEN 'skip-dir' WHEN path LIKE '%.min.js' OR path LIKE 'pkg/tests/%' THEN 'excluded' END AS skip_reason FROM sized_files""")
def _(t):
    return src.prune_paths(t.sized_files, excludes=["pkg/tests", "**/*.min.js"]).select("repo", "path", "skip_reason")


ONLY = "w AS (SELECT DISTINCT repo, rtrim(entry, '/') AS entry FROM requested_paths)"


@query("s04_scope_files", f"""
WITH {ONLY} SELECT DISTINCT l.repo, l.file AS path FROM ledger l JOIN w ON w.repo = l.repo AND (l.file = w.entry OR starts_with(l.file, w.entry || '/'))""")
def _(t):
    files = t.ledger.select("repo", F.col("file").alias("path")).distinct()
    return src.scope_files(files, t.requested_paths)[0]


@query("u03_scope_missed", f"""
WITH {ONLY} SELECT repo, entry FROM w WHERE NOT EXISTS (SELECT 1 FROM ledger l WHERE w.repo = l.repo AND (l.file = w.entry OR starts_with(l.file, w.entry || '/')))""")
def _(t):
    return src.scope_files(t.ledger.select("repo", F.col("file").alias("path")).distinct(), t.requested_paths)[2]


@query("s05_glob_files", "SELECT repo, path FROM sized_files WHERE regexp_matches(path, '^(.*/)?f[^/]*\\.py$')")
def _(t):
    return src.glob_files(t.sized_files, "**/f*.py").select("repo", "path")


@query("s12_read_unified_diff", """
SELECT 'repo' || (c_custkey % 30) AS repo, 'src/f' || c_custkey || '.js' AS path, 10 + i AS start_line, 10 + i + CASE WHEN i = 0 THEN 0 ELSE 2 END AS end_line FROM customer, (VALUES (0), (5)) AS x(i)""")
def _(t):
    k = F.col("c_custkey").cast("string")
    text = F.concat(F.lit("diff --git a/x b/x\n--- a/src/f"), k, F.lit(".js\n+++ b/src/f"), k, F.lit(".js\n@@ -1,2 +10 @@ fn\n+a\n@@ -9,0 +15,3 @@\n+b\n@@ -20,2 +30,0 @@\n-c\n--- a/gone.js\n+++ /dev/null\n@@ -1,3 +1,2 @@\n-d"))
    d = t.customer.select(F.concat(F.lit("repo"), F.col("c_custkey") % 30).alias("repo"), k.alias("diff_id"), text.alias("content"))
    return src.read_unified_diff(d)


@query("w08_fill_forward", """
WITH l AS (SELECT repo, path, u.o AS line, u.x AS text FROM manifest_files, unnest(string_split(content, chr(10))) WITH ORDINALITY AS u(x, o) WHERE path LIKE '.github/%')
SELECT repo, path, line, last_value(CASE WHEN regexp_matches(text, '^[a-z]+:') THEN regexp_extract(text, '^([a-z]+):', 1) END IGNORE NULLS) OVER (PARTITION BY repo, path ORDER BY line) AS block FROM l""")
def _(t):
    l = src.split_lines(t.manifest_files.filter("path LIKE '.github/%'"))
    return src.fill_forward(l, F.when(F.col("text").rlike("^[a-z]+:"), F.regexp_extract("text", "^([a-z]+):", 1))).select("repo", "path", "line", "block")


@query("w09_line_window", """
WITH l AS (SELECT repo, path, u.o AS line, u.x AS text FROM code_files, unnest(string_split(content, chr(10))) WITH ORDINALITY AS u(x, o))
SELECT repo, path, line, md5(string_agg(text, chr(10)) OVER (PARTITION BY repo, path ORDER BY line ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING)) AS digest FROM l""")
def _(t):
    return src.line_window(src.split_lines(t.code_files)).select("repo", "path", "line", F.md5("window").alias("digest"))
