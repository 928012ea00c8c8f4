"""Attack surface: routes, guards, ranked endpoints, contracts, plans."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ident, paths
from .core import cut_lineage, first_row, fixed_point, top_k, unique_match
from .detect.engine import mask_comments

WRITES = ["POST", "PUT", "PATCH", "DELETE"]
# Sinks that raise the risk of an endpoint in the same file.
HOT_SINKS = ["sqli", "sql-injection", "nosql-injection", "command-injection", "ssrf", "path-traversal", "ssti", "eval-injection",
             "insecure-deserialization", "xxe", "mass-assignment"]
# Engines in order of trust: lower wins.
ENGINE_PRIORITY = {"router": 1, "decorator": 2, "filesystem": 3, "serverless": 4, "mount": 5, "raw": 6, "spec": 7}


def normalize_path(path: Column) -> Column:
    """:id, *rest, <int:id>, [id] and [...rest] all become {name}."""
    p = F.regexp_replace(path, r"<(?:[A-Za-z_]+:)?([A-Za-z_]\w*)>", "{$1}")
    p = F.regexp_replace(p, r"\[(?:\.\.\.)?([A-Za-z_]\w*)\]", "{$1}")
    p = F.regexp_replace(p, r":([A-Za-z_]\w*)\??", "{$1}")
    p = F.regexp_replace(p, r"\*([A-Za-z_]\w*)", "{$1}")
    return F.when(p.startswith("/"), p).otherwise(F.concat(F.lit("/"), p))


def contract_path(path: Column) -> Column:
    """Form used to compare with a contract: anonymous parameters, lower case, no trailing slash."""
    p = F.lower(F.regexp_replace(normalize_path(path), r"\{[^}]*\}", "{}"))
    return F.when(p == "/", p).otherwise(F.regexp_replace(p, "/+$", ""))


def path_params(path: Column) -> Column:
    return F.regexp_extract_all(path, F.lit(r"\{([^}]+)\}"), F.lit(1))


def _calls(files: DataFrame, pattern: str, suffixes: str, technology: str, engine: str, method_group: int, path_group: int) -> DataFrame:
    z = F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(method_group)).alias("m"),
                     F.regexp_extract_all("content", F.lit(pattern), F.lit(path_group)).alias("p"))
    return (files.filter(F.col("path").rlike(suffixes)).select("repo", F.col("path").alias("code_path"), F.posexplode(z).alias("pos", "z"))
            .select("repo", "code_path", "pos", F.upper("z.m").alias("method"), normalize_path(F.col("z.p")).alias("path"), F.lit(technology).alias("technology"), F.lit(engine).alias("source")))


def extract_routes(files: DataFrame) -> DataFrame:
    """routes(repo, code_path, method, path, technology, source, params) from router calls, decorators and file names.

    Comments are blanked out first: a route in one is none."""
    files = mask_comments(files).withColumn("content", F.col("code"))
    js, py = r"\.(?:js|jsx|ts|tsx|mjs|cjs)$", r"\.py$"
    express = _calls(files, r"[\w$]\.(get|post|put|patch|delete|head|options|all)\s*\(\s*['\"`](/[^'\"`\n]*)['\"`]", js, "express", "router", 1, 2)
    on = _calls(files, r"\.on\s*\(\s*['\"](get|post|put|patch|delete|GET|POST|PUT|PATCH|DELETE)['\"]\s*,\s*['\"](/[^'\"\n]*)['\"]", js, "hono", "router", 1, 2)
    fastapi = _calls(files, r"@\w+\.(get|post|put|patch|delete|head|options)\s*\(\s*['\"](/[^'\"\n]*)['\"]", py, "fastapi", "decorator", 1, 2)
    spring = _calls(files, r"@(Get|Post|Put|Patch|Delete)Mapping\s*\(\s*(?:value\s*=\s*)?\"(/[^\"\n]*)\"", r"\.java$", "spring", "decorator", 1, 2)
    aspnet = _calls(files, r"\[Http(Get|Post|Put|Patch|Delete)\s*\(\s*\"(/?[^\"\n]*)\"", r"\.cs$", "aspnet", "decorator", 1, 2)
    flask_rx = r"@(?:\w+)\.route\s*\(\s*['\"](/[^'\"\n]*)['\"]([^)\n]*)\)"
    z = F.arrays_zip(F.regexp_extract_all("content", F.lit(flask_rx), F.lit(1)).alias("p"), F.regexp_extract_all("content", F.lit(flask_rx), F.lit(2)).alias("o"))
    flask = files.filter(F.col("path").rlike(py)).select("repo", F.col("path").alias("code_path"), F.posexplode(z).alias("pos", "z"))
    listed = F.regexp_extract_all(F.regexp_extract("z.o", r"methods\s*=\s*\[([^\]]*)\]", 1), F.lit(r"['\"](\w+)['\"]"), F.lit(1))
    flask = flask.select("repo", "code_path", "pos", normalize_path(F.col("z.p")).alias("path"), F.explode(F.when(F.size(listed) > 0, listed).otherwise(F.array(F.lit("GET")))).alias("m"))
    flask = flask.select("repo", "code_path", "pos", F.upper("m").alias("method"), "path", F.lit("flask").alias("technology"), F.lit("decorator").alias("source"))
    app_rx = r"(?:^|/)app/(.*?)/?route\.(?:js|ts)$"
    nxt = files.filter(F.col("path").rlike(app_rx)).select(
        "repo", F.col("path").alias("code_path"), F.posexplode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"export\s+(?:async\s+)?(?:function|const)\s+(GET|POST|PUT|PATCH|DELETE)\b"), F.lit(1)))).alias("pos", "method"))
    nxt = nxt.select("repo", "code_path", "pos", "method", normalize_path(F.concat(F.lit("/"), F.regexp_replace(F.regexp_extract("code_path", app_rx, 1), r"\([^)]*\)/?", ""))).alias("path"),
                     F.lit("next").alias("technology"), F.lit("filesystem").alias("source"))
    out = reduce(DataFrame.unionByName, [express, on, fastapi, spring, aspnet, flask, nxt])
    return out.withColumn("method", F.when(F.col("method") == "ALL", F.lit("ANY")).otherwise(F.col("method"))).withColumn("params", path_params(F.col("path"))).drop("pos").distinct()


def serverless_routes(files: DataFrame) -> DataFrame:
    """Edge functions by path, and template events of serverless functions with their auth type."""
    edge = (files.filter(F.col("path").rlike(r"(?:^|/)(?:supabase/functions|netlify/functions|api)/([\w-]+)(?:/index)?\.(?:ts|js)$"))
            .select("repo", F.col("path").alias("code_path"), F.lit("ANY").alias("method"),
                    F.concat(F.lit("/"), F.regexp_extract("path", r"(?:functions|api)/([\w-]+)(?:/index)?\.(?:ts|js)$", 1)).alias("path"), F.lit(None).cast("string").alias("auth_type")))
    t = files.filter(F.contains("content", F.lit("AWS::Serverless::Function"))).select("repo", F.col("path").alias("code_path"), F.posexplode(F.split("content", r"Type:\s*AWS::Serverless::Function")).alias("_n", "b")).filter("_n > 0").drop("_n")
    # One piece for each event, so that an event without a method doesn't take the next one's.
    event = t.select("repo", "code_path", F.explode(F.split("b", r"Type:\s*['\"]?(?:Http)?Api\b")).alias("e"))
    api = (event.select("repo", "code_path", F.regexp_extract("e", r"Path:\s*['\"]?(/[^\s'\"]*)", 1).alias("p"), F.regexp_extract("e", r"Method:\s*['\"]?(\w+)", 1).alias("m")).filter("p <> ''")
           .select("repo", "code_path", F.upper(F.when(F.col("m") == "", F.lit("ANY")).otherwise(F.col("m"))).alias("method"), normalize_path(F.col("p")).alias("path"), F.lit(None).cast("string").alias("auth_type")))
    url = (t.filter(F.contains("b", F.lit("FunctionUrlConfig"))).select("repo", "code_path", F.lit("ANY").alias("method"), F.lit("/").alias("path"),
                                                                       F.regexp_extract("b", r"AuthType:\s*['\"]?(\w+)", 1).alias("auth_type")))
    return edge.unionByName(api).unionByName(url).withColumn("technology", F.lit("serverless")).withColumn("source", F.lit("serverless"))


def raw_server_routes(files: DataFrame) -> DataFrame:
    """Plain HTTP servers: one row per path literal that the request URL is held against, and the methods seen.

    Methods are compared names and handler methods (do_GET). A server that answers itself but names no path is one row for every path."""
    f = files.filter(F.col("content").rlike(r"createServer\s*\(|BaseHTTPRequestHandler|\bBun\.serve\s*\("))

    def found(pattern, group=1):
        return F.regexp_extract_all("content", F.lit(pattern), F.lit(group))
    p = F.array_distinct(F.concat(found(r"(?:url|pathname|\.path)\s*={2,3}\s*['\"](/[^'\"\n]*)['\"]"), found(r"(?:url|pathname|\.path)\.starts(?:With|with)\s*\(\s*['\"](/[^'\"\n]*)['\"]"), found(r"\bcase\s+['\"](/[^'\"\n]*)['\"]")))
    m = F.array_sort(F.array_distinct(F.concat(F.transform(found(r"\.method\s*={2,3}\s*['\"](\w+)['\"]"), F.upper), found(r"\bdef\s+do_([A-Z]+)\s*\("))))
    answers = F.col("content").rlike(r"\bres(?:ponse)?\.(?:writeHead|end|write)\s*\(|\breq(?:uest)?\.(?:url|method)\b|\bdef\s+do_[A-Z]+\s*\(|\bfetch\s*\(")
    named = F.when(F.size(p) > 0, p).when(answers, F.array(F.lit("/*"))).otherwise(p)
    return f.select("repo", F.col("path").alias("code_path"), m.alias("methods_seen"), F.explode(named).alias("path")).select(
        "repo", "code_path", F.lit("ANY").alias("method"), normalize_path(F.col("path")).alias("path"), F.lit("raw").alias("source"), "methods_seen")


def dedupe_routes(routes: DataFrame) -> DataFrame:
    """First engine wins per (repo, service, method, path); an ANY row yields to any row with its path.

    Adds ``listed``: endpoint, fixture or spec. Nothing is dropped but duplicates."""
    from ..functions.ranks import lookup
    keyed = (routes.withColumn("_prio", lookup(F.col("source"), ENGINE_PRIORITY, 9)).withColumn("_svc", F.coalesce("service_id", F.lit(""))))
    best = first_row(keyed, ["repo", "_svc", "method", "path"], ["_prio", "code_path"])
    exact = best.filter("method <> 'ANY'").select("repo", "_svc", "path").distinct()
    keep = best.filter("method <> 'ANY'").unionByName(best.filter("method = 'ANY'").join(exact, ["repo", "_svc", "path"], "left_anti"))
    listed = F.when(F.col("source") == "spec", F.lit("spec")).when(paths.is_test_file(F.col("code_path")), F.lit("fixture")).otherwise(F.lit("endpoint"))
    return keep.withColumn("listed", listed).drop("_prio", "_svc").select(*routes.columns, "listed")


# Whole names of parameters, and path patterns, of the candidate lists.
BUCKETS = [
    ("write", "method", "^(?:POST|PUT|PATCH|DELETE)$"), ("idor", "param", r"(?:^|_)(?i:id)$|[a-z0-9]Id$|(?i:uuid)"),
    ("ssrf", "param", r"(?i)^(?:url|uri|link|domain|host|endpoint|webhook|feed|rss|image|img|src|proxy|fetch|target|origin|site|address)s?$"),
    ("open_redirect", "param", r"(?i)^(?:redirect|redirect_?uri|next|return|return_?url|callback|continue|dest|destination|goto)s?$"),
    ("traversal", "param", r"(?i)^(?:file|filename|filepath|path|dir|folder|template|name|key|attachment|download|doc)s?$"),
    ("upload", "path", r"(?i)upload|import|attachment|avatar|media"),
    ("auth", "path", r"(?i)login|signin|sign-in|token|password|register|signup|otp|oauth"),
]


def target_buckets(routes: DataFrame) -> DataFrame:
    """(repo, bucket, method, path, signature): which checks an endpoint is a candidate for."""
    def hit(what, rx):
        return F.exists("params", lambda p: p.rlike(rx)) if what == "param" else F.col(what).rlike(rx)
    rows = [F.when(hit(what, rx), F.lit(name)) for name, what, rx in BUCKETS]
    b = F.filter(F.array(*rows), lambda x: x.isNotNull())
    return routes.select("repo", "method", "path", F.explode(b).alias("bucket")).withColumn("signature", F.concat_ws(" ", "method", "path")).distinct()


def attack_surface(routes: DataFrame, guards: DataFrame, sinks: DataFrame, buckets: DataFrame) -> DataFrame:
    """Endpoints with auth verdict and additive risk.

    ``routes(repo, route_id, service_id, method, path, code_path, params)``,
    ``guards(repo, guard_id, service_id, method, path, code_path, guarded, analyzed, public_hint)``,
    ``sinks(repo, path, attack_class)``, ``buckets(repo, bucket, method, path)``. A guard is used only if
    it and the endpoint have each other as their one compatible candidate."""
    m = unique_match(routes, guards, ["repo", "method", "path"], "route_id", "guard_id", compatible=["service_id", "code_path"],
                     payload=["guarded", "analyzed", "public_hint"])
    hot = (sinks.filter(F.col("attack_class").isin(*HOT_SINKS)).select("repo", F.col("path").alias("code_path"), "attack_class").distinct()
           .groupBy("repo", "code_path").agg(F.array_sort(F.collect_set("attack_class")).alias("hot_sinks")))
    flags = buckets.groupBy("repo", "method", "path").agg(*[F.bool_or(F.col("bucket") == b).alias(f"is_{b}") for b in ("idor", "upload", "ssrf", "open_redirect", "auth")])
    j = m.join(hot, ["repo", "code_path"], "left").join(flags, ["repo", "method", "path"], "left")
    auth = (F.when(~F.coalesce("analyzed", F.lit(False)) | F.col("guarded").isNull(), F.lit("unknown")).when(F.col("guarded"), F.lit("guarded"))
            .when(F.coalesce("public_hint", F.lit(False)), F.lit("public")).otherwise(F.lit("UNGUARDED")))
    write, bare = F.col("method").isin(*WRITES), F.col("auth") == "UNGUARDED"

    def yes(c):
        return F.coalesce(c, F.lit(False))
    points = [("unguarded-write", bare & write, 4), ("unguarded-read", bare & ~write, 3), ("object-id-in-path", yes(F.col("is_idor")), 3),
              ("hot-sink-in-file", F.size(F.coalesce("hot_sinks", F.array().cast("array<string>"))) > 0, 3), ("upload", yes(F.col("is_upload")), 2), ("url-parameter", yes(F.col("is_ssrf")), 2),
              ("redirect-parameter", yes(F.col("is_open_redirect")), 1), ("auth-endpoint", yes(F.col("is_auth")), 1), ("path-parameter-unguarded", bare & (F.size("params") > 0), 1)]
    j = j.withColumn("auth", auth)
    risk = reduce(lambda a, b: a + b, [F.when(c, F.lit(n)).otherwise(F.lit(0)) for _w, c, n in points])
    why = F.filter(F.array(*[F.when(c, F.lit(w)) for w, c, _n in points]), lambda x: x.isNotNull())
    return j.select(*routes.columns, "auth", F.coalesce("hot_sinks", F.array().cast("array<string>")).alias("hot_sinks"), write.alias("is_write"), risk.alias("risk"), why.alias("why"))


def surface_order(endpoints: DataFrame) -> DataFrame:
    return endpoints.orderBy(F.desc("risk"), F.desc("is_write"), "path", "method", "service_id", "code_path")


def surface_summary(endpoints: DataFrame) -> DataFrame:
    bare = F.col("auth") == "UNGUARDED"
    return endpoints.groupBy("repo").agg(F.count(F.lit(1)).alias("endpoints"), F.count_if(bare).alias("unguarded"), F.count_if(bare & F.col("is_write")).alias("unguarded_writes"),
                                         F.count_if(F.size("hot_sinks") > 0).alias("with_hot_sink"), F.max("risk").alias("top_risk"))


def contract_diff(spec_ops: DataFrame, routes: DataFrame) -> DataFrame:
    """(repo, method, path, kind): shadow-path, undocumented-method or stale-operation. HEAD and OPTIONS do not count."""
    ops = spec_ops.select("repo", F.upper("method").alias("method"), contract_path(F.col("path")).alias("path")).distinct()
    code = routes.select("repo", F.upper("method").alias("method"), contract_path(F.col("path")).alias("path")).distinct()
    ops_paths = ops.select("repo", "path").distinct()
    extra = code.filter("method <> 'ANY'").join(ops, ["repo", "method", "path"], "left_anti").filter(~F.col("method").isin("HEAD", "OPTIONS"))
    undocumented = extra.join(ops_paths, ["repo", "path"], "left_semi").withColumn("kind", F.lit("undocumented-method"))
    any_shadow = code.filter("method = 'ANY'").join(ops_paths, ["repo", "path"], "left_anti")
    shadow = extra.join(ops_paths, ["repo", "path"], "left_anti").unionByName(any_shadow).withColumn("kind", F.lit("shadow-path"))
    any_code = code.filter("method = 'ANY'").select("repo", "path").distinct()
    stale = (ops.join(code, ["repo", "method", "path"], "left_anti").join(any_code, ["repo", "path"], "left_anti").withColumn("kind", F.lit("stale-operation")))
    cols = ["repo", "method", "path", "kind"]
    return shadow.select(cols).unionByName(undocumented.select(cols)).unionByName(stale.select(cols))


def coverage_warning(routes: DataFrame, files: DataFrame) -> DataFrame:
    """Repos with at least five handler signatures and at most a third as many routes."""
    rx = r"\((?:req|request|ctx|c)\s*(?::\s*\w+)?\s*,\s*(?:res|response|next|reply)\b|def\s+\w+\s*\(\s*request\b"
    handlers = files.groupBy("repo").agg(F.sum(F.regexp_count("content", F.lit(rx))).alias("handlers"))
    n = routes.groupBy("repo").agg(F.count(F.lit(1)).alias("routes"))
    return (handlers.join(n, "repo", "left").withColumn("routes", F.coalesce("routes", F.lit(0))).filter("handlers >= 5 AND routes * 3 <= handlers"))


def contract_security(spec_ops: DataFrame, files: DataFrame) -> DataFrame:
    """Adds code_path and analyzed: an operation id names the longest dotted prefix that is a file.

    ``spec_ops(repo, method, path, operation_id)``. Prefixes are exploded with their rank and joined by
    equality; the longest hit wins. An operation without a file stays unanalysed, never unguarded."""
    parts = F.split("operation_id", r"\.")
    ranked = spec_ops.select("repo", "method", "path", "operation_id", F.explode(F.sequence(F.lit(1), F.size(parts))).alias("k"), parts.alias("_p"))
    cand = ranked.select("repo", "method", "path", "k", F.explode(F.array(F.concat(F.array_join(F.slice("_p", 1, F.col("k")), "/"), F.lit(".py")),
                                                                            F.concat(F.array_join(F.slice("_p", 1, F.col("k")), "/"), F.lit("/__init__.py")))).alias("code_path"))
    present = files.select("repo", F.col("path").alias("code_path")).distinct()
    hit = cand.join(present, ["repo", "code_path"], "left_semi").groupBy("repo", "method", "path").agg(F.max_by("code_path", "k").alias("code_path"))
    return spec_ops.join(hit, ["repo", "method", "path"], "left").withColumn("analyzed", F.col("code_path").isNotNull())


def resolve_import(imports: DataFrame, files: DataFrame) -> DataFrame:
    """Relative specifiers to files: ``imports(repo, path, spec)`` gains ``target``, the first existing candidate."""
    folder = F.regexp_replace("path", r"/?[^/]*$", "")
    joined = F.split(F.concat_ws("/", F.nullif(folder, F.lit("")), F.col("spec")), "/")
    fold = F.aggregate(joined, F.array().cast("array<string>"), lambda acc, p: F.when(p.isin("", "."), acc).when((p == "..") & (F.size(acc) > 0), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0)))).otherwise(F.concat(acc, F.array(p))))
    base = F.array_join(fold, "/")
    ends = ["", ".ts", ".tsx", ".js", ".jsx", ".mjs", ".py", "/index.ts", "/index.tsx", "/index.js", "/__init__.py"]
    cand = imports.select("repo", "path", "spec", F.posexplode(F.transform(F.array(*[F.lit(e) for e in ends]), lambda e: F.concat(base, e))).alias("_k", "target"))
    present = files.select("repo", F.col("path").alias("target")).distinct()
    best = cand.join(present, ["repo", "target"], "left_semi").groupBy("repo", "path", "spec").agg(F.min_by("target", "_k").alias("target"))
    return imports.join(best, ["repo", "path", "spec"], "left")


def compose_mounts(roots: DataFrame, mounts: DataFrame, leaves: DataFrame, max_depth: int | None = None) -> DataFrame:
    """routes(repo, method, path, status, depth) by following mounts from the roots.

    ``roots(repo, node)``, ``mounts(repo, parent, prefix, child)``, ``leaves(repo, node, method, path)``. A
    mount without a child, or one met again on its own way (or beyond ``max_depth``, if given), is a candidate
    row with the prefix known so far. Of ways with one prefix to one node the shortest, then the least, counts.

    Ways from the roots and jumps between any two nodes double in length each round, so a chain of n mounts
    takes log2(n) rounds; in a forest a round has at most one jump for each node."""
    m = mounts.select("repo", F.col("parent").alias("node"), F.col("prefix").alias("_add"), "child")
    # Names of nodes on a way, its first left out: a way may not meet itself.
    jump = m.filter("child IS NOT NULL AND child <> node").select("repo", F.col("node").alias("_from"), F.col("child").alias("node"), F.col("_add").alias("prefix"), F.array("child").alias("way"))
    known = roots.select("repo", "node", F.lit("").alias("prefix"), F.array("node").alias("way"))
    where = ["repo", "node"]

    def least(ways, keys):
        best = F.min_by("way", F.struct(F.size("way"), "way"))
        return cut_lineage(ways.groupBy(*keys).agg(best.alias("way")))

    def onward(ways, jumps, first):
        """Ways with a jump at their end, where the two have no node in common."""
        nxt = jumps.select("repo", F.col("_from").alias("_at"), F.col("node").alias("_to"), F.col("prefix").alias("_add"), F.col("way").alias("_more"))
        j = ways.withColumnRenamed("node", "_at").join(nxt, ["repo", "_at"]).filter(~F.arrays_overlap("way", "_more"))
        if first:
            j = j.filter(~F.array_contains("_more", F.col("_from")))
        return j.select("repo", *(["_from"] if first else []), F.col("_to").alias("node"), F.concat("prefix", "_add").alias("prefix"), F.concat("way", "_more").alias("way"))

    known, jump = least(known, [*where, "prefix"]), least(jump, ["repo", "_from", "node", "prefix"])
    length = 1  # of every jump; known has all ways of fewer mounts
    while max_depth is None or length <= max_depth:
        longer = cut_lineage(onward(known, jump, False))
        if longer.isEmpty():
            break
        known = least(known.unionByName(longer), [*where, "prefix"])
        jump = least(onward(jump, jump, True), ["repo", "_from", "node", "prefix"])
        length *= 2
    known = known.withColumn("depth", F.size("way") - 1)
    if max_depth is not None:
        known = known.filter(F.col("depth") <= max_depth)
    far = F.lit(False) if max_depth is None else F.col("depth") >= max_depth
    routes = known.join(leaves, where).select("repo", "method", F.concat("prefix", "path").alias("path"), F.lit("resolved").alias("status"), "depth")
    stuck = known.join(m, where).filter(F.col("child").isNull() | F.array_contains("way", F.col("child")) | far)
    return routes.unionByName(stuck.select("repo", F.lit("ANY").alias("method"), F.concat("prefix", "_add").alias("path"), F.lit("candidate").alias("status"), "depth")).distinct()


def mount_auth_coverage(mounts: DataFrame, imports: DataFrame) -> DataFrame:
    """covered(repo, path): files whose routes sit under an authenticated mount.

    ``mounts(repo, path, offset, prefix, auth, target)``: ``target`` is the mounted router file. A mount is
    authed if it says so or an earlier auth mount of the same file has a prefix that covers it; an authed
    mount anywhere wins. Coverage spreads over ``imports(repo, path, target)`` but not into files that
    are mounted without auth or into tests."""
    guards = mounts.filter("auth").select("repo", "path", F.col("offset").alias("_go"), F.when(F.col("prefix") == "/", F.lit("")).otherwise(F.col("prefix")).alias("_gp"))
    # The earliest guard per prefix is enough; then each mount asks for its own ancestors by equality.
    first = guards.groupBy("repo", "path", "_gp").agg(F.min("_go").alias("_go"))
    asks = mounts.select("repo", "path", "offset", "prefix", "auth", "target", F.explode(F.concat(F.array(F.lit("")), paths.ancestors(F.col("prefix")))).alias("_gp"))
    hit = asks.join(first, ["repo", "path", "_gp"], "left").groupBy("repo", "target").agg(F.bool_or(F.col("auth") | F.coalesce(F.col("_go") < F.col("offset"), F.lit(False))).alias("authed"))
    hit = cut_lineage(hit.filter("target IS NOT NULL"))
    barred = hit.filter("NOT authed").select("repo", F.col("target").alias("path"))
    start = hit.filter("authed").select("repo", F.col("target").alias("path"))

    def step(front):
        nxt = front.join(imports, ["repo", "path"]).select("repo", F.col("target").alias("path")).distinct()
        return nxt.join(barred, ["repo", "path"], "left_anti").filter(~paths.is_test_file(F.col("path")))
    known, done = fixed_point(start, step, ["repo", "path"], 100_000)
    if not done:
        raise RuntimeError("import chains are longer than 100,000 files")
    return known


def endpoint_guards(routes: DataFrame, files: DataFrame, covered: DataFrame, aliases: DataFrame) -> DataFrame:
    """Routes with guarded and analyzed.

    Guarded: its file names a known guard, calls a guard alias of the repo, or is under an authed mount.
    Alias calls are found by token equality, not by one pattern per repo. A route whose file was not
    read is not analysed and its guard stays NULL."""
    known = r"(?i)requireAuth|getServerSession|isAuthenticated|@login_required|authenticate\s*\(|verifyToken|withAuth\b|currentUser\s*\(|passport\.authenticate|@PreAuthorize|\[Authorize"
    wanted = routes.select("repo", F.col("code_path").alias("path")).distinct()
    src = files.join(wanted, ["repo", "path"], "left_semi")
    calls = src.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_$][\w$]{2,60})\s*\("), F.lit(1)))).alias("alias"))
    by_alias = calls.join(aliases, ["repo", "alias"], "left_semi").select("repo", "path").distinct().withColumn("_alias", F.lit(True))
    state = (src.select("repo", "path", F.col("content").rlike(known).alias("_own")).join(by_alias, ["repo", "path"], "left")
             .join(covered.select("repo", "path").distinct().withColumn("_cov", F.lit(True)), ["repo", "path"], "left")
             .select("repo", F.col("path").alias("code_path"), (F.col("_own") | F.coalesce("_alias", F.lit(False)) | F.coalesce("_cov", F.lit(False))).alias("guarded")))
    return (routes.join(state, ["repo", "code_path"], "left").withColumn("analyzed", F.col("guarded").isNotNull())
            .withColumn("public_hint", F.col("path").rlike(r"(?i)^/(?:health|healthz|ready|metrics|public|login|signup|robots\.txt)")))


def probe_plan(summary: DataFrame, buckets: DataFrame) -> DataFrame:
    """(repo, probe, priority, targets): checks the surface justifies, most important first."""
    # Bucket that justifies a check, the check, its priority.
    plan = {"idor": ("cross-tenant-read", 1), "write": ("write-verbs", 2), "auth": ("credential-endpoints", 3), "ssrf": ("outbound-url", 4), "upload": ("upload-types", 5), "open_redirect": ("redirect-target", 6)}
    name = prio = None
    for b, (probe, p) in plan.items():
        name = F.when(F.col("bucket") == b, F.lit(probe)) if name is None else name.when(F.col("bucket") == b, F.lit(probe))
        prio = F.when(F.col("bucket") == b, F.lit(p)) if prio is None else prio.when(F.col("bucket") == b, F.lit(p))
    t = buckets.withColumn("probe", name).withColumn("priority", prio).groupBy("repo", "probe").agg(F.min("priority").alias("priority"), F.count_distinct("signature").alias("targets"))
    return t.join(summary.select("repo").distinct(), "repo", "left_semi")


def test_plan(endpoints: DataFrame, buckets: DataFrame) -> DataFrame:
    """(repo, phase, position, method, path): at most 12 object-id, 6 unguarded write and 12 sink-backed picks."""
    idor = endpoints.join(buckets.filter("bucket = 'idor'").select("repo", "method", "path").distinct(), ["repo", "method", "path"], "left_semi")
    order = [F.desc("risk"), F.col("path"), F.col("method"), F.col("route_id")]
    picks = [("object-ownership", idor, 12), ("unguarded-writes", endpoints.filter("auth = 'UNGUARDED' AND is_write"), 6), ("sink-backed", endpoints.filter("size(hot_sinks) > 0"), 12)]
    parts = [top_k(df, ["repo"], order, n).select("repo", F.lit(phase).alias("phase"), "position", "method", "path") for phase, df, n in picks]
    return reduce(DataFrame.unionByName, parts)


def invariants(guards: DataFrame, findings: DataFrame, cap: int = 25) -> DataFrame:
    """(repo, principle, statement, status). VIOLATED only on confirmed missing-auth evidence that names one route.

    Capped per repo and principle as a report; the guards table itself holds every route."""
    proof = (findings.filter("attack_class = 'missing-auth' AND confirmed").groupBy("repo", "method", "path").agg(F.count_distinct("service_id").alias("_n")).filter("_n <= 1")
             .select("repo", "method", "path", F.lit(True).alias("_bad")))
    g = guards.select("repo", "method", "path", "guarded", "analyzed").distinct().join(proof, ["repo", "method", "path"], "left")
    status = (F.when(F.col("_bad"), F.lit("VIOLATED")).when(~F.coalesce("analyzed", F.lit(False)), F.lit("UNKNOWN")).when(F.col("guarded"), F.lit("HOLDS")).otherwise(F.lit("UNVERIFIED")))
    principle = F.when(F.col("method").isin(*WRITES), F.lit("authenticated-writes")).otherwise(F.lit("authenticated-reads"))
    rows = g.select("repo", "method", "path", principle.alias("principle"), status.alias("status")).withColumn(
        "statement", F.format_string("Given no session, when %s %s is called, then it is refused", "method", "path"))
    return top_k(rows, ["repo", "principle"], [F.col("status").desc(), F.col("path"), F.col("method")], cap)


def candidate_id(*cols: Column) -> Column:
    return ident.sha(F.concat_ws("|", *cols))
