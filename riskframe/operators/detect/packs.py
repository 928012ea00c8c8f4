"""Detector packs that need more than a rule table: correlation, windows, counts over a repo."""

from __future__ import annotations

import bisect
import itertools
import math
from collections import defaultdict
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ...functions import paths
from ..core import cut_lineage, fixed_point, top_k
from . import rules as R
from .engine import Rule, has_any, mask_comments, scan_rules, with_roles
from .tokens import events as token_events


def sinks(files: DataFrame, gates: DataFrame | None = None) -> DataFrame:
    """Occurrences of the sink rules. ``gates(repo, has_sql, has_nosql)``: a datastore rule is kept
    where the repo has that store or the file reads a request. Comments are blanked out before the scan."""
    src = mask_comments(with_roles(files)).withColumn("content", F.col("code"))
    if gates is None:
        return scan_rules(src, R.SINKS)
    # Whether the file reads a request is decided in the same pass over its text.
    asks = has_any(F.col("content"), ("req", "searchParams", "nextUrl", "params", "ctx.", "body.", "user")) & F.col("content").rlike(R.REQUEST)
    occ = scan_rules(src, R.SINKS, carry={"_req": asks})
    gated = {r.rule_id: r.gate for r in R.SINKS if r.gate}
    j = occ.join(gates, "repo", "left")
    ok = F.lit(True)
    for rule_id, gate in gated.items():
        ok = ok & ((F.col("rule_id") != rule_id) | F.coalesce(f"has_{gate}", F.lit(False)) | F.coalesce("_req", F.lit(False)))
    return j.filter(ok).select(*[c for c in occ.columns if c != "_req"])


def nearest_ancestor(files: DataFrame, roots: DataFrame, root_cols=()) -> DataFrame:
    """Adds the longest ``root`` of the repo that is a whole-component prefix of the path, with its columns.

    Paths are exploded to ancestors and joined by equality; the root "." stands for the whole repo."""
    keyed = files.select("repo", "path").distinct()
    up = keyed.select("repo", "path", F.explode(F.concat(F.array(F.lit(".")), paths.ancestors(F.col("path")))).alias("root"))
    best = (up.join(roots.select("repo", "root", *root_cols), ["repo", "root"])
            .groupBy("repo", "path").agg(F.max_by(F.struct("root", *root_cols), F.when(F.col("root") == ".", F.lit(0)).otherwise(F.length("root"))).alias("_b")))
    return files.join(best, ["repo", "path"], "left").select(*files.columns, *[F.col(f"_b.{c}").alias(c) for c in ("root", *root_cols)])


def client_exposure(files: DataFrame) -> DataFrame:
    """(repo, path, name, kind, severity): public variables that look secret, server secrets in client
    code, committed environment files. A public prefix counts only under a frontend package."""
    f = with_roles(files)
    packages = (files.filter(F.col("path").rlike(r"(^|/)package\.json$"))
                .select("repo", F.coalesce(F.nullif(F.regexp_replace("path", r"/?package\.json$", ""), F.lit("")), F.lit(".")).alias("root"),
                        F.col("content").rlike(R.FRONTEND_DEPS).alias("frontend")))
    names = (f.filter(~F.col("is_test") & has_any(F.col("content"), ("NEXT_PUBLIC_", "VITE_", "REACT_APP_", "GATSBY_", "EXPO_PUBLIC_")))
             .select("repo", "path", "is_doc", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(R.PUBLIC_ENV), F.lit(0)))).alias("name"))
             .filter(F.col("name").rlike(R.SECRETISH)))
    named = nearest_ancestor(names, packages, ["frontend"]).filter("frontend")
    public = named.select("repo", "path", "name", F.when(F.col("name").rlike(R.ANALYTICS_PUBLIC), F.lit("analytics-public")).otherwise(F.lit("public-name")).alias("kind"),
                          F.when(F.col("name").rlike(R.ANALYTICS_PUBLIC), F.lit("INFO")).when(F.col("is_doc"), F.lit("LOW")).otherwise(F.lit("HIGH")).alias("severity"))
    head = F.substring("content", 1, 300)
    server = (f.filter((head.contains("'use client'") | head.contains('"use client"')) & ~F.col("is_test"))
              .select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(R.SERVER_SECRET), F.lit(0)))).alias("name"))
              .select("repo", "path", "name", F.lit("server-secret-in-client").alias("kind"), F.lit("HIGH").alias("severity")))
    env = (files.filter(F.col("path").rlike(r"(^|/)\.env(\.[\w-]+)?$") & ~paths.is_example_file(F.col("path")))
           .select("repo", "path", F.lit(".env").alias("name"), F.lit("committed-environment").alias("kind"), F.lit("MEDIUM").alias("severity")))
    return public.unionByName(server).unionByName(env)


def token_tiers(files: DataFrame) -> DataFrame:
    """(repo, path, role, tier) of hosted-database keys: the payload of a token says anon or service."""
    jwt = (files.filter(F.contains("content", F.lit("eyJ"))).select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all(
        "content", F.lit(r"eyJ[A-Za-z0-9_-]{6,}\.eyJ[A-Za-z0-9_-]{6,}\.[A-Za-z0-9_-]{4,}"), F.lit(0)))).alias("tok")))
    seg = F.translate(F.split_part("tok", F.lit("."), F.lit(2)), "-_", "+/")
    padded = F.rpad(seg, (F.ceil(F.length(seg) / 4) * 4).cast("int"), F.lit("="))
    payload = F.from_json(F.try_to_binary(padded, F.lit("base64")).cast("string"), "role string, iss string, ref string")
    role = F.lower(F.col("d.role"))
    by_jwt = (jwt.withColumn("d", payload).filter(role.isin("anon", "service_role") & (F.lower(F.coalesce("d.iss", F.lit(""))).contains("supabase") | F.col("d.ref").isNotNull()))
              .select("repo", "path", role.alias("role")))
    pub = files.filter(F.col("content").rlike(r"\bsb_publishable_[A-Za-z0-9]{10,}\b")).select("repo", "path", F.lit("anon").alias("role"))
    sec = files.filter(F.col("content").rlike(r"\bsb_secret_[A-Za-z0-9]{10,}\b")).select("repo", "path", F.lit("service_role").alias("role"))
    return (by_jwt.unionByName(pub).unionByName(sec).distinct()
            .withColumn("tier", F.when(F.col("role") == "anon", F.lit("INFO")).otherwise(F.lit("CRITICAL"))))


def secret_defaults(files: DataFrame) -> DataFrame:
    """(repo, path, var, literal, dev_ish, guarded, severity, confidence) of hard-coded fallbacks.

    Guarded: some file of the repo refuses to start without the variable."""
    from ..findings import asserted_variables
    f = with_roles(files).filter(~F.col("is_test") & ~F.col("is_example") & has_any(F.col("content"), ("process.env", "environ", "getenv")))

    def pairs(pattern):
        return F.arrays_zip(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)).alias("var"), F.regexp_extract_all("content", F.lit(pattern), F.lit(2)).alias("literal"))
    hits = f.select("repo", "path", F.explode(F.array_distinct(F.concat(*[pairs(p) for p in R.SECRET_DEFAULT]))).alias("h")).select("repo", "path", "h.var", "h.literal")
    guarded = asserted_variables(files).withColumn("guarded", F.lit(True))
    signs = files.groupBy("repo").agg(F.bool_or(F.col("content").rlike(R.JWT_USE)).alias("_jwt"))
    dev = F.col("literal").rlike(R.DEVISH)
    severity = (F.when(F.col("guarded"), F.lit("LOW")).when(dev & F.col("_jwt"), F.lit("CRITICAL")).when(dev, F.lit("HIGH")).otherwise(F.lit("MEDIUM")))
    return (hits.join(guarded, ["repo", "var"], "left").join(signs, "repo", "left").withColumn("guarded", F.coalesce("guarded", F.lit(False)))
            .select("repo", "path", "var", "literal", dev.alias("dev_ish"), "guarded", severity.alias("severity"),
                    F.when(F.col("guarded") | dev, F.lit("MEDIUM")).otherwise(F.lit("LOW")).alias("confidence")))


def auth_scheme(files: DataFrame) -> DataFrame:
    """(repo, scheme, files_seen): the first scheme in order that any file of the repo shows."""
    counts = files.groupBy("repo").agg(*[F.count_if(F.col("content").rlike(p)).alias(n) for n, p in R.AUTH_SCHEMES])
    pick, seen = F.lit("none"), F.lit(0).cast("bigint")
    for name, _p in reversed(R.AUTH_SCHEMES):
        pick, seen = F.when(F.col(f"`{name}`") > 0, F.lit(name)).otherwise(pick), F.when(F.col(f"`{name}`") > 0, F.col(f"`{name}`")).otherwise(seen)
    return counts.select("repo", pick.alias("scheme"), seen.alias("files_seen"))


def password_policy(files: DataFrame) -> DataFrame:
    """(repo, path, enforces, strongest, drift): requirement sets per validation window.

    A window starts at a password field and ends after 320 characters or at the next field. Drift: a
    strict subset of the repo's strongest set when that has three classes or more."""
    cut = F.split("content", f"(?={R.PASSWORD_FIELD})")
    win = (files.filter(F.lower("content").contains("password")).select("repo", "path", F.explode(cut).alias("w"))
           .filter(F.col("w").rlike("^" + R.PASSWORD_FIELD)).withColumn("w", F.substring("w", 1, 320))
           .filter(F.col("w").rlike(r"\.min\s*\(|minLength|isLength|matches\s*\(|regex\s*\(|\.test\s*\(|pattern|isStrongPassword")))
    strong = F.col("w").contains("isStrongPassword")
    classes = F.filter(F.array(*[F.when(strong | F.col("w").rlike(p), F.lit(n)) for n, p in R.PASSWORD_CLASSES]), lambda x: x.isNotNull())
    blocks = win.select("repo", "path", classes.alias("enforces")).filter(F.size("enforces") > 0).distinct()
    best = blocks.groupBy("repo").agg(F.max_by("enforces", F.struct(F.size("enforces"), F.array_join("enforces", ","))).alias("strongest"))
    sub = (F.size(F.array_except("enforces", "strongest")) == 0) & (F.size("enforces") < F.size("strongest"))
    return blocks.join(best, "repo").withColumn("drift", sub & (F.size("strongest") >= 3))


def workflow_injection(files: DataFrame) -> DataFrame:
    """(repo, path, line, expression): untrusted contexts inside ``run:`` bodies of workflows.

    Lines are assigned to their block by filling the last key forward: a body line is one indented
    deeper than the ``run:`` it follows. The window is one file."""
    wf = files.filter(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))
    lines = wf.select("repo", "path", F.posexplode(F.split("content", "\n")).alias("pos", "text")).filter("trim(text) <> ''")
    indent = F.length("text") - F.length(F.ltrim("text"))
    run = F.col("text").rlike(r"^\s*(?:-\s+)?run\s*:")
    key_indent = F.when(run, F.length(F.regexp_extract("text", r"^(\s*(?:-\s+)?)", 1)))
    w = W.partitionBy("repo", "path").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    l = lines.withColumn("_run", run).withColumn("_ind", indent).withColumn("_at", F.last(F.when(run, F.col("pos")), True).over(w)).withColumn("_key", F.last(key_indent, True).over(w))
    closed = F.max(F.when(~F.col("_run") & (F.col("_ind") <= F.col("_key")), F.col("pos"))).over(w)
    body = l.withColumn("_closed", closed).filter("_run OR (_at IS NOT NULL AND (_closed IS NULL OR _closed < _at))")
    hits = body.select("repo", "path", (F.col("pos") + 1).alias("line"), F.explode(F.regexp_extract_all("text", F.lit(R.UNTRUSTED_CONTEXT), F.lit(0))).alias("expression"))
    return hits.filter(~F.col("expression").rlike(R.SAFE_CONTEXT))


def unpinned_actions(files: DataFrame) -> DataFrame:
    """(repo, action, ref, files): workflow steps not pinned to a full commit id."""
    wf = files.filter(F.col("path").rlike(r"(^|/)\.github/workflows/[^/]+\.ya?ml$"))
    z = F.arrays_zip(F.regexp_extract_all("content", F.lit(R.USES), F.lit(1)).alias("action"), F.regexp_extract_all("content", F.lit(R.USES), F.lit(2)).alias("ref"))
    u = wf.select("repo", "path", F.explode(F.array_distinct(z)).alias("z")).select("repo", "path", "z.action", "z.ref")
    return (u.filter(~F.col("ref").rlike("^[0-9a-f]{40}$") & ~F.col("action").startswith("./")).groupBy("repo", "action", "ref").agg(F.count_distinct("path").alias("files")))


def repeated_secret_fetch(files: DataFrame) -> DataFrame:
    """(repo, path, secret, n): the same secret key fetched more than once in a file."""
    keys = files.filter(F.lower("content").contains("secret")).select("repo", "path", F.explode(F.regexp_extract_all("content", F.lit(R.SECRET_FETCH), F.lit(1))).alias("secret"))
    return keys.groupBy("repo", "path", "secret").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def pii_boundary(files: DataFrame) -> DataFrame:
    """(repo, name, kind, place): masking helpers nobody calls, and raw entities returned with personal fields."""
    f = with_roles(files).filter("NOT is_test")
    defs = f.select("repo", "path", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(R.MASK_DEF), F.lit(1)))).alias("name")).filter(F.length("name") > 0)
    # Only tokens that start like a helper are counted, so the token table stays small.
    tokens = f.select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"\b((?:mask|redact|canViewFull|scrub|anonymi[sz]e|toPublic)\w+)\b"), F.lit(1))).alias("name"))
    used = tokens.groupBy("repo", "name").agg(F.count(F.lit(1)).alias("mentions"))
    dead = (defs.groupBy("repo", "name").agg(F.min("path").alias("place")).join(used, ["repo", "name"]).filter("mentions <= 1")
            .select("repo", "name", F.lit("masking-unused").alias("kind"), "place"))
    raw = (f.filter(F.col("content").rlike(R.RES_RAW) & F.col("content").rlike(R.PII_FIELD) & ~F.col("content").rlike(R.MASK_CALL))
           .select("repo", F.regexp_extract("content", "(" + R.RES_RAW + ")", 1).alias("name"), F.lit("raw-entity-returned").alias("kind"), F.col("path").alias("place")))
    return dead.unionByName(raw)


def manifest_dependencies(files: DataFrame) -> DataFrame:
    """declarations(repo, ecosystem, name, spec, file) of npm and pip manifests."""
    npm = (files.filter(F.col("path").rlike(r"(^|/)package\.json$"))
           .select("repo", F.col("path").alias("file"), F.from_json("content", "dependencies map<string,string>, optionalDependencies map<string,string>").alias("d")))
    npm = npm.select("repo", "file", F.explode(F.map_concat(F.coalesce("d.dependencies", F.create_map().cast("map<string,string>")),
                                                            F.map_filter(F.coalesce("d.optionalDependencies", F.create_map().cast("map<string,string>")),
                                                                         lambda k, v: ~F.array_contains(F.map_keys(F.coalesce("d.dependencies", F.create_map().cast("map<string,string>"))), k)))).alias("name", "spec"))
    npm = npm.select("repo", F.lit("npm").alias("ecosystem"), "name", "spec", "file")
    line = F.trim(F.split_part("l", F.lit("#"), F.lit(1)))
    pip = (files.filter(F.col("path").rlike(r"(^|/)requirements[^/]*\.txt$")).select("repo", F.col("path").alias("file"), F.explode(F.split("content", "\n")).alias("l"))
           .select("repo", "file", line.alias("l")).filter("l <> '' AND NOT l RLIKE '^(-|git[+]|http)'"))
    pip = pip.select("repo", F.lit("pip").alias("ecosystem"), F.regexp_extract("l", r"^([A-Za-z0-9._-]+)", 1).alias("name"),
                     F.coalesce(F.nullif(F.trim(F.regexp_extract("l", r"^[A-Za-z0-9._-]+\s*(.*)$", 1)), F.lit("")), F.lit("*")).alias("spec"), "file")
    return npm.unionByName(pip.filter("name <> ''"))


def npm_unpinned(spec):
    """Floating npm version; workspace, file, link and alias forms are intentional."""
    s = F.trim(F.coalesce(spec, F.lit("")))
    intentional = F.lit(False)
    for p in R.NPM_INTENTIONAL:
        intentional = intentional | s.startswith(p)
    return F.when((s == "") | intentional, F.lit(False)).when(s.rlike(r"^\d"), F.lower(s).rlike(r"[x*]")).otherwise(F.lit(True))


def pip_unpinned(spec):
    s = F.trim(F.coalesce(spec, F.lit("")))
    return ~s.contains("==") & ~s.contains("@")


def package_pin_state(spec, launcher):
    """local, exact or unresolved for a package run through npx, uvx and the like."""
    node = launcher.isin("npx", "bunx")
    exact = F.when(node, spec.rlike(r"^(?:@[\w.-]+/)?[\w.-]+@\d+\.\d+\.\d+(?:-[\w.-]+)?(?:\+[\w.-]+)?$")).otherwise(
        spec.rlike(r"^[\w.-]+(?:\[[\w.,-]+\])?(?:==|@)\d+(?:\.\d+)*(?:(?:a|b|rc|post|dev)\d+)?$"))
    git = spec.rlike(r"^(?:git\+https://|git\+ssh://|git://|github:)") & F.when(node, spec.rlike("#[0-9a-fA-F]{40}$")).otherwise(spec.rlike("@[0-9a-fA-F]{40}$"))
    return F.when(spec.rlike(r"^(?:\./|\.\./|/|file:)"), F.lit("local")).when(git | exact, F.lit("exact")).otherwise(F.lit("unresolved"))


def lock_entries(files: DataFrame) -> DataFrame:
    """lock_entries(repo, folder, name, resolved) of npm lock files, old and new layout."""
    lock = (files.filter(F.col("path").rlike(r"(^|/)(?:package-lock|npm-shrinkwrap)\.json$"))
            .select("repo", F.regexp_replace("path", r"/?[^/]*$", "").alias("folder"),
                    F.from_json("content", "packages map<string, struct<name string, resolved string, integrity string>>, dependencies map<string, struct<resolved string, integrity string>>").alias("d")))
    ok = lambda v: F.col(f"{v}.resolved").isNotNull() & F.col(f"{v}.integrity").isNotNull()
    new = (lock.select("repo", "folder", F.explode("d.packages").alias("k", "v"))
           .select("repo", "folder", F.coalesce("v.name", F.when(F.contains("k", F.lit("node_modules/")), F.substring_index("k", "node_modules/", -1))).alias("name"), ok("v").alias("resolved")))
    old = lock.select("repo", "folder", F.explode("d.dependencies").alias("name", "v")).select("repo", "folder", "name", ok("v").alias("resolved"))
    return (new.unionByName(old).filter("name IS NOT NULL AND name <> ''").groupBy("repo", "folder", "name").agg(F.bool_or("resolved").alias("resolved")))


def dependency_hygiene(files: DataFrame) -> DataFrame:
    """(repo, file, name, kind, severity): suspicious scripts, drift, floating versions, open scopes."""
    scripts = (files.filter(F.col("path").rlike(r"(^|/)package\.json$"))
               .select("repo", F.col("path").alias("file"), F.explode(F.from_json("content", "scripts map<string,string>")["scripts"]).alias("name", "body"))
               .filter(F.col("name").isin(*R.LIFECYCLE_KEYS) & F.col("body").rlike(R.SUSPICIOUS_SCRIPT))
               .select("repo", "file", "name", F.lit("malicious-install-script").alias("kind"), F.lit("MEDIUM").alias("severity")))
    d = manifest_dependencies(files).withColumn("folder", F.regexp_replace("file", r"/?[^/]*$", ""))
    floating = F.when(F.col("ecosystem") == "npm", npm_unpinned(F.col("spec"))).otherwise(pip_unpinned(F.col("spec")))
    unpinned = d.filter(floating).select("repo", "file", "name", F.lit("unpinned").alias("kind"), F.lit("INFO").alias("severity"))
    scope = F.lower(F.regexp_extract("name", r"^@([\w.-]+)/", 1))
    open_scope = (d.filter((F.col("ecosystem") == "npm") & (scope != "") & ~scope.isin(*R.PUBLIC_SCOPES) & ~F.col("spec").rlike(r"^(?:workspace:|file|link|portal:|catalog:|npm:|git|http)"))
                  .select("repo", "file", "name", F.lit("scope-confusion").alias("kind"), F.lit("INFO").alias("severity")))
    locks = lock_entries(files)
    locked = locks.select("repo", "folder").distinct()
    drift = (d.filter("ecosystem = 'npm'").join(locked, ["repo", "folder"], "left_semi").join(locks, ["repo", "folder", "name"], "left_anti")
             .select("repo", "file", "name", F.lit("lockfile-drift").alias("kind"), F.lit("LOW").alias("severity")))
    return scripts.unionByName(unpinned).unionByName(open_scope).unionByName(drift)


def table_events(files: DataFrame) -> DataFrame:
    """(repo, path, pos, name, kind, policy, owned): statements on tables of .sql files, comments and literals blanked out.

    Kinds: create, drop, column, enable, disable, policy, unpolicy. ``name`` is schema.table in lower case, public where
    no schema is named. Bodies between dollar signs are read like the rest. Renames are not followed."""
    clean = F.regexp_replace("content", R.SQL_NOISE, " ")
    stmt = (files.filter(F.endswith("path", F.lit(".sql"))).select("repo", "path", F.posexplode(F.split(clean, ";")).alias("pos", "s"))
            .filter(F.col("s").rlike(R.SQL_VERB)))

    def part(pattern, group):
        return F.regexp_extract("s", pattern, group)
    switch = F.element_at(F.filter(F.regexp_extract_all("s", F.lit(R.SQL_SWITCH), F.lit(1)), lambda w: ~F.lower(w).startswith("no")), -1)
    # Of each kind: pattern, group of the name, policy, whether an owner column is named.
    owned = F.col("s").rlike(R.OWNER_COLUMN)
    none, no = F.lit(None).cast("string"), F.lit(False)
    kinds = [("create", R.SQL_CREATE, 1, none, owned), ("column", R.SQL_ADD_COLUMN, 1, none, owned), ("policy", R.SQL_POLICY, 2, part(R.SQL_POLICY, 1), no), ("unpolicy", R.SQL_UNPOLICY, 2, part(R.SQL_UNPOLICY, 1), no)]
    rows = [F.when(F.col("s").rlike(p), F.struct(part(p, g).alias("name"), F.lit(k).alias("kind"), pol.alias("policy"), own.alias("owned"))) for k, p, g, pol, own in kinds]
    rows.append(F.when(F.col("s").rlike(R.SQL_ALTER) & F.col("s").rlike(R.SQL_SWITCH) & switch.isNotNull(),
                       F.struct(part(R.SQL_ALTER, 1).alias("name"), F.when(F.lower(switch) == "disable", F.lit("disable")).otherwise(F.lit("enable")).alias("kind"), none.alias("policy"), no.alias("owned"))))
    # One statement may drop several tables.
    drops = F.transform(F.split(part(R.SQL_DROP, 1), ","), lambda n: F.struct(F.trim(F.regexp_replace(n, r"(?i)\s+(?:CASCADE|RESTRICT)\s*$", "")).alias("name"), F.lit("drop").alias("kind"), none.alias("policy"), no.alias("owned")))
    every = F.concat(F.filter(F.array(*rows), lambda e: e.isNotNull()), F.when(F.col("s").rlike(R.SQL_DROP), drops).otherwise(F.filter(drops, lambda e: F.lit(False))))
    e = stmt.select("repo", "path", "pos", F.explode(every).alias("e")).select("repo", "path", "pos", "e.*")
    bare = F.lower(F.regexp_replace("name", r"[\"`\s]", ""))
    return e.withColumn("name", F.when(bare.contains("."), bare).otherwise(F.concat(F.lit("public."), bare))).withColumn("policy", F.lower(F.regexp_replace("policy", r"[\"`]", "")))


def table_states(files: DataFrame) -> DataFrame:
    """(repo, name, exists, owned, rls, policies): each table after all statements, in the order of paths and of places in them.

    What comes before a table's last drop counts no more; a policy dropped later is none; the last switch of row security
    decides. Partial aggregation by table and by policy, no list of statements."""
    # Statements are few; written once, so that texts are read once.
    ev = cut_lineage(table_events(files)).withColumn("o", F.struct("path", "pos"))
    dropped = ev.filter("kind = 'drop'").groupBy("repo", "name").agg(F.max("o").alias("_gone"))
    live = ev.filter("kind <> 'drop'").join(dropped, ["repo", "name"], "left").filter("_gone IS NULL OR o > _gone")
    # First by policy (null for the rest), then by table.
    by_policy = live.groupBy("repo", "name", "policy").agg(
        F.bool_or(F.col("kind") == "create").alias("exists"), F.bool_or(F.col("owned")).alias("owned"), (F.max_by("kind", "o") == "policy").alias("_held"),
        F.max(F.when(F.col("kind").isin("enable", "disable"), F.struct("o", "kind"))).alias("_switch"))
    now = by_policy.groupBy("repo", "name").agg(F.bool_or("exists").alias("exists"), F.bool_or("owned").alias("owned"), F.max("_switch").alias("_switch"),
                                                F.count_if(F.col("policy").isNotNull() & F.col("_held")).alias("policies"))
    now = now.select("repo", "name", "exists", "owned", F.coalesce(F.col("_switch.kind") == "enable", F.lit(False)).alias("rls"), "policies")
    gone = dropped.select("repo", "name").join(now, ["repo", "name"], "left_anti")
    return now.unionByName(gone.select("repo", "name", F.lit(False).alias("exists"), F.lit(False).alias("owned"), F.lit(False).alias("rls"), F.lit(0).cast("bigint").alias("policies")))


def missing_rls(files: DataFrame) -> DataFrame:
    """(repo, tables, owner_tables): repos with owner-scoped tables and no policy or row security left at the end, on any table."""
    per_repo = table_states(files).groupBy("repo").agg(F.count_if("exists").alias("tables"), F.count_if(F.col("exists") & F.col("owned")).alias("owner_tables"), F.bool_or(F.col("rls") | (F.col("policies") > 0)).alias("_rls"))
    return per_repo.filter("NOT _rls AND owner_tables > 0").drop("_rls")


def entities(files: DataFrame) -> DataFrame:
    """(repo, path, kind, name) of declared entities."""
    def found(kind, pattern):
        return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda n: F.struct(F.lit(kind).alias("kind"), n.alias("name")))
    rows = F.flatten(F.array(*[found(kind, p) for kind, p in R.ENTITIES]))
    return files.select("repo", "path", F.explode(F.array_distinct(rows)).alias("e")).select("repo", "path", "e.*")


def tenant_keys(files: DataFrame, k: int = 6, sample: int = 5) -> DataFrame:
    """(repo, key, occurrences, position, files): the tenant keys named most, with up to five files.

    Counts are per file first; both the sums and the smallest paths are partial aggregates."""
    f = with_roles(files).filter("NOT is_test")
    counts = F.filter(F.array(*[F.when(F.contains("content", F.lit(key)), F.struct(F.lit(key).alias("key"), F.regexp_count("content", F.lit(key + r"(?!entif|entit)")).alias("n"))) for key in R.TENANT_KEYS]),
                      lambda x: x.isNotNull() & (x["n"] > 0))
    hits = f.select("repo", "path", F.explode(counts).alias("h")).select("repo", "path", "h.key", "h.n")
    total = hits.groupBy("repo", "key").agg(F.sum("n").alias("occurrences"))
    best = top_k(total, ["repo"], [F.col("occurrences").desc(), F.col("key")], k)
    few = top_k(hits.select("repo", "key", "path").distinct(), ["repo", "key"], [F.col("path")], sample, "_p")
    names = few.groupBy("repo", "key").agg(F.array_sort(F.collect_set("path")).alias("files"))
    return best.join(names, ["repo", "key"])


# Dependency names and the label each stands for.
STACK_LABELS = {
    "framework": {"express": "express", "next": "next", "react": "react", "vue": "vue", "fastify": "fastify", "koa": "koa", "flask": "flask", "fastapi": "fastapi", "django": "django", "svelte": "svelte", "@nestjs/core": "nestjs"},
    "datastore": {"pg": "postgres", "mysql2": "mysql", "mongoose": "mongodb", "mongodb": "mongodb", "redis": "redis", "ioredis": "redis", "psycopg2": "postgres", "sqlalchemy": "sql-orm", "@prisma/client": "prisma(sql)", "better-sqlite3": "sqlite", "@aws-sdk/client-dynamodb": "dynamodb", "pymongo": "mongodb"},
}
# File suffix to language, and the languages no rule analyses.
LANGUAGES = {".js": "javascript", ".jsx": "javascript", ".mjs": "javascript", ".cjs": "javascript", ".ts": "typescript", ".tsx": "typescript", ".py": "python", ".java": "java", ".cs": "csharp", ".go": "go", ".rb": "ruby",
             ".php": "php", ".rs": "rust", ".swift": "swift", ".kt": "kotlin", ".ex": "elixir", ".exs": "elixir", ".scala": "scala", ".c": "c", ".cpp": "cpp", ".dart": "dart"}
ANALYSED = ["javascript", "typescript", "python", "java", "csharp", "go", "ruby", "php"]
SQL_STORES = ["postgres", "postgresql", "mysql", "mariadb", "sqlite", "mssql", "sqlserver", "aurora", "oracle", "cockroach", "prisma(sql)", "sql-orm"]
NOSQL_STORES = ["dynamodb", "dynamo", "mongodb", "mongo", "firestore", "cosmos", "cosmosdb", "couchdb", "cassandra", "redis"]


def language_of(path):
    from ...functions.ranks import lookup
    return lookup(paths.extension(path), LANGUAGES)


def unanalyzed_languages(files: DataFrame) -> DataFrame:
    """(language, files) for recognised languages without rules, most files first."""
    lang = files.select(language_of(F.col("path")).alias("language")).filter(F.col("language").isNotNull() & ~F.col("language").isin(*ANALYSED))
    return lang.groupBy("language").agg(F.count(F.lit(1)).alias("files")).orderBy(F.desc("files"), "language")


def stack(files: DataFrame) -> DataFrame:
    """(repo, kind, label): languages, frameworks, datastores and package managers seen."""
    from ...functions.ranks import lookup
    langs = files.select("repo", F.lit("language").alias("kind"), language_of(F.col("path")).alias("label"))
    deps = manifest_dependencies(files)
    by_dep = [deps.select("repo", F.lit(kind).alias("kind"), lookup(F.lower("name"), table).alias("label")) for kind, table in STACK_LABELS.items()]
    managers = deps.select("repo", F.lit("package-manager").alias("kind"), F.col("ecosystem").alias("label"))
    out = langs.unionByName(managers)
    for d in by_dep:
        out = out.unionByName(d)
    return out.filter("label IS NOT NULL").distinct()


def datastore_gates(stack_rows: DataFrame) -> DataFrame:
    s = stack_rows.filter("kind = 'datastore'")
    sqlish = F.col("label").isin(*SQL_STORES) | (F.contains("label", F.lit("sql")) & ~F.contains("label", F.lit("nosql")))
    return s.groupBy("repo").agg(F.bool_or(sqlish).alias("has_sql"), F.bool_or(F.col("label").isin(*NOSQL_STORES)).alias("has_nosql"))


def text_leaks(texts: DataFrame, rules=None) -> DataFrame:
    """Value shapes in any text table: (repo, path, content) in, occurrences out."""
    return scan_rules(texts, rules or R.TEXT_SHAPES)


def subscription_authz(files: DataFrame) -> DataFrame:
    """(repo, field): subscription fields with a tenant argument and no identity check in any resolver naming them."""
    arg = r"(\w+)\s*\([^)]*\b(?:groupId|group_id|orgId|org_id|tenantId|tenant_id|workspaceId|accountId|conversationId|channelId)\b"
    body = F.regexp_extract("content", r"type\s+Subscription\b[^{]*\{([^}]*)\}", 1)
    fields = (files.filter(F.contains("content", F.lit("Subscription"))).select("repo", F.explode(F.regexp_extract_all(body, F.lit(arg), F.lit(1))).alias("field")).distinct())
    bound = F.col("content").rlike(r"identity\.(?:sub|username|claims|resolverContext)|\$ctx\.identity|util\.unauthorized")
    names = files.filter(F.contains("path", F.lit("resolver")) & bound).select("repo", F.explode(F.array_distinct(F.regexp_extract_all("content", F.lit(r"\b([A-Za-z_]\w{2,60})\b"), F.lit(1)))).alias("field"))
    return fields.join(names, ["repo", "field"], "left_anti")


def config_checks(files: DataFrame) -> DataFrame:
    return scan_rules(files, [Rule(n, "transport-security", p, suffixes=(sfx,)) for n, p, sfx, _cwe in R.CONFIG_CHECKS])


def taint_events(files: DataFrame) -> DataFrame:
    """Assignments and sink calls of each file in order, from its token table."""
    return token_events(files)


def taint_flows(files: DataFrame) -> DataFrame:
    """(repo, path, scope, pos, sink, hops): sinks whose first argument may carry request data, a row for each call; ``pos`` is its line from 0."""
    asks = has_any(F.col("content"), ("req", "searchParams", "nextUrl", "params", "query", "body", "ctx", "userInput", "userProvided"))
    reads = F.regexp_replace("content", r"\s*+\??([.\[])\s*+", "$1").rlike(R.REQUEST)  # without it nothing can be tainted
    return taint_over(taint_events(files.filter(F.when(asks, reads).otherwise(False))))


#: Events of a file up to which one task walks it; longer files are walked by joins.
FILE_EVENTS = 200_000


def taint_over(events: DataFrame) -> DataFrame:
    """taint_flows of events(repo, path, scope, at, pos, kind, var, refs, source, conditional) in the order of ``at``.

    A plain assignment of a variable opens a segment; conditional ones after it join that segment. A use
    is tainted when a tainted definition of its segment lies before it, so a segment is represented by
    the position of its first tainted definition and no definition-use pairs are listed. Taint spreads
    to a fixed point. Files are dealt out once and walked where they lie; those of more than FILE_EVENTS events
    are walked by joins that stay inside one file and scope."""
    ev = cut_lineage(events.select("repo", "path", "scope", "at", "pos", "kind", "var", "refs", "source", "conditional"))
    at = ["repo", "path", "scope"]
    long = cut_lineage(ev.groupBy(*at).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FILE_EVENTS).drop("_n"))
    if long.isEmpty():
        return _walked(ev)
    same = reduce(lambda a, c: a & F.col("e." + c).eqNullSafe(F.col("l." + c)), at, F.lit(True))
    return _walked(ev.alias("e").join(long.alias("l"), same, "left_anti")).unionByName(_joined(ev.alias("e").join(long.alias("l"), same, "left_semi")))


def _walked(ev: DataFrame) -> DataFrame:
    """taint_over of files that fit in a task: the events of one file and scope in their order, round by round, as the joins do it."""
    kinds = {f.name: f.dataType.simpleString() for f in ev.schema}
    schema = ", ".join(f"{c} {kinds[c]}" for c in ("repo", "path", "scope", "pos")) + f", sink {kinds['var']}, hops int"
    target = to_arrow_schema(StructType.fromDDL(schema))

    def tainted(events: list[dict], named: bool) -> list[tuple]:
        # Each use is looked at once, as a segment only remembers from where on its uses are tainted. Without a name nothing joins: only sources count.
        ids = [(e["at"], e["kind"], e["var"], e["pos"]) for e in events]
        since: dict = {}  # of each variable, the plain definition that holds
        defs, uses = defaultdict(list), defaultdict(dict)
        for _, group in itertools.groupby(range(len(events)) if named else (), key=lambda i: ids[i][0]):
            group = list(group)
            for i in group:  # uses look back before the definitions of their own event
                for var in events[i]["refs"] or ():
                    if var is not None and ids[i][0] is not None:
                        uses[var, since.get(var, -1)][ids[i]] = None
            own = [i for i in group if ids[i][1] == "assign" and ids[i][2] is not None and ids[i][0] is not None]
            for i in own:
                if events[i]["conditional"] is False:
                    since[ids[i][2]] = ids[i][0]
            for i in own:
                defs[ids[i]].append((ids[i][2], since.get(ids[i][2], -1)))
        ordered = {key: list(found) for key, found in uses.items()}
        places = {key: [x[0] for x in found] for key, found in ordered.items()}
        left = {key: len(found) for key, found in ordered.items()}  # uses from here on are tainted
        known = {x: 0 for x, e in zip(ids, events, strict=True) if e["source"]}
        front, hops = list(known), 0
        while front:
            hops += 1
            first: dict = {}
            for x in front:
                for key in defs.get(x, ()):
                    if key in left and x[0] < first.get(key, math.inf):
                        first[key] = x[0]
            front = []
            for key, place in first.items():
                start = bisect.bisect_right(places[key], place)
                for x in ordered[key][start:left[key]]:
                    if x not in known:
                        known[x] = hops
                        front.append(x)
                left[key] = min(left[key], start)
        return [(x[3], x[2], n) for x, n in known.items() if x[1] == "sink"]

    def run(batches):
        rows = (row for batch in batches for row in batch.to_pylist())
        out = []
        for key, own in itertools.groupby(rows, key=lambda r: (r["repo"], r["path"], r["scope"])):
            out += [{"repo": key[0], "path": key[1], "scope": key[2], "pos": pos, "sink": var, "hops": hops} for pos, var, hops in tainted(list(own), None not in key)]
            if len(out) > 10_000:
                yield pa.RecordBatch.from_pylist(out, target)
                out = []
        yield pa.RecordBatch.from_pylist(out, target)
    return ev.repartition("repo", "path", "scope").sortWithinPartitions("repo", "path", "scope", "at").mapInArrow(run, schema)


def _joined(events: DataFrame) -> DataFrame:
    """taint_over by joins inside one file and scope, for files of any length."""
    ev = cut_lineage(events.select("repo", "path", "scope", "at", "pos", "kind", "var", "refs", "source", "conditional", F.struct("at", "kind", "var", "pos").alias("id")))
    at = ["repo", "path", "scope"]
    own = ev.schema["id"].dataType
    uses = ev.select(*at, F.explode("refs").alias("var"), F.col("at").alias("p"), "id")
    defs = ev.filter("kind = 'assign'").select(*at, "var", F.col("at").alias("p"), "id", "conditional")
    # One pass over a variable's events in order: a use looks back before the definitions of its own event.
    line = (defs.select(*at, "var", "p", F.lit(1).alias("o"), F.when(~F.col("conditional"), F.col("p")).alias("plain"), F.lit(None).cast(own).alias("uid"), F.col("id").alias("did"))
            .unionByName(uses.select(*at, "var", "p", F.lit(0).alias("o"), F.lit(None).cast("int").alias("plain"), F.col("id").alias("uid"), F.lit(None).cast(own).alias("did")).distinct()))
    w = W.partitionBy(*at, "var").orderBy("p", "o").rowsBetween(W.unboundedPreceding, W.currentRow)
    seg = cut_lineage(line.withColumn("since", F.coalesce(F.last("plain", True).over(w), F.lit(-1))).drop("plain"))
    key = [*at, "var", "since"]
    def_of = seg.filter("did IS NOT NULL").select(*key, F.col("p").alias("dpos"), F.col("did").alias("id"))
    use_of = seg.filter("uid IS NOT NULL").select(*key, F.col("p").alias("upos"), F.col("uid").alias("next"))
    start = ev.filter("source").select(*at, "id", F.lit(0).alias("hops"))

    def step(front):
        first = front.join(def_of, [*at, "id"]).groupBy(*key).agg(F.min("dpos").alias("dpos"), F.min("hops").alias("hops"))
        return first.join(use_of, key).filter("upos > dpos").select(*at, F.col("next").alias("id"), (F.col("hops") + 1).alias("hops"))
    known, done = fixed_point(start, step, [*at, "id"], 100_000)
    if not done:
        raise RuntimeError("taint did not reach a fixed point")
    return known.filter("id.kind = 'sink'").select(*at, F.col("id.pos").alias("pos"), F.col("id.var").alias("sink"), "hops")
