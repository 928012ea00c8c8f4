"""Threat intelligence, reachability, re-assessment."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ident import cve_of

# Probability called high, days a feed stays fresh.
HIGH_EPSS = 0.5
FRESH_DAYS = 7
# Distribution name to import name.
PY_ALIAS = {"pyyaml": "yaml", "beautifulsoup4": "bs4", "pillow": "pil", "scikit-learn": "sklearn", "opencv-python": "cv2", "python-dateutil": "dateutil",
            "msgpack-python": "msgpack", "protobuf": "google", "setuptools": "setuptools", "pyjwt": "jwt", "python-jose": "jose", "python-multipart": "multipart",
            "mysqlclient": "mysqldb", "psycopg2-binary": "psycopg2"}
JS_ECOSYSTEMS = ["npm", "node-pkg", "yarn", "pnpm"]
PY_ECOSYSTEMS = ["pip", "python-pkg", "poetry", "pipenv", "uv"]


def enrich_exploitability(findings: DataFrame, epss: DataFrame, kev: DataFrame) -> DataFrame:
    """Adds cve_id, epss, epss_pct, kev, exploit_level by equality on the CVE named first in cve, key, title.

    The ids are looked up once per distinct CVE, so a CVE with a third of all findings is one probe."""
    named = findings.withColumn("cve_id", cve_of(*[F.col(c) for c in ("cve", "key", "title") if c in findings.columns]))
    ids = named.select("cve_id").filter("cve_id IS NOT NULL").distinct()
    intel = (ids.join(epss.select(F.col("cve").alias("cve_id"), F.col("epss").alias("_e"), F.col("percentile").alias("_p")), "cve_id", "left")
             .join(kev.select(F.col("cve").alias("cve_id"), F.lit(True).alias("_k")), "cve_id", "left"))
    out = named.drop("epss", "epss_pct", "kev").join(intel, "cve_id", "left")
    level = F.when(F.col("_k"), F.lit("known-exploited")).when(F.col("_e") >= HIGH_EPSS, F.lit("high")).when(F.col("_e").isNotNull(), F.lit("scored"))
    return (out.withColumn("epss", F.col("_e")).withColumn("epss_pct", F.col("_p"))
            .withColumn("kev", F.when(F.col("cve_id").isNotNull(), F.coalesce("_k", F.lit(False)))).withColumn("exploit_level", level).drop("_e", "_p", "_k"))


def js_root(spec: Column) -> Column:
    """Package of an import: @scope/name of @scope/name/sub, name of name/sub; empty for relative and built-in ones."""
    s = F.trim(F.coalesce(spec, F.lit("")))
    scoped = F.array_join(F.slice(F.split(s, "/"), 1, 2), "/")
    return F.when(s.rlike(r"^(?:[./]|node:)") | (s == ""), F.lit("")).when(s.startswith("@"), scoped).otherwise(F.split_part(s, F.lit("/"), F.lit(1)))


def py_candidates(pkg: Column) -> Column:
    """Import names a distribution may have."""
    from ..functions.ranks import lookup
    p = F.lower(F.trim(F.coalesce(pkg, F.lit(""))))
    all_ = F.array(p, F.replace(p, F.lit("-"), F.lit("_")), lookup(p, PY_ALIAS), F.when(p.startswith("python-"), F.replace(F.substring(p, 8, 200), F.lit("-"), F.lit("_"))))
    return F.filter(F.array_distinct(all_), lambda c: c.isNotNull() & (c != ""))


def import_roots(files: DataFrame) -> DataFrame:
    """imports(repo, family, root) of first-party source."""
    js = (files.filter(F.col("path").rlike(r"\.(?:js|jsx|ts|tsx|mjs|cjs)$"))
          .select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"(?:require\s*\(|import\s*\(|from|import)\s*['\"]([^'\"\n]{1,200})['\"]"), F.lit(1))).alias("s"))
          .select("repo", F.lit("js").alias("family"), F.lower(js_root(F.col("s"))).alias("root")))
    py = (files.filter(F.endswith("path", F.lit(".py"))).select("repo", F.explode(F.regexp_extract_all("content", F.lit(r"(?m)^\s*(?:import|from)\s+([A-Za-z0-9_]+)"), F.lit(1))).alias("s"))
          .select("repo", F.lit("py").alias("family"), F.lower("s").alias("root")))
    return js.unionByName(py).filter("root <> ''").distinct()


def enrich_reachability(findings: DataFrame, imports: DataFrame) -> DataFrame:
    """Adds reachability to dependency rows: imported, no-import-found or n/a.

    No claim is made where the ecosystem's imports are not read or the repo has no readable import."""
    sca = F.col("category").endswith("sca") & F.col("pkg").isNotNull() & (F.col("pkg") != "")
    eco = F.lower(F.coalesce("ecosystem", F.lit("")))
    family = F.when(eco.isin(*JS_ECOSYSTEMS), F.lit("js")).when(eco.isin(*PY_ECOSYSTEMS), F.lit("py"))
    pk = findings.filter(sca & family.isNotNull()).select("repo", "pkg", family.alias("family")).distinct()
    cand = F.when(F.col("family") == "js", F.array_distinct(F.array(F.lower(js_root(F.col("pkg"))), F.lower("pkg")))).otherwise(py_candidates(F.col("pkg")))
    hit = pk.select("repo", "pkg", "family", F.explode(cand).alias("root")).join(imports, ["repo", "family", "root"], "left_semi").select("repo", "pkg", "family").distinct()
    readable = imports.select("repo").distinct().withColumn("_any", F.lit(True))
    j = findings.withColumn("family", family).join(hit.withColumn("_hit", F.lit(True)), ["repo", "pkg", "family"], "left").join(readable, "repo", "left")
    state = (F.when(~sca | ~F.coalesce("_any", F.lit(False)) | F.col("family").isNull(), F.when(sca, F.lit("n/a")))
             .when(F.col("_hit"), F.lit("imported")).otherwise(F.lit("no-import-found")))
    return j.withColumn("reachability", state).select(*findings.columns, "reachability")


def feed_age_days(feed_date: Column, today: Column) -> Column:
    return F.datediff(today, feed_date)


def freshness(feed_date: Column, today: Column) -> Column:
    return F.when(feed_date.isNull(), F.lit("unavailable")).when(feed_age_days(feed_date, today) > FRESH_DAYS, F.lit("stale")).otherwise(F.lit("fresh"))


def reassess(findings: DataFrame, epss: DataFrame, kev: DataFrame, epss_date: Column, kev_date: Column):
    """(findings, events) with newer intelligence.

    ``findings`` carry cve, epss, kev, status, and the feed dates of their own evidence as intel_epss_date
    and intel_kev_date with has_intel. Evidence newer than the snapshot, or with a missing date, blocks
    the row (``blocked``). An acknowledged row reopens when it became known-exploited or crossed the
    high mark."""
    ids = findings.select("cve").filter("cve IS NOT NULL").distinct()
    intel = (ids.join(epss.select("cve", F.col("epss").alias("_e")), "cve", "left").join(kev.select("cve", F.lit(True).alias("_k")), "cve", "left"))
    j = findings.join(intel, "cve", "left").withColumn("_k", F.coalesce("_k", F.lit(False)))
    incomplete = F.col("has_intel") & (F.col("intel_epss_date").isNull() | F.col("intel_kev_date").isNull())
    older = F.col("has_intel") & ((F.col("intel_epss_date") > epss_date) | (F.col("intel_kev_date") > kev_date))
    block = F.when(F.col("cve").isNotNull() & incomplete, F.lit("incomplete-provenance")).when(F.col("cve").isNotNull() & F.coalesce(older, F.lit(False)), F.lit("older-snapshot"))
    j = j.withColumn("blocked", block)
    apply = F.col("cve").isNotNull() & F.col("blocked").isNull()
    rose = (F.col("_k") & ~F.coalesce("kev", F.lit(False))) | ((F.coalesce("_e", F.lit(0.0)) >= HIGH_EPSS) & (F.coalesce("epss", F.lit(0.0)) < HIGH_EPSS))
    reopen = apply & (F.col("status") == "acknowledged") & rose
    changed = F.filter(F.array(
        F.when(apply & ~F.col("_k").eqNullSafe(F.col("kev")), F.struct(F.when(F.col("_k"), F.lit("newly-exploited")).otherwise(F.lit("kev-changed")).alias("kind"), F.col("kev").cast("string").alias("previous"), F.col("_k").cast("string").alias("current"))),
        F.when(apply & ~F.col("_e").eqNullSafe(F.col("epss")), F.struct(F.lit("epss-changed").alias("kind"), F.col("epss").cast("string").alias("previous"), F.col("_e").cast("string").alias("current"))),
        F.when(reopen, F.struct(F.lit("reopened").alias("kind"), F.lit("acknowledged").alias("previous"), F.lit("open").alias("current")))), lambda e: e.isNotNull())
    events = j.select("repo", "finding_id", F.explode(changed).alias("e")).select("repo", "finding_id", "e.*")
    out = (j.withColumn("new_status", F.when(reopen, F.lit("open")).otherwise(F.col("status")))
           .withColumn("new_epss", F.when(apply, F.col("_e")).otherwise(F.col("epss"))).withColumn("new_kev", F.when(apply, F.col("_k")).otherwise(F.col("kev"))))
    return out.select("repo", "finding_id", "cve", "blocked", F.col("new_status").alias("status"), F.col("new_epss").alias("epss"), F.col("new_kev").alias("kev"), reopen.alias("reopened")), events


def registry_plan(declarations: DataFrame, local: DataFrame, private_scopes: DataFrame, private_index: DataFrame) -> DataFrame:
    """Adds suppressed_reason to distinct declared names: local, private scope, private index, invalid; NULL is queued."""
    d = (declarations.withColumn("name_l", F.lower("name")).groupBy("repo", "ecosystem", "name_l").agg(F.min_by(F.struct("name", "file"), F.struct("file", "name")).alias("r"))
         .select("repo", "ecosystem", "name_l", "r.*"))
    scope = F.when(F.startswith("name_l", F.lit("@")), F.split_part(F.substring("name_l", 2, 300), F.lit("/"), F.lit(1)))
    d = (d.withColumn("scope", scope).join(local.select("repo", F.lower("name").alias("name_l"), F.lit(True).alias("_l")).distinct(), ["repo", "name_l"], "left")
         .join(private_scopes.select("repo", F.lower("scope").alias("scope"), F.lit(True).alias("_s")).distinct(), ["repo", "scope"], "left")
         .join(private_index.select("repo", F.lit("pip").alias("ecosystem"), F.lit(True).alias("_i")).distinct(), ["repo", "ecosystem"], "left"))
    why = (F.when(F.col("_l"), F.lit("local")).when(F.col("_s"), F.lit("private-scope")).when(F.col("_i"), F.lit("private-index"))
           .when(~valid_registry_name(F.col("ecosystem"), F.col("name")), F.lit("invalid-name")))
    return d.select("repo", "ecosystem", "name", "file", why.alias("suppressed_reason"))


def valid_registry_name(ecosystem: Column, name: Column) -> Column:
    npm = name.rlike(r"^(?:@[a-z0-9~-][a-z0-9._~-]*/)?[a-z0-9~-][a-z0-9._~-]*$") & (F.length(name) <= 214)
    pip = name.rlike(r"(?i)^[A-Z0-9](?:[A-Z0-9._-]*[A-Z0-9])?$") & (F.length(name) <= 214)
    return F.when(ecosystem == "npm", npm).when(ecosystem == "pip", pip).otherwise(F.lit(False))


def registry_class(plan: DataFrame, index: DataFrame, locks: DataFrame) -> DataFrame:
    """State of queued names against an ``index(ecosystem, name, known)`` table: exists, missing or unknown.

    A missing name that a lock file once resolved was published and removed; otherwise it never existed."""
    once = locks.filter("resolved").select("repo", F.lower("name").alias("_n")).distinct().withColumn("_once", F.lit(True))
    q = plan.filter("suppressed_reason IS NULL").join(index, ["ecosystem", "name"], "left").withColumn("_n", F.lower("name")).join(once, ["repo", "_n"], "left")
    state = F.when(F.col("known"), F.lit("exists")).when(~F.col("known"), F.lit("missing")).otherwise(F.lit("unknown"))
    cls = F.when(state == "missing", F.when(F.col("_once"), F.lit("unpublished-or-removed")).otherwise(F.lit("nonexistent")))
    return q.select("repo", "ecosystem", "name", "file", state.alias("state"), cls.alias("class"))
