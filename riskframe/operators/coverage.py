"""What was analysed: outcomes, gaps, digests, gates, scope."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths
from .core import multiset_digest

EXECUTION_STATUSES = ["oversized", "byte_budget_exceeded", "unreadable", "parse_failed"]


def input_digest(files: DataFrame) -> DataFrame:
    """(repo, input_digest, inputs): order-independent digest of (path, sha256), built from partial sums."""
    return files.groupBy("repo").agg(multiset_digest(F.col("path"), F.col("sha256")).alias("input_digest"), F.count(F.lit(1)).alias("inputs"))


def scope_digest(coverage: DataFrame) -> Column:
    """Digest column over the fields that select what is reviewed."""
    keep = [c for c in ("profile", "detector_revision", "excludes", "include_fixtures", "review_policy", "scanners") if c in coverage.columns]
    return F.sha2(F.to_json(F.struct(*sorted(keep))), 256)


def coverage_rows(files: DataFrame, outcomes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(coverage, gaps). One coverage row per repo; a gap row for whatever was not analysed.

    ``files(repo, path, read_status, analysable)``, ``outcomes(repo, detector, outcome)``."""
    bad = files.filter("read_status <> 'ok'").groupBy("repo", F.col("read_status").alias("kind")).agg(F.count(F.lit(1)).alias("affected"))
    by_read = bad.withColumn("execution", F.col("kind").isin(*EXECUTION_STATUSES))
    failed = (outcomes.filter("outcome <> 'completed'").groupBy("repo").agg(F.count(F.lit(1)).alias("affected"))
              .select("repo", F.lit("detector").alias("kind"), "affected", F.lit(True).alias("execution")))
    unsupported = (files.filter("read_status = 'ok' AND NOT analysable").groupBy("repo").agg(F.count(F.lit(1)).alias("affected"))
                   .select("repo", F.lit("unsupported_source").alias("kind"), "affected", F.lit(False).alias("execution")))
    gaps = by_read.unionByName(failed).unionByName(unsupported)
    count = files.groupBy("repo").agg(F.count(F.lit(1)).alias("seen"), F.count_if(F.col("read_status") == "ok").alias("read"), F.count_if((F.col("read_status") == "ok") & F.col("analysable")).alias("scanned"))
    broken = gaps.groupBy("repo").agg(F.bool_or("execution").alias("_x"))
    cov = (count.join(broken, "repo", "left").withColumn("execution_complete", ~F.coalesce("_x", F.lit(False)))
           .withColumn("no_analyzable_source", (F.col("seen") > 0) & (F.col("scanned") == 0)).drop("_x"))
    return cov, gaps


def execution_errors(coverage: DataFrame) -> DataFrame:
    """Adds errors ARRAY<STRING>: contradictions inside one coverage row."""
    tests = [("complete-with-execution-gap", F.col("execution_complete") & (F.col("execution_gaps") > 0)), ("incomplete-without-gap", ~F.col("execution_complete") & (F.col("execution_gaps") == 0)),
             ("read-exceeds-seen", F.col("read") > F.col("seen")), ("scanned-exceeds-read", F.col("scanned") > F.col("read")), ("digest-missing", (F.col("read") > 0) & F.col("input_digest").isNull()),
             ("not-complete", ~F.col("execution_complete"))]
    return coverage.withColumn("errors", F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests]), lambda e: e.isNotNull()))


EVIDENCE = ("repo string, area string, item string, outcome string, execution boolean, selected boolean, installed boolean, runnable boolean, ran boolean, errors bigint, "
            "amount bigint, allowed bigint, truncated bigint")
PROFILE_OUTCOMES = ["completed", "manual", "unknown", "not-applicable", "not_applicable"]


def _constraints():
    """(error, area, condition that violates it) over one row of evidence; an unknown value never passes for a good one."""
    c = F.col
    good, no_errors = c("outcome").eqNullSafe("completed"), F.coalesce("errors", F.lit(0)) == 0
    sure = lambda name: F.coalesce(c(name), F.lit(False))
    selected = sure("selected")
    return [
        ("not-complete", "claim", ~good), ("gap-unclassified", "gap", c("execution").isNull()), ("execution-gap", "gap", sure("execution")),
        ("read-loss", "read", F.coalesce("amount", F.lit(1)) != 0), ("selection-truncated", "read", F.coalesce("truncated", F.lit(0)) != 0),
        ("bytes-invalid", "bytes", c("amount") < 0), ("limit-invalid", "bytes", c("allowed") < 0), ("bytes-over-limit", "bytes", c("amount") > c("allowed")),
        ("check-incomplete", "check", ~good), ("check-reported-errors", "check", ~no_errors),
        ("selection-unknown", "scanner", c("selected").isNull()), ("scanner-incomplete", "scanner", selected & ~(good & sure("ran") & sure("installed") & sure("runnable"))),
        ("scanner-reported-errors", "scanner", selected & ~no_errors),
        ("import-incomplete", "import", ~(good & sure("ran"))), ("import-gap", "import", good & sure("ran") & (sure("execution") | ~no_errors)),
        ("route-errors", "route", ~no_errors), ("route-diagnostics-truncated", "route", F.coalesce("truncated", F.lit(0)) != 0), ("route-gap", "route", sure("execution")),
        ("route-count-invalid", "route", c("amount") < 0), ("route-limit-invalid", "route", c("allowed") < 0),
        ("profile-check-failed", "profile", ~F.coalesce(c("outcome").isin(*PROFILE_OUTCOMES), F.lit(False))),
    ]


def evidence_errors(evidence: DataFrame) -> DataFrame:
    """(repo, error, items, example): every contradiction between a claim of completion and its detailed evidence.

    ``evidence`` has the columns of EVIDENCE, a row for each claim, gap, kind of read loss, byte account, check, scanner, import,
    route engine and profile check. All constraints are tried in one pass over the rows. Those across rows of a repo come from the
    same aggregate: claim-missing, claims-disagree, claimed-complete-despite (a complete claim beside any other error), and
    reads-disagree (byte accounts of one item that name different amounts). ``items`` counts, ``example`` is the least item."""
    tests = _constraints()
    areas = sorted({a for _n, a, _c in tests})
    hits = [F.when((F.col("area") == a) & F.coalesce(cond, F.lit(False)), F.lit(n)) for n, a, cond in tests]
    hits.append(F.when(~F.coalesce(F.col("area").isin(*areas), F.lit(False)), F.lit("area-unknown")))
    found = F.filter(F.array(*hits), lambda e: e.isNotNull())
    seen = evidence.select("repo", "area", "item", "amount", F.col("outcome").eqNullSafe("completed").alias("_good"), found.alias("_found"))
    rows = seen.select("repo", "item", F.explode("_found").alias("error"))
    claim = F.col("area").eqNullSafe("claim")
    per_repo = seen.groupBy("repo").agg(F.count_if(claim).alias("_claims"), F.coalesce(F.bool_or(F.when(claim, F.col("_good"))), F.lit(False)).alias("_yes"), F.coalesce(F.bool_or(F.when(claim, ~F.col("_good"))), F.lit(False)).alias("_no"),
                                        F.coalesce(F.bool_or(F.when(~claim, F.size("_found") > 0)), F.lit(False)).alias("_bad"))
    across = F.filter(F.array(F.when(F.col("_claims") == 0, F.lit("claim-missing")), F.when(F.col("_yes") & F.col("_no"), F.lit("claims-disagree")), F.when(F.col("_yes") & F.col("_bad"), F.lit("claimed-complete-despite"))), lambda e: e.isNotNull())
    cross = per_repo.select("repo", F.lit(None).cast("string").alias("item"), F.explode(across).alias("error"))
    double = (seen.filter("area = 'bytes' AND item IS NOT NULL AND amount IS NOT NULL").groupBy("repo", "item").agg((F.min("amount") < F.max("amount")).alias("_d")).filter("_d")
              .select("repo", "item", F.lit("reads-disagree").alias("error")))
    return (rows.unionByName(cross).unionByName(double).groupBy("repo", "error").agg(F.count(F.lit(1)).alias("items"), F.min("item").alias("example")))


def scanner_outcomes(installed: DataFrame, requested: DataFrame, results: DataFrame, validity: DataFrame) -> DataFrame:
    """(repo, tool, outcome). Every tool that is installed, requested or left a result gets one row.

    ``installed(repo, tool, runnable)``, ``requested(repo, tool)``, ``results(repo, tool, status)``,
    ``validity(repo, tool, outcome)``; status is NULL for a clean exit."""
    on = ["repo", "tool"]
    j = (installed.withColumn("_i", F.lit(True)).join(requested.select(*on).distinct().withColumn("_q", F.lit(True)), on, "full_outer")
         .join(results.withColumn("_r", F.lit(True)), on, "full_outer").join(validity.withColumnRenamed("outcome", "_v"), on, "left"))
    i, q, r = [F.coalesce(c, F.lit(False)) for c in ("_i", "_q", "_r")]
    outcome = (F.when(~q, F.when(i, F.lit("not_selected")).otherwise(F.lit("unavailable"))).when(~i, F.lit("unavailable")).when(~F.coalesce("runnable", F.lit(False)), F.lit("unsupported_adapter"))
               .when(~r, F.lit("not_run")).when(F.col("status") == "timeout", F.lit("timeout")).when(F.col("status").isNotNull() | (F.col("_v") == "error"), F.lit("error"))
               .when(F.col("_v").isin("parse_failed", "wrong_shape"), F.lit("parse_failed")).when(F.col("_v").isNull(), F.lit("missing_output")).when(F.col("_v") == "partial", F.lit("partial"))
               .otherwise(F.lit("completed")))
    return j.select(*on, outcome.alias("outcome"))


def thin_languages(services: DataFrame, catalog: DataFrame) -> DataFrame:
    """Languages seen in a repo for which no sink rule exists. ``services(repo, language)``, ``catalog(language)``."""
    return services.select("repo", "language").distinct().join(catalog.select("language").distinct(), "language", "left_anti").select("repo", "language")


def profile_status(services: DataFrame, checks: DataFrame, occurrences: DataFrame) -> DataFrame:
    """(repo, service_id, check_id, status, findings). ``checks(check_id, profile, automated)`` is the catalog.

    Automated checks are completed where their service was examined, else unknown; the rest are manual."""
    found = occurrences.groupBy("repo", "service_id", "check_id").agg(F.count(F.lit(1)).alias("findings"))
    every = services.select("repo", "service_id", "profile", "examined").join(checks, "profile")
    return (every.join(found, ["repo", "service_id", "check_id"], "left")
            .select("repo", "service_id", "check_id", F.when(~F.col("automated"), F.lit("manual")).when(F.col("examined"), F.lit("completed")).otherwise(F.lit("unknown")).alias("status"),
                    F.coalesce("findings", F.lit(0)).alias("findings")))


def proof_score(expectations: DataFrame, facts: DataFrame) -> DataFrame:
    """Per app: checks passed, total and state; an incomplete run is unknown, not a failure.

    ``expectations(app, metric, minimum)``, ``facts(app, metric, value, complete)``."""
    j = expectations.join(facts, ["app", "metric"], "left")
    ok = F.coalesce(F.col("value") >= F.col("minimum"), F.lit(False))
    g = j.groupBy("app").agg(F.count_if(ok).alias("passed"), F.count(F.lit(1)).alias("total"), F.bool_and(F.coalesce("complete", F.lit(False))).alias("complete"))
    return g.withColumn("state", F.when(~F.col("complete"), F.lit("unknown")).when(F.col("passed") == F.col("total"), F.lit("passed")).otherwise(F.lit("failed"))).drop("complete")


def gate_scope(findings: DataFrame, requested: DataFrame, files: DataFrame) -> DataFrame:
    """Adds scope: in-scope, outside-scope or unattributed. A repo without requested paths is all in scope.

    Outside needs proof: a named path is a file of the repo. Named paths and their ancestors are
    joined by equality on distinct (repo, path)."""
    strip = r":L?\d+(:\d+)?$"
    named = F.filter(F.array_distinct(F.array(F.regexp_replace(F.coalesce("file", F.lit("")), strip, ""), F.regexp_replace(F.coalesce("location", F.lit("")), strip, ""))), lambda p: p != "")
    f = findings.withColumn("_named", named)
    places = f.select("repo", F.explode("_named").alias("p")).distinct()
    covered = (places.select("repo", "p", F.explode(F.concat(F.array(F.lit(".")), paths.ancestors(F.col("p")))).alias("path"))
               .join(requested.select("repo", "path").distinct(), ["repo", "path"], "left_semi").select("repo", "p").distinct().withColumn("_cov", F.lit(True)))
    exists = places.join(files.select("repo", F.col("path").alias("p")).distinct(), ["repo", "p"], "left_semi").withColumn("_file", F.lit(True))
    state = places.join(covered, ["repo", "p"], "left").join(exists, ["repo", "p"], "left")
    per = (f.select("repo", "finding_id", F.explode("_named").alias("p")).join(state, ["repo", "p"], "left").groupBy("repo", "finding_id")
           .agg(F.bool_or(F.coalesce("_cov", F.lit(False))).alias("_cov"), F.bool_or(F.coalesce("_file", F.lit(False))).alias("_file")))
    asked = requested.select("repo").distinct().withColumn("_asked", F.lit(True))
    return (findings.join(per, ["repo", "finding_id"], "left").join(asked, "repo", "left")
            .withColumn("scope", F.when(F.col("_asked").isNull() | F.coalesce("_cov", F.lit(False)), F.lit("in-scope")).when(F.coalesce("_file", F.lit(False)), F.lit("outside-scope")).otherwise(F.lit("unattributed")))
            .select(*findings.columns, "scope"))


def gate_verdict(scoped: DataFrame, coverage: DataFrame, missed: DataFrame, threshold: str = "MEDIUM", min_confidence: str | None = None) -> DataFrame:
    """Per repo: passed, blocking, outside_scope, acknowledged, missed, execution_errors.

    ``scoped`` is gate_scope's output with status; ``coverage(repo, errors)``; ``missed(repo, path)``."""
    from ..functions.ranks import CONFIDENCE, SEVERITY, confidence_rank, severity_rank
    active = F.coalesce("status", F.lit("open")) != "acknowledged"
    conf = confidence_rank(F.col("confidence"))
    sure = F.lit(True) if min_confidence is None else conf.isNull() | (conf >= CONFIDENCE[min_confidence])
    blocks = active & (F.col("scope") != "outside-scope") & (severity_rank(F.col("severity")) >= SEVERITY[threshold]) & sure
    g = scoped.groupBy("repo").agg(F.count_if(blocks).alias("blocking"), F.count_if(active & (F.col("scope") == "outside-scope")).alias("outside_scope"), F.count_if(~active).alias("acknowledged"))
    m = missed.groupBy("repo").agg(F.count(F.lit(1)).alias("missed"))
    j = coverage.select("repo", F.size("errors").alias("execution_errors")).join(g, "repo", "left").join(m, "repo", "left").na.fill(0)
    return j.withColumn("passed", (F.col("blocking") == 0) & (F.col("execution_errors") == 0))


# Control rows and the run flag that evidences each.
CONTROLS = [("secure-development", "static_analysis"), ("dependency-review", "sca_scan"), ("secret-scanning", "secret_scan"), ("dynamic-testing", "dynamic_run"), ("change-attribution", "attribution"), ("exception-review", "acknowledgements")]


def evidence_inventory(runs: DataFrame) -> DataFrame:
    """(repo, control, state): present or gap per control; an inventory, never a verdict.

    ``runs`` has a nullable boolean column per flag."""
    rows = F.array(*[F.struct(F.lit(c).alias("control"), F.when(F.coalesce(flag, F.lit(False)), F.lit("present")).otherwise(F.lit("gap")).alias("state")) for c, flag in CONTROLS])
    return runs.select("repo", F.explode(rows).alias("r")).select("repo", "r.*")


# Directory names that usually hold no product code.
CANDIDATE_DIRS = ["tests", "test", "__tests__", "spec", "fixtures", "examples", "example", "samples", "docs", "benchmarks", "scripts", "testdata", "mocks", "e2e"]


def scope_proposal(files: DataFrame, findings: DataFrame) -> DataFrame:
    """(repo, path, files, findings, mode) of outermost candidate directories up to four levels deep.

    mode is acknowledge when all findings below are secrets, else glob."""
    def top(path):
        parts = F.split(path, "/")
        at = F.aggregate(F.sequence(F.lit(1), F.least(F.size(parts) - 1, F.lit(4))), F.lit(0),
                         lambda acc, i: F.when((acc == 0) & F.lower(F.element_at(parts, i)).isin(*CANDIDATE_DIRS), i).otherwise(acc))
        return F.when(F.size(parts) > 1, F.when(at > 0, F.concat(F.array_join(F.slice(parts, 1, F.greatest(at, F.lit(1))), "/"), F.lit("/"))))
    dirs = files.select("repo", top(F.col("path")).alias("path")).filter("path IS NOT NULL").groupBy("repo", "path").agg(F.count(F.lit(1)).alias("files"))
    below = (findings.select("repo", top(F.col("file")).alias("path"), F.col("category").endswith("secret").alias("s")).filter("path IS NOT NULL")
             .groupBy("repo", "path").agg(F.count(F.lit(1)).alias("findings"), F.bool_and("s").alias("_all")))
    return (dirs.join(below, ["repo", "path"], "left").select("repo", "path", "files", F.coalesce("findings", F.lit(0)).alias("findings"),
                                                            F.when(F.col("_all"), F.lit("acknowledge")).otherwise(F.lit("glob")).alias("mode")))


def union_all(parts) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
