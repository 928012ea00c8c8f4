"""Repair plans and their verification."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.standards import disposition


def repair_plans(findings: DataFrame, context: DataFrame) -> DataFrame:
    """One plan per finding bound to the build it was seen in. ``context(repo, application_id, build_id,
    source_digest, scope_digest)``; plan_id is the digest of the plan's own fields."""
    body = ["fingerprint", "application_id", "build_id", "source_digest", "scope_digest", "attack_class", "file", "disposition"]
    j = findings.join(context, "repo", "left").withColumn("disposition", disposition(F.col("attack_class")))
    return j.withColumn("plan_id", F.sha2(F.to_json(F.struct(*sorted(body))), 256)).select("repo", "plan_id", *body)


def verify_repair(plans: DataFrame, records: DataFrame, rerun: DataFrame, coverage: DataFrame, tests: DataFrame) -> DataFrame:
    """(repo, plan_id, accepted, errors) per submitted record.

    ``records(repo, plan_id, application_id, build_id, source_digest)`` the claimed fixed build;
    ``rerun(repo, source_digest, fingerprint, fingerprint_aliases)`` findings of the re-run;
    ``coverage(repo, source_digest, scope_digest, execution_complete)``;
    ``tests(repo, plan_id, test_id, kind, build, status, failed, test_count)`` with build fixed or original."""
    p = plans.select("repo", "plan_id", "fingerprint", F.col("application_id").alias("_app"), F.col("source_digest").alias("_src"), F.col("scope_digest").alias("_scope"))
    seen = (rerun.select("repo", "source_digest", F.explode(F.array_distinct(F.concat(F.array("fingerprint"), "fingerprint_aliases"))).alias("fingerprint")).distinct().withColumn("_seen", F.lit(True)))
    ok = (F.col("status") == "passed") & (F.col("failed") == 0) & (F.col("test_count") > 0)
    before = tests.filter("build = 'original' AND kind = 'negative' AND status = 'failed' AND failed >= 1").select("repo", "plan_id", "test_id").distinct().withColumn("_before", F.lit(True))
    t = tests.filter("build = 'fixed'").join(before, ["repo", "plan_id", "test_id"], "left")
    paired = t.groupBy("repo", "plan_id").agg(F.bool_or((F.col("kind") == "positive") & ok).alias("_p"), F.bool_or((F.col("kind") == "negative") & ok & F.coalesce("_before", F.lit(False))).alias("_n"), F.bool_and(ok).alias("_ok"))
    cov = coverage.select("repo", "source_digest", F.col("scope_digest").alias("_cscope"), F.col("execution_complete").alias("_done"))
    j = (records.join(p, ["repo", "plan_id"], "left").join(cov, ["repo", "source_digest"], "left").join(seen, ["repo", "source_digest", "fingerprint"], "left").join(paired, ["repo", "plan_id"], "left"))
    no = lambda c: ~F.coalesce(c, F.lit(False))
    tests_ = [("unknown-plan", F.col("fingerprint").isNull()), ("application-changed", no(F.col("application_id") == F.col("_app"))), ("source-unchanged", F.coalesce(F.col("source_digest") == F.col("_src"), F.lit(False))),
              ("coverage-incomplete", no(F.col("_done"))), ("scope-differs", no(F.col("_cscope") == F.col("_scope"))), ("still-observed", F.coalesce("_seen", F.lit(False))),
              ("positive-test-missing", no(F.col("_p"))), ("negative-test-missing", no(F.col("_n"))), ("failing-test", F.col("_ok").isNotNull() & ~F.col("_ok"))]
    errors = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in tests_]), lambda e: e.isNotNull())
    return j.select("repo", "plan_id", errors.alias("errors")).withColumn("accepted", F.size("errors") == 0)
