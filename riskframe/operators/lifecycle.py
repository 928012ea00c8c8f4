"""Findings against a baseline, clusters, changed lines."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ident, ranks
from .core import cut_lineage, unique_match

IDENTITY_VERSION = 2
# Fields two identities may differ in only when one side does not know them.
IDENTITY_KEYS = ["rule_id", "cve", "resource", "semantic_id", "service_id", "method"]
COARSE = ["repo", "attack_class", "category", "place"]


def annotate(findings: DataFrame) -> DataFrame:
    """Adds fingerprint and the legacy fingerprint as an alias."""
    return (findings.withColumn("fingerprint", ident.fingerprint(findings.columns))
            .withColumn("fingerprint_aliases", F.array(
                ident.legacy_fingerprint(F.col("attack_class"), F.col("location"), F.col("title")))))


def _compatible(a: str, b: str, names):
    tests = [F.col(f"{a}.{n}").isNull() | F.col(f"{b}.{n}").isNull() | (F.col(f"{a}.{n}") == F.col(f"{b}.{n}"))
             for n in names]
    return reduce(lambda x, y: x & y, tests, F.lit(True))


def baseline_match(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """(repo, finding_id, baseline_id, matched_by) of findings seen before.

    Stages, each on what the earlier left over: equal fingerprint; an alias shared with a row of the
    old identity version; equal coarse place with compatible identity. The last two need one
    candidate on both sides. Both inputs carry fingerprint, fingerprint_aliases, place and the
    identity fields; the baseline also baseline_id and identity_version."""
    names = [n for n in IDENTITY_KEYS if n in findings.columns and n in baseline.columns]
    sole = (baseline.groupBy("repo", "fingerprint")
            .agg(F.count(F.lit(1)).alias("_n"), F.min("baseline_id").alias("baseline_id")).filter("_n = 1").drop("_n"))
    need = ["repo", "fingerprint", "fingerprint_aliases", "attack_class", "category", "place", *names]
    staged = cut_lineage(findings.select("finding_id", *need).join(sole, ["repo", "fingerprint"], "left"))
    exact = (staged.filter("baseline_id IS NOT NULL")
             .select("repo", "finding_id", "baseline_id", F.lit("fingerprint").alias("matched_by")))
    rest = staged.filter("baseline_id IS NULL").drop("baseline_id")
    old = cut_lineage(baseline.filter(F.col("identity_version") < IDENTITY_VERSION).select("baseline_id", *need)
                      .join(exact.select("repo", "baseline_id"), ["repo", "baseline_id"], "left_anti"))

    def keyed(df, key):
        return df.select("repo", key, *names, F.explode(F.array_distinct(
            F.concat(F.array("fingerprint"), "fingerprint_aliases"))).alias("alias"))

    def only(df, key):
        return (keyed(df, key).groupBy("repo", "alias")
                .agg(F.count(F.lit(1)).alias("_n"), F.min_by(F.struct(key, *names), F.col(key)).alias("_r"))
                .filter("_n = 1").select("repo", "alias", "_r.*"))
    by_alias = cut_lineage(only(rest, "finding_id").alias("f")
                .join(only(old, "baseline_id").alias("b"),
                      (F.col("f.repo") == F.col("b.repo")) & (F.col("f.alias") == F.col("b.alias")))
                .filter(_compatible("f", "b", names))
                .groupBy(F.col("f.repo").alias("repo"), "finding_id")
                .agg(F.min("baseline_id").alias("baseline_id"), F.max("baseline_id").alias("_hi"))
                .filter("baseline_id = _hi")
                .groupBy("repo", "baseline_id").agg(F.min("finding_id").alias("finding_id"), F.count(F.lit(1)).alias("_n"))
                .filter("_n = 1").select("repo", "finding_id", "baseline_id", F.lit("alias").alias("matched_by")))

    rest2 = rest.join(by_alias.select("repo", "finding_id"), ["repo", "finding_id"], "left_anti")
    old2 = old.join(by_alias.select("repo", "baseline_id"), ["repo", "baseline_id"], "left_anti")
    coarse = unique_match(cut_lineage(rest2.select("finding_id", *COARSE, *names)), cut_lineage(old2.select("baseline_id", *COARSE, *names)),
                          COARSE, "finding_id", "baseline_id", compatible=names)
    by_place = (coarse.filter("match_id IS NOT NULL")
                .select("repo", "finding_id", F.col("match_id").alias("baseline_id"), F.lit("coarse").alias("matched_by")))
    return exact.unionByName(by_alias).unionByName(by_place)


def baseline_diff(findings: DataFrame, baseline: DataFrame, match: DataFrame) -> DataFrame:
    """Findings with matched_by and baseline_state: new, unchanged, reopened or changed."""
    prev = baseline.select("repo", "baseline_id", F.col("severity").alias("_sev"), F.col("status").alias("_st"),
                           F.col("kev").alias("_kev"))
    m = match.join(prev, ["repo", "baseline_id"], "left")
    worse = ranks.severity_rank(F.col("severity")) > ranks.severity_rank(F.col("_sev"))
    listed = F.coalesce("kev", F.lit(False)) & ~F.coalesce("_kev", F.lit(False))
    state = (F.when(F.col("baseline_id").isNull(), F.lit("new"))
             .when((F.col("_st") == "acknowledged") & (F.col("status") != "acknowledged"), F.lit("reopened"))
             .when(worse | listed, F.lit("changed")).otherwise(F.lit("unchanged")))
    return (findings.join(m, ["repo", "finding_id"], "left").withColumn("baseline_state", state)
            .select(*findings.columns, "baseline_id", "matched_by", "baseline_state"))


def change_events(findings: DataFrame, baseline: DataFrame, match: DataFrame,
                  fields=("severity", "kev", "epss")) -> DataFrame:
    """(repo, finding_id, event, previous, current) per field that differs from the matched row."""
    kinds = {"severity": "severity-changed", "kev": "kev-changed", "epss": "intelligence-changed"}
    have = [f for f in fields if f in findings.columns and f in baseline.columns]
    j = (match.join(findings.select("repo", "finding_id", *have), ["repo", "finding_id"])
         .join(baseline.select("repo", "baseline_id", *[F.col(f).alias("_" + f) for f in have]), ["repo", "baseline_id"]))
    changes = F.filter(F.array(*[
        F.when(~F.col(f).eqNullSafe(F.col("_" + f)),
               F.struct(F.lit(kinds[f]).alias("event"), F.col("_" + f).cast("string").alias("previous"),
                        F.col(f).cast("string").alias("current"))) for f in have]), lambda e: e.isNotNull())
    return j.select("repo", "finding_id", F.explode(changes).alias("_e")).select("repo", "finding_id", "_e.*")


def missing_observations(baseline: DataFrame, match: DataFrame) -> DataFrame:
    """Baseline rows nobody saw this time. Their state says only that; absence never means fixed."""
    return (baseline.join(match.select("repo", "baseline_id"), ["repo", "baseline_id"], "left_anti")
            .withColumn("state", F.lit("no-longer-observed")))


def gate_filter(findings: DataFrame, threshold: str = "MEDIUM", min_confidence: str | None = None,
                new_only: bool = False) -> DataFrame:
    """Findings that block: severity at the floor or above; unknown confidence is never below a floor."""
    out = findings.filter(ranks.severity_rank(F.coalesce("severity", F.lit("LOW"))) >= ranks.SEVERITY[threshold])
    if min_confidence is not None:
        rank = ranks.confidence_rank(F.col("confidence"))
        out = out.filter(rank.isNull() | (rank >= ranks.CONFIDENCE[min_confidence]))
    return out.filter(F.col("baseline_state").isin("new", "reopened", "changed")) if new_only else out


# A group needs this many sites to be a cluster.
MIN_SITES = 2


def with_cluster_key(findings: DataFrame) -> DataFrame:
    """An incident (all removed by one commit) wins over the rule as the grouping."""
    incident = F.coalesce("history_only", F.lit(False)) & (F.coalesce("commit", F.lit("")) != "")
    rule = F.coalesce(F.nullif("rule_id", F.lit("")), F.nullif("attack_class", F.lit("")),
                      F.nullif("category", F.lit("")), F.lit("finding"))
    return (findings.withColumn("kind", F.when(incident, F.lit("incident")).otherwise(F.lit("rule")))
            .withColumn("disc", F.when(incident, F.concat(F.lit("deleted-in:"), F.substring("commit", 1, 12)))
                        .otherwise(F.concat(F.coalesce("category", F.lit("")), F.lit(":"), rule)))
            .withColumn("cluster_id", ident.cluster_id(F.col("kind"), F.col("disc"))))


def clusters(findings: DataFrame) -> DataFrame:
    """One row per group of two or more sites: worst severity, best confidence, size.

    Sites are not nested: a rule may hold a third of all findings. See ``cluster_sites``."""
    sev, conf = ranks.severity_rank(F.col("severity")), ranks.confidence_rank(F.col("confidence"))
    return (with_cluster_key(findings).groupBy("repo", "cluster_id", "kind", "disc")
            .agg(F.count(F.lit(1)).alias("site_count"), F.max_by("severity", sev).alias("severity"),
                 F.max_by("confidence", conf).alias("confidence"),
                 F.min_by("finding_id", F.struct((-sev).alias("s"), F.col("file"), F.col("line"), F.col("finding_id"))).alias("representative"))
            .filter(F.col("site_count") >= MIN_SITES))


def cluster_sites(findings: DataFrame) -> DataFrame:
    """(repo, cluster_id, finding_id, file, line, severity, confidence), one row per site."""
    keep = clusters(findings).select("repo", "cluster_id")
    return (with_cluster_key(findings).join(keep, ["repo", "cluster_id"], "left_semi")
            .select("repo", "cluster_id", "finding_id", "file", "line", "severity", "confidence"))


def cluster_summary(findings: DataFrame) -> DataFrame:
    """Per repo: clusters, clustered findings, distinct issues, largest cluster."""
    sized = (with_cluster_key(findings).groupBy("repo", "cluster_id").agg(F.count(F.lit(1)).alias("_n")))
    big = F.col("_n") >= MIN_SITES
    return sized.groupBy("repo").agg(
        F.count_if(big).alias("clusters"), F.coalesce(F.sum(F.when(big, F.col("_n"))), F.lit(0)).alias("clustered_findings"),
        F.count(F.lit(1)).alias("distinct_issues"), F.sum("_n").alias("total_findings"),
        F.coalesce(F.max(F.when(big, F.col("_n"))), F.lit(0)).alias("largest"))


def in_hunk(findings: DataFrame, hunks: DataFrame, bucket: int = 64) -> DataFrame:
    """Adds diff_state: untouched, in-changed-file or in-changed-hunk.

    ``location`` and ``file`` are both tried as the changed path. Hunks are clipped to buckets of
    ``bucket`` lines and matched against distinct lines, so a file with many findings and many hunks
    meets in small groups instead of every pair."""
    def path_of(c):
        return F.regexp_replace(F.split_part(F.translate(F.coalesce(c, F.lit("")), "\\", "/"), F.lit(":"), F.lit(1)), r"^[./]+", "")
    h = hunks.select("repo", path_of(F.col("path")).alias("_path"), "start_line", "end_line")
    changed = h.select("repo", "_path", F.lit(True).alias("_in")).distinct()
    lo, hi = F.floor(F.col("start_line") / bucket), F.floor(F.col("end_line") / bucket)
    pieces = (h.filter("end_line >= start_line").withColumn("_b", F.explode(F.sequence(lo, hi)))
              .select("repo", "_path", "_b", F.greatest("start_line", F.col("_b") * bucket).alias("_s"),
                      F.least("end_line", F.col("_b") * bucket + bucket - 1).alias("_e")).distinct())
    cand = F.array_distinct(F.array(
        F.struct(path_of(F.col("location")).alias("p"),
                 F.regexp_extract("location", r":(\d+)$", 1).try_cast("int").alias("l")),
        F.struct(path_of(F.col("file")).alias("p"), F.regexp_extract("file", r":(\d+)$", 1).try_cast("int").alias("l"))))
    probes = (findings.select("repo", "finding_id", F.explode(cand).alias("_c"))
              .select("repo", "finding_id", F.col("_c.p").alias("_path"), F.col("_c.l").alias("_line")).filter("_path <> ''"))
    lines = probes.filter("_line IS NOT NULL").select("repo", "_path", "_line", F.floor(F.col("_line") / bucket).alias("_b")).distinct()
    on = ["repo", "_path", "_b"]
    hit_lines = (lines.alias("l").join(pieces.alias("p"), [F.col("l." + c) == F.col("p." + c) for c in on]
                                       + [F.col("l._line").between(F.col("p._s"), F.col("p._e"))], "left_semi")
                 .select("repo", "_path", "_line", F.lit(True).alias("_hit")))
    state = (probes.join(changed, ["repo", "_path"], "left").join(hit_lines, ["repo", "_path", "_line"], "left")
             .groupBy("repo", "finding_id")
             .agg(F.bool_or(F.coalesce("_in", F.lit(False))).alias("_in"), F.bool_or(F.coalesce("_hit", F.lit(False))).alias("_hit")))
    return (findings.join(state, ["repo", "finding_id"], "left")
            .withColumn("diff_state", F.when(F.col("_hit"), F.lit("in-changed-hunk"))
                        .when(F.col("_in"), F.lit("in-changed-file")).otherwise(F.lit("untouched")))
            .select(*findings.columns, "diff_state"))


def two_role_diff(a: DataFrame, b: DataFrame, keys) -> DataFrame:
    """Keys seen only as role A, only as role B, or by both."""
    keys = list(keys)
    l = a.select(*keys).distinct().withColumn("_a", F.lit(True))
    r = b.select(*keys).distinct().withColumn("_b", F.lit(True))
    return (l.join(r, keys, "full_outer")
            .select(*keys, F.when(F.col("_a") & F.col("_b"), F.lit("both"))
                    .when(F.col("_a"), F.lit("only-a")).otherwise(F.lit("only-b")).alias("seen_by")))
