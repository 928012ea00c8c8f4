"""Recorded runtime observations and scanner evidence; nothing is sent anywhere."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ident import sample_id
from .core import unique_match

# Path segments of actions with side effects.
SIDE_EFFECTING = (r"(?i)/cron(?![\w-])|/seed(?![\w-])|(?:re)?generate(?![\w-])|/trigger(?![\w-])|/sync(?![\w-])|/send(?![\w-])|/send-[\w-]+|/run(?![\w-])|social-image|sponsor-post|upload(?![\w-])|"
                  r"/refresh(?![\w-])|/rebuild(?![\w-])|/process(?![\w-])|/dispatch(?![\w-])|/import(?![\w-])|/export(?![\w-])|/scrape(?![\w-])")
CONTEXT = ["application_id", "build_id", "identity", "endpoint", "method", "parameter"]


def side_effect_free(routes: DataFrame) -> DataFrame:
    """Adds probe: read (GET, no parameter, no side effect), skipped-side-effect or not-eligible."""
    get = F.col("method") == "GET"
    return routes.withColumn("probe", F.when(get & F.col("path").rlike(SIDE_EFFECTING), F.lit("skipped-side-effect"))
                             .when(get & ~F.contains("path", F.lit("{")), F.lit("read")).otherwise(F.lit("not-eligible")))


def reachability_verdict(status: Column, n_bytes: Column, soft_deny: Column) -> Column:
    ok = status.isin(200, 206)
    return (F.when(status.isin(401, 403), F.lit("protected")).when(status.isin(301, 302, 303, 307, 308), F.lit("redirect"))
            .when(ok & n_bytes.isNull(), F.lit("open-unreadable")).when(ok & F.coalesce(soft_deny, F.lit(False)), F.lit("soft-deny"))
            .when(ok & (n_bytes > 2), F.lit("open")).when(ok, F.lit("open-empty")).when(status == 404, F.lit("404"))
            .otherwise(F.concat(F.lit("http-"), F.coalesce(status.cast("string"), F.lit("none")))))


def reachability_verdicts(observations: DataFrame):
    """(rows with verdict and state, summary per target)."""
    v = reachability_verdict(F.col("status"), F.col("bytes"), F.col("soft_deny"))
    rows = observations.withColumn("verdict", v).withColumn(
        "state", F.when(F.col("status").isin(401, 403) | (F.col("status").isin(200, 206) & F.col("bytes").isNotNull()), F.lit("observed")).otherwise(F.lit("inconclusive")))
    is_open = F.col("verdict") == "open"
    s = rows.groupBy("repo", "target").agg(F.count(F.lit(1)).alias("tested"), F.count_if(is_open).alias("open"), F.count_if(F.col("verdict").isin("protected", "redirect")).alias("_prot"),
                                           F.bool_and(F.col("status").isNull()).alias("unreachable"), F.bool_and(F.col("state") == "observed").alias("_obs"))
    s = s.withColumn("fail_open_suspected", (F.col("tested") >= 3) & (F.col("_prot") == 0) & (F.col("open") > 0))
    return rows, s.withColumn("trustworthy", ~F.col("fail_open_suspected") & ~F.col("unreachable") & F.col("_obs")).drop("_prot", "_obs")


def write_verdicts(observations: DataFrame):
    """(rows, summary): a status alone never confirms a bypass."""
    st = F.col("status")
    v = (F.when(st.isin(401, 403), F.lit("auth-enforced")).when(st.isin(200, 201, 202, 204), F.lit("candidate")).when(st.isin(400, 409, 415, 422), F.lit("validation-inconclusive"))
         .otherwise(F.concat(F.lit("http-"), F.coalesce(st.cast("string"), F.lit("none")))))
    rows = observations.withColumn("verdict", v).withColumn("state", F.when(st.isin(401, 403), F.lit("blocked")).otherwise(F.lit("inconclusive")))
    s = rows.groupBy("repo", "target").agg(F.count(F.lit(1)).alias("tested"), F.count_if(F.col("verdict") == "auth-enforced").alias("enforced"), F.count_if(F.col("verdict") == "candidate").alias("candidates"),
                                           F.bool_and(st.isNull()).alias("unreachable"))
    return rows, s.withColumn("fail_open_suspected", (F.col("tested") >= 3) & (F.col("enforced") == 0) & (F.col("candidates") > 0))


def cross_tenant_verdicts(observations: DataFrame, controls: DataFrame) -> DataFrame:
    """(repo, path, direction, verdict, state, sample_id) from recorded probes.

    ``observations(repo, path, direction, role, status, marker_match)`` with roles owner, anonymous,
    attacker, repeat; ``controls(repo, application_id, build_id, identity_ok)``. Confirmed only when
    identity, owner read, anonymous denial and a repeated marker read all hold. The roles of a check
    are folded by one conditional aggregate instead of a self-join."""
    def of(role, col):
        return F.max(F.when(F.col("role") == role, F.col(col)))
    g = observations.groupBy("repo", "path", "direction").agg(
        of("owner", "status").alias("_os"), F.bool_or((F.col("role") == "owner") & F.col("marker_match")).alias("_om"), of("anonymous", "status").alias("_as"),
        of("attacker", "status").alias("status"), F.bool_or((F.col("role") == "attacker") & F.col("marker_match")).alias("_am"), of("repeat", "status").alias("_rs"), F.bool_or((F.col("role") == "repeat") & F.col("marker_match")).alias("_rm"))
    j = g.join(controls, "repo", "left")
    controlled = F.coalesce("identity_ok", F.lit(False)) & (F.coalesce("_os", F.lit(0)) == 200) & F.coalesce("_om", F.lit(False)) & F.coalesce("_as", F.lit(0)).isin(401, 403, 404)
    st = F.col("status")
    hit = st.isin(200, 206) & controlled & F.coalesce("_am", F.lit(False))
    again = F.coalesce(F.col("_rs").isin(200, 206), F.lit(False)) & F.coalesce("_rm", F.lit(False))
    verdict = (F.when(st.isin(401, 403, 404), F.lit("blocked")).when(hit & again, F.lit("leak")).when(hit, F.lit("repeat-inconclusive")).when(st.isin(200, 206), F.lit("candidate")).otherwise(F.lit("investigate")))
    state = F.when(verdict == "leak", F.lit("confirmed-vulnerable")).when((verdict == "blocked") & controlled, F.lit("blocked")).otherwise(F.lit("inconclusive"))
    sid = F.when((verdict == "leak") & F.col("application_id").isNotNull() & F.col("build_id").isNotNull(), sample_id(F.col("application_id"), F.col("build_id"), F.col("path"), F.col("direction")))
    return j.select("repo", "path", "direction", verdict.alias("verdict"), state.alias("state"), sid.alias("sample_id"))


def correlate_dynamic(guards: DataFrame, observations: DataFrame) -> DataFrame:
    """Unguarded endpoints with the one observation of their own method and path, else unjudged.

    ``guards(repo, guard_id, service_id, method, path, code_path, guarded, analyzed, public_hint)``,
    ``observations(repo, obs_id, service_id, method, path, code_path, verdict)``. Writes meet write
    rows and GET meets GET rows because the method is part of the key."""
    bare = guards.filter("analyzed AND NOT guarded AND NOT public_hint")
    m = unique_match(bare, observations, ["repo", "method", "path"], "guard_id", "obs_id", compatible=["service_id", "code_path"], payload=["verdict"])
    write = F.col("method").isin("POST", "PUT", "PATCH", "DELETE")
    return m.select("repo", "guard_id", "method", "path", F.when(write, F.lit("HIGH")).otherwise(F.lit("MEDIUM")).alias("severity"), "verdict",
                    F.when(F.col("match_id").isNotNull(), F.lit("observed")).when(F.col("candidate_count") > 0, F.lit("unjudged")).otherwise(F.lit("none")).alias("association"))


def dast_labels(findings: DataFrame, alerts: DataFrame, checks: DataFrame, class_map: DataFrame) -> DataFrame:
    """Adds verdict: confirmed, refuted, conflict or unjudged, by exact six-field context.

    A named identity must have been verified on the evidence. ``class_map(plugin_id, attack_class)``:
    a plugin that maps to several classes counts only if the alert names the class itself. Silence is
    not evidence."""
    def complete(df):
        have = reduce(lambda a, c: a & F.col(c).isNotNull() & ((F.col(c) != "") if c != "parameter" else F.lit(True)), CONTEXT, F.lit(True))
        ok = F.when(F.col("identity") == "anonymous", F.coalesce("auth_verified", F.lit(True))).otherwise(F.coalesce("auth_verified", F.lit(False)))
        return df.filter(have & ok)
    fan = class_map.groupBy("plugin_id").agg(F.count_distinct("attack_class").alias("_fan"))
    named = alerts.withColumnRenamed("attack_class", "_named").join(class_map, "plugin_id").join(fan, "plugin_id")
    pos = complete(named.filter((F.col("_named").isNull() & (F.col("_fan") == 1)) | (F.col("_named") == F.col("attack_class")))).select("attack_class", *CONTEXT).distinct().withColumn("_pos", F.lit(True))
    neg = (complete(checks.filter("completed AND coverage_complete AND auth_verified AND outcome = 'not-vulnerable'").join(class_map, ["plugin_id", "attack_class"], "left_semi"))
           .select("attack_class", *CONTEXT).distinct().withColumn("_neg", F.lit(True)))
    j = findings.join(pos, ["attack_class", *CONTEXT], "left").join(neg, ["attack_class", *CONTEXT], "left")
    p, n = F.coalesce("_pos", F.lit(False)), F.coalesce("_neg", F.lit(False))
    return j.withColumn("verdict", F.when(p & n, F.lit("conflict")).when(p, F.lit("confirmed")).when(n, F.lit("refuted")).otherwise(F.lit("unjudged"))).select(*findings.columns, "verdict")


def dast_predict(findings: DataFrame, alert_map: DataFrame, blind: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(predicted alerts, blind spots) per repo with the number of findings and a few files behind each.

    ``alert_map(attack_class, alert_id)`` and ``blind(attack_class, reason)`` are code-sized tables."""
    per = findings.groupBy("repo", "attack_class").agg(F.count(F.lit(1)).alias("findings"), F.min("file").alias("first_file"))
    pred = per.join(alert_map, "attack_class").groupBy("repo", "alert_id").agg(F.sum("findings").alias("findings"), F.array_sort(F.collect_set("attack_class")).alias("classes"), F.min("first_file").alias("first_file"))
    return pred, per.join(blind, "attack_class").select("repo", "attack_class", "reason", "findings")
