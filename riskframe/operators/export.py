"""Writing results: SARIF, JSON envelope, CSV, redacted records, fix queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ident
from ..functions.standards import is_pathlike, sarif_level, security_severity, standards_table
from .core import top_k
from .findings import rank_order

# Results per SARIF log. A repo with more gets several logs; each is a whole, valid document.
CHUNK = 5000
TOOL = "riskframe"


def _chunked(findings: DataFrame, size: int) -> DataFrame:
    """Adds chunk: results of a repo are spread by digest over as many logs as its size asks for."""
    n = findings.groupBy("repo").agg(F.ceil(F.count(F.lit(1)) / F.lit(size)).cast("int").alias("_k"))
    return findings.join(n, "repo").withColumn("chunk", F.pmod(F.xxhash64("repo", "fingerprint", "finding_id"), F.col("_k")).cast("int")).drop("_k")


def sarif_result(columns) -> Column:
    """One SARIF result as a struct: path or project anchor, fingerprints, suppression, baseline state."""
    def col(n):
        return F.col(n) if n in columns else F.lit(None).cast("string")
    path = F.when(is_pathlike(F.col("file")), F.translate("file", "\\", "/")).when(is_pathlike(ident.strip_line_suffix(F.col("location"))), ident.strip_line_suffix(F.col("location")))
    line = F.greatest(F.coalesce(F.col("line").cast("int"), F.lit(1)), F.lit(1))
    region = F.struct(F.when(path.isNotNull(), line).otherwise(F.lit(1)).alias("startLine"))
    where = F.struct(F.struct(F.coalesce(path, F.lit(".")).alias("uri")).alias("artifactLocation"), region.alias("region"))
    state = F.when(col("baseline_state").isin("reopened", "changed"), F.lit("updated")).otherwise(col("baseline_state"))
    return F.struct(
        F.concat(F.lit(TOOL + "/"), "attack_class").alias("ruleId"), sarif_level(F.col("severity")).alias("level"), F.struct(F.col("title").alias("text")).alias("message"),
        F.array(F.struct(where.alias("physicalLocation"))).alias("locations"), F.struct(F.col("fingerprint").alias("riskframeV2")).alias("partialFingerprints"), state.alias("baselineState"),
        F.when(col("status") == "acknowledged", F.array(F.struct(F.lit("external").alias("kind"), F.coalesce(col("ack_reason"), F.lit("acknowledged")).alias("justification")))).alias("suppressions"),
        F.struct(F.col("severity").alias("severity"), F.col("confidence").alias("confidence"), security_severity(F.col("severity")).alias("security-severity"), path.isNull().alias("projectLevel")).alias("properties"))


def sarif_logs(findings: DataFrame, size: int = CHUNK) -> DataFrame:
    """(repo, chunk, results, json): whole SARIF logs. A log is bounded by ``size`` results (in expectation),
    so no task ever holds a whole large repo."""
    f = _chunked(findings, size).withColumn("_res", sarif_result(findings.columns))
    rules = f.select("repo", "chunk", "attack_class").distinct().join(F.broadcast(standards_table(f.sparkSession)), "attack_class", "left")
    rules = (rules.groupBy("repo", "chunk").agg(F.array_sort(F.collect_list(F.struct(F.concat(F.lit(TOOL + "/"), "attack_class").alias("id"),
                                                                                  F.struct(F.coalesce(F.get("cwe", F.lit(0)), "attack_class").alias("text")).alias("shortDescription")))).alias("rules")))
    logs = f.groupBy("repo", "chunk").agg(F.array_sort(F.collect_list(F.struct("fingerprint", "finding_id", F.to_json("_res").alias("r")))).alias("rs"))
    j = logs.join(rules, ["repo", "chunk"])
    body = F.array_join(F.transform("rs", lambda x: x["r"]), ",")
    driver = F.to_json(F.struct(F.lit(TOOL).alias("name"), F.col("rules")))
    text = F.concat(F.lit('{"version":"2.1.0","$schema":"https://json.schemastore.org/sarif-2.1.0.json","runs":[{"tool":{"driver":'), driver, F.lit('},"results":['), body, F.lit("]}]}"))
    return j.select("repo", "chunk", F.size("rs").alias("results"), text.alias("json"))


def write_sarif(findings: DataFrame, path: str, size: int = CHUNK) -> None:
    """One line per log under repo=<repo>."""
    sarif_logs(findings, size).select("repo", F.col("json").alias("value")).write.mode("overwrite").partitionBy("repo").text(path)


def envelopes(findings: DataFrame, size: int = CHUNK) -> DataFrame:
    """(repo, chunk, json): versioned envelope with the summary of the whole repo and one chunk of findings."""
    summary = findings.groupBy("repo").agg(F.count(F.lit(1)).alias("total"), F.count_if(F.col("severity") == "CRITICAL").alias("critical"), F.count_if(F.col("severity") == "HIGH").alias("high"),
                                           F.count_if(F.col("severity") == "MEDIUM").alias("medium"), F.count_if(F.col("severity") == "LOW").alias("low"), F.count_if(F.col("severity") == "INFO").alias("info"))
    keep = [c for c in ("finding_id", "fingerprint", "title", "attack_class", "severity", "confidence", "location", "status", "baseline_state") if c in findings.columns]
    parts = _chunked(findings, size).groupBy("repo", "chunk").agg(F.array_sort(F.collect_list(F.struct(*keep))).alias("findings"))
    return parts.join(summary, "repo").select("repo", "chunk", F.to_json(F.struct(
        F.lit("1.0").alias("schema_version"), F.lit(TOOL).alias("tool"), F.col("repo").alias("target"), F.col("chunk"), F.struct("total", "critical", "high", "medium", "low", "info").alias("summary"), "findings")).alias("json"))


def write_envelope(findings: DataFrame, path: str) -> None:
    envelopes(findings).select("repo", F.col("json").alias("value")).write.mode("overwrite").partitionBy("repo").text(path)


def safe_cell(col: Column) -> Column:
    """A cell that a spreadsheet would run as a formula is prefixed with an apostrophe."""
    return F.when(col.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), col)).otherwise(col)


def grades_csv(graded: DataFrame) -> DataFrame:
    return graded.select(*[safe_cell(F.col(n)).alias(n) if t == "string" else F.col(n) for n, t in graded.dtypes])


def write_grades_csv(graded: DataFrame, path: str) -> None:
    grades_csv(graded).write.mode("overwrite").option("header", True).csv(path)


def redact(findings: DataFrame, include_snippet: bool = False) -> DataFrame:
    """Allow-listed columns; the extension stands for the path."""
    keep = [c for c in ("fingerprint", "attack_class", "category", "severity", "confidence", "rule_id") if c in findings.columns]
    out = [F.col(c) for c in keep] + [extension_hint(F.col("file")).alias("extension")]
    if include_snippet and "snippet" in findings.columns:
        out.append(F.col("snippet"))
    return findings.select(*out)


def extension_hint(path: Column) -> Column:
    """Lower-case extension, the name of a known extensionless file, or (none)."""
    base = F.regexp_extract(F.translate(F.coalesce(path, F.lit("")), "\\", "/"), r"([^/]*)$", 1)
    ext = F.lower(F.regexp_extract(base, r"(\.[A-Za-z0-9]{1,10})(?::\d+)?$", 1))
    return F.when(ext != "", ext).when(base.rlike(r"^(?:Dockerfile|Makefile|Jenkinsfile|Procfile|Gemfile)$"), base).otherwise(F.lit("(none)"))


def fix_queue(findings: DataFrame, limit: int = 12) -> DataFrame:
    """(repo, position, finding_id, prompt): the first findings to fix with a self-contained instruction."""
    top = top_k(findings, ["repo"], rank_order(["finding_id"]), limit)
    text = F.format_string("Fix %s (%s) at %s: %s. Verify the change before closing.", "attack_class", "severity", "location", "title")
    return top.select("repo", "position", "finding_id", text.alias("prompt"))


def attribution_assurance(ci: Column, vcs: Column, declared: Column) -> Column:
    """How much the identity of a change is worth: CI identity, version control, a declared name, or nothing."""
    f = F.lit(False)
    return (F.when(F.coalesce(ci, f), F.lit("ci-verified")).when(F.coalesce(vcs, f), F.lit("vcs-recorded")).when(F.coalesce(declared, f), F.lit("self-declared")).otherwise(F.lit("unattributed")))
