"""Scanner reports to scan_findings rows.

``reports(repo, snapshot, tool, raw)`` holds one document per row. Each normaliser parses only the
fields it needs (``from_json`` with a schema) and explodes arrays; malformed documents are rows of
``report_validity``, never an empty clean result."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import ident, ranks, tiers
from .core import cut_lineage

# Order and types of the columns every normaliser returns.
COLUMNS = {
    "repo": "string", "snapshot": "string", "tool": "string", "category": "string", "severity": "string",
    "key": "string", "file": "string", "line": "int", "title": "string", "fingerprint": "string",
    "rule_id": "string", "semantic_id": "string", "pkg": "string", "cve": "string", "installed": "string",
    "fixed": "string", "ecosystem": "string", "advisory_aliases": "array<string>", "commit": "string",
    "native_confidence": "string", "verified": "boolean", "resource": "string",
}


def _doc(reports: DataFrame, tool, schema: str) -> DataFrame:
    names = [tool] if isinstance(tool, str) else list(tool)
    return (reports.filter(F.col("tool").isin(*names))
            .select("repo", "snapshot", "tool", F.from_json("raw", schema).alias("d")))


def _each(df: DataFrame, array: Column, *keep: str) -> DataFrame:
    return df.select("repo", "snapshot", "tool", *keep, F.posexplode(array).alias("pos", "x"))


def _rows(df: DataFrame, **cols: Column) -> DataFrame:
    """Project to COLUMNS; fields a tool does not report are NULL."""
    out = []
    for name, kind in COLUMNS.items():
        if name in cols:
            out.append(cols[name].cast(kind).alias(name))
        elif name in ("repo", "snapshot", "tool"):
            out.append(F.col(name))
        else:
            out.append(F.lit(None).cast(kind).alias(name))
    return df.select(*out)


def _or(col: Column, other="") -> Column:
    return F.coalesce(col, F.lit(other))


def _fp(*parts: Column) -> Column:
    return F.concat_ws("|", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])


def norm_trivy(reports: DataFrame) -> DataFrame:
    d = _doc(reports, "trivy", """Results array<struct<Target string, Type string,
        Vulnerabilities array<struct<VulnerabilityID string, PkgName string, InstalledVersion string, FixedVersion string, Severity string>>,
        Secrets array<struct<RuleID string, Title string, Severity string, StartLine int, `Match` string, Secret string, Code string>>,
        Misconfigurations array<struct<ID string, Title string, Severity string>>>>""")
    r = d.select("repo", "snapshot", "tool", F.explode("d.Results").alias("r"))
    x, target = F.col("x"), _or(F.col("r.Target"))
    v = _each(r, F.col("r.Vulnerabilities"), "r")
    vulns = _rows(v, category=F.lit("sca"), severity=ranks.clean_severity(x["Severity"]), key=x["VulnerabilityID"], file=target,
                  line=F.lit(0), pkg=x["PkgName"], cve=x["VulnerabilityID"], installed=x["InstalledVersion"], fixed=x["FixedVersion"],
                  ecosystem=F.lower(_or(F.col("r.Type"))),
                  title=F.concat_ws(" ", x["PkgName"], x["InstalledVersion"], F.lit("to"), _or(x["FixedVersion"], "(no fix)")),
                  fingerprint=_fp(F.lit("cve"), x["PkgName"], x["VulnerabilityID"]))
    s = _each(r, F.col("r.Secrets"), "r").withColumn("t", tiers.secret_severity(
        target, F.coalesce(x["Match"], x["Secret"]), x["Code"], x["RuleID"], ranks.clean_severity(_or(x["Severity"], "HIGH"))))
    secrets = _rows(s, category=F.lit("secret"), severity=F.col("t.severity"), key=x["RuleID"], file=target, line=_or(x["StartLine"], 0),
                    title=F.concat_ws(" ", F.lit("secret:"), F.coalesce(x["Title"], x["RuleID"]), F.col("t.note")),
                    fingerprint=_fp(F.lit("secret"), target, x["RuleID"], _or(x["StartLine"], 0)))
    m = _each(r, F.col("r.Misconfigurations"), "r")
    iac = _rows(m, category=F.lit("iac"), severity=ranks.clean_severity(x["Severity"]), key=x["ID"], file=target, line=F.lit(0),
                title=F.substring(_or(x["Title"]), 1, 90), fingerprint=_fp(F.lit("iac"), target, x["ID"]))
    return vulns.unionByName(secrets).unionByName(iac)


# Ecosystem names of advisories and the token they are known by here.
OSV_ECOSYSTEMS = {"pypi": "pip", "npm": "npm", "go": "gomod", "crates.io": "cargo", "rubygems": "gem",
                  "packagist": "composer", "maven": "maven", "nuget": "nuget"}


def norm_osv(reports: DataFrame) -> DataFrame:
    """One row per alias group; a CVE id is preferred over other ids."""
    d = _doc(reports, "osv-scanner", """results array<struct<source struct<path string>, packages array<struct<
        package struct<name string, version string, ecosystem string>, groups array<struct<ids array<string>, aliases array<string>, max_severity string>>>>>>""")
    r = d.select("repo", "snapshot", "tool", F.explode("d.results").alias("r"))
    p = r.select("repo", "snapshot", "tool", F.col("r.source.path").alias("path"), F.explode("r.packages").alias("p"))
    g = _each(p, F.col("p.groups"), "path", "p")
    x = F.col("x")
    aliases = F.when(F.size(F.coalesce(x["aliases"], F.array())) > 0, x["aliases"]).otherwise(x["ids"])
    cve = F.coalesce(F.get(F.filter(aliases, lambda a: F.upper(a).startswith("CVE-")), F.lit(0)), F.get(x["ids"], F.lit(0)), F.lit(""))
    name, version = _or(F.col("p.package.name")), _or(F.col("p.package.version"))
    eco = ranks.lookup(F.lower(F.col("p.package.ecosystem")), OSV_ECOSYSTEMS, "")
    return _rows(g, category=F.lit("sca"), severity=tiers.cvss_band(x["max_severity"]), key=cve, file=_or(F.col("path")), line=F.lit(0),
                 pkg=name, cve=cve, installed=version, ecosystem=eco, advisory_aliases=F.array_sort(F.array_distinct(F.filter(aliases, lambda a: a != ""))),
                 title=F.concat_ws(" ", name, version, cve), fingerprint=_fp(F.lit("cve"), name, cve))


def norm_gitleaks(reports: DataFrame) -> DataFrame:
    rows = "array<struct<File string, RuleID string, Secret string, `Match` string, Description string, StartLine int, Commit string>>"
    d = (reports.filter(F.col("tool").isin("gitleaks", "gitleaks-dir"))
         .select("repo", "snapshot", "tool", F.when(F.ltrim("raw").startswith("["), F.from_json("raw", rows))
                 .otherwise(F.from_json("raw", f"findings {rows}")["findings"]).alias("d")))
    g = _each(d, F.coalesce("d", F.array().cast(rows)))
    x = F.col("x")
    file, rule, line = _or(x["File"]), _or(x["RuleID"]), _or(x["StartLine"], 0)
    g = g.withColumn("t", tiers.secret_severity(file, x["Secret"], x["Match"], rule, F.lit("HIGH")))
    return _rows(g, category=F.lit("secret"), severity=F.col("t.severity"), key=rule, file=file, line=line,
                 commit=F.nullif(x["Commit"], F.lit("")),
                 title=F.concat_ws(" ", F.lit("secret:"), F.substring(F.coalesce(F.nullif(x["Description"], F.lit("")), rule), 1, 80), F.col("t.note")),
                 fingerprint=_fp(F.lit("secret"), file, rule, line))


def norm_trufflehog(reports: DataFrame) -> DataFrame:
    """JSON lines. A verified credential is CRITICAL; anything else stays MEDIUM."""
    lines = (reports.filter("tool = 'trufflehog'").select("repo", "snapshot", "tool", F.explode(F.split("raw", "\n")).alias("l")).filter("trim(l) <> ''"))
    x = lines.select("repo", "snapshot", "tool", F.from_json("l", """DetectorName string, DetectorType string, Verified boolean, SourceMetadata struct<Data struct<
        Filesystem struct<file string, line int>, Git struct<file string, path string, line int>>>""").alias("x")).filter("x IS NOT NULL")
    c = F.col("x")
    data = c["SourceMetadata"]["Data"]
    det = F.coalesce(c["DetectorName"], c["DetectorType"], F.lit("secret"))
    file = F.coalesce(data["Filesystem"]["file"], data["Git"]["file"], data["Git"]["path"], F.lit(""))
    line = F.coalesce(data["Filesystem"]["line"], data["Git"]["line"], F.lit(0))
    ok = _or(c["Verified"], False)
    return _rows(x, category=F.lit("secret"), severity=F.when(ok, "CRITICAL").otherwise("MEDIUM"), key=det, file=file, line=line, verified=ok,
                 title=F.concat_ws(" ", F.lit("secret:"), det, F.when(ok, F.lit("verified live")).otherwise(F.lit("unverified"))),
                 fingerprint=_fp(F.lit("secret"), file, det, line))


def norm_semgrep(reports: DataFrame) -> DataFrame:
    d = _doc(reports, "semgrep", """results array<struct<check_id string, path string, start struct<line int>, match_based_id string,
        extra struct<severity string, message string>>>""")
    g = _each(d, F.col("d.results"))
    x = F.col("x")
    rule, path, line = _or(x["check_id"]), _or(x["path"]), _or(x["start"]["line"], 0)
    severity = ranks.lookup(_or(x["extra"]["severity"], "INFO"), {"ERROR": "HIGH", "WARNING": "MEDIUM", "INFO": "INFO"}, "MEDIUM")
    return _rows(g, category=F.lit("sast"), severity=severity, rule_id=rule, key=F.element_at(F.split(rule, r"\."), -1), file=path, line=line,
                 semantic_id=F.nullif(x["match_based_id"], F.lit("")), title=F.substring(F.coalesce(F.nullif(x["extra"]["message"], F.lit("")), rule), 1, 90),
                 fingerprint=_fp(F.lit("sast"), path, line, rule, x["match_based_id"]))


def norm_gosec(reports: DataFrame) -> DataFrame:
    """Line numbers come as text, sometimes as a range; the first number counts."""
    d = _doc(reports, "gosec", "Issues array<struct<severity string, cwe struct<id string>, rule_id string, details string, file string, line string>>")
    g = _each(d, F.col("d.Issues"))
    x = F.col("x")
    line = F.coalesce(F.split_part(x["line"], F.lit("-"), F.lit(1)).try_cast("int"), F.lit(0))
    cwe = F.nullif(_or(x["cwe"]["id"]), F.lit(""))
    title = F.concat(F.substring(F.coalesce(F.nullif(x["details"], F.lit("")), x["rule_id"]), 1, 90), F.coalesce(F.concat(F.lit(" (CWE-"), cwe, F.lit(")")), F.lit("")))
    return _rows(g, category=F.lit("sast"), severity=ranks.clean_severity(x["severity"]), key=x["rule_id"], file=x["file"], line=line,
                 title=title, fingerprint=_fp(F.lit("sast"), x["file"], line, x["rule_id"]))


def norm_bandit(reports: DataFrame) -> DataFrame:
    """The anchor is the source text without its line numbers; an ordinal tells equal sites apart.

    The ordinal counts within one path, rule and anchor of a repo, so its window is one file's hits."""
    d = _doc(reports, "bandit", """results array<struct<filename string, test_id string, test_name string, line_number int, issue_confidence string,
        issue_severity string, issue_text string, code string>>""")
    g = _each(d, F.col("d.results"))
    x = F.col("x")
    source = F.trim(F.regexp_replace(_or(x["code"]), r"(?m)^\s*\d+\s+", ""))
    anchor = F.when(source != "", ident.sha(source, 20)).otherwise(F.lit("unavailable"))
    g = g.select("*", _or(x["filename"]).alias("_f"), _or(x["test_id"]).alias("_r"), anchor.alias("_a"))
    order = W.partitionBy("repo", "snapshot", "_f", "_r", "_a").orderBy("pos", x["line_number"], x["issue_text"])
    g = g.withColumn("_n", F.row_number().over(order))
    conf = F.when(x["issue_confidence"].isin("LOW", "MEDIUM", "HIGH"), x["issue_confidence"]).otherwise(F.lit("UNKNOWN"))
    return _rows(g, category=F.lit("sast"), severity=ranks.clean_severity(x["issue_severity"]), native_confidence=conf, key=F.col("_r"), rule_id=F.col("_r"),
                 file=F.col("_f"), line=_or(x["line_number"], 0), semantic_id=F.concat_ws(":", F.lit("bandit"), "_a", F.col("_n")),
                 title=F.substring(F.coalesce(F.nullif(x["issue_text"], F.lit("")), x["test_name"], F.col("_r")), 1, 180),
                 fingerprint=_fp(F.lit("sast"), F.col("_f"), F.col("_r"), F.col("_a"), F.col("_n")))


def norm_brakeman(reports: DataFrame) -> DataFrame:
    d = _doc(reports, "brakeman", "warnings array<struct<warning_type string, message string, file string, line int, confidence string, check_name string, fingerprint string>>")
    g = _each(d, F.col("d.warnings"))
    x = F.col("x")
    line, native = _or(x["line"], 0), F.nullif(x["fingerprint"], F.lit(""))
    return _rows(g, category=F.lit("sast"), severity=ranks.lookup(_or(x["confidence"], "Medium"), {"High": "HIGH", "Medium": "MEDIUM", "Weak": "LOW"}, "MEDIUM"),
                 key=x["check_name"], file=x["file"], line=line, semantic_id=native,
                 title=F.substring(F.concat(_or(x["warning_type"], "warning"), F.lit(": "), _or(x["message"])), 1, 90),
                 fingerprint=F.coalesce(native, _fp(F.lit("sast"), x["file"], line, x["check_name"])))


def norm_checkov(reports: DataFrame) -> DataFrame:
    """One object or a list of objects, one per framework."""
    block = "struct<results struct<failed_checks array<struct<check_id string, check_name string, file_path string, repo_file_path string, file_line_range array<int>, resource string, severity string>>>>"
    d = reports.filter("tool = 'checkov'").select("repo", "snapshot", "tool", F.explode(
        F.when(F.ltrim("raw").startswith("["), F.from_json("raw", f"array<{block}>")).otherwise(F.array(F.from_json("raw", block)))).alias("b"))
    g = _each(d, F.col("b.results.failed_checks"))
    x = F.col("x")
    file, line = F.coalesce(F.nullif(x["file_path"], F.lit("")), x["repo_file_path"], F.lit("")), F.coalesce(F.get(x["file_line_range"], F.lit(0)), F.lit(0))
    return _rows(g, category=F.lit("iac"), severity=ranks.clean_severity(_or(x["severity"], "MEDIUM")), key=x["check_id"], file=file, line=line, resource=x["resource"],
                 title=F.substring(F.coalesce(F.nullif(x["check_name"], F.lit("")), x["check_id"]), 1, 90),
                 fingerprint=_fp(F.lit("iac"), file, x["check_id"], x["resource"], line))


NORMALISERS = [norm_trivy, norm_osv, norm_gitleaks, norm_trufflehog, norm_semgrep, norm_gosec, norm_bandit, norm_brakeman, norm_checkov]


def normalize_all(reports: DataFrame) -> DataFrame:
    """Rows of every native report, advisories named by the input they affect."""
    rows = reduce(DataFrame.unionByName, [f(reports) for f in NORMALISERS])
    sca = F.col("category") == "sca"
    dep = ident.sca_identity(F.col("file"), F.col("ecosystem"), F.col("pkg"), F.col("installed"), F.col("cve"))
    return (rows.withColumn("semantic_id", F.when(sca, dep).otherwise(F.col("semantic_id")))
            .withColumn("fingerprint", F.when(sca, dep).otherwise(F.col("fingerprint"))))


# The field that must hold the rows of each tool, and tools that may leave it null.
SHAPES = {"trivy": "Results", "semgrep": "results", "osv-scanner": "results", "gosec": "Issues", "brakeman": "warnings", "bandit": "results"}
NULL_OK = ["trivy", "gosec"]
# Failures that concern one rule, not the whole run.
RULE_FAILURES = ["Timeout", "TimeoutDuringInterfile", "OutOfMemory", "OutOfMemoryDuringInterfile", "StackOverflow",
                 "PartialParsing", "MaxMemory", "Timeout during interfile analysis"]


# Diagnostics of one input file, which is skipped or read in part while the run goes on.
FILE_FAILURES = {"PartialParsing": "partial-parse", "Syntax error": "parse-failed", "Lexical error": "parse-failed", "Other syntax error": "parse-failed"}
# Kinds of diagnostics that make the outcome an error, and one that makes it partial.
FAILED = ["scanner-error", "contradiction", "invalid-count"]
INCOMPLETE = "rule-incomplete"

DIAGNOSTIC = "array<struct<kind string, subject string, path string, reason string, n bigint>>"


def _note(kind, subject="", path="", reason="", n=1) -> Column:
    def col(v):
        return v if isinstance(v, Column) else F.lit(v)
    return F.struct(col(kind).cast("string").alias("kind"), F.coalesce(col(subject), F.lit("")).alias("subject"), F.coalesce(col(path), F.lit("")).alias("path"),
                    col(reason).cast("string").alias("reason"), col(n).cast("bigint").alias("n"))


def _when(cond: Column, note: Column) -> Column:
    return F.when(F.coalesce(cond, F.lit(False)), note)


def _present(notes) -> Column:
    return F.filter(F.array(*notes), lambda x: x.isNotNull())


def _count(text: Column) -> Column:
    """The number, if the text is one that can count things."""
    return F.when(text.rlike("^[0-9]{1,18}$"), text.cast("bigint"))


def _semgrep_notes(outside) -> Column:
    d = F.from_json("raw", """errors array<struct<type string, rule_id string, check_id string, path string, location struct<path string>, level string>>, skipped_rules array<string>""")

    def note(e):
        # A type is a name, or a list that begins with one; of several names the first known one counts.
        names = F.when(e["type"].startswith("["), F.from_json(e["type"], "array<string>")).otherwise(F.array(e["type"]))
        names = F.filter(F.coalesce(names, F.array().cast("array<string>")), lambda x: x.isNotNull())
        kind = F.coalesce(F.get(F.filter(names, lambda x: x.isin(*RULE_FAILURES)), F.lit(0)), F.get(names, F.lit(0)), F.lit("error"))
        rule = F.coalesce(F.nullif(e["rule_id"], F.lit("")), F.nullif(e["check_id"], F.lit("")), F.lit(""))
        path = F.coalesce(F.nullif(e["path"], F.lit("")), e["location"]["path"], F.lit(""))
        of_rule = kind.isin(*RULE_FAILURES) & (rule != "")
        of_file = kind.isin(*FILE_FAILURES) & F.coalesce(e["level"] == "warn", F.lit(False)) & (path != "")
        what = (F.when(of_rule, F.lit(INCOMPLETE)).when(of_file & outside(path), F.lit("limitation-excluded")).when(of_file, F.lit("file-limitation")).otherwise(F.lit("scanner-error")))
        return _note(what, rule, path, F.when(of_file & ~of_rule, F.element_at(F.create_map(*[F.lit(x) for kv in FILE_FAILURES.items() for x in kv]), kind)).otherwise(kind))
    errors = F.transform(F.coalesce(d["errors"], F.array().cast("array<struct<type string, rule_id string, check_id string, path string, location struct<path string>, level string>>")),
                         lambda e: note(F.coalesce(e, F.from_json(F.lit("{}"), "type string, rule_id string, check_id string, path string, location struct<path string>, level string"))))
    return F.concat(errors, _present([_when(F.size(d["skipped_rules"]) > 0, _note("skipped", reason="rules", n=F.size(d["skipped_rules"])))]))


CHECKOV = """array<struct<check_type string, results struct<passed_checks array<string>, failed_checks array<string>, skipped_checks array<string>, parsing_errors array<string>>,
  summary struct<passed string, failed string, skipped string, parsing_errors string, resource_count string>, errors array<string>,
  passed string, failed string, skipped string, parsing_errors string, resource_count string>>"""


def _checkov_notes(outside) -> Column:
    rows = F.from_json(F.when(F.ltrim("raw").startswith("["), F.col("raw")).otherwise(F.concat(F.lit("["), F.col("raw"), F.lit("]"))), CHECKOV)

    def of_row(r):
        # The counts stand in a summary, or in the row itself where nothing was found to check.
        def said(name):
            return F.coalesce(r["summary"][name], r[name])
        name = F.coalesce(r["check_type"], F.lit("checkov"))
        listed = F.coalesce(r["results"]["parsing_errors"], F.array().cast("array<string>"))
        paths = F.filter(listed, lambda p: F.coalesce(p != "", F.lit(False)))
        inside = F.filter(paths, lambda p: ~outside(p))
        total = F.greatest(F.coalesce(_count(said("parsing_errors")), F.lit(0)), F.size(listed))
        evaluated = F.lit(False)
        for c in ("passed_checks", "failed_checks", "skipped_checks"):
            evaluated = evaluated | F.coalesce(F.size(r["results"][c]) > 0, F.lit(False))
        for c in ("passed", "failed", "skipped", "resource_count"):
            evaluated = evaluated | F.coalesce(_count(said(c)) > 0, F.lit(False))
        lost = F.when(evaluated, F.lit(0)).otherwise(F.size(inside)) + total - F.size(paths)
        skipped = F.coalesce(_count(said("skipped")), F.size(r["results"]["skipped_checks"]), F.lit(0))
        single = [
            _when(F.size(r["errors"]) > 0, _note("scanner-error", name, reason="reported errors")),
            _when(lost > 0, _note("scanner-error", name, reason=F.when(~evaluated & (F.size(inside) > 0), F.lit("no evaluated resources")).otherwise(F.lit("not attributed to a file")), n=lost)),
            *[_when(said(c).isNotNull() & _count(said(c)).isNull(), _note("invalid-count", name, reason=c)) for c in ("parsing_errors", "skipped")],
            *[_when(r["summary"][c].isNotNull() & (F.size(r["results"][f"{c}_checks"]) >= 0) & ~F.coalesce(_count(r["summary"][c]) == F.size(r["results"][f"{c}_checks"]), F.lit(False)),
                    _note("contradiction", name, reason=c)) for c in ("failed", "passed", "skipped")],
            _when(skipped > 0, _note("skipped", name, reason="checks", n=skipped))]
        limits = F.when(evaluated, F.transform(inside, lambda p: _note("file-limitation", name, p, "parse-failed"))).otherwise(F.array().cast(DIAGNOSTIC))
        away = F.transform(F.filter(paths, outside), lambda p: _note("limitation-excluded", name, p, "parse-failed"))
        return F.concat(_present(single), limits, away)
    return F.flatten(F.transform(F.filter(F.coalesce(rows, F.array().cast(CHECKOV)), lambda r: r.isNotNull()), of_row))


def _bandit_notes() -> Column:
    d = F.from_json("raw", "errors array<string>, metrics struct<_totals struct<nosec string, skipped_tests string>>")
    totals = d["metrics"]["_totals"]
    skipped = _count(totals["skipped_tests"])
    return _present([_when(F.size(d["errors"]) > 0, _note("scanner-error", reason="reported errors")),
                     *[_when(totals[c].isNotNull() & _count(totals[c]).isNull(), _note("invalid-count", reason=c)) for c in ("nosec", "skipped_tests")],
                     _when(skipped > 0, _note("skipped", reason="tests", n=skipped))])


def _other_notes() -> Column:
    found = [F.size(F.from_json("raw", f"{name} array<string>")[name]) > 0 for name in ("errors", "Errors")]
    return _present([_when(F.coalesce(found[0], F.lit(False)) | F.coalesce(found[1], F.lit(False)), _note("scanner-error", reason="reported errors"))])


def _inside_skipped(path: Column) -> Column:
    from ..sources.files import PRIVATE_DIRS, SKIP_DIRS
    parts = F.split(path, "/")
    return F.arrays_overlap(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), F.array(*[F.lit(n) for n in sorted({*PRIVATE_DIRS, *SKIP_DIRS})]))


def _diagnostics(outside) -> Column:
    tool = F.col("tool")
    return F.coalesce(F.when(tool == "semgrep", _semgrep_notes(outside)).when(tool == "checkov", _checkov_notes(outside)).when(tool == "bandit", _bandit_notes()).otherwise(_other_notes()),
                      F.array()).cast(DIAGNOSTIC)


def report_diagnostics(reports: DataFrame, outside=_inside_skipped) -> DataFrame:
    """(repo, snapshot, tool, kind, subject, path, reason, n): what the documents say about their own runs, one row each.

    Kinds: rule-incomplete (a rule timed out or ran out of memory), file-limitation (one file was skipped or read in part),
    limitation-excluded (such a file outside the scope, by ``outside(path)``), scanner-error, contradiction (a count that its list does
    not bear out), invalid-count (no whole number), skipped (n rules, checks or tests). A quoted whole number counts as one. Documents that are no JSON say nothing."""
    return (reports.filter("tool <> 'trufflehog'").select("repo", "snapshot", "tool", F.explode_outer(_diagnostics(outside)).alias("d")).filter("d IS NOT NULL")
            .select("repo", "snapshot", "tool", "d.*"))


def report_validity(reports: DataFrame, outside=_inside_skipped) -> DataFrame:
    """(repo, snapshot, tool, outcome, rule_errors, errors) per document.

    outcome: parse_failed (not JSON), wrong_shape, error (a diagnostic of the whole run, or counts that contradict their lists),
    partial (some rules failed), ok. Limitations of single files leave the outcome as it is; see report_diagnostics."""
    r = reports.filter("tool <> 'trufflehog'").withColumn("v", F.try_parse_json("raw"))
    kind = F.schema_of_variant("v")
    is_list, is_obj = kind.startswith("ARRAY"), kind.startswith("OBJECT")

    def is_array(path):
        return F.coalesce(F.schema_of_variant(F.try_variant_get("v", path, "variant")).startswith("ARRAY"), F.lit(False))
    shape = F.lit(False)
    for tool, field in SHAPES.items():
        here = is_array(f"$.{field}")
        if tool in NULL_OK:
            here = here | F.coalesce(kind.contains(f"{field}: VOID"), F.lit(False))
        if tool == "bandit":
            here = here & is_array("$.errors")
        shape = F.when(F.col("tool") == tool, is_obj & here).otherwise(shape)
    shape = F.when(F.col("tool").isin("gitleaks", "gitleaks-dir"), is_list | is_array("$.findings")).otherwise(shape)
    shape = F.when(F.col("tool") == "checkov", is_list | is_array("$.results.failed_checks")).otherwise(shape)
    shape = F.when(F.col("tool") == "sarif", is_obj & is_array("$.runs")).otherwise(shape)
    r = r.select("repo", "snapshot", "tool", "v", F.coalesce(shape, F.lit(False)).alias("_shape"), _diagnostics(outside).alias("_d"))
    scoped, failed = F.size(F.filter("_d", lambda x: x["kind"] == INCOMPLETE)), F.size(F.filter("_d", lambda x: x["kind"].isin(*FAILED)))
    outcome = (F.when(F.col("v").isNull(), F.lit("parse_failed")).when(~F.col("_shape"), F.lit("wrong_shape"))
               .when(failed > 0, F.lit("error")).when(scoped > 0, F.lit("partial")).otherwise(F.lit("ok")))
    return r.select("repo", "snapshot", "tool", outcome.alias("outcome"), scoped.cast("int").alias("rule_errors"), failed.cast("int").alias("errors"))


SARIF = """runs array<struct<tool struct<driver struct<name string, guid string, rules array<struct<id string,
  messageStrings map<string, struct<text string>>, defaultConfiguration struct<level string>, properties map<string, string>>>>>,
  automationDetails struct<id string>, results array<struct<ruleId string, ruleIndex int, kind string, level string, baselineState string,
  message struct<text string, id string, arguments array<string>>,
  locations array<struct<physicalLocation struct<artifactLocation struct<uri string>, region struct<startLine int>>>>,
  partialFingerprints map<string, string>, fingerprints map<string, string>, suppressions array<struct<kind string, status string>>>>>>"""


def expand_message(template: Column, args: Column) -> Column:
    """Replace {0}, {1}, … by the arguments; nothing else in the text is interpreted."""
    args = F.coalesce(args, F.array().cast("array<string>"))
    pairs = F.transform(args, lambda a, i: F.struct(i.alias("i"), a.alias("a")))
    return F.aggregate(pairs, template, lambda acc, p: F.replace(acc, F.concat(F.lit("{"), p["i"].cast("string"), F.lit("}")), p["a"]))


def safe_import_path(uri: Column) -> Column:
    """struct(path, error): a relative path inside the source root, or why the URI is refused."""
    raw = F.coalesce(uri, F.lit(""))
    decoded = F.translate(F.try_url_decode(F.replace(raw, F.lit("+"), F.lit("%2B"))), "\\", "/")
    fold = F.aggregate(
        F.split(decoded, "/"), F.array().cast("array<string>"),
        lambda acc, p: F.when(p.isin("", "."), acc)
        .when((p == "..") & (F.size(acc) > 0) & (F.coalesce(F.try_element_at(acc, F.lit(-1)), F.lit("")) != ".."), F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))))
        .otherwise(F.concat(acc, F.array(p))))
    path = F.array_join(fold, "/")
    error = (F.when(raw == "", F.lit("empty")).when(raw.rlike(r"[\x00-\x1f\x7f]"), F.lit("control-character"))
             .when(raw.rlike("%(?![0-9a-fA-F]{2})"), F.lit("bad-escape")).when(decoded.isNull() | decoded.rlike("%[0-9a-fA-F]{2}|[\\x00-\\x1f]"), F.lit("ambiguous-escape"))
             .when(decoded.rlike(r"^([A-Za-z][A-Za-z0-9+.-]*:|/)|[?#]"), F.lit("absolute-or-remote"))
             .when((path == "..") | path.startswith("../"), F.lit("escapes-root")))
    return F.struct(F.when(error.isNull(), F.when(path == "", F.lit(".")).otherwise(path)).alias("path"), error.alias("error"))


def norm_sarif(reports: DataFrame) -> DataFrame:
    """One row per SARIF result: accepted findings, observations, and rejected rows with the reason.

    Rules are joined from a dictionary of (report, run, index or id), so results and rules cost their sum. ``identity`` binds
    tool, rule, automation id, file and the producer's fingerprints; without fingerprints the row is
    bound to its place in the report. Colliding identities get an occurrence number and a flag."""
    d = reports.filter("tool = 'sarif'").select("repo", "snapshot", F.sha2("raw", 256).alias("rid"), F.from_json("raw", SARIF).alias("d"))
    runs = d.select("repo", "snapshot", "rid", F.posexplode("d.runs").alias("run", "r"))
    at = ["repo", "snapshot", "rid", "run"]
    found = runs.select(*at, F.col("r.tool.driver.name").alias("driver"), F.coalesce("r.tool.driver.guid", F.lit("")).alias("guid"),
                        F.coalesce("r.automationDetails.id", F.lit("")).alias("automation"), F.posexplode("r.results").alias("pos", "x"))
    # A result names its rule by index or else by id, so the dictionary has a row for each index and one for each id.
    # A report that lies there twice gives each of them once.
    entry = runs.select(*at, F.posexplode("r.tool.driver.rules").alias("_i", "_ru"))
    names = F.array(F.concat(F.lit("#"), F.col("_i")), F.concat(F.lit("="), F.col("_ru.id")))
    entries = entry.select(*at, "_i", "_ru", F.explode(names).alias("_key")).groupBy(*at, "_key").agg(F.min_by("_ru", "_i").alias("_ru"), F.count_distinct("_i").alias("_dups"))
    key = F.when(F.col("x.ruleIndex").isNotNull(), F.concat(F.lit("#"), F.col("x.ruleIndex"))).otherwise(F.concat(F.lit("="), F.col("x.ruleId")))
    same = lambda c: F.col(f"f.{c}").eqNullSafe(F.col(f"b.{c}"))
    j = (found.withColumn("_key", key).alias("f").join(entries.alias("b"), same("repo") & same("snapshot") & same("rid") & same("run") & (F.col("f._key") == F.col("b._key")), "left")
         .select("f.*", F.col("b._ru").alias("_rule"), F.col("b._dups").alias("_dups")))
    j = j.withColumn("_ru", F.when(F.col("x.ruleIndex").isNotNull(), F.col("_rule"))).withColumn("_rd", F.when(F.col("x.ruleIndex").isNull(), F.col("_rule")))
    x = F.col("x")
    j = j.withColumn("_ix", x["ruleIndex"]).withColumn("_id", x["ruleId"])
    rule = F.coalesce("_ru", F.when(F.col("_ix").isNull(), F.col("_rd")))
    kind = _or(x["kind"], "fail")
    level = F.coalesce(x["level"], F.when(kind == "fail", _or(rule["defaultConfiguration"]["level"], "warning")).otherwise(F.lit("none")))
    raw_score = rule["properties"]["security-severity"]
    score = raw_score.try_cast("double")
    by_level = ranks.lookup(level, {"error": "HIGH", "warning": "MEDIUM", "note": "LOW", "none": "INFO"})
    by_score = F.when(score > 0, tiers.cvss_band(score)).otherwise(F.lit("INFO"))
    text = F.coalesce(x["message"]["text"], rule["messageStrings"][x["message"]["id"]]["text"])
    loc = F.get(x["locations"], F.lit(0))["physicalLocation"]
    j = j.select(
        *at, "driver", "guid", "automation", "pos", F.coalesce(rule["id"], F.col("_id")).alias("rule_id"), kind.alias("kind"), level.alias("level"),
        F.when((kind == "fail") & score.isNotNull(), by_score).otherwise(by_level).alias("severity"), expand_message(text, x["message"]["arguments"]).alias("title"), (F.size(F.coalesce(x["message"]["arguments"], F.array())) > 0).alias("_has_args"),
        F.when(F.size(F.coalesce(x["locations"], F.array())) > 0, safe_import_path(loc["artifactLocation"]["uri"])).alias("_p"),
        F.coalesce(loc["region"]["startLine"], F.lit(0)).alias("line"), _fingerprint_text(x).alias("_fps"),
        (F.size(F.coalesce(x["suppressions"], F.array())) > 0).alias("natively_suppressed"), x["baselineState"].alias("_bs"),
        "_ix", "_id", F.col("_ru.id").alias("_rid"), F.col("_ru").isNull().alias("_noru"), "_dups", raw_score.alias("_rs"), score.alias("_score"))
    reason = (F.when(F.col("_ix").isNotNull() & F.col("_noru"), F.lit("rule index is out of range"))
              .when(F.col("_ix").isNotNull() & F.col("_id").isNotNull() & (F.col("_id") != F.col("_rid")), F.lit("rule id and index disagree"))
              .when(F.col("_ix").isNull() & (F.col("_dups") > 1), F.lit("duplicate rule definitions"))
              .when(F.coalesce("rule_id", F.lit("")) == "", F.lit("no rule id"))
              .when(F.coalesce("title", F.lit("")) == "", F.lit("no message"))
              .when(F.col("title").rlike(r"\{[0-9]{1,6}\}") & F.col("_has_args"), F.lit("missing message argument"))
              .when(~F.col("kind").isin("fail", "pass", "open", "review", "notApplicable", "informational"), F.lit("invalid kind"))
              .when(F.col("_bs").isNotNull() & ~F.col("_bs").isin("new", "unchanged", "updated", "absent"), F.lit("invalid baseline state"))
              .when(~F.col("level").isin("error", "warning", "note", "none"), F.lit("invalid level"))
              .when((F.col("kind") == "fail") == (F.col("level") == "none"), F.lit("kind and level disagree"))
              .when(F.col("_rs").isNotNull() & (F.col("_score").isNull() | ~F.col("_score").between(0, 10)), F.lit("invalid security severity"))
              .when(F.col("_p.error").isNotNull(), F.concat(F.lit("path: "), F.col("_p.error"))))
    stable = F.col("_fps") != ""
    identity = ident.sha(F.concat_ws("\u0001", "driver", "guid", "rule_id", "automation", F.coalesce("_p.path", F.lit("")), "_fps",
                                     F.when(~stable, F.concat_ws("|", "rid", "run", "pos"))), 64)
    j = j.withColumn("reason", reason).withColumn("identity", F.when(reason.isNull(), identity))
    outcome = F.when(F.col("reason").isNotNull(), F.lit("rejected")).when(F.col("kind") == "fail", F.lit("finding")).otherwise(F.lit("observation"))
    out = j.select("repo", "snapshot", "rid", "run", "pos", outcome.alias("outcome"), "reason", "driver", "rule_id", "kind", "level", "severity",
                   F.col("_p.path").alias("file"), "line", "title", "natively_suppressed",
                   F.when(stable, F.lit("producer-fingerprint")).otherwise(F.lit("report-local")).alias("identity_basis"), "identity")
    # The parsed rows are narrow; writing them once is cheaper than parsing every document again.
    out = cut_lineage(out)
    crowd = out.filter("identity IS NOT NULL").groupBy("repo", "identity").agg((F.count(F.lit(1)) > 1).alias("ambiguous"))
    return out.join(crowd, ["repo", "identity"], "left")


def _fingerprint_text(x: Column) -> Column:
    """Producer fingerprints as sorted text; partial ones win over full ones, empty when there are none."""
    def text(m):
        e = F.array_sort(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))))
        return F.array_join(F.transform(e, lambda kv: F.concat(kv["key"], F.lit("="), kv["value"])), ",")
    return F.coalesce(F.nullif(text(x["partialFingerprints"]), F.lit("")), text(x["fingerprints"]))


def norm_dast(reports: DataFrame) -> DataFrame:
    """One row per alert instance; a field of the instance overrides the alert's, the site's, the report's."""
    ctx = "application_id string, build_id string, identity string, method string, parameter string, param string, uri string, url string, auth_verified boolean"
    schema = f"{ctx}, site array<struct<{ctx}, alerts array<struct<pluginid string, attack_class string, {ctx}, instances array<struct<{ctx}>>>>>>"
    d = reports.filter("tool = 'dast'").select("repo", "snapshot", F.from_json("raw", schema).alias("d"))
    s = d.select("repo", "snapshot", "d", F.explode("d.site").alias("s"))
    a = s.select("repo", "snapshot", "d", "s", F.explode("s.alerts").alias("a"))
    i = a.select("repo", "snapshot", "d", "s", "a", F.explode_outer("a.instances").alias("i"))

    def near(field):
        return F.coalesce(*[F.col(f"{lvl}.{field}") for lvl in ("i", "a", "s", "d")])
    url = F.coalesce(*[F.coalesce(F.col(f"{lvl}.uri"), F.col(f"{lvl}.url")) for lvl in ("i", "a", "s", "d")])
    param = F.coalesce(*[F.coalesce(F.col(f"{lvl}.param"), F.col(f"{lvl}.parameter")) for lvl in ("i", "a", "s", "d")])
    path = F.try_parse_url(url, F.lit("PATH"))
    host = F.try_parse_url(url, F.lit("AUTHORITY"))
    return i.select("repo", "snapshot", F.trim("a.pluginid").alias("plugin_id"), F.col("a.attack_class").alias("attack_class"),
                    near("application_id").alias("application_id"), near("build_id").alias("build_id"), near("identity").alias("identity"),
                    F.coalesce(F.nullif(path, F.lit("")), F.when(host.isNotNull(), F.lit("/"))).alias("endpoint"), F.upper(near("method")).alias("method"), param.alias("parameter"),
                    F.when(host.isNotNull(), F.concat(F.try_parse_url(url, F.lit("PROTOCOL")), F.lit("://"), F.regexp_replace(host, "^.*@", ""))).alias("origin"),
                    near("auth_verified").alias("auth_verified"))
