"""Scanner rows to one ledger: demotion, merging, de-duplication, confidence, ranking, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import ident, ranks, tiers
from ..functions.paths import is_example_file, is_test_file
from .core import top_k


def placeholder_demote(scan: DataFrame) -> DataFrame:
    """Lower secret-like rows in template and documentation files or with a made-up value. Never raises."""
    like = tiers.secret_like(F.col("category"), F.coalesce("key", F.lit("")), F.coalesce("title", F.lit("")))
    # The patterns of a tier are tried once a row, in an array of one row: that is left out of generated code, which with them grows
    # beyond what Java compiles. A rank reads its argument once for each name, so the tier is a column of its own.
    tier = F.transform(F.array(F.struct("file", "secret")), lambda r: tiers.placeholder_tier(r["file"], r["secret"], F.lit(False))["severity"])
    tiered = scan.withColumn("_tier", F.when(like, F.get(tier, F.lit(0))))
    lower = F.col("_tier").isNotNull() & (ranks.severity_rank(F.col("severity")) > ranks.severity_rank(F.col("_tier")))
    label = F.when(is_example_file(F.col("file")), F.lit("example-file")).otherwise(F.lit("doc-file"))
    return (tiered.withColumn("_lower", lower).withColumn("placeholder_tier", F.when(F.col("_lower"), label))
            .withColumn("severity", F.when(F.col("_lower"), F.col("_tier")).otherwise(F.col("severity"))).drop("_tier", "_lower"))


def fixture_demote(scan: DataFrame) -> DataFrame:
    """Secrets in test files fall to LOW; the note stays on the row."""
    hit = ((F.col("category") == "secret") & is_test_file(F.col("file")) & tiers.at_least(F.col("severity"), "MEDIUM"))
    return (scan.withColumn("in_fixture", F.coalesce(hit, F.lit(False)))
            .withColumn("severity", F.when(hit, F.lit("LOW")).otherwise(F.col("severity"))))


def local_only_demote(scan: DataFrame, ignored: DataFrame) -> DataFrame:
    """Working-tree secrets in files that version control ignores fall to LOW. ``ignored(repo, path)``."""
    paths = ignored.select("repo", F.col("path").alias("file"), F.lit(True).alias("_ig")).distinct()
    hit = (F.col("_ig") & (F.col("tool") == "trivy") & (F.col("category") == "secret")
           & tiers.at_least(F.col("severity"), "MEDIUM"))
    return (scan.join(paths, ["repo", "file"], "left")
            .withColumn("local_only", F.coalesce(hit, F.lit(False)))
            .withColumn("severity", F.when(F.col("local_only"), F.lit("LOW")).otherwise(F.col("severity")))
            .drop("_ig").select(*scan.columns, "local_only"))


def history_only(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Adds ``in_tree`` and ``history_only`` for secrets of the history scanner whose file is gone."""
    present = files.select("repo", F.col("path").alias("file"), F.lit(True).alias("_p")).distinct()
    mine = (F.col("tool") == "gitleaks") & (F.col("category") == "secret")
    in_tree = F.when(mine, F.when(F.col("scan_mode") == "dir", F.lit(True)).otherwise(F.coalesce("_p", F.lit(False))))
    return (scan.join(present, ["repo", "file"], "left").withColumn("in_tree", in_tree)
            .withColumn("history_only", F.coalesce(~F.col("in_tree"), F.lit(False)))
            .select(*scan.columns, "in_tree", "history_only"))


def merge_scan_modes(scan: DataFrame) -> DataFrame:
    """Rows of one fingerprint seen by the history and the tree pass become one ``git+dir`` row.

    Repeats of the first mode before the second one appears stay, as they are ordinary duplicates."""
    keys = ["repo", "snapshot", "fingerprint"]
    mine = scan.filter("tool = 'gitleaks'")
    seen = (mine.groupBy(*keys).agg(F.min(F.when(F.col("scan_mode") == "git", F.col("seq"))).alias("_g"),
                                    F.min(F.when(F.col("scan_mode") == "dir", F.col("seq"))).alias("_d"))
            .filter("_g IS NOT NULL AND _d IS NOT NULL")
            .select(*keys, F.least("_g", "_d").alias("_first"), F.greatest("_g", "_d").alias("_switch")))
    merged = (mine.join(seen, keys, "left").filter("_switch IS NULL OR seq < _switch")
              .withColumn("scan_mode", F.when(F.col("seq") == F.col("_first"), F.lit("git+dir"))
                          .otherwise(F.col("scan_mode"))).select(*scan.columns))
    return scan.filter("tool <> 'gitleaks' OR tool IS NULL").unionByName(merged)


def dedupe_findings(scan: DataFrame) -> DataFrame:
    """One row per fingerprint: fields of the first row, worst severity, union of tools, fixes, aliases.

    Everything is a partial aggregate, so a fingerprint with a third of all rows is reduced before the
    shuffle. The collected sets hold distinct tool names and version strings only."""
    keys = ["repo", "snapshot", "fingerprint"]
    merged = {"tool", "severity", "fixed", "alias"}
    first = [c for c in scan.columns if c not in merged | set(keys)]
    rank = ranks.severity_rank(F.col("severity"))
    out = scan.groupBy(*keys).agg(
        F.min_by(F.struct(*first), F.struct("seq", "tool", "line")).alias("_f"),
        F.array_sort(F.collect_set("tool")).alias("tools"),
        F.max_by("severity", F.struct(rank, -F.col("seq"))).alias("severity"),
        F.nullif(F.array_join(F.array_sort(F.collect_set("fixed")), ", "), F.lit("")).alias("fixed"),
        F.array_sort(F.collect_set("alias")).alias("advisory_aliases"),
        F.count(F.lit(1)).alias("copies"))
    return out.select(*keys, "_f.*", "tools", "severity", "fixed", "advisory_aliases", "copies")


def with_confidence(scan: DataFrame) -> DataFrame:
    have = set(scan.columns)

    def col(name, kind="string"):
        return F.col(name) if name in have else F.lit(None).cast(kind)
    got = tiers.derive_confidence({
        "category": F.col("category"), "file": F.col("file"), "key": F.coalesce(col("key"), col("rule_id")),
        "severity": F.col("severity"), "verified": col("verified", "boolean"), "native": col("native_confidence"),
        "value": col("secret"), "semantic_id": col("semantic_id"), "reachability": col("reachability")})
    return (scan.withColumn("_c", got).withColumn("confidence", F.col("_c.confidence"))
            .withColumn("confidence_basis", F.col("_c.basis")).drop("_c"))


def with_instance_id(scan: DataFrame) -> DataFrame:
    return scan.withColumn("instance_id", ident.instance_id(
        F.col("category"), F.col("file"), F.col("key"), F.col("line"), F.coalesce("cve", "pkg")))


def merge_imports(scan: DataFrame, imports: DataFrame) -> DataFrame:
    """Imported rows join the scanner rows; per semantic id the best one stays and counts its sites.

    Best: a failed result first, then severity, then the source text as a tiebreak."""
    rank = F.struct((F.col("kind") == "fail").alias("f"), ranks.severity_rank(F.col("severity")).alias("s"), F.col("raw"))
    keys = ["repo", "semantic_id"]
    rest = [c for c in imports.columns if c not in keys]
    best = (imports.groupBy(*keys).agg(F.max_by(F.struct(*rest), rank).alias("_b"),
                                       F.count_distinct("raw").alias("occurrences"))
            .select(*keys, "_b.*", "occurrences"))
    return scan.unionByName(best, allowMissingColumns=True)


def summarize(findings: DataFrame, dims=("severity", "category", "confidence")) -> DataFrame:
    """Long counts per repo: (repo, dimension, value, n). One pass with grouping sets."""
    dims = list(dims)
    sets = [["repo", d] for d in dims] + [["repo"]]
    grouped = (findings.select("repo", *dims).groupingSets([[F.col(c) for c in g] for g in sets], "repo", *dims)
               .agg(F.count(F.lit(1)).alias("n"), F.grouping_id().alias("_gid")))
    # grouping_id sets a bit for each column left out; the first column is the highest bit.
    width = len(dims)
    name, value = F.lit("total"), F.lit("all")
    for i, d in enumerate(dims):
        gid = (1 << width) - 1 - (1 << (width - 1 - i))
        name = F.when(F.col("_gid") == gid, F.lit(d)).otherwise(name)
        value = F.when(F.col("_gid") == gid, F.coalesce(F.col(d), F.lit("UNKNOWN"))).otherwise(value)
    return grouped.select("repo", name.alias("dimension"), value.alias("value"), "n")


def rank_order(tiebreak):
    return [ranks.severity_rank(F.col("severity")).desc(),
            F.coalesce(ranks.confidence_rank(F.col("confidence")), F.lit(-1)).desc(),
            *[F.col(c).asc() for c in tiebreak]]


def rank_findings(findings: DataFrame, tiebreak=("finding_id",)) -> DataFrame:
    """Whole ledger, worst first. A range-partitioned sort."""
    return findings.orderBy(*rank_order(tiebreak))


def top_findings(findings: DataFrame, k: int = 15, group=("repo",), tiebreak=("finding_id",)) -> DataFrame:
    return top_k(findings, list(group), rank_order(tiebreak), k)


def triage_order(findings: DataFrame) -> DataFrame:
    """Severity, then probability, then rows an agent may not fix alone last."""
    return findings.orderBy(ranks.severity_rank(F.col("severity")).desc(),
                            F.coalesce(F.col("p"), F.lit(0.0)).desc(),
                            (F.col("disposition") == "human-required").asc(), F.col("finding_id").asc())


# Classes reviewers set aside, memory classes and languages that rule them out.
LOW_SIGNAL = {"redos": "regex-complexity", "open-redirect": "open-redirect-alone",
              "missing-usage-cap": "hardening-gap", "llm-unbounded": "cost-concern"}
MEMORY_CLASSES = ["buffer-overflow", "use-after-free", "memory-safety"]
MEMORY_SAFE = ["python", "node", "typescript", "ruby", "go", "java", "csharp"]


def likely_filtered(findings: DataFrame, languages: DataFrame) -> DataFrame:
    """Adds ``likely_filtered`` and the first ``filter_reason``. ``languages(repo, language)``."""
    from ..functions.paths import PRODUCT_LOOKALIKE
    safe = languages.groupBy("repo").agg(F.bool_and(F.lower("language").isin(*MEMORY_SAFE)).alias("_safe"))
    cls, low = F.lower(F.coalesce("attack_class", F.lit(""))), F.lower(F.translate("location", "\\", "/"))
    reason = ranks.lookup(cls, LOW_SIGNAL)
    reason = F.coalesce(
        reason,
        F.when(low.rlike(r"\.(md|mdx|rst|txt|adoc)$"), F.lit("prose-file")),
        F.when(is_test_file(low) & ~low.rlike(PRODUCT_LOOKALIKE), F.lit("test-file")),
        F.when(cls.isin(*MEMORY_CLASSES) & F.coalesce("_safe", F.lit(False)), F.lit("memory-safe-stack")))
    return (findings.join(safe, "repo", "left").withColumn("filter_reason", reason)
            .withColumn("likely_filtered", F.col("filter_reason").isNotNull()).drop("_safe"))


def attach_history_note(scan: DataFrame) -> DataFrame:
    return scan.withColumn("title", F.when(F.col("history_only"), F.concat("title", F.lit(" [history only]")))
                           .otherwise(F.col("title")))


def env_fallback_demote(scan: DataFrame, files: DataFrame) -> DataFrame:
    """Hard-coded fallbacks of an environment variable fall to LOW when any file asserts that variable.

    The variable is read from the lines around the hit (two before to one after); assertions are
    searched line by line in script files of the same repo."""
    code = r"process\.env(?:\.([A-Z0-9_]+)|\[['\"]([A-Z0-9_]+)['\"]\])\s*(?:\|\||\?\?)"
    wanted = scan.filter((F.col("category") == "sast") & F.col("key").contains("insecure-default"))
    lines = (files.select("repo", F.col("path").alias("file"), F.posexplode(F.split("content", "\n")).alias("_pos", "text")))
    reads = (lines.filter(F.col("text").contains("process.env") & F.col("text").rlike(code))
             .select("repo", "file", (F.col("_pos") + 1).alias("_at"),
                     F.coalesce(F.nullif(F.regexp_extract("text", code, 1), F.lit("")),
                                F.regexp_extract("text", code, 2)).alias("var")))
    # Each read answers hits from one line above it to two below: an equi join on the line, no range scan.
    near = reads.select("repo", "file", "var", "_at", F.explode(F.sequence(F.col("_at") - 1, F.col("_at") + 1)).alias("line"))
    sites = wanted.select("repo", "file", "line").distinct()
    var_of = (sites.join(near, ["repo", "file", "line"])
              .groupBy("repo", "file", "line").agg(F.min_by("var", "_at").alias("var")))
    asserted = asserted_variables(files)
    guarded = var_of.join(asserted, ["repo", "var"], "left_semi").withColumnRenamed("var", "guarded_env")
    out = scan.join(guarded, ["repo", "file", "line"], "left")
    mine = F.col("guarded_env").isNotNull() & (F.col("category") == "sast") & F.col("key").contains("insecure-default")
    return (out.withColumn("guarded_env", F.when(mine, F.col("guarded_env")))
            .withColumn("severity", F.when(mine, ranks.lowered_to(F.col("severity"), "LOW")).otherwise(F.col("severity")))
            .select(*scan.columns, "guarded_env"))


def asserted_variables(files: DataFrame) -> DataFrame:
    """(repo, var) of environment variables whose absence stops the program."""
    name = r"([A-Z][A-Z0-9_]{1,63})"
    shapes = [
        r"if\s*\(\s*!\s*process\.env\." + name + r"[^)]{0,80}\)\s*\{?[^}]{0,200}?(?:throw|process\.exit|assert|fatal)",
        r"(?:invariant|assert|ok|required|requireEnv|assertEnv|mustGetEnv|getRequiredEnv)\s*\([^)]{0,80}?\b" + name,
        r"['\"]?\b" + name + r"['\"]?\s*:\s*(?:z|Joi|joi|yup|v|type|envalid|str|num)\b",
        r"throw\s+new\s+\w{0,40}Error\s*\([^)]{0,200}?\b" + name,
    ]
    code = files.filter(F.col("path").rlike(r"\.(?:ts|tsx|js|jsx|mjs|cjs)$"))
    found = F.flatten(F.array(*[F.regexp_extract_all("content", F.lit(p), F.lit(1)) for p in shapes]))
    return code.select("repo", F.explode(F.array_distinct(found)).alias("var")).filter("var <> ''").distinct()


