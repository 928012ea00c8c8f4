"""One ledger from scanner rows and detector packs."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths, ranks

# Scanner category to attack class, sink names that differ from their class.
CATEGORY_CLASS = {"sca": "cve", "secret": "secret", "iac": "iac", "sast": "sast"}



@dataclass(frozen=True)
class Family:
    """How rows of a detector family enter the ledger. Class, severity and confidence stand in where a row has none;
    columns in ``settled`` hold whatever the row says, and ``kinds`` settles columns of single kinds. ``only``: kinds
    that enter (empty: all; the rest stays advice). ``place``: the location of rows without a file."""

    category: str
    attack_class: str
    severity: str
    confidence: str
    settled: tuple = ()
    kinds: dict = field(default_factory=dict)
    only: tuple = ()
    place: str = ""


# Category, class, severity and confidence of the detector families.
FAMILIES = {
    "auth-backdoors": Family("authn", "auth-backdoor", "HIGH", "MEDIUM"),
    "secret-defaults": Family("authn", "insecure-secret-default", "MEDIUM", "LOW"),
    "password-policy": Family("authn", "password-policy", "MEDIUM", "MEDIUM", kinds={"weak-password-policy": {"severity": "LOW", "confidence": "LOW"}}),
    "redirect-leads": Family("attack-surface", "ssrf", "MEDIUM", "LOW", kinds={"proxy-prefix-escape": {"confidence": "MEDIUM"}}),
    "client-exposure": Family("client-exposure", "client-exposure", "HIGH", "HIGH"),
    "key-tiers": Family("client-exposure", "client-exposure", "CRITICAL", "HIGH"),
    "row-security": Family("access-control", "missing-rls", "MEDIUM", "LOW", kinds={"missing-rls-public-key": {"severity": "HIGH", "confidence": "MEDIUM"}}),
    "infrastructure": Family("iac-ci", "iac", "MEDIUM", "MEDIUM", ("confidence",), {"appsync-api-key-mode": {"attack_class": "missing-auth"}}),
    "graphql": Family("graphql", "graphql", "MEDIUM", "MEDIUM", ("confidence",), place="/graphql"),
    "client-integrity": Family("client-integrity", "tamperable-display", "LOW", "LOW", place="client"),
    "web-extension": Family("client-trust", "client-side-entitlement", "LOW", "LOW"),
    "transport": Family("transport", "missing-csp", "LOW", "LOW", ("confidence",), place="(response headers)"),
    "integrations": Family("integrations", "iac", "LOW", "LOW", kinds={"webhook-unsigned": {"attack_class": "webhook-forgery", "severity": "MEDIUM", "confidence": "MEDIUM"}}),
    "uploads": Family("upload", "unrestricted-upload", "MEDIUM", "MEDIUM", ("attack_class", "confidence"), {"no-nosniff": {"attack_class": "content-sniffing"}}),
    "pii": Family("pii", "pii-exposure", "MEDIUM", "MEDIUM", ("attack_class", "confidence")),
    "model-surface": Family("llm-security", "llm-prompt-injection", "MEDIUM", "LOW", ("confidence",)),
    "crypto": Family("crypto", "weak-password-hash", "MEDIUM", "MEDIUM", ("confidence",)),
    "authz-data": Family("access-control", "cookie-authz", "MEDIUM", "LOW", ("confidence",)),
    "agent-config": Family("agent-config", "agent-config-hidden-unicode", "MEDIUM", "MEDIUM"),
    "dependencies": Family("supply-chain", "lockfile-drift", "LOW", "LOW", kinds={"malicious-install-script": {"attack_class": "malicious-install-script"}}, only=("malicious-install-script", "lockfile-drift")),
    "profile": Family("profile-configuration", "transport-security", "MEDIUM", "MEDIUM"),
}


def scan_to_ledger(scan: DataFrame) -> DataFrame:
    """Confidence follows severity for secrets and advisories; a tool with its own confidence keeps it."""
    sure = F.col("category").isin("secret", "sca") & F.col("severity").isin("HIGH", "CRITICAL")
    own = F.when(F.col("native_confidence").isin("HIGH", "MEDIUM", "LOW"), F.col("native_confidence")).otherwise(F.lit("LOW"))
    conf = F.when(F.col("tool") == "bandit", own).when(sure, F.lit("HIGH")).otherwise(F.lit("MEDIUM"))
    return (scan.withColumn("confidence", conf).withColumn("attack_class", ranks.lookup(F.col("category"), CATEGORY_CLASS, "sast"))
            .withColumn("category", F.concat(F.lit("static-"), "category"))
            .withColumn("rule_id", F.col("key")).withColumn("status", F.lit("open")))


def sinks_to_ledger(occurrences: DataFrame, gates: DataFrame) -> DataFrame:
    """Sink occurrences as low-confidence leads; classic SQL injection falls to LOW where a repo has only other stores."""
    only_nosql = F.coalesce("has_nosql", F.lit(False)) & ~F.coalesce("has_sql", F.lit(False))
    sev = F.when((F.col("attack_class") == "sqli") & only_nosql, F.lit("LOW")).otherwise(F.col("severity"))
    return occurrences.join(gates, "repo", "left").select(
        "repo", "attack_class", F.lit("attack-surface").alias("category"), sev.alias("severity"), F.lit("LOW").alias("confidence"),
        F.concat_ws(":", "path", F.col("line").cast("string")).alias("location"), F.col("path").alias("file"), "line", "rule_id", "semantic_id",
        F.concat("rule_id", F.lit(" sink")).alias("title"), F.lit("open").alias("status"))


def pack_to_ledger(rows: DataFrame, category: str) -> DataFrame:
    """Rows of a condition pack (kind, attack_class, severity and maybe a path)."""
    path = F.col("path") if "path" in rows.columns else F.lit("").alias("path")
    return rows.select("repo", "attack_class", F.lit(category).alias("category"), "severity", F.lit("LOW").alias("confidence"), path.alias("location"), path.alias("file"),
                       F.col("kind").alias("rule_id"), F.col("kind").alias("title"), F.lit("open").alias("status"))


def family_to_ledger(rows: DataFrame, name: str) -> DataFrame:
    """families_to_ledger of the rows of one detector."""
    return families_to_ledger(rows.withColumn("family", F.lit(name)))


def families_to_ledger(rows: DataFrame) -> DataFrame:
    """Ledger rows of detector families: ``rows(repo, family, kind)`` and, where the detectors have them, path, line, attack_class,
    severity, confidence and semantic_id. An empty or missing path gives the family's place; a null kind is an unnamed row, kept;
    rows of unknown families are left out.

    One projection: every family's values are literals chosen by its name, nothing is joined or read again."""
    def choose(column):
        own = F.nullif(F.col(column), F.lit("")) if column in rows.columns else F.lit(None).cast("string")
        out = None
        for name, fam in FAMILIES.items():
            default = F.lit(getattr(fam, column))
            value = default if column in fam.settled else F.coalesce(own, default)
            for kind, values in fam.kinds.items():
                if column in values:
                    value = F.when(F.col("kind") == kind, F.lit(values[column])).otherwise(value)
            here = F.col("family") == name
            out = F.when(here, value) if out is None else out.when(here, value)
        return out.alias(column)

    kept = F.col("family").isin(*FAMILIES)
    for name, fam in FAMILIES.items():
        if fam.only:
            kept = kept & ((F.col("family") != name) | F.coalesce(F.col("kind").isin(*fam.only), F.lit(False)))
    path = F.nullif(F.col("path"), F.lit("")) if "path" in rows.columns else F.lit(None).cast("string")
    line = F.col("line").cast("int") if "line" in rows.columns else F.lit(None).cast("int")
    ident = F.col("semantic_id") if "semantic_id" in rows.columns else F.lit(None).cast("string")
    place = F.when(path.isNull(), ranks.lookup(F.col("family"), {n: f.place for n, f in FAMILIES.items()})).otherwise(F.concat_ws(":", path, line.cast("string")))
    kind = F.coalesce("kind", F.lit(""))
    return rows.filter(kept).select("repo", "family", ranks.lookup(F.col("family"), {n: f.category for n, f in FAMILIES.items()}).alias("category"), choose("attack_class"), choose("severity"),
                                    choose("confidence"), place.alias("location"), path.alias("file"), line.alias("line"), kind.alias("rule_id"), ident.alias("semantic_id"),
                                    F.concat_ws(": ", kind, path).alias("title"), F.lit("open").alias("status"))


def public_key_downgrade(ledger: DataFrame, tiers: DataFrame) -> DataFrame:
    """Token hits of scanners in files whose only hosted-database key is the public one: client exposure, INFO, LOW.

    ``ledger(repo, category, title, file, attack_class, severity, confidence)`` and maybe ``sarif`` (imported rows keep their
    judgement); ``tiers(repo, path, role)``. A finding's file may lie deeper than the tier's path: whole trailing components
    are compared, by equality. Adds ``downgraded``. Rows without file, title or repo stay as they are."""
    cols = ledger.columns
    roles = tiers.filter("repo IS NOT NULL AND path IS NOT NULL").groupBy("repo", F.translate("path", "\\", "/").alias("_tail")).agg(F.bool_or(F.col("role") == "anon").alias("_anon"), F.bool_or(F.col("role") == "service_role").alias("_service"))
    token = F.col("category").isin("static-secret", "static-sast") & F.lower("title").rlike("jwt|web token")
    if "sarif" in cols:
        token = token & F.col("sarif").isNull()
    # Only distinct files of token hits meet the tiers, each with one row for a trailing part of its path.
    files = ledger.filter(token & F.col("file").isNotNull()).select("repo", "file").distinct()
    tails = files.select("repo", "file", F.explode(paths.suffixes(F.translate("file", "\\", "/"))).alias("_tail"))
    judged = tails.join(roles, ["repo", "_tail"]).groupBy("repo", "file").agg((F.bool_or("_anon") & ~F.bool_or("_service")).alias("_public"))
    down = token & F.coalesce("_public", F.lit(False))
    out = ledger.join(judged, ["repo", "file"], "left").withColumn("downgraded", F.coalesce(down, F.lit(False)))
    for column, value in (("attack_class", "client-exposure"), ("severity", "INFO"), ("confidence", "LOW")):
        out = out.withColumn(column, F.when(F.col("downgraded"), F.lit(value)).otherwise(F.col(column)))
    return out.select(*cols, "downgraded")


def union_ledger(parts) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def detector_ledger(files: DataFrame) -> DataFrame:
    """Every detector family over files(repo, path, content), as one ledger.

    The packs of file conditions share one pass over the texts and those of repository conditions another; detectors that
    correlate (keys, defaults, dependencies, personal data, row security, passwords, configuration) read the files they ask for."""
    from .detect import engine, packs

    per_file = engine.all_file_findings(files, file_packs())
    per_repo = engine.all_repo_findings(files, repo_packs())
    tiers = packs.token_tiers(files)
    public = tiers.filter("role = 'anon'").select("repo").distinct().withColumn("_public", F.lit(True))
    rls = (packs.missing_rls(files).join(public, "repo", "left")
           .select("repo", F.when(F.col("_public"), F.lit("missing-rls-public-key")).otherwise(F.lit("missing-rls")).alias("kind")))
    # Public and low rows are leads only; the rest is as sure as its family.
    weak = F.when(F.col("severity").isin("INFO", "LOW"), F.lit("LOW"))
    pii = packs.pii_boundary(files).select("repo", "kind", F.col("place").alias("path"))
    one = {
        "client-exposure": packs.client_exposure(files).select("repo", "path", "kind", "severity", weak.alias("confidence")),
        "key-tiers": tiers.select("repo", "path", F.concat(F.lit("hosted-database-key-"), "role").alias("kind"), F.col("tier").alias("severity"), F.when(F.col("tier") == "INFO", F.lit("LOW")).alias("confidence")),
        "secret-defaults": packs.secret_defaults(files).select("repo", "path", F.lit("hard-coded-secret-default").alias("kind"), "severity", "confidence"),
        "password-policy": packs.password_policy(files).filter("drift").select("repo", "path", F.lit("inconsistent-password-policy").alias("kind")).distinct(),
        "row-security": rls,
        "pii": pii,
        "dependencies": packs.dependency_hygiene(files).select("repo", F.col("file").alias("path"), "kind", "severity"),
        "profile": packs.config_checks(files).select("repo", "path", "line", F.col("rule_id").alias("kind"), "semantic_id"),
    }
    return union_ledger([families_to_ledger(per_file), families_to_ledger(per_repo), *[family_to_ledger(rows, name) for name, rows in one.items()]])


def file_packs() -> dict:
    """Packs whose rules look at one file, by family."""
    from .detect import rules as R

    return {"auth-backdoors": R.BACKDOORS, "redirect-leads": R.REDIRECT_LEADS, "crypto": R.CRYPTO, "authz-data": R.AUTHZ_DATA, "uploads": R.UPLOADS, "infrastructure": R.IAC,
            "integrations": R.INTEGRATIONS, "model-surface": R.MODEL_SURFACE, "web-extension": R.EXTENSION, "agent-config": R.AGENT_CONFIG}


def repo_packs() -> dict:
    """Packs whose rules look at all files of a repository, by family."""
    from .detect import rules as R

    return {"transport": R.TRANSPORT, "graphql": R.GRAPHQL, "client-integrity": R.CLIENT_INTEGRITY}
