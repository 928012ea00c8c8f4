"""Severity and confidence tiers of scanner rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import is_doc_file, is_example_file, is_test_file, placeholder_value
from .ranks import severity_rank

# Cloud key shapes, most telling first (pattern, severity, note).
AWS_TIERS = [
    (r"(?i)X-Amz-(Signature|Credential|Expires|Security-Token)=", "LOW", "presigned-url"),
    (r"\bASIA[0-9A-Z]{16}\b", "MEDIUM", "temporary-token"),
    (r"\b(?:AROA|AIDA|AGPA|AIPA|ANPA|ANVA)[0-9A-Z]{16}\b", "LOW", "resource-identifier"),
    (r"\bAKIA[0-9A-Z]{16}\b", "HIGH", "long-lived-access-key"),
]
# Provider prefixes, first match wins.
PROVIDER_TIERS = [
    (r"\bwhsec_[A-Za-z0-9]{16,}", "HIGH", "webhook-signing-secret"),
    (r"\bsk_live_[A-Za-z0-9]{16,}", "HIGH", "payment-live-secret"),
    (r"\brk_live_[A-Za-z0-9]{16,}", "HIGH", "payment-restricted-live"),
    (r"\bsk_test_[A-Za-z0-9]{16,}", "LOW", "payment-test-secret"),
    (r"\b(?:ghp|gho|ghu|ghs|ghr)_[A-Za-z0-9]{30,}|\bgithub_pat_[A-Za-z0-9_]{40,}", "HIGH", "github-token"),
    (r"\bglpat-[A-Za-z0-9_\-]{20,}", "HIGH", "gitlab-token"),
    (r"\bxox[baprs]-[A-Za-z0-9-]{10,}", "HIGH", "slack-token"),
    (r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}", "HIGH", "sendgrid-key"),
    (r"\bnpm_[A-Za-z0-9]{36}\b", "HIGH", "npm-token"),
    (r"\bdop_v1_[a-f0-9]{64}\b", "HIGH", "digitalocean-token"),
    (r"\bshpat_[a-fA-F0-9]{32}\b", "HIGH", "shopify-token"),
    (r"\bAIza[0-9A-Za-z_\-]{35}\b", "MEDIUM", "google-api-key"),
    (r"\bpk_live_[A-Za-z0-9]{16,}", "LOW", "publishable-key"),
]
# Rule ids of catch-all secret rules.
GENERIC_RULES = ["generic-api-key", "generic-api-key-1", "generic", "api-key", "secret-keyword",
                 "high-entropy", "high-entropy-string", "entropy"]
SECRET_LIKE = (r"(?i)secret|credential|api[_-]?key|token|password|passwd|private[_-]?key|appsync|"
               r"access[_-]?key|auth[_-]?header|hardcoded")


def secret_tier(blob: Column) -> Column:
    """struct(severity, note) of a provider-identified secret; NULL when no provider shape is seen."""
    out = None
    for pattern, severity, note in AWS_TIERS + PROVIDER_TIERS:
        hit = F.struct(F.lit(severity).alias("severity"), F.lit(note).alias("note"))
        cond = F.coalesce(blob, F.lit("")).rlike(pattern)
        out = F.when(cond, hit) if out is None else out.when(cond, hit)
    return out


def generic_rule(rule: Column) -> Column:
    r = F.lower(F.coalesce(rule, F.lit("")))
    return r.isin(*GENERIC_RULES) | r.contains("generic") | r.contains("entropy")


def placeholder_tier(path: Column, value: Column, provider_identified: Column) -> Column:
    """struct(severity, note) for template files, documentation and made-up values; else NULL.

    A provider prefix is itself the evidence, so it switches the value test off."""
    def tier(severity, note):
        return F.struct(F.lit(severity).alias("severity"), F.lit(note).alias("note"))
    return (F.when(~provider_identified & placeholder_value(value), tier("INFO", "placeholder-value"))
            .when(is_example_file(path), tier("LOW", "example-file"))
            .when(is_doc_file(path), tier("LOW", "doc-file")))


def secret_severity(path: Column, value: Column, match: Column, rule: Column, native: Column) -> Column:
    """struct(severity, note) of one secret hit: provider shape, then catch-all rule, then the tool's own.

    A rule recognised as catch-all counts as identified, as a tier was already given to it."""
    by_shape = secret_tier(F.concat_ws(" ", value, match))
    identified = by_shape.isNotNull() | generic_rule(rule)
    base_sev = F.coalesce(by_shape["severity"], F.when(generic_rule(rule), F.lit("MEDIUM")))
    base_note = F.coalesce(by_shape["note"], F.when(generic_rule(rule), F.lit("generic-rule")))
    ph = placeholder_tier(path, value, identified)
    return F.struct(
        F.coalesce(ph["severity"], base_sev, native).alias("severity"),
        F.nullif(F.concat_ws("; ", base_note, ph["note"]), F.lit("")).alias("note"))


def secret_like(category: Column, *texts: Column) -> Column:
    return (category == "secret") | F.concat_ws(" ", *texts).rlike(SECRET_LIKE)


def cvss_band(score: Column) -> Column:
    s = score.cast("string").try_cast("double")
    return (F.when(s.isNull(), F.lit("MEDIUM")).when(s >= 9.0, F.lit("CRITICAL")).when(s >= 7.0, F.lit("HIGH"))
            .when(s >= 4.0, F.lit("MEDIUM")).when(s > 0, F.lit("LOW")).otherwise(F.lit("UNKNOWN")))


def derive_confidence(c: dict) -> Column:
    """struct(confidence, basis). ``c`` maps category, file, key, severity, verified, native, value,
    semantic_id and reachability to Columns; native is NULL where the tool reports none."""
    def out(confidence, basis):
        return F.struct(F.lit(confidence).alias("confidence"), F.lit(basis).alias("basis"))
    native = F.upper(c["native"])
    secret, sca = c["category"] == "secret", c["category"] == "sca"
    iac, sast = c["category"] == "iac", c["category"] == "sast"
    path = c["file"]
    return (F.when(native.isin("HIGH", "MEDIUM", "LOW"),
                   F.struct(native.alias("confidence"), F.lit("reported").alias("basis")))
            .when(native.isNotNull(), out("LOW", "unrecognised-native"))
            .when(secret & F.coalesce(c["verified"], F.lit(False)), out("HIGH", "verified-live"))
            .when(secret & ((c["severity"] == "INFO") | placeholder_value(c["value"])), out("LOW", "placeholder-value"))
            .when(secret & is_example_file(path), out("LOW", "example-file"))
            .when(secret & is_doc_file(path), out("LOW", "doc-file"))
            .when(secret & is_test_file(path), out("LOW", "test-file"))
            .when(secret & generic_rule(c["key"]), out("LOW", "generic-rule"))
            .when(secret, out("HIGH", "provider-rule"))
            .when(sca & (c["reachability"] == "not-imported"), out("MEDIUM", "not-imported"))
            .when(sca, out("HIGH", "pinned-version"))
            .when(iac, out("MEDIUM", "config-policy"))
            .when(sast & (is_test_file(path) | is_doc_file(path)), out("LOW", "test-or-doc"))
            .when(sast & (F.coalesce(c["semantic_id"], F.lit("")) != ""), out("MEDIUM", "semantic-rule"))
            .when(sast, out("MEDIUM", "syntactic-pattern"))
            .otherwise(out("MEDIUM", "default")))


def at_least(severity: Column, floor: str) -> Column:
    from .ranks import SEVERITY
    return severity_rank(severity) >= SEVERITY[floor]
