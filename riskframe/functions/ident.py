"""Identifiers: fingerprints and ids built from stable fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha(col: Column, length: int = 16) -> Column:
    return F.substring(F.sha2(col, 256), 1, length)


def strip_line_suffix(col: Column) -> Column:
    """Forward slashes, and no trailing ``:12``, ``:L12`` or ``:12:3``."""
    return F.regexp_replace(F.translate(F.coalesce(col, F.lit("")), "\\", "/"), r":L?\d+(:\d+)?$", "")


def clean_path(col: Column) -> Column:
    return F.regexp_replace(strip_line_suffix(F.trim(col)), r"^(\./)+", "")


def embedded_paths(location: Column) -> Column:
    """Paths named in parentheses inside a location text."""
    return F.regexp_extract_all(F.coalesce(location, F.lit("")), F.lit(r"\(([^()\s]+)\)"), F.lit(1))


# Output name of an identity field and the input fields it may come from, in order.
IDENTITY_FIELDS = {
    "cve": ("cve", "vulnerability_id"),
    "method": ("method",),
    "package": ("package", "pkg"),
    "parameter": ("parameter",),
    "resource": ("resource", "resource_id"),
    "rule_id": ("rule_id", "rule", "check_id"),
    "service": ("service", "service_id"),
    "sink": ("semantic_id", "sink_id", "sink"),
    "symbol": ("symbol", "function"),
}


def identity_struct(columns) -> Column:
    """Semantic identity of a ledger row: no title, line, severity or intelligence takes part.

    ``to_json`` drops the fields that are NULL, so an unknown field is not part of the identity."""
    have = set(columns)

    def col(name):
        return F.col(name) if name in have else F.lit(None).cast("string")

    parts = {
        "attack_class": F.coalesce(col("attack_class"), F.lit("")),
        "category": F.coalesce(col("category"), F.lit("")),
        "location": strip_line_suffix(col("location")),
        "file": F.when(col("file") != "", strip_line_suffix(col("file"))),
    }
    for name, sources in IDENTITY_FIELDS.items():
        present = [F.col(s) for s in sources if s in have]
        parts[name] = F.coalesce(*present) if present else F.lit(None).cast("string")
    if "title" in have:
        from_title = F.upper(F.nullif(
            F.regexp_extract(F.col("title"), r"(?i)\b(CVE-\d{4}-\d+|GHSA-[\w-]+)\b", 1), F.lit("")))
        parts["cve"] = F.coalesce(parts["cve"], F.when(col("attack_class") == "cve", from_title))
    return F.struct(*[parts[k].alias(k) for k in sorted(parts)])


def fingerprint(columns) -> Column:
    return sha(F.to_json(identity_struct(columns)))


def legacy_fingerprint(attack_class: Column, location: Column, title: Column) -> Column:
    e = F.lit("")
    return sha(F.concat_ws("|", F.coalesce(attack_class, e), F.coalesce(location, e), F.coalesce(title, e)))


def instance_id(category: Column, path: Column, rule: Column, line: Column, what: Column) -> Column:
    """Portable id of one occurrence: the rule id names the detector, this names the site."""
    e = F.lit("")
    return F.concat(F.lit("place1_"), sha(F.concat_ws(
        "|", F.coalesce(category, e), F.coalesce(path, e), F.coalesce(rule, e),
        F.coalesce(line, F.lit(0)).cast("string"), F.coalesce(what, e))))


def cluster_id(kind: Column, disc: Column) -> Column:
    return F.concat(F.lit("wc1_"), F.substring(kind, 1, 3), F.lit("_"), sha(F.concat_ws("|", kind, disc), 12))


def sample_id(*cols: Column) -> Column:
    """Digest of provenance fields."""
    return F.sha2(F.to_json(F.struct(*cols)), 256)


def sca_identity(path: Column, ecosystem: Column, pkg: Column, version: Column, cve: Column) -> Column:
    eco = F.lower(F.coalesce(ecosystem, F.lit("")))
    # Ecosystem synonyms.
    for alias, name in {"python-pkg": "pip", "node-pkg": "npm", "gobinary": "gomod"}.items():
        eco = F.when(eco == alias, F.lit(name)).otherwise(eco)
    e = F.lit("")
    return F.concat(F.lit("dependency:"), sha(F.concat_ws(
        "\u0001", F.coalesce(path, e), eco, F.coalesce(pkg, e), F.coalesce(version, e), F.coalesce(cve, e)), 24))


def cve_of(*cols: Column) -> Column:
    """First CVE id found in the columns, in order; NULL when none names one."""
    return F.coalesce(*[
        F.upper(F.nullif(F.regexp_extract(F.coalesce(c, F.lit("")), r"(?i)\b(CVE-\d{4}-\d{4,})\b", 1), F.lit("")))
        for c in cols])
