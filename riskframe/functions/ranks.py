"""Ordered enumerations. The orders of severity and confidence."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values. UNKNOWN ranks with LOW where scanner rows and baselines are compared.
SEVERITY = {"CRITICAL": 4, "HIGH": 3, "MEDIUM": 2, "LOW": 1, "UNKNOWN": 1, "INFO": 0}
CONFIDENCE = {"HIGH": 2, "MEDIUM": 1, "LOW": 0}


def lookup(col: Column, table: dict, default=None) -> Column:
    """CASE over a small constant table; stays in codegen and needs no join."""
    out = None
    for key, value in table.items():
        cond = col == F.lit(key)
        out = F.when(cond, F.lit(value)) if out is None else out.when(cond, F.lit(value))
    return out if default is None else out.otherwise(F.lit(default))


def severity_rank(col: Column) -> Column:
    """Rank of a severity name; a missing or strange name ranks 0."""
    return lookup(col, SEVERITY, 0)


def confidence_rank(col: Column) -> Column:
    """Rank of a confidence name; NULL for an unknown one."""
    return lookup(col, CONFIDENCE)


def clean_severity(col: Column) -> Column:
    """Upper-cased severity, or MEDIUM when the name is not one of the known ones."""
    up = F.upper(F.trim(col))
    return F.when(up.isin(*SEVERITY), up).otherwise(F.lit("MEDIUM"))


def lowered_to(severity: Column, cap: str) -> Column:
    """Demotion: never raises a severity."""
    return F.when(severity_rank(severity) > SEVERITY[cap], F.lit(cap)).otherwise(severity)
