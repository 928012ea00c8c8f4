"""Binomial statistics as column arithmetic."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

Z95 = 1.959963984540054

# Probability used when no cell is large enough, and the size a cell must reach.
PRIOR = {"HIGH": 0.85, "MEDIUM": 0.5, "LOW": 0.25}
PRIOR_OTHER = 0.5
MIN_N = 5


def _parts(k: Column, n: Column, z: float):
    n = n.cast("double")
    p = k.cast("double") / n
    denom = 1.0 + z * z / n
    centre = (p + z * z / (2.0 * n)) / denom
    half = (z / denom) * F.sqrt(p * (1.0 - p) / n + z * z / (4.0 * n * n))
    return centre, half


def wilson_lo(k: Column, n: Column, z: float = Z95) -> Column:
    """Lower end of the Wilson score interval; an empty sample knows nothing, so 0."""
    centre, half = _parts(k, n, z)
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.greatest(F.lit(0.0), centre - half))


def wilson_hi(k: Column, n: Column, z: float = Z95) -> Column:
    """Upper end of the Wilson score interval; an empty sample knows nothing, so 1."""
    centre, half = _parts(k, n, z)
    return F.when(n <= 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), centre + half))


def proportion(k: Column, n: Column) -> Column:
    return F.when(n > 0, k.cast("double") / n.cast("double"))


def prior_of(confidence: Column) -> Column:
    out = F.lit(PRIOR_OTHER)
    for name, p in PRIOR.items():
        out = F.when(confidence == name, F.lit(p)).otherwise(out)
    return out


def wilson(flag: Column, z: float = Z95) -> Column:
    """Aggregate over a nullable boolean: struct(n, k, p, ci_lo, ci_hi). NULL flags are unknown and leave n."""
    n, k = F.count(flag), F.count_if(flag)
    return F.struct(
        n.alias("n"), k.alias("k"),
        F.round(proportion(k, n), 3).alias("p"),
        F.round(wilson_lo(k, n, z), 3).alias("ci_lo"),
        F.round(wilson_hi(k, n, z), 3).alias("ci_hi"))
