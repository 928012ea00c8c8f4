"""Calibrated probability that a finding is real, and how well it scores."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import stats
from .textjoin import contains_join


def _cell_columns(n: str = "n", k: str = "k"):
    nc, kc = F.col(n), F.col(k)
    return [nc.cast("bigint").alias("n"), kc.cast("bigint").alias("k"),
            F.round(stats.proportion(kc, nc), 3).alias("p"),
            F.round(stats.wilson_lo(kc, nc), 3).alias("ci_lo"),
            F.round(stats.wilson_hi(kc, nc), 3).alias("ci_hi")]


def wilson_cells(labels: DataFrame, researched: DataFrame | None = None) -> DataFrame:
    """cells(grp, key, n, k, p, ci_lo, ci_hi) per class+label and per label. NULL verdicts leave n.

    ``researched(attack_class)`` limits the class cells to reviewed classes."""
    known = labels.filter(F.col("is_real").isNotNull())
    counts = (known.groupingSets([[F.col("attack_class"), F.col("confidence")], [F.col("confidence")]],
                                 "attack_class", "confidence")
              .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("is_real")).alias("k"),
                   F.grouping("attack_class").alias("_g")))
    cells = counts.select(
        F.when(F.col("_g") == 1, F.lit("label")).otherwise(F.lit("class_label")).alias("grp"),
        F.when(F.col("_g") == 1, F.col("confidence"))
        .otherwise(F.concat_ws("|", "attack_class", "confidence")).alias("key"), *_cell_columns())
    if researched is None:
        return cells
    keep = researched.select(F.col("attack_class").alias("_c")).distinct()
    by_class = cells.filter("grp = 'class_label'").withColumn("_c", F.substring_index("key", "|", 1))
    return by_class.join(keep, "_c", "left_semi").drop("_c").unionByName(cells.filter("grp = 'label'"))


def merge_cells(shipped: DataFrame, local: DataFrame, shipped_status: str = "verified") -> DataFrame:
    """Sum of two cell tables with fresh intervals. A shipped table with unverified history adds nothing."""
    both = local.select("grp", "key", "n", "k")
    if shipped_status != "historical-unverified":
        both = shipped.select("grp", "key", "n", "k").unionByName(both)
    return (both.groupBy("grp", "key").agg(F.sum("n").alias("n"), F.sum("k").alias("k"))
            .select("grp", "key", *_cell_columns()))


def calibrate(findings: DataFrame, cells: DataFrame, min_n: int = stats.MIN_N) -> DataFrame:
    """Adds p, ci_lo, ci_hi, n, basis: class+label cell if large enough, else label cell, else prior.

    Cells are one row per class and label, so Spark's own size check decides on a broadcast."""
    fields = ["n", "p", "ci_lo", "ci_hi"]
    big = cells.filter(F.col("n") >= min_n)
    by_class = big.filter("grp = 'class_label'").select(
        F.col("key").alias("_ck"), F.struct(*fields, F.lit("class+label").alias("basis")).alias("_c"))
    by_label = big.filter("grp = 'label'").select(
        F.col("key").alias("_lk"), F.struct(*fields, F.lit("label").alias("basis")).alias("_l"))
    prior = F.struct(F.lit(0).cast("bigint").alias("n"), stats.prior_of(F.col("confidence")).alias("p"),
                     F.lit(0.0).alias("ci_lo"), F.lit(1.0).alias("ci_hi"), F.lit("prior").alias("basis"))
    return (findings.withColumn("_ck", F.concat_ws("|", "attack_class", "confidence"))
            .join(by_class, "_ck", "left").withColumn("_lk", F.col("confidence")).join(by_label, "_lk", "left")
            .withColumn("_e", F.coalesce("_c", "_l", prior)).select(*findings.columns, "_e.*"))


def brier(labels: DataFrame, cells: DataFrame) -> DataFrame:
    """One row: mean squared error of the calibrated p on known verdicts; NULL when there are none."""
    scored = calibrate(labels.filter("is_real IS NOT NULL").select("attack_class", "confidence", "is_real"), cells)
    err = F.pow(F.col("p") - F.col("is_real").cast("double"), F.lit(2.0))
    return scored.agg(F.round(F.avg(err), 4).alias("brier"), F.count(F.lit(1)).alias("n"))


def reviewed_classes(truth: DataFrame) -> DataFrame:
    """Classes whose every truth entry is reviewed with an explicit verdict."""
    ok = (F.col("review_status") == "reviewed") & F.col("is_real").isNotNull()
    return (truth.filter("attack_class <> ''").groupBy("attack_class")
            .agg(F.bool_and(F.coalesce(ok, F.lit(False))).alias("_ok")).filter("_ok").select("attack_class"))


def truth_match(findings: DataFrame, truth: DataFrame) -> DataFrame:
    """Adds ``is_real``: the verdict all matching truth entries agree on, else NULL.

    Entries match on repo and class, and by wildcard or substring of the location. Wildcards are
    reduced to one row per class first; substrings meet distinct locations through their rarest gram."""
    t = (truth.filter("is_real IS NOT NULL")
         .select(F.col("app").alias("repo"), "attack_class",
                 F.lower(F.coalesce("location_contains", F.lit(""))).alias("_sub"), "is_real"))
    wild = F.col("_sub").isin("", "*")
    any_place = (t.filter(wild).groupBy("repo", "attack_class")
                 .agg(F.min("is_real").alias("_wmin"), F.max("is_real").alias("_wmax")))
    subs = (t.filter(~wild).groupBy("repo", "attack_class", "_sub")
            .agg(F.min("is_real").alias("_smin"), F.max("is_real").alias("_smax")))
    places = findings.select("repo", "attack_class", F.lower("location").alias("_loc")).distinct()
    keys = ["repo", "attack_class"]
    hit = (contains_join(places, subs, keys, "_loc", "_sub").join(subs, [*keys, "_sub"])
           .groupBy(*keys, "_loc").agg(F.min("_smin").alias("_smin"), F.max("_smax").alias("_smax")))
    lo, hi = F.least("_wmin", "_smin"), F.greatest("_wmax", "_smax")
    return (findings.withColumn("_loc", F.lower("location"))
            .join(any_place, ["repo", "attack_class"], "left")
            .join(hit, ["repo", "attack_class", "_loc"], "left")
            .withColumn("is_real", F.when(lo == hi, lo)).select(*findings.columns, "is_real"))


def synthetic_cells(pairs: DataFrame, fired: DataFrame) -> DataFrame:
    """Cells of authored pairs: a vulnerable case that fired is real, a control that fired is not.

    A vulnerable case that stayed silent is an ``error`` row; a silent control says nothing.
    ``pairs(case_id, attack_class, vulnerable)``, ``fired(case_id, confidence)``."""
    hits = pairs.join(fired, "case_id", "left")
    labels = hits.filter("confidence IS NOT NULL").select("attack_class", "confidence", F.col("vulnerable").alias("is_real"))
    missed = (hits.filter("confidence IS NULL AND vulnerable").groupBy("attack_class")
              .agg(F.count(F.lit(1)).alias("n"))
              .select(F.lit("error").alias("grp"), F.col("attack_class").alias("key"), "n",
                      F.lit(0).cast("bigint").alias("k"), F.lit(None).cast("double").alias("p"),
                      F.lit(0.0).alias("ci_lo"), F.lit(1.0).alias("ci_hi")))
    return wilson_cells(labels).unionByName(missed)


def confusion(cases: DataFrame) -> DataFrame:
    """Per partition: tp, fn, tn, fp, unknown, and whether the partition is eligible.

    ``cases(partition, content_hash, vulnerable, detected)``; detected is NULL where the run failed.
    Content that occurs in two partitions disqualifies both."""
    leaks = (cases.groupBy("content_hash").agg(F.min("partition").alias("_a"), F.max("partition").alias("_b"))
             .filter("_a <> _b"))
    shared = (cases.select("partition", "content_hash").distinct().join(leaks, "content_hash", "left_semi")
              .groupBy("partition").agg(F.count(F.lit(1)).alias("shared_contents")))
    v, d = F.col("vulnerable"), F.col("detected")
    counts = cases.groupBy("partition").agg(
        F.count_if(v & d).alias("tp"), F.count_if(v & ~d).alias("fn"), F.count_if(~v & ~d).alias("tn"),
        F.count_if(~v & d).alias("fp"), F.count_if(d.isNull() | v.isNull()).alias("unknown"))
    return (counts.join(shared, "partition", "left")
            .withColumn("shared_contents", F.coalesce("shared_contents", F.lit(0)))
            .withColumn("eligible", (F.col("shared_contents") == 0) & (F.col("unknown") == 0)
                        & (F.col("fn") == 0) & (F.col("fp") == 0)))


def grade_reports(findings: DataFrame, labels: DataFrame, rule_map: DataFrame, scope: DataFrame) -> DataFrame:
    """Per tool: tp, fp, unknown, precision and distinct labels hit.

    ``findings(repo, tool, rule, file, line)``, ``labels(repo, file, line, attack_class, is_real)``,
    ``rule_map(tool, rule, attack_class)``, ``scope(repo, tool, completed)``. A finding is graded only by
    a label at its exact file, line and class; labels that contradict each other are unknown. Precision
    is stated only for tools whose every capture completed."""
    at = ["repo", "file", "line", "attack_class"]
    verdicts = (labels.filter("is_real IS NOT NULL").groupBy(*at)
                .agg(F.min("is_real").alias("_lo"), F.max("is_real").alias("_hi"))
                .select(*at, F.when(F.col("_lo") == F.col("_hi"), F.col("_lo")).alias("verdict")))
    graded = (findings.join(rule_map, ["tool", "rule"], "left").join(verdicts, at, "left"))
    hit = F.when(F.col("verdict").isNotNull(), F.struct(*at))
    done = scope.groupBy("tool").agg(F.bool_and("completed").alias("completed"))
    out = graded.groupBy("tool").agg(
        F.count_if(F.col("verdict")).alias("tp"), F.count_if(~F.col("verdict")).alias("fp"),
        F.count_if(F.col("verdict").isNull()).alias("unknown"), F.count_distinct(hit).alias("label_hits"))
    return (out.join(done, "tool", "left").withColumn(
        "precision", F.when(F.coalesce("completed", F.lit(False)) & (F.col("tp") + F.col("fp") > 0),
                            F.round(F.col("tp") / (F.col("tp") + F.col("fp")), 4))))
