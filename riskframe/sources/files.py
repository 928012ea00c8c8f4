"""Selecting and classifying files before their texts are read."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ..functions import paths

# Read limits, and folders never descended into.
MAX_BYTES = 2_000_000
BUDGET_BYTES = 64 * 1024 * 1024
SKIP_DIRS = ["node_modules", ".git", "dist", "build", "out", ".next", ".nuxt", "vendor", "venv", ".venv", "__pycache__", "coverage", ".cache", "target", ".terraform", ".tox", ".mypy_cache", ".pytest_cache", ".idea", ".vscode", "bower_components", ".svelte-kit"]
PRIVATE_DIRS = [".local"]


def classify_read(files: DataFrame, max_bytes: int = MAX_BYTES, budget: int = BUDGET_BYTES) -> DataFrame:
    """Adds read_status: ok, oversized or byte_budget_exceeded.

    The budget of a repo is spent in the order of the path digests, so the result does not depend on
    partitioning. The running sum has two levels: sums of 4096 digest buckets per repo, then a window
    inside one bucket, so a repo with a third of all files is spread over thousands of tasks."""
    f = files.withColumn("_h", F.md5("path")).withColumn("_b", F.substring("_h", 1, 3))
    take = F.when(F.col("n_bytes") <= max_bytes, F.col("n_bytes")).otherwise(F.lit(0))
    sums = f.groupBy("repo", "_b").agg(F.sum(take).alias("_s"))
    before = W.partitionBy("repo").orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offs = sums.select("repo", "_b", F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_off"))
    inner = W.partitionBy("repo", "_b").orderBy("_h", "path").rowsBetween(W.unboundedPreceding, W.currentRow)
    run = f.withColumn("_run", F.sum(take).over(inner)).join(offs, ["repo", "_b"])
    status = (F.when(F.col("n_bytes") > max_bytes, F.lit("oversized")).when(F.col("_off") + F.col("_run") > budget, F.lit("byte_budget_exceeded")).otherwise(F.lit("ok")))
    return run.withColumn("read_status", status).select(*[c for c in files.columns if c != "read_status"], "read_status")


def glob_regex(pattern: str) -> str:
    """Regular expression of a path glob: ``**`` is any number of folders, ``*`` stays within one."""
    out, i = "", 0
    while i < len(pattern):
        if pattern.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif pattern.startswith("**", i):
            out, i = out + ".*", i + 2
        elif pattern[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif pattern[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(pattern[i]), i + 1
    return f"^{out}$"


def prune_paths(files: DataFrame, skip_dirs=None, excludes=()) -> DataFrame:
    """Adds skip_reason: private, skip-dir, excluded or NULL. Rows stay, so coverage can count them."""
    parts = F.split("path", "/")
    folders = F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))

    def within(names):
        return F.arrays_overlap(folders, F.array(*[F.lit(n) for n in names]))
    out = F.lit(False)
    for e in excludes:
        out = out | F.contains("path", F.lit(e)) | (F.col("path").rlike(glob_regex(e)) if any(c in e for c in "*?[") else F.lit(False))
    return files.withColumn("skip_reason", F.when(within(PRIVATE_DIRS), F.lit("private")).when(within(skip_dirs or SKIP_DIRS), F.lit("skip-dir")).when(out, F.lit("excluded")))


def scope_files(files: DataFrame, only: DataFrame):
    """(files in scope, matched, missed). ``only(repo, entry)``: a path or a whole-component folder prefix."""
    want = only.select("repo", F.regexp_replace("entry", r"^\./|/+$", "").alias("entry")).distinct()
    hit = (files.select("repo", "path").distinct().select("repo", "path", F.explode(F.concat(F.array(F.lit(".")), paths.ancestors(F.col("path")))).alias("entry"))
           .join(want, ["repo", "entry"], "left_semi"))
    chosen = hit.select("repo", "path").distinct()
    matched = hit.select("repo", "entry").distinct()
    return files.join(chosen, ["repo", "path"], "left_semi"), matched, want.join(matched, ["repo", "entry"], "left_anti")


def glob_files(files: DataFrame, pattern: str) -> DataFrame:
    """Files whose path matches a glob. Nothing is truncated, so there is no gap to record."""
    return files.filter(F.col("path").rlike(glob_regex(pattern)))


def with_size(files: DataFrame) -> DataFrame:
    return files.withColumn("n_bytes", F.octet_length("content").cast("bigint")).withColumn("sha256", F.sha2("content", 256))


def read_unified_diff(diffs: DataFrame) -> DataFrame:
    """hunks(repo, path, start_line, end_line) of ``diffs(repo, diff_id, content)``.

    The current file is filled forward over the lines of one diff; deletions of whole hunks vanish."""
    lines = diffs.select("repo", "diff_id", F.posexplode(F.split("content", "\r?\n")).alias("pos", "l"))
    head = F.when(F.startswith("l", F.lit("+++ ")), F.when(F.startswith("l", F.lit("+++ b/")), F.trim(F.substring("l", 7, 4096))).otherwise(F.lit("/dev/null")))
    keep = lines.withColumn("_h", head).filter(F.col("_h").isNotNull() | F.startswith("l", F.lit("@@")))
    w = W.partitionBy("repo", "diff_id").orderBy("pos").rowsBetween(W.unboundedPreceding, W.currentRow)
    rx = r"^@@ -\d+(?:,\d+)? \+(\d+)(?:,(\d+))? @@"
    h = keep.withColumn("path", F.last("_h", True).over(w)).filter(F.col("l").rlike(rx)).filter("path IS NOT NULL AND path <> '/dev/null'")
    start = F.regexp_extract("l", rx, 1).cast("int")
    count = F.coalesce(F.regexp_extract("l", rx, 2).try_cast("int"), F.lit(1))
    return h.select("repo", "path", start.alias("start_line"), (start + count - 1).alias("end_line"), count.alias("_n")).filter("_n > 0").drop("_n")


#: Lines of a file that one window holds; those beside an edge are sent to both sides.
WINDOW_LINES = 1 << 14


def line_window(lines: DataFrame, before: int = 2, after: int = 1) -> DataFrame:
    """Adds window: the text of the lines around each line of ``lines(repo, path, line, text)``.

    Windows run inside runs of WINDOW_LINES lines, so each line is shuffled once and a long file needs no one-task window."""
    run = lambda c: F.floor(c / WINDOW_LINES)
    keyed = lines.filter("repo IS NOT NULL AND path IS NOT NULL AND line IS NOT NULL")
    runs = F.sequence(run(F.col("line") - after), run(F.col("line") + before))
    near = keyed.withColumn("_own", run(F.col("line"))).withColumn("_run", F.explode(runs))
    w = W.partitionBy("repo", "path", "_run").orderBy("line").rangeBetween(-before, after)
    window = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line", "text")).over(w)), lambda x: x["text"]), "\n")
    rest = [c for c in lines.columns if c not in ("repo", "path", "line")]
    return near.withColumn("window", window).filter("_run = _own").select("repo", "path", "line", *rest, "window")


def split_lines(files: DataFrame) -> DataFrame:
    return files.select("repo", "path", F.posexplode(F.split("content", "\r?\n")).alias("_p", "text")).select("repo", "path", (F.col("_p") + 1).alias("line"), "text")


def fill_forward(lines: DataFrame, marker: Column, out: str = "block") -> DataFrame:
    """Assigns each line of a file to the last line before it where ``marker`` is not NULL."""
    w = W.partitionBy("repo", "path").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    return lines.withColumn(out, F.last(marker, True).over(w))
