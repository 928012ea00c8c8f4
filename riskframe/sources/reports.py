"""Reading report documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def classify_reports(reports: DataFrame) -> DataFrame:
    """Adds status: ok or parse_failed. A malformed document is never an empty clean result."""
    good_lines = F.forall(F.filter(F.split("raw", "\n"), lambda l: F.trim(l) != ""), lambda l: F.try_parse_json(l).isNotNull())
    ok = F.when(F.col("tool") == "trufflehog", good_lines).otherwise(F.try_parse_json("raw").isNotNull())
    return reports.withColumn("status", F.when(ok, F.lit("ok")).otherwise(F.lit("parse_failed")))


def read_scan_reports(spark: SparkSession, path: str) -> DataFrame:
    """reports(repo, snapshot, tool, raw, status) of a tree laid out as <path>/<repo>/<snapshot>/<tool>.json."""
    raw = spark.read.text(path, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.json")
    file = F.input_file_name()
    parts = F.split(file, "/")
    docs = raw.select(F.element_at(parts, -3).alias("repo"), F.element_at(parts, -2).alias("snapshot"),
                      F.regexp_replace(F.element_at(parts, -1), r"\.json$", "").alias("tool"), F.col("value").alias("raw"))
    return classify_reports(docs)


def stage_reports(reports: DataFrame, path: str) -> DataFrame:
    """Write the documents once, in a folder per tool, and read them back.

    Each normaliser filters on the tool, so afterwards it reads its own folder only and all of them
    together read the documents once. Not needed where the table is already laid out by tool."""
    reports.write.mode("overwrite").partitionBy("tool").parquet(path)
    return reports.sparkSession.read.parquet(path)
