"""Threat-intelligence feeds and graph files, with their checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

CVE = r"^CVE-\d{4}-\d{4,}$"


class FeedError(ValueError):
    """A feed failed a check; nothing of it is used."""


def parse_epss(lines: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(epss rows, problems) of ``lines(value)``: comment lines carry score_date and model_version.

    Problems is one row of counts; a load is valid when all are zero."""
    meta = (lines.filter(F.startswith("value", F.lit("#"))).agg(
        F.max(F.nullif(F.regexp_extract("value", r"score_date\s*:\s*(\d{4}-\d{2}-\d{2})", 1), F.lit(""))).alias("_d"),
        F.max(F.nullif(F.regexp_extract("value", r"model_version\s*:\s*([^,\s]+)", 1), F.lit(""))).alias("model_version")))
    md = F.try_to_date(F.regexp_replace(F.regexp_extract("model_version", r"(\d{4}[.-]\d{2}[.-]\d{2})", 1), r"\.", "-"))
    meta = meta.select(F.try_to_date("_d").alias("feed_date"), "model_version", md.alias("model_date"))
    c = F.split("value", ",")
    body = lines.filter(~F.startswith("value", F.lit("#")) & (F.trim("value") != "") & ~F.startswith("value", F.lit("cve,")))
    rows = body.select(F.get(c, F.lit(0)).alias("cve"), F.get(c, F.lit(1)).try_cast("double").alias("epss"), F.get(c, F.lit(2)).try_cast("double").alias("percentile"))
    # One row of metadata: the size of the broadcast is one row.
    out = rows.crossJoin(F.broadcast(meta)).select("cve", "epss", "percentile", "feed_date", "model_version")
    bad = ~F.coalesce(F.col("epss").between(0, 1) & F.col("percentile").between(0, 1) & F.col("cve").rlike(CVE), F.lit(False))
    dup = rows.groupBy("cve").agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicates"), F.count(F.lit(1)).alias("distinct_cves"))
    problems = (rows.agg(F.count_if(bad).alias("invalid_rows")).crossJoin(F.broadcast(dup)).crossJoin(F.broadcast(meta))
                .select("invalid_rows", "duplicates", F.when(F.col("distinct_cves") == 0, F.lit(1)).otherwise(F.lit(0)).alias("empty"),
                        F.when(F.col("feed_date").isNull() | F.col("model_date").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("missing_metadata"),
                        F.when(F.coalesce((F.col("feed_date") > today) | (F.col("model_date") > F.col("feed_date")), F.lit(False)), F.lit(1)).otherwise(F.lit(0)).alias("bad_dates")))
    return out, problems


def read_epss_csv(spark: SparkSession, path: str, today: Column | None = None) -> DataFrame:
    """epss(cve, epss, percentile, feed_date, model_version); raises FeedError when a check fails."""
    rows, problems = parse_epss(spark.read.text(path), F.current_date() if today is None else today)
    found = {k: v for k, v in problems.first().asDict().items() if v}
    if found:
        raise FeedError(f"EPSS feed rejected: {found}")
    return rows


def parse_kev(docs: DataFrame, today: Column) -> tuple[DataFrame, DataFrame]:
    """(kev rows, problems per document) of ``docs(doc_id, raw)``."""
    d = docs.select("doc_id", F.from_json("raw", "catalogVersion string, dateReleased string, count int, vulnerabilities array<struct<cveID string, dateAdded string>>").alias("d"))
    released = F.try_to_date(F.substring("d.dateReleased", 1, 10))
    rows = d.select("doc_id", released.alias("feed_date"), F.explode("d.vulnerabilities").alias("v")).select(
        "doc_id", F.col("v.cveID").alias("cve"), F.try_to_date("v.dateAdded").alias("date_added"), "feed_date")
    per = rows.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("cve").alias("u"), F.count_if(~F.coalesce(F.col("cve").rlike(CVE), F.lit(False))).alias("bad_ids"),
                                     F.count_if(F.coalesce(F.col("date_added") > today, F.lit(True))).alias("bad_dates"))
    problems = (d.join(per, "doc_id", "left").select("doc_id", F.filter(F.array(
        F.when(F.coalesce("n", F.lit(0)) == 0, F.lit("empty")), F.when(~F.coalesce(F.col("d.count") == F.col("n"), F.lit(False)), F.lit("count-mismatch")), F.when(F.col("u") < F.col("n"), F.lit("duplicate-cve")),
        F.when(F.col("bad_ids") > 0, F.lit("invalid-cve")), F.when(F.col("bad_dates") > 0, F.lit("bad-date")), F.when(F.coalesce("d.catalogVersion", F.lit("")) == "", F.lit("missing-version"))),
        lambda e: e.isNotNull()).alias("problems")))
    return rows, problems


def read_kev_json(spark: SparkSession, path: str, today: Column | None = None) -> DataFrame:
    docs = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("doc_id"), F.col("value").alias("raw"))
    rows, problems = parse_kev(docs, F.current_date() if today is None else today)
    bad = problems.filter(F.size("problems") > 0).first()
    if bad:
        raise FeedError(f"KEV feed rejected: {bad['problems']}")
    return rows.select("cve", "date_added", "feed_date")


def parse_graph(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of ``docs(repo, raw)``; edges come from links or edges."""
    from ..operators.graph import DEPENDENCY_RELATIONS
    link = "array<struct<source string, target string, relation string>>"
    d = docs.select("repo", F.from_json("raw", f"nodes array<struct<id string, source_file string, label string, community string>>, links {link}, edges {link}").alias("d"))
    nodes = d.select("repo", F.explode("d.nodes").alias("n")).select("repo", "n.*").filter("id IS NOT NULL")
    edges = d.select("repo", F.explode(F.coalesce("d.links", "d.edges")).alias("e")).select("repo", "e.*")
    return nodes, edges.filter(F.col("relation").isin(*DEPENDENCY_RELATIONS) & F.col("source").isNotNull() & F.col("target").isNotNull())


def read_graph(spark: SparkSession, path: str):
    docs = spark.read.text(path, wholetext=True).select(F.regexp_extract(F.input_file_name(), r"([^/]+)/[^/]*$", 1).alias("repo"), F.col("value").alias("raw"))
    return parse_graph(docs)


METHODS = ["get", "post", "put", "patch", "delete", "head", "options"]


def read_openapi(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(spec_ops, gaps) of contract files. JSON is parsed as a map; YAML by the indentation of its lines.

    spec_ops(repo, file, method, path, operation_id, secured). A file without any path is a gap row."""
    js = files.filter(F.endswith("path", F.lit(".json")) & F.col("content").rlike(r"\"(?:openapi|swagger)\"\s*:"))
    op = "struct<operationId string, security array<map<string, array<string>>>>"
    ops = "struct<" + ", ".join(f"`{m}` {op}" for m in METHODS) + ">"
    d = js.select("repo", F.col("path").alias("file"), F.from_json("content", f"paths map<string, {ops}>, security array<map<string, array<string>>>").alias("d"))
    p = d.select("repo", "file", F.size(F.coalesce("d.security", F.array())).alias("_g"), F.explode("d.paths").alias("path", "o"))
    each = F.filter(F.array(*[F.when(F.col(f"o.{m}").isNotNull(), F.struct(F.lit(m.upper()).alias("method"), F.col(f"o.{m}.operationId").alias("operation_id"), F.col(f"o.{m}.security").alias("s"))) for m in METHODS]), lambda x: x.isNotNull())
    json_ops = (p.select("repo", "file", "path", "_g", F.explode(each).alias("e"))
                .select("repo", "file", "e.method", "path", "e.operation_id", F.when(F.col("e.s").isNotNull(), F.size("e.s") > 0).otherwise(F.col("_g") > 0).alias("secured")))
    from .files import fill_forward, split_lines
    ya = files.filter(F.col("path").rlike(r"\.ya?ml$") & F.col("content").rlike(r"(?m)^(?:openapi|swagger)\s*:"))
    l = split_lines(ya).filter("trim(text) <> '' AND NOT text RLIKE '^ *#'")
    l = fill_forward(l, F.when(F.col("text").rlike(r"^\w"), F.regexp_extract("text", r"^(\w+)\s*:", 1)), "top").filter("top = 'paths'")
    l = fill_forward(l, F.when(F.col("text").rlike(r"^ {2}['\"]?/"), F.regexp_extract("text", r"^ {2}['\"]?(/[^'\":]*)", 1)), "p")
    mrx = r"^ {4}(" + "|".join(METHODS) + r")\s*:"
    l = fill_forward(l, F.when(F.col("text").rlike(mrx), F.concat_ws(" ", F.regexp_extract("text", mrx, 1), "line")).when(F.col("text").rlike(r"^ {2,4}\S"), F.lit("")), "m").filter("m <> '' AND p IS NOT NULL")
    yaml_ops = (l.groupBy("repo", F.col("path").alias("file"), "m", F.col("p").alias("path")).agg(
        F.max(F.nullif(F.regexp_extract("text", r"^\s+operationId\s*:\s*['\"]?([\w.]+)", 1), F.lit(""))).alias("operation_id"), F.bool_or(F.col("text").rlike(r"^ {6}security\s*:\s*(?:$|\[\s*[^\]\s])")).alias("secured"))
        .select("repo", "file", F.upper(F.split_part("m", F.lit(" "), F.lit(1))).alias("method"), "path", "operation_id", "secured"))
    out = json_ops.unionByName(yaml_ops)
    every = js.select("repo", F.col("path").alias("file")).unionByName(ya.select("repo", F.col("path").alias("file")))
    gaps = every.join(out.select("repo", "file").distinct(), ["repo", "file"], "left_anti").withColumn("kind", F.lit("contract-without-paths"))
    return out, gaps
