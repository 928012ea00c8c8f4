"""Ignore files: parsing, pattern matching, suppression and acknowledgement."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ident import clean_path, embedded_paths
from .textjoin import FEW, contains_join, longest_literal


def read_policy(files: DataFrame, today: Column | None = None):
    """(suppressions, acknowledgements) of ``files(repo, source, content)``.

    A line is a pattern, or ``fingerprint:ID expires:YYYY-MM-DD # reason``. Text after # is a comment."""
    lines = (files.select("repo", "source", F.posexplode(F.split("content", "\r?\n")).alias("_p", "_l"))
             .select("repo", "source", (F.col("_p") + 1).alias("line_no"),
                     F.trim(F.split_part("_l", F.lit("#"), F.lit(1))).alias("body"),
                     F.trim(F.when(F.contains("_l", F.lit("#")), F.regexp_extract("_l", r"#(.*)$", 1)).otherwise("")).alias("reason"))
             .filter("body <> ''"))
    is_ack = F.lower("body").startswith("fingerprint:")
    sup = lines.filter(~is_ack).select("repo", "line_no", F.col("body").alias("pattern"), pattern_kind(F.col("body")).alias("kind"))
    tokens = F.filter(F.split(F.regexp_replace("body", r"(?i)^fingerprint:", ""), r"\s+"), lambda t: t != "")
    acks = (lines.filter(is_ack).withColumn("_t", tokens).filter(F.size("_t") > 0)
            .select("repo", "source", "line_no", F.get("_t", F.lit(0)).alias("fingerprint"), F.size("_t").alias("_n"),
                    F.get("_t", F.lit(1)).alias("_e"), "reason"))
    return sup, ack_state(acks, today)


def ack_state(acks: DataFrame, today: Column | None = None) -> DataFrame:
    """Adds expires DATE and state to parsed acknowledgement lines (columns _n tokens, _e second token)."""
    today = F.current_date() if today is None else today
    text = F.nullif(F.regexp_extract(F.coalesce("_e", F.lit("")), r"^expires:(\d{4}-\d{2}-\d{2})$", 1), F.lit(""))
    good = (F.col("_n") == 2) & text.isNotNull() & F.try_to_date(text).isNotNull()
    expires = F.when(good, F.try_to_date(text))
    state = (F.when(F.col("reason") == "", F.lit("missing-reason"))
             .when(F.col("_n") == 1, F.lit("legacy-no-expiry")).when(~F.coalesce(good, F.lit(False)), F.lit("malformed"))
             .when(expires >= today, F.lit("active")).otherwise(F.lit("expired")))
    return acks.withColumn("expires", expires).withColumn("state", state).drop("_n", "_e")


def latest_ack(acks: DataFrame) -> DataFrame:
    """Last line per fingerprint; an entry of the target tree beats one of the old working folder."""
    order = F.struct((F.col("source") == "target").alias("t"), F.col("line_no"))
    rest = [c for c in acks.columns if c not in ("repo", "fingerprint")]
    return (acks.groupBy("repo", "fingerprint").agg(F.max_by(F.struct(*rest), order).alias("_r"))
            .select("repo", "fingerprint", "_r.*"))


def pattern_kind(pattern: Column) -> Column:
    """category, path (a slash, a glob sign or an extension) or word."""
    p = F.trim(pattern)
    return (F.when(F.lower(p).startswith("category:"), F.lit("category"))
            .when(p.rlike(r"[/*?\[]|\.[A-Za-z0-9_-]{1,10}$"), F.lit("path")).otherwise(F.lit("word")))


def _escape(glob: Column) -> Column:
    """Quote regex signs other than the glob signs * ? [ ]."""
    return F.regexp_replace(glob, r"([.+^${}()|\\])", r"\\$1")


def path_regex(pattern: Column) -> Column:
    """Regular expression of an ignore-style path pattern over a lower-case path.

    Unanchored patterns match at any component; a match of a folder hides what is below it; a final
    slash asks for something below."""
    p = F.lower(F.translate(F.trim(pattern), "\\", "/"))
    anchored = p.startswith("/") & ~F.regexp_replace(p, "^/+", "").startswith("**/")
    body = F.regexp_replace(F.regexp_replace(p, "^/+", ""), r"^(\*\*/)+", "")
    dir_only = body.endswith("/")
    body = F.regexp_replace(body, "/+$", "")
    # Glob signs first become private-use letters so that later steps cannot meet each other's output.
    body = F.regexp_replace(_escape(body), r"\[!", "[^")
    body = F.regexp_replace(F.regexp_replace(body, r"\*+", ".*"), r"\?", ".")
    head = F.when(anchored, F.lit("^/*")).otherwise(F.lit("(?:^|/)"))
    tail = F.when(dir_only, F.lit("/[^/]")).otherwise(F.lit("(?:/|$)"))
    return F.when(body != "", F.concat(head, F.lit("(?:"), body, F.lit(")"), tail))


def legacy_regex(pattern: Column) -> Column:
    """Whole-text glob of the old rule."""
    body = F.regexp_replace(_escape(F.lower(pattern)), r"\[!", "[^")
    body = F.regexp_replace(F.regexp_replace(body, r"\*+", ".*"), r"\?", ".")
    return F.concat(F.lit("^(?s:"), body, F.lit(")$"))


def finding_paths() -> Column:
    """Distinct paths a finding names: its file, paths in parentheses, the location itself."""
    every = F.concat(F.array(F.col("file")), embedded_paths(F.col("location")), F.array(F.col("location")))
    return F.filter(F.array_distinct(F.transform(every, lambda v: clean_path(F.coalesce(v, F.lit(""))))), lambda v: v != "")


def path_literal(pattern: Column) -> Column:
    """What every path that ``path_regex`` accepts contains."""
    return longest_literal(F.lower(F.translate(F.trim(pattern), "\\", "/")), "/")


def matched_paths(paths: DataFrame, patterns: DataFrame, keys, path: str) -> DataFrame:
    """(keys, path, pattern): lower-case paths that a path pattern of the same keys matches. Patterns meet paths by their longest literal."""
    keys = list(keys)
    p = patterns.select(*keys, "pattern", path_regex(F.col("pattern")).alias("_rx"), path_literal(F.col("pattern")).alias("_lit")).filter("_rx IS NOT NULL").distinct()
    near = contains_join(paths, p, keys, path, "_lit")
    return near.join(p, [*keys, "_lit"]).filter(F.rlike(F.col(path), F.col("_rx"))).select(*keys, path, "pattern").distinct()


#: Patterns of a repository up to which each is tried on its findings; more meet the findings by their grams.
EACH = 64


def suppress(findings: DataFrame, suppressions: DataFrame, keep=lambda df: df) -> DataFrame:
    """Adds suppressed, legacy_only and the number of legacy patterns that hit.

    A finding meets the patterns of its repository where it lies, in one pass: a regular expression is tried only where the text holds
    its longest literal. In repositories of very many patterns no pattern is tried on all findings: those of the category are an equi
    join, all others meet the texts that hold their longest literal. That reads the findings several times, after ``keep`` has had them."""
    pats = (suppressions.filter("pattern IS NOT NULL").groupBy("repo", "pattern").agg(F.bool_or(F.coalesce(F.col("kind") == "path", F.lit(False))).alias("_is_path"), F.bool_or(F.coalesce(F.col("kind") == "category", F.lit(False))).alias("_is_cat"))
            .withColumn("_low", F.lower("pattern")).withColumn("_glob", legacy_regex(F.col("pattern"))).withColumn("_lit", longest_literal(F.col("_low")))
            .withColumn("_cat", F.when(F.col("_is_cat"), F.trim(F.split_part("_low", F.lit(":"), F.lit(2)))))
            .withColumn("_rx", F.when(F.col("_is_path"), path_regex(F.col("pattern")))).withColumn("_plit", path_literal(F.col("pattern"))))
    held = pats.groupBy("repo").agg(F.count(F.lit(1)).alias("_n"), F.sum(F.length("pattern") + 1).alias("_c"))
    most, size = held.agg(F.max("_n"), F.sum("_c")).first()
    small = F.broadcast if (size or 0) <= FEW else (lambda df: df)
    if (most or 0) <= EACH:
        return _tried(findings, pats, small)
    many, findings = held.filter(F.col("_n") > EACH).select("repo"), keep(findings)
    few = _tried(findings.join(many, "repo", "left_anti"), pats.join(many, "repo", "left_anti"), small)
    return few.unionByName(_looked_up(findings.join(many, "repo", "left_semi"), pats.join(many, "repo", "left_semi")))


def _shape_text() -> Column:
    return F.lower(F.concat_ws(" ", F.coalesce("category", F.lit("")), F.coalesce("location", F.lit("")), F.coalesce("title", F.lit(""))))


def _tried(findings: DataFrame, pats: DataFrame, small) -> DataFrame:
    """Verdicts by trying the patterns of the repository one after the other."""
    paths = F.when(F.col("_rx").isNotNull(), F.struct("_rx", "_plit"))
    own = pats.groupBy("repo").agg(F.collect_set("_cat").alias("_cats"), F.collect_list(paths).alias("_by_path"), F.collect_list(F.struct("_low", "_lit", "_glob")).alias("_by_text"))
    by_category = F.coalesce(F.array_contains("_cats", F.lower("category")), F.lit(False))
    on_path = F.exists(F.transform(finding_paths(), lambda v: F.lower(v)), lambda v: F.exists("_by_path", lambda p: F.contains(v, p["_plit"]) & F.rlike(v, p["_rx"])))
    by_path = F.when(F.size("_by_path") > 0, on_path).otherwise(F.lit(False))
    # An array of one row, so that its texts are made once and not for each pattern.
    texts = F.array(F.struct(_shape_text().alias("all"), F.lower(F.coalesce("location", F.lit(""))).alias("place")))
    hits = F.transform(texts, lambda t: F.size(F.filter("_by_text", lambda p: F.contains(t["all"], p["_low"]) | F.contains(t["place"], p["_lit"]) & F.rlike(t["place"], p["_glob"]))))
    legacy = F.when(F.col("_by_text").isNotNull(), F.get(hits, F.lit(0))).otherwise(F.lit(0)).cast("bigint")
    legacy_only = ~F.col("_strict") & (F.col("_legacy") > 0)
    return (findings.join(small(own), "repo", "left").withColumn("_strict", by_category | by_path).withColumn("_legacy", legacy)
            .select(*findings.columns, (F.col("_strict") | (F.col("_legacy") > 0)).alias("suppressed"), legacy_only.alias("legacy_only"), F.when(legacy_only, F.col("_legacy")).otherwise(F.lit(0)).alias("legacy_patterns")))


def _looked_up(findings: DataFrame, pats: DataFrame) -> DataFrame:
    """Verdicts by joins. Works on distinct (repo, category, location, file, title) tuples, so copies of a finding are tested once."""
    cols = ["repo", "category", "location", "file", "title"]
    shapes = (findings.select(*cols).distinct().withColumn("_id", F.sha2(F.to_json(F.struct(*cols)), 256)).withColumn("_text", _shape_text())
              .withColumn("_where", F.lower(F.coalesce("location", F.lit("")))).withColumn("_paths", F.transform(finding_paths(), lambda p: F.lower(p))))

    def hits(df, strict):
        return df.select("repo", "_id", "pattern", F.lit(strict).alias("_strict"), F.lit(not strict).alias("_legacy"))
    by_category = shapes.select("repo", "_id", F.lower("category").alias("_cat")).join(pats.filter("_cat IS NOT NULL").select("repo", "_cat", "pattern"), ["repo", "_cat"])
    each = shapes.select("repo", "_id", F.explode("_paths").alias("_path"))
    by_path = each.join(matched_paths(each, pats.filter("_is_path"), ["repo"], "_path"), ["repo", "_path"])
    by_text = shapes.join(contains_join(shapes, pats, ["repo"], "_text", "_low"), ["repo", "_text"]).join(pats.select("repo", "_low", "pattern"), ["repo", "_low"])
    globs = pats.select("repo", "pattern", "_glob", "_lit")
    by_place = (shapes.join(contains_join(shapes, globs, ["repo"], "_where", "_lit"), ["repo", "_where"]).join(globs, ["repo", "_lit"]).filter(F.rlike(F.col("_where"), F.col("_glob"))))
    every = hits(by_category, True).unionByName(hits(by_path, True)).unionByName(hits(by_text, False)).unionByName(hits(by_place, False))
    verdict = (every.groupBy("_id", "pattern").agg(F.bool_or("_strict").alias("_strict"), F.bool_or("_legacy").alias("_legacy"))
               .groupBy("_id").agg(F.bool_or("_strict").alias("_strict"), F.count_if("_legacy").alias("_legacy")))
    legacy_only = F.coalesce(~F.col("_strict"), F.lit(False))
    return (findings.withColumn("_id", F.sha2(F.to_json(F.struct(*cols)), 256)).join(verdict, "_id", "left")
            .select(*findings.columns, F.col("_legacy").isNotNull().alias("suppressed"), legacy_only.alias("legacy_only"), F.when(legacy_only, F.col("_legacy")).otherwise(F.lit(0)).alias("legacy_patterns")))


def replacement_for(kind: Column, pattern: Column) -> Column:
    """Exact line that would hide a finding found only by the old rule (columns category, file)."""
    path, word = clean_path(F.col("file")), F.lower(F.trim(pattern))
    parts, low = F.split(path, "/"), F.split(F.lower(path), "/")
    n, at = F.size(low), F.array_position(low, word)
    cat = F.concat(F.lit("category:"), F.col("category"))
    is_path = (path != "") & ~F.contains(path, F.lit(" "))
    is_word = kind == "word"
    return (F.when(is_word & (word == F.lower("category")), cat)
            .when(is_word & is_path & (at > 0) & (at < n), F.concat(F.element_at(parts, at.cast("int")), F.lit("/")))
            .when(is_word & is_path & (at == n), F.concat(F.lit("**/"), F.element_at(parts, -1)))
            .when(is_word & F.contains(F.lower("category"), word), cat)
            .when(is_path, F.concat(F.lit("/"), path)).when(F.coalesce("category", F.lit("")) != "", cat))


def acknowledge(findings: DataFrame, acks: DataFrame) -> DataFrame:
    """Adds status, ack_reason and reopened_reason.

    By fingerprint, else by an alias that leads to one fingerprint only. Expired, malformed, reasonless
    and ambiguous entries leave the finding open and say so."""
    a = latest_ack(acks).select("repo", F.col("fingerprint").alias("_key"), "state", "reason", "expires")
    pairs = (findings.select("repo", "fingerprint", F.lit(0).alias("_prio"), F.col("fingerprint").alias("_key"))
             .unionByName(findings.select("repo", "fingerprint", F.lit(1).alias("_prio"), F.explode("fingerprint_aliases").alias("_key")))
             .distinct())
    # A key of either kind that names several fingerprints decides nothing, except for its own fingerprint.
    fan = pairs.groupBy("repo", "_key").agg(F.count_distinct("fingerprint").alias("_fan"))
    usable = (F.col("_prio") == 0) | (F.col("_fan") == 1)
    hit = (pairs.join(a, ["repo", "_key"]).join(fan, ["repo", "_key"]).groupBy("repo", "fingerprint")
           .agg(F.min_by(F.when(usable, F.struct("state", "reason")), F.when(usable, F.struct("_prio", "_key"))).alias("_a"), F.bool_or(~usable).alias("_amb")))
    live = F.coalesce(F.col("_a.state").isin("active", "legacy-no-expiry"), F.lit(False))
    why = F.when(F.col("_a").isNotNull() & ~live, F.concat(F.lit("acknowledgement "), F.col("_a.state"))).when(F.col("_a").isNull() & F.col("_amb"), F.lit("acknowledgement ambiguous"))
    return (findings.join(hit, ["repo", "fingerprint"], "left")
            .withColumn("status", F.when(live, F.lit("acknowledged")).otherwise(F.lit("open")))
            .withColumn("ack_reason", F.when(live, F.col("_a.reason"))).withColumn("reopened_reason", why)
            .select(*findings.columns, "status", "ack_reason", "reopened_reason"))


def resolve_ids(requests: DataFrame, findings: DataFrame) -> DataFrame:
    """Which finding does an id name? Adds fingerprint; NULL and a reason where none or several do."""
    keys = (findings.select("repo", "fingerprint", F.explode(
        F.array_distinct(F.concat(F.array("fingerprint"), "fingerprint_aliases"))).alias("id"))
        .groupBy("repo", "id").agg(F.count_distinct("fingerprint").alias("_n"), F.min("fingerprint").alias("fingerprint")))
    return (requests.join(keys, ["repo", "id"], "left")
            .withColumn("outcome", F.when(F.col("_n").isNull(), F.lit("unknown")).when(F.col("_n") > 1, F.lit("ambiguous")).otherwise(F.lit("resolved")))
            .withColumn("fingerprint", F.when(F.col("_n") == 1, F.col("fingerprint"))).drop("_n"))


def ack_expiry_instant(day: Column) -> Column:
    """An entry holds through its last day, so it ends at the next midnight UTC."""
    return F.date_format(F.date_add(day, 1), "yyyy-MM-dd'T00:00:00Z'")
