"""Scanning of file texts by rule tables.

The unit of work is one file: a text is read once, each rule is tried only if one of its literals
occurs, and only the matches leave the projection. No join multiplies files by rules."""

from __future__ import annotations

import re
import re._constants as sre
import re._parser as sre_parser
import warnings
from dataclasses import dataclass, field
from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from ...functions import paths
from ...functions.ident import sha

HIT = "struct<rule_id:string,attack_class:string,severity:string,i:int,expression:string,before:int,inside:int>"


@dataclass(frozen=True)
class Rule:
    """One pattern. ``literals``: at least one must occur in the text for the pattern to be tried.

    ``exclude`` drops a match whose expression matches it. ``suffixes`` limits the files. ``where``
    names a boolean column of the prepared files that must hold."""

    rule_id: str
    attack_class: str
    pattern: str
    literals: tuple = ()
    severity: str = "MEDIUM"
    exclude: str = ""
    suffixes: tuple = ()
    where: str = ""
    gate: str = ""
    extra: dict = field(default_factory=dict, hash=False, compare=False)


def newlines(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit("")))


def has_any(text: Column, literals) -> Column:
    out = None
    for word in literals:
        c = F.contains(text, F.lit(word))
        out = c if out is None else out | c
    return F.lit(True) if out is None else out


@cache
def needed(pattern: str) -> tuple:
    """Lower-case strings one of which is in the lower-cased text of every match; empty where the pattern names none.

    Only ASCII letters count: those are what (?i) folds in Java. What Python's parser reads otherwise than Java (classes
    within classes) or not at all has none."""
    inside = False
    for c in _unescaped(pattern):
        if inside and c in "[&":
            return ()
        inside = c == "[" or inside and c != "]"

    def of(items) -> tuple:
        best, run = (), ""
        for op, arg in [*items, (None, None)]:
            if op is sre.LITERAL and arg < 128:
                run += chr(arg).lower()
                continue
            found, run = [(run,)], ""
            if op is sre.BRANCH:
                ways = [of(way) for way in arg[1]]
                found.append(tuple(dict.fromkeys(w for way in ways for w in way)) if all(ways) else ())
            elif op is sre.SUBPATTERN:
                found.append(of(arg[3]))
            elif op in (sre.MAX_REPEAT, sre.MIN_REPEAT, sre.POSSESSIVE_REPEAT) and arg[0]:
                found.append(of(arg[2]))
            elif op is sre.ATOMIC_GROUP:
                found.append(of(arg))
            best = max([best, *found], key=lambda words: (min((min(len(w), 6) for w in words), default=0), -len(words)))
        return best if best and min(map(len, best)) > 1 else ()
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("error")
            return of(sre_parser.parse(pattern))
    except (re.error, Warning, OverflowError):
        return ()


def _unescaped(pattern: str) -> str:
    """The pattern without its escaped characters."""
    out, at = [], 0
    while at < len(pattern):
        if pattern[at] == "\\":
            at += 2
        else:
            out.append(pattern[at])
            at += 1
    return "".join(out)


def found_in(pattern: str, low: str = "_low") -> Column:
    """Whether a pattern matches ``content``; it is tried only where ``low``, the lower-cased text, holds a string that it needs."""
    words, matched = needed(pattern), F.col("content").rlike(pattern)
    return has_any(F.col(low), words) & matched if words else matched


def matches(text: Column, pattern: str) -> Column:
    """Array of struct(hits, gaps): each match with the text between it and the match before."""
    return F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hits"),
                        F.split(text, pattern, -1).alias("gaps"))


def _rule_hits(text: Column, rule: Rule, shared: dict) -> Column:
    def row(e, i):
        return F.struct(F.lit(rule.rule_id).alias("rule_id"), F.lit(rule.attack_class).alias("attack_class"),
                        F.lit(rule.severity).alias("severity"), i.cast("int").alias("i"), e["hits"].alias("expression"),
                        newlines(e["gaps"]).alias("before"), newlines(e["hits"]).alias("inside"))
    cond = F.lit(True)
    if rule.literals:
        cond = None
        for word in rule.literals:
            c = F.col(shared[word]) if word in shared else F.contains(text, F.lit(word))
            cond = c if cond is None else cond | c
    if rule.suffixes:
        ends = None
        for sfx in rule.suffixes:
            c = F.endswith("path", F.lit(sfx))
            ends = c if ends is None else ends | c
        cond = ends & cond
    if rule.where:
        cond = F.col(rule.where) & cond
    # The text is split only where the pattern matches.
    hits = F.filter(F.array(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))), lambda h: F.size(h) > 0)
    found = F.flatten(F.transform(hits, lambda h: F.filter(F.transform(F.arrays_zip(h.alias("hits"), F.split(text, rule.pattern, -1).alias("gaps")), row), lambda x: x["expression"].isNotNull())))
    return F.when(cond, found).otherwise(F.array().cast(f"array<{HIT}>"))


def with_roles(files: DataFrame) -> DataFrame:
    """Adds the file-role flags that rules refer to."""
    p = F.col("path")
    return (files.withColumn("is_test", paths.is_test_file(p)).withColumn("is_script", paths.is_script_file(p))
            .withColumn("is_client", paths.is_client_file(p, F.col("content"))).withColumn("is_doc", paths.is_doc_file(p))
            .withColumn("is_example", paths.is_example_file(p))
            .withColumn("not_test", ~F.col("is_test"))
            .withColumn("is_server", ~(F.col("is_test") | F.col("is_script") | F.col("is_client"))))


def scan_rules(files: DataFrame, rules, carry: dict | None = None) -> DataFrame:
    """occurrences(repo, path, line, rule_id, attack_class, severity, expression, ordinal, semantic_id).

    ``files(repo, path, content)`` plus any flag columns the rules use. The line is counted from the
    text between matches; ordinal counts equal expressions of a rule within the file. Both windows run
    inside one file, over matches only, and share one shuffle. ``carry`` adds columns computed from a
    file with matches in the same pass. A literal of several rules is searched once per file."""
    text, carry = F.col("content"), carry or {}
    used = [w for r in rules for w in set(r.literals)]
    shared = {w: f"_l{i}" for i, w in enumerate(sorted({w for w in used if used.count(w) > 1}))}
    flagged = files.select("*", *[F.contains(text, F.lit(w)).alias(n) for w, n in shared.items()])
    found = flagged.select("repo", "path", "content", F.flatten(F.array(*[_rule_hits(text, r, shared) for r in rules])).alias("_h"))
    # An inner explode would make Spark infer a filter on the array and evaluate it again for that filter.
    hits = found.select("repo", "path", *[F.when(F.size("_h") > 0, e).alias(n) for n, e in carry.items()], F.explode_outer("_h").alias("h")).filter("h IS NOT NULL").select("repo", "path", *carry, "h.*")
    by_rule = W.partitionBy("repo", "path", "rule_id").orderBy("i")
    upto = by_rule.rowsBetween(W.unboundedPreceding, W.currentRow)
    same = W.partitionBy("repo", "path", "rule_id", "expression").orderBy("i")
    # Hashing by file alone satisfies both windows, so the second one needs no shuffle of its own.
    out = (hits.repartition("repo", "path")
           .withColumn("line", (1 + F.sum(F.col("before") + F.col("inside")).over(upto) - F.col("inside")).cast("int"))
           .withColumn("ordinal", (F.row_number().over(same) - 1).cast("int")))
    for r in rules:
        if r.exclude:
            out = out.filter(~((F.col("rule_id") == r.rule_id) & F.col("expression").rlike(r.exclude)))
    ident = F.concat_ws(":", "attack_class", sha(F.regexp_replace("expression", r"\s+", "")), F.col("ordinal").cast("string"))
    return out.select("repo", "path", "line", "rule_id", "attack_class", "severity", "expression", "ordinal", ident.alias("semantic_id"), *carry)


def flag_table(files: DataFrame, flags: dict, keep=()) -> DataFrame:
    """One row per file with a boolean column per named pattern. Texts do not leave the projection."""
    low = files.withColumn("_low", F.lower("content"))
    return low.select("repo", "path", *keep, *[found_in(p).alias(n) for n, p in flags.items()])


def file_findings(files: DataFrame, pack: dict) -> DataFrame:
    """Findings of a pack whose rules are conditions over flags of one file.

    pack: {"flags": {name: pattern}, "keep": [role columns], "findings": [(kind, class, severity, condition)]}"""
    f = flag_table(files, pack["flags"], pack.get("keep", ()))
    # In a projection of their own conditions take in flags that are used once, which are then tried only where a condition comes to them.
    found = f.select("repo", "path", _conditions(pack).alias("_x"))
    # As in scan_rules: an inner explode would evaluate the array once more for a filter.
    return found.select("repo", "path", F.explode_outer("_x").alias("x")).filter("x IS NOT NULL").select("repo", "path", "x.*")


def repo_findings(files: DataFrame, pack: dict) -> DataFrame:
    """Findings of a pack whose rules look at the flags of all files of a repo together.

    ``derive`` turns file flags into file conditions; they are then OR-ed per repo (partial
    aggregation, so repo size does not matter) and the rules are evaluated once per repo."""
    f = flag_table(files, pack["flags"], pack.get("keep", ()))
    derived = pack.get("derive") or {n: n for n in pack["flags"]}
    g = f.groupBy("repo").agg(*[F.coalesce(F.bool_or(F.expr(e)), F.lit(False)).alias(n) for n, e in derived.items()])
    return g.select("repo", F.explode(_conditions(pack)).alias("x")).select("repo", "x.*")


ROLES = ["is_test", "is_script", "is_client", "is_doc", "is_example", "not_test", "is_server"]


def _of_family(pack: dict, name: str) -> Column:
    return F.transform(_conditions(pack), lambda x: F.struct(F.lit(name).alias("family"), x["kind"].alias("kind"), x["attack_class"].alias("attack_class"), x["severity"].alias("severity")))


def all_file_findings(files: DataFrame, packs: dict) -> DataFrame:
    """file_findings of several packs, {name: pack}, in one pass over the texts, with the column ``family``.

    Flags live from their own pack to the next, so equal names do not clash; only findings leave the projection."""
    fixed, found = ["repo", "path", "content", "_low", *ROLES], []
    df = with_roles(files).withColumn("_low", F.lower("content")).select(*fixed)
    for i, (name, pack) in enumerate(packs.items()):
        df = df.select(*fixed, *found, *[found_in(p).alias(n) for n, p in pack["flags"].items()])
        df = df.select(*fixed, *found, _of_family(pack, name).alias(f"_f{i}"))
        found.append(f"_f{i}")
    # As in scan_rules: an inner explode would evaluate the array once more for a filter.
    return df.select("repo", "path", F.explode_outer(F.concat(*found)).alias("x")).filter("x IS NOT NULL").select("repo", "path", "x.*")


def all_repo_findings(files: DataFrame, packs: dict) -> DataFrame:
    """repo_findings of several packs, {name: pack}, in one pass over the texts and one aggregation, with the column ``family``."""
    fixed, found = ["repo", "content", "_low", *ROLES], []
    df = with_roles(files).withColumn("_low", F.lower("content")).select(*fixed)
    held = {}
    for i, (name, pack) in enumerate(packs.items()):
        derived = pack.get("derive") or {n: n for n in pack["flags"]}
        held[name] = {n: f"_p{i}_{n}" for n in derived}
        df = df.select(*fixed, *found, *[found_in(p).alias(n) for n, p in pack["flags"].items()])
        df = df.select(*fixed, *found, *[F.expr(e).alias(held[name][n]) for n, e in derived.items()])
        found += held[name].values()
    g = df.groupBy("repo").agg(*[F.coalesce(F.bool_or(c), F.lit(False)).alias(c) for c in found])
    parts, arrays = g, []
    for i, (name, pack) in enumerate(packs.items()):
        parts = parts.select("repo", *found, *arrays, *[F.col(c).alias(n) for n, c in held[name].items()])
        parts = parts.select("repo", *found, *arrays, _of_family(pack, name).alias(f"_f{i}"))
        arrays.append(f"_f{i}")
    return parts.select("repo", F.explode_outer(F.concat(*arrays)).alias("x")).filter("x IS NOT NULL").select("repo", "x.*")


def _conditions(pack: dict) -> Column:
    rows = [F.when(F.expr(cond), F.struct(F.lit(kind).alias("kind"), F.lit(cls).alias("attack_class"), F.lit(sev).alias("severity")))
            for kind, cls, sev, cond in pack["findings"]]
    return F.filter(F.array(*rows), lambda r: r.isNotNull())


# Comments and literals of the comment styles. A slash begins a regular expression only where no value can end before it;
# "//" after a colon is part of an address in markup text.
REGEX_LITERAL = r"(?<=[=(,:\[!&|?{};+\n>]|return|typeof|case)[ \t]*+/(?![*/])(?:[^/\\\[\n]|\\.|\[(?:[^\]\\\n]|\\.)*+\])++/[a-z]*+"
TEMPLATE = (r"`(?:[^`\\$]|\\.|\$(?!\{)|\$\{(?:[^{}`'\"]|'[^'\n]*+'|\"[^\"\n]*+\"|`(?:[^`\\$]|\\.|\$(?!\{)|\$\{[^{}`]*+\})*+`|\{[^{}]*+\})*+\})*+`")
C_STYLE = (r"\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|" + TEMPLATE + "|" + REGEX_LITERAL
           + r"|(?<!:)//[^\n]*|/\*(?:[^*]|\*(?!/))*+\*/|<!--(?:[^-]|-(?!->))*+-->")
HASH_STYLE = (r"\"\"\"(?:[^\"]|\"(?!\"\"))*+\"\"\"|'''(?:[^']|'(?!''))*+'''|\"[^\"\\\n]*+(?:\\.[^\"\\\n]*+)*+\""
              r"|'[^'\\\n]*+(?:\\.[^'\\\n]*+)*+'|#[^\n]*")
# In shells, YAML and Ruby a sign inside a word is no comment.
SHELL_STYLE = r"\"[^\"\\]*+(?:\\.[^\"\\]*+)*+\"|'[^'\n]*+'|(?<![^\s;])#[^\n]*"
SHELL_FILES = r"\.(?:rb|sh|bash|ya?ml|toml|tf)$|(?:^|/)Dockerfile[^/]*$"
QUOTED_MARKUP = r"(?is)<(pre|code)\b[^>]*+>.*?</\1\s*>"


def _masked(text: Column, pattern: str, comment: str) -> Column:
    def piece(e):
        hit = F.coalesce(e["hits"], F.lit(""))
        return F.concat(F.coalesce(e["gaps"], F.lit("")), F.when(hit.rlike(comment), F.regexp_replace(hit, r"[^\n]", " ")).otherwise(hit))
    return F.array_join(F.transform(matches(text, pattern), piece), "")


def mask_comments(files: DataFrame) -> DataFrame:
    """Adds ``code``: the text with comments blanked out, same length, same lines. Strings, templates and regular expressions stay.

    In markup files the bodies of <pre> and <code> elements, which show code instead of being it, are blanked out too."""
    markup = F.col("path").rlike(r"\.(?:html?|vue|svelte|mdx?)$") & F.col("content").rlike(r"(?i)<(?:pre|code)\b")
    text = F.when(markup, _masked(F.col("content"), QUOTED_MARKUP, "^<")).otherwise(F.col("content"))
    py, shell = F.endswith("path", F.lit(".py")), F.col("path").rlike(SHELL_FILES)
    code = (F.when(py & F.contains(text, F.lit("#")), _masked(text, HASH_STYLE, "^#"))
            .when(shell, F.when(F.contains(text, F.lit("#")), _masked(text, SHELL_STYLE, "^#")).otherwise(text))
            .when(~py & (F.contains(text, F.lit("//")) | F.contains(text, F.lit("/*")) | F.contains(text, F.lit("<!--"))),
                  _masked(text, C_STYLE, r"^(?://|/\*|<!--)")).otherwise(text))
    return files.withColumn("code", code)


def is_vendored(path: Column, content: Column) -> Column:
    """Minified names, a licence banner with version or copyright, or one long dense line."""
    head = F.substring(content, 1, 4096)
    banner = head.rlike(r"^\s*/\*!") & head.rlike(r"(?i)\bv?\d+\.\d+\.\d+\b|copyright|\(c\)")
    dense = F.exists(F.split(content, "\n"), lambda l: (F.length(l) > 1000)
                     & (F.length(F.regexp_replace(l, r"\s", "")) / F.length(l) > 0.9))
    return path.rlike(r"\.min\.js$") | banner | ((F.length(content) > 1000) & dense)
