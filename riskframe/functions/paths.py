"""Predicates over repository paths and placeholder values."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Path patterns of the file roles. All are matched without case.
TEST_PATH = (
    r"(?:^|/)(?:tests?|__tests__|__mocks__|spec|specs|e2e|cypress|fixtures?|mocks?|stories|testdata|testing)/"
    r"|\.(?:test|spec|stories|e2e|cy)\.[cm]?[jt]sx?$"
    r"|(?:^|/)test_[^/]*\.py$|(?:^|/)[^/]*_test\.py$|(?:^|/)conftest\.py$"
    r"|(?:^|/)[\w.-]*\.config\.[cm]?[jt]sx?$"
    r"|(?:^|/)(?:playwright|vitest|jest|cypress)\.[\w.]*$")
SCRIPT_PATH = (
    r"(?:^|/)(?:scripts?|bin|\.bin|ops|operations|migrations?|seeds?|tools?|tooling|research|"
    r"examples?|samples?|benchmarks?|notebooks?|codemods?|generators?|datagen|[\w-]*backtests?)/")
CLIENT_PATH = r"\.(?:tsx|jsx)$|(?:^|/)(?:components?|hooks?|contexts?|widgets?|ui)/"
NEVER_DOC = r"/\.github/workflows/|/requirements|/pipfile|/poetry\.lock"
DOC_PATH = (
    r"\.(?:md|mdx|markdown|rst|txt|adoc)$"
    r"|/(?:docs|doc|examples|example|samples|sample|\.github)/"
    r"|/(?:readme|changelog|contributing|license|authors|history|notice)[^/]*$")
EXAMPLE_NAME = r"\.(?:example|sample|dist|template|tmpl)[^/]*$"
PRODUCT_LOOKALIKE = r"(?:^|/)(?:testimonial|testament|contest|latest|protest)[\w-]*/"

# Words and shapes that announce a made-up secret.
PLACEHOLDER_WORDS = (
    r"your[-_]?(?:api|key|token|secret|password|value|here)|replace[-_]?me|changeme|change[-_]me|"
    r"placeholder|example[-_]?(?:key|token|secret|value)|dummy|fake[-_]?(?:key|token|secret)|"
    r"insert[-_]?(?:key|token|here)|todo|xxx+|<[^>]{2,40}>|\.\.\.|s3cr3t|notarealkey|"
    r"abcdef(?:0123|ghij)|deadbeef|0123456789abcdef")


def norm(path: Column) -> Column:
    return F.translate(F.coalesce(path, F.lit("")), "\\", "/")


def rooted(path: Column) -> Column:
    """Lower-cased path that starts with exactly one slash."""
    return F.concat(F.lit("/"), F.regexp_replace(F.lower(norm(path)), "^/+", ""))


def is_test_file(path: Column) -> Column:
    return norm(path).rlike("(?i)" + TEST_PATH)


def is_script_file(path: Column) -> Column:
    return norm(path).rlike("(?i)" + SCRIPT_PATH)


def is_client_file(path: Column, content: Column | None = None) -> Column:
    by_path = norm(path).rlike("(?i)" + CLIENT_PATH)
    if content is None:
        return by_path
    head = F.substring(F.coalesce(content, F.lit("")), 1, 300)
    return by_path | head.contains("'use client'") | head.contains('"use client"')


def is_example_file(path: Column) -> Column:
    return rooted(path).rlike(EXAMPLE_NAME)


def is_doc_file(path: Column) -> Column:
    """Documentation or template file. Workflows, requirements and lock files never are."""
    return ~rooted(path).rlike(NEVER_DOC) & (rooted(path).rlike(DOC_PATH) | is_example_file(path))


def placeholder_value(value: Column) -> Column:
    """The value itself says it is made up: six equal characters in a row, or a fill-me-in word."""
    v = F.trim(F.coalesce(value, F.lit("")))
    return (F.length(v) >= 4) & (v.rlike(r"(.)\1{5,}") | v.rlike("(?i)" + PLACEHOLDER_WORDS))


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(basename(path), r"(\.[A-Za-z0-9]{1,10})$", 1))


def ancestors(path: Column) -> Column:
    """Every whole-component prefix of a path, itself included: a/b/c gives a, a/b, a/b/c."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "/"))


def suffixes(path: Column) -> Column:
    """Every whole-component suffix of a path, itself included: a/b/c gives a/b/c, b/c, c."""
    parts = F.split(path, "/")
    n = F.size(parts)
    return F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(parts, i, n), "/"))
