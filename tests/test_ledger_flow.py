"""Steps of ledger_end_to_end: patterns are tried where the findings lie, texts are split only where a rule matches."""

import random

import pytest
from riskframe.operators import findings as fnd
from riskframe.operators import policy
from riskframe.operators.core import cut_lineage
from riskframe.operators.detect import engine

FINDING = "repo string, category string, location string, file string, title string, n int"
VERDICT = ["suppressed", "legacy_only", "legacy_patterns"]


def _odd_findings(spark):
    rnd = random.Random(3)
    files = ["src/app/a.js", "tests/t.py", "a/tests/x.md", "docs/r.md", "infra/m.tf", "contests/x.py", "", None]
    rows = []
    for n in range(300):
        f = rnd.choice(files)
        place = rnd.choice([f"{f}:{n}" if f else f, f, f"see (docs/r.md) near {n}", "login", None])
        rows.append((rnd.choice(["r0", "r1", "r2", "hot", "none", None]), rnd.choice(["sca", "Secret", "sast", "", None]), place, f, rnd.choice(["issue 7", "LOGIN form", "", None]), n))
    return spark.createDataFrame(rows + rows[:40], FINDING)


def _patterns(spark):
    some = ["tests/", "category:sca", "*.md", "issue 7", "/src/app", "login", "category:Secret", "/infra/*.tf", "docs/**", "x?z.py", "contests/", "category:", "[!a]*.py", "*"]
    rows = [(r, p, k) for i, r in enumerate(["r0", "r1", "hot", None]) for p, k in [(p, "category" if p.startswith("category:") else "word" if p in ("login", "issue 7") else "path") for p in some[i::3] + some[:2]]]
    rows += [("hot", f"dir{i}/", "path") for i in range(policy.EACH)] + [("r0", "login", "path"), ("r0", "login", None), ("r0", None, "path"), ("r2", "see", "word"), ("r2", "near", "word")] + rows[:5]
    return spark.createDataFrame(rows, "repo string, pattern string, kind string")


@pytest.mark.parametrize("few", [policy.FEW, 0])
def test_suppress_tries_patterns_with_the_results_of_the_joins(spark, monkeypatch, few):
    f, p = _odd_findings(spark), _patterns(spark)
    monkeypatch.setattr(policy, "FEW", few)
    kept = []

    def rows(df):
        return sorted(map(str, df.select(*f.columns, *VERDICT).collect()))
    mixed = rows(policy.suppress(f, p, lambda df: kept.append(1) or df))
    assert kept == [1]  # one repository has more patterns than are tried on each finding
    tried = rows(policy.suppress(f, p.filter("repo <> 'hot' OR repo IS NULL OR pattern NOT LIKE 'dir%'"), lambda df: kept.append(1) or df))
    assert kept == [1] and tried == mixed
    monkeypatch.setattr(policy, "EACH", 0)
    assert rows(policy.suppress(f, p)) == mixed
    got = [r.split("suppressed=")[1].rstrip(")") for r in mixed]
    assert len(got) == 340 and len(set(got)) > 3


def test_suppress_reads_its_findings_once(spark):
    f, p = _odd_findings(spark), _patterns(spark).filter("repo = 'r0'")
    out = policy.suppress(cut_lineage(f), p)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert sum("title#" in line and "LogicalRDD" in line for line in plan.splitlines()) == 1
    assert "Generate" not in plan.split("_by_text")[0] and "sha2" not in plan


def test_suppress_without_patterns(spark):
    f = _odd_findings(spark)
    assert {tuple(r) for r in policy.suppress(f, _patterns(spark).limit(0)).select(*VERDICT).collect()} == {(False, False, 0)}


def test_a_tier_is_looked_for_once_a_row(spark):
    rows = [("secret", "k", "t", "docs/readme.md", "q7Zp-91xK-lm22", "HIGH"), ("secret", "k", "t", "src/a.js", "changeme-please", "LOW"), ("secret", "k", "t", "src/.env.example", "q7Zp-91xK-lm22", "LOW"),
            ("sast", "k", "t", "docs/a.md", None, "HIGH"), (None, "api-key", None, "docs/a.md", None, "MEDIUM"), (None, None, None, None, None, None), ("secret", None, None, None, "aaaaaaaa", "INFO")]
    got = fnd.placeholder_demote(spark.createDataFrame(rows, "category string, key string, title string, file string, secret string, severity string"))
    assert got.columns == ["category", "key", "title", "file", "secret", "severity", "placeholder_tier"]
    assert [(r.severity, r.placeholder_tier) for r in got.collect()] == [("LOW", "doc-file"), ("INFO", "doc-file"), ("LOW", None), ("HIGH", None), ("LOW", "doc-file"), (None, None), ("INFO", None)]
    plan = got.drop("placeholder_tier")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("changelog") == 1  # the pattern of documentation


def test_a_text_is_split_only_where_a_rule_matches(spark):
    rules = [engine.Rule("r", "c", r"ab+", ("a",)), engine.Rule("any", "c", r"(?<=x)y|z\n?")]
    files = spark.createDataFrame([("p", "1", "ab\nabb\n\nxab"), ("p", "2", "aaa"), ("p", "3", "xy\nz\nz"), ("p", "4", ""), ("p", "5", None)], "repo string, path string, content string")
    out = engine.scan_rules(files, rules)
    assert sorted(tuple(r) for r in out.select("path", "rule_id", "line", "expression", "ordinal").collect()) == [
        ("1", "r", 1, "ab", 0), ("1", "r", 2, "abb", 0), ("1", "r", 4, "ab", 1), ("3", "any", 1, "y", 0), ("3", "any", 2, "z\n", 0), ("3", "any", 3, "z", 0)]
    found = out._jdf.queryExecution().optimizedPlan().toString().split(" split(")
    assert len(found) > 1 and all("filter(array(regexp_extract_all(" in x for x in found[:-1])
