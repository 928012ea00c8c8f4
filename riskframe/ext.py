"""User extension points: detector packs, rule tables, a table function, an aggregate."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from .functions.stats import wilson
from .operators.core import scratch_dir
from .operators.detect.engine import Rule, scan_rules

PACKS: dict = {}
MAX_RULES = 500


def register_pack(name: str, fn) -> None:
    """Add a detector: a function of files(repo, path, content) that returns a DataFrame."""
    PACKS[name] = fn


def run_packs(files: DataFrame, names=None, path: str | None = None):
    """({name: DataFrame}, outcomes). A pack that fails becomes an error row; the others still run.

    Each pack runs once: its rows are written as Parquet under ``path`` (a fresh folder beside the checkpoints by
    default), counted by an observation of that write, and read from there."""
    spark = files.sparkSession
    path = path or scratch_dir(spark, "packs")
    out, rows = {}, []
    for i, name in enumerate(names or sorted(PACKS)):
        try:
            seen, folder = Observation(f"pack-{uuid.uuid4().hex}"), f"{path}/pack={i}"
            df = PACKS[name](files)
            df.observe(seen, F.count(F.lit(1)).alias("n")).write.parquet(folder)
            rows.append((name, "completed", int(seen.get["n"]), None))
            out[name] = spark.read.schema(df.schema).parquet(folder)
        except Exception as e:
            rows.append((name, "error", 0, f"{type(e).__name__}: {(str(e).splitlines() or [""])[0][:200]}"))
    schema = "pack string, outcome string, findings bigint, detail string"
    return out, spark.createDataFrame(rows, schema)


def rules_from_table(rules: DataFrame) -> list:
    """Rule objects of ``rules(rule_id, attack_class, pattern, literal, severity)``.

    A rule table is written by people; one over MAX_RULES rows is refused rather than truncated."""
    rows = rules.select("rule_id", "attack_class", "pattern", "literal", "severity").orderBy("rule_id").take(MAX_RULES + 1)
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules; split the table into packs")
    if len({r.rule_id for r in rows}) < len(rows):
        raise ValueError("rule ids must be unique")
    for r in rows:
        if not r.pattern or not r.attack_class or r.severity not in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO"):
            raise ValueError(f"rule {r.rule_id} is incomplete")
    return [Rule(r.rule_id, r.attack_class, r.pattern, (r.literal,) if r.literal else (), r.severity) for r in rows]


def scan_with_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    return scan_rules(files, rules_from_table(rules))


@udtf(returnType="line int, expression string")
class ScanText:
    """scan_text(content, pattern): matches that Java's regular expressions cannot state, line by line."""

    def eval(self, content: str, pattern: str):
        import regex
        rx = regex.compile(pattern)
        for i, line in enumerate((content or "").split("\n"), 1):
            for m in rx.finditer(line):
                yield i, m.group(0)


def register_functions(spark) -> None:
    spark.udtf.register("scan_text", ScanText)


def wilson_by(df: DataFrame, keys, flag: str) -> DataFrame:
    """Wilson cells of a nullable boolean per key."""
    return df.groupBy(*keys).agg(wilson(F.col(flag)).alias("w")).select(*keys, "w.*")
