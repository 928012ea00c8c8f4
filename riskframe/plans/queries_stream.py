"""Streaming and extension queries. Each stream reads a given table as a file stream until it is used up."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import ext
from ..operators.core import scratch_dir
from ..operators.detect import rules as R
from ..streaming import evidence as ev
from .catalog import query
from .queries_detect import pack_sql, rules_sql
from .queries_ledger import W_HI, W_LO, sev


#: Buckets of the streams' state here: few, as the given tables have few keys.
STATE_BUCKETS = 8


def _stream(t, table):
    """Given table as a stream: the folder with a filter on the file name."""
    schema = t.raw(table).schema
    return t.spark.readStream.schema(schema).option("pathGlobFilter", f"{table}.parquet").option("maxFilesPerTrigger", 1).parquet(t.path)


def _run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def _in_batches(t, parts, name):
    """Frames of one schema as a stream with a batch for each, in order."""
    folder = scratch_dir(t.spark, name)
    for part in parts:
        part.coalesce(1).write.mode("append").parquet(folder)
    return t.spark.readStream.schema(parts[0].schema).option("maxFilesPerTrigger", 1).parquet(folder)


def _thirds(df):
    """Three frames that hold all rows between them; a key may occur in each."""
    return [df.filter(F.col("event_id") % 3 == i) for i in range(3)]


@query("m01_evidence_fold", f"""
WITH s AS (SELECT DISTINCT user_id % 300 AS id FROM events WHERE user_id % 300 % 7 <> 0), l AS (SELECT (['xss', 'sqli', 'ssrf'])[id % 3 + 1] AS c, (['HIGH', 'MEDIUM', 'LOW'])[id % 5 % 3 + 1] AS f, id % 4 <> 0 AS r FROM s),
 c0 AS (SELECT 'class_label' AS grp, c || '|' || f AS key, count(*)::DOUBLE AS n, (count(*) FILTER (r))::DOUBLE AS k FROM l GROUP BY 2 UNION ALL SELECT 'label', f, count(*), count(*) FILTER (r) FROM l GROUP BY 2)
SELECT grp, key, n::BIGINT AS n, k::BIGINT AS k, round(k / n, 3) AS p, round({W_LO}, 3) AS ci_lo, round({W_HI}, 3) AS ci_hi FROM c0""")
def _(t):
    i = F.col("user_id") % 300

    def pick(e, *v):
        return F.element_at(F.array(*[F.lit(x) for x in v]), (e + 1).cast("int"))
    parts = [p.select(pick(i % 3, "xss", "sqli", "ssrf").alias("attack_class"), pick(i % 5 % 3, "HIGH", "MEDIUM", "LOW").alias("confidence"), (i % 4 != 0).alias("is_real"),
                      i.cast("string").alias("sample_id"), (i % 7 != 0).alias("evidence_verified")) for p in _thirds(t.events)]
    root = scratch_dir(t.spark, "evidence")
    _run(ev.evidence_fold(_in_batches(t, parts, "evidence-in"), root, STATE_BUCKETS))
    ev.evidence_folding(root, STATE_BUCKETS)(parts[2], 2)  # a batch run again changes nothing
    return ev.evidence_cells(t.spark, root)


@query("m02_feedback_queue", """
SELECT CASE WHEN user_id % 2 = 0 THEN 'stale' ELSE 'pending' END AS state, count(DISTINCT user_id || event_type) AS candidates FROM events WHERE event_id % 3 = 0 GROUP BY 1""")
def _(t):
    parts = [p.select(F.col("ts").alias("recorded"), F.when(F.col("event_id") % 3 == 0, F.lit("false-positive")).otherwise(F.lit("missed")).alias("verdict"), F.lit("r").alias("reason"),
                                    F.col("user_id").cast("string").alias("fingerprint"), F.col("event_type").alias("attack_class"), F.when(F.col("user_id") % 2 == 0, F.lit("old")).otherwise(F.lit("v2")).alias("detector_revision"))
             for p in [t.events.filter(F.floor(F.col("event_id") / 3) % 3 == i) for i in range(3)]]
    root = scratch_dir(t.spark, "feedback")
    _run(ev.feedback_queue(_in_batches(t, parts, "feedback-in"), root, "v2", STATE_BUCKETS))
    ev.feedback_folding(root, "v2", STATE_BUCKETS)(parts[2], 2)
    return t.spark.read.parquet(f"{root}/candidates").groupBy("state").agg(F.count("*").alias("candidates"))


@query("m02_review", """
WITH c AS (SELECT DISTINCT user_id, event_type FROM events WHERE event_id % 3 = 0)
SELECT CASE WHEN user_id % 5 = 0 THEN 'open' WHEN user_id % 2 = 0 THEN 'refused-stale' WHEN user_id % 5 = 1 THEN 'refused-no-reason' WHEN user_id % 5 = 2 THEN 'rejected' ELSE 'accepted' END AS outcome, count(*) AS n FROM c GROUP BY 1""")
def _(t):
    f = t.events.select(F.col("ts").alias("recorded"), F.when(F.col("event_id") % 3 == 0, F.lit("false-positive")).otherwise(F.lit("missed")).alias("verdict"), F.lit("r").alias("reason"), F.col("user_id").cast("string").alias("fingerprint"),
                        F.col("event_type").alias("attack_class"), F.when(F.col("user_id") % 2 == 0, F.lit("old")).otherwise(F.lit("v2")).alias("detector_revision"))
    c = ev.feedback_candidates(f, "v2")
    k = F.col("fingerprint").cast("bigint") % 5
    d = c.filter(k != 0).select("candidate_id", (k != 2).alias("accept"), F.when(k == 1, F.lit("")).otherwise(F.lit("seen in review")).alias("reason"))
    return ev.review(c, d).groupBy("outcome").agg(F.count("*").alias("n"))


# Three batches: one of days 5 to 14, one of days 10 to 19, one of days 0 to 9; each is held against the days before it.
@query("m03_monotone_intel", """
WITH p AS (SELECT 'src' || (s_suppkey % 10) AS source, max(DATE '2024-01-10' + (s_suppkey % 10)::INT) AS pub FROM supplier GROUP BY 1),
 b AS (SELECT event_id % 3 AS batch, 'src' || (user_id % 12) AS source, DATE '2024-01-05' + (event_id % 10 + [0, 5, -5][event_id % 3 + 1])::INT AS feed_date FROM events),
 r0 AS (SELECT b.*, pub FROM b LEFT JOIN p USING (source) WHERE batch = 0), p0 AS (SELECT source, max(d) AS pub FROM (SELECT source, pub AS d FROM p UNION ALL SELECT source, feed_date FROM r0 WHERE pub IS NULL OR feed_date >= pub) GROUP BY 1),
 r1 AS (SELECT b.*, pub FROM b LEFT JOIN p0 USING (source) WHERE batch = 1), p1 AS (SELECT source, max(d) AS pub FROM (SELECT source, pub AS d FROM p0 UNION ALL SELECT source, feed_date FROM r1 WHERE pub IS NULL OR feed_date >= pub) GROUP BY 1),
 r2 AS (SELECT b.*, pub FROM b LEFT JOIN p1 USING (source) WHERE batch = 2)
SELECT source, count(*) FILTER (pub IS NULL OR feed_date >= pub) AS accepted, count(*) FILTER (feed_date < pub) AS rejected FROM (FROM r0 UNION ALL FROM r1 UNION ALL FROM r2) GROUP BY 1""")
def _(t):
    root = scratch_dir(t.spark, "intel")
    seed = t.supplier.select(F.concat(F.lit("src"), F.col("s_suppkey") % 10).alias("source"), F.lit("CVE-2024-00001").alias("cve"), F.lit(0.1).alias("value"), F.date_add(F.lit("2024-01-10").cast("date"), (F.col("s_suppkey") % 10).cast("int")).alias("feed_date"))
    ev.seed_intel(seed, root, STATE_BUCKETS)
    e = F.col("event_id")
    parts = [p.select(F.concat(F.lit("src"), F.col("user_id") % 12).alias("source"), F.lit("CVE-2024-00002").alias("cve"), F.col("value"), F.date_add(F.lit("2024-01-05").cast("date"), (e % 10 + shift).cast("int")).alias("feed_date"))
             for p, shift in zip(_thirds(t.events), (0, 5, -5))]
    _run(ev.monotone_intel(_in_batches(t, parts, "intel-in"), root, STATE_BUCKETS))
    ev.intel_folding(root, STATE_BUCKETS)(parts[2], 2)
    ok = t.spark.read.parquet(f"{root}/published").filter("batch >= 0").groupBy("source").agg(F.count("*").alias("accepted"))
    bad = t.spark.read.parquet(f"{root}/rejected").groupBy("source").agg(F.sum("rows").alias("rejected"))
    return ok.join(bad, "source", "full_outer").na.fill(0)


SEVS = "(['CRITICAL', 'HIGH', 'MEDIUM', 'LOW', 'INFO'])"




def _run_sql(i):
    """CTEs of run 4 + i: its rows b, repos live, joined rows j with events, next state s."""
    return f"""b{i} AS (SELECT DISTINCT 'r' || (user_id % 40) AS repo, 'f' || (event_id % 97) AS fp, {4 + i} AS run, {SEVS}[(event_id % 97 + user_id % 40 + {i}) % 5 + 1] AS severity FROM events WHERE event_id % 4 <> {i}),
 live{i} AS (SELECT repo FROM (SELECT DISTINCT repo FROM b{i}) x WHERE NOT EXISTS (SELECT 1 FROM s{i} s WHERE s.repo = x.repo AND s.run >= {4 + i})), c{i} AS (SELECT b{i}.* FROM b{i} JOIN live{i} USING (repo)),
 j{i} AS (SELECT coalesce(c.repo, s.repo) AS repo, coalesce(c.fp, s.fp) AS fp, c.repo IS NOT NULL AS now, s.run AS srun, coalesce(c.severity, s.severity) AS severity, CASE WHEN c.repo IS NOT NULL THEN 'open' ELSE s.status END AS status, s.seen, coalesce(c.repo, s.repo) IN (SELECT repo FROM live{i}) AS ran,
   CASE WHEN c.repo IS NOT NULL AND s.repo IS NULL THEN 'new' WHEN c.repo IS NOT NULL AND (s.status = 'acknowledged' OR NOT s.seen) THEN 'reopened' WHEN c.repo IS NOT NULL AND {sev('c.severity')} > {sev('s.severity')} THEN 'changed'
   WHEN c.repo IS NOT NULL THEN 'unchanged' WHEN s.repo IN (SELECT repo FROM live{i}) AND s.seen THEN 'no-longer-observed' END AS event FROM c{i} c FULL JOIN s{i} s ON c.repo = s.repo AND c.fp = s.fp),
 s{i + 1} AS (SELECT repo, fp, CASE WHEN ran THEN {4 + i} ELSE srun END AS run, severity, status, now OR (NOT ran AND seen) AS seen FROM j{i})"""


# Runs 4, 5 and 6 of the repos over a known state; three repos already had run 5.
@query("m04_lifecycle_stream", f"""
WITH s0 AS (SELECT DISTINCT 'r' || (c_custkey % 45) AS repo, 'f' || (c_custkey % 110) AS fp, CASE WHEN c_custkey % 45 < 3 THEN 5 ELSE 1 END AS run, {SEVS}[(c_custkey % 110) % 5 + 1] AS severity, CASE WHEN c_custkey % 110 % 4 = 0 THEN 'acknowledged' ELSE 'open' END AS status, c_custkey % 110 % 9 <> 0 AS seen FROM customer),
 {_run_sql(0)}, {_run_sql(1)}, {_run_sql(2)}
SELECT repo, run, event, count(*) AS n FROM (SELECT repo, event, 4::BIGINT AS run FROM j0 UNION ALL SELECT repo, event, 5 FROM j1 UNION ALL SELECT repo, event, 6 FROM j2) WHERE event IS NOT NULL GROUP BY 1, 2, 3""")
def _(t):
    root = scratch_dir(t.spark, "lifecycle")

    def sevs(e):
        return F.element_at(F.array(*[F.lit(x) for x in ("CRITICAL", "HIGH", "MEDIUM", "LOW", "INFO")]), (e % 5 + 1).cast("int"))
    k = F.col("c_custkey")
    ev.lifecycle_state(root, STATE_BUCKETS).put(t.customer.select(F.concat(F.lit("r"), k % 45).alias("repo"), F.concat(F.lit("f"), k % 110).alias("fingerprint"), F.when(k % 45 < 3, 5).otherwise(1).cast("bigint").alias("run"), sevs(k % 110).alias("severity"),
                                                F.when(k % 110 % 4 == 0, F.lit("acknowledged")).otherwise(F.lit("open")).alias("status"), (k % 110 % 9 != 0).alias("seen")).distinct(), -1)
    e, u = F.col("event_id"), F.col("user_id")
    parts = [t.events.filter(e % 4 != i).select(F.concat(F.lit("r"), u % 40).alias("repo"), F.concat(F.lit("f"), e % 97).alias("fingerprint"), F.lit(4 + i).cast("bigint").alias("run"), sevs(e % 97 + u % 40 + i).alias("severity"), F.lit("open").alias("status")) for i in range(3)]
    _run(ev.lifecycle_stream(_in_batches(t, parts, "lifecycle-in"), root, STATE_BUCKETS))
    ev.lifecycle_folding(root, STATE_BUCKETS)(parts[2], 2)
    return t.spark.read.parquet(f"{root}/events").groupBy("repo", "run", "event").agg(F.count("*").alias("n"))


@query("m05_bypass_log", """
WITH l AS (SELECT CASE WHEN event_id % 9 <> 0 THEN 'r' || (user_id % 20) END AS repo, event_id FROM events) SELECT repo, least(count(*), 50) AS kept FROM l GROUP BY 1""")
def _(t):
    root = scratch_dir(t.spark, "bypass")
    lines = _stream(t, "events").select(F.when(F.col("event_id") % 9 == 0, F.lit("{not json")).otherwise(F.to_json(F.struct(F.concat(F.lit("r"), F.col("user_id") % 20).alias("repo"), F.col("ts").alias("recorded"), F.lit("urgent").alias("reason")))).alias("value"))
    _run(ev.parse_log(lines).writeStream.format("parquet").option("path", f"{root}/log").option("checkpointLocation", f"{root}/_checkpoint"))
    return ev.bypass_tail(t.spark.read.parquet(f"{root}/log")).groupBy("repo").agg(F.count("*").alias("kept"))


# Extension points --------------------------------------------------------------------------------

@query("x01_register_pack", f"""
SELECT 'sinks' AS pack, 'completed' AS outcome, count(*) AS findings FROM ({rules_sql("code_files", R.SINKS)}) a UNION ALL SELECT 'crypto', 'completed', count(*) FROM ({pack_sql("code_files", R.CRYPTO)}) b UNION ALL SELECT 'broken', 'error', 0""")
def _(t):
    """Outcome rows of packs; one of them fails on purpose and does not stop the others."""
    from ..operators.detect import engine, packs
    ext.register_pack("sinks", packs.sinks)
    ext.register_pack("crypto", lambda f: engine.file_findings(engine.with_roles(f), R.CRYPTO))
    ext.register_pack("broken", lambda f: f.select("no_such_column"))
    return ext.run_packs(t.code_files, ["sinks", "crypto", "broken"])[1].select("pack", "outcome", "findings")


USER_RULES = [("inline-call", "client-exposure", r"track\([0-9]{1,9}\)", "track(", "INFO"), ("wide-link", "open-redirect", r"href=\"/[a-z]{8,40}\"", "", "LOW")]


@query("x02_rules_from_table", rules_sql("page_texts", [R.Rule(i, c, p, (), s) for i, c, p, _l, s in USER_RULES]))
def _(t):
    values = ", ".join("('{}', '{}', r'{}', '{}', '{}')".format(*r) for r in USER_RULES)
    rules = t.spark.sql(f"SELECT * FROM VALUES {values} AS r(rule_id, attack_class, pattern, literal, severity)")
    return ext.scan_with_table(t.page_texts, rules).select("repo", "path", "line", "rule_id", "severity", "expression", "ordinal")


@query("x03_scan_text", """
SELECT path, line, e AS expression FROM (SELECT path, u.o AS line, u.x FROM code_files, unnest(string_split(content, chr(10))) WITH ORDINALITY AS u(x, o)) l, unnest(regexp_extract_all(x, 'req\\.(?:body|query)\\.\\w+')) AS q(e)""")
def _(t):
    ext.register_functions(t.spark)
    t.code_files.createOrReplaceTempView("riskframe_code")
    return t.spark.sql(r"SELECT path, s.line, s.expression FROM riskframe_code, LATERAL scan_text(content, r'req\.(?:body|query)\.\w+') AS s")


@query("x04_wilson_aggregate", f"""
WITH c AS (SELECT attack_class, count(is_real)::DOUBLE AS n, (count(*) FILTER (is_real))::DOUBLE AS k FROM finding_labels GROUP BY 1)
SELECT attack_class, n::BIGINT AS n, k::BIGINT AS k, round(k / n, 3) AS p, round({W_LO}, 3) AS ci_lo, round({W_HI}, 3) AS ci_hi FROM c""")
def _(t):
    return ext.wilson_by(t.finding_labels, ["attack_class"], "is_real")
