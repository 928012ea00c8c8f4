"""Readers on files, streams over several batches, extension points."""

import gzip
import json
import os

import pytest
from pyspark.sql import functions as F
from riskframe import ext
from riskframe.operators import export as ex
from riskframe.operators import lifecycle as life
from riskframe.sources import intel
from riskframe.sources.reports import read_scan_reports
from riskframe.sources.tree import read_source_tree
from riskframe.streaming import evidence as ev
from riskframe.streaming.state import KeyedState


def put(path, text):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "w") as f:
        f.write(text)


def test_tree_reads_hidden_files(spark, tmp_path):
    put(f"{tmp_path}/app/.env", "A=1")
    put(f"{tmp_path}/app/.github/workflows/x.yml", "on: push")
    put(f"{tmp_path}/app/pkg/__init__.py", "")
    put(f"{tmp_path}/app/big.js", "x" * 3_000_000)
    rows = {r.path: r for r in read_source_tree(spark, [f"{tmp_path}/app"]).collect()}
    assert set(rows) == {".env", ".github/workflows/x.yml", "pkg/__init__.py", "big.js"}
    assert rows["big.js"].read_status == "oversized" and rows[".env"].content == "A=1" and rows[".env"].repo == "app" and len(rows[".env"].sha256) == 64


def test_reports_on_disk(spark, tmp_path):
    put(f"{tmp_path}/r1/s1/semgrep.json", '{"results": []}')
    put(f"{tmp_path}/r1/s1/trivy.json", '{"Results": [')
    assert {r.tool: (r.repo, r.snapshot, r.status) for r in read_scan_reports(spark, str(tmp_path)).collect()} == {"semgrep": ("r1", "s1", "ok"), "trivy": ("r1", "s1", "parse_failed")}


def test_epss_file(spark, tmp_path):
    today = F.lit("2025-06-01").cast("date")
    with gzip.open(f"{tmp_path}/e.csv.gz", "wt") as f:
        f.write("#model_version:v2025.03.14,score_date:2025-05-01T00:00:00+0000\ncve,epss,percentile\nCVE-2024-0001,0.5,0.9\n")
    assert intel.read_epss_csv(spark, f"{tmp_path}/e.csv.gz", today).first().epss == 0.5
    put(f"{tmp_path}/b/bad.csv", "#model_version:v2025.03.14,score_date:2025-05-01\ncve,epss,percentile\nCVE-2024-0001,1.5,0.9\n")
    with pytest.raises(intel.FeedError):
        intel.read_epss_csv(spark, f"{tmp_path}/b/bad.csv", today)


def test_kev_file(spark, tmp_path):
    today = F.lit("2025-06-01").cast("date")
    doc = {"catalogVersion": "1", "dateReleased": "2025-01-01T00:00:00Z", "count": 1, "vulnerabilities": [{"cveID": "CVE-2024-0001", "dateAdded": "2024-02-02"}]}
    put(f"{tmp_path}/ok.json", json.dumps(doc))
    assert intel.read_kev_json(spark, f"{tmp_path}/ok.json", today).count() == 1
    put(f"{tmp_path}/bad.json", json.dumps({**doc, "count": 2}))
    with pytest.raises(intel.FeedError):
        intel.read_kev_json(spark, f"{tmp_path}/bad.json", today)


def test_sarif_and_envelope_files(spark, tmp_path):
    f = life.annotate(spark.createDataFrame([("r", 1, "xss", "sast", "(headers)", "", 0, "t", "HIGH", "LOW", "acknowledged"), ("r", 2, "xss", "sast", "a.js:3", "a.js", 3, "t", "LOW", "LOW", "open")],
                                            "repo string, finding_id int, attack_class string, category string, location string, file string, line int, title string, severity string, confidence string, status string"))
    ex.write_sarif(f, f"{tmp_path}/sarif")
    ex.write_envelope(f, f"{tmp_path}/env")
    log = json.loads(spark.read.text(f"{tmp_path}/sarif").first().value)
    by = {r["locations"][0]["physicalLocation"]["artifactLocation"]["uri"]: r for r in log["runs"][0]["results"]}
    assert by["."]["properties"]["projectLevel"] is True and by["."]["suppressions"][0]["kind"] == "external" and by["a.js"]["locations"][0]["physicalLocation"]["region"]["startLine"] == 3
    assert json.loads(spark.read.text(f"{tmp_path}/env").first().value)["summary"]["total"] == 2


def batches(spark, tmp_path, name, schema, parts):
    """A stream that sees one file per batch."""
    folder = f"{tmp_path}/{name}"
    for i, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").json(folder)
        yield spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).json(folder)


def run(writer):
    writer.trigger(availableNow=True).start().awaitTermination()


def test_sample_counts_once_over_batches(spark, tmp_path):
    root = f"{tmp_path}/out"
    parts = [[("xss", "HIGH", True, "s1", True), ("xss", "HIGH", True, "s2", False)], [("xss", "HIGH", True, "s1", True), ("xss", "HIGH", False, "s3", True)]]
    for stream in batches(spark, tmp_path, "in", ev.EVIDENCE, parts):
        run(ev.evidence_fold(stream, root))
    cell = ev.evidence_cells(spark, root).filter("grp = 'label'").first()
    assert (cell.n, cell.k) == (2, 1)
    assert spark.read.parquet(f"{root}/quarantine").count() == 1


def test_older_feed_is_rejected(spark, tmp_path):
    root = f"{tmp_path}/out"
    schema = "source string, cve string, value double, feed_date date"
    import datetime
    d = datetime.date
    parts = [[("epss", "CVE-2024-1", 0.1, d(2025, 5, 2))], [("epss", "CVE-2024-1", 0.2, d(2025, 5, 1))], [("epss", "CVE-2024-1", 0.3, d(2025, 5, 3))]]
    for stream in batches(spark, tmp_path, "in", schema, parts):
        run(ev.monotone_intel(stream, root))
    assert sorted(r.value for r in spark.read.parquet(f"{root}/published").collect()) == [0.1, 0.3]
    assert spark.read.parquet(f"{root}/rejected").count() == 1


def test_lifecycle_over_runs(spark, tmp_path):
    root = f"{tmp_path}/out"
    parts = [[("r", "f", 1, "LOW", "open"), ("r", "g", 1, "LOW", "open")], [("r", "f", 2, "HIGH", "open")], [("r", "f", 1, "LOW", "open")], [("r", "f", 3, "HIGH", "open"), ("r", "g", 3, "LOW", "open")]]
    for stream in batches(spark, tmp_path, "in", ev.OBSERVED, parts):
        run(ev.lifecycle_stream(stream, root))
    got = {(r.run, r.fingerprint): r.event for r in spark.read.parquet(f"{root}/events").collect()}
    assert got == {(1, "f"): "new", (1, "g"): "new", (2, "f"): "changed", (2, "g"): "no-longer-observed", (3, "f"): "unchanged", (3, "g"): "reopened"}


def test_rule_tables_are_checked(spark):
    schema = "rule_id string, attack_class string, pattern string, literal string, severity string"
    f = spark.createDataFrame([("r", "a.js", "x\nTODO here")], "repo string, path string, content string")
    assert ext.scan_with_table(f, spark.createDataFrame([("t", "sast", "TODO", "", "LOW")], schema)).first().line == 2
    with pytest.raises(ValueError):
        ext.rules_from_table(spark.createDataFrame([("t", "sast", "a", "", "LOW"), ("t", "sast", "b", "", "LOW")], schema))
    with pytest.raises(ValueError):
        ext.rules_from_table(spark.createDataFrame([("t", "sast", "a", "", "severe")], schema))


def test_failing_pack_is_a_row(spark):
    ext.register_pack("bad", lambda f: f.select("nope"))
    ext.register_pack("good", lambda f: f.select("repo"))
    out, rows = ext.run_packs(spark.createDataFrame([("r", "a", "b")], "repo string, path string, content string"), ["bad", "good"])
    assert {r.pack: r.outcome for r in rows.collect()} == {"bad": "error", "good": "completed"} and set(out) == {"good"}


def files_of(root):
    return sorted(os.path.join(d, n) for d, _s, names in os.walk(root) for n in names if n.endswith(".parquet"))


def test_state_reads_own_buckets_and_repeats(spark, tmp_path):
    st = KeyedState(f"{tmp_path}/st", "k string, v int", ["k"], 16)
    frame = lambda rows: spark.createDataFrame(rows, "k string, v int")

    def add(rows, n):
        batch = frame(rows)
        st.put(st.before(batch, n).unionByName(batch).groupBy("k").agg(F.sum("v").cast("int").alias("v")), n)
    want = {}
    for n in range(6):
        rows = [(f"k{(n * 7 + i) % 40}", i + 1) for i in range(5)] + [(None, 1)]
        add(rows, n)
        if n % 2:
            add(rows, n)  # run again
        for k, v in rows:
            want[k] = want.get(k, 0) + v
        assert {r.k: r.v for r in st.all(spark).collect()} == want
    one = frame([("k3", 0)])
    bucket = one.select(st.bucket()).first()[0]
    assert {p.split("bucket=")[1].split("/")[0] for p in st.before(one, 6).inputFiles()} == {str(bucket)}
    assert len({tuple(p.split("/rows/")[1].split("/")[:2]) for p in files_of(f"{tmp_path}/st/rows")}) <= 2 * 16
    with pytest.raises(ValueError):
        KeyedState(f"{tmp_path}/st", "k string, v int", ["k"], 8).all(spark)


def test_empty_batches_leave_the_state(spark, tmp_path):
    st = KeyedState(f"{tmp_path}/st", "k string, v int", ["k"], 4)
    none = spark.createDataFrame([], "k string, v int")
    st.put(none, 0)
    st.put(spark.createDataFrame([("a", 1)], "k string, v int"), 1)
    st.put(none, 2)
    assert [tuple(r) for r in st.all(spark).collect()] == [("a", 1)]


def test_repeated_batch_of_a_late_run(spark, tmp_path):
    fold = ev.lifecycle_folding(f"{tmp_path}/out", 4)
    runs = [[("r", "f", 1, "LOW", "open"), ("q", "f", 1, "LOW", "open")], [("r", "f", 2, "HIGH", "open")], [("r", "g", 2, "LOW", "open"), ("q", "g", 2, "LOW", "open")]]
    for n, rows in enumerate(runs):
        for _again in range(2):
            fold(spark.createDataFrame(rows, ev.OBSERVED), n)
    got = sorted((r.repo, r.run, r.fingerprint, r.event) for r in spark.read.parquet(f"{tmp_path}/out/events").collect())
    assert got == [("q", 1, "f", "new"), ("q", 2, "f", "no-longer-observed"), ("q", 2, "g", "new"), ("r", 1, "f", "new"), ("r", 2, "f", "changed")]
