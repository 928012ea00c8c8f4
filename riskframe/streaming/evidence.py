"""Continuous folding of evidence with Structured Streaming.

State that must outlive any watermark (a sample counts once, ever) is kept in hash buckets (``state.py``), of
which a batch reads only its own. What a batch adds is written under its batch id with overwrite, so a
batch that is run again after a failure replaces its own output instead of adding to it. Each writer has its
fold apart, a function of (batch, batch id), for use outside a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import ranks
from ..functions.ident import sha
from ..operators.calibration import wilson_cells
from ..operators.core import cut_lineage, first_row
from .state import KeyedState


def _put(df: DataFrame, path: str, batch_id: int) -> None:
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def _write(stream: DataFrame, fold, root: str):
    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{root}/_checkpoint")


def _once(batch: DataFrame, batch_id: int, state: KeyedState, key: str) -> DataFrame:
    """Rows of the batch whose key no earlier batch had; the state then holds their keys too."""
    seen = state.before(batch, batch_id)
    fresh = cut_lineage(batch.join(seen, key, "left_anti").select(*batch.columns))
    state.put(seen.unionByName(fresh.select(key)), batch_id)
    return fresh


EVIDENCE = "attack_class string, confidence string, is_real boolean, sample_id string, evidence_verified boolean"


def evidence_folding(root: str, buckets: int = 256):
    """Fold of labelled evidence: new verified samples to <root>/samples, the rest to <root>/quarantine.

    A sample id is accepted once over all batches; of rows of one batch that share an id the least counts."""
    state = KeyedState(f"{root}/seen", "sample_id string", ["sample_id"], buckets)
    cols = [c.split()[0] for c in EVIDENCE.split(", ")]

    def fold(batch: DataFrame, batch_id: int):
        ok = F.coalesce("evidence_verified", F.lit(False)) & F.col("sample_id").isNotNull() & F.col("is_real").isNotNull()
        one = first_row(batch.filter(ok).select(*cols), ["sample_id"], ["attack_class", "confidence", "is_real"])
        _put(_once(one, batch_id, state, "sample_id"), f"{root}/samples", batch_id)
        _put(batch.filter(~ok).select(*cols), f"{root}/quarantine", batch_id)
    return fold


def evidence_fold(stream: DataFrame, root: str, buckets: int = 256):
    """Writer of labelled evidence, see ``evidence_folding``."""
    return _write(stream, evidence_folding(root, buckets), root)


def evidence_cells(spark: SparkSession, root: str) -> DataFrame:
    return wilson_cells(spark.read.schema(EVIDENCE).parquet(f"{root}/samples"))


def feedback_candidates(feedback: DataFrame, revision: str) -> DataFrame:
    """Candidates of false-positive verdicts, one per id; stale where the detector changed since."""
    cid = sha(F.concat_ws("|", "fingerprint", "attack_class", F.coalesce("detector_revision", F.lit(""))))
    one = first_row(feedback.filter("verdict = 'false-positive'").withColumn("candidate_id", cid), ["candidate_id"], ["recorded", "reason"])
    return (one
            .withColumn("state", F.when(F.coalesce("detector_revision", F.lit("")) != revision, F.lit("stale")).otherwise(F.lit("pending"))))


FEEDBACK = "recorded timestamp, verdict string, reason string, fingerprint string, attack_class string, detector_revision string"


def feedback_folding(root: str, revision: str, buckets: int = 256):
    """Fold of review candidates, each once over all batches; every record is kept under <root>/records."""
    state = KeyedState(f"{root}/seen", "candidate_id string", ["candidate_id"], buckets)
    cols = [c.split()[0] for c in FEEDBACK.split(", ")] + ["candidate_id", "state"]

    def fold(batch: DataFrame, batch_id: int):
        _put(_once(feedback_candidates(batch, revision).select(*cols), batch_id, state, "candidate_id"), f"{root}/candidates", batch_id)
        _put(batch, f"{root}/records", batch_id)
    return fold


def feedback_queue(stream: DataFrame, root: str, revision: str, buckets: int = 256):
    """Writer of review candidates, see ``feedback_folding``."""
    return _write(stream, feedback_folding(root, revision, buckets), root)


def review(candidates: DataFrame, decisions: DataFrame) -> DataFrame:
    """Accepted needs a pending candidate and a reason. ``decisions(candidate_id, accept, reason)``."""
    j = candidates.join(decisions.select("candidate_id", "accept", F.col("reason").alias("review_reason")), "candidate_id", "left")
    has = F.coalesce(F.trim("review_reason"), F.lit("")) != ""
    return j.withColumn("outcome", F.when(F.col("accept").isNull(), F.lit("open")).when(F.col("state") == "stale", F.lit("refused-stale")).when(F.col("accept") & ~has, F.lit("refused-no-reason"))
                        .when(F.col("accept"), F.lit("accepted")).otherwise(F.lit("rejected")))


INTEL = "source string, cve string, value double, feed_date date"


def newest_feeds(batch: DataFrame, published: DataFrame):
    """(accepted rows, rejected sources): a feed older than the published one of its source is refused."""
    old = published.groupBy("source").agg(F.max("feed_date").alias("_pub"))
    j = batch.join(old, "source", "left")
    late = F.coalesce(F.col("feed_date") < F.col("_pub"), F.lit(False))
    return j.filter(~late).drop("_pub"), j.filter(late).groupBy("source", "feed_date").agg(F.max("_pub").alias("published"), F.count(F.lit(1)).alias("rows"))


def _newest(root: str, buckets: int) -> KeyedState:
    return KeyedState(f"{root}/newest", "source string, feed_date date", ["source"], buckets)


def _dates(feeds: DataFrame) -> DataFrame:
    return feeds.groupBy("source").agg(F.max("feed_date").alias("feed_date"))


def seed_intel(published: DataFrame, root: str, buckets: int = 256) -> None:
    """Feeds published before the stream begins."""
    _put(published.select("source", "cve", "value", "feed_date"), f"{root}/published", -1)
    _newest(root, buckets).put(_dates(published), -1)


def intel_folding(root: str, buckets: int = 256):
    """Fold of feeds: rows to <root>/published, sources with an older feed to <root>/rejected. The state has one date a source."""
    state = _newest(root, buckets)

    def fold(batch: DataFrame, batch_id: int):
        old = state.before(batch, batch_id)
        ok, bad = newest_feeds(batch, old)
        _put(ok.select("source", "cve", "value", "feed_date"), f"{root}/published", batch_id)
        _put(bad, f"{root}/rejected", batch_id)
        state.put(_dates(old.unionByName(ok.select("source", "feed_date"))), batch_id)
    return fold


def monotone_intel(stream: DataFrame, root: str, buckets: int = 256):
    """Writer of feeds, see ``intel_folding``."""
    return _write(stream, intel_folding(root, buckets), root)


OBSERVED = "repo string, fingerprint string, run bigint, severity string, status string"


def lifecycle_events(batch: DataFrame, state: DataFrame):
    """(events, next state) of one run per repo against the last known rows.

    State has one row per (repo, fingerprint) with seen = observed in the repo's last run. Rows of a run
    that is not newer than the state are late and change nothing."""
    runs = batch.groupBy("repo").agg(F.max("run").alias("_run"))
    last = state.groupBy("repo").agg(F.max("run").alias("_last"))
    live = runs.join(last, "repo", "left").filter("_last IS NULL OR _run > _last").select("repo", "_run")
    cur = batch.join(live, "repo").filter("run = _run").drop("_run").dropDuplicates(["repo", "fingerprint"])
    j = cur.alias("c").join(state.alias("s"), (F.col("c.repo") == F.col("s.repo")) & (F.col("c.fingerprint") == F.col("s.fingerprint")), "full_outer")
    j = j.select(F.coalesce("c.repo", "s.repo").alias("repo"), F.coalesce("c.fingerprint", "s.fingerprint").alias("fingerprint"), F.col("c.run").alias("run"), F.col("s.run").alias("_srun"), F.col("c.severity").alias("severity"),
                 F.col("s.severity").alias("_ssev"), F.col("c.status").alias("status"), F.col("s.status").alias("_sst"), F.col("s.seen").alias("_seen")).join(live, "repo", "left")
    event = (F.when(F.col("run").isNotNull() & F.col("_srun").isNull(), F.lit("new")).when(F.col("run").isNotNull() & ((F.col("_sst") == "acknowledged") & (F.col("status") != "acknowledged") | ~F.col("_seen")), F.lit("reopened"))
             .when(F.col("run").isNotNull() & (ranks.severity_rank(F.col("severity")) > ranks.severity_rank(F.col("_ssev"))), F.lit("changed")).when(F.col("run").isNotNull(), F.lit("unchanged"))
             .when(F.col("_run").isNotNull() & F.col("_seen"), F.lit("no-longer-observed")))
    ev = j.withColumn("event", event)
    nxt = ev.select("repo", "fingerprint", F.coalesce("run", F.coalesce("_run", "_srun")).alias("run"), F.coalesce("severity", "_ssev").alias("severity"), F.coalesce("status", "_sst").alias("status"),
                    F.when(F.col("run").isNotNull(), F.lit(True)).when(F.col("_run").isNotNull(), F.lit(False)).otherwise(F.col("_seen")).alias("seen"))
    return ev.filter("event IS NOT NULL").select("repo", "fingerprint", F.coalesce("run", "_run").alias("run"), "event"), nxt


def lifecycle_state(root: str, buckets: int = 256) -> KeyedState:
    """Last known rows, bucketed by repo: a run changes all rows of its repo."""
    return KeyedState(f"{root}/state", OBSERVED + ", seen boolean", ["repo"], buckets)


def lifecycle_folding(root: str, buckets: int = 256):
    """Fold of runs: events to <root>/events. Repos without a run in the batch share buckets and pass unchanged."""
    state = lifecycle_state(root, buckets)

    def fold(batch: DataFrame, batch_id: int):
        events, nxt = lifecycle_events(batch, state.before(batch, batch_id))
        _put(events, f"{root}/events", batch_id)
        state.put(nxt, batch_id)
    return fold


def lifecycle_stream(stream: DataFrame, root: str, buckets: int = 256):
    """Writer of lifecycle events, see ``lifecycle_folding``. Of the state the newest version and the one before it stay."""
    return _write(stream, lifecycle_folding(root, buckets), root)


def parse_log(lines: DataFrame) -> DataFrame:
    """(repo, recorded, reason, raw, parsed) of JSON lines; a line that does not parse stays as a row."""
    d = F.from_json("value", "repo string, recorded timestamp, reason string")
    ok = F.try_parse_json("value").isNotNull()
    return lines.select(F.when(ok, d["repo"]).alias("repo"), F.when(ok, d["recorded"]).alias("recorded"), F.when(ok, d["reason"]).alias("reason"), F.col("value").alias("raw"), ok.alias("parsed"))


def bypass_tail(log: DataFrame, k: int = 50) -> DataFrame:
    from ..operators.core import top_k
    return top_k(log, ["repo"], [F.col("recorded").desc_nulls_last(), F.col("raw")], k)
