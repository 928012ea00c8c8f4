"""Shared building blocks: unique matching, numbering of hot groups, lineage cuts.

All of them keep hot keys off single tasks: candidates are counted by partial aggregation instead of
being listed as pairs, and numbering inside a group is split over order-preserving buckets."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

ANY = "\u0001any"
NONE = "\u0001none"


def ensure_checkpoint_dir(spark) -> None:
    """Use the folder the cluster names; a local session without one gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is not None:
        return
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        named = tempfile.mkdtemp(prefix="riskframe-checkpoint-")
    sc.setCheckpointDir(named)


def scratch_dir(spark, name: str) -> str:
    """A fresh folder beside the checkpoints, which all executors share."""
    ensure_checkpoint_dir(spark)
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    return f"{base.rstrip('/')}/riskframe-{name}-{uuid.uuid4().hex[:12]}"


def cut_lineage(df: DataFrame) -> DataFrame:
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def _slots(compatible, emit: bool):
    """Array of slot keys of a row. Emitted: own value (or NONE) and ANY per field. Looked up:
    own value and NONE where the field is known, else ANY."""
    choices = []
    for name in compatible:
        value = F.col(name).cast("string")
        known = value.isNotNull() & (value != "")
        if emit:
            choices.append((F.when(known, value).otherwise(F.lit(NONE)), F.lit(ANY)))
        else:
            choices.append((F.when(known, value).otherwise(F.lit(ANY)), F.when(known, F.lit(NONE))))
    if not choices:
        return F.array(F.lit(""))
    combos = []
    for combo in itertools.product(*choices):
        # A NULL member means the combination does not apply; concat makes the whole key NULL.
        combos.append(F.concat(*[x for c in combo for x in (c, F.lit("\u0002"))]))
    return F.filter(F.array(*combos), lambda s: s.isNotNull())


def _candidate_counts(left, right, keys, compatible, left_id, right_id):
    """left_id, n (number of compatible right rows) and one right id, without listing pairs.

    Right rows are pre-aggregated per slot, so a key with a billion rows is one row in the join."""
    slots = (right.select(*keys, F.col(right_id).alias("_rid"), F.explode(_slots(compatible, True)).alias("_slot"))
             .groupBy(*keys, "_slot").agg(F.count(F.lit(1)).alias("_n"), F.min("_rid").alias("_rid")))
    asks = left.select(*keys, F.col(left_id).alias("_lid"), F.explode(_slots(compatible, False)).alias("_slot"))
    return (asks.join(slots, [*keys, "_slot"])
            .groupBy("_lid").agg(F.sum("_n").alias("_n"), F.min("_rid").alias("_rid")))


def unique_match(left: DataFrame, right: DataFrame, keys, left_id: str, right_id: str,
                 compatible=(), payload=(), both_ways: bool = True) -> DataFrame:
    """Left rows with ``payload`` columns of their only compatible right row, else NULLs.

    ``keys`` must be equal. Each ``compatible`` field must be equal or missing on one side. A match
    counts only if the left row has one candidate and (``both_ways``) that candidate has one too.
    Adds ``match_id`` and ``candidate_count``."""
    keys, compatible, payload = list(keys), list(compatible), list(payload)
    have = reduce(lambda a, k: a & F.col(k).isNotNull(), keys, F.lit(True))
    lk, rk = left.filter(have), right.filter(have)
    fwd = _candidate_counts(lk, rk, keys, compatible, left_id, right_id)
    fwd = fwd.select(F.col("_lid").alias(left_id), F.col("_n").alias("candidate_count"),
                     F.when(F.col("_n") == 1, F.col("_rid")).alias("match_id"))
    # Only rows with a match go on: the others have no match_id, and an equal key would bring them all to one task.
    hit = fwd.filter("match_id IS NOT NULL").select(left_id, "match_id")
    if both_ways:
        back = (_candidate_counts(rk, lk, keys, compatible, right_id, left_id)
                .filter("_n = 1").select(F.col("_lid").alias("match_id"), F.col("_rid").alias("_only")))
        hit = hit.join(back, "match_id").filter(F.col("_only") == F.col(left_id)).drop("_only")
    if payload:
        info = right.select(F.col(right_id).alias("match_id"), *payload)
        hit = hit.join(info, "match_id", "left")
    return (left.join(fwd.drop("match_id"), left_id, "left").withColumn("candidate_count", F.coalesce("candidate_count", F.lit(0)))
            .join(hit, left_id, "left"))


def number_within(df: DataFrame, group, order: str, out: str, width: int = 1 << 20) -> DataFrame:
    """1-based position inside ``group`` by the integer column ``order`` (unique within the group).

    Rows are numbered inside buckets of ``width`` consecutive order values and shifted by the counts
    of the buckets before, so no task sorts a whole hot group."""
    group = list(group)
    b = df.withColumn("_b", F.floor(F.col(order) / F.lit(width)))
    sizes = b.groupBy(*group, "_b").agg(F.count(F.lit(1)).alias("_n"))
    before = W.partitionBy(*group).orderBy("_b").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select(*group, "_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    local = b.withColumn("_k", F.row_number().over(W.partitionBy(*group, "_b").orderBy(order)))
    cond = reduce(lambda a, c: a & F.col("l." + c).eqNullSafe(F.col("o." + c)), [*group, "_b"], F.lit(True))
    return (local.alias("l").join(offsets.alias("o"), cond)
            .select("l.*", (F.col("o._off") + F.col("l._k")).cast("bigint").alias(out)).drop("_b", "_k"))


def first_row(df: DataFrame, keys, order) -> DataFrame:
    """One row per key: the smallest by ``order`` columns, all columns kept. Partial aggregation."""
    keys, order = list(keys), list(order)
    rest = [c for c in df.columns if c not in keys]
    best = F.min_by(F.struct(*rest), F.struct(*[F.col(c) for c in order]))
    return df.groupBy(*keys).agg(best.alias("_r")).select(*keys, "_r.*").select(*df.columns)


def top_k(df: DataFrame, group, order, k: int, out: str = "position") -> DataFrame:
    """First ``k`` rows of each group. Spark limits each map partition to k rows per group before the
    shuffle (WindowGroupLimit), so the size of a group does not matter."""
    return (df.withColumn(out, F.row_number().over(W.partitionBy(*group).orderBy(*order)))
            .filter(F.col(out) <= k))


def multiset_digest(*cols: Column) -> Column:
    """Aggregate: order-independent digest of a group of rows, by partial sums.

    Each row is hashed; four 60-bit slices of the hashes are summed as decimals and hashed again with
    the row count. Groups of any size need four numbers per task, never a list."""
    h = F.sha2(F.concat_ws("\u0001", *cols), 256)
    sums = [F.sum(F.conv(F.substring(h, 1 + 15 * i, 15), 16, 10).cast("decimal(38,0)")).cast("string")
            for i in range(4)]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)


def fixed_point(start: DataFrame, step, key, max_rounds: int, every: int = 4) -> tuple[DataFrame, bool]:
    """Grow ``start`` by ``step(frontier)`` until no new ``key`` rows appear.

    Returns (all rows, finished). The known set keeps its lineage cut every few rounds and the frontier
    each round, so a lost executor recomputes one round at most."""
    known = frontier = cut_lineage(start.dropDuplicates(list(key)))
    for i in range(max_rounds):
        fresh = cut_lineage(step(frontier).dropDuplicates(list(key)).join(known, list(key), "left_anti"))
        if fresh.isEmpty():
            return known, True
        known = known.unionByName(fresh)
        if (i + 1) % every == 0:
            known = cut_lineage(known)
        frontier = fresh
    return known, step(frontier).join(known, list(key), "left_anti").isEmpty()
