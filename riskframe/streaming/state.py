"""State of ever-growing keys for micro-batches, in hash buckets.

A batch reads and writes the buckets of its own keys only. Each bucket has two slots: a batch writes the
slot that does not hold the newest rows and then notes in the ledger which slot is the newest. A batch that
is run again finds the rows it started from, and versions before those are overwritten, so nothing piles up.
The ledger has at most one row for each bucket and two slots of its own."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEDGER = "bucket int, slot int, batch bigint, buckets int"


def read_if_there(spark: SparkSession, schema: str, path: str) -> DataFrame:
    """Rows of a folder; an empty frame where it does not exist yet."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class KeyedState:
    """Rows of ``schema`` under ``root``, found by ``keys``. Null keys share a bucket.

    ``buckets`` is fixed for a root; more buckets mean that a small batch rewrites less. A bucket is a folder
    of files, read and written by as many tasks as its size asks for, so a hot key is no single task."""

    def __init__(self, root: str, schema: str, keys, buckets: int = 256):
        self.root, self.schema, self.keys, self.buckets = root, schema, list(keys), buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _ledger(self, spark: SparkSession, before: int | None) -> tuple[dict, int]:
        """({bucket: slot}, ledger slot) of the newest batch, or of the newest one before ``before``."""
        best, at, newest = {}, 1, None
        for slot in (0, 1):
            rows = read_if_there(spark, LEDGER, f"{self.root}/ledger/slot={slot}").collect()
            if not rows or (before is not None and rows[0].batch >= before):
                continue
            if rows[0].buckets != self.buckets:
                raise ValueError(f"{self.root} has {rows[0].buckets} buckets, not {self.buckets}")
            if newest is None or rows[0].batch > newest:
                best, at, newest = {r.bucket: r.slot for r in rows if r.bucket is not None}, slot, rows[0].batch
        return best, at

    def _touched(self, df: DataFrame) -> list:
        return sorted(r[0] for r in df.select(self.bucket().alias("b")).distinct().collect())

    def _rows(self, spark: SparkSession, slots: dict) -> DataFrame:
        paths = [f"{self.root}/rows/bucket={b}/slot={s}" for b, s in slots.items()]
        return spark.read.schema(self.schema).parquet(*paths) if paths else spark.createDataFrame([], self.schema)

    def before(self, batch: DataFrame, batch_id: int) -> DataFrame:
        """State before a batch: all rows of the buckets that its keys fall into."""
        slots, _at = self._ledger(batch.sparkSession, batch_id)
        touched = set(self._touched(batch))
        return self._rows(batch.sparkSession, {b: s for b, s in slots.items() if b in touched})

    def put(self, rows: DataFrame, batch_id: int) -> None:
        """New rows of every bucket that occurs in ``rows``: all of the bucket's rows, as ``before`` gave them and as changed."""
        spark = rows.sparkSession
        slots, at = self._ledger(spark, batch_id)
        fresh = [1 - slots.get(b, 1) for b in range(self.buckets)]
        names = [f.strip().split()[0] for f in self.schema.split(",")]
        out = rows.select(*names).withColumn("bucket", self.bucket()).hint("rebalance", "bucket").withColumn("slot", F.get(F.lit(fresh), F.col("bucket")))
        # Which buckets are written is asked before the write: at most ``buckets`` numbers.
        touched = self._touched(rows)
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket", "slot").parquet(f"{self.root}/rows")
        now = {**slots, **{b: fresh[b] for b in touched}}
        ledger = [(b, s, batch_id, self.buckets) for b, s in now.items()] or [(None, None, batch_id, self.buckets)]
        spark.createDataFrame(ledger, LEDGER).coalesce(1).write.mode("overwrite").parquet(f"{self.root}/ledger/slot={1 - at}")

    def all(self, spark: SparkSession) -> DataFrame:
        """The newest rows of all buckets."""
        return self._rows(spark, self._ledger(spark, None)[0])
