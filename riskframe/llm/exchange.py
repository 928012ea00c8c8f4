"""Shuffles of packed arrays between blocks of documents and buckets of keys.

A block is the set of documents with one hash of ``doc_id``; a bucket is the set of entries (words, windows,
n-grams) with one hash of the entry. Spark deals out both; a row of a shuffle is a compressed bundle of
numpy arrays instead of one entry. The number of blocks and of buckets follows the bytes of text, so what
one task holds stays the same at every size. Before a bundle leaves a task, equal entries are merged, so a
key that a third of all documents hold sends one entry for each block."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A bundle: who shall get it (a block or a bucket), what it holds, who sent it, the arrays.
BUNDLE = "key long, kind int, sender long, payload binary"
#: Bytes of text for one block.
BLOCK_BYTES = 6 << 20
#: Rows that Python gets at once.
BATCH_ROWS = 1000
#: Bytes that Python gets at once, about; a single longer row comes alone.
BATCH_BYTES = 8 << 20
#: Workers live through many stages: memory that arrays free goes back at once, to be there for the next worker.
WORKER = {"MALLOC_ARENA_MAX": "1", "MALLOC_MMAP_THRESHOLD_": "262144", "MALLOC_TRIM_THRESHOLD_": "262144", "ARROW_DEFAULT_MEMORY_POOL": "system"}
NULL = -1

_HELD: dict[object, object] = {}


def held(what: object, make):
    """What this worker keeps from task to task (an encoder with its cache); only one thing at a time."""
    if what not in _HELD:
        release()
        _HELD[what] = make()
    return _HELD[what]


def release() -> None:
    """Let go what this worker kept for other operators' tasks."""
    if _HELD:
        _HELD.clear()
        gc.collect()


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share; one of our own only where the session names none."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="riskframe-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def written(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read again: a lost executor costs no earlier stage."""
    path = os.path.join(shared_folder(df.sparkSession), f"riskframe-{uuid.uuid4().hex}")
    df.write.option("compression", "lz4").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ready(spark: SparkSession) -> None:
    """Bound what Python holds at once where texts are long, and let workers import this package from where the driver has it.

    On a cluster whose nodes don't share that path, ship the package with --py-files."""
    home, env = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))), spark.sparkContext.environment
    if home not in env.get("PYTHONPATH", "").split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(filter(None, [home, env.get("PYTHONPATH")]))
    for name, value in WORKER.items():
        env.setdefault(name, value)
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS), ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = spark.conf.get(key)
        if not now.isdigit() or not 0 < int(now) <= most:
            spark.conf.set(key, str(most))


def n_blocks(docs: DataFrame, block_bytes: int = BLOCK_BYTES) -> int:
    """Blocks for this table, by the bytes of its texts."""
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(total // block_bytes) + 1


def pack(*arrays: np.ndarray) -> bytes:
    """The arrays as one compressed value."""
    parts = [len(arrays).to_bytes(1, "little")]
    for a in arrays:
        parts += [a.dtype.str.encode().ljust(4), len(a).to_bytes(8, "little"), a.tobytes()]
    return zstandard.compress(b"".join(parts), 1)


def unpack(payload: bytes) -> list[np.ndarray]:
    data, at, out = zstandard.decompress(payload), 1, []
    for _ in range(data[0]):
        kind, n = np.dtype(data[at:at + 4].decode().strip()), int.from_bytes(data[at + 4:at + 12], "little")
        at += 12
        out.append(np.frombuffer(data, kind, n, at))
        at += n * kind.itemsize
    return out


def gathered(payloads: list[bytes], n_arrays: int, kinds: str) -> list[np.ndarray]:
    """Arrays of several bundles, each joined end to end."""
    found = [unpack(p) for p in payloads]
    return [np.concatenate([f[i] for f in found]) if found else np.zeros(0, kind) for i, kind in zip(range(n_arrays), kinds.split(","), strict=True)]


def bundles(rows: list[tuple[int, int, int, bytes]]) -> pa.RecordBatch:
    """Rows of a shuffle as an Arrow batch."""
    key, kind, sender, payload = zip(*rows, strict=True) if rows else ([], [], [], [])
    return pa.record_batch([pa.array(key, pa.int64()), pa.array(kind, pa.int32()), pa.array(sender, pa.int64()), pa.array(payload, pa.binary())], names=["key", "kind", "sender", "payload"])


def dealt(keys: np.ndarray, arrays: list[np.ndarray], kind: int, sender: int) -> list[tuple[int, int, int, bytes]]:
    """Entries dealt out to the bucket named in ``keys``; their order within a bucket stays."""
    if not len(keys):
        return []
    order = np.argsort(keys, kind="stable")
    where, starts = np.unique(keys[order], return_index=True)
    ends = np.append(starts[1:], len(keys))
    return [(int(k), kind, sender, pack(*(a[order[s:e]] for a in arrays))) for k, s, e in zip(where, starts, ends, strict=True)]


def packed_documents(docs: DataFrame, blocks: int, kind: int = 0) -> DataFrame:
    """BUNDLE rows that hold the documents of each block: ids, lengths of texts in bytes (NULL for null), bytes."""
    ready(docs.sparkSession)

    def run(batches):
        release()
        for batch in batches:
            texts = batch.column("text").cast(pa.binary()).to_pylist()
            ids, to = batch.column("doc_id").to_numpy(zero_copy_only=False), batch.column("block").to_numpy(zero_copy_only=False)
            rows = []
            for k in np.unique(to):
                at = np.flatnonzero(to == k)
                own = [texts[i] for i in at]
                rows.append((int(k), kind, 0, pack(ids[at].astype(np.int64), np.array([NULL if t is None else len(t) for t in own], np.int64), np.frombuffer(b"".join(t or b"" for t in own), np.uint8))))
            yield bundles(rows)

    return docs.filter(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(blocks)).alias("block")).mapInArrow(run, BUNDLE)


def documents_of(payloads: list[bytes]) -> tuple[np.ndarray, list[bytes | None]]:
    """(ids, texts) of a block in the order of ids."""
    ids, texts = [], []
    for p in payloads:
        own, lengths, data = unpack(p)
        at, raw = 0, data.tobytes()
        for n in lengths.tolist():
            texts.append(None if n == NULL else raw[at:at + n])
            at += max(n, 0)
        ids.append(own)
    ids = np.concatenate(ids) if ids else np.zeros(0, np.int64)
    order = sorted(range(len(texts)), key=lambda i: (ids[i], texts[i] or b""))
    return ids[order], [texts[i] for i in order]


def by_key(messages: DataFrame, answer, schema: str = BUNDLE) -> DataFrame:
    """Call ``answer(key, {kind: [(sender, payload)]})`` for each key; it returns an Arrow batch."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    target = to_arrow_schema(StructType.fromDDL(schema))

    def run(key, table):
        release()
        own: dict[int, list[tuple[int, bytes]]] = {}
        for kind, sender, payload in sorted(zip(table.column("kind").to_pylist(), table.column("sender").to_pylist(), table.column("payload").to_pylist(), strict=True), key=lambda x: x[:2]):
            own.setdefault(kind, []).append((sender, payload))
        return pa.Table.from_batches([answer(key[0].as_py(), own)]).cast(target)

    ready(messages.sparkSession)
    return messages.groupBy("key").applyInArrow(run, schema)
