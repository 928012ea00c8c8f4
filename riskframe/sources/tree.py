"""Reading source trees, hidden files included.

Spark's file sources skip names that start with a dot or underscore, which would lose ``.env``,
``.github/`` and ``__init__.py``. Folders are a table: each round the tasks list the folders of one depth,
so the driver holds no path. Files are then dealt out by bytes and read in the tasks."""

from __future__ import annotations

import hashlib
import math
import os
from functools import reduce

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.core import cut_lineage

SCHEMA = "repo string, path string, content string, sha256 string, n_bytes bigint, read_status string"
ENTRY = "repo string, root string, path string, kind string, n_bytes bigint"
BATCH_BYTES = 64 * 1024 * 1024
FRAME_BYTES = 16 * 1024 * 1024
FRAME_ROWS = 5000
MAX_FILE_BYTES = 2_000_000


def _entries(repo, root, folder):
    """Entries of one folder; links are left out, as is what is neither a file nor a folder."""
    try:
        with os.scandir(os.path.join(root, folder)) as found:
            for e in found:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    yield repo, root, path, "folder", None
                elif e.is_file(follow_symlinks=False):
                    yield repo, root, path, "file", e.stat(follow_symlinks=False).st_size
    except OSError:
        yield repo, root, folder or ".", "lost", None


def _list(frames):
    names = [c.split()[0] for c in ENTRY.split(", ")]
    rows = []
    for frame in frames:
        for repo, root, folder in zip(frame["repo"], frame["root"], frame["path"]):
            for row in _entries(repo, root, folder):
                rows.append(row)
                if len(rows) >= FRAME_ROWS:
                    yield pd.DataFrame(rows, columns=names).astype({"n_bytes": "Int64"})
                    rows = []
    yield pd.DataFrame(rows, columns=names).astype({"n_bytes": "Int64"})


def _read(cap):
    names = [c.split()[0] for c in SCHEMA.split(", ")]

    def one(repo, root, path, kind, n):
        if kind == "lost":
            return repo, path, None, None, None, "unreadable"
        if n > cap:
            return repo, path, None, None, int(n), "oversized"
        try:
            with open(os.path.join(root, path), "rb") as f:
                raw = f.read()
            return repo, path, raw.decode("utf-8", "replace"), hashlib.sha256(raw).hexdigest(), int(n), "ok"
        except OSError:
            return repo, path, None, None, int(n), "unreadable"

    def frame(rows):
        return pd.DataFrame(rows, columns=names).astype({"n_bytes": "Int64"})

    def read(frames):
        rows, size = [], 0
        for f in frames:
            for entry in zip(f["repo"], f["root"], f["path"], f["kind"], f["n_bytes"]):
                rows.append(one(*entry))
                size += len(rows[-1][2] or "")
                if size >= FRAME_BYTES or len(rows) >= FRAME_ROWS:
                    yield frame(rows)
                    rows, size = [], 0
        yield frame(rows)
    return read


def list_source_tree(spark: SparkSession, roots) -> DataFrame:
    """Entries(repo, root, path, kind, n_bytes) below the roots: files, and folders that cannot be listed (lost).

    ``roots``: paths, or a DataFrame (repo, root) where there are many. Rounds follow the depth of the trees."""
    if not isinstance(roots, DataFrame):
        roots = spark.createDataFrame([(os.path.basename(os.path.normpath(r)), r) for r in roots], "repo string, root string")
    front, found = roots.select("repo", "root", F.lit("").alias("path")), []
    tasks = 4 * spark.sparkContext.defaultParallelism
    while True:
        listed = cut_lineage(front.repartition(tasks).mapInPandas(_list, ENTRY))
        found.append(listed.filter("kind <> 'folder'"))
        front = listed.filter("kind = 'folder'").select("repo", "root", "path")
        if front.isEmpty():
            return reduce(DataFrame.unionByName, found)


def read_source_tree(spark: SparkSession, roots, max_bytes: int = MAX_FILE_BYTES) -> DataFrame:
    """files(repo, path, content, sha256, n_bytes, read_status); the repo is the name of the root folder.

    The roots must be folders every executor can read. A file over ``max_bytes`` is a row without content
    (oversized), one that cannot be read and a folder that cannot be listed are rows too (unreadable)."""
    files = list_source_tree(spark, roots)
    size = files.agg(F.coalesce(F.sum(F.least("n_bytes", F.lit(max_bytes))), F.lit(0)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    parts = max(1, math.ceil(size.b / BATCH_BYTES), math.ceil(size.n / FRAME_ROWS))
    return files.repartition(parts, "repo", "path").mapInPandas(_read(max_bytes), SCHEMA)
