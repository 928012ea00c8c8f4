"""Line de-duplication: range-partitioned hashes, a stream of first occurrences, keep bitmaps per document.

1. *Hashes.* Every line of at least ``least`` code points becomes (hash, document, line number); its text stays
   where it is. The hash has 128 bits of SHA-256 of the line, stripped of ASCII white space and with A-Z lower-cased.
2. *Range partitioning with secondary sort.* Rows are dealt out by ranges of (hash, document, line), so a line that
   a third of all rows hold spreads over several partitions instead of filling one.
3. *Stream.* A partition is read once in order: the first document of a hash keeps the line, later ones lose
   it. Only the first hash of a partition may have begun in an earlier one; its rows wait for the
   least first document that any partition names for it (at most two names a partition).
4. *Bitmaps.* Lost lines meet per document and become one compressed bitmap: a bit a line, 1 for lines that stay.
   Lines past its end stay. No text is shuffled for it.

``apply_bitmaps`` lays bitmaps on texts. A null text is one empty line. A line that only repeats within one document
stays. Rows that share a doc_id are one document with several texts: they lose no line to one another, and each has its own
bitmap (``version`` is the hash of the text); exact repeats share it. Rows without doc_id are returned whole, and their
lines take none from others. Ties do not occur: the smallest doc_id keeps. Other columns, whatever their names, are not
read. Empty tables give empty results."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex

ENTRY = "hash binary, doc_id long, version long, line int"
DROPPED, WAITING, FIRST = 0, 1, 2
ORDER = ["hash", "doc_id", "version", "line"]
#: Rows of hashes for one range, about.
RANGE_ROWS = 2_000_000


def key_of(line: bytes) -> bytes:
    """What two lines must share: bytes.strip and bytes.lower know the ASCII characters only."""
    return line.strip().lower()


def code_points(key: bytes) -> int:
    return len(key.decode("utf-8", "replace"))


def _long_enough(key: bytes, least: int) -> bool:
    return len(key) >= least and (len(key) >= 4 * least or code_points(key) >= least)


def _versions(docs: DataFrame) -> DataFrame:
    """(doc_id, text, version), nothing else."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("version"))


def line_hashes(docs: DataFrame, least: int) -> DataFrame:
    """ENTRY rows of all lines that count."""
    ex.ready(docs.sparkSession)

    def run(batches):
        ex.release()
        for batch in batches:
            hashes, numbers, sizes = [], [], []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                before = len(hashes)
                for number, line in enumerate(text.split(b"\n")):
                    key = line.strip().lower()
                    if _long_enough(key, least):
                        hashes.append(hashlib.sha256(key).digest()[:16])
                        numbers.append(number)
                sizes.append(len(hashes) - before)
            row = np.repeat(np.arange(len(sizes)), sizes)
            yield pa.record_batch([pa.array(hashes, pa.binary()), batch.column("doc_id").take(pa.array(row)), batch.column("version").take(pa.array(row)), pa.array(numbers, pa.int32())], names=ORDER)

    return _versions(docs).filter("doc_id is not null and text is not null").mapInArrow(run, ENTRY)


def first_occurrences(ranges: DataFrame) -> DataFrame:
    """From ENTRY rows in order: (kind, hash, doc_id, version, line) with DROPPED lines, lines WAITING for the first document of their hash, FIRST documents."""

    def run(batches):
        ex.release()
        last = first = lead = trail = before = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            column = batch.column("hash").cast(pa.binary(16))
            pair = np.frombuffer(column.buffers()[1], np.uint64, 2 * n, column.offset * 16).reshape(n, 2)
            doc, version, line = (batch.column(c).to_numpy() for c in ORDER[1:])
            starts = np.append(True, (pair[1:] != pair[:-1]).any(axis=1))
            here = column[0].as_py()
            goes_on = here == last
            begin = np.maximum.accumulate(np.where(starts, np.arange(n), 0))
            keeper = doc[begin]
            head = begin == 0  # rows of the run that this batch begins with
            if goes_on:
                keeper = np.where(head, first, keeper)
            again = np.append(before == (here, doc[0], version[0], line[0]), ~starts[1:] & (doc[1:] == doc[:-1]) & (version[1:] == version[:-1]) & (line[1:] == line[:-1]))
            if lead is None:
                lead = here
            waits = head if lead == here else np.zeros(n, bool)
            if last is None:
                yield _decisions(FIRST, [here], [doc[0]], [0], [0])
            lost = np.flatnonzero((doc != keeper) & ~waits & ~again)
            yield _decisions(DROPPED, [None] * len(lost), doc[lost], version[lost], line[lost])
            held = np.flatnonzero(waits & ~again)
            yield _decisions(WAITING, [here] * len(held), doc[held], version[held], line[held])
            last, first = column[n - 1].as_py(), int(keeper[-1])
            trail, before = (last, first), (last, doc[-1], version[-1], line[-1])
        if trail is not None and trail[0] != lead:
            yield _decisions(FIRST, [trail[0]], [trail[1]], [0], [0])

    ex.ready(ranges.sparkSession)
    return ranges.mapInArrow(run, "kind int, " + ENTRY)


def _decisions(kind: int, hashes: list, doc, version, line) -> pa.RecordBatch:
    return pa.record_batch([pa.array(np.full(len(hashes), kind, np.int32)), pa.array(hashes, pa.binary()), pa.array(np.asarray(doc, np.int64)), pa.array(np.asarray(version, np.int64)), pa.array(np.asarray(line, np.int32))], names=["kind", *ORDER])


def _bitmap(lost: np.ndarray) -> bytes:
    """Bits of the lines up to the last lost one (and ones up to a whole byte): 1 stays."""
    bits = np.ones((int(lost[-1]) // 8 + 1) * 8, np.uint8)
    bits[lost] = 0
    return zstandard.compress(np.packbits(bits).tobytes(), 3)


def lost_of(keep: bytes | None) -> np.ndarray:
    """Numbers of the lines that a bitmap drops."""
    if keep is None:
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.unpackbits(np.frombuffer(zstandard.decompress(keep), np.uint8)) == 0)


def bitmaps(lost: DataFrame) -> DataFrame:
    """(doc_id, version, n_dropped, keep) from dropped lines, one row for each text that loses any."""

    def run(batches):
        ex.release()
        rest = None
        for batch in batches:
            doc, version, line = (batch.column(c).to_numpy() for c in ORDER[1:])
            if rest is not None:
                doc, version, line = (np.concatenate(x) for x in zip(rest, (doc, version, line), strict=True))
            if not len(doc):
                continue
            cut = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (version[1:] != version[:-1])))
            yield _rows(doc, version, line, cut)
            rest = (doc[cut[-1]:], version[cut[-1]:], line[cut[-1]:])
        if rest is not None:
            yield _rows(*rest, np.array([0, len(rest[0])]))

    ex.ready(lost.sparkSession)
    return lost.repartition("doc_id", "version").sortWithinPartitions("doc_id", "version", "line").mapInArrow(run, "doc_id long, version long, n_dropped long, keep binary")


def _rows(doc: np.ndarray, version: np.ndarray, line: np.ndarray, cut: np.ndarray) -> pa.RecordBatch:
    """Bitmaps of the documents between the cuts (what follows the last cut is left)."""
    at = cut[:-1]
    keep = [_bitmap(line[s:e]) for s, e in zip(at, cut[1:], strict=True)]
    return pa.record_batch([pa.array(doc[at]), pa.array(version[at]), pa.array(np.diff(cut).astype(np.int64)), pa.array(keep, pa.binary())], names=["doc_id", "version", "n_dropped", "keep"])


def keep_bitmaps(docs: DataFrame, least: int = 10) -> DataFrame:
    """(doc_id, version, n_dropped, keep) of each text that loses a line; ``keep`` is a zstandard-compressed bitmap."""
    entries = ex.written(line_hashes(docs, least))
    spark = docs.sparkSession
    ranges = max(int(spark.conf.get("spark.sql.shuffle.partitions")), entries.count() // RANGE_ROWS + 1)
    found = ex.written(first_occurrences(entries.repartitionByRange(ranges, *ORDER).sortWithinPartitions(*ORDER)))
    # at most two rows for each range
    first = found.filter(f"kind = {FIRST}").groupBy("hash").agg(F.min("doc_id").alias("first"))
    late = found.filter(f"kind = {WAITING}").join(F.broadcast(first), "hash").filter("doc_id > first")
    lost = found.filter(f"kind = {DROPPED}").select(*ORDER[1:]).unionByName(late.select(*ORDER[1:]))
    return bitmaps(lost)


def apply_bitmaps(docs: DataFrame, keep: DataFrame, with_text: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, text, keep) of each document; ``text`` is null unless ``with_text``.

    Texts meet their bitmaps by (doc_id, version); rows without doc_id take no part in the join."""
    mine = _versions(docs)
    with_id = mine.filter("doc_id is not null").join(keep, ["doc_id", "version"], "left")
    every = with_id.unionByName(mine.filter("doc_id is null"), allowMissingColumns=True).select("doc_id", "text", "n_dropped", "keep")
    ex.ready(docs.sparkSession)

    def run(batches):
        ex.release()
        for batch in batches:
            n_lines, digests, texts = [], [], []
            for text, keep in zip(batch.column("text").cast(pa.binary()).to_pylist(), batch.column("keep").to_pylist(), strict=True):
                raw = text or b""
                n_lines.append(raw.count(b"\n") + 1)
                if keep is not None:
                    lines, gone = raw.split(b"\n"), set(lost_of(keep).tolist())
                    raw = text = b"\n".join(x for i, x in enumerate(lines) if i not in gone)
                digests.append(hashlib.sha256(raw).hexdigest())
                texts.append(text if with_text else None)
            yield pa.record_batch([batch.column("doc_id"), pa.array(n_lines, pa.int64()), batch.column("n_dropped").fill_null(0), pa.array(digests, pa.string()), pa.array(texts, pa.binary()).cast(pa.string()), batch.column("keep")], names=["doc_id", "n_lines", "n_dropped", "kept_sha256", "text", "keep"])

    return every.mapInArrow(run, "doc_id long, n_lines long, n_dropped long, kept_sha256 string, text string, keep binary")


def line_dedup(docs: DataFrame, least: int = 10, with_text: bool = False) -> DataFrame:
    """(doc_id, n_lines, n_dropped, kept_sha256, text, keep) of each row of ``docs``: lines found in an earlier document go."""
    docs = docs.select("doc_id", "text")
    return apply_bitmaps(docs, keep_bitmaps(docs, least), with_text)
