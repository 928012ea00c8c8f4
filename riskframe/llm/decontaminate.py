"""Benchmark decontamination by spaced-seed hashing.

Words are lower-cased runs of letters, digits and other non-ASCII bytes; ASCII punctuation parts them. Every
mask is laid on every place of an item and of a document, and only the words under its 1s are hashed, so a
substituted word under a 0 does not hide a match. Hashes of test items and of documents are joined; around
each hit the aligned words are compared, and the pair counts as a leak where ``overlap`` aligned words in a
row (the whole item, if it is shorter) agree in ``percent`` of places or more.

The default masks hit every overlap of 13 words with up to two substitutions (11 of 13 agree at 80 %); this
is tested pattern by pattern. Items of fewer than ``overlap`` words get masks of their own length (only for lengths that
the benchmark has), which hit every pattern that ``percent`` allows. Items of fewer than ``least_words`` words are
left out.

Where the benchmark is within ``broadcast_bytes`` (checked), its hashes go to all tasks and texts are neither
shuffled nor sent; a larger benchmark is joined by Spark on the hashes, with the same result. Null and empty
texts match nothing. Rows that repeat a doc_id count as one document, and so do items; rows without an id are
left out."""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .words import Words, mixed, words_of

#: The masks.
MASKS = ("11101011", "11001111")
RESULT = "doc_id long, item_id long, agree int, aligned int, at long"
_PUNCTUATION = np.array([32 if chr(b).isascii() and not chr(b).isalnum() else b for b in range(256)], np.uint8)


def plain_words(column: pa.Array) -> Words:
    """Words of a column of texts, lower-cased and without punctuation."""
    texts = pc.utf8_lower(column).cast(pa.binary()).to_pylist()
    return words_of([None if t is None else _PUNCTUATION[np.frombuffer(t, np.uint8)].tobytes() for t in texts])


def whole_masks(n: int, percent: int) -> list[str]:
    """Masks over a whole item of n words: one has 0s at all the words that an allowed copy substitutes.

    Words are dealt to two groups more than may be substituted, and each mask opens as many groups as that."""
    free = n - -(-percent * n // 100)
    groups = min(n, free + 2) if free else 1
    return ["".join("0" if i % groups in gone else "1" for i in range(n)) for gone in itertools.combinations(range(groups), free)]


def spaced_hashes(words: Words, mask: str) -> tuple[np.ndarray, np.ndarray]:
    """(first words, hashes) of the places where the mask fits in a document."""
    n = len(words.hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    out = np.full(n, int("1" + mask, 2), np.uint64)
    for i, c in enumerate(mask):
        if c == "1":
            out = out * np.uint64(0x9E3779B97F4A7C15) + words.hashes[i:i + n]
    document = words.documents()
    inside = np.flatnonzero(document[:n] == document[len(mask) - 1:])
    return inside, mixed(out[inside])


def item_hashes(item: Words, mask: str, whole: bool) -> tuple[np.ndarray, np.ndarray]:
    """spaced_hashes of items; of a mask over a whole item, those of the items of its length."""
    at, value = spaced_hashes(item, mask)
    own = np.diff(item.first)[item.documents()[at]] == len(mask) if whole else slice(None)
    return at[own], value[own]


def overlaps(text: Words, item: Words, place: np.ndarray, at: np.ndarray, doc: np.ndarray, which: np.ndarray, overlap: int, percent: int, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each hit (word ``place`` of the texts on word ``at`` of the items): the most agreeing words in a
    window around it, its length (0: no window fits) and its first word in the texts."""
    length = np.minimum(overlap, item.first[which + 1] - item.first[which])
    agree, aligned, first = np.zeros(len(place), np.int64), np.zeros(len(place), np.int64), np.zeros(len(place), np.int64)
    for lo in range(0, len(place), 20_000):
        p, a, d, w, size = (x[lo:lo + 20_000, None] for x in (place, at, doc, which, length))
        shift = np.arange(-overlap, overlap + span)[None, :]
        x, y = p + shift, a + shift
        there = (x >= text.first[d]) & (x < text.first[d + 1]) & (y >= item.first[w]) & (y < item.first[w + 1])
        same = there & (text.hashes[np.clip(x, 0, len(text.hashes) - 1)] == item.hashes[np.clip(y, 0, len(item.hashes) - 1)])
        total, fits = (np.concatenate([np.zeros((len(p), 1), np.int64), np.cumsum(v, axis=1)], axis=1) for v in (same, there))
        begin = np.arange(shift.shape[1])[None, :]
        end = begin + size
        ok = end <= shift.shape[1]
        end = np.minimum(end, shift.shape[1])
        count = np.where(ok & (np.take_along_axis(fits, end, 1) - fits[:, :-1] == size), np.take_along_axis(total, end, 1) - total[:, :-1], -1)
        best = count.argmax(axis=1)
        most = count[np.arange(len(p)), best]
        good = (100 * most >= percent * size[:, 0]) & (size[:, 0] >= 1)
        part = slice(lo, lo + len(p))
        agree[part], aligned[part], first[part] = most, np.where(good, size[:, 0], 0), x[np.arange(len(p)), best]
    return agree, aligned, first


def _leaks(text: Words, item: Words, place, at, ids: np.ndarray, items: np.ndarray, overlap: int, percent: int, span: int) -> pa.RecordBatch:
    """RESULT rows of the verified hits; the best for each document and item."""
    text_doc, item_doc = (np.searchsorted(w.first, x, side="right") - 1 for w, x in ((text, place), (item, at)))
    agree, aligned, first = overlaps(text, item, place, at, text_doc, item_doc, overlap, percent, span)
    good = np.flatnonzero(aligned)
    good = good[np.lexsort((first[good], -agree[good], item_doc[good], text_doc[good]))]
    pair = text_doc[good] * len(items) + item_doc[good]
    good = good[np.unique(pair, return_index=True)[1]]
    return pa.record_batch([pa.array(ids[text_doc[good]], pa.int64()), pa.array(items[item_doc[good]], pa.int64()), pa.array(agree[good].astype(np.int32)), pa.array(aligned[good].astype(np.int32)), pa.array(first[good] - text.first[text_doc[good]])], names=["doc_id", "item_id", "agree", "aligned", "at"])


def _lengths(batches):
    """The number of words of each item."""
    for batch in batches:
        yield pa.record_batch([pa.array(np.diff(plain_words(batch.column("text")).first).astype(np.int64))], names=["n"])


def _best(found: DataFrame) -> DataFrame:
    return found.groupBy("doc_id", "item_id").agg(F.min(F.struct(-F.col("agree"), -F.col("aligned"), "at")).alias("x")).select("doc_id", "item_id", (-F.col("x.col1")).alias("agree"), (-F.col("x.col2")).alias("aligned"), "x.at")


def _against_small(docs: DataFrame, items: pa.Table, masks, overlap: int, percent: int) -> DataFrame:
    sent, span = docs.sparkSession.sparkContext.broadcast(items), max(len(m) for m, _ in masks)

    def run(batches):
        ex.release()
        ids = sent.value.column("item_id").to_numpy()
        item = plain_words(sent.value.column("text").combine_chunks())
        tables = []
        for mask, whole in masks:
            at, value = item_hashes(item, mask, whole)
            order = np.argsort(value, kind="stable")
            bits = np.zeros(1 << 20, bool)
            bits[(value & np.uint64(0xFFFFF)).astype(np.int64)] = True
            tables.append((mask, at[order], value[order], bits))
        for batch in batches:
            text = plain_words(batch.column("text"))
            places, ats = [], []
            for mask, at, known, bits in tables:
                place, value = spaced_hashes(text, mask)
                likely = np.flatnonzero(bits[(value & np.uint64(0xFFFFF)).astype(np.int64)])
                lo, hi = np.searchsorted(known, value[likely]), np.searchsorted(known, value[likely], side="right")
                n = hi - lo
                places.append(np.repeat(place[likely], n))
                ats.append(at[np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())] if n.sum() else np.zeros(0, np.int64))
            place, at = np.concatenate(places), np.concatenate(ats)
            if len(place):
                yield _leaks(text, item, place, at, batch.column("doc_id").to_numpy(), ids, overlap, percent, span)

    return _best(docs.mapInArrow(run, RESULT))


def _against_large(docs: DataFrame, items: DataFrame, masks, overlap: int, percent: int) -> DataFrame:
    """Spark joins the hashes; candidates then meet their texts."""
    span = max(len(m) for m, _ in masks)

    def seeds(table: DataFrame, key: str) -> DataFrame:
        def run(batches):
            ex.release()
            for batch in batches:
                words, ids = plain_words(batch.column("text")), batch.column(key).to_numpy()
                for mask, whole in masks:
                    at, value = item_hashes(words, mask, whole) if key == "item_id" else spaced_hashes(words, mask)
                    doc = words.documents()[at]
                    yield pa.record_batch([pa.array(value.astype(np.int64)), pa.array(ids[doc]), pa.array(at - words.first[doc])], names=["seed", key, key + "_at"])

        return table.mapInArrow(run, f"seed long, {key} long, {key}_at long")

    def verify(batches):
        for batch in batches:
            text, item = plain_words(batch.column("text")), plain_words(batch.column("item_text"))
            n = np.arange(batch.num_rows)
            at = batch.column("item_id_at").to_numpy()
            found = [_leaks(text, item, text.first[n] + at + batch.column("diagonal").to_numpy(), item.first[n] + at, batch.column("doc_id").to_numpy(), batch.column("item_id").to_numpy(), overlap, percent, span)]
            yield from found

    # one hit for each stretch of a diagonal that a window around it covers
    hits = seeds(docs, "doc_id").join(seeds(items, "item_id"), "seed").select("doc_id", "item_id", (F.col("doc_id_at") - F.col("item_id_at")).alias("diagonal"), "item_id_at").distinct()
    near = hits.join(items.select("item_id", F.col("text").alias("item_text")), "item_id").join(docs, "doc_id")
    return _best(near.select("doc_id", "item_id", "diagonal", "item_id_at", "text", "item_text").mapInArrow(verify, RESULT))


def benchmark_leaks(docs: DataFrame, benchmark: DataFrame, masks: tuple[str, ...] = MASKS, overlap: int = 13, percent: int = 80, broadcast_bytes: int = 32 << 20, least_words: int = 5) -> DataFrame:
    """(doc_id, item_id, agree, aligned, at): each document that holds (a near copy of a part of) an item.

    ``at`` is the first word of the best window, in words without punctuation."""
    ex.ready(docs.sparkSession)
    docs = docs.filter("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    items = benchmark.filter("item_id is not null and text is not null").select(F.col("item_id").cast("long").alias("item_id"), "text").distinct()
    lengths = items.select("item_id", "text").mapInArrow(_lengths, "n long")
    short = sorted(x.n for x in lengths.filter(F.col("n").between(1, overlap - 1)).distinct().collect())
    masks = [(m, False) for m in masks] + [(m, True) for n in short if n >= least_words for m in whole_masks(n, percent)]
    size = items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0
    if size <= broadcast_bytes:
        return _against_small(docs, items.orderBy("item_id", "text").toArrow(), masks, overlap, percent)
    return _against_large(docs, items, masks, overlap, percent)
