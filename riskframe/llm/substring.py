"""Substring de-duplication by repeated-phrase automata.

A window is ``window`` consecutive words of one document; a word goes if a window that covers it has the
words of a window that starts earlier (smaller doc_id, or earlier in the same document).

1. *Confirm recurring passages.* Each window is stood for by its anchor, the phrase of ``phrase`` words with
   the least hash in it (equal windows have equal anchors). Anchors are counted over all documents; only
   windows with a recurring anchor are looked at further. Their hashes meet in buckets, which tell each block
   of documents the windows whose first occurrence is elsewhere.
2. *Compile sharded automata.* Every block compiles an Aho-Corasick automaton (pyahocorasick, words spelled in
   three letters of a small alphabet) from the anchors of its recurring windows. A shard so holds what its documents can match,
   and its size is bounded by the block.
3. *Stream all documents* of the block through it. Each hit marks the windows around the phrase; these are
   held against the confirmed windows, and later occurrences are removed.

Windows are compared by a 64-bit hash among those that a second hash (of window and anchor) dealt to the same
bucket; the number of buckets grows with the bytes of text, and so do the bits that must agree. Null and empty texts have no words. Rows that
repeat a doc_id are documents of their own, in the order of their texts; rows without doc_id are left out."""

from __future__ import annotations

import hashlib

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .words import Words, member, mixed, run_starts, runs_hashed, words_of

DOCUMENTS, RECURRING, ELSEWHERE = 0, 1, 2
SPELL = 3
RESULT = "doc_id long, n_words long, n_removed long, kept_sha256 string, text string, changed boolean, text_sha256 string"


def anchors(words: Words, window: int, phrase: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first words of all windows, place of the anchor of each, hashes of all phrases).

    The anchor is the leftmost phrase with the least hash among those of the window."""
    at, grams = run_starts(words.first, window), runs_hashed(words.hashes, phrase)
    least, place, reach, want = grams, np.arange(len(grams)), 1, window - phrase + 1
    while reach < want:
        step = min(reach, want - reach)
        right = least[step:] < least[:-step]
        place = np.where(right, place[step:], place[:-step])
        least = np.where(right, least[step:], least[:-step])
        reach += step
    return at, place[at] if len(at) else at, grams


def window_hashes(words: Words, at: np.ndarray, anchor: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """Two values of 64 bits for each window, from its words and its anchor: the first is what windows are compared by, the second deals them out."""
    if not len(at):
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    every = runs_hashed(words.hashes, window)[at]
    return mixed(every ^ mixed(anchor)), mixed(every + anchor * np.uint64(0xA0761D6478BD642F))


def anchor_counts(docs: DataFrame, blocks: int, window: int, phrase: int) -> DataFrame:
    """Bundles for buckets of anchors: (anchor, block, 1 or 2 if it occurs more often there) merged over a batch."""
    ex.ready(docs.sparkSession)

    def run(batches):
        ex.release()
        for batch in batches:
            words = words_of(batch.column("text").cast(pa.binary()).to_pylist())
            at, place, grams = anchors(words, window, phrase)
            if not len(at):
                continue
            place = place[np.append(True, place[1:] != place[:-1])]  # one for each occurrence
            block = batch.column("block").to_numpy()[words.documents()[place]]
            pair, count = np.unique(np.array([grams[place], block.astype(np.uint64)]).T.copy().view([("a", "u8"), ("b", "u8")])[:, 0], return_counts=True)
            yield ex.bundles(ex.dealt((pair["a"] >> np.uint64(20)) % np.uint64(blocks), [pair["a"].copy(), pair["b"].astype(np.int32), np.minimum(count, 2).astype(np.uint8)], 0, 0))

    return docs.filter(F.col("doc_id").isNotNull()).select("text", F.pmod(F.xxhash64(F.col("doc_id").cast("long")), F.lit(blocks)).alias("block")).mapInArrow(run, ex.BUNDLE)


def recurring_anchors(counts: DataFrame) -> DataFrame:
    """Tell each block which of its anchors occur twice or more in all documents."""

    def answer(key, own):
        anchor, block, count = ex.gathered([p for _, p in own[0]], 3, "u8,i4,u1")
        group = np.unique(anchor, return_inverse=True)[1]
        again = np.bincount(group, count)[group] >= 2
        return ex.bundles(ex.dealt(block[again], [anchor[again]], RECURRING, key))

    return ex.by_key(counts, answer)


class Block:
    """The documents of one block, their windows, and which of those have a recurring anchor."""

    def __init__(self, own: dict, window: int, phrase: int) -> None:
        self.ids, self.texts = ex.documents_of([p for _, p in own.get(DOCUMENTS, [])])
        self.words = words_of(self.texts)
        self.at, self.place, self.grams = anchors(self.words, window, phrase)
        self.window, self.phrase = window, phrase

    def hashes(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return window_hashes(self.words, self.at[chosen], self.grams[self.place[chosen]], self.window)


def candidate_windows(messages: DataFrame, blocks: int, window: int, phrase: int) -> DataFrame:
    """Bundles for buckets of windows: (hash, document, place) of the first in this block, and if there are more of it."""

    def answer(key, own):
        b = Block(own, window, phrase)
        known = np.unique(ex.gathered([p for _, p in own.get(RECURRING, [])], 1, "u8")[0])
        chosen = np.flatnonzero(member(b.grams[b.place], known)) if len(b.at) else b.at
        every, deal = b.hashes(chosen)
        value, first, count = np.unique(every, return_index=True, return_counts=True)
        order = np.argsort(first)
        value, deal, first, count = value[order], deal[first[order]], chosen[first[order]], count[order]
        word = b.at[first]
        doc = b.words.documents()[word] if len(word) else word
        return ex.bundles(ex.dealt(deal % np.uint64(blocks), [value, b.ids[doc], (word - b.words.first[doc]).astype(np.int32), (count > 1).astype(np.uint8)], 0, key))

    return ex.by_key(messages, answer)


def first_elsewhere(windows: DataFrame) -> DataFrame:
    """Tell each block the recurring windows it holds: 1 where an earlier occurrence is in another block, else 0."""

    def answer(key, own):
        found = [(sender, *ex.unpack(p)) for sender, p in own[0]]
        value, doc, place, more = (np.concatenate([f[i] for f in found]) for i in (1, 2, 3, 4))
        block = np.repeat([f[0] for f in found], [len(f[1]) for f in found])
        order = np.lexsort((place, doc, value))
        value, block, more = value[order], block[order], more[order]
        lead = np.append(True, value[1:] != value[:-1])
        single = lead & np.append(lead[1:], True) & (more == 0)
        return ex.bundles(ex.dealt(block[~single], [value[~single], (~lead[~single]).astype(np.uint8)], ELSEWHERE, key))

    return ex.by_key(windows, answer)


def spelled(hashes: np.ndarray) -> bytes:
    """Words as SPELL letters of 64 each. Few letters keep the nodes of an automaton narrow, whose edges it searches in turn."""
    out = np.empty((len(hashes), SPELL), np.uint8)
    for i in range(SPELL):
        out[:, i] = (hashes >> np.uint64(58 - 6 * i)) & np.uint64(63)
    return out.tobytes()


def automaton_of(phrases: set[bytes]) -> ahocorasick.Automaton:
    """An automaton of spelled phrases."""
    out = ahocorasick.Automaton(ahocorasick.STORE_LENGTH)
    for phrase in phrases:
        out.add_word(phrase.decode("latin-1"))
    out.make_automaton()
    return out


def located(b: Block, automaton: ahocorasick.Automaton, letters: bytes) -> np.ndarray:
    """Windows of the block (by their number) that hold a phrase the automaton finds, document by document."""
    near, reach = np.zeros(len(b.words.hashes) + 1, np.int64), b.window - b.phrase
    for lo, hi in zip(b.words.first[:-1].tolist(), b.words.first[1:].tolist(), strict=True):
        if hi - lo >= b.window:
            ends = np.fromiter((end for end, _ in automaton.iter(letters[SPELL * lo:SPELL * hi].decode("latin-1"))), np.int64) + 1
            hits = ends[ends % SPELL == 0] // SPELL - b.phrase  # first words of the phrases
            np.add.at(near, np.maximum(hits - reach, 0) + lo, 1)
            np.add.at(near, hits + 1 + lo, -1)
    return np.flatnonzero(np.cumsum(near)[b.at] > 0)


def removed_words(b: Block, elsewhere: np.ndarray, recurring: np.ndarray) -> np.ndarray:
    """Which words of the block go. ``recurring``: ordered hashes of its recurring windows; ``elsewhere``: those that begin earlier in another block."""
    gone = np.zeros(len(b.words.hashes) + 1, np.int64)
    if not len(recurring):
        return gone[:-1] > 0
    # phrases come from windows that all documents together confirmed
    confirmed = np.flatnonzero(member(b.hashes(np.arange(len(b.at)))[0], recurring))
    letters, place = spelled(b.words.hashes), b.place[confirmed]
    starts = place[np.unique(b.grams[place], return_index=True)[1]].tolist()
    near = located(b, automaton_of({letters[SPELL * at:SPELL * (at + b.phrase)] for at in starts}), letters)
    value = b.hashes(near)[0]
    known = member(value, recurring)
    near, value = near[known], value[known]
    later = np.ones(len(near), bool)
    later[np.unique(value, return_index=True)[1]] = False
    at = b.at[near[later | member(value, elsewhere)]]
    np.add.at(gone, at, 1)
    np.add.at(gone, at + b.window, -1)
    return np.cumsum(gone)[:-1] > 0


def removed(messages: DataFrame, window: int, phrase: int, with_text: bool) -> DataFrame:
    """RESULT rows of every document."""

    def answer(_, own):
        b = Block(own, window, phrase)
        value, other = ex.gathered([p for _, p in own.get(ELSEWHERE, [])], 2, "u8,u1")
        gone = removed_words(b, np.sort(value[other == 1]), np.sort(value))
        rows = []
        for doc, text in enumerate(b.texts):
            lo, hi = int(b.words.first[doc]), int(b.words.first[doc + 1])
            n, kept = int(gone[lo:hi].sum()), (text or b"").split()
            if n:
                kept = [w for w, g in zip(kept, gone[lo:hi].tolist(), strict=True) if not g]
            joined = b" ".join(kept)
            rows.append((hi - lo, n, hashlib.sha256(joined).hexdigest(), (joined if n else text) if with_text else None, n > 0, hashlib.sha256(text).hexdigest() if with_text and text is not None else None))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.bool_(), pa.string())
        columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
        columns[3] = columns[3].cast(pa.string())
        return pa.record_batch([pa.array(b.ids), *columns], names=["doc_id", "n_words", "n_removed", "kept_sha256", "text", "changed", "text_sha256"])

    return ex.by_key(messages, answer, RESULT)


def substring_dedup(docs: DataFrame, window: int = 20, phrase: int = 6, with_text: bool = False) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256, text, changed, text_sha256) for each document with an id.

    ``text_sha256`` names the text as it was; null unless ``with_text``. ``text`` is null unless ``with_text``: then the kept words joined by a space where words went, else the
    text as it is. An empty table gives an empty result."""
    if not 1 <= phrase <= window:
        raise ValueError("a phrase has from one word to the words of a window")
    docs = docs.select("doc_id", "text")
    blocks = ex.n_blocks(docs)
    texts = ex.packed_documents(docs, blocks, DOCUMENTS)
    anchors_known = recurring_anchors(anchor_counts(docs, blocks, window, phrase))
    windows = candidate_windows(texts.unionByName(anchors_known), blocks, window, phrase)
    return removed(texts.unionByName(ex.written(first_elsewhere(windows))), window, phrase, with_text)
