"""Language-model scores from an Elias-Fano bigram trie.

The words of a document follow a start sign and end with an end sign. The model mixes bigrams and unigrams
(Dirichlet smoothing with ``prior`` observations): p(w | v) = (c(v w) + prior * p(w)) / (c(v) + prior), with
p(w) = (c(w) + 0.5) / (N + 0.5 * (V + 1)). Counts cover every training document.

Bigrams are dealt out over shards by Spark (the successors of one word over up to SPREAD shards, so a frequent word
is no hot spot), equal ones merged in each block of documents first. A shard writes its trie as memory-mapped
levels: the ordered words of level one; monotone pointers to their successors; successors as ordered values
relative to their context; all three Elias-Fano coded, beside 16-bit codes of the logarithm of N times the joint
probability of the pair. Blocks mix these with the unigrams, whose weight is c(v). A query finds the context's rank, then the first successor
not less than the word asked for within that context (select over the unary high bits, then the low bits). Each block of
documents asks for its distinct bigrams and gets codes back, so a shard never holds texts and a block never
holds the model.

Words are 64-bit hashes; successors keep 40 bits within a context. The quantisation error of a probability is
below 0.04 %. Null texts are empty: one end sign. Rows that repeat a doc_id are documents of their own; rows
without one are scored too, belong to no fold (``held_out`` is null) and teach nothing."""

from __future__ import annotations

import os
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .words import words_of

START, END = np.uint64(0x5EED0001), np.uint64(0x5EED0002)
SPREAD, KEEP = 16, 40
#: log10 of N * p(v w) from 0 to TOP in 16-bit steps; code 0: never seen.
TOP, CODES = 14.0, 65535
DOCUMENTS, WORDS, PAIRS, TOTALS, UNNAMED = 0, 1, 2, 3, 4
RESULT = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


class EliasFano:
    """An ordered sequence of non-negative integers in about 2 + log2(universe / n) bits each, on disk."""

    def __init__(self, folder: str, name: str, values: np.ndarray) -> None:
        self.n = n = len(values)
        top = int(values[-1]) + 1 if n else 1
        self.bits = max(0, min(56, (top // max(n, 1)).bit_length() - 1))
        high = (values >> np.uint64(self.bits)).astype(np.int64)
        unary = np.zeros((int(high[-1]) if n else 0) + n + 65, bool)
        unary[high + np.arange(n)] = True
        words = np.packbits(np.pad(unary, (0, -len(unary) % 64)), bitorder="little").view(np.uint64)
        low = np.zeros((n, self.bits), bool)
        for b in range(self.bits):
            low[:, b] = (values >> np.uint64(b)) & np.uint64(1)
        ones = np.concatenate([[0], np.cumsum(np.bitwise_count(words), dtype=np.int64)])
        self.words, self.ones = (self._mapped(folder, f"{name}.{k}", a) for k, a in (("high", words), ("rank", ones)))
        self.low = self._mapped(folder, f"{name}.low", np.concatenate([np.packbits(low.reshape(-1), bitorder="little"), np.zeros(8, np.uint8)]))
        self.window = np.ndarray(len(self.low) - 7, np.dtype("<u8"), self.low, strides=(1,))

    @staticmethod
    def _mapped(folder: str, name: str, a: np.ndarray) -> np.ndarray:
        path = os.path.join(folder, name)
        a.tofile(path)
        return np.memmap(path, a.dtype, "r", shape=a.shape) if a.size else a

    def low_of(self, i: np.ndarray) -> np.ndarray:
        at = i * self.bits
        return (self.window[at >> 3] >> (at & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def _select(self, k: np.ndarray, zeros: bool) -> np.ndarray:
        """Places of the k-th (from 0) zero or one of the high bits."""
        ranks = np.arange(len(self.ones)) * 64 - self.ones if zeros else self.ones
        word = np.searchsorted(ranks, k, side="right") - 1
        left, bits, at = (k - ranks[word]).astype(np.int64), self.words[word], np.zeros(len(k), np.int64)
        if zeros:
            bits = ~bits
        for step in (32, 16, 8, 4, 2, 1):
            count = np.bitwise_count(bits & np.uint64((1 << step) - 1)).astype(np.int64)
            go = left >= count
            left, bits, at = left - count * go, np.where(go, bits >> np.uint64(step), bits), at + step * go
        return word * 64 + at

    def value(self, i: np.ndarray) -> np.ndarray:
        """The i-th values."""
        return ((self._select(i, False) - i).astype(np.uint64) << np.uint64(self.bits)) | self.low_of(i)

    def successor(self, x: np.ndarray) -> np.ndarray:
        """The index of the first value not less than each x (n: none)."""
        high = np.minimum(x >> np.uint64(self.bits), np.uint64(len(self.words) * 64 - self.n - 1)).astype(np.int64)
        beyond = (x >> np.uint64(self.bits)) > high.astype(np.uint64)
        lo = np.where(high > 0, self._select(np.maximum(high - 1, 0), True) - np.maximum(high - 1, 0), 0)
        end = self._select(high, True) - high
        want, hi = x & np.uint64((1 << self.bits) - 1), end.copy()
        while (open_ := np.flatnonzero(lo < hi)).size:  # within the values of equal high bits
            mid = (lo[open_] + hi[open_]) >> 1
            less = self.low_of(mid) < want[open_]
            lo[open_[less]], hi[open_[~less]] = mid[less] + 1, mid[~less]
        return np.where(beyond, self.n, lo)


class Trie:
    """Two levels: contexts, and their successors with quantised probabilities."""

    def __init__(self, folder: str, context: np.ndarray, follower: np.ndarray, code: np.ndarray) -> None:
        """Rows ordered by context and follower (40 bits), each once."""
        self.contexts, start, rank = np.unique(context, return_index=True, return_inverse=True)
        self.level = EliasFano(folder, "contexts", self.contexts)
        self.pointers = EliasFano(folder, "pointers", np.append(start, len(context)).astype(np.uint64))
        self.followers = EliasFano(folder, "followers", (rank.astype(np.uint64) << np.uint64(KEEP)) | follower)
        self.codes = EliasFano._mapped(folder, "codes", code)

    def codes_of(self, context: np.ndarray, follower: np.ndarray) -> np.ndarray:
        """The code of each pair; 0 where the trie has it not."""
        out = np.zeros(len(context), np.uint16)
        if not self.level.n:
            return out
        rank = self.level.successor(context)
        known = np.flatnonzero(rank < self.level.n)
        known = known[self.level.value(rank[known]) == context[known]]
        rank, follower = rank[known], follower[known]
        want = (rank.astype(np.uint64) << np.uint64(KEEP)) | follower
        at, end = self.followers.successor(want), self.pointers.value(rank + 1).astype(np.int64)
        inside = np.flatnonzero(at < end)
        inside = inside[self.followers.value(at[inside]) == want[inside]]
        out[known[inside]] = self.codes[at[inside]]
        return out


class Block:
    """Tokens of the documents of a block, its distinct words and bigrams."""

    def __init__(self, own: dict[int, list[tuple[int, bytes]]], held: int, folds: int, shards: int, lower: bool) -> None:
        self.ids, texts = ex.documents_of([p for _, p in own.get(DOCUMENTS, [])])
        unnamed = ex.documents_of([p for _, p in own.get(UNNAMED, [])])[1]
        self.unnamed = np.arange(len(texts) + len(unnamed)) >= len(texts)
        words = words_of(texts + unnamed, lower)
        n = np.diff(words.first)
        self.size = n + 1
        self.first = np.concatenate([[0], np.cumsum(self.size)])
        self.tokens = np.full(self.first[-1], END, np.uint64)
        self.before = np.full(self.first[-1], START, np.uint64)
        at = np.arange(len(words.hashes)) + words.documents()
        self.tokens[at], self.before[at + 1] = words.hashes, words.hashes
        self.held = np.array([zlib.crc32(str(i).encode()) % folds == held for i in self.ids.tolist()] + [False] * len(unnamed), bool)
        self.ids = np.concatenate([self.ids, np.zeros(len(unnamed), np.int64)])
        trains = np.repeat(~self.held & ~self.unnamed, self.size)
        self.words, self.word = np.unique(self.tokens, return_inverse=True)
        self.word_count = np.bincount(self.word, trains, len(self.words)).astype(np.int64)
        follower = self.tokens & np.uint64((1 << KEEP) - 1)
        order = np.lexsort((follower, self.before))
        lead = np.append(True, (np.diff(self.before[order]) != 0) | (np.diff(follower[order]) != 0)) if len(order) else order > 0
        self.pair = np.zeros(len(order), np.int64)
        self.pair[order] = np.cumsum(lead) - 1
        self.context, self.follower = self.before[order][lead], follower[order][lead]
        self.pair_count = np.bincount(self.pair, trains, len(self.context)).astype(np.int64)
        salt = (self.follower >> np.uint64(8)) % np.uint64(SPREAD)
        self.shard = (((self.context >> np.uint64(16)) + salt * np.uint64(0x9E3779B1)) % np.uint64(shards)).astype(np.int64)


def asked(texts: DataFrame, shards: int, held: int, folds: int, lower: bool) -> DataFrame:
    """Bundles for shards: distinct words and bigrams of each block with their training counts."""

    def answer(key, own):
        b = Block(own, held, folds, shards, lower)
        small = b.pair_count.astype(np.uint32)
        low, top = (b.follower & np.uint64(0xFFFFFFFF)).astype(np.uint32), (b.follower >> np.uint64(32)).astype(np.uint8)
        rows = ex.dealt(((b.words >> np.uint64(16)) % np.uint64(shards)).astype(np.int64), [b.words, b.word_count], WORDS, key)
        return ex.bundles(rows + ex.dealt(b.shard, [b.context, low, top, small], PAIRS, key))

    return ex.by_key(texts, answer)


def answered(questions: DataFrame) -> DataFrame:
    """Each shard's answers to the blocks, in their order: counts of words, codes of bigrams; and its totals."""

    def answer(key, own):
        rows = []
        if WORDS in own:
            found = [(sender, *ex.unpack(p)) for sender, p in own[WORDS]]
            value, group = np.unique(np.concatenate([f[1] for f in found]), return_inverse=True)
            total = np.bincount(group, np.concatenate([f[2] for f in found]), len(value)).astype(np.int64)
            at = 0
            for sender, words, _ in found:
                rows.append((sender, WORDS, key, ex.pack(total[group[at:at + len(words)]])))
                at += len(words)
            rows.append((int(total.sum()), TOTALS, int((total > 0).sum()), b""))  # tokens and types, for Spark to add
        if PAIRS in own:
            context, follower, count, sizes = [], [], [], []
            for sender, p in own[PAIRS]:
                c, low, top, n = ex.unpack(p)
                context.append(c), follower.append(low.astype(np.uint64) | (top.astype(np.uint64) << np.uint64(32))), count.append(n), sizes.append((sender, len(c)))
            context, follower, count = np.concatenate(context), np.concatenate(follower), np.concatenate(count)
            order = np.lexsort((follower, context))
            c, f = context[order], follower[order]
            lead = np.append(True, (np.diff(c) != 0) | (np.diff(f) != 0))
            total = np.add.reduceat(count[order].astype(np.int64), np.flatnonzero(lead))
            c, f = c[lead], f[lead]
            seen = total > 0
            code = np.round(np.log10(total[seen]) / TOP * (CODES - 1)).astype(np.uint16) + np.uint16(1)
            with tempfile.TemporaryDirectory() as folder:
                trie = Trie(folder, c[seen], f[seen], code)
                at = 0
                for sender, n in sizes:
                    rows.append((sender, PAIRS, key, ex.pack(trie.codes_of(context[at:at + n], follower[at:at + n]))))
                    at += n
                del trie
        return ex.bundles(rows)

    return ex.by_key(questions, answer)


def scored(messages: DataFrame, shards: int, held: int, folds: int, tokens: int, types: int, prior: float, lower: bool) -> DataFrame:
    """RESULT rows of every document."""

    def answer(key, own):
        b = Block(own, held, folds, shards, lower)
        count = np.zeros(len(b.words), np.int64)
        home = ((b.words >> np.uint64(16)) % np.uint64(shards)).astype(np.int64)
        for shard, p in own.get(WORDS, []):
            count[home == shard] = ex.unpack(p)[0]
        code = np.zeros(len(b.context), np.uint16)
        order = np.argsort(b.shard, kind="stable")
        where, begin = np.unique(b.shard[order], return_index=True)
        begin = dict(zip(where.tolist(), begin.tolist(), strict=True))
        for shard, p in own.get(PAIRS, []):
            got = ex.unpack(p)[0]
            code[order[begin[shard]:begin[shard] + len(got)]] = got
        together = np.where(code > 0, 10.0 ** ((code.astype(np.float64) - 1) / (CODES - 1) * TOP), 0.0)
        base = (count + 0.5) / (tokens + 0.5 * (types + 1))
        # how often a context was followed: words as often as they occur, the start once for each document
        at = np.searchsorted(b.words, b.context)
        context = np.where(b.context == START, count[np.searchsorted(b.words, END)], count[np.minimum(at, len(b.words) - 1)])
        logs = np.log10(base)
        pair = np.log10((together[b.pair] + prior * base[b.word]) / (context[b.pair] + prior))
        total = [np.add.reduceat(x, b.first[:-1]) for x in (logs[b.word], pair, (count[b.word] > 0).astype(np.int64))]
        return pa.record_batch([pa.array(b.ids, mask=b.unnamed), pa.array(b.held, mask=b.unnamed), pa.array(b.size), pa.array(total[2]), pa.array(np.full(len(b.ids), tokens)), pa.array(total[0]), pa.array(total[1])], names=["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return ex.by_key(messages, answer, RESULT)


def score(docs: DataFrame, held: int = 1, folds: int = 5, prior: float = 32.0, lower: bool = False) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of each document; learns from those
    with crc32(doc_id) mod ``folds`` other than ``held``. ``lower`` maps A-Z first. An empty table gives an empty result."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    blocks = ex.n_blocks(docs)
    # Rows without an id are dealt out by their text; only those are asked for again.
    unnamed = docs.filter("doc_id IS NULL").withColumn("doc_id", F.xxhash64("text"))
    texts = ex.packed_documents(docs, blocks, DOCUMENTS).unionByName(ex.packed_documents(unnamed, blocks, UNNAMED))
    answers = ex.written(answered(asked(texts, blocks, held, folds, lower)))
    tokens, types = answers.filter(F.col("kind") == TOTALS).agg(F.sum("key"), F.sum("sender")).first()
    return scored(texts.unionByName(answers.filter(F.col("kind") != TOTALS)), blocks, held, folds, tokens or 0, types or 0, prior, lower)
