"""Token counts of whole texts, huge ones by overlapping chunks.

A text of more than ``chunk`` characters is encoded in chunks that overlap, with offsets. Two neighbours are
spliced at a boundary that both have inside the overlap and that is stable: the text goes from other signs to
white space there, which ends a pre-token whatever stands before or after, and all tokens of both chunks
between that boundary and the next such one agree. Where no boundary qualifies, the overlap is widened,
in the end to the whole text.

Shorter texts are cut before each single blank, where this pre-tokenizer (byte-level, with the usual pattern)
always begins a token; words that a worker has counted are not encoded again. Texts with white space beyond
ASCII, and tokenizers of another kind, are encoded whole. Special strings in texts are handled as the library
does by default. Null texts count as empty; rows that repeat a doc_id are counted each."""

from __future__ import annotations

import json
import os
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex

CHUNK, OVERLAP = 1 << 15, 256
#: White space of the pre-tokenizer's pattern (or near it) that isn't one of ASCII's six.
_WIDE = re.compile("[\x1c-\x1f\x85\xa0 ᠎ -​    　﻿]")
_BEFORE_BLANK = re.compile(r"(?= [^ \t\n\v\f\r])")
_STABLE = re.compile(r"(?<=[!-~])(?=[ \t\n\v\f\r])")
_ODD = re.compile("  | [\t\n\v\f\r]| $")


class Counter:
    """Counts of a tokenizers or sentencepiece file."""

    def __init__(self, path: str, keep: int = 200_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.known: dict[str, int] = {}
        self.old: dict[str, int] = {}
        self.keep, self.widened, self.byte_level, self.piece = keep, 0, False, None
        if path.endswith(".model"):
            import sentencepiece

            self.piece = sentencepiece.SentencePieceProcessor(model_file=path)
            return
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path) as f:
            parts = json.load(f)
        before = parts.get("pre_tokenizer") or {}
        plain = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in parts.get("added_tokens", []))
        self.byte_level = before.get("type") == "ByteLevel" and before.get("use_regex", False) and not before.get("add_prefix_space") and parts.get("normalizer") is None and parts.get("post_processor") is None and plain

    def encode(self, text: str):
        return self.tokenizer.encode(text, add_special_tokens=False)

    def whole(self, text: str) -> int:
        if self.piece is not None:
            return len(self.piece.encode(text, num_threads=1))
        return len(self.encode(text).ids)

    def words(self, text: str) -> int:
        """The count of a text by its words."""
        if _ODD.search(text):
            parts = _BEFORE_BLANK.split(text)
        else:
            first, *rest = text.split(" ")
            parts = [first, *[" " + r for r in rest]]
        if len(self.known) > self.keep:
            self.old, self.known = self.known, {}
        known, old = self.known, self.old
        if missing := {p for p in parts if p not in known}:
            known.update((p, old[p]) for p in missing if p in old)
            new = [p for p in missing if p not in known]
            for p, found in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False), strict=True):
                known[p] = len(found.ids)
        return sum(map(known.__getitem__, parts))

    def spliced(self, text: str, chunk: int = CHUNK, overlap: int = OVERLAP) -> int:
        """The count of a huge text by overlapping chunks."""
        total, begin, at = 0, 0, 0  # the chunk begins at ``begin``; tokens before ``at`` are counted
        end = min(chunk, len(text))
        left = self.encode(text[:end])
        while end < len(text):
            wide, splice = overlap, None
            while splice is None and wide < len(text):
                start = max(at, end - wide)
                stop = min(start + max(chunk, 2 * wide), len(text))
                right = self.encode(text[start:stop])
                splice = self.boundary(text, begin, left, start, right, end)
                if splice is None:
                    self.widened += 1
                    if start == at:
                        break
                    wide *= 2
            if splice is None:  # nothing to splice at: the rest is one chunk
                return total + len(self.encode(text[at:]).ids)
            total += sum(at <= begin + s < splice for s, _ in left.offsets)
            begin, at, end, left = start, splice, stop, right
        return total + sum(begin + s >= at for s, _ in left.offsets)

    @staticmethod
    def boundary(text: str, a: int, left, b: int, right, end: int) -> int | None:
        """A stable boundary that both chunks (from ``a`` and from ``b``) have, before ``end``."""
        one = [(a + s, i) for (s, _), i in zip(left.offsets, left.ids, strict=True) if a + s >= b]
        two = [(b + s, i) for (s, _), i in zip(right.offsets, right.ids, strict=True) if b + s < end]
        places = [m.start() for m in _STABLE.finditer(text, b + 1, end)]
        for lo, hi in zip(places, places[1:], strict=False):
            x, y = [t for t in one if lo <= t[0] < hi], [t for t in two if lo <= t[0] < hi]
            if x and x == y and x[0][0] == lo:
                return lo
        return None

    def count(self, text: str, chunk: int = CHUNK) -> int:
        if not self.byte_level or _WIDE.search(text):
            return self.whole(text)
        return self.spliced(text, chunk) if len(text) > chunk else self.words(text)


def counter(path: str) -> Counter:
    """The worker's counter of a file."""
    return ex.held(("counts", path), lambda: Counter(path))


def token_counts(docs: DataFrame, path: str, limit: int = 512, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of each row. ``path``: a tokenizer's file that every node has."""
    ex.ready(docs.sparkSession)

    def run(batches):
        own = counter(path)
        for batch in batches:
            n = [own.count(t or "", chunk) for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("doc_id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["doc_id", "n_bytes", "n_tokens"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    return rows.mapInArrow(run, "doc_id long, n_bytes long, n_tokens long").withColumn("over_limit", F.col("n_tokens") > limit)
