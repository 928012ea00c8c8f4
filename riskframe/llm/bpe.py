"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash of the last bytes cuts every text where its bytes say so; equal passages of different documents
so give equal chunks, wherever they stand. A chunk is encoded once by a worker and kept (bounded by bytes) for
all documents of its tasks. A cut may fall inside a word, so the ids around a join can differ from those of the
whole text: of each chunk only the part between its first and last white space is kept as ids; what stands
around a join is put together again, widened to the next chunks until white space bounds it on both sides, and
encoded anew. Before ASCII white space this tokenizer can't join anything, so there the parts agree exactly
with the whole.

That holds for tokenizers whose pre-tokenizer drops white space and that have no decoder, template or added
token which spans it; ``check`` says so for a file, and others encode whole texts. Null texts are encoded as
empty ones; rows that repeat a doc_id are encoded each."""

from __future__ import annotations

import hashlib
import json
import os

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex

#: Chunks of about 2 ** CUT_BITS bytes, by a hash of the last SPAN bytes.
CUT_BITS, SPAN = 8, 16
_BLANK = b" \t\n\v\f\r"
_GEAR = np.random.default_rng(7).integers(0, 1 << 63, 256, dtype=np.uint64)


def cuts(text: bytes) -> list[int]:
    """Where the chunks of a text end: wherever the rolling hash of the last bytes has zeros on top."""
    if len(text) <= SPAN:
        return [len(text)] if text else []
    gear = _GEAR[np.frombuffer(text, np.uint8)]
    rolled, reach = gear, 1
    while reach < SPAN:  # the hash of 2n bytes from two hashes of n
        rolled = (rolled[:-reach] << np.uint64(reach)) + rolled[reach:]
        reach *= 2
    at = np.flatnonzero((rolled & np.uint64(((1 << CUT_BITS) - 1) << SPAN)) == 0) + SPAN
    out = at.tolist()
    return out if out and out[-1] == len(text) else [*out, len(text)]


class Encoder:
    """Ids and decoded texts of a tokenizer's file, with kept chunks and pieces."""

    def __init__(self, path: str, keep_pieces: int = 100_000, keep_chunk_bytes: int = 12 << 20) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.apart, self.keep, self.keep_bytes = self.check(path), keep_pieces, keep_chunk_bytes
        # kept in two generations: what is in use moves to the young one, the old one is let go
        self.pieces: dict[bytes, tuple[bytes, str]] = {}
        self.old_pieces: dict[bytes, tuple[bytes, str]] = {}
        self.chunks: dict[bytes, tuple[bytes, bytes, list[str], bytes] | None] = {}
        self.old_chunks: dict[bytes, tuple[bytes, bytes, list[str], bytes] | None] = {}
        self.held = self.hits = 0

    @staticmethod
    def check(path: str) -> bool:
        """Whether texts can be encoded and decoded in parts that meet at white space."""
        with open(path) as f:
            parts = json.load(f)
        steps = [(s.get("type"), s.get("behavior"), s.get("invert")) for s in (parts.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        pattern = [s["pattern"].get("Regex", "") for s in (parts.get("pre_tokenizer") or {}).get("pretokenizers", []) if s.get("type") == "Split"]
        drops = steps[:1] == [("Split", "Removed", True)] and "\\s" in pattern[0] and all(x.endswith("]+") or x.startswith("'") or x.startswith("[") for x in pattern[0].split("|"))
        plain = all(not any(c.isspace() for c in t["content"]) and not t["lstrip"] and not t["rstrip"] and not t["single_word"] for t in parts.get("added_tokens", []))
        return drops and plain and parts.get("decoder") is None and parts.get("post_processor") is None

    def learn(self, pieces: list[bytes]) -> None:
        """Encode pieces that aren't known, in one call."""
        known, old, new = self.pieces, self.old_pieces, []
        for p in {p for p in pieces if p not in known}:
            if p in old:
                known[p] = old[p]
            else:
                new.append(p)
        found = [f.ids for f in self.tokenizer.encode_batch_fast([p.decode() for p in new], add_special_tokens=False)]
        for p, ids, text in zip(new, found, self.tokenizer.decode_batch(found, skip_special_tokens=False), strict=True):
            known[p] = np.array(ids, "<u4").tobytes(), text

    def encoded(self, piece: bytes) -> tuple[bytes, str]:
        if piece not in self.pieces:
            self.learn([piece])
        return self.pieces[piece]

    def chunk(self, data: bytes) -> tuple[bytes, bytes, list[str], bytes] | None:
        """(bytes before the first white space, ids and decoded words between, bytes after the last); None without white space."""
        if data in self.chunks:
            self.hits += 1
            return self.chunks[data]
        self.held += 400 + 3 * len(data)
        if data in self.old_chunks:
            self.hits += 1
            out = self.chunks[data] = self.old_chunks[data]
            return out
        words = data.split()
        if not any(data.find(b) >= 0 for b in (b" ", b"\n", b"\t", b"\r", b"\v", b"\f")):
            out = None
        else:
            head = words.pop(0) if words and data[0] not in _BLANK else b""
            tail = words.pop() if words and data[-1] not in _BLANK else b""
            known = [self.encoded(w) for w in words]
            out = head, b"".join(k[0] for k in known), [k[1] for k in known if k[1]], tail
        self.chunks[data] = out
        return out

    def text(self, text: bytes) -> tuple[bytes, str]:
        """(ids as little-endian unsigned 32-bit integers, decoded text)."""
        if not self.apart:
            ids = self.tokenizer.encode(text.decode(), add_special_tokens=False).ids
            return np.array(ids, "<u4").tobytes(), self.tokenizer.decode(ids, skip_special_tokens=False)
        ids, words, join, at = [], [], b"", 0

        def repaired() -> None:
            if join:
                own, decoded = self.encoded(join)
                ids.append(own)
                if decoded:
                    words.append(decoded)

        for end in cuts(text):
            found = self.chunk(text[at:end])
            if found is None:
                join += text[at:end]  # the join is wider than this chunk
            else:
                join += found[0]
                repaired()
                ids.append(found[1])
                words += found[2]
                join = found[3]
            at = end
        repaired()
        return b"".join(ids), " ".join(words)

    def batch(self, texts: list[bytes]) -> list[tuple[bytes, str]]:
        if len(self.pieces) > self.keep:
            self.old_pieces, self.pieces = self.pieces, {}
        if self.held > self.keep_bytes:
            self.old_chunks, self.chunks, self.held = self.chunks, {}, 0
        if self.apart:
            self.learn([w for t in texts for w in t.split()])
        return [self.text(t) for t in texts]


def encoder(path: str) -> Encoder:
    """The worker's encoder of a file."""
    return ex.held(("bpe", path), lambda: Encoder(path))


def encode_decode(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256, ids) of each row; ``ids`` is null unless ``with_ids``.

    ``path``: a tokenizers file that every node has."""
    ex.ready(docs.sparkSession)

    def run(batches):
        own = encoder(path)
        for batch in batches:
            texts = [t or b"" for t in batch.column("text").cast(pa.binary()).to_pylist()]
            columns: list[list] = [[], [], [], []]
            for at in range(0, len(texts), 64):
                for ids, decoded in own.batch(texts[at:at + 64]):
                    for c, v in zip(columns, (len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest(), np.frombuffer(ids, "<u4") if with_ids else None), strict=True):
                        c.append(v)
            yield pa.record_batch([batch.column("doc_id"), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string()), pa.array(columns[3], pa.list_(pa.int64()))], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string, ids array<long>")
