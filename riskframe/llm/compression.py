"""Texts under zstandard dictionaries: what the two compression classifiers share.

A dictionary holds what texts of one kind have in common. A text compresses better with the dictionary of its
own kind, and the difference in bytes is the evidence."""

from __future__ import annotations

import zlib
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import mixed, words_of


def remainder(modulus: int):
    """crc32 of doc_id as text, by a modulus; null without doc_id."""
    return F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(modulus))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, per_class: int, text_bytes: int) -> tuple[list[tuple[bytes, int]], float]:
    """([(text, 0 or 1)], share of label 1 in all training labels; 0.5 without any): distinct texts of up to
    ``per_class`` documents of each label, chosen by a hash of the id.

    Only labels for which the column ``train`` holds, texts of ``text_bytes`` or fewer: both bound what the driver
    holds, and the chosen ids what is broadcast. A document with contradicting labels is left out, and so is a
    text that has both."""
    known = labels.filter(train).filter(f"{label} in (0, 1) and doc_id is not null").groupBy("doc_id").agg(F.min(label).alias("label"), F.max(label).alias("other")).filter("label = other")
    share = known.agg(F.avg("label")).first()[0]
    chosen = [known.filter(f"label = {v}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class) for v in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]).select("doc_id", F.col("label").cast("int").alias("label")))
    rows = docs.select("doc_id", "text").filter(f"length(text) > 0 and octet_length(text) <= {text_bytes}").join(ids, "doc_id")
    found: dict[str, set[int]] = {}
    table = rows.select("doc_id", "text", "label").toArrow().sort_by([("doc_id", "ascending"), ("text", "ascending")])
    for text, v in zip(table.column("text").to_pylist(), table.column("label").to_pylist(), strict=True):
        found.setdefault(text, set()).add(v)
    return [(t.encode(), y) for y in (0, 1) for t, v in found.items() if v == {y}], 0.5 if share is None else share


def windows_of(text: bytes, size: int) -> list[bytes]:
    """The text cut at white space into windows of about ``size`` bytes; long words are cut as they are."""
    out, at, n = [], 0, len(text)
    while at < n:
        end = min(at + size, n)
        if end < n and (cut := text.rfind(b" ", at + size // 2, end)) > 0:
            end = cut
        out.append(text[at:end])
        at = end
    return out


_LETTER = np.array([(b + 32 if 65 <= b < 91 else b) if b >= 128 or chr(b).isalpha() else 32 for b in range(256)], np.uint8)
SHORTEST, LONGEST = 4, 14


def prefix_codes(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes of 16 bytes, first code of each text and one more): every word of letters (A-Z as a-z) becomes one
    code for each of its prefixes of SHORTEST to LONGEST bytes.

    A code is as good as random, so a text of codes only compresses where it shares whole prefixes with what
    the compressor knows; single letters that happen to agree save nothing."""
    words = words_of([_LETTER[np.frombuffer(t or b"", np.uint8)].tobytes() for t in texts])
    size = words.ends - words.starts
    n = np.maximum(np.minimum(size, LONGEST) - SHORTEST + 1, 0)
    begin = np.concatenate([[0], np.cumsum(n)])
    out, value = np.zeros(begin[-1], np.uint64), np.zeros(len(size), np.uint64)
    for j in range(LONGEST):
        at = np.flatnonzero(size > j)
        value[at] = value[at] * np.uint64(0x9E3779B97F4A7C15) + words.data[words.starts[at] + j] + np.uint64(1)
        if j + 1 >= SHORTEST:
            out[begin[at] + j + 1 - SHORTEST] = value[at]
    one = mixed(out)
    return np.stack([one, mixed(one + np.uint64(1))], axis=1), begin[words.first]


def code_of(prefix: bytes) -> bytes:
    return prefix_codes([prefix])[0][-1].tobytes()


def apart(texts: list[bytes]) -> list[bytes]:
    """The texts without near copies of earlier ones: one for each least hash of three words."""
    out, seen = [], set()
    for t in texts:
        words = t.lower().split()
        least = min(zlib.crc32(b" ".join(words[i:i + 3])) for i in range(max(1, len(words) - 2)))
        if least not in seen:
            seen.add(least)
            out.append(t)
    return out


def prefixes(texts: list[bytes]) -> Counter:
    """In how many texts a word begins with each prefix."""
    count: Counter = Counter()
    for t in texts:
        words = set(_LETTER[np.frombuffer(t, np.uint8)].tobytes().split())
        count.update({w[:n] for w in words for n in range(SHORTEST, min(len(w), LONGEST) + 1)})
    return count


def stems(own: Counter, n: int, other: Counter, m: int, most: int, least_share: float = 0.01, least_ratio: float = 12) -> list[bytes]:
    """Beginnings of words far more frequent among the ``n`` texts of ``own`` than among the ``m`` of ``other``; none begins with another."""
    found = []
    for w, c in own.items():
        ratio = ((c + 0.5) / n) / ((other[w] + 0.5) / m)
        if c >= max(3, least_share * n) and ratio >= least_ratio:
            found.append((c / n * np.log(ratio) * len(w) ** 0.5, w))
    out: list[bytes] = []
    for _, w in sorted(found, reverse=True):
        if len(out) < most and not any(w.startswith(q) or q.startswith(w) for q in out):
            out.append(w)
    return out


@dataclass
class Coder:
    """Compressed lengths under one dictionary. It can be sent to tasks."""

    content: bytes
    level: int = 5
    _own: object = field(default=None, repr=False, compare=False)

    def __getstate__(self):
        return {"content": self.content, "level": self.level, "_own": None}

    def lengths(self, texts: list[bytes]) -> np.ndarray:
        if self._own is None:
            own = zstandard.ZstdCompressionDict(self.content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            own.precompute_compress(level=self.level)
            self._own = zstandard.ZstdCompressor(dict_data=own, level=self.level, write_content_size=False, write_checksum=False, write_dict_id=False)
        squeeze = self._own.compress
        return np.fromiter((len(squeeze(t)) for t in texts), np.int64, len(texts))


@dataclass
class Logistic:
    """A calibrated probability from a few standardised features."""

    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray

    @classmethod
    def fit(cls, x: np.ndarray, y: np.ndarray, share: float, ridge: float = 1e-2) -> Logistic:
        """``share``: of label 1 where the scores will be used; rows are weighted to it."""
        mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-9
        z = np.hstack([(x - mean) / scale, np.ones((len(x), 1))])
        weight = np.where(y == 1, share / y.mean(), (1 - share) / (1 - y.mean()))
        w = np.zeros(z.shape[1])
        for _ in range(60):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -30, 30)))
            step = np.linalg.solve((z * (weight * p * (1 - p))[:, None]).T @ z + ridge * np.eye(len(w)), z.T @ (weight * (y - p)) - ridge * w)
            w += np.clip(step, -5, 5)
            if abs(step).max() < 1e-8:
                break
        return cls(mean, scale, w)

    def __call__(self, x: np.ndarray) -> np.ndarray:
        z = np.hstack([(x - self.mean) / self.scale, np.ones((len(x), 1))])
        return 1 / (1 + np.exp(-np.clip(z @ self.weights, -30, 30)))
