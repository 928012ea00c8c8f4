"""Language identification by hyperdimensional profiles.

Every letter has a random vector of ``dims`` signs; an n-gram binds its letters' vectors, each permuted by its
place, by multiplication; a text or a language is the sum (bundle) of its n-gram vectors, and the answer is
the language whose prototype is nearest by cosine. Bundling is linear, so Spark only sums counts of n-grams by
language and the prototype is made once from the sums; its size depends on the alphabet and the languages
alone.

Letters are folded to 32 symbols: white space and other signs, a-z, and five classes that other letters share
by code point. ``und``: null texts, texts without a letter, or no language learned. A tie goes to the first
language by name. Rows that repeat a doc_id are scored each; lang values are learned as they are."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .compression import remainder
from .words import mixed

SYMBOLS, GRAM = 32, 3
GRAMS = SYMBOLS ** GRAM
#: Texts and characters worked on at once, and vectors of n-grams held as floats at once.
TEXTS, CHARS, ROWS = 64, 1 << 18, 256
_FOLDED: dict[str, np.ndarray] = {}


def symbols() -> np.ndarray:
    """The symbol of each code point: 0 for what is no letter."""
    if "table" not in _FOLDED:
        out = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()[0]
                out[c] = ord(low) - 96 if "a" <= low <= "z" else 27 + ord(low) % 5
        _FOLDED["table"] = out
    return _FOLDED["table"]


def portions(texts: list[str]) -> Iterator[slice]:
    """Texts side by side that are worked on at once; a longer one comes alone."""
    start = chars = 0
    for end, text in enumerate(texts):
        if end > start and (end - start == TEXTS or chars + len(text) > CHARS):
            yield slice(start, end)
            start, chars = end, 0
        chars += len(text)
    if len(texts) > start:
        yield slice(start, len(texts))


def grams_of(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams, the number of the text of each); a text without a letter has none."""
    own = symbols()[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)]
    text = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    first = np.concatenate([[True], text[1:] != text[:-1]])[:len(text)]
    kept = first | (own != 0)
    kept[1:] |= own[:-1] != 0  # runs of other signs count once
    own, text, first = own[kept].astype(np.int32), text[kept], first[kept]
    before, after = np.zeros_like(own), np.zeros_like(own)
    before[1:], after[:-1] = np.where(first[1:], 0, own[:-1]), np.where(first[1:], 0, own[1:])
    grams = (before * SYMBOLS + own) * SYMBOLS + after
    some = grams != 0  # three other signs in a row: only where a text holds nothing else
    return grams[some], text[some]


def gram_vectors(dims: int) -> np.ndarray:
    """The vector of each n-gram: the product of its letters' vectors, rolled by their distance from the end."""
    bits = mixed(np.arange(SYMBOLS * dims, dtype=np.uint64) + np.uint64(1)) >> np.uint64(63)
    letters = (bits.astype(np.int8) * 2 - 1).reshape(SYMBOLS, dims)
    out = letters
    for _ in range(GRAM - 1):
        out = (np.roll(out, 1, axis=1)[:, None, :] * letters[None, :, :]).reshape(-1, dims)
    return out


def bundles_of(texts: list[str], vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sum of the n-gram vectors of each text, whether it has a letter).

    A vector is read once for all texts instead of once for each. Sums are whole numbers, exact below 2 ** 24 in any order."""
    grams, text = grams_of(texts)
    place = np.zeros(GRAMS, np.int64)
    place[grams] = 1
    at = np.flatnonzero(place)
    place[at] = np.arange(len(at))
    counts = np.bincount(text * len(at) + place[grams], minlength=len(texts) * len(at)).reshape(len(texts), len(at)).astype(np.float32)
    out, rows = np.zeros((len(texts), vectors.shape[1]), np.float32), np.empty((min(ROWS, len(at)), vectors.shape[1]), np.float32)
    for s in range(0, len(at), ROWS):
        own = rows[:len(at) - s]
        own[:] = vectors[at[s:s + ROWS]]
        out += counts[:, s:s + ROWS] @ own
    return out, np.bincount(text, minlength=len(texts)) > 0


def language_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n): n-grams of all texts of a language; merged in each task before the shuffle."""
    ex.ready(docs.sparkSession)

    def run(batches):
        ex.release()
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            texts: dict[str, list[str]] = {}
            for text, lang in zip(batch.column("text").to_pylist(), batch.column("lang").to_pylist(), strict=True):
                texts.setdefault(lang, []).append(text)
            for lang, own in texts.items():
                for part in portions(own):
                    if len(grams := grams_of(own[part])[0]):
                        if lang not in sums:
                            sums[lang] = np.zeros(GRAMS, np.int64)
                        sums[lang] += np.bincount(grams, minlength=GRAMS)
        for lang, total in sums.items():
            at = np.flatnonzero(total)
            yield pa.record_batch([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], names=["lang", "gram", "n"])

    return docs.filter("text is not null and lang is not null").select("text", "lang").mapInArrow(run, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def identify(docs: DataFrame, dims: int = 1024) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of each row; learns from rows with crc32(doc_id) mod 4 other than 2.

    ``score`` is the share of the nearest language when cosines are compared at the scale at which languages
    differ: 1 / number of languages for a text like all of them, near 1 for a clear one; 0 for ``und``."""
    fold = remainder(4)
    counts = language_counts(docs.select("doc_id", "text", "lang").filter(fold != 2)).toArrow()
    lang, gram, n = (counts.column(c).to_numpy() for c in ("lang", "gram", "n"))
    names = sorted(set(lang.tolist()))
    total = np.zeros((len(names), GRAMS))
    total[np.searchsorted(names, lang) if len(names) else [], gram] = n
    vectors = gram_vectors(dims)
    prototypes = total @ vectors.astype(np.float32) if len(names) else np.zeros((0, dims))
    prototypes /= np.maximum(np.linalg.norm(prototypes, axis=1, keepdims=True), 1e-12)
    sent = docs.sparkSession.sparkContext.broadcast((names, prototypes.astype(np.float32)))

    def run(batches):
        (names, prototypes), vectors = sent.value, ex.held((__name__, dims), lambda: gram_vectors(dims))
        for batch in batches:
            texts, best, score = [t or "" for t in batch.column("text").to_pylist()], [], []
            for part in portions(texts):
                for bundle, lettered in zip(*bundles_of(texts[part], vectors), strict=True):
                    if not lettered or not names:
                        best.append("und"), score.append(0.0)
                        continue
                    cosine = prototypes @ (bundle / max(float(np.linalg.norm(bundle)), 1e-12))
                    share = np.exp((cosine - cosine.max()) * 10)
                    best.append(names[int(cosine.argmax())]), score.append(float(share.max() / share.sum()))
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == 2).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
