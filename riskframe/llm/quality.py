"""Quality by compression: dictionaries of good and of bad labelled text.

A text is compressed with both zstandard dictionaries; the difference of the two sizes, divided by the size of
the text, says which kind it is like. The same difference of its windows (least, and share of windows that
lean to the bad side) shows texts that are bad in part, and the normalised compressed size itself shows
repetition. A logistic fit on labelled rows kept apart from the dictionaries calibrates the score.

Trained on at most ``per_class`` texts of each label (a documented bound). Null and empty texts are calibrated
as a text without evidence. Where one label is missing, the score is the share of the other one: 0, 1, or 0.5
without any label. Rows that repeat a doc_id are scored each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .compression import Coder, Logistic, labelled_sample, remainder, windows_of

WINDOW = 400
DICTIONARY = 24 << 10


def dictionary_of(texts: list[bytes]) -> bytes:
    """A trained zstandard dictionary of windows of texts; their plain join where there is too little to train on."""
    parts = [w for t in texts for w in windows_of(t, WINDOW)]
    try:
        return zstandard.train_dictionary(DICTIONARY, parts, k=64, d=6).as_bytes()
    except zstandard.ZstdError:
        return b"".join(parts)[-DICTIONARY:] or b" "


@dataclass
class QualityModel:
    good: Coder
    bad: Coder
    plain: Coder
    calibrated: Logistic | None
    share: float

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """Normalised differences of the text and of its windows, and normalised sizes, of each text."""
        out = np.zeros((len(texts), 6))
        cut = [windows_of(t or b"", WINDOW) for t in texts]
        flat = [w for c in cut for w in c]
        size = np.array([len(w) for w in flat], float)
        good, bad, plain = (c.lengths(flat) for c in (self.good, self.bad, self.plain))
        lean, rate, at = (bad - good) / (size + 8), plain / (size + 8), 0
        for i, c in enumerate(cut):
            if c:
                part = slice(at, at + len(c))
                own, whole = lean[part], size[part].sum()
                out[i] = (bad[part].sum() - good[part].sum()) / whole, own.min(), (own < -0.02).mean(), good[part].sum() / whole, rate[part].min(), np.log1p(len(c))
            at += len(c)
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.calibrated is None:
            return np.full(len(texts), self.share)
        return self.calibrated(self.features(texts))


def train(sample: list[tuple[bytes, int]], share: float) -> QualityModel:
    """The model of labelled texts; ``share``: label 1 among all labelled rows."""
    bad, bad_check, good, good_check = [[t for i, (t, v) in enumerate(sample) if v == y and (i % 3 == 2) == last] for y in (0, 1) for last in (False, True)]
    if not bad or not good or not bad_check or not good_check:
        return QualityModel(Coder(b" "), Coder(b" "), Coder(b" "), None, share)
    model = QualityModel(Coder(dictionary_of(good)), Coder(dictionary_of(bad)), Coder(b" "), None, 0.5)
    y = np.array([0] * len(bad_check) + [1] * len(good_check))
    model.calibrated = Logistic.fit(model.features(bad_check + good_check), y, share)
    return model


def quality(docs: DataFrame, labels: DataFrame, per_class: int = 2000, text_bytes: int = 1 << 16) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; learns from rows with crc32(doc_id) mod 4 other than 2."""
    ex.ready(docs.sparkSession)
    fold = remainder(4)
    rows = docs.select("doc_id", "text")
    model = train(*labelled_sample(rows, labels, "quality", fold != 2, per_class, text_bytes))
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        ex.release()
        for batch in batches:
            score = sent.value.scores(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.7).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.select(F.col("doc_id").cast("long").alias("doc_id"), (fold == 2).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
