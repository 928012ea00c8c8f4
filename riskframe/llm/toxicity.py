"""Toxicity by compression distance.

Two zstandard dictionaries are trained, one on toxic and one on ordinary labelled text: what is frequent in
all texts, then beginnings of words that are far more frequent in that kind (near copies in the training
texts count once). Texts are recoded so that only whole beginnings of words can match, and every window is
compressed with both dictionaries. The largest and the summed difference of lengths over the windows of a
text, in a logistic fit, become a calibrated probability; its threshold is the decision.

Trained on at most ``per_class`` texts of each label (a documented bound); the fit sees each text scored by
dictionaries of other texts. Null and empty texts score as a text without evidence. Where a label has fewer than three texts, the
score is the share of the other one: 0, 1, or 0.5 without any label. Rows that repeat a doc_id are scored
each."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import exchange as ex
from .compression import Coder, Logistic, apart, code_of, labelled_sample, prefix_codes, prefixes, remainder, stems

#: Codes in a window, and bytes before it that always compress, so that a small gain shows.
WINDOW, CARRIER = 120, bytes(64)
LEVEL = 3
#: Bytes that one shared code saves, about.
GAIN = 12
FOLDS = 3
#: Words that both dictionaries hold.
SHARED = 60


@dataclass
class ToxicityModel:
    toxic: Coder
    ordinary: Coder
    calibrated: Logistic | None
    share: float

    def features(self, texts: list[bytes | None]) -> np.ndarray:
        """(largest gain of a window, log of all gains, log of windows) of each text, in shared codes."""
        codes, first = prefix_codes(texts)
        data, width = codes.tobytes(), 16 * WINDOW
        cut = [range(16 * lo, 16 * hi, width) for lo, hi in zip(first[:-1].tolist(), first[1:].tolist(), strict=True)]
        flat = [CARRIER + data[at:min(at + width, c.stop)] for c in cut for at in c]
        gain = (self.ordinary.lengths(flat) - self.toxic.lengths(flat)) / GAIN
        out, at = np.zeros((len(texts), 3)), 0
        for i, c in enumerate(cut):
            if own := gain[at:at + len(c)].tolist():
                out[i] = min(max(max(own), 0), 4), np.log1p(sum(g for g in own if g > 0.5)), np.log1p(len(c))
            at += len(c)
        return out

    def scores(self, texts: list[bytes | None]) -> np.ndarray:
        if self.calibrated is None:
            return np.full(len(texts), self.share)
        return self.calibrated(self.features(texts))


def dictionaries(toxic: list[bytes], ordinary: list[bytes]) -> tuple[Coder, Coder]:
    """One of toxic and one of ordinary texts."""
    toxic, ordinary = apart(toxic), apart(ordinary)
    a, b = prefixes(toxic), prefixes(ordinary)
    shared = b"".join(code_of(w) for _, w in sorted(((c, w) for w, c in b.items()), reverse=True)[:SHARED])
    marks, calm = (b"".join(code_of(w) for w in x) for x in (stems(a, len(toxic), b, len(ordinary), 1000), stems(b, len(ordinary), a, len(toxic), 1000)))
    return Coder(CARRIER + marks + shared, LEVEL), Coder(CARRIER + calm + shared, LEVEL)


def train(sample: list[tuple[bytes, int]], share: float) -> ToxicityModel:
    """The model of labelled texts; ``share``: label 1 among all labelled rows."""
    by_label = [[t for t, v in sample if v == y] for y in (0, 1)]
    if min(map(len, by_label)) < FOLDS:
        return ToxicityModel(Coder(b" "), Coder(b" "), None, share)
    x, y = [], []
    for fold in range(FOLDS):  # calibrated on texts that the dictionaries have not seen
        ordinary, toxic = ([t for i, t in enumerate(texts) if i % FOLDS != fold] for texts in by_label)
        checked = [texts[fold::FOLDS] for texts in by_label]
        x.append(ToxicityModel(*dictionaries(toxic, ordinary), None, share).features(checked[0] + checked[1]))
        y += [0] * len(checked[0]) + [1] * len(checked[1])
    return ToxicityModel(*dictionaries(by_label[1], by_label[0]), Logistic.fit(np.concatenate(x), np.array(y), share), share)


def learned(docs: DataFrame, labels: DataFrame, per_class: int = 2000, text_bytes: int = 1 << 16) -> ToxicityModel:
    """The model of rows with crc32(doc_id) mod 5 other than 0."""
    return train(*labelled_sample(docs, labels, "toxic", remainder(5) != 0, per_class, text_bytes))


def toxicity(docs: DataFrame, labels: DataFrame, per_class: int = 2000, text_bytes: int = 1 << 16) -> DataFrame:
    """(doc_id, held_out, score, predicted) of each row; learns from rows with crc32(doc_id) mod 5 other than 0."""
    ex.ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, per_class, text_bytes))

    def run(batches):
        ex.release()
        for batch in batches:
            score = sent.value.scores(batch.column("text").cast(pa.binary()).to_pylist())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), (remainder(5) == 0).alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")


def without_toxic(docs: DataFrame, labels: DataFrame, per_class: int = 2000, text_bytes: int = 1 << 16) -> DataFrame:
    """The rows, in all their columns, whose text scores below 0.5."""
    ex.ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(learned(docs, labels, per_class, text_bytes))

    def run(batches):
        ex.release()
        for batch in batches:
            yield batch.filter(pa.array(sent.value.scores(batch.column("text").cast(pa.binary()).to_pylist()) < 0.5))

    return docs.mapInArrow(run, docs.schema)
