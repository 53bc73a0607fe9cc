"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader.

Features are words, pairs and triples of words, each also with words replaced by what repeats in the text
(the distance to the same word before, up to a few) and by their form (last character, first character's kind, length), so
that patterns such as repeated words or marks between words carry over to words never seen. All are hashed
into 2**BITS slots, with log counts scaled to length 1. Training passes over at most TRAIN_ROWS labelled
documents, the first by a hash of their ids, whole, in one task; how many passes, training rows alone decide. Scoring is a sparse dot product for each document.

Cases: very long texts are used whole, as log counts; repeated documents each get a row, and the first of one doc_id is learnt from; equal
scores get equal answers, and a score of exactly the threshold is accepted; null or empty text has the bias alone as its feature; labels that are null, repeated with other values
or without a document are left out of training (the smallest label of a doc_id counts); without usable labels every score is 0.5;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import wordhash as H

BITS = 18
#: Most labelled documents that the classifier is fitted on.
TRAIN_ROWS = 8_000
#: Least passes over the training rows, and most updates of all passes where there are more.
EPOCHS, UPDATES = 3, 24_000
ALPHA, BETA, L1, L2 = 0.5, 1.0, 0.02, 1.0
FOLDS = 5
THRESHOLD = 0.3
#: Slots, values and label of a training row.
Row = tuple[np.ndarray, np.ndarray, int]


def _forms(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A small hash of each word's form: first byte's kind, last byte if it is a mark, length."""
    kind = np.zeros(256, np.int64)
    kind[ord("a") : ord("z") + 1], kind[ord("A") : ord("Z") + 1], kind[ord("0") : ord("9") + 1], kind[128:] = 1, 2, 3, 4
    for c in range(33, 128):
        if not kind[c]:
            kind[c] = c
    last = kind[raw[ends - 1]]
    return H.mix((kind[raw[starts]] * 4096 + np.where(last < 5, 0, last) * 16 + np.minimum(ends - starts, 12)).astype(np.uint64))


def features(raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Slots and values of each text."""
    mask = np.uint64((1 << BITS) - 1)
    hashes, at, starts, ends = H.words(raw, offsets)
    forms = _forms(raw, starts, ends)
    same = np.zeros(hashes.size, np.uint64)
    own = np.arange(hashes.size) - np.repeat(np.asarray(at[:-1]), np.diff(at))  # place in its own text
    for back in (3, 2, 1):
        same[back:][(hashes[back:] == hashes[:-back]) & (own[back:] >= back)] = back
    echo = H.mix(same + np.uint64(77))
    grams = []
    for salt, source, sizes in ((1, hashes, (1, 2)), (2, forms, (1, 2, 3)), (3, echo, (1, 2, 3))):
        grams += [(n, ((H.ngrams(source, n) + np.uint64(salt * 1_000_003 + n)) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BITS)) for n in sizes]
    for k in range(offsets.size - 1):
        a, b = at[k], at[k + 1]
        got = [(g[a : max(a, b - n + 1)] & mask) for n, g in grams]
        slots, counts = np.unique(np.concatenate(got), return_counts=True)
        values = 1 + np.log(counts)
        values /= np.sqrt((values**2).sum()) or 1.0
        yield np.concatenate([slots.astype(np.int64), [1 << BITS]]), np.concatenate([values, [0.3]])


class Regression:
    """Logistic regression over 2**BITS slots and the bias slot, by FTRL-proximal updates."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, slots: np.ndarray | slice) -> np.ndarray:
        z = self.z[slots]
        return np.where(np.abs(z) <= L1, 0.0, -(z - np.sign(z) * L1) / ((BETA + np.sqrt(self.n[slots])) / ALPHA + L2))

    def learn(self, rows: list[Row]) -> None:
        """One pass."""
        for slots, values, label in rows:
            ws, ns = self.weights(slots), self.n[slots]
            g = (1 / (1 + np.exp(-np.clip(ws @ values, -35, 35))) - label) * values
            self.z[slots] += g - (np.sqrt(ns + g * g) - np.sqrt(ns)) / ALPHA * ws
            self.n[slots] = ns + g * g

    def loss(self, rows: list[Row]) -> float:
        """Mean log loss, both labels of equal weight."""
        by_label: dict[int, list[float]] = {}
        for slots, values, label in rows:
            margin = float(np.clip(self.weights(slots) @ values, -35, 35)) * (1 if label else -1)
            by_label.setdefault(label, []).append(float(np.log1p(np.exp(-margin))))
        return sum(sum(v) / len(v) for v in by_label.values()) / max(1, len(by_label))


def passes(rows: list[Row]) -> int:
    """How often to go over the training rows: EPOCHS times, or more often if that lowers the loss on every fourth of them, learnt from the others.

    Few labels need more passes to move the weights as far; at most UPDATES updates are tried.
    """
    inner, rest = [r for k, r in enumerate(rows) if k % 4 != 0], rows[::4]
    most = max(EPOCHS, UPDATES // max(1, len(rows)))
    if most == EPOCHS or {label for _, _, label in inner} != {0, 1}:
        return EPOCHS
    model, best, least = Regression(), EPOCHS, np.inf
    for turn in range(1, most + 1):
        model.learn(inner)
        if turn >= EPOCHS and (turn & (turn - 1) == 0 or turn in (EPOCHS, most)) and (loss := model.loss(rest)) < least:
            best, least = turn, loss
    return best


def fit(rows: list[Row]) -> np.ndarray:
    """Weights of 2**BITS slots and the bias slot."""
    model = Regression()
    for _ in range(passes(rows)):
        model.learn(rows)
    return model.weights(slice(None)).astype(np.float32)


def _arrays(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    return H.buffers(pa.array(texts, pa.string()))


def held_out(doc_id: Column, folds: int = FOLDS) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == 0, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> np.ndarray | None:
    """Weights fitted on labelled documents outside the held-out fold; None without labels of both kinds."""
    usable = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.min("quality").cast("int").alias("label")).where(~held_out(F.col("doc_id")))
    order = F.xxhash64(F.lit(11), "doc_id")
    usable = usable.where("label in (0, 1)").orderBy(order, "doc_id").limit(rows)
    texts = usable.join(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).where("doc_id is not null"), "doc_id")
    picked = texts.dropDuplicates(["doc_id"]).select("text", "label", order.alias("at"), "doc_id").coalesce(1).sortWithinPartitions("at", "doc_id").select("text", "label")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        data, seen = [], set()
        for batch in batches:
            raw, offsets = H.buffers(batch.column(0))
            labels = batch.column(1).to_pylist()
            seen.update(labels)
            for a, b in H.chunks(offsets):
                part = features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                data += [(s.astype(np.int32), v.astype(np.float32), y) for (s, v), y in zip(part, labels[a:b], strict=True)]
        if {0, 1} <= seen:
            yield pa.RecordBatch.from_arrays([pa.array([fit(data).tobytes()], pa.binary())], names=["weights"])

    got = picked.mapInArrow(task, "weights binary").collect()
    return np.frombuffer(got[0].weights, np.float32) if got else None


def _scorer(docs: DataFrame, labels: DataFrame, train_rows: int):
    """A function from a string column's values to scores, for tasks."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels, train_rows))

    def score(column: pa.Array) -> np.ndarray:
        w = shared.value
        raw, offsets = H.buffers(column)
        if w is None:
            return np.full(len(column), 0.5)
        sums = [float(w[s] @ v) for a, b in H.chunks(offsets) for s, v in features(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]
        return 1 / (1 + np.exp(-np.clip(np.array(sums, np.float64), -35, 35)))

    return score


def quality_scores(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 is likelier), predicted (1 if score >= threshold)."""
    score = _scorer(docs, labels, train_rows)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(score(batch.column(1)), pa.float64())], names=["doc_id", "score"])

    out = docs.select("doc_id", "text").mapInArrow(tasks, "doc_id long, score double")
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """Rows of docs that score at least threshold, all columns, without a join."""
    score, at = _scorer(docs, labels, train_rows), docs.columns.index("text")

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(score(batch.column(at)) >= threshold))

    return docs.mapInArrow(tasks, docs.schema)
