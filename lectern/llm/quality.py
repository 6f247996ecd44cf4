"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader updates.

A text's features are hashed n-grams of its words and of its words' shapes. Training streams a bounded sample of
labelled texts through one task; scoring is a sparse dot product for each text, with the weights broadcast.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lectern.llm.base import REMEMBERED_WORDS, Hashes, cut, mixed, raw, slices

BITS = 20
#: The classifier is fitted on so many labelled texts at most, those with the least digests of their ids.
MOST_TRAINED = 16_000
RUNS = re.compile(r"(.)\1+", re.S)


class Shapes(dict):
    """Hashes of words' shapes: letters become x or X, digits 0, and runs of a character one."""

    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED_WORDS:
            self.clear()
        shape = "".join("X" if c.isupper() else "x" if c.isalpha() else "0" if c.isdigit() else c for c in word.decode("utf-8", "replace"))
        self[word] = value = xxhash.xxh3_64_intdigest(RUNS.sub(r"\1", shape).encode())
        return value


def features(texts: list[bytes | None], words: Hashes, shapes: Shapes, bits: int = BITS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of all texts, and where each text's begin (one more offset at the end).

    Words and pairs of words; one, two and three shapes; and whether a word repeats the one before. Each of a
    text's n words has six of them; n-grams at its end reach past it as if followed by nothing.
    """
    split = [(t or b"").split() for t in texts]
    counts = np.array([len(own) for own in split], np.int64)
    total = int(counts.sum())
    w = np.fromiter((words[x] for own in split for x in own), np.uint64, total)
    s = np.fromiter((shapes[x] for own in split for x in own), np.uint64, total)
    offsets = np.concatenate(([0], np.cumsum(counts)))
    owner = np.repeat(np.arange(len(texts)), counts)

    def later(x: np.ndarray, by: int) -> np.ndarray:
        out = np.zeros(total, np.uint64)
        if total > by:
            out[:-by] = np.where(owner[by:] == owner[:-by], x[by:], np.uint64(0))
        return out

    w1, s1, s2 = later(w, 1), later(s, 1), later(s, 2)
    b, c = np.uint64(0x9DDFEA08EB382D69), np.uint64(0xC2B2AE3D27D4EB4F)
    with np.errstate(over="ignore"):
        grams = [mixed(w, 1), mixed(w * b + w1, 2), mixed(s, 3), mixed(s * b + s1, 4), mixed((s * b + s1) * c + s2, 5), mixed((w == w1).astype(np.uint64), 6)]
    found = np.stack(grams, 1) >> np.uint64(64 - bits)
    return found.astype(np.uint32).reshape(-1), offsets * len(grams)


class Ftrl:
    """FTRL-proximal with one learning rate for each weight."""

    def __init__(self, bits: int = BITS, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.002, l2: float = 0.5):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z, self.n = np.zeros((1 << bits) + 1), np.zeros((1 << bits) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= self.l1, 0.0, (np.sign(z) * self.l1 - z) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2))

    def learn(self, at: np.ndarray, values: np.ndarray, label: float) -> None:
        w = self.weights(at)
        gradient = (1 / (1 + np.exp(-np.clip(w @ values, -35, 35))) - label) * values
        n = self.n[at]
        self.z[at] += gradient - (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + gradient * gradient


def _valued(found: np.ndarray, bias: int, scale: float) -> tuple[np.ndarray, np.ndarray]:
    at, counts = np.unique(found, return_counts=True)
    return np.append(at, bias), np.append(counts * (scale / max(1, len(found))), 1.0)


SCALE = 60.0


def train(labelled: DataFrame, most: int = MOST_TRAINED, bits: int = BITS) -> np.ndarray:
    """Weights (the last is the bias) from rows of (doc_id, text, label), of which ``most`` are used.

    Rows without a label of 0 or 1 are left out; null and empty texts count with their bias alone. Without rows,
    all weights are 0. One task reads the rows once, in the order of their digests, and keeps nothing but the model.
    """
    rows = labelled.filter(F.col("label").isin(0, 1)).select(F.xxhash64("doc_id").alias("turn"), "text", F.col("label").cast("int").alias("label"))
    rows = rows.orderBy("turn", "label").limit(most).repartition(1).sortWithinPartitions("turn", "label")

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes, model = Hashes(), Shapes(), Ftrl(bits)
        for part in slices(batches, most=1 << 20):
            found, offsets = features(raw(part.column("text")), words, shapes, bits)
            for a, b, label in zip(offsets[:-1].tolist(), offsets[1:].tolist(), part.column("label").to_pylist(), strict=True):
                model.learn(*_valued(found[a:b], 1 << bits, SCALE), label)
        yield pa.record_batch([pa.array([model.weights().astype("<f4").tobytes()])], names=["weights"])

    found = rows.mapInArrow(fit, "weights binary").first()
    return np.frombuffer(found["weights"], "<f4") if found else np.zeros((1 << bits) + 1, np.float32)


def score(docs: DataFrame, weights: np.ndarray, threshold: float = 0.3, bits: int = BITS) -> DataFrame:
    """(doc_id, score, predicted) of each row: the chance of label 1, and whether it is ``threshold`` or more.

    Whole texts are scored; a null or empty one has the score of the bias. Rows that share an id are scored each.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(np.asarray(weights, np.float32))

    def rate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, shapes = Hashes(), Shapes()
        w = shipped.value
        for part in slices(batches, most=1 << 20):
            found, offsets = features(raw(part.column("text")), words, shapes, bits)
            sums = np.concatenate(([0.0], np.cumsum(w[found], dtype=np.float64)))
            n = np.diff(offsets)
            logit = (sums[offsets[1:]] - sums[offsets[:-1]]) * SCALE / np.maximum(n, 1) + float(w[-1])
            chance = 1 / (1 + np.exp(-np.clip(logit, -35, 35)))
            yield pa.record_batch([part.column("doc_id"), pa.array(chance), pa.array((chance >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(rate, "doc_id long, score double, predicted int")


def quality_scores(docs: DataFrame, labels: DataFrame, label: str = "quality", folds: int = 5, threshold: float = 0.3, most: int = MOST_TRAINED) -> DataFrame:
    """Scores of all ``docs`` (doc_id, text) by a classifier fitted on ``labels`` (doc_id and the column ``label``).

    Rows whose crc32 of the doc_id as text leaves 0 when divided by ``folds`` are held out: they are scored, but
    their labels are never read. Returns a row for each input row: doc_id, held_out, score, predicted. A null
    doc_id has no digest; it is not held out and has no label. Of a doc_id labelled twice, the least label counts.
    """
    rest = F.crc32(F.col("doc_id").cast("string")) % folds
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).alias("label")).filter(rest != 0).filter(F.col("label").isin(0, 1))
    known = cut(known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The sample has ``most`` rows of two numbers at most, so it may go to all executors.
    weights = train(texts.join(F.broadcast(known), "doc_id"), most)
    return score(docs, weights, threshold).select("doc_id", F.coalesce(rest == 0, F.lit(False)).alias("held_out"), "score", "predicted")
