"""Quality classifier: a byte-level convolutional network in numpy.

Each filter is a table of 256 values for each of WIDTH byte positions, so a convolution is WIDTH look-ups. A
document is covered by overlapping chunks (CHUNK bytes, each half shared with the next) from its first to its
last byte; every filter is max-pooled over each chunk, and the mean and the maximum of the pooled values over all
chunks, with two inputs for the text's size, give one probability. Filters and output weights are learned together by gradient descent on a bounded
sample of labelled documents.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.llm.sampling import class_sample, remainder
from verispark.llm.tables import text_batches
from verispark.llm.textbytes import slices

WIDTH, FILTERS, STEP = 6, 24, 2
CHUNK = 512
TRAIN_PER_CLASS = 500
TRAIN_MAX_BYTES = 20_000  # longer documents are not sampled for training; scoring has no such bound
EPOCHS = 8
THRESHOLD = 0.3
_BLOCK = 1 << 16


class ByteNet:
    """tables[w, byte, filter], bias per filter, weights of the mean and the maximum, and a last bias."""

    def __init__(self, seed: int = 3) -> None:
        rng = np.random.default_rng(seed)
        self.tables = rng.normal(0, 0.25, (WIDTH, 256, FILTERS)).astype(np.float32)
        self.bias = np.zeros(FILTERS, np.float32)
        self.mean_w = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.max_w = rng.normal(0, 0.1, FILTERS).astype(np.float32)
        self.size_w = np.zeros(2, np.float32)
        self.last = np.zeros(1, np.float32)

    @property
    def parameters(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.mean_w, self.max_w, self.size_w, self.last]

    def responses(self, data: np.ndarray) -> np.ndarray:
        """Filter responses at every STEP-th byte, where WIDTH bytes follow (padded with zero bytes)."""
        n = max(1, -(-len(data) // STEP))
        padded = np.zeros(n * STEP + WIDTH, np.uint8)
        padded[: len(data)] = data
        out = np.empty((n, FILTERS), np.float32)
        part = np.empty((min(n, _BLOCK), FILTERS), np.float32)
        for at in range(0, n, _BLOCK):
            m = min(_BLOCK, n - at)
            block = out[at : at + m]
            block[:] = self.bias
            for w in range(WIDTH):
                first = at * STEP + w
                np.take(self.tables[w], padded[first : first + m * STEP : STEP], axis=0, out=part[:m], mode="clip")
                block += part[:m]
        return out

    def pooled(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Maximum of each filter over each chunk, and the response it stands at."""
        out = self.responses(data)
        half = CHUNK // 2 // STEP
        starts = np.arange(0, len(out), half)
        halves = np.maximum.reduceat(out, starts, axis=0)
        if len(halves) == 1:
            return np.maximum(halves, 0), out
        return np.maximum(np.maximum(halves[:-1], halves[1:]), 0), out

    @staticmethod
    def size(n_bytes: int) -> np.ndarray:
        """A short text reaches lower maxima than a long one of the same kind; these two inputs make up for it."""
        return np.array([32 / (32 + n_bytes), 256 / (256 + n_bytes)], np.float32)

    def logit(self, chunks: np.ndarray, n_bytes: int) -> float:
        return float(chunks.mean(axis=0) @ self.mean_w + chunks.max(axis=0) @ self.max_w + self.size(n_bytes) @ self.size_w + self.last[0])

    def score(self, data: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(self.pooled(data)[0], len(data)), -30, 30))))

    def gradients(self, data: np.ndarray, target: float) -> list[np.ndarray]:
        """Of the log loss of one document; through a maximum only its own position learns."""
        chunks, out = self.pooled(data)
        error = 1 / (1 + np.exp(-np.clip(self.logit(chunks, len(data)), -30, 30))) - target
        d_mean, d_max = chunks.mean(axis=0) * error, chunks.max(axis=0) * error
        d_chunks = np.repeat(self.mean_w[None] * error / len(chunks), len(chunks), axis=0)
        d_chunks[chunks.argmax(axis=0), np.arange(FILTERS)] += self.max_w * error
        d_chunks[chunks <= 0] = 0
        d_tables, d_bias = np.zeros_like(self.tables), d_chunks.sum(axis=0)
        padded = np.zeros(len(out) * STEP + WIDTH, np.uint8)
        padded[: len(data)] = data
        half = CHUNK // 2 // STEP
        columns = np.arange(FILTERS)
        for c in range(len(chunks)):
            at = out[c * half : (c + 2) * half].argmax(axis=0) + c * half
            for w in range(WIDTH):
                d_tables[w, padded[at * STEP + w], columns] += d_chunks[c]
        return [d_tables, d_bias, d_mean, d_max, self.size(len(data)) * np.float32(error), np.array([error], np.float32)]

    def fit(self, texts: list[bytes], labels: np.ndarray, weights: np.ndarray, epochs: int = EPOCHS, batch: int = 16, rate: float = 0.02) -> None:
        """Adam on shuffled batches."""
        rng = np.random.default_rng(11)
        first = [np.zeros_like(p) for p in self.parameters]
        second = [np.zeros_like(p) for p in self.parameters]
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(texts))
            for at in range(0, len(order), batch):
                total = [np.zeros_like(p) for p in self.parameters]
                for i in order[at : at + batch]:
                    for t, g in zip(total, self.gradients(np.frombuffer(texts[i], np.uint8), float(labels[i]))):
                        t += g * weights[i]
                step += 1
                pace = rate * (1 - epoch / (epochs + 1)) * np.sqrt(1 - 0.999**step) / (1 - 0.9**step)
                for p, t, m, v in zip(self.parameters, total, first, second):
                    t /= batch
                    m += 0.1 * (t - m)
                    v += 0.001 * (t * t - v)
                    p -= (pace * m / (np.sqrt(v) + 1e-7)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_PER_CLASS) -> ByteNet | None:
    """Fit on documents joined with (doc_id, quality); None where there is no labelled document.

    Ids with contradicting labels are left out. Each class is sampled alike and then weighted by its share.
    """
    known = labels.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most"))
    known = known.filter("quality = _most AND quality IN (0, 1) AND doc_id IS NOT NULL").select("doc_id", F.col("quality").cast("int").alias("quality"))
    sample = class_sample(known, "doc_id", "quality", per_class)
    short = docs.filter(F.octet_length("text") <= TRAIN_MAX_BYTES).select("doc_id", "text")
    # At most 2 * per_class ids per class: a bounded broadcast.
    rows = short.join(F.broadcast(sample), "doc_id").select("doc_id", "text", "quality").limit(8 * per_class).collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["doc_id"], r["text"]))
    y = np.array([r["quality"] for r in rows], np.float32)
    net = ByteNet()
    if y.min() == y.max():
        net.mean_w[:] = net.max_w[:] = 0
        net.last[:] = 3.0 if y[0] else -3.0
        return net
    texts = [r["text"].encode() for r in rows]
    # Few sampled documents are short. A run of words of a good text is good too, so each gives one short excerpt;
    # a run of a bad text need not be bad.
    good = [t for t, label in zip(texts, y) if label == 1]
    texts, y = texts + _excerpts(good), np.concatenate([y, np.ones(len(good), np.float32)])
    net.fit(texts, y, np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())))
    return net


def _excerpts(texts: list[bytes]) -> list[bytes]:
    """One run of whole words of each text, 1 to 40 words long."""
    rng, out = np.random.default_rng(7), []
    for text in texts:
        words = text.split(b" ")
        n = int(np.exp(rng.uniform(0, np.log(40))))
        at = int(rng.integers(0, max(1, len(words) - n + 1)))
        out.append(b" ".join(words[at : at + n]))
    return out


def judged(text: Column, net: ByteNet | None) -> Column:
    """Struct of score and predicted. Only the text goes to Python."""

    def label(parts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in parts:
            score = np.full(len(column), 0.5)
            if net is not None:
                for texts in slices(column):
                    score[texts.first : texts.first + len(texts)] = [net.score(texts.data[a:b]) for a, b in zip(texts.offsets[:-1], texts.offsets[1:])]
            yield pa.StructArray.from_arrays([pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], ["score", "predicted"])

    # Not deterministic to the optimizer, so that no step computes it twice.
    predict = F.arrow_udf(label, "score double, predicted int", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return predict(text)


def quality_scores(docs: DataFrame, labels: DataFrame, train_docs: DataFrame | None = None, per_class: int = TRAIN_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score (near 1: quality 1 is likelier) and predicted of every document.

    Learns from rows whose crc32(doc_id) mod 5 is not 0, at most twice `per_class` for each label; the score reads
    the text alone, all of it. A null text counts as empty; without any label all scores are 0.5. A score of exactly 0.3 is
    predicted 1. Repeated rows give repeated results, an empty table none; other columns are ignored.
    """
    text = F.col("text").cast("string")
    text_batches(docs.sparkSession)
    source = (docs if train_docs is None else train_docs).select("doc_id", text.alias("text"))
    net = train(source, labels.select("doc_id", "quality").filter(remainder("doc_id", 5) != 0), per_class)
    chosen = docs.select("doc_id", F.coalesce(remainder("doc_id", 5) == 0, F.lit(False)).alias("held_out"), judged(text, net).alias("judged"))
    return chosen.select("doc_id", "held_out", "judged.score", "judged.predicted")
