"""Language identification by hierarchical discrimination.

First the language family is predicted, then linear support vector machines, one for each pair of languages of
that family, vote for the language. Both levels see the same features: byte trigrams of the whole text, hashed
into a fixed number of bins, as the square roots of their shares. Training rows are a bounded sample; the
machines are fitted with dual coordinate descent.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from verispark.llm.sampling import class_sample, remainder
from verispark.llm.tables import text_batches
from verispark.llm.textbytes import Texts, lower_ascii, slices

BINS = 4096
TRAIN_ROWS = 2400  # all languages together, where there are few of them
LEAST_ROWS = 20  # of each language, however many there are
OWN_FAMILIES = 8  # languages outside the table that may be a family each; more of them are grouped by likeness
UNKNOWN = "und"

# Language codes by family.
FAMILIES = {
    "germanic": ("en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "fy", "lb", "yi"),
    "romance": ("fr", "es", "it", "pt", "ro", "ca", "gl", "oc", "la"),
    "slavic": ("pl", "cs", "sk", "ru", "uk", "be", "bg", "sr", "hr", "sl", "mk"),
    "uralic": ("fi", "et", "hu"),
    "turkic": ("tr", "az", "kk", "uz"),
    "indic": ("hi", "mr", "ne", "bn", "pa", "gu"),
    "semitic": ("ar", "he", "mt"),
}


def families(langs: np.ndarray, x: np.ndarray) -> dict[str, str]:
    """Family of each language: the table's, or one of its own.

    With more than OWN_FAMILIES others, the others are grouped by the likeness of their mean rows into as many families
    as a family has members, so that the number of machines grows with the power 1.5 of the languages, not 2.
    """
    names = sorted(set(langs))
    known = {lang: name for name, members in FAMILIES.items() for lang in members}
    others = [v for v in names if v not in known]
    out = {v: known.get(v, f"only {v}") for v in names}
    if len(others) > OWN_FAMILIES:
        means = np.stack([x[langs == v].mean(axis=0) for v in others]).astype(np.float64)
        means /= np.maximum(np.sqrt((means * means).sum(axis=1, keepdims=True)), 1e-12)
        size = int(np.ceil(np.sqrt(len(others))))
        left = list(range(len(others)))
        while left:
            like = means[left] @ means[left[0]]
            chosen = [left[k] for k in np.argsort(-like, kind="stable")[:size]]
            out |= {others[k]: f"like {others[chosen[0]]}" for k in chosen}
            left = [k for k in left if k not in chosen]
    return out


def features(texts: Texts) -> np.ndarray:
    """A row of BINS values per document, of length 1 (0 where a text has under three bytes)."""
    data, n = lower_ascii(texts.data), len(texts)
    out = np.zeros((n, BINS), np.float32)
    if len(data) < 3:
        return out
    doc = np.repeat(np.arange(n, dtype=np.int64), np.diff(texts.offsets))
    inside = doc[:-2] == doc[2:]
    code = data[:-2].astype(np.uint32) | (data[1:-1].astype(np.uint32) << np.uint32(8)) | (data[2:].astype(np.uint32) << np.uint32(16))
    bins = (code * np.uint32(2654435761)) >> np.uint32(20)
    counts = np.bincount((doc[:-2] * BINS + bins)[inside], minlength=n * BINS).reshape(n, BINS)
    total = np.maximum(counts.sum(axis=1, keepdims=True), 1)
    return np.sqrt(counts / total).astype(np.float32)


def fit_svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, cost: float = 4.0, rounds: int = 12) -> np.ndarray:
    """Weights and bias of a linear support vector machine (squared hinge) for the given rows of `x`, labels +1 and -1.

    Dual coordinate descent; each class weighs as much as the other. `x` is shared by all machines and never copied.
    """
    share = np.where(y > 0, (y > 0).mean(), (y < 0).mean())
    diagonal = share / cost  # 1 / (2 C) with C = cost / (2 share)
    squares = np.array([np.dot(x[r], x[r]) for r in rows], np.float64) + 1.0 + diagonal  # 1 for the bias
    alpha, w, bias = np.zeros(len(rows)), np.zeros(x.shape[1]), 0.0
    order = np.random.default_rng(5)
    for _ in range(rounds):
        for i in order.permutation(len(rows)):
            row = x[rows[i]].astype(np.float64)
            gradient = y[i] * (row @ w + bias) - 1 + diagonal[i] * alpha[i]
            moved = max(alpha[i] - gradient / squares[i], 0.0)
            step = (moved - alpha[i]) * y[i]
            w += step * row
            bias += step
            alpha[i] = moved
    return np.append(w, bias).astype(np.float32)


class Votes:
    """One machine per pair of classes; the class with most votes wins, ties go to the larger sum of margins."""

    def __init__(self, x: np.ndarray, rows: np.ndarray, classes: np.ndarray) -> None:
        self.names = sorted(set(classes))
        self.pairs = list(combinations(range(len(self.names)), 2))
        self.weights = []
        for a, b in self.pairs:
            at = (classes == self.names[a]) | (classes == self.names[b])
            self.weights.append(fit_svm(x, rows[at], np.where(classes[at] == self.names[a], 1.0, -1.0)))

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the winner and its mean probability against each other class."""
        n, k = len(x), len(self.names)
        if k == 1:
            return np.zeros(n, np.int64), np.ones(n)
        votes, chance = np.zeros((n, k)), np.zeros((n, k))
        for (a, b), w in zip(self.pairs, self.weights):
            p = 1 / (1 + np.exp(-np.clip(3.0 * (x @ w[:-1] + w[-1]), -30, 30)))
            votes[:, a] += p >= 0.5
            votes[:, b] += p < 0.5
            chance[:, a] += p
            chance[:, b] += 1 - p
        best = np.argmax(votes + chance / (10 * k), axis=1)
        return best, chance[np.arange(n), best] / (k - 1)


class Hierarchy:
    """Family first, then the language within it."""

    def __init__(self, x: np.ndarray, langs: np.ndarray) -> None:
        of = families(langs, x)
        groups = np.array([of[v] for v in langs])
        self.top = Votes(x, np.arange(len(x)), groups)
        self.within = {f: Votes(x, np.flatnonzero(groups == f), langs[groups == f]) for f in self.top.names}

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        group, sure = self.top.predict(x)
        names, score = np.empty(len(x), object), np.zeros(len(x))
        for g in np.unique(group):
            at, votes = np.flatnonzero(group == g), self.within[self.top.names[g]]
            best, chance = votes.predict(x[at])
            names[at] = np.array(votes.names, object)[best]
            score[at] = sure[at] * chance
        return names, score


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in slices(batch.column(1), max_docs=512):
            packed = [v.tobytes() for v in features(texts).astype(np.float16)]
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(texts.first, len(texts)), pa.array(packed, pa.binary())], ["lang", "vector"])


def _sampled(labelled: DataFrame, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of features and languages of a bounded sample of labelled texts."""
    langs = labelled.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    n_langs = max(1, langs.select("lang").distinct().count())
    sample = class_sample(langs, "doc_id", "lang", max(LEAST_ROWS, rows // n_langs))
    got = sample.select("lang", "text").mapInArrow(_vectors, "lang string, vector binary").collect()  # at most twice that of each language
    got.sort(key=lambda r: (r["lang"], bytes(r["vector"])))
    x = np.empty((len(got), BINS), np.float32)
    for i, r in enumerate(got):
        x[i] = np.frombuffer(r["vector"], np.float16)
    return x, np.array([r["lang"] for r in got], object)


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> Hierarchy | None:
    """Fit on (doc_id, text, lang); None where no row with a letter has a language. Every language is learned."""
    text_batches(labelled.sparkSession)
    x, langs = _sampled(labelled, rows)
    return Hierarchy(x, langs) if len(langs) else None


def least_score(model: Hierarchy, held_out: DataFrame) -> float:
    """The score under which a text is of none of the languages: half the smallest one of rightly predicted held-out rows.

    Taken over all rows of (doc_id, text, lang), which the model has not seen; 0 where no row counts.
    """
    text_batches(held_out.sparkSession)
    known = held_out.filter(F.col("lang").isNotNull() & F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    scored = known.select("lang", judged(F.col("text"), model).alias("judged"))
    least = scored.filter(F.col("judged.lang_pred") == F.col("lang")).agg(F.min("judged.score")).first()[0]
    return 0.0 if least is None else least / 2


def judged(text: Column, model: Hierarchy | None) -> Column:
    """Struct of lang_pred and score: `und` and 0 for a text that is null or has no letter. Only the text goes to Python."""

    def label(parts: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for letters, column in parts:
            has = letters.to_numpy(zero_copy_only=False).astype(bool)
            names, scores = np.full(len(has), UNKNOWN, object), np.zeros(len(has))
            for texts in slices(column, max_docs=512):
                part = slice(texts.first, texts.first + len(texts))
                if model is not None:
                    names[part], scores[part] = model.predict(features(texts))
            names[~has], scores[~has] = UNKNOWN, 0.0
            yield pa.StructArray.from_arrays([pa.array(names, pa.string()), pa.array(scores)], ["lang_pred", "score"])

    # Not deterministic to the optimizer, so that no step computes it twice.
    predict = F.arrow_udf(label, "lang_pred string, score double", F.ArrowUDFType.SCALAR_ITER).asNondeterministic()
    return predict(F.coalesce(text.rlike(r"\p{L}"), F.lit(False)), text)


def language_id(docs: DataFrame, train_docs: DataFrame | None = None, rows: int = TRAIN_ROWS) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every document.

    Learns from rows of `train_docs` (default: `docs`) with a language whose crc32(doc_id) mod 3 is not 1, at
    most about `rows` of them or LEAST_ROWS of each language. Prediction reads the text alone, all of it. Rows with a null
    id are predicted and never learned from; repeated rows give repeated results; equal votes go to the larger sum of
    margins and then to the first name; an empty table gives no rows; other columns are ignored.
    """
    text = F.col("text").cast("string")
    source = (docs if train_docs is None else train_docs).select("doc_id", text.alias("text"), F.col("lang").cast("string").alias("lang"))
    model = train(source.filter(remainder("doc_id", 3) != 1), rows)
    chosen = docs.select("doc_id", F.coalesce(remainder("doc_id", 3) == 1, F.lit(False)).alias("held_out"), judged(text, model).alias("judged"))
    return chosen.select("doc_id", "held_out", "judged.lang_pred", "judged.score")
