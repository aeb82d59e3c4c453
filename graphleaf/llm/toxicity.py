"""Toxicity by multiple-instance learning.

A document is a bag of sentences. A sentence's score is the logistic function of a
bias and the weights of its distinct words; a word's weight is the sum of the weights
of its features (the word and its beginnings, hashed). A document is toxic if any
sentence is: p = 1 - prod(1 - p_sentence), the noisy-or. Only document labels are
known; the likelihood of p is maximised by Adam in numpy on a bounded sample of
labelled rows, and the sentence scores then tell where the offence lies.

Scoring keeps the weights of words seen before, so a word costs a look-up.
"""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphleaf.llm.common import in_small_batches, released, set_aside, table, without
from graphleaf.llm.labelled import fitted, is_held_out, training_rows

BUCKETS = 1 << 18
TRAIN_ROWS, TRAIN_BYTES = 6_000, 16_384
STEPS, RATE, L2 = 120, 0.1, 1e-4
#: A missed toxic document weighs as much as this many false alarms.
TOXIC_WEIGHT = 2.0
LEAST_WORDS, SENTENCE_WORDS = 8, 40
#: Documents whose tokens are expanded into features together.
FIT_DOCS = 200
MAX_CACHED, LONG_WORD = 150_000, 64
_SPLIT = re.compile(r"[.!?\n\r]+")
_WORD = re.compile(r"[^\W_]+")


def sentences(text: str) -> Iterator[list[str]]:
    """Words of each sentence. Sentences end at a full stop, mark or line break once they have ``LEAST_WORDS`` words, and after ``SENTENCE_WORDS`` words in any case."""
    held: list[str] = []
    for piece in _SPLIT.split(text.lower()):
        held += _WORD.findall(piece)
        if len(held) >= LEAST_WORDS:
            for k in range(0, len(held), SENTENCE_WORDS):
                yield held[k : k + SENTENCE_WORDS]
            held = []
    if held:
        yield held


def features(word: str) -> list[int]:
    """Buckets of a word: itself and its beginnings of 3 to 6 letters."""
    return [zlib.crc32(f"={word}".encode()) % BUCKETS] + [zlib.crc32(word[:n].encode()) % BUCKETS for n in range(3, 7) if len(word) >= n]


class Scorer(dict):
    """Weights of words, filled on demand from the weights of features."""

    def __init__(self, weights: np.ndarray, bias: float):
        super().__init__()
        self.weights, self.bias = weights, bias

    def __missing__(self, word: str) -> float:
        w = float(self.weights[features(word)].sum())
        if len(word) < LONG_WORD:  # longer ones are weighed each time, which keeps the memory small
            if len(self) >= MAX_CACHED:
                self.clear()
            self[word] = w
        return w

    def score(self, text: str) -> tuple[float, int, float]:
        """Score of the document, number (from 0) and score of its worst sentence (-1 and 0 without sentences)."""
        total, worst, worst_at, at = 0.0, -math.inf, -1, -1
        weight, bias = self.__getitem__, self.bias
        for at, words in enumerate(sentences(text)):
            z = bias + sum(map(weight, set(words)))
            total += math.log1p(math.exp(z)) if z < 30 else z
            if z > worst:
                worst, worst_at = z, at
        return 1.0 - math.exp(-total), worst_at, 1.0 / (1.0 + math.exp(-worst)) if worst_at >= 0 else 0.0


def fit(texts: list[str], labels: list[int], steps: int = STEPS) -> tuple[np.ndarray, float]:
    """Weights of features and bias. Without both labels in the sample the weights are zero, and every text with sentences scores close to 0 if there is no label 1, close to 1 if there is no label 0."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return np.zeros(BUCKETS), -30.0 if not len(y) or y[0] == 0 else 3.0
    vocabulary: dict[str, int] = {}
    token, bag_of, first = array("i"), array("i"), array("q")
    for d, text in enumerate(texts):
        for words in sentences(text):
            first.append(len(token))
            bag_of.append(d)
            token.extend(vocabulary.setdefault(w, len(vocabulary)) for w in sorted(set(words)))
    token, first, bag_of = np.array(token, np.int32), np.array(first, np.int64), np.array(bag_of, np.int32)
    sentence_of = np.repeat(np.arange(len(first), dtype=np.int32), np.diff(np.append(first, len(token))))
    lists = [features(w) for w in vocabulary]
    feature = np.array([f for x in lists for f in x], np.int32)
    word_of = np.repeat(np.arange(len(lists), dtype=np.int32), [len(x) for x in lists])
    in_docs = np.zeros(BUCKETS, np.int64)
    edges = np.searchsorted(bag_of[sentence_of], np.arange(0, len(texts) + FIT_DOCS, FIT_DOCS))
    for lo, hi in zip(edges[:-1], edges[1:], strict=True):
        own = token[lo:hi]
        each = np.bincount(word_of, minlength=len(lists))[own]
        pairs = np.repeat(bag_of[sentence_of[lo:hi]].astype(np.int64), each) * BUCKETS + _expanded(feature, word_of, own, len(lists))
        in_docs += np.bincount(np.unique(pairs) % BUCKETS, minlength=BUCKETS)
    seen = in_docs >= 3  # features of one document tell nothing about others
    theta, bias = np.zeros(BUCKETS), -6.0
    m, v, mb, vb = np.zeros(BUCKETS), np.zeros(BUCKETS), 0.0, 0.0
    n = len(y)
    for step in range(1, steps + 1):
        word_weight = np.bincount(word_of, weights=theta[feature], minlength=len(lists))
        z = np.bincount(sentence_of, weights=word_weight[token], minlength=len(first)) + bias
        soft = np.logaddexp(0.0, z)
        total = np.bincount(bag_of, weights=soft, minlength=n)
        p = -np.expm1(-total)
        outer = np.where(y == 1, -TOXIC_WEIGHT * (1 - p) / np.maximum(p, 1e-9), 1.0)  # of the loss by the sum of soft
        slope = outer[bag_of] / (1.0 + np.exp(-z))
        by_word = np.bincount(token, weights=slope[sentence_of], minlength=len(lists))
        grad = np.bincount(feature, weights=by_word[word_of], minlength=BUCKETS) / n + L2 * theta
        grad[~seen] = 0.0
        grad_bias = slope.sum() / n
        m, v = 0.9 * m + 0.1 * grad, 0.99 * v + 0.01 * grad * grad
        mb, vb = 0.9 * mb + 0.1 * grad_bias, 0.99 * vb + 0.01 * grad_bias**2
        up, down = 1 - 0.9**step, 1 - 0.99**step
        theta = np.maximum(theta - RATE * (m / up) / (np.sqrt(v / down) + 1e-8), 0.0)  # words only ever add to an offence
        bias -= RATE * (mb / up) / (math.sqrt(vb / down) + 1e-8)
    return theta, float(bias)


def _expanded(feature: np.ndarray, word_of: np.ndarray, token: np.ndarray, n_words: int) -> np.ndarray:
    """The features of every token, one after another."""
    size = np.bincount(word_of, minlength=n_words)
    first = np.concatenate([[0], np.cumsum(size)[:-1]])
    many = size[token]
    start = np.concatenate([[0], np.cumsum(many)[:-1]])
    return feature[np.arange(many.sum()) - np.repeat(start - first[token], many)]


def score(docs: DataFrame, model: tuple[np.ndarray, float], text_col: str = "text") -> DataFrame:
    """Add to ``docs``: ``toxicity`` (0 to 1), ``worst_sentence`` (its number from 0, -1 if none) and ``worst_score``.

    Reads the text only. Null, empty and wordless texts have no sentences: score 0. Texts and
    words may be of any length; of equally bad sentences the first counts; repeated rows
    score alike; an empty table gives no rows.
    Columns of ``docs`` that have one of the new names are replaced."""
    new = {"toxicity": pa.float64(), "worst_sentence": pa.int32(), "worst_score": pa.float64()}
    docs = in_small_batches(without(docs, new))
    shared = docs.sparkSession.sparkContext.broadcast((model[0].astype(np.float32), model[1]))
    schema = T.StructType([*docs.schema.fields, T.StructField("toxicity", T.DoubleType()), T.StructField("worst_sentence", T.IntegerType()), T.StructField("worst_score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(*shared.value)
        for batch in batches:
            for k in range(0, batch.num_rows, 1000):
                part = batch.slice(k, 1000)
                names = part.schema.names
                got = [scorer.score(t) for t in pc.fill_null(part.column(names.index(text_col)), "").to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array([g[i] for g in got], t) for i, t in enumerate(new.values()))], names=[*names, *new])

    return docs.mapInArrow(released(run), schema)


def trained(docs: DataFrame, labels: DataFrame) -> tuple[np.ndarray, float]:
    return fitted(training_rows(docs, labels, "toxic", TRAIN_ROWS, TRAIN_BYTES), fit)


def remove_toxic(docs: DataFrame, model: tuple[np.ndarray, float], most: float = 0.5) -> DataFrame:
    """The documents scored below ``most``, columns as they were, those of clashing names too.

    Null and empty texts score 0 and stay; repeated rows score alike; texts of any length are scored whole; an empty table gives no rows."""
    inside, back = set_aside(docs, ("toxicity", "worst_sentence", "worst_score"))
    return back(score(inside, model).filter(F.col("toxicity") < most))


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out().alias("held_out"), F.col("toxicity").alias("score"), (F.col("toxicity") >= 0.5).cast("int").alias("predicted"), "worst_sentence", "worst_score")
