"""Quality by histogram gradient-boosted trees over document statistics.

Statistics of a text (lengths, shares of character kinds, repetition of words, lines
and word pairs) are cut into at most ``BINS`` bins at the sample's quantiles. Trees of fixed
depth grow level by level from histograms of gradients over the bins; each is kept as
flat arrays of a full binary tree, so that numpy sends all rows of a batch down a level
at a time. Fitting sees a bounded sample of labelled rows; scoring is one pass without
a shuffle.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphleaf.llm.common import in_small_batches, released, table, without
from graphleaf.llm.labelled import fitted, is_held_out, training_rows

TRAIN_ROWS, TRAIN_BYTES = 6_000, 32_768
BINS, TREES, DEPTH, RATE, RIDGE, LEAST_ROWS = 64, 80, 4, 0.15, 1.0, 10

_KINDS = {
    "upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ",
    "lower": b"abcdefghijklmnopqrstuvwxyz",
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n",
    "stop": b".",
    "comma": b",",
    "mark": b"!?",
    "bar": b"|",
    "symbol": b"#$%&*+=~^@\\/<>_",
    "bracket": b"()[]{}",
    "quote": b"\"'`",
    "dash": b"-:;",
    "wide": bytes(range(128, 256)),
}
_KIND_OF = np.zeros((256, len(_KINDS)))
for _n, _chars in enumerate(_KINDS.values()):
    _KIND_OF[list(_chars), _n] = 1.0
STATISTICS = [f"{k}_share" for k in _KINDS] + ["log_bytes", "log_words", "word_length", "word_spread", "distinct_words", "top_word", "same_as_last", "distinct_pairs", "log_lines", "distinct_lines", "line_words", "longest_word", "byte_entropy", "capital_words", "half_change"]


def statistics(text: str) -> list[float]:
    """The statistics of a whole text, in the order of ``STATISTICS``; all 0 for a text without characters."""
    raw = text.encode()
    if not raw:
        return [0.0] * len(STATISTICS)
    count = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    shares = count @ _KIND_OF / len(raw)
    seen = count[count > 0] / len(raw)
    words = text.split()
    n = max(1, len(words))
    length = np.fromiter(map(len, words), np.int32, len(words)) if words else np.zeros(1, np.int32)
    different = Counter(words)
    lines = text.split("\n")
    half = raw[: len(raw) // 2]
    capital = sum(map(str.istitle, words)) / n
    first = np.bincount(np.frombuffer(half, np.uint8), minlength=256) @ _KIND_OF / max(1, len(half))
    return [
        *shares.tolist(), math.log1p(len(raw)), math.log1p(len(words)), float(length.mean()), float(length.std()), len(different) / n, max(different.values(), default=0) / n,
        sum(map(eq, words, words[1:])) / n, len(set(zip(words, words[1:]))) / n, math.log1p(len(lines)), len(set(lines)) / len(lines), n / len(lines), math.log1p(float(length.max())),
        float(-(seen * np.log2(seen)).sum()), capital, float(np.abs(first - shares).sum()),
    ]


def fit(x: np.ndarray, y: np.ndarray, trees: int = TREES) -> dict[str, np.ndarray]:
    """Flat trees: for each inner node its statistic and cut (go right if above), for each leaf its value, and the base score.

    With one label only, or no rows, there are no splits and the score is that label's share, kept off 0 and 1."""
    inner, leaves = (1 << DEPTH) - 1, 1 << DEPTH
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = {"base": np.array([math.log(share / (1 - share))]), "statistic": np.zeros((trees, inner), np.int32), "cut": np.full((trees, inner), np.inf), "leaf": np.zeros((trees, leaves))}
    if not len(y) or y.min() == y.max():
        return model
    m = x.shape[1]
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(m)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], side="left") for f in range(m)], 1).astype(np.int32)
    raw = np.full(len(y), model["base"][0])
    offset = np.arange(m, dtype=np.int32) * BINS
    for t in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(y), np.int32)
        for level in range(DEPTH):
            width, first = 1 << level, (1 << level) - 1
            key = ((node[:, None] * m * BINS) + offset + binned).ravel()
            size = width * m * BINS
            g, h, c = (np.bincount(key, weights=w, minlength=size).reshape(width, m, BINS) for w in (np.repeat(grad, m), np.repeat(hess, m), np.ones(len(key))))
            gl, hl, cl = g.cumsum(2), h.cumsum(2), c.cumsum(2)
            gt, ht, ct = gl[:, :, -1:], hl[:, :, -1:], cl[:, :, -1:]
            gain = gl**2 / (hl + RIDGE) + (gt - gl) ** 2 / (ht - hl + RIDGE) - gt**2 / (ht + RIDGE)
            gain[(cl < LEAST_ROWS) | (ct - cl < LEAST_ROWS)] = 0.0
            flat = gain.reshape(width, -1)
            best = flat.argmax(1)
            for k in range(width):
                if flat[k, best[k]] > 1e-9:
                    f, b = divmod(int(best[k]), BINS)
                    model["statistic"][t, first + k], model["cut"][t, first + k] = f, cuts[f][min(b, len(cuts[f]) - 1)]
            node = 2 * node + (x[np.arange(len(y)), model["statistic"][t, first + node]] > model["cut"][t, first + node])
        gs, hs = np.bincount(node, weights=grad, minlength=leaves), np.bincount(node, weights=hess, minlength=leaves)
        model["leaf"][t] = -RATE * gs / (hs + RIDGE)
        raw += model["leaf"][t][node]
    return model


def predict(model: dict[str, np.ndarray], x: np.ndarray) -> np.ndarray:
    """Scores of all rows, every tree a level at a time."""
    raw = np.full(len(x), model["base"][0])
    rows = np.arange(len(x))
    for statistic, cut, leaf in zip(model["statistic"], model["cut"], model["leaf"], strict=True):
        node = np.zeros(len(x), np.int64)
        for _ in range(DEPTH):
            node = 2 * node + 1 + (x[rows, statistic[node]] > cut[node])
        raw += leaf[node - len(statistic)]
    return 1 / (1 + np.exp(-raw))


def score(docs: DataFrame, model: dict[str, np.ndarray], text_col: str = "text") -> DataFrame:
    """Add ``quality`` (0 to 1) to ``docs``; null texts count as empty. A column of that name in ``docs`` is replaced.

    Every row keeps its other columns; repeated rows and equal texts score alike, whatever stands beside them;
    texts of any length are read whole; an empty table gives no rows."""
    docs = in_small_batches(without(docs, ["quality"]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                part = batch.slice(k, 2000)
                names = part.schema.names
                x = np.array([statistics(t) for t in pc.fill_null(part.column(names.index(text_col)), "").to_pylist()]).reshape(-1, len(STATISTICS))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(predict(shared.value, x))], names=[*names, "quality"])

    return docs.mapInArrow(released(run), T.StructType([*docs.schema.fields, T.StructField("quality", T.DoubleType())]))


def fit_texts(texts: list[str], labels: list[int]) -> dict[str, np.ndarray]:
    return fit(np.array([statistics(t) for t in texts]).reshape(-1, len(STATISTICS)), np.array(labels, np.float64))


def trained(docs: DataFrame, labels: DataFrame) -> dict[str, np.ndarray]:
    return fitted(training_rows(docs, labels, "quality", TRAIN_ROWS, TRAIN_BYTES), fit_texts)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = score(docs, trained(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", is_held_out().alias("held_out"), F.col("quality").alias("score"), (F.col("quality") >= 0.3).cast("int").alias("predicted"))
