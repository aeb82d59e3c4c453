"""Document fingerprints by I-Match.

Document frequencies of all terms are counted over the whole corpus, a task sending
each term once. The lexicon keeps the terms within a band of inverse document
frequency, log(documents / frequency). Its upper edge also bounds the lexicon: terms
that at least a share s of the documents hold number at most (distinct terms of an
average document) / s, however large the corpus, so the lexicon can be broadcast.

A fingerprint hashes a text's distinct lexicon terms in order, and then those of them that
lie in each of several randomised subsets of the lexicon. The subsets are fixed: subset
(k, v) holds each term of the lexicon with chance 2**-v, by a hash of the term, and all of a
text's terms in it are hashed. A single edit changes the hash of every subset that holds an
edited term, so dense subsets suit short texts and sparse ones long texts: a text with m
terms, 2**v <= m < 2**(v+1), uses the ``SUBSETS`` subsets of density 2**-(v+1) and those of
density 2**-(v+2). The likeness of two fingerprints is the share of the subsets used by both
in which they agree, of those in which at least one has a term. A text without lexicon terms
uses all its terms.

Words are runs of 0-9, A-Z (as a-z) and characters beyond ASCII.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.llm.common import U64, blocks, in_small_batches, mix, released, table, utf8, without, word_hashes

IDF_LEAST, IDF_MOST = math.log(10), math.log(2000)
#: Randomised subsets of each density.
SUBSETS = 24
WORDS = 3 + 2 * SUBSETS
#: The lexicon's proven bound has this many terms if an average document has 2,000 distinct ones.
LEXICON_MOST = 4_000_000
HELD_TERMS = 1_000_000
#: Ranges of ids have about so many bytes of text; ids looked at for each range to find the ranges' ends.
RANGE_BYTES, LOOKED_AT = 16 << 20, 20
_SEEDS = mix(np.arange(1, SUBSETS + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15))


def _distinct(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Document and hash of each distinct term of each document."""
    h, before = word_hashes(data, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(before))
    _, at = np.unique(h ^ mix(doc.astype(np.uint64) + U64(1)), return_index=True)
    return doc[at], h[at]


def _summed(hashes: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    h, where = np.unique(np.concatenate(hashes), return_inverse=True)
    return h, np.bincount(where, weights=np.concatenate(counts)).astype(np.int64)


def document_frequencies(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``term`` (its hash) and ``df`` over all of ``docs``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, counts, held = [], [], 0
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in blocks(offsets):
                h, n = np.unique(_distinct(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])[1], return_counts=True)
                hashes.append(h)
                counts.append(n)
                held += len(h)
                if held > HELD_TERMS:
                    h, n = _summed(hashes, counts)
                    hashes, counts, held = [h], [n], len(h)
                    if held > HELD_TERMS // 2:
                        yield _terms(h, n)
                        hashes, counts, held = [], [], 0
        if hashes:
            yield _terms(*_summed(hashes, counts))

    return in_small_batches(docs).select(F.col(text_col).alias("text")).mapInArrow(released(run), "term long, n long").groupBy("term").agg(F.sum("n").alias("df"))


def _terms(h: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["term", "n"])


def lexicon(docs: DataFrame, idf_least: float = IDF_LEAST, idf_most: float = IDF_MOST, text_col: str = "text") -> np.ndarray:
    """Sorted hashes of the terms in the band."""
    n = docs.count()
    if not n:
        return np.zeros(0, np.uint64)
    kept = document_frequencies(docs, text_col).filter((F.col("df") >= n * math.exp(-idf_most)) & (F.col("df") <= max(1.0, n * math.exp(-idf_least)))).select("term")
    terms = kept.limit(LEXICON_MOST + 1).toArrow().column(0).to_numpy()
    if len(terms) > LEXICON_MOST:
        raise ValueError(f"over {LEXICON_MOST} terms within the band: documents this long need a lower idf_most")
    return np.sort(terms.view(np.uint64))


def fingerprints(data: np.ndarray, offsets: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """A row for each document: two words of the whole list's hash, the level v, then a hash for each subset of the two densities, 0 where it holds no term."""
    n = len(offsets) - 1
    out = np.zeros((n, WORDS), np.uint32)
    for i, j in blocks(offsets):
        doc, h = _distinct(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        if not len(h):
            continue
        at = np.minimum(np.searchsorted(terms, h), max(0, len(terms) - 1))
        inside = terms[at] == h if len(terms) else np.zeros(len(h), bool)
        some = np.bincount(doc[inside], minlength=j - i) > 0
        use = inside | ~some[doc]
        doc, h = doc[use], h[use]
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        own = doc[first]
        size = np.diff(np.append(first, len(doc)))
        rank = np.arange(len(doc)) - np.repeat(first, size)
        whole = mix(np.add.reduceat(mix(h + rank.astype(np.uint64) * U64(0xD1B54A32D192ED03)), first))
        rows = out[i:j]
        rows[own, 0], rows[own, 1] = whole >> U64(32), whole & U64(0xFFFFFFFF)
        level = np.frexp(size.astype(np.float64))[1] - 1
        rows[own, 2] = level
        below = (U64(1) << (U64(63) - level.astype(np.uint64)))[np.repeat(np.arange(len(size)), size)]
        for k, seed in enumerate(_SEEDS):
            r = mix(h ^ seed)
            for dense, column in ((1, 3 + k), (2, 3 + SUBSETS + k)):
                member = np.flatnonzero(r < (below >> U64(dense - 1)))
                total, there = np.zeros(j - i, np.uint64), np.zeros(j - i, bool)
                np.add.at(total, doc[member], mix(r[member]))
                there[doc[member]] = True
                rows[there, column] = (mix(total[there]) >> U64(32)) | U64(1)
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """0 to 1 for rows of ``fingerprints``: 1 if the whole lists agree, else the share of common subsets that do (0 if the texts differ so much in size that none are common)."""
    same = (a[:, :2] == b[:, :2]).all(1)
    agree, informed = np.zeros(len(a)), np.zeros(len(a))
    for own in range(2):
        for other in range(2):
            x, y = (r[:, 3 + k * SUBSETS : 3 + (k + 1) * SUBSETS] for r, k in ((a, own), (b, other)))
            common = (a[:, 2].astype(np.int64) + own == b[:, 2].astype(np.int64) + other)[:, None]
            agree += ((x == y) & (x > 0) & common).sum(1)
            informed += (((x > 0) | (y > 0)) & common).sum(1)
    return np.where(same, 1.0, agree / np.maximum(informed, 1))


def _packed(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    raw = [t.encode() for t in texts]
    return np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)


def fingerprint(docs: DataFrame, terms: np.ndarray, text_col: str = "text") -> DataFrame:
    """Add ``fingerprint`` (hexadecimal) to ``docs``.

    Null texts count as empty; equal texts, repeated rows among them, have equal fingerprints;
    texts may be of any length; an empty table gives no rows; a column of that name is replaced."""
    docs = in_small_batches(without(docs, ["fingerprint"]))
    shared = docs.sparkSession.sparkContext.broadcast(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            rows = fingerprints(*utf8(batch.column(names.index(text_col))), shared.value)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([r.tobytes().hex() for r in rows])], names=[*names, "fingerprint"])

    return docs.mapInArrow(released(run), f"{', '.join(f'`{n}` {t}' for n, t in docs.dtypes + [('fingerprint', 'string')])}")


def with_following(docs: DataFrame) -> DataFrame:
    """Deal (doc_id, text) into ranges of ids so that each row meets the one after it.

    Rows are (slot, doc_id, text), a slot being twice the range's number, or that plus one
    for a copy of the row that follows the range's last one. Partitions hold whole ranges,
    in order of slot, id and text. Ids equal to each other are in one range; null comes first.

    The ends of the ranges come from the ids whose hash is divisible by a number, and the
    bytes of their texts; they and the first ids of the ranges, a few numbers for each
    ``RANGE_BYTES`` of text, are what the driver gets. A range is read as a stream."""
    total, n, lo = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)), F.count("*"), F.min("doc_id")).first()
    low = (lo or 0) - 1
    key = F.coalesce(F.col("doc_id"), F.lit(low))
    docs = docs.select(key.alias("key"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    k = max(1, -(-total // RANGE_BYTES))
    bounds = np.zeros(0, np.int64)
    if k > 1:
        looked_at = docs.filter(F.pmod(F.xxhash64("key"), F.lit(max(1, n // (k * LOOKED_AT)))) == 0).groupBy("key").agg(F.sum(F.octet_length("text") + 1).alias("size"))
        seen = looked_at.toArrow().sort_by("key")
        size = np.cumsum(seen["size"].to_numpy())
        if len(size):
            at = np.searchsorted(size, size[-1] * np.arange(1, k) / k)
            bounds = np.unique(seen["key"].to_numpy()[np.minimum(at, len(size) - 1)])
    k = len(bounds) + 1

    @F.pandas_udf("int")
    def range_of(keys: pd.Series) -> pd.Series:
        return pd.Series(np.searchsorted(bounds, keys.to_numpy(), side="right").astype(np.int32))

    firsts = sorted(docs.select("key", range_of("key").alias("r")).groupBy("r").agg(F.min("key").alias("key")).collect())  # a row for each range
    ranges, keys = np.array([r["r"] for r in firsts]), np.array([r["key"] for r in firsts], np.int64)

    @F.pandas_udf("array<int>")
    def slots_of(values: pd.Series) -> pd.Series:
        v = values.to_numpy()
        own = np.searchsorted(bounds, v, side="right")
        at = np.minimum(np.searchsorted(keys, v), len(keys) - 1)
        return pd.Series([[2 * r, 2 * int(ranges[i - 1]) + 1] if keys[i] == x else [2 * r] for r, i, x in zip(own.tolist(), at.tolist(), v.tolist(), strict=True)])

    dealt = docs.select(F.explode(slots_of("key")).alias("slot"), "doc_id", "text")
    return dealt.withColumn("range", F.shiftright("slot", 1)).repartitionById(k, F.col("range")).drop("range").sortWithinPartitions("slot", "doc_id", "text")


def compare_with_following(docs: DataFrame, terms: np.ndarray) -> DataFrame:
    """Each document beside its edited text (its last quarter replaced by the beginning of the next document) and the next document.

    The next is that of the next greater id, after the last the first; of rows with one id in
    order of the text, so that repeated rows follow each other; null ids come first, null texts
    are empty; a document alone follows itself; an empty table gives no rows; texts may be of
    any length; further columns are not looked at."""
    shared = docs.sparkSession.sparkContext.broadcast(terms)
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: tuple | None = None
        for batch in batches:
            _, offsets = utf8(batch.column(2))
            for i, j in blocks(offsets):
                part = batch.slice(i, j - i)
                rows = list(zip(*(c.to_pylist() for c in part.columns), strict=True))
                rows = [held, *rows] if held else rows
                held = rows[-1]
                if (got := compared(rows)) is not None:
                    yield got

    def compared(rows: list[tuple]) -> pa.RecordBatch | None:
        pairs = [i for i in range(len(rows) - 1) if not rows[i][0] & 1 and rows[i][0] >> 1 == rows[i + 1][0] >> 1]
        if not pairs:
            return None
        texts = [r[2] for r in rows]
        edited = [texts[i][: len(texts[i]) - len(texts[i]) // 4] + texts[i + 1][: len(texts[i]) // 4] for i in pairs]
        own, new = fingerprints(*_packed(texts), shared.value), fingerprints(*_packed(edited), shared.value)
        at = np.array(pairs)
        return pa.RecordBatch.from_arrays([
            pa.array([rows[i][1] for i in pairs], pa.int64()), pa.array([len(texts[i]) for i in pairs], pa.int64()),
            pa.array([hashlib.sha256(e.encode()).hexdigest() for e in edited]), pa.array([r.tobytes().hex() for r in own[at]]), pa.array([r.tobytes().hex() for r in new]),
            pa.array(likeness(own[at], new)), pa.array(likeness(own[at], own[at + 1])),
        ], names=names)

    return with_following(docs).mapInArrow(released(run), "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double")


def op8_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likeness."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return compare_with_following(docs, lexicon(docs))

