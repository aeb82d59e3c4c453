"""Benchmark decontamination by Wu-Manber multi-pattern search over bytes.

Texts and benchmark items are brought to one form: words (A-Z as a-z) between
single spaces. Every window of ``width`` words of an item, with a space before and
after, is a pattern. Patterns are sorted into classes by length. In a class, m is
the shortest length and B the block length; the shift table says for each block how
far the end of the search window may move, and a block that ends some pattern's
first m bytes (shift 0) selects a bucket by the hash of that block and of the
pattern's first bytes, whose patterns are then compared with the text byte by byte.
The search runs in numpy over many stretches of text at once; every stretch follows
its own shifts.

Nothing is shuffled. The compiled tables of at most ``PATTERN_BYTES`` of benchmark
text are broadcast; a larger benchmark is split by item into blocks of that size,
which are searched one after another, the hits of a block carried in two columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from graphleaf.llm.common import IS_WORD, LOWER, ROLL_A, ROLL_B, U64, blocks, in_small_batches, materialise, mix, released, set_aside, table, utf8, without

WIDTH = 10
NEW = ("n_words", "hit_spans", "hit_items")
PATTERN_BYTES = 4 << 20
TABLE_BITS = 20
STRETCH = 2048
EDGES = (3, 6, 12, 24, 1 << 62)
_MUL = U64(0x9E3779B97F4A7C15)
_FORM = LOWER.copy()
_FORM[~IS_WORD] = 32


def _joined(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Documents as `` w w w `` divided by the byte 0xFF, which no UTF-8 text holds; word starts in it; words before each document."""
    n = len(offsets) - 1
    gap = np.array([32, 255, 32], np.uint8)
    out = np.empty(len(data) + 3 * (n + 1), np.uint8)
    where = np.arange(n + 1) * 3
    own = np.ones(len(out), bool)
    marks = offsets + where
    for k in range(3):
        out[marks + k] = gap[k]
        own[marks + k] = False
    out[own] = _FORM[data]
    space = out == 32
    keep = ~space
    keep[0] = True
    keep[1:] |= ~space[:-1]
    out = out[keep]
    space = out == 32
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    is_mark = out[starts] == 255
    at = np.flatnonzero(is_mark)
    before = at - np.arange(len(at))
    return out, starts[~is_mark], before


class Patterns:
    """Compiled patterns: the items' text once, each distinct window as a place in it, the items of each, and the tables of each length class.

    About 45 bytes for each byte of text while it is made, 7 when it is broadcast."""

    def __init__(self, items: list[tuple[object, str | None]], width: int = WIDTH):
        self.names = [item for item, _ in items]
        raw = [(text or "").encode() for _, text in items]
        data, offsets = np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
        texts, first, length, key, item, at = [], [], [], [], [], 0
        for i, j in blocks(offsets):
            text, starts, before = _joined(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            space = np.flatnonzero(text == 32)
            past = space[np.searchsorted(space, starts)] + 1  # of each word, with the space after it
            n = np.diff(before)
            many = np.maximum(n - width + 1, np.minimum(n, 1))
            doc = np.repeat(np.arange(j - i), many)
            word = before[doc] + np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
            a, b = starts[word] - 1, past[word + np.minimum(n[doc], width) - 1]
            texts.append(text)
            first.append((a + at).astype(np.int32))
            length.append((b - a).astype(np.int32))
            key.append(ROLL_A.of(ROLL_A.running(text), a, b) ^ mix(ROLL_B.of(ROLL_B.running(text), a, b)))
            item.append((doc + i).astype(np.int32))
            at += len(text)
        self.text = np.concatenate([*texts, np.zeros(8, np.uint8)])
        joined = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
        _, one, pattern = np.unique(joined(key, np.uint64), return_index=True, return_inverse=True)
        self.first, self.length = joined(first, np.int32)[one], joined(length, np.int32)[one]
        pairs = np.unique(pattern.astype(np.int64) * len(items) + joined(item, np.int32)) if len(one) else np.zeros(0, np.int64)
        self.item, self.items_before = (pairs % max(1, len(items))).astype(np.int32), np.searchsorted(pairs, np.arange(len(one) + 1) * len(items)).astype(np.int32)
        self.classes = []
        for low, high in zip(EDGES, EDGES[1:], strict=False):
            own = np.flatnonzero((self.length >= low) & (self.length < high))
            if len(own):
                self.classes.append(self._compiled(own))

    def items_of(self, pattern: int) -> list:
        return [self.names[i] for i in self.item[self.items_before[pattern] : self.items_before[pattern + 1]] if self.names[i] is not None]

    def _compiled(self, own: np.ndarray) -> dict:
        first = self.first[own].astype(np.int64)
        m = int(self.length[own].min())
        b = min(8, max(2, m // 2))
        mask = U64((1 << (8 * b)) - 1)
        shift = np.full(1 << TABLE_BITS, min(255, m - b + 1), np.uint8)
        for end in range(b, m + 1):
            np.minimum.at(shift, _slot(_load(self.text, first + end - b) & mask), np.uint8(min(255, m - end)))
        key = _key(_load(self.text, first + m - b) & mask, _load(self.text, first) & mask)
        order = np.argsort(key, kind="stable")
        return {"m": m, "b": b, "mask": mask, "shift": shift, "key": key[order], "pattern": own[order].astype(np.int32)}

    def search(self, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and pattern of every occurrence in ``text``."""
        found = [self._search(c, text) for c in self.classes]
        if not found:
            return (np.zeros(0, np.int64),) * 3
        return tuple(np.concatenate(x) for x in zip(*found, strict=True))

    def _search(self, c: dict, text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        m, b, n = c["m"], c["b"], len(text)
        padded = np.concatenate([text, np.zeros(8, np.uint8)])
        end = np.arange(m, n + 1, STRETCH, dtype=np.int64)  # a stretch owns the windows that end in it
        last = np.minimum(end + STRETCH, n + 1)
        hits = []
        while len(end):
            move = c["shift"][_slot(_load(padded, end - b) & c["mask"])].astype(np.int64)
            stop = move == 0
            if stop.any():
                hits.append(end[stop])
            end = end + np.maximum(move, 1)
            live = end < last
            end, last = end[live], last[live]
        if not hits:
            return (np.zeros(0, np.int64),) * 3
        start = np.concatenate(hits) - m
        key = _key(_load(padded, start + m - b) & c["mask"], _load(padded, start) & c["mask"])
        lo, hi = np.searchsorted(c["key"], key, "left"), np.searchsorted(c["key"], key, "right")
        out = ([], [], [])
        some = hi > lo
        start, lo, hi = start[some], lo[some], hi[some]
        while len(start):  # one pattern of each bucket at a time: memory stays that of the positions
            pattern = c["pattern"][lo]
            length, first = self.length[pattern].astype(np.int64), self.first[pattern].astype(np.int64)
            ok = start + length <= n
            for k in range(0, int(length.max(initial=0)), 8):
                rest = np.minimum(8, length - k)
                test = np.flatnonzero(ok & (rest > 0))
                if not len(test):
                    break
                cut = U64(64) - U64(8) * rest[test].astype(np.uint64)
                diff = _load(padded, start[test] + k) ^ _load(self.text, first[test] + k)
                ok[test] = (diff << cut) == 0
            for x, y in zip(out, (start[ok], length[ok], pattern[ok]), strict=True):
                x.append(y)
            lo = lo + 1
            more = lo < hi
            start, lo, hi = start[more], lo[more], hi[more]
        return tuple(np.concatenate(x) if x else np.zeros(0, np.int64) for x in out)


def _load(text: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The eight bytes at each place as one little-endian number."""
    view = np.ndarray(len(text) - 7, "<u8", text, 0, (1,))
    return view[np.minimum(at, len(text) - 8)]


def _slot(block: np.ndarray) -> np.ndarray:
    return (block * _MUL) >> U64(64 - TABLE_BITS)


def _key(suffix: np.ndarray, prefix: np.ndarray) -> np.ndarray:
    return suffix * _MUL ^ (prefix * U64(0xC2B2AE3D27D4EB4F))


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _scan(patterns: Patterns, data: np.ndarray, offsets: np.ndarray) -> tuple[list[int], dict[int, list], dict[int, set]]:
    """Words of each document; word spans and items of those with occurrences."""
    n_words, spans, items = [], {}, {}
    for i, j in blocks(offsets):
        text, starts, before = _joined(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        n_words += np.diff(before).tolist()
        at, length, pattern = patterns.search(text)
        if not len(at):
            continue
        first = np.searchsorted(starts, at + 1)
        past = np.searchsorted(starts, at + length - 1)
        doc = np.searchsorted(before, first, "right") - 1
        base = before[doc]
        for d, a, b, p in zip((doc + i).tolist(), (first - base).tolist(), (past - base).tolist(), pattern.tolist(), strict=True):
            spans.setdefault(d, []).append((a, b))
            items.setdefault(d, set()).update(patterns.items_of(p))
    return n_words, {d: _merged(x) for d, x in spans.items()}, items


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", width: int = WIDTH, pattern_bytes: int = PATTERN_BYTES) -> DataFrame:
    """Add to ``docs``: ``n_words``, ``hit_spans`` (array of first word and word past the end, disjoint, in order) and ``hit_items`` (ids as strings, sorted).

    Null and wordless texts have no words and no hits; null or wordless items have no
    windows; an item without id marks words but is not listed; repeated rows and items
    repeat; with an empty benchmark nothing is hit. Columns of ``docs`` that have one of
    the three new names are replaced, all others stay. Texts are searched whole, whatever their length; items of
    equal text are hit together, each under its id, so that nothing ties; an empty table gives no rows."""
    docs = in_small_batches(without(docs, NEW))
    spark = docs.sparkSession
    items = benchmark.select(F.col(item_col).cast("string").alias("item"), F.col(item_text).alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n_blocks = max(1, -(-total // pattern_bytes))
    schema = T.StructType([*docs.schema.fields, T.StructField("n_words", T.LongType()), T.StructField("hit_spans", T.ArrayType(T.StructType([T.StructField("first", T.IntegerType()), T.StructField("past", T.IntegerType())]))), T.StructField("hit_items", T.ArrayType(T.StringType()))])
    for k in range(n_blocks):
        own = items if n_blocks == 1 else items.filter(F.pmod(F.xxhash64("item", "text"), F.lit(n_blocks)) == k)
        shared = spark.sparkContext.broadcast(Patterns([(r["item"], r["text"]) for r in own.collect()], width))
        docs = docs.mapInArrow(released(_searcher(shared, text_col, k > 0)), schema)
        if k < n_blocks - 1:
            docs = materialise(docs)
    return docs


def _searcher(shared, text_col: str, again: bool):
    spans_type = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = shared.value
        for batch in batches:
            names = batch.schema.names
            n_words, spans, items = _scan(patterns, *utf8(batch.column(names.index(text_col))))
            columns, n = list(batch.columns), batch.num_rows
            if again:  # columns of the blocks before
                for d, (old, ids) in enumerate(zip(columns[-2].to_pylist(), columns[-1].to_pylist(), strict=True)):
                    if old:
                        spans[d] = _merged([(x["first"], x["past"]) for x in old] + spans.get(d, []))
                    if ids:
                        items[d] = items.get(d, set()) | set(ids)
                columns, names = columns[:-3], names[:-3]
            columns.append(pa.array(n_words, pa.int64()))
            columns.append(pa.array([[{"first": a, "past": b} for a, b in spans.get(d, ())] for d in range(n)], spans_type))
            columns.append(pa.array([sorted(items.get(d, ())) for d in range(n)], pa.list_(pa.string())))
            yield pa.RecordBatch.from_arrays(columns, names=[*names, "n_words", "hit_spans", "hit_items"])

    return run


def remove_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents without a word inside a benchmark window, columns as they were, those of clashing names too.

    Null, empty and wordless texts stay; repeated rows stay or go each; with an empty benchmark all stay; an empty table gives no rows."""
    inside, back = set_aside(docs, NEW)
    return back(decontaminate(inside, benchmark).filter(F.size("hit_spans") == 0))


def op2_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in every document."""
    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda a, x: a + (x["past"] - x["first"]))
    return out.select("doc_id", "n_words", hit.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (F.size("hit_spans") > 0).alias("contaminated"))


_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, least(len(w), {WIDTH}) AS k, array_to_string(w[i:i + least(len(w), {WIDTH}) - 1], ' ') AS s
         FROM b, LATERAL (SELECT unnest(range(1, greatest(len(w) - {WIDTH}, 0) + 2)) AS i) WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM wins),
pos AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM d, ks, LATERAL (SELECT unnest(range(1, greatest(len(w) - k, -1) + 2)) AS i)),
occ AS (SELECT DISTINCT pos.doc_id, pos.k, pos.i, wins.item_id FROM pos JOIN wins ON pos.k = wins.k AND pos.s = wins.s),
hit AS (SELECT doc_id, count(DISTINCT i + j) AS n_hit FROM occ, LATERAL (SELECT unnest(range(0, k)) AS j) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS ids FROM occ GROUP BY doc_id)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""
