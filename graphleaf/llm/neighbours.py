"""Approximate nearest neighbours by cross-polytope hashing.

A pseudo-rotation is three rounds of random signs and a fast Hadamard transform. A hash is the
signed axis nearest to the rotated unit vector; a table's bucket is one hash, or two taken
together. A query scores every bucket of a table by the sum of its rotated components
along the bucket's axes and probes the best; all rows in them are its candidates, and their
inner products are taken exactly.

What is measured, not assumed: a bounded sample of queries meets all rows once, and each of its
true neighbours says how deep its bucket stands in each table. The cheapest kind and number of
tables and probes that find ``target`` of these neighbours serve the whole search; with as many probes as buckets it is
exact. A query whose probes find fewer than ``k`` rows is asked again, of all rows.

Work is dealt in blocks of rows: neighbouring small buckets share one, a bucket of many rows (copies, say) is split
over several by a hash. A row is sent once for each table, a query once to each block that holds a probed bucket; a task holds one
block and reads its queries past it, some at a time, keeping ``k`` rows for each.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphleaf.llm.common import in_small_batches, materialise, mix, released, table
from graphleaf.llm.vectors import finite_rows, matrix

NEIGHBOURS, EVERY = 20, 20
TARGET, SAMPLE = 0.96, 192
LEAST_TABLES, MOST_TABLES, SEED = 2, 4, 71
#: Buckets of a table at most; components (of rows) in a block; queries compared at a time.
MOST_BUCKETS, BLOCK_COMPONENTS, QUERIES = 1 << 16, 1 << 20, 64
_ROWS = 4096


class Rotations:
    """Pseudo-rotations of rows of ``width`` components, filled up to a power of two."""

    def __init__(self, width: int, number: int = 2 * MOST_TABLES):
        self.width, self.size = width, 1 << max(1, (width - 1).bit_length())
        self.signs = np.random.default_rng(SEED).choice(np.array([-1, 1], np.float32), (number, 3, self.size))

    def __call__(self, rows: np.ndarray, which: int) -> np.ndarray:
        """Unit rows, rotated; elementwise throughout, so that a row's result does not depend on its company."""
        x = np.zeros((len(rows), self.size), np.float32)
        x[:, : self.width] = rows / np.sqrt((rows * rows).sum(1, keepdims=True))
        for signs in self.signs[which]:
            x *= signs
            step = 1
            while step < self.size:
                pairs = x.reshape(len(x), self.size // (2 * step), 2, step)
                x = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], 2).reshape(len(x), self.size)
                step *= 2
            x /= np.float32(np.sqrt(self.size))
        return x


@dataclass(frozen=True)
class Kind:
    """Tables whose buckets are ``joined`` hashes taken together."""

    rotations: Rotations
    joined: int

    @property
    def buckets(self) -> int:
        return (2 * self.rotations.size) ** self.joined

    def codes(self, rows: np.ndarray, t: int) -> np.ndarray:
        """The bucket of each row in table ``t``."""
        out = np.zeros(len(rows), np.int64)
        for j in range(self.joined):
            y = self.rotations(rows, self.joined * t + j)
            axis = np.abs(y).argmax(1)
            out = out * 2 * self.rotations.size + 2 * axis + (y[np.arange(len(y)), axis] < 0)
        return out

    def scores(self, rows: np.ndarray, t: int) -> np.ndarray:
        """How near each bucket of table ``t`` is to each row."""
        out = np.zeros((len(rows), 1), np.float32)
        for j in range(self.joined):
            y = self.rotations(rows, self.joined * t + j)
            out = (out[:, :, None] + np.stack([y, -y], 2).reshape(len(y), 1, 2 * self.rotations.size)).reshape(len(y), out.shape[1] * 2 * self.rotations.size)
        return out

    def probed(self, rows: np.ndarray, t: int, probes: int) -> np.ndarray:
        """Which buckets of table ``t`` each row probes."""
        s = self.scores(rows, t)
        return s >= np.partition(s, -probes, 1)[:, -probes, None] if probes < self.buckets else np.ones(s.shape, bool)


@dataclass(frozen=True)
class Plan:
    """What a search does: kind of tables, their number, probes in each, and where the rows of each table's buckets are (first block, number of blocks)."""

    kind: Kind
    tables: int
    probes: int
    first: np.ndarray
    blocks: np.ndarray

    def blocks_of(self, t: int, probed: np.ndarray) -> np.ndarray:
        """The blocks of some buckets of table ``t``."""
        first, n = self.first[t, probed], self.blocks[t, probed]
        return np.unique(np.repeat(first - np.cumsum(n) + n, n) + np.arange(n.sum()))

    def table_of(self, block: int) -> int:
        return int(np.searchsorted(self.first.min(1), block, side="right")) - 1


def _chunks(batch: pa.RecordBatch, width: int) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray]]:
    """Numbers, ids and rows (filled up with zeros) of the vectors that take part, a bounded number at a time."""
    for i in range(0, batch.num_rows, _ROWS):
        part = batch.slice(i, _ROWS)
        at, sizes, values = finite_rows(part.column(1))
        x = matrix(sizes, values, width)
        some = x.any(1)
        if some.any():
            yield at[some] + i, part.column(0).take(pa.array(at[some])).to_numpy(), x[some]


def products(queries: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products of pairs of rows, each summed alike wherever it is computed."""
    return (queries * rows).sum(1)


def best_rows(queries: np.ndarray, query_ids: np.ndarray, rows: np.ndarray, ids: np.ndarray, k: int, allowed: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each query (number) the ``k`` nearest different ids other than its own among the allowed rows: numbers of queries and rows, and products."""
    s = queries @ rows.T
    s[query_ids[:, None] == ids] = -np.inf
    if allowed is not None:
        s[~allowed] = -np.inf
    room = 1e-13 * np.sqrt((queries**2).sum(1)) * np.sqrt((rows**2).sum(1).max(initial=0))
    most = s.shape[1]
    ask = min(k, most)
    while True:
        least = np.partition(s, most - ask, 1)[:, most - ask]
        q, r = np.nonzero((s >= (least - room)[:, None]) & (s > -np.inf))
        score = products(queries[q], rows[r])
        order = np.lexsort((ids[r], -score, q))
        q, r, score = q[order], r[order], score[order]
        # an id that repeats counts where it is nearest
        by_id = np.lexsort((np.arange(len(q)), ids[r], q))
        again = (np.diff(q[by_id]) == 0) & (np.diff(ids[r][by_id]) == 0)
        first = np.ones(len(q), bool)
        first[by_id[1:][again]] = False
        q, r, score = q[first], r[first], score[first]
        start = np.searchsorted(q, np.arange(len(queries)))
        found = np.bincount(q, minlength=len(queries))
        if ask == most or (found >= k).all() or not ((s > -np.inf).sum(1)[found < k] > ask).any():
            break
        ask = min(most, 4 * ask)
    keep = np.arange(len(q)) - start[q] < k
    return q[keep], r[keep], score[keep]


def _sampled_codes(source: DataFrame, kinds: list[Kind], ids: np.ndarray, queries: np.ndarray, width: int, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The true neighbours of sampled queries: the number of the query, and the row's bucket for each kind and table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, row_ids, x in _chunks(batch, width):
                q, r, score = best_rows(queries, ids, x, row_ids, k, None)
                near, back = np.unique(r, return_inverse=True)
                codes = np.stack([kind.codes(x[near], t)[back] for kind in kinds for t in range(MOST_TABLES)], 1)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(q) + 1, dtype=np.int32) * codes.shape[1]), pa.array(codes.ravel()))
                yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(row_ids[r]), pa.array(score), lists], names=["q", "vec_id", "score", "codes"])

    found = source.select("vec_id", "embedding").mapInArrow(released(run), "q int, vec_id long, score double, codes array<long>")
    best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
    top = found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("q", "codes").collect()  # at most k for each sampled query
    return np.array([r["q"] for r in top], np.int64), np.array([r["codes"] for r in top], np.int64).reshape(-1, len(kinds), MOST_TABLES)


def choose(kinds: list[Kind], queries: np.ndarray, q: np.ndarray, codes: np.ndarray, target: float) -> tuple[Kind, int, int]:
    """The kind, number of tables and probes that reach ``target`` of the sample's neighbours and read the least."""
    plans = []
    for c, kind in enumerate(kinds):
        depth = np.full(len(q), kind.buckets)
        for t in range(MOST_TABLES):
            for i, one in enumerate(queries):
                own = q == i
                scores = kind.scores(one[None], t)[0]
                depth[own] = np.minimum(depth[own], (scores > scores[codes[own, c, t], None]).sum(1))
            if t + 1 >= LEAST_TABLES:
                probes = int(np.sort(depth)[int(np.ceil(target * len(q))) - 1]) + 1 if len(q) else 1
                # a table's rows are sent once, which counts as reading a hundredth of them
                plans.append(((t + 1) * (probes / kind.buckets + 0.01), c, t + 1, probes))
    _, c, tables, probes = min(plans)
    return kinds[c], tables, probes


def _planned(source: DataFrame, kind: Kind, tables: int, probes: int, width: int) -> Plan:
    """Count the rows of each bucket and put them into blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros((tables, kind.buckets), np.int64)
        for batch in batches:
            for _, _, x in _chunks(batch, width):
                for t in range(tables):
                    n[t] += np.bincount(kind.codes(x, t), minlength=kind.buckets)
        t, code = np.nonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(t.astype(np.int32)), pa.array(code.astype(np.int32)), pa.array(n[t, code])], names=["t", "code", "n"])

    counts = np.zeros((tables, kind.buckets), np.int64)
    for r in source.select("vec_id", "embedding").mapInArrow(released(run), "t int, code int, n long").groupBy("t", "code").agg(F.sum("n").alias("n")).collect():  # a number for each bucket
        counts[r["t"], r["code"]] = r["n"]
    most = max(64, BLOCK_COMPONENTS // width)
    first, blocks, at = np.zeros(counts.shape, np.int64), np.zeros(counts.shape, np.int64), 0
    for t, own in enumerate(counts):
        large = own > most
        small = np.where(large, 0, own)
        group = (np.cumsum(small) - small) // most
        first[t] = at + np.unique(group, return_inverse=True)[1]
        blocks[t] = small > 0
        at = int(first[t].max()) + 1
        n = -(-own[large] // most)
        first[t, large] = at + np.cumsum(n) - n
        blocks[t, large] = n
        at += int(n.sum())
    return Plan(kind, tables, probes, first, blocks)


def _search(source: DataFrame, plan: Plan, width: int, k: int, stored: str) -> DataFrame:
    """query_id, vec_id, score, rank: the ``k`` best candidates of each row of (vec_id, embedding, asked) that is asked."""

    def dealt(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            asked = batch.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for at, ids, x in _chunks(batch, width):
                raw = np.ascontiguousarray(x.astype(stored))
                spread = (mix(ids.astype(np.uint64)) >> np.uint64(1)).astype(np.int64)
                queries = np.flatnonzero(asked[at])
                for t in range(plan.tables):
                    codes = plan.kind.codes(x, t)
                    yield _sent(plan.first[t, codes] + spread % plan.blocks[t, codes], False, ids, codes, raw)
                    for i in range(0, len(queries), QUERIES):
                        own = queries[i : i + QUERIES]
                        to = [plan.blocks_of(t, mask) for mask in plan.kind.probed(x[own], t, plan.probes)]
                        each = np.repeat(own, [len(b) for b in to])
                        yield _sent(np.concatenate(to), True, ids[each], np.zeros(len(each), np.int64), raw[each])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, whole = -1, [], None
        for batch in batches:
            block, is_query, ids, codes = (batch.column(c).to_numpy(zero_copy_only=False) for c in range(4))
            x = np.frombuffer(batch.column(4).buffers()[2], stored)[batch.column(4).offset * width :][: batch.num_rows * width].reshape(-1, width)
            edges = np.flatnonzero((np.diff(block) != 0) | (np.diff(is_query.astype(np.int8)) != 0)) + 1
            for a, b in zip([0, *edges.tolist()], [*edges.tolist(), batch.num_rows], strict=True):
                if block[a] != now:
                    now, held, whole = int(block[a]), [], None
                if not is_query[a]:
                    fresh = np.ones(b - a, bool)  # repeated rows stand together, as they are sorted
                    fresh[1:] = (np.diff(ids[a:b]) != 0) | (np.diff(x[a:b], axis=0) != 0).any(1)
                    held.append((ids[a:b][fresh], codes[a:b][fresh], x[a:b][fresh].astype(np.float64)))
                    continue
                if whole is None:
                    whole = [np.concatenate(parts) for parts in zip(*held, strict=True)] if held else None
                for i in range(a, b if whole else a, QUERIES):
                    j = min(b, i + QUERIES)
                    queries = x[i:j].astype(np.float64)
                    allowed = plan.kind.probed(queries, plan.table_of(now), plan.probes)[:, whole[1]]
                    q, r, score = best_rows(queries, ids[i:j], whole[2], whole[0], k, allowed)
                    yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][q]), pa.array(whole[0][r]), pa.array(score)], names=["query_id", "vec_id", "score"])

    sent = source.mapInArrow(released(dealt), "block int, is_query boolean, vec_id long, code int, row binary")
    found = sent.repartition("block").sortWithinPartitions("block", "is_query", "vec_id", "row").mapInArrow(released(compared), "query_id long, vec_id long, score double")
    # what is dealt by query stays so for both the distinct pairs and the ranks
    pairs = found.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return pairs.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _sent(block: np.ndarray, is_query: bool, ids: np.ndarray, codes: np.ndarray, raw: np.ndarray) -> pa.RecordBatch:
    offsets = np.arange(len(raw) + 1, dtype=np.int32) * (raw.shape[1] * raw.itemsize)
    rows = pa.Array.from_buffers(pa.binary(), len(raw), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(raw))])
    return pa.RecordBatch.from_arrays([pa.array(block.astype(np.int32)), pa.array(np.full(len(raw), is_query)), pa.array(ids), pa.array(codes.astype(np.int32)), rows], names=["block", "is_query", "vec_id", "code", "row"])


def nearest(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS, target: float = TARGET) -> DataFrame:
    """``query_id, rank, vec_id, score``: for each row whose id is divisible by ``every`` the ``k`` rows found with the largest inner products.

    Vectors that are null, empty, zero or hold nulls, NaN or infinities, and rows without id, take no part; shorter vectors count as filled up
    with zeros. Equal scores go by id. Repeated rows count once; an id with several vectors counts with the nearest, as a query with
    its best score to each. An empty table gives no rows; other columns are ignored. ``target`` is the share of the true neighbours
    of a bounded sample of queries that the probes must find; 1 makes the search exact for these only, so use ``exact`` where all must be found."""
    return _nearest(vectors, id_col, vector_col, every, k, target)


def exact(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", every: int = EVERY, k: int = NEIGHBOURS) -> DataFrame:
    """``nearest`` with every bucket probed."""
    return _nearest(vectors, id_col, vector_col, every, k, None)


def _nearest(vectors: DataFrame, id_col: str, vector_col: str, every: int, k: int, target: float | None) -> DataFrame:
    vectors = in_small_batches(vectors)
    stored = "<f4" if vectors.select(vector_col).schema[0].dataType.simpleString() == "array<float>" else "<f8"
    source = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter("vec_id is not null and size(embedding) > 0")
    source = source.withColumn("asked", F.col("vec_id") % every == 0)
    width = source.agg(F.max(F.size("embedding"))).first()[0] or 1
    rotations = Rotations(width)
    kinds = [kind for kind in (Kind(rotations, 1), Kind(rotations, 2)) if kind.joined == 1 or kind.buckets <= MOST_BUCKETS]
    if target is None:
        chosen = kinds[0], 1, kinds[0].buckets
    else:
        sampled = source.filter("asked").orderBy(F.xxhash64("vec_id"), "vec_id", "embedding").limit(SAMPLE).select("vec_id", "embedding")
        ids, queries = _collected(sampled, width)
        chosen = choose(kinds, queries, *_sampled_codes(source, kinds, ids, queries, width, k), target) if len(ids) else (kinds[0], 1, 1)
    top = materialise(_search(source, _planned(source, *chosen, width), width, k, stored))
    if target is None:
        return top
    filled = top.filter(F.col("rank") == k).select(F.col("query_id").alias("vec_id"))
    short = materialise(source.filter("asked").select("vec_id").distinct().join(filled, "vec_id", "left_anti"))
    if not short.limit(1).count():
        return top
    again = source.drop("asked").join(short.withColumn("asked", F.lit(True)), "vec_id", "left").withColumn("asked", F.coalesce("asked", F.lit(False)))
    everything = _planned(source, kinds[0], 1, kinds[0].buckets, width)
    whole = _search(again.select("vec_id", "embedding", "asked"), everything, width, k, stored)
    return top.join(short.withColumnRenamed("vec_id", "query_id"), "query_id", "left_anti").select("query_id", "rank", "vec_id", "score").union(whole)


def _collected(sampled: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and rows of a bounded sample, those that take part."""
    whole = sampled.toArrow().combine_chunks()
    parts = [(ids, x) for batch in whole.to_batches() for _, ids, x in _chunks(batch, width)]
    return (np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])) if parts else (np.zeros(0, np.int64), np.zeros((0, width)))


def op13_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every embedding whose id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"))
