"""Substring dedup by content-defined chunking with a gear rolling hash.

The gear hash of a place is the sum of table values of the bytes before it, each
shifted left once more than the next, so that it depends on the last ``GEAR_BYTES``
bytes only. A chunk ends where the hash's top bits are zero, not before ``LEAST`` and
not after ``MOST`` bytes; an insertion moves the cuts around it and no others. Chunks
with equal digests are equal; the one that comes first (by document id, then place)
stays and the others are duplicates. Short chunks also repeat by chance or in stock
phrases, so that only runs of neighbouring duplicates of at least ``RUN`` bytes go, or all
on demand. Digests have 93 bits, modulo primes, so that no two chunks are taken for equal
by chance or by their build.

One narrow row for each chunk is shuffled, by digest. Counting keeps one row for each
digest and task before the shuffle; the repeated digests are written, so that the one join
with them is between two plain shuffles, which Spark splits where a digest is frequent.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.llm.common import ROLL_A, ROLL_B, U64, blocks, in_small_batches, materialise, mix, released, set_aside, table, utf8

GEAR_BYTES, CUT_BITS = 32, 5
LEAST, MOST, RUN = 16, 256, 64
_GEAR = mix(np.arange(256, dtype=np.uint64) + U64(0x5851F42D4C957F2D)) >> U64(32)


def gear_hash(data: np.ndarray) -> np.ndarray:
    """For each place the 32-bit gear hash of the bytes up to it (those ``GEAR_BYTES`` that are left in 32 bits), by doubling."""
    h = _GEAR[data]
    span = 1
    while span < GEAR_BYTES:  # h covers span bytes; twice that from two parts
        longer = h.copy()
        longer[span:] += h[:-span] << U64(span)
        h = longer & U64(0xFFFFFFFF)
        span *= 2
    return h


def chunks(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends (in ``data``) of all chunks, and the number of chunks before each document."""
    n = len(offsets) - 1
    ends: list[int] = []
    before = np.zeros(n + 1, np.int64)
    if len(data):
        h = gear_hash(data)
        hit = np.flatnonzero(h >> U64(32 - CUT_BITS) == 0) + 1
        lo = np.searchsorted(hit, offsets[:-1], side="right").tolist()
        hi = np.searchsorted(hit, offsets[1:], side="left").tolist()
        hit = hit.tolist()
        edge = offsets.tolist()
        for d in range(n):
            at, stop = edge[d], edge[d + 1]
            for e in hit[lo[d] : hi[d]]:
                if e - at < max(LEAST, GEAR_BYTES if at == edge[d] else 0):
                    continue
                while e - at > MOST:
                    at += MOST
                    ends.append(at)
                if e - at >= LEAST:
                    at = e
                    ends.append(at)
            while stop - at > MOST:
                at += MOST
                ends.append(at)
            if at < stop:
                ends.append(stop)
            before[d + 1] = len(ends)
    past = np.array(ends, np.int64)
    starts = np.concatenate([[0], past[:-1]]) if len(past) else past
    return starts, past, before


_CHUNKS = pa.list_(pa.struct([("digest", pa.int64()), ("check", pa.int32()), ("start", pa.int32()), ("length", pa.int32())]))


def _chunk_lists(source: DataFrame) -> DataFrame:
    """doc_id, tie, n_bytes, chunks for each row of (doc_id, tie, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            for i, j in blocks(offsets):
                own, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                start, past, before = chunks(own, off)
                a, b = ROLL_A.of(ROLL_A.running(own), start, past), ROLL_B.of(ROLL_B.running(own), start, past)
                doc = np.repeat(np.arange(j - i), np.diff(before))
                parts = [pa.array(a.view(np.int64)), pa.array((b >> U64(32)).astype(np.uint32).view(np.int32)), pa.array((start - off[doc]).astype(np.int32)), pa.array((past - start).astype(np.int32))]
                lists = pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.StructArray.from_arrays(parts, names=["digest", "check", "start", "length"]))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(off)), lists], names=["doc_id", "tie", "n_bytes", "chunks"])

    return source.mapInArrow(released(run), "doc_id long, tie int, n_bytes long, chunks array<struct<digest: long, check: int, start: int, length: int>>")


def _runs(duplicates: DataFrame, least_run: int) -> DataFrame:
    """d, t, n_duplicates, spans: the number of each row's duplicate chunks, (start, length) each, and their runs of at least ``least_run`` bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            count, out = [], []
            for parts in batch.column(2).to_pylist():
                spans: list[list[int]] = []
                for start, length in sorted((p["start"], p["length"]) for p in parts):
                    if spans and spans[-1][1] == start:
                        spans[-1][1] = start + length
                    else:
                        spans.append([start, start + length])
                count.append(len(parts))
                out.append([{"first": a, "past": b} for a, b in spans if b - a >= least_run])
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count, pa.int64()), pa.array(out, pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())])))], names=["d", "t", "n_duplicates", "spans"])

    return duplicates.mapInArrow(released(run), "d long, t int, n_duplicates long, spans array<struct<first: int, past: int>>")


def _tie(text: Column) -> Column:
    return F.hash(text)


def duplicate_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = RUN) -> DataFrame:
    """``doc_id, tie, n_bytes, n_chunks, n_duplicates, spans`` for each row of ``docs``: byte spans of runs of at least ``least_run`` bytes (0: all) of chunks that occur before.

    Null texts count as empty and have no chunks; rows that repeat both id and text are one
    document; of rows with one id and several texts the order is that of ``tie``, a hash of the
    text; null ids come first; texts may be of any length; an empty table gives no rows; other
    columns are ignored."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), _tie(text).alias("tie"), text.alias("text"))
    lists = materialise(_chunk_lists(source))
    each = lists.select("doc_id", "tie", F.explode("chunks").alias("c")).select("doc_id", "tie", "c.*")
    here = F.struct("doc_id", "tie", "start")
    often = materialise(each.groupBy("digest", "check").agg(F.count("*").alias("n"), F.min(here).alias("first")).filter("n > 1").select("digest", "check", "first"))
    again = each.join(often, ["digest", "check"]).filter(~here.eqNullSafe(F.col("first")))
    found = again.groupBy("doc_id", "tie").agg(F.collect_set(F.struct("start", "length")).alias("parts"))  # the chunks of one text
    rows = lists.select("doc_id", "tie", "n_bytes", F.size("chunks").cast("long").alias("n_chunks"))
    out = rows.join(_runs(found, least_run), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("tie") == F.col("t")), "left")
    return out.select("doc_id", "tie", "n_bytes", "n_chunks", F.coalesce("n_duplicates", F.lit(0)).alias("n_duplicates"), F.coalesce("spans", F.expr("cast(array() AS array<struct<first: int, past: int>>)")).alias("spans"))


def remove_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_run: int = RUN) -> DataFrame:
    """``docs`` with the spans of ``duplicate_spans`` cut out of the texts, a character that loses a byte going whole.

    Every row stays, if with an empty text; null texts stay null; columns keep their names and order."""
    inside, back = set_aside(docs, ("_d", "_t", "_spans", "_tie"))
    spans = duplicate_spans(inside, id_col, text_col, least_run).filter(F.size("spans") > 0).select(F.col("doc_id").alias("_d"), F.col("tie").alias("_t"), F.col("spans").alias("_spans")).distinct()
    marked = inside.withColumn("_tie", _tie(F.coalesce(F.col(text_col), F.lit("")))).join(spans, F.col(id_col).cast("long").eqNullSafe(F.col("_d")) & (F.col("_tie") == F.col("_t")), "left")
    schema = marked.schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index(text_col)
            texts = batch.column(at).to_pylist()
            for i, gone in enumerate(batch.column(batch.schema.names.index("_spans")).to_pylist()):
                if gone:
                    raw = texts[i].encode()
                    edges = [0, *(x for s in gone for x in (s["first"], s["past"])), len(raw)]
                    texts[i] = "".join(raw[a:b].decode(errors="ignore") for a, b in zip(edges[::2], edges[1::2], strict=True))
            yield batch.set_column(at, batch.schema.field(at), pa.array(texts, batch.schema.field(at).type))

    return back(marked.mapInArrow(released(run), schema))


def op1_chunk_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Duplicate chunks of all documents."""
    out = duplicate_spans(table(spark, sf_dir, "documents"))
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + (s["past"] - s["first"]))
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws("-", s["first"], s["past"])), ",")
    return out.select("doc_id", "n_bytes", "n_chunks", "n_duplicates", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), spans.alias("spans"))
