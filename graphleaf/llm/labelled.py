"""The bounded sample of labelled documents that a classifier is fitted on, and the fit."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from typing import TypeVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphleaf.llm.common import in_small_batches, released

Model = TypeVar("Model")


def is_held_out(doc_id: str = "doc_id") -> Column:
    """True where crc32 of the id as text is divisible by 5; a null id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def training_rows(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, most_bytes: int) -> DataFrame:
    """``doc_id, text, y``: at most ``most_rows`` texts of at most ``most_bytes`` bytes each, with labels 0 or 1.

    Rows are taken in the order of a hash of their id, so that the sample is the same
    each time; ids without a text of that size are passed over before rows are counted.
    Held-out and unlabelled rows never enter; of several labels of an id the highest
    counts, of several texts the least. The sample of ids is broadcast: its size is
    bounded by ``most_rows``."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    text = F.coalesce(F.col("text"), F.lit(""))
    short = docs.filter(F.octet_length(text) <= most_bytes).select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"))
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("y")).filter("doc_id is not null and y in (0, 1)").filter(~is_held_out()).groupBy("doc_id").agg(F.max("y").alias("y"))
    chosen = known.join(short.select("doc_id"), "doc_id", "left_semi").orderBy(*order).limit(most_rows)
    return short.join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.first("y").alias("y"))


def training_texts(docs: DataFrame, labels: DataFrame, label: str, most_rows: int, most_bytes: int) -> tuple[list[str], list[int]]:
    """Texts and labels of ``training_rows``, by id."""
    rows = training_rows(docs, labels, label, most_rows, most_bytes).collect()
    rows.sort(key=lambda r: r["doc_id"])
    return [r["text"] for r in rows], [r["y"] for r in rows]


def fitted(sample: DataFrame, fit: Callable[[list[str], list[int]], Model]) -> Model:
    """``fit`` of the texts and labels of ``training_rows``, by id: one task of an executor holds the bounded sample, and only the model reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((r for b in batches for r in zip(*(c.to_pylist() for c in b.columns), strict=True)), key=lambda r: r[0])
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows]))], pa.binary())], names=["model"])

    models = in_small_batches(sample.select("doc_id", "text", "y")).repartition(1).mapInArrow(released(run), "model binary").collect()
    return pickle.loads(models[0]["model"]) if models else fit([], [])  # an empty sample may have no task
