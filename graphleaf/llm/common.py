"""Shared pieces of the training-data operators.

Text reaches the numpy code as one UTF-8 byte buffer for each Arrow batch plus
offsets, so that work is done for many documents at once. Intermediate tables
that later steps read more than once are written as Parquet below the folder in
``spark.checkpoint.dir``; a lost executor then costs a re-read, not a recomputation.
"""

from __future__ import annotations

import atexit
import ctypes
import tempfile
import time
import uuid
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphleaf.session import ship

U64 = np.uint64
#: Bytes of text that the numpy code looks at together.
BLOCK = 1 << 20
BATCH_BYTES = 4 << 20

#: Seconds from one collection of the driver's garbage to the next, at least.
TIDY_SECONDS = 10

_written: list[tuple[SparkSession, str]] = []
_tidied = 0.0


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's checkpoint folder.

    Where none is set, a temporary folder becomes it on a single machine; on a cluster that is an error."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and context.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="graphleaf-"))
    return context.getCheckpointDir()


def in_small_batches(docs: DataFrame) -> DataFrame:
    """``docs``, its session sending Python workers at most ``BATCH_BYTES`` at a time (Spark's own limit counts rows, and rows may be long)."""
    ship(docs.sparkSession)
    docs.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return docs


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it again: lineage ends here."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/graphleaf-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    if not _written:
        atexit.register(_remove_written)
    _written.append((spark, path))
    _tidy(spark)
    return spark.read.schema(df.schema).parquet(path)


def _tidy(spark: SparkSession) -> None:
    """Let the driver's JVM collect what finished jobs have left, which it would keep, with their shuffle files, until its heap has grown."""
    global _tidied
    if time.monotonic() - _tidied >= TIDY_SECONDS:
        spark.sparkContext._jvm.System.gc()
        _tidied = time.monotonic()


def settle(build: Callable[[], DataFrame]) -> DataFrame:
    """``materialise`` what ``build`` gives and remove the tables that were materialised in building it."""
    before = len(_written)
    out = materialise(build())
    inner = _written[before:-1]
    del _written[before:-1]
    _remove(inner)
    return out


def _remove_written() -> None:
    _remove(_written)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            jvm = spark.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
        except Exception:  # the session may have ended first
            return


def released(run: Callable) -> Callable:
    """``run``, a function over Arrow batches, giving freed memory back to the system at its end: Python workers live on between tasks and stages."""

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            give_back()

    return whole


def give_back() -> None:
    """Return this process's freed memory to the system."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(text: Column) -> Column:
    """The 16 bytes of hash that stand for a text."""
    return F.substring(F.unhex(F.sha2(text, 256)), 1, 16)


def without(docs: DataFrame, names: Iterable[str]) -> DataFrame:
    """``docs`` less the columns that an operator's results of these names replace."""
    taken = {n.lower() for n in names}
    return docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in taken])


def set_aside(docs: DataFrame, names: Iterable[str]) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``docs`` with columns of these names renamed, and a function that takes a frame with all of them back to ``docs``' own columns."""
    taken = {n.lower() for n in names}
    inside = {c: f"own {k}" if c.lower() in taken else c for k, c in enumerate(docs.columns)}
    moved = docs.select(*[F.col(f"`{c}`").alias(a) for c, a in inside.items()])
    return moved, lambda df: df.select(*[F.col(f"`{a}`").alias(c) for c, a in inside.items()])


def dense_rank_slots(df: DataFrame, keys: list[str], order: list[str], out: str, rows_per_cell: int = 50_000) -> DataFrame:
    """Add ``out``: a gapless number from 0 within each value of ``keys``.

    A window over the keys alone would send a hot key to one task. Rows are dealt
    to hashed cells within the key; cell sizes are counted, their running totals
    give each cell's first number, and only the order inside a cell needs a sort.
    ``df`` should be cheap to read twice (a materialised table). Rows equal in
    ``keys`` and ``order`` take neighbouring numbers."""
    cells = max(1, -(-df.count() // rows_per_cell))
    dealt = df.withColumn("_cell", F.pmod(F.xxhash64(*order), F.lit(cells)).cast("int"))
    sizes = dealt.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_cell").alias("_k_cell"), F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_first"))
    same = F.col("_cell") == F.col("_k_cell")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    inside = Window.partitionBy(*keys, "_cell").orderBy(*order)
    numbered = dealt.withColumn("_row", F.row_number().over(inside))
    return numbered.join(starts, same).withColumn(out, (F.col("_row") - 1 + F.col("_first")).cast("long")).select(*df.columns, out)


# --- bytes of many documents ------------------------------------------------

def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Data and offsets (n + 1) of a string column; null is empty."""
    column = pc.fill_null(column, "" if not pa.types.is_binary(column.type) and not pa.types.is_large_binary(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64) if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def blocks(offsets: np.ndarray, most: int = BLOCK) -> Iterator[tuple[int, int]]:
    """Ranges of documents of at most ``most`` bytes, one longer document being a range of its own."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + most, side="right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


#: Word characters are 0-9, A-Z, a-z and every byte of a character beyond ASCII.
IS_WORD = np.zeros(256, bool)
IS_WORD[128:] = IS_WORD[48:58] = IS_WORD[65:91] = IS_WORD[97:123] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words, and the number of words before each document (n + 1)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    w = IS_WORD[data]
    edge = offsets[1:-1]
    edge = edge[(edge > 0) & (edge < len(data))]
    first = w.copy()
    first[1:] &= ~w[:-1]
    first[edge] = w[edge]
    last = w.copy()
    last[:-1] &= ~w[1:]
    last[edge - 1] = w[edge - 1]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offsets)


# --- hashing ----------------------------------------------------------------

def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit (the splitmix64 finaliser)."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


PRIME = (1 << 31) - 1


def _reduced(x: np.ndarray) -> np.ndarray:
    """A smaller number of the same remainder modulo ``PRIME``: of 64 bits about 33, of 34 bits about 31."""
    return (x & U64(PRIME)) + (x >> U64(31))


class Rolling:
    """Polynomial hash of any substring, modulo a prime in each of ``lanes``, from running sums over the bytes."""

    def __init__(self, seed: int, lanes: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(1, PRIME, (lanes, 256), dtype=np.uint64)
        self.bases = [int(b) for b in rng.integers(256, PRIME, lanes)]
        self.up = [np.ones(1, np.uint64)] * lanes
        self.down = [np.ones(1, np.uint64)] * lanes

    def _grow(self, n: int) -> None:
        if len(self.up[0]) < n:
            size = max(n, min(BLOCK + 1, 2 * len(self.up[0])))  # the driver hashes little
            self.up = [_powers(b, size) for b in self.bases]
            self.down = [_powers(pow(b, -1, PRIME), size) for b in self.bases]

    def running(self, data: np.ndarray) -> np.ndarray:
        """A row of sums for each lane; below 2**64 for texts of up to 2**32 bytes."""
        self._grow(len(data) + 1)
        out = np.zeros((len(self.values), len(data) + 1), np.uint64)
        for row, values, up in zip(out, self.values, self.up, strict=True):
            np.cumsum(_reduced(values[data] * up[: len(data)]), out=row[1:])
        return out

    def of(self, running: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """31 bits for each lane (of two at most), spread over 64 together with the length."""
        out = (ends - starts).astype(np.uint64)
        for row, down in zip(running, self.down, strict=True):
            x = _reduced(_reduced(row[ends] - row[starts])) * down[starts]
            x = _reduced(_reduced(_reduced(x)))
            out = mix(out) ^ np.where(x >= U64(PRIME), x - U64(PRIME), x)
        return mix(out)


def _powers(base: int, n: int) -> np.ndarray:
    out, have = np.ones(n, np.uint64), 1
    while have < n:
        more = min(have, n - have)
        out[have : have + more] = out[:more] * U64(pow(base, have, PRIME)) % U64(PRIME)
        have += more
    return out


class Grams:
    """Polynomial hash modulo 2**64 of the grams of one length: fast, for choosing places only, as built-up texts can collide in it."""

    def __init__(self, seed: int):
        rng = np.random.default_rng(seed)
        self.values = rng.integers(0, 1 << 64, 256, dtype=np.uint64)
        self.base = int(rng.integers(0, 1 << 62, dtype=np.uint64)) * 2 + 1
        self.up = self.down = np.ones(1, np.uint64)

    def of(self, data: np.ndarray, gram: int) -> np.ndarray:
        """The hash of the ``gram`` bytes from each place that has so many."""
        total = self._running(data)
        n = max(0, len(data) - gram + 1)
        return mix((total[gram : gram + n] - total[:n]) * self.down[:n])

    def between(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """The hash of the bytes from each start to its end."""
        total = self._running(data)
        return mix((total[ends] - total[starts]) * self.down[starts])

    def _running(self, data: np.ndarray) -> np.ndarray:
        if len(self.up) <= len(data):
            size = max(len(data), BLOCK) + 1
            self.up, self.down = (_wrapped_powers(b, size) for b in (self.base, pow(self.base, -1, 1 << 64)))
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.values[data] * self.up[: len(data)], out=total[1:])
        return total


def _wrapped_powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


ROLL_A, ROLL_B, GRAMS = Rolling(20_011, 2), Rolling(77_003, 1), Grams(20_011)


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A 64-bit hash of each word (A-Z as a-z) and the number of words before each document."""
    starts, ends, before = word_bounds(data, offsets)
    return ROLL_A.of(ROLL_A.running(LOWER[data]), starts, ends), before
