"""Best-fit packing planned on the histogram of lengths.

Documents become token pieces of at most ``capacity`` ids. Only the count of each
length (at most ``capacity`` rows) reaches the driver, where best-fit decreasing
runs over counts: sequences with equal room form ranges, and a range takes several
pieces of one length at a time. The plan lists, for each length, which ranks go to
which range of sequences; its segments number a few for each length, whatever the
number of documents. Pieces get a distributed rank within their length and join the
plan on it.

Words recur, so each worker keeps the ids of chunks between white space and of the pieces
that the tokenizer's own pattern cuts a lower-cased chunk into, which it encodes one by
one, and asks the tokenizer only for pieces that it has not seen: letter runs many at a time, told apart again by the
vocabulary's end-of-word mark. Texts with characters on which the libraries' Unicode tables
may differ, or with the text of a special token, go to the tokenizer whole.
"""

from __future__ import annotations

import bisect
import itertools
import re
import struct
import unicodedata
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.llm.common import ROLL_A, blocks, dense_rank_slots, in_small_batches, materialise, released, table, utf8

CAPACITY = 4096
END_ID = 1
MAX_CACHED, MAX_CHUNKS = 150_000, 1_000_000
END_OF_WORD = "</w>"
#: The pre-tokenizer's pattern, a fixed value of the vocabulary file.
PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: Texts that the tokenizer gets whole: beyond the basic plane, white space of one library only, capital sigma (lower case by context), special tokens.
_WHOLE = re.compile("[\U00010000-\U0010ffff\x1c-\x1f\u03a3]|<\\|")

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_workers: dict[str, PieceIds] = {}


class PieceIds:
    """Packed little-endian ids of texts, by pieces that are remembered."""

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        self.ends = {i for t, i in self.tokenizer.get_vocab().items() if t.endswith(END_OF_WORD)}
        self.known: dict[str, bytes] = {}
        self._forget()

    def _encode(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _learn(self, unknown: list[str]) -> None:
        letters = [p for p in unknown if p.isalpha()]
        for k in range(0, len(letters), 2000):
            part, words, word = letters[k : k + 2000], [], []
            for i in self._encode(" ".join(part)):
                word.append(i)
                if i in self.ends:
                    words.append(_packed(word))
                    word = []
            if len(words) == len(part):
                self.known.update(zip(part, words, strict=True))
        for p in unknown:
            if p not in self.known:
                self.known[p] = _packed(self._encode(p))

    def _fill(self, hashes: np.ndarray, chunks: list[str]) -> None:
        """Remember ``chunks``, parts of lower-cased texts between white space, by their hashes."""
        cut = list(map(_pieces, chunks))
        unknown = set(itertools.chain.from_iterable(cut)) - self.known.keys()
        if len(self.known) + len(unknown) > MAX_CACHED:
            self.known.clear()
            unknown = set(itertools.chain.from_iterable(cut))
        self._learn(sorted(unknown))
        known = self.known
        packed = [known[p[0]] if len(p) == 1 else b"".join(map(known.__getitem__, p)) for p in cut]
        many = np.fromiter(map(len, packed), np.int32, len(packed)) // 4
        where = np.searchsorted(self.hashes, hashes)
        self.first = np.insert(self.first, where, self.used + np.cumsum(many) - many)
        self.many = np.insert(self.many, where, many)
        self.hashes = np.insert(self.hashes, where, hashes)
        ids = np.frombuffer(b"".join(packed), "<u4")
        if self.used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[: self.used], np.empty(self.used + len(ids), "<u4")])
        self.pool[self.used : self.used + len(ids)] = ids
        self.used += len(ids)

    def _forget(self) -> None:
        self.hashes, self.first, self.many, self.pool, self.used = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(1 << 20, "<u4"), 0

    def _at(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of hashes among those remembered, and which are there."""
        at = np.searchsorted(self.hashes, hashes)
        if not len(self.hashes):
            return at, np.zeros(len(hashes), bool)
        at = np.minimum(at, len(self.hashes) - 1)
        return at, self.hashes[at] == hashes

    def of(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text. Chunks of all texts are sorted by hash, so that each distinct one is looked up once."""
        whole = [i for i, t in enumerate(texts) if _WHOLE.search(t)]
        out_of_line = set(whole)
        plain = [b"" if i in out_of_line else (t if t.isascii() else unicodedata.normalize("NFC", t)).lower().encode() for i, t in enumerate(texts)]
        joined = b"\n".join([*plain, b""])
        data = np.frombuffer(joined, np.uint8)
        past = np.cumsum([len(t) + 1 for t in plain])
        black = ~_SPACE[data]
        starts = np.flatnonzero(black & np.concatenate([[True], ~black[:-1]]))
        ends = np.flatnonzero(black & np.concatenate([~black[1:], [True]])) + 1
        hashes, first, nth = np.unique(ROLL_A.of(ROLL_A.running(data), starts, ends), return_index=True, return_inverse=True)
        _, there = self._at(hashes)
        new = np.flatnonzero(~there)
        if len(self.hashes) + len(new) > MAX_CHUNKS:  # emptied once; all chunks of these texts are filled together, even if they are more
            self._forget()
            new = np.arange(len(hashes))
        if len(new):
            a, b = starts[first[new]].tolist(), ends[first[new]].tolist()
            self._fill(hashes[new], [joined[x:y].decode() for x, y in zip(a, b, strict=True)])
        at, there = self._at(hashes)
        if not there.all():
            raise RuntimeError("chunks without ids")
        many, at = self.many[at].astype(np.int64), self.first[at]
        size = many[nth]
        run = np.cumsum(size)
        ids = self.pool[np.arange(run[-1] if len(run) else 0) - np.repeat(run - size - at[nth], size)]
        cut = np.concatenate([[0], run])[np.searchsorted(starts, past)]
        out = [ids[a:b].tobytes() for a, b in zip([0, *cut[:-1].tolist()], cut.tolist(), strict=True)]
        for i in whole:
            out[i] = _packed(self._encode(texts[i]))
        return out


def _pieces(chunk: str) -> list[str]:
    """``PIECES.findall``, with the usual cases, a letter run with or without ASCII marks after it, told apart sooner."""
    if chunk.isalpha():
        return [chunk]
    run = chunk.rstrip("!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~")
    return [run, chunk[len(run) :]] if run.isalpha() else PIECES.findall(chunk)


def _packed(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


def _tokenizer(tokenizer_file: str) -> PieceIds:
    if tokenizer_file not in _workers:
        _workers[tokenizer_file] = PieceIds(tokenizer_file)
    return _workers[tokenizer_file]


def pieces(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """A row for each piece: ``doc_id, piece, start, length, ids_crc32`` and, on demand, ``ids`` (packed little-endian unsigned 32-bit).

    Null and empty texts are the end id alone; every row of ``docs`` is a document, a repeated one too; a very long
    text gives as many pieces as it takes; null ids are kept; an empty table gives no rows; other columns are ignored; nothing ties."""
    kind = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids binary" * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = _tokenizer(tokenizer_file).of
        end, step = END_ID.to_bytes(4, "little"), 4 * capacity
        for batch in batches:
            for i, j in blocks(utf8(batch.column(1))[1]):
                part = batch.slice(i, j - i)
                cols = [[], [], [], [], [], []]
                texts = pc.fill_null(part.column(1), "").to_pylist()
                for doc, packed in zip(part.column(0).to_pylist(), ids_of(texts), strict=True):
                    packed += end
                    for n, at in enumerate(range(0, len(packed), step)):
                        own = packed[at : at + step]
                        for c, v in zip(cols, (doc, n, at // 4, len(own) // 4, zlib.crc32(own), own if with_ids else None), strict=True):
                            c.append(v)
                types = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
                names = ["doc_id", "piece", "start", "length", "ids_crc32", "ids"]
                m = 6 if with_ids else 5
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols[:m], types[:m], strict=True)], names=names[:m])

    return in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(released(run), kind)


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int, int]]:
    """Segments (length, first rank, rank past the end, first sequence, pieces a sequence, offset of the first) of best-fit decreasing."""
    room: list[tuple[int, int, int]] = []  # room, first sequence, sequences; in order of room
    segments, used = [], 0
    for length in sorted(histogram, reverse=True):
        count, rank = histogram[length], 0
        while count:
            k = bisect.bisect_left(room, (length,))
            if k < len(room):
                free, first, n = room.pop(k)
            else:
                each = capacity // length
                free, first, n = capacity, used, -(-count // each)
                used += n
            each = min(free // length, count)
            full = min(n, count // each)
            segments.append((length, rank, rank + full * each, first, each, capacity - free))
            rank, count = rank + full * each, count - full * each
            if free > each * length:
                bisect.insort(room, (free - each * length, first, full))
            if full < n:
                bisect.insort(room, (free, first + full, n - full))
    return segments


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Place every piece of ``docs``: the columns of ``pieces`` with ``sequence_id`` and ``offset``.

    An empty table gives no rows; repeated rows are packed each; other columns are ignored."""
    spark = docs.sparkSession
    all_pieces = materialise(pieces(docs, tokenizer_file, capacity, id_col, text_col, with_ids))
    histogram = {r["length"]: r["n"] for r in all_pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most capacity rows
    segments = plan(histogram, capacity)
    by_length: dict[int, list] = {}
    for s in segments:
        by_length.setdefault(s[0], []).append((s[2], s[1], s[3], s[4], s[5]))
    slots = spark.createDataFrame([(n, sorted(x)) for n, x in by_length.items()], "length long, parts array<struct<past: long, first: long, seq: long, each: long, at: long>>")
    ranked = dense_rank_slots(all_pieces.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids), ["length"], ["doc_id", "piece", "ids_crc32"], "rank")
    part = F.expr("filter(parts, p -> rank < p.past)[0]")
    placed = ranked.join(F.broadcast(slots), "length").withColumn("p", part)  # the plan: at most capacity rows
    nth = F.col("rank") - F.col("p.first")
    return placed.select("doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, (F.col("p.seq") + F.floor(nth / F.col("p.each"))).cast("long").alias("sequence_id"), (F.col("p.at") + F.pmod(nth, F.col("p.each")) * F.col("length")).cast("long").alias("offset"))


def default_tokenizer() -> str:
    import public_tokenizers

    return str(Path(public_tokenizers.path("word_bpe_49k.json")))


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in sequences of 4096 tokens."""
    return pack(table(spark, sf_dir, "documents"), default_tokenizer())
