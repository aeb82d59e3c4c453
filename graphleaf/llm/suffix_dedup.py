"""Removal of repeated passages with suffix arrays.

A byte goes if a string of ``length`` bytes that covers it starts anywhere else too; or,
on demand, only if such a string starts earlier, so that the corpus keeps the first of each
(by id, then hash of the text, then place).

Routing. Every string of ``length`` bytes has an anchor: the least of its ``gram``-byte
grams by hash, the first of equals. Equal strings have equal anchors, so only strings
with the same anchor need to meet. The starts of a text that share one anchor form a run,
whose segment reaches from its first start to the end of its last string. Anchors that
occur once are dropped; equal segments of one anchor are kept once, with their count.
Equal texts are one text with a count from the outset. The starts of one segment differ
(their anchor lies at different distances), so where all segments of an anchor are equal
every start repeats and nothing is sorted. Equal strings have their anchor at the same
distance, so of other segments only the parts are sorted whose common bytes another
segment of the anchor has at the same distances.

Suffix arrays. Segments are dealt by anchor to shards; the segments of an anchor that has
very many are split over several. A shard sorts the suffixes of its segments by
Larsson-Sadakane refinement: first by seven bytes, then only groups that are still tied,
by the rank of the suffix as far ahead as they are known to agree, until they agree in
``length`` bytes. Starts whose suffix then still has a neighbour's rank repeat. For anchors split over shards, the
classes of each shard go to merge tasks as sorted digests, and each shard's run is looked
up by binary search among those of all shards, a range of digests at a time.

Passages of so many words, whatever their bytes, take the same route with words for bytes:
a string is the text from the start of a word to the end of a later one, the anchor its
least gram of words, and starts are compared by digests of their strings.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.llm.common import GRAMS, ROLL_A, ROLL_B, U64, blocks, in_small_batches, materialise, mix, released, set_aside, settle, table, text_key, utf8, word_bounds

LENGTH, GRAM = 400, 64
#: Words of a passage and of its anchor.
WORDS, WORD_GRAM = 51, 8
#: Bytes of segments that are sorted together, and segments of one anchor that one shard takes.
SHARD_BYTES, SHARD_SEGMENTS = 1 << 19, 1000
#: Starts of a long text that are looked at together; a place takes 24 bits of a key.
PART_BYTES = 1 << 22
PART_WORDS = 1 << 19
#: Bytes of text whose anchors are found together: the arrays of eight bytes for each should stay in the processor's cache.
BLOCK_BYTES = 1 << 18
#: Digests of starts that are compared together.
SHARD_MARKS = 1 << 18
#: Rows that are Python objects at one time.
PYTHON_ROWS = 500
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOW = U64((1 << 24) - 1)


def anchors(data: np.ndarray, offsets: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Runs of starts: document, first start (within it), number of starts, hash of the anchor, digest of the segment."""
    size = np.diff(offsets)
    own = np.flatnonzero(size >= length)
    if not len(own):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(size) == 1 and size[0] >= PART_BYTES + length:  # a long text in parts: a run that crosses an edge becomes two
        parts = []
        for at in range(0, int(size[0]) - length + 1, PART_BYTES):
            piece = data[at : at + PART_BYTES + length - 1]
            doc, first, n, anchor, digest = anchors(piece, np.array([0, len(piece)]), length, gram)
            parts.append((doc, first + at, n, anchor, digest))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    v = GRAMS.of(data, gram)
    doc, first, stop, anchor = _runs(v, offsets, length, gram)
    return doc, first - offsets[doc], stop - first, anchor, _digests(data, first, stop + length - 1)


def _runs(v: np.ndarray, offsets: np.ndarray, length: int, gram: int) -> tuple[np.ndarray, ...]:
    """Runs of starts that share an anchor: document, first start, the place past the last, hash of the anchor; ``v``: hashes of the grams from each place."""
    size = np.diff(offsets)
    own = np.flatnonzero(size >= length)
    at = np.arange(len(v))
    w = length - gram + 1
    key = np.full(-(-len(v) // w) * w + w, U64(0xFFFFFFFFFFFFFFFF))
    key[: len(v)] = (v & ~_LOW) | at.astype(np.uint64)
    grid = key.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, 1).ravel()
    behind = np.minimum.accumulate(grid[:, ::-1], 1)[:, ::-1].ravel()
    n = int(offsets[-1]) - length + 1
    least = (np.minimum(behind[:n], ahead[w - 1 : w - 1 + n]) & _LOW).astype(np.int64)
    valid = np.zeros(n + 1, np.int8)
    np.add.at(valid, offsets[own], 1)
    np.add.at(valid, offsets[own] + size[own] - length + 1, -1)
    valid = np.cumsum(valid[:n]) > 0
    fresh = valid.copy()
    fresh[1:] &= (least[1:] != least[:-1]) | ~valid[:-1]
    fresh[offsets[own]] = True
    first = np.flatnonzero(fresh)
    doc = np.searchsorted(offsets, first, side="right") - 1
    stop = np.minimum(np.append(first[1:], n), offsets[doc + 1] - length + 1)
    return doc, first, stop, v[least[first]]


def word_anchors(data: np.ndarray, offsets: np.ndarray, words: int = WORDS, gram: int = WORD_GRAM) -> tuple[np.ndarray, ...]:
    """As ``anchors``, with starts counted in words and strings of so many words."""
    starts, ends, before = word_bounds(data, offsets)
    size = np.diff(before)
    if not (size >= words).any():
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),) * 2
    if len(size) == 1 and size[0] >= PART_WORDS + words:  # a long text in parts: a run that crosses an edge becomes two
        parts = []
        for at in range(0, int(size[0]) - words + 1, PART_WORDS):
            piece = data[starts[at] : ends[min(at + PART_WORDS + words - 1, int(size[0])) - 1]]
            doc, first, n, anchor, digest = word_anchors(piece, np.array([0, len(piece)]), words, gram)
            parts.append((doc, first + at, n, anchor, digest))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    v = GRAMS.between(data, starts[: len(starts) - gram + 1], ends[gram - 1 :])
    doc, first, stop, anchor = _runs(v, before, words, gram)
    return doc, first - before[doc], stop - first, anchor, _digests(data, starts[first], ends[stop + words - 2])


def _digests(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return ROLL_A.of(ROLL_A.running(data), starts, ends) ^ mix(ROLL_B.of(ROLL_B.running(data), starts, ends))


def suffix_array(text: np.ndarray, ends: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and their ranks by Larsson-Sadakane refinement; those that agree in ``depth`` bytes (seven at least), or to their ends, have one rank and stay in order of place.

    ``ends``: for each place, where its segment ends; a suffix ends there and comes before longer ones."""
    n = len(text)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    key = np.ndarray(n, ">u8", padded, 0, (1,)).astype(np.uint64)
    left = np.minimum(ends - np.arange(n), 7).astype(np.uint64)
    key = (key & (~U64(0) << (U64(8) * (U64(8) - left)))) | left  # seven bytes, and how many of them there are
    order = np.argsort(key)
    new = np.ones(n, bool)
    new[1:] = key[order][1:] != key[order][:-1]
    head = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n, np.int64)
    rank[order] = head
    known = 7
    tied = _tied(new)
    order[tied] = order[tied][np.argsort(head[tied] * n + order[tied])]
    while known < depth and len(tied):
        at = order[tied]
        ahead = at + min(known, depth - known)  # the last step ends at the depth
        inside = ahead < ends[at]
        second = np.where(inside, rank[np.minimum(ahead, n - 1)] + 1, 0)
        both = rank[at] * (n + 1) + second
        by = np.argsort(both, kind="stable")
        order[tied] = at[by]
        both = both[by]
        new = np.ones(len(both), bool)
        new[1:] = both[1:] != both[:-1]
        rank[order[tied]] = tied[np.maximum.accumulate(np.where(new, np.arange(len(both)), 0))]
        tied = tied[_tied(new)]
        known = min(2 * known, depth)
    return order, rank


def _tied(new: np.ndarray) -> np.ndarray:
    """Places of members of groups with more than one; ``new`` marks groups' first members."""
    alone = new.copy()
    alone[:-1] &= new[1:]
    return np.flatnonzero(~alone)


def common_prefixes(text: np.ndarray, ends: np.ndarray, order: np.ndarray, most: int = LENGTH, stretch: int = 64) -> np.ndarray:
    """Bytes that each suffix in order shares with the one before it, counted up to ``most``, by Kasai's rule over many stretches of text at once."""
    n = len(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    words = np.ndarray(n, "<u8", padded, 0, (1,))
    shared = np.zeros(n, np.int64)
    lanes = np.arange(0, n, stretch)
    k = np.zeros(len(lanes), np.int64)
    for step in range(stretch):
        at = lanes + step
        at = at[at < n]
        k = np.maximum(k[: len(at)] - 1, 0)
        other = before[at]
        room = np.minimum(np.minimum(ends[at] - at, np.where(other < 0, 0, ends[other] - other)), most)
        k = np.minimum(k, room)
        go = np.flatnonzero(k < room)
        while len(go):
            diff = words[at[go] + k[go]] ^ words[other[go] + k[go]]
            low = diff & (~diff + U64(1))
            same = np.where(diff == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
            k[go] = np.minimum(k[go] + same, room[go])
            go = go[(same == 8) & (k[go] < room[go])]
        shared[at] = k
    return shared[order]


def repeated_starts(segments: list[bytes], counts: np.ndarray, length: int = LENGTH, rank: np.ndarray | None = None) -> tuple[np.ndarray, ...]:
    """For all starts of all segments, one after another: segment, start, whether it repeats here, whether an earlier start here is equal, and its class (the place in the text of one member).

    ``rank``: the order in which the segments come first in the corpus; without it no start counts as later."""
    if not segments:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool), np.zeros(0, bool), np.zeros(0, np.int64)
    text = np.frombuffer(b"".join(segments), np.uint8)
    size = np.array([len(s) for s in segments], np.int64)
    past = np.cumsum(size)
    ends = np.repeat(past, size)
    order, rank_of = suffix_array(text, ends, length)
    same = np.zeros(len(text), bool)
    same[1:] = rank_of[order[1:]] == rank_of[order[:-1]]
    fresh = np.flatnonzero(~same)
    group = np.cumsum(~same) - 1
    class_of = np.empty(len(text), np.int64)
    class_of[order] = order[fresh][group]
    which = np.repeat(np.arange(len(size)), size)
    start = np.arange(len(text)) - (past - size)[which]
    weight = np.bincount(group, weights=np.asarray(counts)[which[order]])
    more = np.empty(len(text), bool)
    more[order] = (weight > 1)[group]
    later = np.zeros(len(text), bool)
    if rank is not None:
        when = (rank[which] * (int(size.max()) + 1) + start)[order]
        later[order] = when > np.minimum.reduceat(when, fresh)[group]
    use = np.flatnonzero(ends - np.arange(len(text)) >= length)
    return which[use], start[use], more[use], later[use], class_of[use]


def _narrowed(text: np.ndarray, size: np.ndarray, anchor: np.ndarray, counts: np.ndarray, whole: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """Parts of segments, of ``size`` bytes each in ``text``, outside of which no start repeats among the segments of its anchor: segment, first start, the place past the last.

    Starts are taken by their distance before the anchor, ``gram`` distances together. The bytes
    that all strings of these distances cover lie the same way in every segment; where no other
    segment of the anchor has them, none of the starts repeats. Their hashes may collide, which
    only keeps a part too many. ``whole``: segments that stay whole."""
    base = np.cumsum(size) - size
    n = size - length + 1
    v = GRAMS.of(text, gram)
    which = np.repeat(np.arange(len(size)), size)[: len(v)]
    at = np.arange(len(v)) - base[which]
    hit = np.flatnonzero((v == anchor[which]) & (at >= n[which] - 1) & (at <= length - gram))  # inside every string of the run; the first is the anchor
    lead = at[hit[np.searchsorted(which[hit], np.arange(len(size)))]]
    near = np.arange(0, length - gram + 1, gram)
    far = np.minimum(near + gram - 1, length - gram)
    first = np.maximum(lead[:, None] - far, 0)
    past = np.minimum(lead[:, None] - near + 1, n[:, None])
    segment, k = np.nonzero(first < past)
    place = base[segment] + lead[segment]
    mark = mix(GRAMS.between(text, place - near[k], place - far[k] + length) ^ anchor[segment]) ^ k.astype(np.uint64)
    _, of = np.unique(mark, return_inverse=True)
    keep = (np.bincount(of, weights=counts[segment]) > 1)[of] | whole[segment]
    segment, first, past = (x[keep][::-1] for x in (segment, first[segment, k], past[segment, k]))  # a segment's starts now ascend
    fresh = np.flatnonzero(np.concatenate([[True], (segment[1:] != segment[:-1]) | (first[1:] > past[:-1])])) if len(segment) else np.zeros(0, np.int64)
    last = np.append(fresh[1:], len(segment))[: len(fresh)] - 1
    return segment[fresh][::-1], first[fresh][::-1], past[last][::-1]


def _intervals(flags: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], flags.astype(np.int8), [0]])))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def _spans_of(cut: np.ndarray, places: np.ndarray) -> pa.ListArray:
    """Runs of the places in each range from one of ``cut`` to the next, counted from its beginning; no range is empty."""
    flags = np.zeros(cut[-1] + 1, bool)
    flags[places] = True
    begins, ends = flags[:-1].copy(), flags[:-1].copy()
    begins[1:] &= ~flags[:-2]
    ends &= ~flags[1:]
    begins[cut[:-1]] = flags[cut[:-1]]
    ends[cut[1:] - 1] = flags[cut[1:] - 1]
    first, past = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    base = cut[np.searchsorted(cut, first, "right") - 1]
    runs = pa.StructArray.from_arrays([pa.array((x - base).astype(np.int32)) for x in (first, past)], ["first", "past"])
    return pa.ListArray.from_arrays(pa.array(np.searchsorted(first, cut).astype(np.int32)), runs)


_SPANS = "array<struct<first: int, past: int>>"
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int32()), ("past", pa.int32())]))


def _anchor_rows(source: DataFrame, find: Callable) -> DataFrame:
    """node, doc, rows, runs of each row of (node, text, doc, rows) that is long enough; ``find``: ``anchors`` or ``word_anchors`` for some length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                doc, first, n, anchor, digest = find(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                cut = np.searchsorted(doc, np.arange(j - i + 1)).astype(np.int32)
                kinds = (("first", first.astype(np.int32)), ("n", n.astype(np.int32)), ("anchor", anchor.view(np.int64)), ("digest", digest.view(np.int64)))
                lists = [pa.ListArray.from_arrays(pa.array(cut), pa.array(v)) for _, v in kinds]
                rows = pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("node", "doc", "rows")), *lists], names=["node", "doc", "rows", *(k for k, _ in kinds)])
                yield rows.filter(pa.array(cut[1:] > cut[:-1]))

    return source.mapInArrow(released(run), "node binary, doc long, rows long, first array<int>, n array<int>, anchor array<long>, digest array<long>")


_KINDS = {"anchor": pa.int64(), "digest": pa.int64(), "copies": pa.int64(), "split": pa.int32(), "splits": pa.int32(), "doc": pa.int64(), "node": pa.binary(), "first": pa.int32(), "segment": pa.binary()}


def _segments(texts: DataFrame, length: int) -> DataFrame:
    """anchor, digest, copies, shard, number of the anchor's shards, first place (doc, node, first) and the bytes of each wanted segment of (node, text, wanted)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, PYTHON_ROWS):
                part, rows = batch.slice(k, PYTHON_ROWS), []
                for node, text, wanted in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    raw = text.encode()
                    rows += [(w["anchor"], w["digest"], w["copies"], w["split"], w["splits"], w["doc"], node, w["first"], raw[w["first"] : w["first"] + w["n"] + length - 1]) for w in wanted]
                yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS.values())], names=list(_KINDS))

    return texts.mapInArrow(released(run), "anchor long, digest long, copies long, split int, splits int, doc long, node binary, first int, segment binary")


def _sorted_shards(segments: DataFrame, length: int, gram: int, keep_first: bool) -> DataFrame:
    """For each segment its starts that repeat and those that come later than an equal one; for segments of split anchors also the digests of all starts, to be merged."""

    def shard(rows: list[tuple]) -> pa.RecordBatch:
        anchor, counts, split = np.array([r[0] for r in rows]).view(np.uint64), np.array([r[2] for r in rows]), np.array([r[3] > 0 for r in rows])
        size = np.array([len(r[8]) for r in rows])
        part, at, past = _narrowed(np.frombuffer(b"".join(r[8] for r in rows), np.uint8), size, anchor, counts, split, length, gram)
        texts = [rows[i][8][a : b + length - 1] for i, a, b in zip(part.tolist(), at.tolist(), past.tolist(), strict=True)]
        rank = np.empty(len(rows), np.int64)
        if keep_first:
            rank[sorted(range(len(rows)), key=lambda i: (rows[i][5] is not None, rows[i][5], rows[i][6], rows[i][7]))] = np.arange(len(rows))
        which, start, more, later, class_of = repeated_starts(texts, counts[part], length, rank[part] if keep_first else None)
        which, start = part[which], at[which] + start
        cut = np.concatenate([[0], np.cumsum(size - length + 1)])
        spans, late = (_spans_of(cut, cut[which[own]] + start[own]) for own in (more, later))
        text = np.frombuffer(b"".join(texts), np.uint8)
        listed = split[which]
        mark = _digests(text, class_of[listed], class_of[listed] + length).view(np.int64)
        many = np.bincount(which[listed], minlength=len(rows))
        marks = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(many)]).astype(np.int32)), pa.array(mark))
        own = {n: pa.array([r[k] for r in rows], t) for k, (n, t) in enumerate(_KINDS.items()) if n not in ("copies", "segment")}
        return pa.RecordBatch.from_arrays([*own.values(), spans, late, marks], names=[*own, "spans", "later", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if held and (size + len(row[8]) > SHARD_BYTES) and (row[0], row[3]) != (held[-1][0], held[-1][3]):
                    yield shard(held)
                    held, size = [], 0
                held.append(row)
                size += len(row[8])
        if held:
            yield shard(held)

    dealt = segments.repartition("anchor", "split").sortWithinPartitions("anchor", "split", "digest")
    return dealt.mapInArrow(released(run), f"anchor long, digest long, split int, splits int, doc long, node binary, first int, spans {_SPANS}, later {_SPANS}, marks array<long>")


def _word_marks(texts: DataFrame, words: int) -> DataFrame:
    """As ``_segments`` for strings of words, with the digests of the starts in place of the bytes."""
    kinds = {k: t for k, t in _KINDS.items() if k not in ("node", "segment")}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets, BLOCK_BYTES):
                lists = batch.column(2).slice(i, j - i)
                wanted = pa.RecordBatch.from_struct_array(lists.flatten())
                first, n = (wanted[c].to_numpy().astype(np.int64) for c in ("first", "n"))
                row = np.repeat(np.arange(j - i), pc.list_value_length(lists).to_numpy())
                own = data[offsets[i] : offsets[j]]
                starts, ends, before = word_bounds(own, offsets[i : j + 1] - offsets[i])
                cut = np.concatenate([[0], np.cumsum(n)])
                at = np.repeat(before[row] + first - cut[:-1], n) + np.arange(cut[-1])
                marks = pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(_in_parts(own, starts[at], ends[at + words - 1]).view(np.int64)))
                node = batch.column(0).slice(i, j - i).take(pa.array(row))
                yield pa.RecordBatch.from_arrays([*(wanted[k] for k in kinds), node, marks], names=[*kinds, "node", "marks"])

    return texts.mapInArrow(released(run), "anchor long, digest long, copies long, split int, splits int, doc long, first int, node binary, marks array<long>")


def _in_parts(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """``_digests`` of strings of one block of text, by the part of ``PART_BYTES`` that they start in."""
    out = np.empty(len(starts), np.uint64)
    part = starts // PART_BYTES
    for k in np.unique(part):
        own = np.flatnonzero(part == k)
        low, high = int(starts[own].min()), int(ends[own].max())
        out[own] = _digests(data[low:high], starts[own] - low, ends[own] - low)
    return out


def _counted_shards(segments: DataFrame) -> DataFrame:
    """As ``_sorted_shards``, of segments that hold the digests of their starts."""
    kinds = {k: t for k, t in _KINDS.items() if k not in ("copies", "segment")}

    def shard(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        own = pa.Table.from_batches(held).combine_chunks()
        mark, row = _flat(own["marks"])
        _, of = np.unique(mark, return_inverse=True)
        more = (np.bincount(of, weights=own["copies"].to_numpy()[row]) > 1)[of]
        cut = np.searchsorted(row, np.arange(len(own) + 1)).tolist()
        spans = pa.array([[{"first": a, "past": b} for a, b in _intervals(more[x:y])] for x, y in zip(cut[:-1], cut[1:], strict=True)], _SPANS_ARROW)
        late = pa.array([[]] * len(own), _SPANS_ARROW)
        marks = pc.if_else(pc.greater(own["split"], 0), own["marks"], pa.scalar([], own["marks"].type))
        return pa.RecordBatch.from_arrays([*(own[c].combine_chunks() for c in kinds), spans, late, marks.combine_chunks()], names=[*kinds, "spans", "later", "marks"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, last = [], 0, None
        for batch in batches:
            keys = list(zip(batch["anchor"].to_pylist(), batch["split"].to_pylist(), strict=True))
            many, at = pc.list_value_length(batch["marks"]).to_pylist(), 0
            for i, key in enumerate(keys):
                if size > SHARD_MARKS and key != last:
                    if i > at:
                        held.append(batch.slice(at, i - at))
                    yield shard(held)
                    held, size, at = [], 0, i
                size += many[i]
                last = key
            if at < len(keys):
                held.append(batch.slice(at))
        if held:
            yield shard(held)

    dealt = segments.repartition("anchor", "split").sortWithinPartitions("anchor", "split")
    return dealt.mapInArrow(released(run), f"anchor long, digest long, split int, splits int, doc long, node binary, first int, spans {_SPANS}, later {_SPANS}, marks array<long>")


def _merged(found: DataFrame) -> DataFrame:
    """anchor, digest, place, spans, later of segments of split anchors whose starts repeat over several shards.

    Marks travel as sorted arrays: each shard's, cut into as many ranges as the anchor has
    shards, meet those of the same range, and what several shards have goes back to each."""
    split = found.filter("split > 0").select("anchor", "split", "splits", "digest", "doc", "node", "first", "marks")
    runs = split.repartition("anchor", "split").sortWithinPartitions("anchor", "split").mapInArrow(released(_sorted_marks), "anchor long, range int, split int, mark array<long>, doc array<long>, node array<binary>, at array<int>")
    shared = runs.repartition("anchor", "range").sortWithinPartitions("anchor", "range").mapInArrow(released(_shared_marks), "anchor long, split int, marks array<long>, late array<long>")
    none = [F.lit(None).cast(t).alias(c) for c, t in (("digest", "long"), ("doc", "long"), ("node", "binary"), ("first", "int"))]
    both = split.select("anchor", "split", F.lit(1).alias("kind"), "digest", "doc", "node", "first", "marks", F.expr("cast(array() AS array<long>) AS late")).unionByName(shared.select("anchor", "split", F.lit(0).alias("kind"), *none, "marks", "late"))
    return both.repartition("anchor", "split").sortWithinPartitions("anchor", "split", "kind").mapInArrow(released(_marked_starts), f"anchor long, digest long, doc long, node binary, first int, spans {_SPANS}, later {_SPANS}")


def _groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[pa.Table]:
    """Tables of the neighbouring rows that are equal in ``keys``."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        values = list(zip(*(batch[k].to_pylist() for k in keys), strict=True))
        at = 0
        for i, own in enumerate(values):
            if own != last:
                if i > at:
                    held.append(batch.slice(at, i - at))
                if held:
                    yield pa.Table.from_batches(held)
                held, last, at = [], own, i
        if at < len(values):
            held.append(batch.slice(at))
    if held:
        yield pa.Table.from_batches(held)


def _flat(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers of a column of lists, and for each the row that it is from."""
    lists = column.combine_chunks()
    size = np.diff(lists.offsets.to_numpy())
    return lists.flatten().to_numpy(zero_copy_only=False), np.repeat(np.arange(len(size)), size)


def _list_of(values: pa.Array) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array([0, len(values)], pa.int32()), values)


def _by_place(mark: np.ndarray, doc: pa.Array, node: pa.Array, at: np.ndarray) -> np.ndarray:
    """The order of mark, then place; a null document comes first."""
    halves = np.frombuffer(b"".join(node.to_pylist()), ">u8").reshape(-1, 2) if len(node) else np.zeros((0, 2), ">u8")
    return np.lexsort((at, halves[:, 1], halves[:, 0], doc.fill_null(0).to_numpy(), doc.is_valid().to_numpy(zero_copy_only=False), mark))


def _sorted_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard of an anchor its distinct marks with their first places, a row for each range of marks."""
    for own in _groups(batches, "anchor", "split"):
        mark, row = _flat(own["marks"])
        start = np.arange(len(mark)) - np.searchsorted(row, row)
        doc, node = (own[c].combine_chunks().take(pa.array(row)) for c in ("doc", "node"))
        at = own["first"].to_numpy()[row] + start
        order = _by_place(mark, doc, node, at)
        order = order[np.concatenate([[True], mark[order][1:] != mark[order][:-1]])] if len(order) else order
        n = own["splits"][0].as_py()
        bounds = np.searchsorted(mark[order], np.linspace(-(1 << 63), 1 << 63, n + 1)[1:-1]) if n > 1 else []
        for k, part in enumerate(np.split(order, bounds)):
            if len(part):
                take = pa.array(part)
                lists = [_list_of(pa.array(mark[part])), _list_of(doc.take(take)), _list_of(node.take(take)), _list_of(pa.array(at[part].astype(np.int32)))]
                yield pa.RecordBatch.from_arrays([own["anchor"][:1].combine_chunks(), pa.array([k], pa.int32()), own["split"][:1].combine_chunks(), *lists], names=["anchor", "range", "split", "mark", "doc", "node", "at"])


def _shared_marks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each shard the marks that others have too, and those of them of which another shard has the first place.

    Each shard's sorted run is looked up by binary search among the marks of all."""
    for own in _groups(batches, "anchor", "range"):
        mark, row = _flat(own["mark"])
        everywhere = np.sort(mark)
        shared = np.flatnonzero(np.searchsorted(everywhere, mark, "right") - np.searchsorted(everywhere, mark, "left") > 1)
        mark, row, take = mark[shared], row[shared], pa.array(shared)
        doc, node, at = (own[c].combine_chunks().flatten().take(take) for c in ("doc", "node", "at"))
        order = _by_place(mark, doc, node, at.to_numpy())
        late = np.ones(len(mark), bool)
        late[order[np.concatenate([[True], mark[order][1:] != mark[order][:-1]])] if len(order) else order] = False
        for k in np.unique(row):
            mine = row == k
            yield pa.RecordBatch.from_arrays([own["anchor"].slice(k, 1).combine_chunks(), own["split"].slice(k, 1).combine_chunks(), _list_of(pa.array(mark[mine])), _list_of(pa.array(mark[mine & late]))], names=["anchor", "split", "marks", "late"])


def _marked_starts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Spans of the starts whose marks several shards have (rows of kind 0, which come first), and of those that come later than another shard's."""
    for own in _groups(batches, "anchor", "split"):
        kind = own["kind"].to_numpy()
        shared, of_shared = _flat(own["marks"])
        known, late = shared[kind[of_shared] == 0], _flat(own["late"])[0]
        segments = own.slice(int((kind == 0).sum()))
        if not len(known) or not len(segments):
            continue
        mark, row = _flat(segments["marks"])
        cut = np.searchsorted(row, np.arange(len(segments) + 1)).tolist()
        spans, later = (pa.array([[{"first": a, "past": b} for a, b in _intervals(flags[x:y])] for x, y in zip(cut[:-1], cut[1:], strict=True)], _SPANS_ARROW) for flags in (np.isin(mark, known), np.isin(mark, late)))
        columns = [segments[c].combine_chunks() for c in ("anchor", "digest", "doc", "node", "first")]
        rows = pa.RecordBatch.from_arrays([*columns, spans, later], names=["anchor", "digest", "doc", "node", "first", "spans", "later"])
        yield rows.filter(pc.greater(pc.list_value_length(rows["spans"]), 0))


def _covered(first: np.ndarray, past: np.ndarray, length: int) -> list[tuple[int, int]]:
    """Byte spans that strings at the starts from ``first`` to ``past`` cover, joined where they touch."""
    if not len(first):
        return []
    order = np.argsort(first)
    first, past = first[order], np.maximum.accumulate(past[order]) + length - 1
    fresh = np.flatnonzero(np.concatenate([[True], first[1:] > past[:-1]]))
    return list(zip(first[fresh].tolist(), past[np.append(fresh[1:], len(first)) - 1].tolist(), strict=True))


def _cut(texts: DataFrame, length: int, least_words: int) -> DataFrame:
    """node, doc, n_removed, n_spans, kept_sha256, removed, kept_text, whole of (node, doc, text, first, past): the starts of strings that go.

    ``whole``: the text has words enough to go altogether."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = {"node": pa.binary(), "doc": pa.int64(), "n_removed": pa.int64(), "n_spans": pa.int64(), "kept_sha256": pa.string(), "removed": _SPANS_ARROW, "kept_text": pa.string(), "whole": pa.bool_()}
        for batch in batches:
            for k in range(0, batch.num_rows, PYTHON_ROWS):
                part, rows = batch.slice(k, PYTHON_ROWS), []
                for i in range(part.num_rows):
                    raw, at, kept = part.column(2)[i].as_py().encode(), 0, []
                    gone = _covered(part.column(3)[i].values.to_numpy(), part.column(4)[i].values.to_numpy(), length)
                    if least_words:
                        gone = [(a, b) for a, b in gone if len(_WORD.findall(raw, a, b)) >= least_words]
                    for a, b in gone:
                        kept.append(raw[at:a])
                        at = b
                    kept.append(raw[at:])
                    left = "".join(p.decode(errors="ignore") for p in kept)
                    rows.append((part.column(0)[i].as_py(), part.column(1)[i].as_py(), sum(b - a for a, b in gone), len(gone), hashlib.sha256(b"".join(kept)).hexdigest(), [{"first": a, "past": b} for a, b in gone], left, not least_words or len(_WORD.findall(raw)) >= least_words))
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds.values())], names=list(kinds))

    return texts.mapInArrow(released(run), f"node binary, doc long, n_removed long, n_spans long, kept_sha256 string, removed {_SPANS}, kept_text string, whole boolean")


def repeated_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, least_words: int = 0) -> DataFrame:
    """For each distinct text with a repeated string of ``length`` bytes: ``node`` (its ``text_key``), ``doc`` (its least id), ``n_removed``, ``n_spans``, ``kept_sha256``, ``removed`` (byte spans), ``kept_text``, in which a character that loses a byte is gone whole, and ``whole``.

    With ``keep_first`` the first string of each class stays, so that these columns hold for
    the row of id ``doc``; all other rows of that text repeat it whole, and lose it if ``whole``
    is true. With ``least_words`` only spans of at least so many words go (runs of letters,
    digits and characters beyond ASCII). ``gram``, the bytes of an anchor, is below ``length``.

    Null texts count as empty; texts of less than ``length`` bytes lose nothing; of repeated
    rows and copies every one loses all, but with ``keep_first`` rows that repeat id and text
    are one; null ids come first; an empty table gives no rows; other columns are ignored;
    of equal places there is none, so nothing ties; texts may be of any length."""
    return _passages(_distinct(docs, text_col, id_col, length), length, gram, keep_first, least_words)


def _distinct(docs: DataFrame, text_col: str, id_col: str, least: int) -> DataFrame:
    """node, text, doc (the least id), rows of each distinct text of at least so many bytes."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc"), text_key(text).alias("node"), text.alias("text")).filter(F.octet_length("text") >= least)
    return materialise(source.groupBy("node").agg(F.first("text").alias("text"), F.min(F.struct("doc")).alias("doc"), F.count("*").alias("rows")).select("node", "text", "doc.doc", "rows"))


def _passages(texts: DataFrame, length: int = LENGTH, gram: int = GRAM, keep_first: bool = False, least_words: int = 0) -> DataFrame:
    """``repeated_passages`` of the result of ``_distinct``."""
    texts = texts.filter(F.octet_length("text") >= length)
    starts = _starts(texts, partial(anchors, length=length, gram=gram), lambda wanted: _sorted_shards(_segments(wanted, length), length, gram, keep_first), keep_first)
    return _cut(texts.select("node", "text").join(starts, "node").select("node", "doc", "text", "firsts", "pasts"), length, least_words)


def _starts(texts: DataFrame, find: Callable, shards: Callable, keep_first: bool = False) -> DataFrame:
    """node, doc, firsts, pasts of the distinct texts of (node, text, doc, rows) with starts that repeat.

    ``shards``: finds the starts that repeat among the wanted segments of (node, text, wanted)."""
    runs = materialise(_anchor_rows(texts, find))
    each = runs.select("node", "doc", "rows", F.explode(F.arrays_zip("first", "n", "anchor", "digest")).alias("r")).select("node", "doc", "rows", "r.*")
    kinds = each.groupBy("anchor", "digest").agg(F.sum("rows").alias("copies"))
    often = kinds.groupBy("anchor").agg(F.count("*").alias("kinds"), F.sum("copies").alias("total")).filter("total > 1").select("anchor", "kinds")
    splits = F.ceil(F.col("kinds") / SHARD_SEGMENTS)
    split = F.when(splits == 1, 0).otherwise(1 + F.pmod(F.xxhash64("digest"), splits)).cast("int")
    again = materialise(each.join(kinds.join(often, "anchor"), ["anchor", "digest"]).select("anchor", "digest", "copies", "kinds", "node", "doc", "first", "n"))
    wanted = materialise(again.groupBy("anchor", "digest", "copies", "kinds").agg(F.min(F.struct("doc", "node", "first", "n")).alias("at")).select("anchor", "digest", "copies", "at.*", "kinds", split.alias("split"), splits.cast("int").alias("splits")))
    by_text = wanted.filter("kinds > 1").groupBy("node").agg(F.collect_list(F.struct("anchor", "digest", "copies", "split", "splits", "doc", "first", "n")).alias("wanted"))
    found = materialise(shards(texts.join(by_text, "node").select("node", "text", "wanted")))
    none = F.array().cast(_SPANS)
    alike = wanted.filter("kinds = 1").select("anchor", "digest", "doc", "node", "first", F.array(F.struct(F.lit(0).alias("first"), F.col("n").alias("past"))).cast(_SPANS).alias("spans"), none.alias("later"))
    spans = found.filter(F.size("spans") > 0).select("anchor", "digest", "doc", "node", "first", "spans", "later").unionByName(_merged(found)).unionByName(alike)
    spans = spans.select("anchor", "digest", F.struct("doc", "node", "first").alias("at"), "spans", "later")
    here = F.struct("doc", "node", "first")
    use = F.when(here.eqNullSafe(F.col("at")), F.col("later")).otherwise(F.col("spans")) if keep_first else F.col("spans")
    moved = lambda end: F.transform("use", lambda s: s[end] + F.col("first"))
    flat = lambda c: F.flatten(F.collect_list(c)).alias(c)
    return again.join(spans, ["anchor", "digest"]).withColumn("use", use).select("node", "doc", moved("first").alias("firsts"), moved("past").alias("pasts")).groupBy("node").agg(F.first("doc").alias("doc"), flat("firsts"), flat("pasts"))


def repeated_word_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """For each distinct text with a passage of ``words`` words that also starts anywhere else: ``node`` (its ``text_key``), ``n_words`` in such passages and ``n_passages`` (maximal runs of such words).

    Words are runs of letters, digits and characters beyond ASCII; a passage is all bytes from the
    start of its first word to the end of its last, so case and marks count. Passages never cross
    texts; the first of equals counts too. ``gram``, the words of an anchor, is below ``words``.

    Null texts count as empty; texts of fewer words give no row; of repeated rows and copies
    every passage repeats; null ids are as others; an empty table gives no rows; texts may be
    of any length."""
    return _word_passages(_distinct(docs, text_col, id_col, 2 * words - 1), words, gram)


def _word_passages(texts: DataFrame, words: int = WORDS, gram: int = WORD_GRAM) -> DataFrame:
    """``repeated_word_passages`` of the result of ``_distinct``."""
    starts = _starts(texts.filter(F.octet_length("text") >= 2 * words - 1), partial(word_anchors, words=words, gram=gram), lambda wanted: _counted_shards(_word_marks(wanted, words)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = [_covered(first.values.to_numpy(), past.values.to_numpy(), words) for first, past in zip(batch.column(1), batch.column(2), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([sum(b - a for a, b in s) for s in spans], pa.int64()), pa.array([len(s) for s in spans], pa.int64())], names=["node", "n_words", "n_passages"])

    return starts.select("node", "firsts", "pasts").mapInArrow(run, "node binary, n_words long, n_passages long")


def remove_passages(docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", **how) -> DataFrame:
    """``docs`` with repeated passages cut out of the texts and ``n_chars``, if there, counted anew; ``how`` as for ``repeated_passages``.

    A character that loses a byte goes whole. Every row stays, if with an empty text; rows that
    lose nothing, null texts among them, are as they were; columns keep their names and order."""
    inside, back = set_aside(docs, ("_node", "_doc", "_kept", "_whole"))
    gone = settle(lambda: repeated_passages(inside, text_col, id_col, **how).select(F.col("node").alias("_node"), F.col("doc").alias("_doc"), F.col("kept_text").alias("_kept"), F.col("whole").alias("_whole")))
    own = F.col("_kept")
    if how.get("keep_first"):
        own = F.when(F.col(id_col).cast("long").eqNullSafe(F.col("_doc")), own).when(F.col("_whole"), F.lit(""))
    out = inside.withColumn("_node", text_key(F.coalesce(F.col(text_col), F.lit("")))).join(gone, "_node", "left").withColumn("_kept", own).withColumn(text_col, F.coalesce("_kept", text_col))
    if "n_chars" in inside.columns:
        out = out.withColumn("n_chars", F.when(F.col("_kept").isNotNull(), F.length("_kept").cast(dict(inside.dtypes)["n_chars"])).otherwise(F.col("n_chars")))
    return back(out)


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Passages of 400 bytes and more that repeat, cut out of all documents; beside them the words in passages of over 50 words that repeat, which may be shorter and stay in the text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    texts = _distinct(docs, "text", "doc_id", min(LENGTH, 2 * WORDS - 1))
    gone = settle(lambda: _passages(texts).select("node", "n_removed", "n_spans", "kept_sha256"))
    worded = settle(lambda: _word_passages(texts).select("node", F.col("n_words").alias("n_passage_words"), "n_passages"))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(text, 256).alias("whole")).withColumn("node", F.substring(F.unhex("whole"), 1, 16))
    none = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return rows.join(gone.join(worded, "node", "full"), "node", "left").select("doc_id", "n_bytes", none("n_removed"), none("n_spans"), F.coalesce("kept_sha256", "whole").alias("kept_sha256"), none("n_passage_words"), none("n_passages"))
