"""Near-duplicates by order MinHash, verified by banded alignment.

Equal texts become one node first. A node's k-mers of five words carry their occurrence
number; each of a table's hash functions samples the ``SAMPLED`` least of them and keeps
their order in the text, so that two texts share a sample about as often as their edit
similarity suggests. Further tables sample k-mers of three words, of which more survive scattered edits, and
for texts of fewer than 50 words k-mers of two; any text as like as ``SIMILARITY`` to one of up to 40 words has fewer than 51. Nodes with a common sample are candidates; a link is a pair whose
word sequences align with similarity 1 - distance / longer length of at least
``SIMILARITY``, found by a bit-parallel alignment within the band of allowed distances.

Candidates without all pairs: first each bucket's nodes are aligned with one leader of
the bucket, its node with the most company; then, in buckets that still hold several classes, nodes of different classes
are compared by the words they have in common, which bound the alignment from above, and
of those that pass first each node's best of every class, then all others are aligned. Pairs within a class need no alignment: classes are the
connected components of the links. Components are found by label propagation with
pointer jumping over written tables, nothing of which reaches the driver but a count.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.llm.common import U64, blocks, in_small_batches, materialise, mix, released, table, text_key, utf8, word_hashes

SAMPLED, SIMILARITY = 2, 0.8
#: Words of a k-mer, tables, and the number of words from which on a text is in none of them.
KINDS = ((5, 16, None), (3, 20, None), (2, 16, 51))
TABLES = sum(n for _, n, _ in KINDS)
BAG = 128
#: Members of a bucket that one task compares with each other or with as many others.
BLOCK_ROWS = 2000
_SEEDS = mix(np.arange(1, TABLES + 1, dtype=np.uint64) * U64(0xA24BAED4963EE407)) | U64(1)
_STEP = [U64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _kmers(h: np.ndarray, before: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Occurrence-labelled k-mers in text order and the number before each document; a shorter text is one k-mer."""
    n_words = np.diff(before)
    n = np.maximum(n_words - size + 1, np.minimum(n_words, 1))
    ahead = np.concatenate([[0], np.cumsum(n)])
    doc = np.repeat(np.arange(len(n)), n)
    at = before[doc] + np.arange(ahead[-1]) - ahead[doc]
    past = before[doc + 1]
    x = np.zeros(len(at), np.uint64)
    for k in range(size):
        use = at + k < past
        x[use] += h[at[use] + k] * _STEP[k]
    x = mix(x)
    order = np.lexsort((x, doc))  # stable: equal k-mers stay in text order
    xs, ds = x[order], doc[order]
    fresh = np.concatenate([[True], (xs[1:] != xs[:-1]) | (ds[1:] != ds[:-1])]) if len(xs) else np.zeros(0, bool)
    start = np.flatnonzero(fresh)
    nth = np.arange(len(xs)) - np.repeat(start, np.diff(np.append(start, len(xs))))
    x[order] = mix(xs + nth.astype(np.uint64) * U64(0x8CB92BA72F3D8DD7))
    return x, ahead


def sketch(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of words and order-MinHash keys (a row of ``TABLES`` for each document; 0 for texts that are in no such table)."""
    h, before = word_hashes(data, offsets)
    n_words, first = np.diff(before), 0
    keys = np.zeros((len(offsets) - 1, TABLES), np.uint64)
    for size, tables, most in KINDS:
        some = np.flatnonzero((n_words > 0) & (n_words < (most or np.inf)))
        if len(some):
            own = np.concatenate([[0], np.cumsum(n_words[some])])
            at = np.repeat(before[some] - own[:-1], n_words[some]) + np.arange(own[-1])
            keys[some, first : first + tables] = _sampled(*_kmers(h[at], own, size), range(first, first + tables))
        first += tables
    return n_words, keys


def _sampled(x: np.ndarray, ahead: np.ndarray, tables: range) -> np.ndarray:
    """The keys in some tables of documents with k-mers ``x``."""
    first, size = ahead[:-1], np.diff(ahead)
    keys = np.empty((len(first), len(tables)), np.uint64)
    for column, t in enumerate(tables):
        r = x * _SEEDS[t]
        key = np.full(len(first), t + 1, np.uint64)
        picked = []
        for _ in range(SAMPLED):
            least = np.minimum.reduceat(r, first)
            where = np.flatnonzero(r == np.repeat(least, size))
            owner = np.searchsorted(first, where, side="right") - 1
            at = np.full(len(first), -1)
            at[owner[::-1]] = where[::-1]
            picked.append(at)
            r[at] = U64(0xFFFFFFFFFFFFFFFF)
        for at in np.sort(np.stack(picked), 0):
            key = mix(key + x[at] * _STEP[1])
        keys[:, column] = key | U64(1)
    return keys


def aligned(a: list[int], b: list[int], similarity: float = SIMILARITY) -> bool:
    """Whether 1 - edit distance / longer length reaches ``similarity``."""
    most = int((1 - similarity) * max(len(a), len(b)) + 1e-9)
    return banded_distance(a, b, most) <= most


def banded_distance(a: list[int], b: list[int], most: int) -> int:
    """Edit distance of two sequences if at most ``most``, else ``most`` + 1: bit-parallel columns of the diagonals within ``most``."""
    if len(a) < len(b):
        a, b = b, a
    n, m = len(a), len(b)
    if n - m > most:
        return most + 1
    i = 0
    while i < m and a[i] == b[i]:
        i += 1
    j = 0
    while j < m - i and a[n - 1 - j] == b[m - 1 - j]:
        j += 1
    a, b = a[i : n - j], b[i : m - j]
    n, m = len(a), len(b)
    if not m or not most:
        return n if n <= most else most + 1
    most_here = min(most, n)
    width = 2 * most_here + 2
    full, top, below = (1 << width) - 1, 1 << (width - 1), 1 << (width - 2)
    where: dict[int, int] = {}
    bit = 1
    for c in a:
        where[c] = where.get(c, 0) | bit
        bit <<= 1
    vp, vn = (full << (width - most_here - 1)) & full, 0
    distance, start = most_here, most_here + 1 - width
    give_up = 2 * most_here - (n - m)  # the last columns take back no more than there are
    for k, c in enumerate(b):
        x = where.get(c, 0)
        x = (x >> start if start >= 0 else x << -start) & full
        d0 = ((((x & vp) + vp) ^ vp) | x | vn) & full
        hp = (vn | ~(d0 | vp)) & full
        hn = d0 & vp
        if k < n - most_here:
            distance += not d0 & top
        else:
            distance += bool(hp & below) - bool(hn & below)
            below >>= 1
        if distance > give_up:
            return most + 1
        d0 >>= 1
        vp = (hn | ~(d0 | hp)) & full
        vn = d0 & hp
        start += 1
    return distance if distance <= most else most + 1


def _sketches(docs: DataFrame) -> DataFrame:
    """node, n_words, keys (also packed) for each row of (node, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                n, keys = sketch(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(n) + 1, dtype=np.int32) * TABLES), pa.array(keys.ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(n.astype(np.int32)), lists, pa.array([k.tobytes() for k in keys.astype("<u8")], pa.binary())], names=["node", "n_words", "keys", "packed"])

    return docs.mapInArrow(released(run), "node binary, n_words int, keys array<long>, packed binary")


def _word_lists(docs: DataFrame) -> DataFrame:
    """node and its words as packed 32-bit hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(1))
            for i, j in blocks(offsets):
                h, before = word_hashes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                h = (h >> U64(32)).astype("<u4")
                words = [h[a:b].tobytes() for a, b in zip(before[:-1].tolist(), before[1:].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(words, pa.binary())], names=["node", "words"])

    return docs.mapInArrow(released(run), "node binary, words binary")


def _verified(pairs: DataFrame, words: DataFrame) -> DataFrame:
    """The pairs (a, b) whose words align."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, a = None, []
        for batch in batches:
            keep = []
            for left, right in zip(*(c.to_pylist() for c in batch.columns[2:]), strict=True):
                if left != last:
                    last, a = left, np.frombuffer(left, "<u4").tolist()
                keep.append(aligned(a, np.frombuffer(right, "<u4").tolist()))
            yield batch.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))

    left = words.select(F.col("node").alias("a"), F.col("words").alias("left"))
    right = words.select(F.col("node").alias("b"), F.col("words").alias("right"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "left", "right").mapInArrow(released(run), "a binary, b binary")


def components(links: DataFrame) -> DataFrame:
    """``node`` and ``label``, the least node of its component, for the nodes of undirected ``links`` (a, b)."""
    both = materialise(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = materialise(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")))
    while True:
        by = labels.select(F.col("node").alias("b"), F.col("label").alias("l"))
        near = both.join(by, "b").groupBy("a").agg(F.min("l").alias("l"))
        step = labels.join(near.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("old"), F.least("label", "l").alias("label"))
        jump = labels.select(F.col("node").alias("label"), F.col("label").alias("further"))
        after = materialise(step.join(jump, "label").select("node", "old", F.col("further").alias("label")))
        changed = after.filter("old <> label").limit(1).count()
        labels = after.select("node", "label")
        if not changed:
            return labels


def merged(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` of components after more ``links``: only the links between different labels are followed."""
    own = lambda c: labels.select(F.col("node").alias(c), F.col("label").alias(f"l{c}"))
    between = links.join(own("a"), "a", "left").join(own("b"), "b", "left").select(F.coalesce("la", "a").alias("x"), F.coalesce("lb", "b").alias("y"))
    up = components(between.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct()).select(F.col("node").alias("label"), F.col("label").alias("up"))
    fresh = up.select(F.col("label").alias("node")).join(labels, "node", "left_anti").select("node", F.col("node").alias("label"))
    return materialise(labels.union(fresh).join(up, "label", "left").select("node", F.coalesce("up", "label").alias("label")))


def _labelled_words(words: np.ndarray) -> np.ndarray:
    """Sorted codes of words with their occurrence numbers: what two texts have in common as multisets, their codes have as sets."""
    words = np.sort(words).astype(np.uint64)
    fresh = np.concatenate([[True], words[1:] != words[:-1]])
    nth = np.arange(len(words)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    return np.sort((words << U64(32)) | nth.astype(np.uint64))


class _Window:
    """Members of one bucket near in length to the next, with their bags in one growing array."""

    def __init__(self):
        self.bags, self.members, self.first = np.zeros((64, BAG), np.int32), [], 0

    def add(self, member: tuple, bag: np.ndarray) -> None:
        at = len(self.members)
        if at == len(self.bags):
            self.bags = np.concatenate([self.bags[self.first :], np.zeros((max(64, at - self.first), BAG), np.int32)])
            self.members, self.first = self.members[self.first :], 0
            at = len(self.members)
        self.bags[at] = bag
        self.members.append(member)

    def drop_shorter(self, least: float) -> None:
        while self.first < len(self.members) and self.members[self.first][0] < least:
            self.members[self.first] = ()
            self.first += 1

    def with_common(self, bag: np.ndarray, least: float) -> list[tuple]:
        out = []
        for k in range(self.first, len(self.members), 2048):
            own = self.bags[k : min(k + 2048, len(self.members))]
            out += [self.members[k + i] for i in np.flatnonzero(np.minimum(own, bag).sum(1) >= least).tolist()]
        return out


def _across(members: DataFrame, best: bool) -> DataFrame:
    """Pairs of members (bucket, t, node, n_words, words, keys, label, blocks) of a bucket with different labels whose common words allow the similarity.

    A pair comes from the first table in which it meets; if ``best``, of each node's pairs with one label only that with the most common words.
    A bucket of several blocks of members is dealt as all pairs of blocks, so that no task has more than two blocks of it at once."""
    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    others = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    members = members.withColumn("own", block).select("*", others.alias("other")).select("bucket", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), "own", "t", "node", "n_words", "words", "packed", "label")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, windows = None, {}
        for batch in batches:
            out: tuple[list, list] = ([], [])
            for bucket_here, lo, hi, own_block, t, node, n, packed, keys, label in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (bucket_here, lo, hi) != bucket:
                    bucket, windows = (bucket_here, lo, hi), {k: _Window() for k in (lo, hi)}
                window = windows[lo + hi - own_block]  # the members to compare with
                words, own_keys, least = np.frombuffer(packed, "<u4"), np.frombuffer(keys, "<u8"), SIMILARITY * n - 1e-9
                bag, own = np.bincount(words & (BAG - 1), minlength=BAG), _labelled_words(words)
                window.drop_shorter(least)  # sorted by words
                near: dict[bytes, list[tuple[int, bytes]]] = {}
                for _, other, other_words, other_label, other_keys in window.with_common(bag, least):
                    if other_label != label and (best or int((own_keys == other_keys).argmax()) == t):
                        common = len(np.intersect1d(own, other_words, assume_unique=True))
                        if common >= least:
                            near.setdefault(other_label, []).append((common, other))
                for found in near.values():
                    for _, other in [max(found)] if best else found:
                        out[0].append(min(node, other))
                        out[1].append(max(node, other))
                windows[own_block].add((n, node, own, label, own_keys), bag)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()) for x in out], names=["a", "b"])

    return members.repartition("bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi", "n_words", "node").mapInArrow(released(run), "a binary, b binary").distinct()


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, class_id, n_links``: the least id of the class, and the number of links found to other texts, a row for each row of ``docs``.

    Null texts count as empty and all empty texts are equal; texts without words are only
    near equal texts; repeated rows are copies; null ids are kept, and a class of null ids
    only has a null class; an empty table gives no rows; other columns are ignored. Texts of any
    length are sketched and aligned whole; of bucket leaders with equal company the greatest hash of the text leads; the links found can depend on that, the classes do not."""
    rows = _labelled(docs, id_col, text_col)
    least = rows.groupBy("label").agg(F.min("doc_id").alias("class_id"))
    return rows.join(least, "label").select("doc_id", "class_id", "n_links")


def _labelled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, node, label of the class, n_links for each row of ``docs``."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    source = in_small_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), text.alias("text"), text_key(text).alias("node"))
    sketched = materialise(_sketches(source.select("node", "text")).groupBy("node").agg(F.first("n_words").alias("n_words"), F.first("keys").alias("keys"), F.first("packed").alias("packed")))
    buckets = sketched.select("node", "n_words", F.posexplode("keys").alias("t", "key")).filter("key <> 0").select("node", "n_words", "t", F.xxhash64("t", "key").alias("bucket"))
    sizes = buckets.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    members = materialise(buckets.join(sizes, "bucket"))
    # a bucket's leader is the node with the most company over all its buckets: the text that others were made from, rather than another copy
    company = members.groupBy("node").agg(F.sum("n").alias("company"))
    leaders = members.join(company, "node").groupBy("bucket").agg(F.max(F.struct("company", "node", "n_words")).alias("leader")).select("bucket", F.col("leader.node").alias("leader"), F.col("leader.n_words").alias("leader_words"))
    shared = materialise(members.drop("n").join(leaders, "bucket"))
    words = materialise(_word_lists(source.select("node", "text").join(company.select("node"), "node", "left_semi").groupBy("node").agg(F.first("text").alias("text"))))
    near_length = F.least("n_words", "leader_words") >= SIMILARITY * F.greatest("n_words", "leader_words") - F.lit(1e-9)
    tested = materialise(shared.filter((F.col("leader") != F.col("node")) & near_length).select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct())
    links = materialise(_verified(tested, words))
    labels = components(links)

    keys = sketched.select("node", "packed").join(words, "node")
    for best in (True, False):  # the likeliest pairs first: few classes are left for the rest
        labelled = shared.select("bucket", "t", "node", "n_words").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        mixed = labelled.groupBy("bucket").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")).filter("lo <> hi").select("bucket", "blocks")
        across = labelled.join(mixed, "bucket").join(keys, "node").select("bucket", "t", "node", "n_words", "words", "packed", "label", "blocks")
        pairs = materialise(_across(across, best).join(tested, ["a", "b"], "left_anti"))
        tested = tested.union(pairs)
        more = materialise(_verified(pairs, words))
        links, labels = links.union(more), merged(labels, more)

    degree = links.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.count("*").alias("n_links"))
    rows = source.select("doc_id", "node").join(labels.join(degree, "node", "left"), "node", "left").select("doc_id", "node", F.coalesce("label", "node").alias("label"), F.coalesce("n_links", F.lit(0)).alias("n_links"))
    return materialise(rows)


def one_of_each_class(docs: DataFrame) -> DataFrame:
    """One row of each class, of the least id and then the least text hash, columns as they were; of rows that repeat id and text one stays; rows without id stay."""
    keep = _labelled(docs).filter("doc_id is not null").groupBy("label").agg(F.min(F.struct("doc_id", "node")).alias("k")).select(F.col("k.doc_id").alias("_kept_id"), F.col("k.node").alias("_kept_node"))
    own = docs.filter("doc_id is not null").withColumn("_own_node", text_key(F.coalesce(F.col("text"), F.lit(""))))
    kept = own.join(keep, (F.col("doc_id").cast("long") == F.col("_kept_id")) & (F.col("_own_node") == F.col("_kept_node")), "left_semi")
    return kept.dropDuplicates(["doc_id", "_own_node"]).select(*docs.columns).unionByName(docs.filter("doc_id is null"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate classes of all documents."""
    return near_classes(table(spark, sf_dir, "documents"))
