"""How far the sources of a language differ in their words.

Each task counts the words of some documents at once, each language's and source's, with the number of documents beside. A term that enough
documents of its language hold becomes one wide row: its counts as an array over the language's sources, by number.
Higher-order functions turn counts into smoothed shares in whole billionths and, for each source, into the
differences to all later ones, which a sum that begins in every task adds up to the distances of pairs.
A row never holds more than one number for each source of its language; the differences of one term are taken
one source at a time. Where shares need what is known of a language, that small table is repeated for each of
``SALTS`` hashes of the terms, so that the terms of one language are never one task's.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphleaf.llm.common import IS_WORD, blocks, in_small_batches, materialise, released, table, utf8, word_bounds
from graphleaf.llm.common import LOWER as LOWER_BYTES

LEAST_DOCUMENTS, ADDED, SHARES, TERMS, SALTS = 30, 5, 1_000_000_000, 50, 32
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Lower-case letters and bytes beyond ASCII as they are, A-Z in lower case, a space for all that ends a term.
TERM_BYTES = np.where(IS_WORD & ~np.isin(np.arange(256), np.arange(48, 58)), LOWER_BYTES, 32).astype(np.uint8)
#: Bytes of text that a task counts together, and of a piece of a longer document.
GATHERED, PIECE = 8 << 20, 8 << 20


def share(count: Column, of: Column) -> Column:
    """1 + floor(10**9 (count + 5) / of), divided in three steps of a thousand, so that longs are exact for ``of`` up to 9 * 10**15."""
    out, rest = F.lit(0).cast("long"), count + ADDED
    whole = lambda x: F.call_function("div", x, of)
    # of is at least count + 5, and each rest is below it
    for _ in range(3):
        out, rest = out * 1000 + whole(rest * 1000), (rest * 1000) % of
    return out + 1


def counted(text: np.ndarray, offsets: np.ndarray, groups: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray, np.ndarray]:
    """For some documents' bytes and groups: each group and term once, with its occurrences and documents."""
    text = TERM_BYTES[text]
    starts, ends, before = word_bounds(text, offsets)
    if not len(starts):
        return groups[:0], pa.array([], pa.string()), starts, starts
    edges = np.concatenate([[0], np.cumsum(ends - starts)]).astype(np.int32)
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(edges), pa.py_buffer(text[IS_WORD[text]])).dictionary_encode()
    terms, size = words.dictionary, len(words.dictionary)
    at = np.repeat(np.arange(len(offsets) - 1), np.diff(before)) * size + np.asarray(words.indices)
    held, n = np.unique(at, return_counts=True)  # a document and a term
    pair = groups[held // size] * size + held % size
    order = np.argsort(pair, kind="stable")
    pair, n = pair[order], n[order]
    first = np.flatnonzero(np.diff(pair, prepend=-1))
    return pair[first] // size, terms.take(pa.array(pair[first] % size)), np.add.reduceat(n, first), np.diff(np.append(first, len(pair)))


def long_counted(text: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The terms of one long document and their occurrences, a piece of it at a time."""
    found: list[tuple[pa.Array, np.ndarray]] = []
    while len(text):
        end = len(text)
        if end > PIECE:  # after the last separator of a piece, or else before the first one behind it
            between = np.flatnonzero(~IS_WORD[TERM_BYTES[text[:PIECE]]])
            end = int(between[-1]) + 1 if len(between) else PIECE
            while end < len(text) and not len(between):
                between = np.flatnonzero(~IS_WORD[TERM_BYTES[text[end : end + PIECE]]])
                end = end + int(between[0]) if len(between) else min(len(text), end + PIECE)
        _, terms, n, _ = counted(text[:end], np.array([0, end]), np.zeros(1, np.int64))
        found, text = [*found, (terms, n)], text[end:]
        if len(found) > 8:
            found = [_added(found)]
    return _added(found)


def _added(found: list[tuple[pa.Array, np.ndarray]]) -> tuple[pa.Array, np.ndarray]:
    terms = pa.concat_arrays([f[0] for f in found]).dictionary_encode()
    n = np.zeros(len(terms.dictionary), np.int64)
    np.add.at(n, np.asarray(terms.indices), np.concatenate([f[1] for f in found]))
    return terms.dictionary, n


def term_counts(docs: DataFrame) -> DataFrame:
    """lang, source, term, n (occurrences), documents (of that language and source that hold the term)."""

    def one(rows: pa.Table) -> Iterator[pa.RecordBatch]:
        rows = rows.combine_chunks()
        langs, sources = (rows.column(c).chunk(0).dictionary_encode() for c in ("lang", "source"))
        groups = np.asarray(langs.indices).astype(np.int64) * len(sources.dictionary) + np.asarray(sources.indices)
        text, offsets = utf8(rows.column("text").chunk(0))
        for i, j in blocks(offsets, GATHERED):
            if offsets[j] - offsets[i] > PIECE and j == i + 1:
                terms, n = long_counted(text[offsets[i] : offsets[j]])
                group, documents = np.full(len(n), groups[i]), np.ones(len(n), np.int64)
            else:
                group, terms, n, documents = counted(text[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], groups[i:j])
            lang, source = np.divmod(group, len(sources.dictionary))
            yield pa.RecordBatch.from_arrays([langs.dictionary.take(pa.array(lang)), sources.dictionary.take(pa.array(source)), terms, pa.array(n), pa.array(documents)], names=["lang", "source", "term", "n", "documents"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(b.nbytes for b in held) >= GATHERED:
                yield from one(pa.Table.from_batches(held))
                held = []
        if sum(b.num_rows for b in held):
            yield from one(pa.Table.from_batches(held))

    counts = in_small_batches(docs).select("lang", "source", "text").mapInArrow(released(run), "lang string, source string, term string, n long, documents long")
    return counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("documents").alias("documents"))


def languages(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """lang, sources (in order), own (for each source N + 5 V), whole (the same of the language), terms (V)."""
    sums = kept.select("lang", F.explode("counts").alias("c")).groupBy("lang", "c.source").agg(F.sum("c.n").alias("total"))
    terms = kept.groupBy("lang").agg(F.count("*").alias("terms"))
    groups = docs.select("lang", "source").distinct().join(sums, ["lang", "source"], "left").join(terms, "lang", "left")
    terms, total = F.coalesce("terms", F.lit(0)), F.coalesce("total", F.lit(0))
    ordered = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", total.alias("total")))).alias("s"), F.first(terms).alias("terms"), F.sum(total).alias("total"))
    smoothed = ADDED * F.col("terms")
    return ordered.select("lang", F.col("s.source").alias("sources"), F.transform("s.total", lambda x: x + smoothed).alias("own"), (F.col("total") + smoothed).alias("whole"), "terms")


def wide_terms(kept: DataFrame, langs: DataFrame) -> DataFrame:
    """lang, term, n and p (over the language's sources), q (the language's)."""
    salted = langs.select("*", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    rows = kept.withColumn("salt", F.pmod(F.xxhash64("term"), F.lit(SALTS)).cast("int")).join(salted, ["lang", "salt"])
    by_source = F.map_from_entries("counts")
    rows = rows.select("lang", "term", "total", "own", "whole", F.transform("sources", lambda s: F.coalesce(F.try_element_at(by_source, s), F.lit(0))).alias("n"))
    return rows.select("lang", "term", "n", F.zip_with("n", "own", share).alias("p"), share(F.col("total"), F.col("whole")).alias("q"))


def pair_distances(wide: DataFrame) -> DataFrame:
    """lang, i, j (numbers of two sources, i < j), value."""
    ahead = wide.select("lang", F.posexplode("p").alias("i", "own"), "p").select("lang", "i", F.transform(F.slice("p", F.col("i") + 2, F.size("p")), lambda x: F.abs(x - F.col("own"))).alias("d"))
    return ahead.select("lang", "i", F.posexplode("d").alias("k", "f")).groupBy("lang", "i", (F.col("i") + F.col("k") + 1).alias("j")).agg(F.sum("f").alias("value"))


def divergence(docs: DataFrame, least_documents: int = LEAST_DOCUMENTS, terms: int = TERMS) -> DataFrame:
    """``lang, source, part, item, value, rank``: for each source of a language its distance to each other one
    (part ``pair``), and the terms it uses beyond the language's share, the first ``terms`` (part ``term``).

    Null text, lang and source count as ''. Documents without terms make their group known; a language
    without kept terms has distances of 0; a source alone in its language has no pairs. Repeated rows are documents each, as long as
    the text may be. Equal values go by item. An empty table gives no rows; other columns are ignored."""
    docs = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("text", "lang", "source")])
    by_term = term_counts(docs).groupBy("lang", "term").agg(F.collect_list(F.struct("source", "n")).alias("counts"), F.sum("n").alias("total"), F.sum("documents").alias("documents"))
    kept = materialise(by_term.filter(F.col("documents") >= least_documents).drop("documents"))
    langs = materialise(languages(docs, kept))
    wide = materialise(wide_terms(kept, langs))

    numbered = langs.select("lang", "sources", F.posexplode("sources").alias("i", "source"))
    others = numbered.select("lang", "i", "source", F.posexplode("sources").alias("j", "item")).filter("i <> j")
    sums = pair_distances(wide)
    both = sums.union(sums.select("lang", "j", "i", "value"))
    pairs = others.join(both, ["lang", "i", "j"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).alias("value"))

    excess = wide.select("lang", "term", "q", F.posexplode(F.arrays_zip("n", "p")).alias("i", "own")).filter("own.n > 0 and own.p > q").select("lang", "i", F.col("term").alias("item"), (F.col("own.p") - F.col("q")).alias("value"))
    order = [F.col("value").desc(), F.col("item")]
    first = excess.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "i").orderBy(*order))).filter(F.col("rank") <= terms)
    named = first.join(numbered.select("lang", "i", "source"), ["lang", "i"]).select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order))).unionByName(named)


def op12_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between the sources of each language of all documents, and each source's own terms."""
    return divergence(table(spark, sf_dir, "documents"))


ORACLE_SQL = rf"""
with d as (
    select row_number() over () as k, coalesce(lang, '') as lang, coalesce(source, '') as source,
        regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
    from documents),
w as (select k, lang, source, unnest(words) as term from d),
kept as materialized (select lang, term from w group by 1, 2 having count(distinct k) >= {LEAST_DOCUMENTS}),
v as (select lang, count(*) as v from kept group by 1),
counts as materialized (select lang, source, term, count(*) as n from w join kept using (lang, term) group by 1, 2, 3),
grps as (select distinct lang, source from d),
g as materialized (
    select lang, source, coalesce(v.v, 0) as v, coalesce(t.n, 0) as total
    from grps left join v using (lang) left join (select lang, source, sum(n) as n from counts group by 1, 2) t using (lang, source)),
p as materialized (
    select g.lang, g.source, kept.term, coalesce(c.n, 0) as n, 1 + (cast({SHARES} as hugeint) * (coalesce(c.n, 0) + {ADDED})) // (g.total + {ADDED} * g.v) as p
    from g join kept using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = kept.term),
q as materialized (
    select c.lang, c.term, 1 + (cast({SHARES} as hugeint) * (sum(c.n) + {ADDED})) // (any_value(t.total) + {ADDED} * any_value(v.v)) as q
    from counts c join v using (lang) join (select lang, sum(total) as total from g group by 1) t using (lang) group by 1, 2),
pair as (
    select a.lang, a.source, 'pair' as part, b.source as item, coalesce(f.value, 0) as value
    from g a join g b on a.lang = b.lang and a.source <> b.source
    left join (
        select x.lang, x.source, y.source as other, sum(abs(x.p - y.p)) as value
        from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3) f
    on f.lang = a.lang and f.source = a.source and f.other = b.source),
term as (select p.lang, p.source, 'term' as part, p.term as item, p.p - q.q as value from p join q using (lang, term) where p.n > 0 and p.p > q.q),
ranked as (
    select *, row_number() over (partition by lang, source, part order by value desc, item) as rank from (select * from pair union all select * from term))
select lang, source, part, item, cast(value as bigint) as value, cast(rank as integer) as rank from ranked where part = 'pair' or rank <= {TERMS}
"""
