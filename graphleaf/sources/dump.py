"""Multistream dumps: bz2 files of many streams with about a hundred pages each, and their indexes.

``multistream`` is a data source with a partition for each group of streams, so that a
stream is decompressed once, where it is needed; it reads files that the executors can
open by path. ``xml_pages`` reads the same files through Spark's XML reader, from any store.
"""

from __future__ import annotations

import bz2
import html
import mmap
import re
from collections.abc import Iterator
from pathlib import Path
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from graphleaf.functions import text as X
from graphleaf.operators.graph import Graph
from graphleaf.sources.wikitext import parsed_pages

#: Bytes of a dump whose streams one task reads, or streams given by offset.
RANGE_BYTES, STREAMS_IN_PARTITION = 32 << 20, 64
_STREAM = re.compile(rb"BZh[1-9]1AY&SY")
_PAGE = re.compile(rb"<page>(.*?)(?:<revision>|</page>)", re.S)
_ID, _TITLE = re.compile(rb"<id>(\d+)</id>"), re.compile(rb"<title>(.*?)</title>", re.S)
PAGE_SCHEMA = "offset long, position int, page_id long, title string, ns int, redirect string, timestamp string, text string"


def stream_offsets(path: str, first: int = 0, past: int | None = None) -> list[int]:
    """Where the streams of a bz2 file begin, of those from ``first`` to ``past``."""
    with open(path, "rb") as f, mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ) as data:
        stop = len(data) if past is None else past
        return [m.start() for m in _STREAM.finditer(data, first, min(len(data), stop + 9)) if m.start() < stop]


def _whole_stream(f) -> bytes:
    """The decompressed stream that begins where the file is."""
    stream, out = bz2.BZ2Decompressor(), []
    while not stream.eof:
        block = f.read(1 << 18)
        if not block:
            raise EOFError("a stream has no end")
        out.append(stream.decompress(block))
    return b"".join(out)


def header_pages(data: bytes) -> list[tuple[int, str]]:
    """(page_id, title) of the pages in decompressed ``data``, read before the revision only."""
    out = []
    for m in _PAGE.finditer(data):
        number, title = _ID.search(m[1]), _TITLE.search(m[1])
        if number and title:
            out.append((int(number[1]), html.unescape(title[1].decode(errors="replace"))))
    return out


def pages_of(data: bytes) -> Iterator[tuple[int, str, int, str | None, str | None, str]]:
    """page_id, title, namespace, redirect title, timestamp and text of each page's latest revision (the first of equals)."""
    body = data.decode(errors="replace")
    first = body.find("<page>")
    past = body.rfind("</page>")
    if first < 0 or past < 0:
        return
    for page in ElementTree.fromstring(f"<pages>{body[first : past + 7]}</pages>"):
        best: tuple[str, str] | None = None
        for revision in page.findall("revision"):
            own = (revision.findtext("timestamp") or "", revision.findtext("text") or "")
            if best is None or own[0] > best[0]:
                best = own
        redirect = page.find("redirect")
        yield int(page.findtext("id") or 0), page.findtext("title") or "", int(page.findtext("ns") or 0), None if redirect is None else redirect.get("title"), best[0] if best else None, best[1] if best else ""


class MultistreamDump(DataSource):
    """``spark.read.format("multistream").load(path)``; ``text=false`` gives ids and titles only, ``offsets`` (parted by commas) reads only streams that begin there."""

    @classmethod
    def name(cls) -> str:
        return "multistream"

    def schema(self) -> str:
        return PAGE_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        offsets = self.options.get("offsets")
        return _StreamReader(self.options["path"], self.options.get("text", "true") != "false", None if offsets is None else {int(o) for o in offsets.split(",") if o})


class _Range(InputPartition):
    """The streams of a dump that begin in a range of bytes, or at the offsets given."""

    def __init__(self, path: str, first: int, past: int, offsets: list[int] | None = None):
        self.path, self.first, self.past, self.offsets = path, first, past, offsets


class _StreamReader(DataSourceReader):
    def __init__(self, path: str, text: bool, offsets: set[int] | None):
        self.path, self.text, self.offsets = path, text, offsets

    def partitions(self) -> list[InputPartition]:
        out = []
        for p in sorted(Path(self.path).glob("*.bz2")) if Path(self.path).is_dir() else [Path(self.path)]:
            if "index" in p.name:
                continue
            if self.offsets is not None and not Path(self.path).is_dir():  # known to be this file's
                wanted = sorted(self.offsets)
                out += [_Range(str(p), 0, 0, wanted[k : k + STREAMS_IN_PARTITION]) for k in range(0, len(wanted), STREAMS_IN_PARTITION)]
                continue
            out += [_Range(str(p), at, at + RANGE_BYTES) for at in range(0, p.stat().st_size, RANGE_BYTES)]
        return out

    def read(self, partition: _Range | None) -> Iterator[tuple]:
        if partition is None:  # there are no streams
            return
        starts = partition.offsets
        if starts is None:
            starts = [s for s in stream_offsets(partition.path, partition.first, partition.past) if self.offsets is None or s in self.offsets]
        with open(partition.path, "rb") as f:
            for start in starts:
                f.seek(start)
                data = _whole_stream(f)
                if self.text:
                    for k, (page, title, ns, redirect, stamp, text) in enumerate(pages_of(data)):
                        yield start, k, page, title, ns, redirect, stamp, text
                else:
                    for k, (page, title) in enumerate(header_pages(data)):
                        yield start, k, page, title, None, None, None, None


def multistream(spark: SparkSession, path: str, text: bool = True, offsets: list[int] | None = None) -> DataFrame:
    """Pages of a dump file or a folder of them; with ``offsets`` only the streams that begin there are decompressed."""
    spark.dataSource.register(MultistreamDump)
    reader = spark.read.format("multistream").option("text", str(text).lower())
    return (reader if offsets is None else reader.option("offsets", ",".join(map(str, offsets)))).load(path)


def xml_pages(spark: SparkSession, path: str) -> DataFrame:
    """page_id, title, ns, redirect, timestamp, text through Spark's XML reader; the schema is given, as titles may look like dates."""
    schema = "title string, ns int, id long, redirect struct<_title: string>, revision array<struct<id: long, timestamp: string, text: struct<_VALUE: string, _bytes: long>>>"
    raw = spark.read.format("xml").option("rowTag", "page").schema(schema).load(path)
    return raw.select(F.col("id").alias("page_id"), F.coalesce("title", F.lit("")).alias("title"), "ns", F.col("redirect._title").alias("redirect"), latest("revision").alias("r")).select("page_id", "title", "ns", "redirect", F.col("r.timestamp").alias("timestamp"), F.coalesce("r.text._VALUE", F.lit("")).alias("text"))


def latest(revisions: str):
    """The element with the greatest timestamp, the first of equals."""
    return F.reduce(revisions, F.get(F.col(revisions), F.lit(0)), lambda a, r: F.when(r["timestamp"] > a["timestamp"], r).otherwise(a))


def index_lines(spark: SparkSession, path: str) -> DataFrame:
    """``offset:page_id:title`` lines of a dump, in order of offset and place."""
    pages = multistream(spark, path, text=False)
    return pages.orderBy("offset", "position").select(F.concat_ws(":", "offset", "page_id", "title").alias("value"))


def parse_index(lines: DataFrame) -> DataFrame:
    """file, offset, page_id, title of index lines (value, file); lines with fewer parts or other offsets are skipped, titles may hold colons."""
    parts = F.split("value", ":", 3)
    ok = lines.filter((F.size(parts) == 3) & F.get(parts, F.lit(0)).rlike("^[0-9]+$") & F.get(parts, F.lit(1)).rlike("^[0-9]+$"))
    return ok.select("file", parts[0].cast("long").alias("offset"), parts[1].cast("long").alias("page_id"), X.canon_title(parts[2]).alias("title"))


def read_index(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """``parse_index`` of text or bz2 index files; ``file`` is the path."""
    return parse_index(spark.read.text(path).withColumn("file", F.col("_metadata.file_path")))


def with_ends(index: DataFrame) -> DataFrame:
    """Add ``end``, the next distinct offset in the file (null after the last)."""
    order = Window.partitionBy("file").orderBy("offset")
    ends = index.select("file", "offset").distinct().withColumn("end", F.lead("offset").over(order))
    return index.join(ends, ["file", "offset"])


def matched_entries(index: DataFrame, titles: DataFrame | None = None, page_ids: DataFrame | None = None) -> DataFrame:
    """Index entries with ``end`` whose title or page id is wanted; all if neither is given."""
    out = with_ends(index)
    if titles is None and page_ids is None:
        return out
    parts = []
    if titles is not None:
        parts.append(out.join(titles.select(X.canon_title(F.col("title")).alias("title")).distinct(), "title", "left_semi"))
    if page_ids is not None:
        parts.append(out.join(page_ids.select("page_id").distinct(), "page_id", "left_semi"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1]).distinct()


def require_all(wanted: DataFrame, found: DataFrame, key: str) -> None:
    """Raise LookupError with the first twenty wanted keys that were not found."""
    lost = [r[0] for r in missing(wanted, found, key).orderBy(key).limit(20).collect()]
    if lost:
        raise LookupError(f"not found: {lost}")


def repeated(pages: DataFrame, key: str = "page_id") -> DataFrame:
    """``key`` and ``n`` of the pages that occur more than once."""
    return pages.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def missing(wanted: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """The wanted keys that were not found, each once."""
    return wanted.select(key).distinct().join(found.select(key), key, "left_anti")


def require_unique(pages: DataFrame, key: str = "page_id") -> None:
    """Raise ValueError if a page occurs twice."""
    twice = [r[0] for r in repeated(pages, key).limit(20).collect()]
    if twice:
        raise ValueError(f"more than one page for {twice}")


def namespaces(pages: DataFrame) -> DataFrame:
    """Distinct namespaces, numbers first and in order."""
    number = F.col("ns").cast("string").try_cast("int")
    return pages.select(F.col("ns").cast("string").alias("ns"), number.isNull().alias("is_text"), number.alias("number")).distinct().orderBy("is_text", "number", "ns").select("ns")


def index_pairs(folder: str) -> list[tuple[str, str]]:
    """(dump, index) of each dump in ``folder``, or of the one dump that it is, with an index beside it.

    ``…multistream<part>.xml….bz2`` goes with ``…multistream-index<part>.txt….bz2``, any other ``….xml.bz2`` with ``…-index.txt.bz2``."""
    out = []
    for dump in sorted(Path(folder).glob("*.xml*.bz2")) if Path(folder).is_dir() else [Path(folder)]:
        stem = dump.name.replace("multistream", "multistream-index", 1) if "multistream" in dump.name else dump.name.replace(".xml", "-index.xml", 1)
        stem = stem.replace(".xml", ".txt", 1)
        for name in (stem, stem.removesuffix(".bz2")):
            if (dump.parent / name).exists():
                out.append((str(dump), str(dump.parent / name)))
                break
    return out


def graph_of_pages(pages: DataFrame, titles: DataFrame | None = None, chunk_size: int = X.CHUNK_SIZE, chunk_overlap: int = X.CHUNK_OVERLAP) -> Graph:
    """The graph of (page_id, title, redirect, text); links resolve against ``titles`` (page_id, title), by default the pages' own. Redirect pages are parsed as text too."""
    X.check_chunking(chunk_size, chunk_overlap)
    catalog = (titles if titles is not None else pages).select("page_id", X.canon_title(F.col("title")).alias("key")).groupBy("key").agg(F.min("page_id").alias("target"))
    parsed = parsed_pages(pages)
    paragraphs = parsed.filter("para_i is not null")
    named = paragraphs.select("page_id", "sec_i", "para_i", F.explode("targets").alias("t")).select("page_id", "sec_i", "para_i", X.canon_title(F.col("t")).alias("key"))
    moved = pages.filter("redirect is not null").select("page_id", X.canon_title(F.col("redirect")).alias("key")).join(catalog, "key").select("page_id", "target")
    return Graph(
        articles=pages.select("page_id", X.canon_title(F.col("title")).alias("title")), sections=parsed.select("page_id", "sec_i").distinct(), paragraphs=paragraphs.select("page_id", "sec_i", "para_i", "text"),
        links=named.filter("key <> ''").join(catalog, "key").select("page_id", "sec_i", "para_i", "target"), redirects=moved, chunk_size=chunk_size, chunk_overlap=chunk_overlap,
    )
