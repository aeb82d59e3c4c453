"""Scalar text functions as column expressions, so that they stay inside generated code."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

CHUNK_SIZE, CHUNK_OVERLAP = 500, 40
INFOBOX = "{{Infobox"


def strip(c: Column) -> Column:
    """Without Unicode white space at either end (``trim`` takes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def canon_title(c: Column) -> Column:
    """``_``, CR and LF become spaces, then the ends are stripped."""
    return strip(F.translate(c, "_\r\n", "   "))


def normal_title(c: Column, stripped: bool = False) -> Column:
    """Lower case with spaces for ``_``; query titles are stripped too."""
    out = F.lower(F.translate(c, "_", " "))
    return strip(out) if stripped else out


def article_id(page: Column) -> Column:
    return F.concat(F.lit("article:"), page.cast("string"))


def section_id(page: Column, section: Column) -> Column:
    return F.concat(article_id(page), F.lit(":s"), section.cast("string"))


def paragraph_id(page: Column, section: Column, paragraph: Column) -> Column:
    return F.concat(section_id(page, section), F.lit(":p"), paragraph.cast("string"))


def chunk_id(page: Column, section: Column, paragraph: Column, chunk: Column) -> Column:
    return F.concat(paragraph_id(page, section, paragraph), F.lit(":c"), chunk.cast("string"))


def article_of(node: Column) -> Column:
    """``article:<page>`` at the front of a node id; null if there is none."""
    got = F.regexp_extract(node, "^(article:[^:]+)", 1)
    return F.when(got != "", got)


def paragraph_of(chunk: Column) -> Column:
    """The paragraph's id of a chunk's."""
    return F.regexp_replace(chunk, ":c[0-9]+$", "")


def check_chunking(size: int, overlap: int) -> None:
    if size <= 0:
        raise ValueError("chunk size must be positive")
    if overlap < 0 or overlap >= size:
        raise ValueError("chunk overlap must be at least 0 and below the size")


def chunk_count(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    check_chunking(size, overlap)
    n = F.length(text)
    return F.when(n == 0, 0).when(n <= size, 1).otherwise(1 + F.ceil((n - size) / (size - overlap))).cast("int")


def chunks(text: Column, size: int = CHUNK_SIZE, overlap: int = CHUNK_OVERLAP) -> Column:
    """Array of overlapping pieces; empty for an empty or null text."""
    n = F.coalesce(chunk_count(text, size, overlap), F.lit(0))
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.expr("cast(array() AS array<int>)"))
    return F.transform(at, lambda i: F.substring(text, i * F.lit(size - overlap) + F.lit(1), F.lit(size)))


def paragraphs(text: Column) -> Column:
    """Pieces between blank lines, stripped, blank ones dropped."""
    return F.filter(F.transform(F.split(text, "\n\n"), strip), lambda p: p != "")


def is_heading(line: Column) -> Column:
    """A whole line such as ``== Title ==``."""
    return line.rlike(r"\A\s*=+[^=]+=+\s*\z")


def heading_title(line: Column) -> Column:
    return F.trim(F.replace(line, F.lit("="), F.lit("")))


def headings(text: Column) -> Column:
    return F.transform(F.filter(F.split(text, "\n"), is_heading), heading_title)


#: ``{{Infobox``, ``{{`` where no such start is hidden in it, and ``}}``.
_BRACES = re.compile(r"\{\{Infobox|\{\{(?!\{Infobox)|\}\}")


def infobox_spans(text: str | None) -> list[str]:
    """Balanced ``{{Infobox ...}}`` spans in order of their starts, in one pass with a stack; nested ones on their own, unbalanced ones not at all."""
    opened: list[tuple[int, bool]] = []
    found: list[tuple[int, int]] = []
    for m in _BRACES.finditer(text or ""):
        if m[0] != "}}":
            opened.append((m.start(), m[0] == INFOBOX))
        elif opened:
            start, is_box = opened.pop()
            if is_box:
                found.append((start, m.end()))
    return [text[a:b] for a, b in sorted(found)]


def infoboxes(text: Column) -> Column:
    """The ``infobox_spans`` of a text."""
    return F.pandas_udf(lambda texts: texts.map(infobox_spans), "array<string>")(text)


def unquote(c: Column) -> Column:
    """Percent-decoding that keeps ``+`` and leaves a malformed text as it is."""
    return F.coalesce(F.try_url_decode(F.replace(c, F.lit("+"), F.lit("%2B"))), c)


def article_titles(raw: Column) -> Column:
    """Titles in a text of wiki links written one after another: the path after ``/wiki/``, decoded, without marks at its end."""
    links = F.filter(F.split(raw, r"(?=https?://)"), lambda u: u.contains("/wiki/"))
    path = lambda u: F.regexp_extract(u, r"/wiki/([^#?\s]+)", 1)
    titles = F.transform(links, lambda u: F.regexp_replace(F.translate(unquote(path(u)), "_", " "), r"[,;:!.\s]+$", ""))
    return F.filter(titles, lambda t: t != "")


def short_count(n: Column) -> Column:
    """1.5k, 2.0M, 3.1B; below a thousand as it is; halves are rounded up."""
    scaled = lambda d, s: F.concat(F.format_string("%.1f", n / F.lit(float(d))), F.lit(s))
    return F.when(n >= 1_000_000_000, scaled(1e9, "B")).when(n >= 1_000_000, scaled(1e6, "M")).when(n >= 1_000, scaled(1e3, "k")).otherwise(n.cast("string"))


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays as a plain sum in order; null if either is all zeros."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def vector_text(v: Column) -> Column:
    """A vector as text parted by ``;``, small values written ``1e-05``."""
    one = lambda x: F.regexp_replace(F.lower(x.cast("string")), r"e-(\d)$", "e-0$1")
    return F.array_join(F.transform(v, one), ";")


def clamp(value: int, least: int, most: int) -> int:
    return max(least, min(int(value), most))
