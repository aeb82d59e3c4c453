"""Wikitext to sections, paragraphs and links: the one step that needs a parser in Python.

Sections follow headings: the lead comes first, and the text of a section includes its
subsections. Paragraphs are parts between blank lines. A paragraph's plain text has no
templates, tables, comments, references or tags, links show their labels, and its links
are the targets of ``[[...]]`` in it.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_HEADING = re.compile(r"^(={1,6})[^=\n].*?\1[ \t]*$", re.M)
#: What the scanner stops at; everything between is text.
_TOKEN = re.compile(
    r"(?P<comment><!--.*?(?:-->|\Z))|<nowiki\s*/>|<nowiki\s*>(?P<nowiki>.*?)(?:</nowiki\s*>|\Z)|(?P<emptyref><ref\b[^<>]*/>)|(?P<ref><ref\b[^<>]*>)|(?P<endref></ref\s*>)|(?P<tag></?[a-zA-Z][^<>]*>)"
    r"|(?P<open>\{{2,})|(?P<close>\}{2,})|(?P<table>\{\|)|(?P<endtable>\|\}(?!\}))|(?P<link>\[\[)|(?P<outside>\[(?:https?:)?//[^\s\]]+[ \t]*)|(?P<brackets>\]+)|(?P<pipe>\|)|(?P<quotes>'{2,5})",
    re.S | re.I,
)


def sections(text: str) -> list[str]:
    """The lead, then each section with everything up to the next heading of its level or above."""
    found = [(m.start(), len(m[1])) for m in _HEADING.finditer(text)]
    ends = [len(text)] * len(found)
    within: list[int] = []  # headings whose sections are open, each deeper than the one before
    for i, (start, level) in enumerate(found):
        while within and found[within[-1]][1] >= level:
            ends[within.pop()] = start
        within.append(i)
    return [text[: found[0][0]] if found else text, *(text[start:end] for (start, _), end in zip(found, ends, strict=True))]


class _Scanner:
    """One pass over a piece of wikitext, with a stack of what is open.

    Templates, parameters, tables, references and comments leave no text; of a link its label is left, or else its target, of a link to outside its
    label; other tags and quotes go, their contents stay; nowiki contents stay as they are. What is never closed stays as text, a
    reference without its tag, and so do closing marks that close nothing. A mark that closes something makes text of what was opened inside and is still open."""

    def __init__(self, text: str):
        self.out: list[str] = []
        self.targets: list[str | None] = []
        self.open: list[tuple[str, int, int]] = []  # kind, where it is in ``out``, its number among the targets
        self.pipes: dict[int, int] = {}  # where a link's first pipe is, by where the link is
        self.count: dict[str, int] = {}
        at = 0
        for m in _TOKEN.finditer(text):
            self.out.append(text[at : m.start()])
            at = m.end()
            self._token(m.lastgroup, m)
        self.out.append(text[at:])

    def text(self) -> str:
        return html.unescape("".join(self.out))

    def links(self) -> list[str]:
        return [t.split("#", 1)[0].lstrip(":") for t in self.targets if t is not None]

    def _token(self, kind: str | None, m: re.Match) -> None:
        if kind == "nowiki":
            self.out.append(m[kind])
        elif kind == "open":
            n = len(m[0])
            for size in [2] * (n // 2) if n in (2, 4) else [2] * (n % 3 == 2) + [3] * (n // 3) + [1] * (n % 3 == 1):
                self._push({2: "template", 3: "parameter"}[size], "{" * size) if size > 1 else self.out.append("{")
        elif kind == "close":
            self._close_braces(len(m[0]))
        elif kind in ("table", "link", "outside", "ref"):
            self._push(kind, "" if kind == "ref" else m[0])
        elif kind == "endtable":
            self._drop("table", m[0])
        elif kind == "endref":
            self._drop("ref", "")
        elif kind == "brackets":
            self._close_brackets(len(m[0]))
        elif kind == "pipe":
            if self.open and self.open[-1][0] == "link":
                self.pipes.setdefault(self.open[-1][1], len(self.out))
            self.out.append("|")

    def _push(self, kind: str, literal: str) -> None:
        self.open.append((kind, len(self.out), len(self.targets)))
        self.count[kind] = self.count.get(kind, 0) + 1
        self.out.append(literal)
        if kind == "link":
            self.targets.append(None)

    def _pop(self, kind: str) -> tuple[str, int, int]:
        """The nearest open ``kind``; what was opened in it and not closed is text."""
        while True:
            top = self.open.pop()
            self.count[top[0]] -= 1
            if top[0] == kind:
                return top

    def _drop(self, kind: str, literal: str) -> None:
        if self.count.get(kind):
            del self.out[self._pop(kind)[1] :]
        else:
            self.out.append(literal)

    def _close_braces(self, n: int) -> None:
        while n >= 2:
            nearest = next((k for k, _, _ in reversed(self.open) if k in ("template", "parameter")), None) if self.count.get("template") or self.count.get("parameter") else None
            if nearest is None:
                break
            if nearest == "parameter" and n < 3:
                if not self.count.get("template"):
                    break
                nearest = "template"
            self._drop(nearest, "")
            n -= 3 if nearest == "parameter" else 2
        self.out.append("}" * n)

    def _close_brackets(self, n: int) -> None:
        while n:
            in_link = self.count.get("link", 0) > 0
            if self.open and self.open[-1][0] == "outside" and (n % 2 or not in_link):
                self.out[self._pop("outside")[1]] = ""
                n -= 1
            elif n >= 2 and in_link:
                self._close_link()
                n -= 2
            else:
                self.out.append("]")
                n -= 1

    def _close_link(self) -> None:
        _, start, number = self._pop("link")
        pipe = self.pipes.get(start)
        self.targets[number] = "".join(self.out[start + 1 : pipe])
        self.out[start] = ""
        if pipe is not None:
            self.out[start + 1 : pipe + 1] = [""] * (pipe - start)


def plain_text(text: str) -> str:
    return _Scanner(text).text()


def links(text: str) -> list[str]:
    """Targets of the links in order of their starts, repeated ones too, those in templates and labels as well; without the part after ``#``."""
    return _Scanner(text).links()


def parse(text: str) -> list[list[tuple[str, list[str]]]]:
    """For each section its paragraphs: plain text and link targets; blank ones are left out."""
    out = []
    for section in sections(text):
        own = []
        for part in map(str.strip, section.split("\n\n")):
            scanned = _Scanner(part)
            plain = scanned.text()
            if plain.strip():
                own.append((plain, scanned.links()))
        out.append(own)
    return out


def parsed_pages(pages: DataFrame) -> DataFrame:
    """page_id, sec_i, para_i, text, targets of (page_id, text); a section without paragraphs has one row with null ``para_i``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "sec_i", "para_i", "text", "targets"]
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string())]
        for batch in batches:
            rows: list[tuple] = []
            for page, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for s, own in enumerate(parse(text or "")):
                    rows += [(page, s, p, plain, targets) for p, (plain, targets) in enumerate(own)] or [(page, s, None, None, [])]
                if len(rows) > 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)
                    rows = []
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=names)

    return pages.select("page_id", "text").mapInArrow(run, "page_id long, sec_i int, para_i int, text string, targets array<string>")
