"""The retrieval tools: validated arguments in, a JSON text out.

Counts are clamped without a word; arguments of the wrong type and failures give
``{"error": ...}``, but a count that is no number raises. Rows are capped on the driver.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql.functions import col as _col

from graphleaf.functions import text as X
from graphleaf.functions.calculate import evaluate
from graphleaf.operators import graph as G
from graphleaf.operators import search as S
from graphleaf.operators.vector_index import VectorIndex

ROWS, TITLE_ROWS, NEIGHBOUR_ROWS, TEXT_ROWS = 100, 500, 2000, 5000


def rows_of(df: DataFrame, limit: int = ROWS) -> list[dict]:
    """At most ``limit`` rows as dictionaries; nested values as Spark gives them."""
    return [r.asDict(recursive=True) for r in df.limit(limit).collect()]


@dataclass
class Tools:
    """The tools over one graph. ``embed`` turns a query into a vector; the vector tools need it and either ``article_vectors`` (page_id, embedding) and ``chunk_vectors`` (chunk_id, paragraph_id, embedding), which are read whole, or indexes of the same ids, of which a few lists are read."""

    graph: G.Graph
    embed: Callable[[str], list[float]] | None = None
    article_vectors: DataFrame | None = None
    chunk_vectors: DataFrame | None = None
    article_index: VectorIndex | None = None
    chunk_index: VectorIndex | None = None

    def vector_search_paragraph(self, query_text: str, k: int = 5) -> str:
        k = X.clamp(k, 1, 50)
        paragraphs = self.graph.paragraphs.select(X.paragraph_id(*map(_col, ("page_id", "sec_i", "para_i"))).alias("paragraph_id"), "text")

        def found() -> dict:
            vector = self.embed(query_text)
            if self.chunk_index is None:
                best = S.paragraph_topk(self.chunk_vectors, paragraphs, vector, k)
            else:
                near = self._indexed(self.chunk_index, vector, 4 * k).select(_col("id").alias("chunk_id"), X.paragraph_of(_col("id")).alias("paragraph_id"), "score")
                best = S.best_paragraphs(near, paragraphs, k)
            return {"query": query_text, "k": k, "results": rows_of(best, k)}

        return _answer(found)

    def _indexed(self, index: VectorIndex, vector: list[float], k: int) -> DataFrame:
        spark = self.graph.articles.sparkSession
        return index.search(spark.createDataFrame([(0, vector)], "question long, vector array<double>"), k)

    def vector_search_article(self, query_text: str, k: int = 5) -> str:
        k = X.clamp(k, 1, 50)

        def found() -> dict:
            vector = self.embed(query_text)
            best = S.vector_topk(self.article_vectors, vector, k, "page_id") if self.article_index is None else self._indexed(self.article_index, vector, k).select(_col("id").alias("page_id"), "score")
            best = best.join(self.graph.articles, "page_id")
            return {"query": query_text, "k": k, "results": rows_of(best.orderBy(_col("score").desc(), "page_id").select(X.article_id(_col("page_id")).alias("article_nodeID"), "title", "score"), k)}

        return _answer(found)

    def articles_within_distance(self, title: str, n: int = 2) -> str:
        if not isinstance(title, str):
            return _error("title must be a string")
        n = X.clamp(n, 1, 3)

        def found() -> dict:
            rows = rows_of(G.within_distance(self.graph, title, n), NEIGHBOUR_ROWS)
            return {"source": title, "max_distance": n, "count": len(rows), "neighbours": rows}

        return _answer(found)

    def get_article_text(self, title: str) -> str:
        return self._by_title(title, G.article_text, "title", "paragraph_count", "paragraphs", TEXT_ROWS)

    def get_infoboxes(self, title: str) -> str:
        return self._by_title(title, G.article_infoboxes, "article", "infobox_count", "infoboxes", TEXT_ROWS)

    def get_section_titles(self, title: str) -> str:
        return self._by_title(title, G.section_titles, "article", "section_count", "sections", TITLE_ROWS)

    def get_section_titles_and_infoboxes(self, title: str) -> str:
        return self._by_title(title, G.section_titles_and_infoboxes, "article", "output_count", "infoboxes_and_section_titles", TITLE_ROWS)

    def get_sections(self, section_ids: list[str]) -> str:
        if not isinstance(section_ids, list) or not all(isinstance(s, str) for s in section_ids):
            return _error("section_ids must be a list of strings")

        def found() -> dict:
            rows = rows_of(G.sections_by_id(self.graph, section_ids), TEXT_ROWS) if section_ids else []
            return {"section_count": len(section_ids), "paragraph_count": len(rows), "paragraphs": rows}

        return _answer(found)

    def window_paragraphs(self, paragraph_id: str, n: int = 2) -> str:
        if not isinstance(paragraph_id, str):
            return _error("paragraph_id must be a string")
        n = X.clamp(n, 0, 20)
        return _answer(lambda: {"centre_paragraph": paragraph_id, "n": n, "window": rows_of(G.window_paragraphs(self.graph, paragraph_id, n), 2 * n + 1)})

    def window_sections(self, section_id: str, n: int = 2) -> str:
        if not isinstance(section_id, str):
            return _error("section_id must be a string")
        n = X.clamp(n, 0, 20)
        return _answer(lambda: {"centre_section": section_id, "n": n, "window": rows_of(G.window_sections(self.graph, section_id, n), 2 * n + 1)})

    def get_backlinks(self, title: str, limit: int = 50) -> str:
        if not isinstance(title, str):
            return _error("title must be a string")
        limit = X.clamp(limit, 1, 500)

        def found() -> dict:
            rows = rows_of(G.backlinks(self.graph, title, limit), limit)
            return {"target": title, "count": len(rows), "backlinks": rows}

        return _answer(found)

    def shortest_path(self, title_a: str, title_b: str) -> str:
        if not isinstance(title_a, str) or not isinstance(title_b, str):
            return _error("title_a and title_b must be strings")

        def found() -> dict:
            rows = rows_of(G.shortest_path(self.graph, title_a, title_b))
            return {"from": title_a, "to": title_b, "hop_count": len(rows), "hops": rows}

        return _answer(found)

    def calculate(self, expression: str) -> str:
        if not isinstance(expression, str) or not expression.strip():
            return _error("expression must be a non-empty string")
        return _answer(lambda: {"expression": expression, "result": evaluate(expression)})

    def _by_title(self, title: str, read: Callable[[G.Graph, str], DataFrame], name: str, count: str, key: str, limit: int) -> str:
        if not isinstance(title, str):
            return _error("title must be a string")

        def found() -> dict:
            rows = rows_of(read(self.graph, title), limit)
            return {name: title, count: len(rows), key: rows}

        return _answer(found)


#: All tools by name, and those that the two question-answering scenarios offer.
NAMES = [
    "vector_search_paragraph", "vector_search_article", "articles_within_distance", "get_article_text", "get_infoboxes", "get_section_titles",
    "get_section_titles_and_infoboxes", "get_sections", "window_paragraphs", "window_sections", "get_backlinks", "shortest_path", "calculate",
]
SCENARIOS = {"none": [], "vector": ["vector_search_paragraph", "calculate"], "graph": [n for n in NAMES if n not in ("get_infoboxes", "get_section_titles")]}


def chosen(tools: Tools, names: list[str]) -> list[Callable]:
    """The tools of these names; an empty or unknown choice raises ValueError, one that is no list TypeError."""
    if not isinstance(names, list):
        raise TypeError("tool names must be a list")
    if not names:
        raise ValueError("no tool was named")
    if unknown := [n for n in names if n not in NAMES]:
        raise ValueError(f"unknown tools {unknown}")
    return [getattr(tools, n) for n in names]


def _error(message: str) -> str:
    return json.dumps({"error": message})


def _answer(found: Callable[[], dict]) -> str:
    try:
        return json.dumps(found(), default=str)
    except Exception as e:
        return _error(f"{type(e).__name__}: {e}")
