"""The property graph as typed DataFrames and the reads over it.

Nodes keep their numbers (page, section, paragraph, chunk) as columns: containment and
order are equality and arithmetic on them, so the containment and sequence edges exist
only for export. Links, redirects and mentions are edge tables. Titles resolve to the
lowest page id that has them.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphleaf.functions import text as X
from graphleaf.tables import numbered, written

MAX_REDIRECTS = 10


@dataclass(frozen=True)
class Graph:
    """articles(page_id, title), sections(page_id, sec_i), paragraphs(page_id, sec_i, para_i, text), links(page_id, sec_i, para_i, target), redirects(page_id, target).

    ``stored`` keeps what reads derive from these, mentions and the ends of redirects, as tables; a graph of ``layout.save_graph`` has
    the articles by title and the links by target as well."""

    articles: DataFrame
    sections: DataFrame
    paragraphs: DataFrame
    links: DataFrame
    redirects: DataFrame
    chunk_size: int = X.CHUNK_SIZE
    chunk_overlap: int = X.CHUNK_OVERLAP
    mention_table: DataFrame | None = None
    terminal_table: DataFrame | None = None
    titles: DataFrame | None = None
    links_in: DataFrame | None = None

    def stored(self) -> Graph:
        return replace(self, mention_table=written(self.mentions()), terminal_table=written(self.terminals()))

    def terminals(self) -> DataFrame:
        """(page_id, terminal) of the redirects."""
        return redirect_terminals(self.redirects) if self.terminal_table is None else self.terminal_table

    def chunks(self) -> DataFrame:
        """page_id, sec_i, para_i, chunk_i, text of overlapping pieces of the paragraphs."""
        return self.paragraphs.select("page_id", "sec_i", "para_i", F.posexplode(X.chunks(F.col("text"), self.chunk_size, self.chunk_overlap)).alias("chunk_i", "text"))

    def mentions(self) -> DataFrame:
        """Distinct (page_id, target) of the links."""
        return self.links.select("page_id", "target").distinct() if self.mention_table is None else self.mention_table


def redirect_terminals(redirects: DataFrame, most: int = MAX_REDIRECTS) -> DataFrame:
    """(page_id, terminal) of redirects that end within ``most`` hops; cycles and longer chains end at their start.

    The hop function is composed with itself, so ten hops cost five joins."""
    step = redirects.groupBy("page_id").agg(F.min("target").alias("target"))

    def after(f: DataFrame, g: DataFrame) -> DataFrame:
        return f.join(g.select(F.col("page_id").alias("target"), F.col("target").alias("next")), "target", "left").select("page_id", F.coalesce("next", "target").alias("target"))

    total, power, rest = None, step, most
    while rest:
        if rest & 1:
            total = power if total is None else after(total, power)
        rest >>= 1
        power = after(power, power) if rest else power
    again = step.select(F.col("page_id").alias("target"), F.lit(True).alias("goes_on"))
    return total.join(again, "target", "left").select("page_id", F.when(F.col("goes_on"), F.col("page_id")).otherwise(F.col("target")).alias("terminal"))


def resolved_id(graph: Graph, title: str) -> int | None:
    """The page of that title, or the one its redirects end at within ``MAX_REDIRECTS`` hops: a look-up of the title, then one for each hop, all of a single row."""
    start = (graph.articles if graph.titles is None else graph.titles).filter(F.col("title") == title).agg(F.min("page_id")).first()[0]
    at = start
    for hop in range(MAX_REDIRECTS + 1):
        if at is None:
            return None
        further = graph.redirects.filter(F.col("page_id") == at).agg(F.min("target")).first()[0]
        if further is None:
            return at
        at = further if hop < MAX_REDIRECTS else start
    return at


def resolved(graph: Graph, title: str) -> DataFrame:
    """(page_id, title): the article of that title, or the one its redirects end at."""
    return graph.articles.filter(F.col("page_id") == F.lit(resolved_id(graph, title)).cast("long")).select("page_id", "title")


def _of_page(rows: DataFrame, page_id: int | None) -> DataFrame:
    return rows.filter(F.col("page_id") == F.lit(page_id).cast("long"))


def article_text(graph: Graph, title: str) -> DataFrame:
    """nodeID, text of the paragraphs in reading order."""
    own = _of_page(graph.paragraphs, resolved_id(graph, title))
    return own.orderBy("sec_i", "para_i").select(X.paragraph_id(F.col("page_id"), F.col("sec_i"), F.col("para_i")).alias("nodeID"), "text")


def sections_by_id(graph: Graph, section_ids: list[str]) -> DataFrame:
    """section_nodeID, paragraph_nodeID, text in the order of the ids, repeated ids repeating."""
    wanted = graph.paragraphs.sparkSession.createDataFrame([(i, s) for i, s in enumerate(section_ids)], "i int, sid string")
    own = wanted.select("i", "sid", F.regexp_extract("sid", r"^article:(\d+):s(\d+)$", 1).try_cast("long").alias("page_id"), F.regexp_extract("sid", r"^article:(\d+):s(\d+)$", 2).try_cast("int").alias("sec_i"))
    found = graph.paragraphs.join(F.broadcast(own), ["page_id", "sec_i"])  # as many rows as ids asked for
    return found.orderBy("i", "para_i").select(F.col("sid").alias("section_nodeID"), X.paragraph_id(F.col("page_id"), F.col("sec_i"), F.col("para_i")).alias("paragraph_nodeID"), "text")


def _numbers(node: str) -> list[int]:
    """Page, section and paragraph number of a node id; empty if it is none."""
    parts = node.split(":")
    marks = ["article", "s", "p"]
    if len(parts) < 2 or parts[0] != "article" or not parts[1].isdigit():
        return []
    rest = [p[1:] for m, p in zip(marks[1:], parts[2:], strict=False) if p.startswith(m) and p[1:].isdigit()]
    return [int(parts[1]), *map(int, rest)] if len(rest) == len(parts) - 2 else []


def window_paragraphs(graph: Graph, paragraph_id: str, n: int = 2) -> DataFrame:
    """paragraph_nodeID, offset, text of the paragraph and up to ``n`` on either side in its section."""
    at = _numbers(paragraph_id)
    page, sec, para = at if len(at) == 3 else (None, None, None)
    section = graph.paragraphs.filter((F.col("page_id") == F.lit(page)) & (F.col("sec_i") == F.lit(sec)))
    here = section.filter(F.col("para_i") == F.lit(para)).select("page_id")
    near = section.filter(F.abs(F.col("para_i") - F.lit(para)) <= n).join(here, "page_id", "left_semi")
    return near.orderBy("para_i").select(X.paragraph_id(F.col("page_id"), F.col("sec_i"), F.col("para_i")).alias("paragraph_nodeID"), (F.col("para_i") - F.lit(para)).alias("offset"), "text")


def window_sections(graph: Graph, section_id: str, n: int = 2) -> DataFrame:
    """section_nodeID, offset, first_paragraph_nodeID, first_paragraph_text, paragraph_count; sections without paragraphs keep null and 0."""
    at = _numbers(section_id)
    page, sec = at if len(at) == 2 else (None, None)
    sections = graph.sections.filter(F.col("page_id") == F.lit(page))
    here = sections.filter(F.col("sec_i") == F.lit(sec)).select("page_id")
    near = sections.filter(F.abs(F.col("sec_i") - F.lit(sec)) <= n).join(here, "page_id", "left_semi")
    first = graph.paragraphs.filter(F.col("page_id") == F.lit(page)).groupBy("page_id", "sec_i").agg(F.min(F.struct("para_i", "text")).alias("first"), F.count("*").alias("n"))
    node = F.when(F.col("first").isNotNull(), X.paragraph_id(F.col("page_id"), F.col("sec_i"), F.col("first.para_i")))
    return near.join(first, ["page_id", "sec_i"], "left").orderBy("sec_i").select(
        X.section_id(F.col("page_id"), F.col("sec_i")).alias("section_nodeID"), (F.col("sec_i") - F.lit(sec)).alias("offset"), node.alias("first_paragraph_nodeID"), F.col("first.text").alias("first_paragraph_text"), F.coalesce("n", F.lit(0)).alias("paragraph_count")
    )


def backlinks(graph: Graph, title: str, limit: int = 50) -> DataFrame:
    """source_article, paragraph_nodeID, text for each link from another article, a paragraph that links twice twice."""
    target = F.lit(resolved_id(graph, title)).cast("long")
    into = (graph.links if graph.links_in is None else graph.links_in).filter((F.col("target") == target) & (F.col("page_id") != target)).select("page_id", "sec_i", "para_i")
    # by page alone first, as paragraphs are kept: all three numbers would deal the whole table anew
    own = graph.paragraphs.join(into.select("page_id").distinct(), "page_id", "left_semi")
    rows = into.join(own, ["page_id", "sec_i", "para_i"]).join(graph.articles, "page_id")
    return rows.orderBy("title", "page_id", "sec_i", "para_i").limit(limit).select(F.col("title").alias("source_article"), X.paragraph_id(F.col("page_id"), F.col("sec_i"), F.col("para_i")).alias("paragraph_nodeID"), "text")


def _first_paragraphs(graph: Graph, page_id: int | None) -> DataFrame:
    own = _of_page(graph.paragraphs, page_id)
    return own.groupBy("page_id", "sec_i").agg(F.min_by("text", "para_i").alias("text"), F.min("para_i").alias("para_i"))


def section_titles(graph: Graph, title: str) -> DataFrame:
    """nodeID, title: heading lines of each section's first paragraph, else its first chunk (null if there is none)."""
    first = _first_paragraphs(graph, resolved_id(graph, title))
    titles = F.when(F.size(X.headings(F.col("text"))) > 0, X.headings(F.col("text"))).otherwise(F.array(F.try_element_at(X.chunks(F.col("text"), graph.chunk_size, graph.chunk_overlap), F.lit(1))))
    rows = first.select("page_id", "sec_i", F.posexplode(titles).alias("at", "title"))
    return rows.orderBy("sec_i", "at").select(X.section_id(F.col("page_id"), F.col("sec_i")).alias("nodeID"), "title")


def _placed_infoboxes(graph: Graph, title: str) -> DataFrame:
    """at, infobox: balanced spans of the article's distinct paragraphs, joined by line breaks."""
    own = _of_page(graph.paragraphs, resolved_id(graph, title))
    whole = own.groupBy("page_id").agg(F.array_join(F.array_distinct(F.transform(F.sort_array(F.collect_list(F.struct("sec_i", "para_i", "text"))), lambda s: s["text"])), "\n").alias("doc"))  # the paragraphs of one article
    return whole.select(X.infoboxes(F.col("doc")).alias("boxes")).select(F.posexplode("boxes").alias("at", "infobox"))


def article_infoboxes(graph: Graph, title: str) -> DataFrame:
    """infobox: balanced spans of the article's distinct paragraphs, joined by line breaks, in order."""
    return _placed_infoboxes(graph, title).orderBy("at").select("infobox")


def section_titles_and_infoboxes(graph: Graph, title: str) -> DataFrame:
    """kind, nodeID, text: infoboxes, then section titles; the first chunk stands in for headings only where no infobox begins."""
    first = _first_paragraphs(graph, resolved_id(graph, title))
    chunk = F.try_element_at(X.chunks(F.col("text"), graph.chunk_size, graph.chunk_overlap), F.lit(1))
    found = X.headings(F.col("text"))
    fallback = F.when(chunk.isNotNull() & ~F.col("text").contains(X.INFOBOX), F.array(chunk)).otherwise(F.expr("cast(array() AS array<string>)"))
    titles = first.select("page_id", "sec_i", F.posexplode(F.when(F.size(found) > 0, found).otherwise(fallback)).alias("at", "text"))
    rows = titles.select(F.lit(1).alias("part"), "sec_i", "at", F.lit("section title").alias("kind"), X.section_id(F.col("page_id"), F.col("sec_i")).alias("nodeID"), "text")
    boxes = _placed_infoboxes(graph, title).select(F.lit(0).alias("part"), F.lit(0).alias("sec_i"), "at", F.lit("infobox").alias("kind"), F.lit(None).cast("string").alias("nodeID"), F.col("infobox").alias("text"))
    return boxes.unionByName(rows).orderBy("part", "sec_i", "at").select("kind", "nodeID", "text")


def _levels(mentions: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """(page_id, distance) reachable within ``hops``; each level drops what was seen before."""
    seen = start.select("page_id", F.lit(0).alias("distance"))
    edge = seen.select("page_id")
    for k in range(1, hops + 1):
        reached = mentions.join(edge, "page_id", "left_semi").select(F.col("target").alias("page_id")).distinct()
        edge = reached.join(seen.select("page_id"), "page_id", "left_anti")
        if k < hops:
            edge = written(edge)
        seen = seen.unionByName(edge.select("page_id", F.lit(k).alias("distance")))
    return seen.filter("distance > 0")


def within_distance(graph: Graph, title: str, n: int = 2) -> DataFrame:
    """title, distance of articles within ``n`` mentions, redirects followed after the distance is known; rows that end at the source's title go."""
    source = resolved(graph, title)
    near = _levels(written(graph.mentions()) if n > 1 and graph.mention_table is None else graph.mentions(), source, n)
    real = near.join(graph.terminals(), "page_id", "left").select(F.coalesce("terminal", "page_id").alias("page_id"), "distance").join(graph.articles, "page_id")
    own = source.select(F.col("title").alias("source"))
    return real.join(own, real["title"] == own["source"], "left_anti").groupBy("title").agg(F.min("distance").alias("distance")).orderBy("distance", "title")


def distances_of(graph: Graph, titles: DataFrame, n: int = 2) -> DataFrame:
    """source, title, distance: ``within_distance`` for each title of ``titles`` (title), all in one search.

    A page's sources are bits of 64-bit words, a row for each word that has any: a level is one join with the mentions
    however many sources there are, and their bits are put together in the tasks. A source's title appears as it is asked; titles that no article has
    get no rows."""
    asked = titles.select(F.col("title").alias("source")).filter("source is not null").distinct()
    named = graph.articles.groupBy("title").agg(F.min("page_id").alias("first"))
    found = asked.join(named, F.col("source") == F.col("title")).join(graph.terminals().withColumnRenamed("page_id", "first"), "first", "left").select("source", F.coalesce("terminal", "first").alias("page_id"))
    starts = written(numbered(found, "number"))
    bit = F.expr("shiftleft(1L, cast(number % 64 AS int))")
    seen = edge = starts.groupBy("page_id", F.floor(F.col("number") / 64).alias("word")).agg(F.bit_or(bit).alias("bits"))
    mentions = written(graph.mentions()) if n > 1 and graph.mention_table is None else graph.mentions()
    levels = []
    for k in range(1, n + 1):
        reached = mentions.join(edge, "page_id").groupBy(F.col("target").alias("page_id"), "word").agg(F.bit_or("bits").alias("bits"))
        before = seen.select("page_id", "word", F.col("bits").alias("old"))
        fresh = reached.join(before, ["page_id", "word"], "left").select("page_id", "word", F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("old", F.lit(0).cast("long")))).alias("bits")).filter("bits <> 0")
        edge = written(fresh)
        levels.append(edge.withColumn("distance", F.lit(k)))
        seen = written(seen.unionByName(edge).groupBy("page_id", "word").agg(F.bit_or("bits").alias("bits"))) if k < n else seen
    near = reduce(DataFrame.unionByName, levels)
    # from bits to sources again, and to the articles that redirects end at
    places = F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.call_function("getbit", F.col("bits"), i) == 1)
    pairs = near.select("page_id", "distance", "word", F.explode(places).alias("place")).select("page_id", "distance", (F.col("word") * 64 + F.col("place")).alias("number"))
    real = pairs.join(graph.terminals(), "page_id", "left").select(F.coalesce("terminal", "page_id").alias("page_id"), "distance", "number").join(graph.articles, "page_id")
    ends = starts.join(graph.articles.withColumnRenamed("title", "own"), "page_id").select("number", "source", "own")
    return real.join(ends, "number").filter("title <> own").groupBy("source", "title").agg(F.min("distance").alias("distance"))


def _path(mentions: DataFrame, start: int, end: int, most: int) -> list[int] | None:
    """The pages of a shortest path, of several the one whose pages, from the end on, are each the least predecessor; null if there is none of ``most`` hops.

    Levels grow from both ends, the smaller one first, and are written; forward levels know each page's least predecessor.
    Where the two meet, the pages on shortest paths are followed through the levels of the end, again with their least
    predecessors, so that the path is the one that a search from the start alone finds."""
    spark = mentions.sparkSession
    ahead = [spark.createDataFrame([(start, None)], "page_id long, parent long")]
    back = [spark.createDataFrame([(end,)], "page_id long")]
    seen_ahead, seen_back = ahead[0].select("page_id"), back[0]
    size_ahead = size_back = 1
    meeting = None
    while meeting is None and len(ahead) + len(back) - 2 < most and size_ahead and size_back:
        if size_ahead <= size_back:
            reached = mentions.join(ahead[-1].select("page_id"), "page_id", "left_semi").groupBy("target").agg(F.min("page_id").alias("parent"))
            ahead.append(written(reached.select(F.col("target").alias("page_id"), "parent").join(seen_ahead, "page_id", "left_anti")))
            seen_ahead, size_ahead = seen_ahead.unionByName(ahead[-1].select("page_id")), ahead[-1].count()
        else:
            reached = mentions.join(back[-1].select(F.col("page_id").alias("target")), "target", "left_semi").select("page_id").distinct()
            back.append(written(reached.join(seen_back, "page_id", "left_anti")))
            seen_back, size_back = seen_back.unionByName(back[-1]), back[-1].count()
        both = written(ahead[-1].select("page_id").join(back[-1], "page_id", "left_semi"))
        meeting = both if both.limit(1).count() else None
    if meeting is None:
        return None
    onward, on = [], meeting
    for level in reversed(back[:-1]):
        after = mentions.join(on.select("page_id"), "page_id", "left_semi").join(level.select(F.col("page_id").alias("target")), "target", "left_semi")
        on = written(after.groupBy("target").agg(F.min("page_id").alias("parent")).select(F.col("target").alias("page_id"), "parent"))
        onward.append(on)
    path, at = [end], end
    for level in reversed(ahead[1:] + onward):  # at most ``most`` look-ups of one row
        at = level.filter(F.col("page_id") == at).first()["parent"]
        path.insert(0, at)
    return path


def _leading_to(redirects: DataFrame, pages: list[int]) -> DataFrame:
    """(target, to_id): the few ``pages``, and all pages from which up to ``MAX_REDIRECTS`` redirects pass through or end at one."""
    spark = redirects.sparkSession
    found = edge = spark.createDataFrame([(p, p) for p in pages], "target long, to_id long")
    for _ in range(MAX_REDIRECTS):
        before = redirects.join(edge, "target").select(F.col("page_id").alias("target"), "to_id").distinct()
        edge = written(before.join(found, ["target", "to_id"], "left_anti"))
        if not edge.limit(1).count():
            break
        found = found.unionByName(edge)
    return found


def shortest_path(graph: Graph, title_a: str, title_b: str, most: int = 6) -> DataFrame:
    """hop, from_article, to_article, paragraph_nodeID, paragraph_text of one shortest path of mentions.

    Of equal paths the one through the least predecessors counts. A hop's evidence is its shortest linking paragraph, the
    first of equals, a link through redirects to the next article or past it counting too; a hop without one has no row. The same start and end, or no path, give no rows."""
    spark = graph.articles.sparkSession
    schema = "hop int, from_article string, to_article string, paragraph_nodeID string, paragraph_text string"
    ends = [resolved_id(graph, t) for t in (title_a, title_b)]
    if None in ends or ends[0] == ends[1]:
        return spark.createDataFrame([], schema)
    path = _path(written(graph.mentions()) if graph.mention_table is None else graph.mentions(), *ends, most)
    if path is None:
        return spark.createDataFrame([], schema)
    hops = F.broadcast(spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(zip(path, path[1:], strict=False))], "hop int, page_id long, to_id long"))
    starts, passed = path[:-1], path[1:]  # at most six each
    reach = graph.links.filter(F.col("page_id").isin(starts)).join(_leading_to(graph.redirects, passed), "target").select("page_id", "sec_i", "para_i", "to_id")
    evidence = reach.join(hops, ["page_id", "to_id"]).join(graph.paragraphs.filter(F.col("page_id").isin(starts)), ["page_id", "sec_i", "para_i"]).groupBy("hop", "page_id", "to_id").agg(F.min_by(F.struct("sec_i", "para_i", "text"), F.struct(F.length("text"), "sec_i", "para_i")).alias("e"))
    on_path = graph.articles.filter(F.col("page_id").isin(path))
    names = on_path.select(F.col("page_id").alias("to_id"), F.col("title").alias("to_article"))
    rows = evidence.join(on_path, "page_id").join(names, "to_id")
    return rows.orderBy("hop").select("hop", F.col("title").alias("from_article"), "to_article", X.paragraph_id(F.col("page_id"), F.col("e.sec_i"), F.col("e.para_i")).alias("paragraph_nodeID"), F.col("e.text").alias("paragraph_text"))


def _chain(df: DataFrame, keys: list[str], number: str, node: Column, kind: str) -> DataFrame:
    """start_id, end_id, rel_type of neighbours in both directions."""
    order = Window.partitionBy(*keys).orderBy(number)
    own = df.select(*keys, number, node.alias("id"))
    pairs = own.select("id", F.lead("id").over(order).alias("next")).filter("next is not null")
    return pairs.select(F.explode(F.array(F.struct(F.col("id").alias("start_id"), F.col("next").alias("end_id"), F.lit(f"NEXT_{kind}").alias("rel_type")), F.struct(F.col("next").alias("start_id"), F.col("id").alias("end_id"), F.lit(f"PREVIOUS_{kind}").alias("rel_type")))).alias("e")).select("e.*")


def section_chain(graph: Graph) -> DataFrame:
    return _chain(graph.sections, ["page_id"], "sec_i", X.section_id(F.col("page_id"), F.col("sec_i")), "SECTION")


def paragraph_chain(graph: Graph) -> DataFrame:
    return _chain(graph.paragraphs, ["page_id", "sec_i"], "para_i", X.paragraph_id(*map(F.col, ("page_id", "sec_i", "para_i"))), "PARAGRAPH")


def chunk_chain(graph: Graph) -> DataFrame:
    return _chain(graph.chunks(), ["page_id", "sec_i", "para_i"], "chunk_i", X.chunk_id(*map(F.col, ("page_id", "sec_i", "para_i", "chunk_i"))), "CHUNK")


def missing_articles(graph: Graph) -> DataFrame:
    """Targets of links and redirects that are not articles (page_id): the stubs that a subset needs. Stubs have title and text ``""``."""
    referenced = graph.links.select(F.col("target").alias("page_id")).union(graph.redirects.select("target")).distinct()
    return referenced.join(graph.articles, "page_id", "left_anti")


def nodes(graph: Graph, stubs: bool = True) -> DataFrame:
    """nodeID, label, title, text of all nodes, absent values empty."""
    blank = F.lit("")
    page, sec, para, chunk = map(F.col, ("page_id", "sec_i", "para_i", "chunk_i"))
    parts = [
        graph.articles.select(X.article_id(page).alias("nodeID"), F.lit("Article").alias("label"), F.coalesce("title", blank).alias("title"), blank.alias("text")),
        graph.sections.select(X.section_id(page, sec).alias("nodeID"), F.lit("Section").alias("label"), blank.alias("title"), blank.alias("text")),
        graph.paragraphs.select(X.paragraph_id(page, sec, para).alias("nodeID"), F.lit("Paragraph").alias("label"), blank.alias("title"), "text"),
        graph.chunks().select(X.chunk_id(page, sec, para, chunk).alias("nodeID"), F.lit("Chunk").alias("label"), blank.alias("title"), "text"),
    ]
    if stubs:
        parts.append(missing_articles(graph).select(X.article_id(page).alias("nodeID"), F.lit("Article").alias("label"), blank.alias("title"), blank.alias("text")))
    return reduce(DataFrame.unionByName, parts)


def edges(graph: Graph, mentions: bool = False) -> DataFrame:
    """start_id, end_id, rel_type of all edges: containment, sequence, links, redirects and, on demand, mentions."""
    page, sec, para, chunk = map(F.col, ("page_id", "sec_i", "para_i", "chunk_i"))

    def edge(df: DataFrame, start: Column, end: Column, kind: str) -> DataFrame:
        return df.select(start.alias("start_id"), end.alias("end_id"), F.lit(kind).alias("rel_type"))

    parts = [
        edge(graph.sections, X.article_id(page), X.section_id(page, sec), "HAS_SECTION"),
        edge(graph.paragraphs, X.section_id(page, sec), X.paragraph_id(page, sec, para), "HAS_PARAGRAPH"),
        edge(graph.chunks(), X.paragraph_id(page, sec, para), X.chunk_id(page, sec, para, chunk), "HAS_CHUNK"),
        section_chain(graph), paragraph_chain(graph), chunk_chain(graph),
        edge(graph.links, X.paragraph_id(page, sec, para), X.article_id(F.col("target")), "LINKS_TO"),
        edge(graph.redirects, X.article_id(page), X.article_id(F.col("target")), "REDIRECTS_TO"),
    ]
    if mentions:
        parts.append(edge(graph.mentions(), X.article_id(page), X.article_id(F.col("target")), "MENTIONS"))
    return reduce(DataFrame.unionByName, parts)


def mentions_of_edges(edge_rows: DataFrame) -> DataFrame:
    """MENTIONS edges of exported LINKS_TO edges: distinct article of the start and target, ids that are no article's dropped."""
    for c in ("start_id", "end_id", "rel_type"):
        if c not in edge_rows.columns:
            raise ValueError(f"edges lack the column {c}")
    pairs = edge_rows.filter("rel_type = 'LINKS_TO'").select(X.article_of(F.col("start_id")).alias("start_id"), "end_id").filter("start_id is not null").distinct()
    return pairs.withColumn("rel_type", F.lit("MENTIONS")).orderBy("start_id", "end_id")


def label_counts(node_rows: DataFrame) -> DataFrame:
    return node_rows.groupBy("label").agg(F.count("*").alias("n"))
