import random

import pytest

from graphleaf.operators import graph as G


@pytest.fixture(scope="module")
def small(spark):
    """Six articles: 1 and 2 link on, 4 redirects to 5, 5's text has a heading and an infobox, 6 has sections only."""
    make = spark.createDataFrame
    return G.Graph(
        articles=make([(1, "A"), (2, "B"), (3, "C"), (4, "D old"), (5, "D"), (6, "Empty"), (7, "A")], "page_id long, title string"),
        sections=make([(1, 0), (1, 1), (2, 0), (5, 0), (5, 1), (6, 0)], "page_id long, sec_i int"),
        paragraphs=make([(1, 0, 0, "== One ==\ntext"), (1, 0, 1, "long paragraph that links to B"), (1, 0, 2, "short to B"), (1, 1, 0, "no heading"), (2, 0, 0, "to D old"), (5, 0, 0, "{{Infobox d|{{x}}}} start"), (5, 1, 0, "end")], "page_id long, sec_i int, para_i int, text string"),
        links=make([(1, 0, 1, 2), (1, 0, 2, 2), (1, 0, 2, 2), (1, 1, 0, 1), (2, 0, 0, 4), (1, 1, 0, 99)], "page_id long, sec_i int, para_i int, target long"),
        redirects=make([(4, 5)], "page_id long, target long"),
    )


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_article_text_follows_redirects(small):
    assert rows(G.article_text(small, "D old")) == [("article:5:s0:p0", "{{Infobox d|{{x}}}} start"), ("article:5:s1:p0", "end")]
    assert rows(G.article_text(small, "nobody")) == []


def test_titles_resolve_to_the_lowest_page(small):
    assert len(rows(G.article_text(small, "A"))) == 4


def test_backlinks_repeat(small):
    assert rows(G.backlinks(small, "B")) == [("A", "article:1:s0:p1", "long paragraph that links to B")] + [("A", "article:1:s0:p2", "short to B")] * 2
    assert rows(G.backlinks(small, "A")) == []


def test_windows(small):
    assert [(r[0], r[1]) for r in rows(G.window_paragraphs(small, "article:1:s0:p1", 1))] == [("article:1:s0:p0", -1), ("article:1:s0:p1", 0), ("article:1:s0:p2", 1)]
    assert rows(G.window_paragraphs(small, "article:1:s0:p9", 20)) == [] and rows(G.window_paragraphs(small, "nonsense", 1)) == []
    assert rows(G.window_sections(small, "article:6:s0", 2)) == [("article:6:s0", 0, None, None, 0)]
    assert [(r[0], r[1], r[4]) for r in rows(G.window_sections(small, "article:1:s1", 1))] == [("article:1:s0", -1, 3), ("article:1:s1", 0, 1)]


def test_sections_keep_order_and_repeats(small):
    got = rows(G.sections_by_id(small, ["article:5:s1", "bad", "article:2:s0", "article:5:s1"]))
    assert [r[1] for r in got] == ["article:5:s1:p0", "article:2:s0:p0", "article:5:s1:p0"]


def test_section_titles(small):
    assert rows(G.section_titles(small, "A")) == [("article:1:s0", "One"), ("article:1:s1", "no heading")]
    assert rows(G.article_infoboxes(small, "D")) == [("{{Infobox d|{{x}}}}",)]
    assert rows(G.section_titles_and_infoboxes(small, "D")) == [("infobox", None, "{{Infobox d|{{x}}}}"), ("section title", "article:5:s1", "end")]


def test_distance_and_path(small):
    assert rows(G.within_distance(small, "A", 2)) == [("B", 1), ("D", 2)]
    assert rows(G.shortest_path(small, "A", "D")) == []  # D itself is only mentioned through its redirect
    assert rows(G.shortest_path(small, "A", "B")) == [(0, "A", "B", "article:1:s0:p2", "short to B")]
    assert rows(G.shortest_path(small, "A", "A")) == []


def test_stubs_and_export(small):
    assert rows(G.missing_articles(small)) == [(99,)]
    n = {r["label"]: r["n"] for r in G.label_counts(G.nodes(small)).collect()}
    assert n == {"Article": 8, "Section": 6, "Paragraph": 7, "Chunk": 7}
    e = {r["rel_type"]: r["count"] for r in G.edges(small, mentions=True).groupBy("rel_type").count().collect()}
    assert e["NEXT_SECTION"] == e["PREVIOUS_SECTION"] == 2 and e["NEXT_PARAGRAPH"] == 2 and e["LINKS_TO"] == 6 and e["MENTIONS"] == 4
    with pytest.raises(ValueError):
        G.mentions_of_edges(G.edges(small).drop("rel_type"))


@pytest.mark.parametrize(("length", "ends"), [(1, True), (9, True), (10, True), (11, False), (14, False)])
def test_redirect_chains(spark, length, ends):
    chain = spark.createDataFrame([(i, i + 1) for i in range(length)] + [(50, 51), (51, 52), (52, 50)], "page_id long, target long")
    got = {r[0]: r[1] for r in rows(G.redirect_terminals(chain))}
    assert got[0] == (length if ends else 0) and got[length - 1] == length and got[50] == 50


def test_paths_match_breadth_first_search(spark):
    random.seed(3)
    n, edges = 40, sorted({(random.randrange(40), random.randrange(40)) for _ in range(60)})
    articles = spark.createDataFrame([(i, f"T{i}") for i in range(n)], "page_id long, title string")
    paragraphs = spark.createDataFrame([(i, 0, 0, "p") for i in range(n)], "page_id long, sec_i int, para_i int, text string")
    links = spark.createDataFrame([(a, 0, 0, b) for a, b in edges], "page_id long, sec_i int, para_i int, target long")
    g = G.Graph(articles, paragraphs.select("page_id", "sec_i"), paragraphs, links, spark.createDataFrame([], "page_id long, target long"))
    ahead = {i: [b for a, b in edges if a == i] for i in range(n)}
    distance, level = {edges[0][0]: 0}, [edges[0][0]]
    while level:
        level = [b for a in level for b in ahead[a] if b not in distance and not distance.update({b: distance[a] + 1})]
    start = edges[0][0]
    assert {r[0]: r[1] for r in rows(G.within_distance(g, f"T{start}", 3))} == {f"T{k}": d for k, d in distance.items() if 0 < d <= 3}
    far = max((d, k) for k, d in distance.items() if d <= 6)
    path = rows(G.shortest_path(g, f"T{start}", f"T{far[1]}"))
    assert len(path) == far[0] and path[-1][2] == f"T{far[1]}" and all(a[2] == b[1] for a, b in zip(path, path[1:]))


def one_sided(edges, start, end, most=6):
    """The path that a search from the start finds, each page's predecessor being the least of the level before."""
    parents, level = {start: None}, [start]
    for _ in range(most):
        fresh = {}
        for a, b in edges:
            if a in level and b not in parents:
                fresh[b] = min(a, fresh.get(b, a))
        parents |= fresh
        level = list(fresh)
        if end in parents:
            path = [end]
            while path[0] != start:
                path.insert(0, parents[path[0]])
            return path
    return None


def test_two_sided_paths_are_those_of_one_side(spark):
    rng = random.Random(11)
    edges = sorted({(rng.randrange(60), rng.randrange(60)) for _ in range(130)} | {(100 + i, 101 + i) for i in range(9)} | {(i, 30 + i % 5) for i in range(20)})
    mentions = spark.createDataFrame(edges, "page_id long, target long")
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(10)] + [(100, 106), (100, 107), (106, 100)]
    for a, b in pairs:
        if a != b:
            assert G._path(mentions, a, b, 6) == one_sided(edges, a, b), (a, b)


def test_evidence_through_any_redirect(spark):
    """7 redirects to 8, which redirects to 9; a link to 7 is evidence for 8 as well as for 9."""
    make = spark.createDataFrame
    g = G.Graph(
        articles=make([(1, "A"), (7, "R1"), (8, "R2"), (9, "End")], "page_id long, title string"), sections=make([(1, 0)], "page_id long, sec_i int"),
        paragraphs=make([(1, 0, 0, "a long text that links to R2"), (1, 0, 1, "to R1")], "page_id long, sec_i int, para_i int, text string"),
        links=make([(1, 0, 0, 8), (1, 0, 1, 7)], "page_id long, sec_i int, para_i int, target long"), redirects=make([(7, 8), (8, 9), (9, 9)], "page_id long, target long"),
    )
    assert sorted(rows(G._leading_to(g.redirects, [8, 9]))) == [(7, 8), (7, 9), (8, 8), (8, 9), (9, 9)]
    assert rows(G._leading_to(g.redirects, [7])) == [(7, 7)]
    reach = G._leading_to(g.redirects, [8]).join(g.links, "target")
    assert {r["para_i"] for r in reach.collect()} == {0, 1}


def test_many_sources_at_once(spark):
    rng = random.Random(8)
    n = 150
    edges = sorted({(rng.randrange(n), rng.randrange(n)) for _ in range(260)})
    articles = spark.createDataFrame([(i, f"T{i}") for i in range(n)] + [(900, "T3"), (901, "Old")], "page_id long, title string")
    links = spark.createDataFrame([(a, 0, 0, b) for a, b in edges], "page_id long, sec_i int, para_i int, target long")
    g = G.Graph(articles, None, None, links, spark.createDataFrame([(901, 5), (7, 8)], "page_id long, target long")).stored()
    sources = [f"T{i}" for i in range(140)] + ["Old", "nobody", None, "T1"]
    got = {}
    for r in G.distances_of(g, spark.createDataFrame([(t,) for t in sources], "title string"), 3).collect():
        got.setdefault(r["source"], {})[r["title"]] = r["distance"]
    for title in ("T1", "T3", "T7", "T64", "T139", "Old", "nobody"):
        assert got.get(title, {}) == {r[0]: r[1] for r in rows(G.within_distance(g, title, 3))}
