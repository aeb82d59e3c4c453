import bz2
import json

import pytest

from graphleaf.operators import evaluation as E
from graphleaf.operators import graph as G
from graphleaf.operators import search as S
from graphleaf.sources import dump as D
from graphleaf.sources import exports as K
from graphleaf.sources.traces import read_traces
from graphleaf.sources.wikitext import parse, plain_text, sections
from graphleaf.streaming.turns import events_by_minute, turn_log, turn_stream
from graphleaf.tools import NAMES, SCENARIOS, Tools, chosen


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- search

def test_topk_breaks_ties_by_id(spark):
    data = spark.createDataFrame([(3, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (4, None), (5, [1.0])], "id long, embedding array<double>")
    assert [r["id"] for r in S.vector_topk(data, [1.0, 0.0], 3, "id").collect()] == [1, 3, 2]


def test_vector_topk_ranks_whole_scores(spark):
    data = spark.createDataFrame([(1, [1.0, 1e-5]), (2, [1.0, 0.0]), (3, [0.0, 0.0]), (4, [1.0, 0.0])], "id int, embedding array<double>")
    assert [(r["id"], r["score"]) for r in S.vector_topk(data, [1.0, 0.0], 4, "id").collect()] == [(2, 1.0), (4, 1.0), (1, 1.0)]
    chunks = spark.createDataFrame([("c0", "p1", [1.0, 1e-5]), ("c1", "p1", [1.0, 0.0]), ("c2", "p0", [0.0, 0.0])], "chunk_id string, paragraph_id string, embedding array<double>")
    assert rows(S.paragraph_topk(chunks, spark.createDataFrame([("p1", "x"), ("p0", "y")], "paragraph_id string, text string"), [1.0, 0.0], 2)) == [("p1", "x", "c1", 1.0)]


def test_paragraph_topk_may_return_fewer(spark):
    chunks = spark.createDataFrame([(f"c{i}", "p1" if i < 8 else "p2", [1.0, i / 10]) for i in range(9)], "chunk_id string, paragraph_id string, embedding array<double>")
    paragraphs = spark.createDataFrame([("p1", "x"), ("p2", "y")], "paragraph_id string, text string")
    assert rows(S.paragraph_topk(chunks, paragraphs, [1.0, 0.0], 2)) == [("p1", "x", "c0", 1.0)]


def test_title_match_asks_for_the_likest_of_all(spark, tmp_path):
    """120 titles share the asked title's words and are closer in BM25; the likest one ranks after them."""
    from graphleaf.plans.queries import title_match

    crowd = [(50 * k, "red red tin box", "tin", 1) for k in range(100, 220)]
    odd = [(350, "red old tin boxes and a long list of other words", "steel", 2)]
    spark.createDataFrame(crowd + odd, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    got = {r["query"]: r for r in title_match(spark, str(tmp_path)).collect()}
    title = "red old tin boxes and a long list of other words steel 2"
    assert {q: r["step"] for q, r in got.items() if "old" in q or "OLD" in q} == {title: 1, title.upper().replace(" ", "_"): 2}
    assert got["red thing tin boxes and a long list of other words steel 2"]["page_id"] == 350
    assert got["red thing tin box tin 1"]["page_id"] == 5000 and sum(q.startswith("zzz") for q in got) == 121


def test_title_match_takes_the_likest_of_a_thousand(spark, tmp_path):
    """Sixty titles with all words of the query come before the likest one in BM25."""
    from graphleaf.functions.fuzzy import wratio
    from graphleaf.plans.queries import title_match

    names = ["blue extraordinary lamp", "blue thinglamp"] + ["thing lamp blue green yellow orange purple"] * 60
    parts = [(50 * k + 50, n, "x", 0) for k, n in enumerate(names)]
    spark.createDataFrame(parts, "p_partkey long, p_name string, p_type string, p_size int").write.parquet(str(tmp_path / "part.parquet"))
    query = "blue thing lamp x 0"
    likest = max(wratio(query, f"{n} x 0") for n in names)
    assert likest == wratio(query, "blue thinglamp x 0")
    got = {r["query"]: r for r in title_match(spark, str(tmp_path)).collect()}[query]
    assert (got["page_id"], got["score"]) == (100, round(likest, 6))


def test_title_matching_steps(spark):
    titles = spark.createDataFrame([(1, "Ada Lovelace"), (2, "Ada lovelace"), (3, "Charles Babbage"), (4, "Ada Lovelace")], "page_id long, title string")
    asked = spark.createDataFrame([("Ada Lovelace",), ("charles_babbage ",), ("Babbage, Charles",), ("zzz",), (None,)], "query string")
    got = {r["query"]: (r["page_id"], r["matched"], r["step"]) for r in S.match_titles(asked, titles).collect()}
    assert got == {"Ada Lovelace": (1, "Ada Lovelace", 1), "charles_babbage ": (3, "Charles Babbage", 2), "Babbage, Charles": (3, "Charles Babbage", 3), "zzz": (None, None, 0)}
    traces = spark.createDataFrame([(1, "q", "https://x/wiki/Ada_Lovelacehttps://x/wiki/Babage%20Charles"), (2, "r", "https://x/wiki/zzz")], "ex_num long, question string, source_url string")
    matches, corrections, unmatched = S.process_traces(traces, titles)
    assert sorted((r[0], len(r[2])) for r in rows(matches)) == [(1, 2), (2, 0)] and rows(corrections)[0][:2] == ("Babage Charles", "Charles Babbage") and rows(unmatched) == [(2, "zzz")]


def test_equal_titles_seek_no_candidates(spark, monkeypatch):
    """Queries for an equal title or normal form make look-ups alone: the best candidates of the others are not theirs to seek."""
    from graphleaf.plans import queries as Q

    sf = "/root/testdata/sf0.01"
    whole = {r["query"]: (r["step"], r["page_id"]) for r in S.match_titles(Q._asked(spark, sf), Q._titles(spark, sf)).collect()}
    monkeypatch.setattr(S, "bm25", None)
    for step, query in ((1, Q.title_exact), (2, Q.title_normalized)):
        found = query(spark, sf)
        assert "InPandas" not in found._jdf.queryExecution().toString()
        assert {r["query"]: r["page_id"] for r in found.collect()} == {q: page for q, (s, page) in whole.items() if s == step}


def test_traces_broadcast_no_table(spark):
    """What grows with titles or traces is not sent through the driver, however small it is here."""
    from graphleaf.plans import queries as Q

    for df in Q._traces(spark, "/root/testdata/sf0.01"):
        df.collect()
        assert "BroadcastHashJoin" not in df._jdf.queryExecution().executedPlan().toString()


def test_trace_files(spark, tmp_path):
    one = {"canary": "x", "Who?": {"provenance": {"a": [{"source_url": ["https://x/wiki/A", "https://x/wiki/B"]}, {"source_url": None}, {}], "b": "none"}}}
    for n, trace in ((4, one), (5, {"What?": {}})):
        (tmp_path / f"dataset_ex_{n}.json").write_text(json.dumps(trace))
    assert sorted(rows(read_traces(spark, str(tmp_path))), key=str) == [(4, "Who?", "https://x/wiki/A"), (4, "Who?", "https://x/wiki/B"), (5, "What?", None)]


# --- evaluation

def test_release_join_is_strict(spark):
    matches = spark.createDataFrame([(0, 1, "q")], "pos int, ex_num long, question string")
    release = "ex_num long, question string, decomposition string, validated_answer string"
    assert rows(E.release_questions(matches, spark.createDataFrame([(1, "q", "d", "a"), (2, "x", "d", "a")], release))) == [(1, "q", "d", "a")]
    for wrong in ([(1, "other", "d", "a")], [(2, "q", "d", "a")]):
        with pytest.raises(E.RecordError):
            E.release_questions(matches, spark.createDataFrame(wrong, release))


def test_one_rejected_source_drops_the_question(spark):
    matches = spark.createDataFrame([(1, [("1", "A"), ("2", "B"), ("3", "C")]), (2, [("1", "A")]), (3, [])], "ex_num long, sources array<struct<page_id: string, title: string>>")
    decisions = spark.createDataFrame([("b", "B", "False"), ("a", "A", "True")], "original string, matched string, accept string")
    assert sorted(r[0] for r in rows(E.accepted_questions(matches, decisions))) == [2, 3]


def test_merge_checks(spark):
    kind = "ex_num long, query string, agent_settings string, score double, success boolean"
    a = spark.createDataFrame([(1, "q", "s", 1.0, True), (2, "r", "s", None, False)], kind)
    assert sorted(r[0] for r in rows(E.merge_runs(a, spark.createDataFrame([(2, "r", "s", 0.5, True)], kind), ["score"]))) == [1, 2]
    with pytest.raises(AssertionError):
        E.merge_runs(a, spark.createDataFrame([(2, "r", "t", 0.5, True)], kind), ["score"])
    with pytest.raises(KeyError):
        E.merge_runs(a, spark.createDataFrame([(1, "q", "s", 0.5, True)], kind), ["score"])
    assert rows(E.last_of_each(spark.createDataFrame([(1, 0), (1, 5)], "ex_num long, pos int"), "ex_num", "pos")) == [(1, 5)]


# --- dump, wikitext, files

PAGES = [(1, "Alpha &amp; Beta", 0, None, "lead [[Gamma|g]]\n\n== H ==\n\ntext"), (2, "Gamma", 0, "Alpha &amp; Beta", "#REDIRECT [[Alpha & Beta]]"), (3, "Talk: x", 1, None, "")]


def page_xml(page, title, ns, redirect, text):
    link = f'<redirect title="{redirect}" />' if redirect else ""
    old = "<revision><id>1</id><timestamp>2020-01-01T00:00:00Z</timestamp><text>old</text></revision>"
    body = text.replace("&", "&amp;")
    return f"<page><title>{title}</title><ns>{ns}</ns><id>{page}</id>{link}{old}<revision><id>2</id><timestamp>2024-01-01T00:00:00Z</timestamp><text>{body}</text></revision></page>"


@pytest.fixture(scope="module")
def dump(tmp_path_factory):
    folder = tmp_path_factory.mktemp("dump")
    path = folder / "w-pages-articles-multistream.xml.bz2"
    parts = ["<mediawiki><siteinfo/>", *(page_xml(*p) for p in PAGES), "</mediawiki>"]
    path.write_bytes(b"".join(bz2.compress(p.encode()) for p in parts))
    (folder / "w-pages-articles-multistream-index.txt.bz2").write_bytes(bz2.compress(b"1:2:a\n"))
    return path


def test_multistream_dump(spark, dump):
    pages = D.multistream(spark, str(dump)).orderBy("page_id").collect()
    assert [(r["page_id"], r["title"], r["ns"], r["redirect"], r["text"]) for r in pages] == [(1, "Alpha & Beta", 0, None, PAGES[0][4]), (2, "Gamma", 0, "Alpha & Beta", PAGES[1][4]), (3, "Talk: x", 1, None, "")]
    lines = [r["value"] for r in D.index_lines(spark, str(dump)).collect()]
    assert [x.split(":", 2)[1:] for x in lines] == [["1", "Alpha & Beta"], ["2", "Gamma"], ["3", "Talk: x"]]
    assert [int(x.split(":")[0]) for x in lines] == D.stream_offsets(str(dump))[1:4]
    assert D.index_pairs(str(dump.parent)) == [(str(dump), str(dump).replace("multistream.xml", "multistream-index.txt"))]
    some = D.multistream(spark, str(dump), offsets=D.stream_offsets(str(dump))[2:3])
    assert [r["page_id"] for r in some.collect()] == [2] and D.multistream(spark, str(dump), offsets=[]).count() == 0
    other = D.xml_pages(spark, str(dump)).orderBy("page_id").collect()
    assert [(r["page_id"], r["title"], r["redirect"], r["text"]) for r in other] == [(r["page_id"], r["title"], r["redirect"], r["text"]) for r in pages]


def test_index(spark):
    lines = spark.createDataFrame([("10:1:A_b", "f"), ("10:2:C: d", "f"), ("30:3:E", "f"), ("x:4:F", "f"), ("5:6", "f"), ("7:8:G", "g")], "value string, file string")
    got = {r["page_id"]: (r["title"], r["offset"], r["end"]) for r in D.matched_entries(D.parse_index(lines)).collect()}
    assert got == {1: ("A b", 10, 30), 2: ("C: d", 10, 30), 3: ("E", 30, None), 8: ("G", 7, None)}
    wanted = spark.createDataFrame([("E",), ("nobody",)], "title string")
    found = D.matched_entries(D.parse_index(lines), titles=wanted, page_ids=spark.createDataFrame([(1,)], "page_id long"))
    assert sorted(r["page_id"] for r in found.collect()) == [1, 3]
    with pytest.raises(LookupError, match="nobody"):
        D.require_all(wanted, found, "title")
    with pytest.raises(ValueError):
        D.require_unique(spark.createDataFrame([(1,), (1,)], "page_id long"))
    assert [r["ns"] for r in D.namespaces(spark.createDataFrame([("10",), ("x",), ("2",), ("2",)], "ns string")).collect()] == ["2", "10", "x"]


def test_wikitext():
    text = "lead {{t|{{u}}}}\n\n== A ==\n\na [[B#x|b]] '''c'''\n=== A1 ===\n\ndeep\n== C ==\n"
    assert [s.split("\n")[0] for s in sections(text)] == ["lead {{t|{{u}}}}", "== A ==", "=== A1 ===", "== C =="]
    parsed = parse(text)
    assert parsed[0] == [("lead ", [])] and parsed[1][1] == ("a b c\n=== A1 ===", ["B"]) and parsed[1][-1][0].startswith("deep") and parsed[3] == [("== C ==", [])]
    assert plain_text("x<!-- no -->[http://e.org site]<ref>r</ref>{| a |} &lt;") == "xsite <"


def test_graph_of_pages(spark, dump):
    pages = D.multistream(spark, str(dump))
    g = D.graph_of_pages(pages)
    assert rows(g.redirects) == [(2, 1)] and sorted(rows(g.links)) == [(1, 0, 0, 2), (2, 0, 0, 1)]
    assert [r[1] for r in rows(G.article_text(g, "Gamma"))] == ["lead g", "== H ==", "text"]
    assert sorted(rows(g.sections)) == [(1, 0), (1, 1), (2, 0), (3, 0)]


def test_shards(spark, tmp_path):
    nodes = spark.createDataFrame([(f"n{i}", "Article" if i % 2 else "Chunk", "t", "" if i < 2 else "x") for i in range(10)], "nodeID string, label string, title string, text string").coalesce(1)
    assert K.write_nodes(nodes, str(tmp_path), 4) == 3
    assert sorted(p.name for p in tmp_path.glob("nodes-*")) == ["nodes-00000.parquet", "nodes-00001.parquet", "nodes-00002.parquet"]
    assert sorted(rows(K.read_shards(spark, str(tmp_path), "nodes", K.NODE_COLUMNS))) == sorted(rows(nodes))
    edges = spark.createDataFrame([("article:1:s0:p0", "article:2", "LINKS_TO")] * 2, "start_id string, end_id string, rel_type string")
    first = K.write_edges(edges, str(tmp_path))
    K.write_edges(G.mentions_of_edges(edges), str(tmp_path), first=first)
    assert K.read_shards(spark, str(tmp_path), "edges", K.EDGE_COLUMNS).count() == 3
    embedded = K.embedded_nodes(nodes, lambda: lambda texts: [[len(t), 0.5] for t in texts])
    assert [r["embedding"] for r in embedded.orderBy("nodeID").limit(3).collect()] == [None, "1.0;0.5", "1.0;0.5"]
    with pytest.raises(ValueError):
        K.read_shards(spark, str(tmp_path), "nodes", K.EDGE_COLUMNS)
    counted = K.token_counts(nodes, lambda: lambda texts: [len(t) for t in texts]).select("n_tokens")
    assert rows(E.scaled_tokens(nodes, counted)) == [(10, 10, 8, 8)]


def test_result_files(spark, tmp_path):
    questions = spark.createDataFrame([(i, f'q"{i}\nx') for i in range(70)], "pos int, question string")
    K.write_batches(E.batches(questions), str(tmp_path / "b"))
    assert len(list((tmp_path / "b").glob("batch=*"))) == 3
    assert json.loads(K.as_json_list(questions.limit(2), "pos").first()[0]) == [{"question": 'q"0\nx'}, {"question": 'q"1\nx'}]
    questions.coalesce(1).write.option("header", True).option("escape", '"').csv(str(tmp_path / "r"))
    assert K.read_results(spark, str(tmp_path / "r")).count() == 70
    assert len(spark.createDataFrame([], E.RESULT_SCHEMA).columns) == 20


# --- turn log and tools

def test_turn_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text("\n".join(json.dumps({"event": e, "logged_at": f"2024-01-01T00:0{m}:01"}) for m, e in ((0, "llm_start"), (0, "llm_start"), (1, "judge"), (1, "unknown"))))
    whole = sorted((r["event"], r["n"]) for r in events_by_minute(turn_log(spark, str(tmp_path))).collect())
    q = events_by_minute(turn_stream(spark, str(tmp_path))).writeStream.outputMode("complete").format("memory").queryName("turns").trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert whole == [("judge", 1), ("llm_start", 2)] == sorted((r["event"], r["n"]) for r in spark.sql("select * from turns").collect())


def test_tools(spark, dump):
    g = D.graph_of_pages(D.multistream(spark, str(dump)))
    vectors = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.0, 1.0])], "page_id long, embedding array<double>")
    tools = Tools(g, embed=lambda text: [1.0, 0.0], article_vectors=vectors)
    assert json.loads(tools.get_article_text("Gamma"))["paragraph_count"] == 3
    assert json.loads(tools.vector_search_article("x", 99)) == {"query": "x", "k": 50, "results": [{"article_nodeID": "article:1", "title": "Alpha & Beta", "score": 1.0}, {"article_nodeID": "article:2", "title": "Gamma", "score": 0.0}]}
    assert "error" in json.loads(tools.vector_search_paragraph("x")) and "error" in json.loads(tools.get_backlinks(3))
    assert json.loads(tools.calculate("3**49"))["result"] == 3**49 and "error" in json.loads(tools.calculate("x")) and "error" in json.loads(tools.get_sections("a"))
    assert json.loads(tools.window_sections("article:1:s0", -5))["n"] == 0 and json.loads(tools.get_sections(["article:1:s1"]))["paragraph_count"] == 2
    assert json.loads(tools.shortest_path("Gamma", "Alpha & Beta"))["hop_count"] == 0
    with pytest.raises(ValueError):
        tools.window_sections("article:1:s0", "many")
    assert len(chosen(tools, NAMES)) == 13 and len(SCENARIOS["graph"]) == 11
    for wrong, error in (([], ValueError), (["nope"], ValueError), ("calculate", TypeError)):
        with pytest.raises(error):
            chosen(tools, wrong)
