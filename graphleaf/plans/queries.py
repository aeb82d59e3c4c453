"""Queries over the driver tables and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.functions import text as X
from graphleaf.functions.calculate import calculate_column
from graphleaf.functions.english import english_words
from graphleaf.functions.fuzzy import wratio_column
from graphleaf.operators import evaluation as E
from graphleaf.operators import graph as G
from graphleaf.operators import search as S
from graphleaf.operators.text_index import TextIndex, build_text_index
from graphleaf.operators.vector_index import VectorIndex, build_index
from graphleaf.plans.derived import SQL, boxed_graph, derived_graph, derived_pages, kept_graph, stored_graph, table
from graphleaf.sources import dump as D
from graphleaf.sources import exports as X_
from graphleaf.sources.wikitext import parsed_pages
from graphleaf.tables import written_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, graph_sql: bool = False) -> Callable:
    """Register a function under its name, with the SQL of its rows; ``graph_sql`` puts the derived graph's tables before it."""

    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = f"WITH RECURSIVE {SQL}{', ' if sql.lstrip().startswith('%') else ''}{sql.replace('%', '', 1) if sql.lstrip().startswith('%') else sql}" if graph_sql else sql
        return f

    return register


# --- reading the graph ------------------------------------------------------

@query("SELECT pid AS \"nodeID\", text FROM paragraphs WHERE page_id = 6", graph_sql=True)
def article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.article_text(derived_graph(spark, sf_dir), "Doc 6")


@query("SELECT page_id, sec_i, para_i, chunk_i, text FROM chunks", graph_sql=True)
def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_graph(spark, sf_dir).chunks()


@query("SELECT doc_id, (CASE WHEN length(text) = 0 THEN 0 WHEN length(text) <= 500 THEN 1 ELSE 1 + ceil((length(text) - 500) / 460.0) END)::INTEGER AS n_chunks FROM documents")
def chunk_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", X.chunk_count(F.col("text")).alias("n_chunks"))


@query(ORACLES["article_text"])
def kept_article_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from bucketed tables, of which one bucket each is read."""
    return G.article_text(kept_graph(spark, sf_dir), "Doc 6")


def _chain_sql(source: str, keys: str, number: str, node: str, kind: str) -> str:
    return f"""% pairs AS (SELECT {node} AS a, lead({node}) OVER (PARTITION BY {keys} ORDER BY {number}) AS b FROM {source})
SELECT a AS start_id, b AS end_id, 'NEXT_{kind}' AS rel_type FROM pairs WHERE b IS NOT NULL UNION ALL SELECT b, a, 'PREVIOUS_{kind}' FROM pairs WHERE b IS NOT NULL"""


@query(_chain_sql("sections", "page_id", "sec_i", "sid", "SECTION"), graph_sql=True)
def section_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.section_chain(derived_graph(spark, sf_dir))


@query(_chain_sql("paragraphs", "page_id, sec_i", "para_i", "pid", "PARAGRAPH"), graph_sql=True)
def paragraph_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.paragraph_chain(derived_graph(spark, sf_dir))


@query(_chain_sql("chunks", "pid", "chunk_i", "cid", "CHUNK"), graph_sql=True)
def chunk_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.chunk_chain(derived_graph(spark, sf_dir))


@query("SELECT page_id, sec_i, para_i, target FROM links", graph_sql=True)
def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_graph(spark, sf_dir).links


@query("SELECT page_id, target FROM mentions", graph_sql=True)
def mentions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return derived_graph(spark, sf_dir).mentions()


@query("SELECT 'article:' || page_id AS start_id, 'article:' || target AS end_id, 'MENTIONS' AS rel_type FROM mentions", graph_sql=True)
def mentions_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.mentions_of_edges(G.edges(derived_graph(spark, sf_dir)))


def _four_fifths(spark: SparkSession, sf_dir: str) -> G.Graph:
    """The graph without every fifth article, all links and redirects left in."""
    return replace(g := derived_graph(spark, sf_dir), articles=g.articles.filter("page_id % 5 <> 4"))


@query("SELECT target AS page_id FROM links WHERE target % 5 = 4 UNION SELECT target FROM redirects WHERE target % 5 = 4", graph_sql=True)
def stub_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.missing_articles(_four_fifths(spark, sf_dir))


@query("""SELECT 'Doc ' || page_id AS source_article, pid AS "paragraph_nodeID", text FROM links WHERE target = 6 AND page_id <> 6 ORDER BY source_article, page_id, sec_i, para_i LIMIT 500""", graph_sql=True)
def backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.backlinks(derived_graph(spark, sf_dir), "Doc 6", 500)


@query(ORACLES["backlinks"])
def kept_backlinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the links kept by target."""
    return G.backlinks(kept_graph(spark, sf_dir), "Doc 6")


@query("SELECT page_id, target AS terminal FROM redirects", graph_sql=True)
def redirect_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.redirect_terminals(derived_graph(spark, sf_dir).redirects)


#: Every order points at the one 25 before it, in chains of up to twelve, and three orders in a circle.
_CHAINS = "SELECT o_orderkey AS page_id, o_orderkey - 25 AS target FROM orders WHERE o_orderkey % 300 >= 25 UNION ALL VALUES (1, 2), (2, 3), (3, 1)"


@query(f"""WITH RECURSIVE r AS ({_CHAINS}), walk AS (SELECT page_id, target, 1 AS n FROM r UNION ALL SELECT w.page_id, r.target, n + 1 FROM walk w JOIN r ON w.target = r.page_id WHERE n < 10)
SELECT r.page_id::BIGINT AS page_id, coalesce(t.target, r.page_id)::BIGINT AS terminal FROM r LEFT JOIN (SELECT * FROM walk WHERE target NOT IN (SELECT page_id FROM r)) t USING (page_id)""")
def redirect_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").filter("o_orderkey % 300 >= 25").selectExpr("o_orderkey AS page_id", "o_orderkey - 25 AS target")
    return G.redirect_terminals(orders.unionByName(spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "page_id long, target long")))


@query("""% near AS (SELECT target AS page_id, 1 AS d FROM mentions WHERE page_id = 1 UNION SELECT m.target, d + 1 FROM near n JOIN mentions m ON m.page_id = n.page_id WHERE d < 3),
least AS (SELECT page_id, min(d) AS d FROM near WHERE page_id <> 1 GROUP BY page_id),
ended AS (SELECT coalesce(r.target, l.page_id) AS page_id, d FROM least l LEFT JOIN redirects r ON r.page_id = l.page_id)
SELECT 'Doc ' || page_id AS title, min(d)::INTEGER AS distance FROM ended WHERE page_id <> 1 GROUP BY 1""", graph_sql=True)
def within_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.within_distance(stored_graph(spark, sf_dir), "Doc 1", 3)


@query("""% near AS (SELECT page_id AS source, page_id, 0 AS d FROM articles WHERE page_id % 50 = 0 UNION SELECT n.source, m.target, d + 1 FROM near n JOIN mentions m ON m.page_id = n.page_id WHERE d < 3),
least AS (SELECT source, page_id, min(d) AS d FROM near GROUP BY 1, 2 HAVING min(d) > 0),
ended AS (SELECT source, coalesce(r.target, l.page_id) AS page_id, d FROM least l LEFT JOIN redirects r ON r.page_id = l.page_id)
SELECT 'Doc ' || source AS source, 'Doc ' || page_id AS title, min(d)::INTEGER AS distance FROM ended WHERE page_id <> source GROUP BY 1, 2""", graph_sql=True)
def distances_of_many(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is within three mentions of every article whose id is divisible by 50, in one search."""
    g = stored_graph(spark, sf_dir)
    return G.distances_of(g, g.articles.filter("page_id % 50 = 0").select("title"), 3)


@query("""% near AS (SELECT 1::BIGINT AS page_id, 0 AS d UNION SELECT m.target, d + 1 FROM near n JOIN mentions m ON m.page_id = n.page_id WHERE d < 6),
dist AS (SELECT page_id, min(d) AS d FROM near GROUP BY 1),
par AS (SELECT b.page_id, min(a.page_id) AS parent, b.d FROM dist a JOIN mentions m ON m.page_id = a.page_id JOIN dist b ON b.page_id = m.target AND b.d = a.d + 1 GROUP BY 1, 3),
back AS (SELECT page_id, parent, d FROM par WHERE page_id = 77 UNION ALL SELECT p.page_id, p.parent, p.d FROM back b JOIN par p ON p.page_id = b.parent),
ev AS (SELECT b.d - 1 AS hop, b.parent, b.page_id AS to_id, l.pid, l.text, row_number() OVER (PARTITION BY b.d ORDER BY length(l.text), l.sec_i, l.para_i) AS r FROM back b JOIN links l ON l.page_id = b.parent AND (l.target = b.page_id OR l.target IN (SELECT page_id FROM redirects WHERE target = b.page_id)))
SELECT hop::INTEGER AS hop, 'Doc ' || parent AS from_article, 'Doc ' || to_id AS to_article, pid AS "paragraph_nodeID", text AS paragraph_text FROM ev WHERE r = 1""", graph_sql=True)
def shortest_path(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.shortest_path(stored_graph(spark, sf_dir), "Doc 1", "Doc 77")


@query("SELECT pid AS \"paragraph_nodeID\", para_i - 1 AS \"offset\", text FROM paragraphs WHERE page_id = 8 AND sec_i = 0 AND abs(para_i - 1) <= 2", graph_sql=True)
def window_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.window_paragraphs(derived_graph(spark, sf_dir), "article:8:s0:p1", 2)


@query("""SELECT s.sid AS "section_nodeID", s.sec_i - 1 AS "offset", min(p.pid) FILTER (p.para_i = 0) AS "first_paragraph_nodeID", min(p.text) FILTER (p.para_i = 0) AS first_paragraph_text, count(p.pid)::BIGINT AS paragraph_count
FROM sections s LEFT JOIN paragraphs p USING (page_id, sec_i) WHERE s.page_id = 5 AND abs(s.sec_i - 1) <= 2 AND EXISTS (SELECT 1 FROM sections WHERE page_id = 5 AND sec_i = 1) GROUP BY 1, 2""", graph_sql=True)
def window_sections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.window_sections(derived_graph(spark, sf_dir), "article:5:s1", 2)


@query("""SELECT sid AS "section_nodeID", pid AS "paragraph_nodeID", text FROM (SELECT unnest(['article:7:s0', 'article:3:s0', 'article:7:s0', 'article:0:s9999']) AS sid) JOIN sections USING (sid) JOIN paragraphs USING (page_id, sec_i)""", graph_sql=True)
def sections_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.sections_by_id(derived_graph(spark, sf_dir), ["article:7:s0", "article:3:s0", "article:7:s0", "article:0:s9999"])


@query("SELECT sid AS \"nodeID\", substr(text, 1, 500) AS title FROM sections JOIN paragraphs USING (page_id, sec_i) WHERE page_id = 8 AND para_i = 0", graph_sql=True)
def section_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.section_titles(derived_graph(spark, sf_dir), "Doc 8")


@query("SELECT 'section title' AS kind, sid AS \"nodeID\", substr(text, 1, 500) AS text FROM sections JOIN paragraphs USING (page_id, sec_i) WHERE page_id = 8 AND para_i = 0", graph_sql=True)
def section_titles_and_infoboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.section_titles_and_infoboxes(derived_graph(spark, sf_dir), "Doc 8")


@query("SELECT 'Article' AS label, count(*)::BIGINT AS n FROM articles UNION ALL SELECT 'Section', count(*) FROM sections UNION ALL SELECT 'Paragraph', count(*) FROM paragraphs UNION ALL SELECT 'Chunk', count(*) FROM chunks", graph_sql=True)
def label_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.label_counts(G.nodes(derived_graph(spark, sf_dir)))


@query("""SELECT 'article:' || page_id AS "nodeID", 'Article' AS label, title, '' AS text FROM articles UNION ALL SELECT sid, 'Section', '', '' FROM sections UNION ALL SELECT pid, 'Paragraph', '', text FROM paragraphs UNION ALL SELECT cid, 'Chunk', '', text FROM chunks""", graph_sql=True)
def export_nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.nodes(derived_graph(spark, sf_dir))


@query(f"""% chain_s AS (SELECT sid AS a, lead(sid) OVER (PARTITION BY page_id ORDER BY sec_i) AS b, 'SECTION' AS k FROM sections UNION ALL SELECT pid, lead(pid) OVER (PARTITION BY page_id, sec_i ORDER BY para_i), 'PARAGRAPH' FROM paragraphs UNION ALL SELECT cid, lead(cid) OVER (PARTITION BY pid ORDER BY chunk_i), 'CHUNK' FROM chunks),
pairs AS (SELECT * FROM chain_s WHERE b IS NOT NULL),
all_edges AS (SELECT 'HAS_SECTION' AS rel_type FROM sections UNION ALL SELECT 'HAS_PARAGRAPH' FROM paragraphs UNION ALL SELECT 'HAS_CHUNK' FROM chunks UNION ALL SELECT 'NEXT_' || k FROM pairs UNION ALL SELECT 'PREVIOUS_' || k FROM pairs UNION ALL SELECT 'LINKS_TO' FROM links UNION ALL SELECT 'REDIRECTS_TO' FROM redirects UNION ALL SELECT 'MENTIONS' FROM mentions)
SELECT rel_type, count(*)::BIGINT AS n FROM all_edges GROUP BY 1""", graph_sql=True)
def export_edge_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.edges(derived_graph(spark, sf_dir), mentions=True).groupBy("rel_type").agg(F.count("*").alias("n"))


# --- text functions ---------------------------------------------------------

_BOX = "'{{Infobox a|{{b|' || text || '}}|c}}'"


@query(f"SELECT doc_id, 0 AS box, {_BOX} AS infobox FROM documents UNION ALL SELECT doc_id, 1, '{{{{Infobox d|' || lang || '}}}}' FROM documents")
def infoboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    box = F.concat(F.lit("{{Infobox a|{{b|"), F.col("text"), F.lit("}}|c}}"))
    text = F.concat(F.lit("lead }} "), box, F.lit("\n{{Infobox open {{Infobox d|"), F.col("lang"), F.lit("}} tail"))
    return docs.select("doc_id", F.posexplode(X.infoboxes(text)).alias("box", "infobox"))


@query(r"SELECT doc_id, trim(replace(line, '=', ''), ' ') AS heading FROM (SELECT doc_id, unnest(string_split('== ' || lang || ' ==' || chr(10) || text || chr(10) || ' === ' || source || ' === ', chr(10))) AS line FROM documents) WHERE regexp_full_match(line, '\s*=+[^=]+=+\s*')")
def headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit("== "), F.col("lang"), F.lit(" ==\n"), F.col("text"), F.lit("\n === "), F.col("source"), F.lit(" === "))
    return table(spark, sf_dir, "documents").select("doc_id", F.explode(X.headings(text)).alias("heading"))


@query("SELECT p_partkey, trim(replace(p_name, ' ', '_'), '_') AS raw, p_name AS canon, lower(p_name) AS normal FROM part")
def canonical_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.replace(F.col("p_name"), F.lit(" "), F.lit("_"))
    noisy = F.concat(F.lit(" _\n"), raw, F.lit("\r\n"))
    return table(spark, sf_dir, "part").select("p_partkey", raw.alias("raw"), X.canon_title(noisy).alias("canon"), X.normal_title(noisy, stripped=True).alias("normal")).withColumn("normal", X.strip("normal"))


@query("SELECT p_partkey, unnest([p_name, p_brand || '+' || p_size]) AS title FROM part")
def article_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = F.replace(F.col("p_name"), F.lit(" "), F.lit("%20"))
    links_ = F.concat(F.lit("https://x.org/wiki/"), name, F.lit("#a,http://x.org/wiki/"), F.replace("p_brand", F.lit("#"), F.lit("%23")), F.lit("+"), F.col("p_size"), F.lit(",;\nhttps://x.org/other"))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(X.article_titles(links_)).alias("title"))


@query("SELECT o_orderkey, CASE WHEN n >= 1e9 THEN printf('%.1fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.1fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.1fk', n / 1e3) ELSE n::VARCHAR END AS shown FROM (SELECT o_orderkey, o_orderkey * 1230 + 1 AS n FROM orders)")
def short_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", X.short_count(F.col("o_orderkey") * 1230 + 1).alias("shown"))


@query("SELECT p_partkey, ((p_partkey * 3 + 1) ** 2)::BIGINT::VARCHAR AS result FROM part")
def calculate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", calculate_column(F.format_string("(%d * 3 + 1) ** 2", "p_partkey")).alias("result"))


@query("SELECT p_partkey, (3::HUGEINT ** 9 + p_partkey * 2)::HUGEINT::VARCHAR AS result FROM part")
def calculate_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", calculate_column(F.format_string("3**9 + %d*2", "p_partkey")).alias("result"))


@query("SELECT p_partkey, '239299329230617529590083' AS result FROM part")
def calculate_beyond_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Integers have no width."""
    return table(spark, sf_dir, "part").select("p_partkey", calculate_column(F.lit("3**49")).alias("result"))


@query()
def wratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select("p_partkey", wratio_column("p_name", "p_type").alias("score"))


@query("""SELECT doc_id AS page_id, 0 AS sec_i, 0 AS para_i, lang AS text, '' AS targets FROM documents UNION ALL SELECT doc_id, 0, 1, trim(text, ' ' || chr(10)), '' FROM documents
UNION ALL SELECT doc_id, 1, 0, '== ' || source || ' ==', '' FROM documents UNION ALL SELECT doc_id, 1, 1, 'see this', 'Doc ' || doc_id FROM documents""")
def wikitext(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as pages with a heading, a template and a link, parsed."""
    docs = table(spark, sf_dir, "documents")
    page = F.concat(F.lit("{{t|{{u}}}}'''"), F.col("lang"), F.lit("'''\n\n"), F.col("text"), F.lit("\n== "), F.col("source"), F.lit(" ==\n\nsee [[Doc "), F.col("doc_id"), F.lit("|this]]"))
    return parsed_pages(docs.select(F.col("doc_id").alias("page_id"), page.alias("text"))).withColumn("targets", F.array_join("targets", ","))


@query("""SELECT doc_id AS page_id, 0 AS sec_i, 0 AS para_i, 'thumb|by the ' || lang || ' now ' || text AS text, 'File:' || source || '.jpg;' || lang || ';in;cited' AS targets FROM documents
UNION ALL SELECT doc_id, 1, 0, '== ' || lang || ' ==' || chr(10) || source AS text, source FROM documents""")
def wikitext_nested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links in captions, in templates and in references, and whole texts that are not to be read as marks."""
    marks = [F.lit("[[File:"), F.col("source"), F.lit(".jpg|thumb|by [["), F.col("lang"), F.lit("|the "), F.col("lang"), F.lit("]] now]]{{t|{{u|[[in]]}}|\n{| class=x\n| y\n|}\n}}<ref>r [[cited]]</ref> <nowiki>"), F.col("text")]
    text = F.concat(*marks, F.lit("</nowiki>\n== "), F.col("lang"), F.lit(" ==\n[["), F.col("source"), F.lit("#top|''"), F.col("source"), F.lit("'']]"))
    pages = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), text.alias("text"))
    return parsed_pages(pages).select("page_id", "sec_i", "para_i", "text", F.array_join("targets", ";").alias("targets"))


# --- index and dump ---------------------------------------------------------

@query("""SELECT 'f' || (p_partkey % 3) AS file, (p_partkey // 100 * 1000)::BIGINT AS "offset", p_partkey AS page_id, p_name || ': ' || p_brand AS title,
(SELECT min(q.p_partkey // 100 * 1000) FROM part q WHERE q.p_partkey % 3 = part.p_partkey % 3 AND q.p_partkey // 100 > part.p_partkey // 100)::BIGINT AS "end" FROM part""")
def index_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index lines with the next distinct offset of their file; broken lines are skipped."""
    part = table(spark, sf_dir, "part")
    line = F.concat_ws(":", F.floor(F.col("p_partkey") / 100) * 1000, "p_partkey", F.concat("p_name", F.lit(": "), "p_brand"))
    lines = part.select(line.alias("value"), F.concat(F.lit("f"), F.col("p_partkey") % 3).alias("file"))
    broken = part.filter("p_partkey < 10").select(F.concat(F.lit("x:"), "p_name").alias("value"), F.lit("f0").alias("file"))
    return D.with_ends(D.parse_index(lines.unionByName(broken)))


@query("SELECT user_id, arg_max(event_id, ts) AS latest FROM events GROUP BY 1")
def latest_revision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's events as the revisions of a page: the last by time, the first of equals."""
    revisions = F.sort_array(F.collect_list(F.struct(F.col("event_id").alias("id"), F.col("ts").alias("timestamp"))))
    pages = table(spark, sf_dir, "events").groupBy("user_id").agg(revisions.alias("revision"))
    return pages.select("user_id", D.latest("revision")["id"].alias("latest"))


@query("SELECT DISTINCT p_size::VARCHAR AS ns FROM part UNION SELECT DISTINCT p_brand FROM part")
def namespaces(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part")
    return D.namespaces(part.select(F.col("p_size").cast("string").alias("ns")).union(part.select("p_brand")))


@query("SELECT o_custkey, count(*)::BIGINT AS n FROM orders GROUP BY 1 HAVING count(*) > 1")
def duplicate_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.repeated(table(spark, sf_dir, "orders"), "o_custkey")


@query("SELECT c_custkey AS o_custkey FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 300000")
def missing_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.missing(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey")), table(spark, sf_dir, "orders").filter("o_totalprice > 300000"), "o_custkey")


_INDEX = """SELECT 'f' || (p_partkey % 3) AS file, (p_partkey // 100 * 1000)::BIGINT AS "offset", p_partkey AS page_id, p_name || ': ' || p_brand AS title,
(SELECT min(q.p_partkey // 100 * 1000) FROM part q WHERE q.p_partkey % 3 = part.p_partkey % 3 AND q.p_partkey // 100 > part.p_partkey // 100)::BIGINT AS "end" FROM part"""


@query(f"SELECT * FROM ({_INDEX}) WHERE title IN (SELECT p_name || ': ' || p_brand FROM part WHERE p_size < 5) OR page_id IN (SELECT ps.p_partkey FROM part ps WHERE ps.p_size > 45)")
def index_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index entries whose title or page id is asked for, titles in another spelling of white space."""
    part = table(spark, sf_dir, "part")
    line = F.concat_ws(":", F.floor(F.col("p_partkey") / 100) * 1000, "p_partkey", F.concat("p_name", F.lit(": "), "p_brand"))
    index = D.parse_index(part.select(line.alias("value"), F.concat(F.lit("f"), F.col("p_partkey") % 3).alias("file")))
    titles = part.filter("p_size < 5").select(F.replace(F.concat("p_name", F.lit(": "), "p_brand"), F.lit(" "), F.lit("_")).alias("title"))
    return D.matched_entries(index, titles, part.filter("p_size > 45").select(F.col("p_partkey").alias("page_id"))).select("file", "offset", "page_id", "title", "end")


# --- pages to graph ---------------------------------------------------------

@query("""SELECT doc_id AS page_id, 1 AS sec_i, 1 AS para_i, (doc_id * 7 + 3) % (SELECT count(*) FROM documents) AS target FROM documents
UNION ALL SELECT doc_id, 1, 1, (doc_id * 3 + 1) % (SELECT count(*) FROM documents) FROM documents""")
def page_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.graph_of_pages(derived_pages(spark, sf_dir)).links


@query("SELECT doc_id AS page_id, doc_id - 1 AS target FROM documents WHERE doc_id % 50 = 49")
def page_redirects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.graph_of_pages(derived_pages(spark, sf_dir)).redirects


@query("SELECT doc_id AS page_id, 'Doc ' || doc_id AS title FROM documents")
def page_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return D.graph_of_pages(derived_pages(spark, sf_dir)).articles


@query("""SELECT 'article:8:s0' AS "nodeID", '{{Infobox a|{{b|' || lang || '}}|c}}' AS title FROM documents WHERE doc_id = 8 UNION ALL SELECT 'article:8:s1', source FROM documents WHERE doc_id = 8""")
def section_titles_of_headings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.section_titles(boxed_graph(spark, sf_dir), "Doc 8")


@query("""SELECT '{{Infobox a|{{b|' || lang || '}}|c}}' AS infobox FROM documents WHERE doc_id = 8 UNION ALL SELECT '{{Infobox d|' || source || '}}' FROM documents WHERE doc_id = 8""")
def article_infoboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.article_infoboxes(boxed_graph(spark, sf_dir), "Doc 8")


@query("""SELECT 'infobox' AS kind, NULL::VARCHAR AS "nodeID", '{{Infobox a|{{b|' || lang || '}}|c}}' AS text FROM documents WHERE doc_id = 8 UNION ALL SELECT 'infobox', NULL, '{{Infobox d|' || source || '}}' FROM documents WHERE doc_id = 8
UNION ALL SELECT 'section title', 'article:8:s1', source FROM documents WHERE doc_id = 8""")
def titles_beside_infoboxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return G.section_titles_and_infoboxes(boxed_graph(spark, sf_dir), "Doc 8")


@query("""SELECT 'article:' || page_id AS "nodeID", 'Article' AS label, title, '' AS text FROM articles UNION ALL SELECT sid, 'Section', '', '' FROM sections UNION ALL SELECT pid, 'Paragraph', '', text FROM paragraphs UNION ALL SELECT cid, 'Chunk', '', text FROM chunks""", graph_sql=True)
def node_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The nodes after they were written as import shards and read again."""
    folder = written_folder(spark)
    X_.write_nodes(G.nodes(derived_graph(spark, sf_dir)), folder, shard_rows=5000)
    return X_.read_shards(spark, folder, "nodes", X_.NODE_COLUMNS)


@query("SELECT pid AS start_id, 'article:' || target AS end_id, 'LINKS_TO' AS rel_type FROM links UNION ALL SELECT 'article:' || page_id, 'article:' || target, 'MENTIONS' FROM mentions", graph_sql=True)
def edge_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and mentions after they were written as import shards and read again."""
    folder = written_folder(spark)
    X_.write_edges(G.edges(derived_graph(spark, sf_dir), mentions=True).filter("rel_type in ('LINKS_TO', 'MENTIONS')"), folder, shard_rows=5000)
    return X_.read_shards(spark, folder, "edges", X_.EDGE_COLUMNS)


# --- vectors and titles -----------------------------------------------------

def _vector(spark: SparkSession, sf_dir: str, vec_id: int) -> list[float]:
    return table(spark, sf_dir, "embeddings").filter(F.col("vec_id") == vec_id).first()["embedding"]


_DOT = "list_reduce(list_transform(range(1, len(e.embedding) + 1), lambda i: e.embedding[i]::DOUBLE * {q}[i]::DOUBLE), lambda x, y: x + y)"
_SCORE = f"{_DOT.format(q='q.embedding')} / (sqrt({_DOT.format(q='e.embedding')}) * sqrt({_DOT.format(q='q.embedding').replace('e.embedding', 'q.embedding')}))"


@query(f"SELECT vec_id, round(s, 6) AS score FROM (SELECT e.vec_id, {_SCORE} AS s FROM embeddings e, (SELECT embedding FROM embeddings WHERE vec_id = 7) q ORDER BY s DESC, e.vec_id LIMIT 50)")
def vector_articles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.vector_topk(table(spark, sf_dir, "embeddings"), _vector(spark, sf_dir, 7), 50, "vec_id").select("vec_id", "score")


@query(f"""% first_chunks AS (SELECT c.cid, c.pid, e.embedding FROM chunks c JOIN embeddings e ON e.vec_id = (c.page_id * 7 + c.sec_i * 5 + c.para_i * 3 + c.chunk_i) % (SELECT count(*) FROM embeddings)),
best AS (SELECT e.cid, e.pid, {_SCORE} AS score FROM first_chunks e, (SELECT embedding FROM embeddings WHERE vec_id = 3) q ORDER BY score DESC, cid LIMIT 80),
one AS (SELECT * FROM best QUALIFY row_number() OVER (PARTITION BY pid ORDER BY score DESC, cid) = 1 ORDER BY score DESC, pid LIMIT 20)
SELECT pid AS "paragraph_nodeID", text, cid AS matched_chunk_id, round(score, 6) AS score FROM one JOIN paragraphs USING (pid)""", graph_sql=True)
def vector_paragraphs(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = derived_graph(spark, sf_dir)
    numbers = [F.col(c) for c in ("page_id", "sec_i", "para_i", "chunk_i")]
    vectors = table(spark, sf_dir, "embeddings")
    at = (F.col("page_id") * 7 + F.col("sec_i") * 5 + F.col("para_i") * 3 + F.col("chunk_i")) % vectors.count()
    rows = g.chunks().select(X.chunk_id(*numbers).alias("chunk_id"), X.paragraph_id(*numbers[:3]).alias("paragraph_id"), at.alias("vec_id")).join(vectors, "vec_id")
    return S.paragraph_topk(rows, g.paragraphs.select(X.paragraph_id(*numbers[:3]).alias("paragraph_id"), "text"), _vector(spark, sf_dir, 3), 20)


_indexes: dict[tuple[str, str], VectorIndex] = {}


def _index(spark: SparkSession, sf_dir: str) -> VectorIndex:
    """The index of all embeddings, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _indexes:
        _indexes[key] = build_index(table(spark, sf_dir, "embeddings"), written_folder(spark), "vec_id")
    return _indexes[key]


def _vector_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").filter("vec_id % 50 = 0").select(F.col("vec_id").alias("question"), F.col("embedding").alias("vector"))


@query()
def vector_index_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 nearest of every vector whose id is divisible by 50, from the lists and codes that the index's sample needed."""
    return _index(spark, sf_dir).search(_vector_questions(spark, sf_dir), 10)


@query(f"""SELECT question, rank::INTEGER AS rank, id, round(s, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY question ORDER BY s DESC, id) AS rank FROM (
SELECT q.vec_id AS question, e.vec_id AS id, {_SCORE} AS s FROM embeddings e, embeddings q WHERE q.vec_id % 50 = 0)) WHERE rank <= 10""")
def vector_index_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, but nothing is left out that could be among the nearest."""
    return _index(spark, sf_dir).search(_vector_questions(spark, sf_dir), 10, exact=True)


def _titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), F.concat_ws(" ", "p_name", "p_type", "p_size").alias("title"))


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The titles whose id is divisible by 50, each as it is, in capitals, with a word changed, and as no title, to be sought among all titles."""
    titles = _titles(spark, sf_dir).filter("page_id % 50 = 0")
    ways = F.array(F.col("title"), F.upper(F.replace(F.col("title"), F.lit(" "), F.lit("_"))), F.regexp_replace("title", r"^(\w+) \w+", "$1 thing"), F.concat(F.lit("zzz"), F.col("page_id")))
    return titles.select(F.explode(ways).alias("query"))


_TITLES = "titles AS (SELECT p_partkey AS page_id, p_name || ' ' || p_type || ' ' || p_size AS title FROM part)"


@query(f"WITH {_TITLES} SELECT t.title AS query, min(u.page_id) AS page_id FROM titles t JOIN titles u ON u.title = t.title WHERE t.page_id % 50 = 0 GROUP BY 1")
def title_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.equal_titles(_asked(spark, sf_dir), _titles(spark, sf_dir)).filter("step = 1").select("query", "page_id")


@query(f"WITH {_TITLES} SELECT upper(replace(t.title, ' ', '_')) AS query, min(u.page_id) AS page_id FROM titles t JOIN titles u ON lower(u.title) = lower(t.title) WHERE t.page_id % 50 = 0 GROUP BY 1")
def title_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.equal_titles(_asked(spark, sf_dir), _titles(spark, sf_dir)).filter("step = 2").select("query", "page_id")


_BM25 = f"""WITH {_TITLES}, words AS (SELECT page_id, unnest(list_filter(regexp_split_to_array(lower(title), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> '')) AS term FROM titles),
postings AS (SELECT page_id, term, count(*) AS tf FROM words GROUP BY 1, 2), lens AS (SELECT page_id, count(*) AS len FROM words GROUP BY 1), dfs AS (SELECT term, count(*) AS df FROM postings GROUP BY 1),
tot AS (SELECT (SELECT count(*) FROM titles) AS n, (SELECT sum(len) FROM lens) AS s),
asked AS (SELECT DISTINCT p_type AS query FROM part), q AS (SELECT query, unnest(list_distinct(list_filter(regexp_split_to_array(lower(query), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''))) AS term FROM asked),
scored AS (SELECT query, page_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / (s / n))))), 6) AS score FROM q JOIN dfs USING (term) JOIN postings USING (term) JOIN lens USING (page_id), tot GROUP BY 1, 2)
SELECT query, page_id, score FROM scored QUALIFY row_number() OVER (PARTITION BY query ORDER BY score DESC, page_id) <= 20"""


@query(_BM25)
def title_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    asked = table(spark, sf_dir, "part").select(F.col("p_type").alias("query")).distinct()
    return S.bm25(asked, _titles(spark, sf_dir), 20).select("query", "page_id", "score")


_text_indexes: dict[tuple[str, str, str], TextIndex] = {}


def _text_index(spark: SparkSession, sf_dir: str, tokens: Callable) -> TextIndex:
    """The index of all titles, built once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir, tokens.__name__)
    if key not in _text_indexes:
        _text_indexes[key] = build_text_index(_titles(spark, sf_dir), written_folder(spark), tokens)
    return _text_indexes[key]


@query(_BM25)
def title_index_bm25(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same from the stored index, which leaves out postings that cannot matter."""
    asked = table(spark, sf_dir, "part").select(F.col("p_type").alias("query")).distinct()
    return _text_index(spark, sf_dir, S.tokens).search(asked, 20).select("query", "page_id", "score")


@query()
def title_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates from the stored index of English stems."""
    return S.match_titles(_asked(spark, sf_dir), _titles(spark, sf_dir), index=_text_index(spark, sf_dir, english_words))


# --- evaluation records -----------------------------------------------------

def _questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First user turns as questions, numbered without gaps, with three sources each."""
    turns = table(spark, sf_dir, "conversations").filter("turn = 0")
    source = lambda k: F.struct(F.format_string("%d", F.col("conv_id") * k).alias("page_id"), F.format_string("T%d", (F.col("conv_id") * k) % 50).alias("title"))
    return turns.select("conv_id", F.col("conv_id").alias("ex_num"), F.col("text").alias("question"), F.array(source(1), source(3), source(7)).alias("sources"))


@query("SELECT conv_id, (conv_id // 32)::INTEGER AS batch FROM conversations WHERE turn = 0")
def batches_32(spark: SparkSession, sf_dir: str) -> DataFrame:
    return E.batches(_questions(spark, sf_dir), order="conv_id").select("conv_id", "batch")


@query("SELECT conv_id FROM conversations WHERE turn = 0 AND (conv_id % 50) NOT IN (4, 11) AND (conv_id * 3 % 50) NOT IN (4, 11) AND (conv_id * 7 % 50) NOT IN (4, 11)")
def question_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    decisions = spark.createDataFrame([("a", "T4", "False"), ("b", "T11", "False"), ("c", "T5", "True")], "original string, matched string, accept string")
    return E.accepted_questions(_questions(spark, sf_dir), decisions).select("conv_id")


@query("""WITH q AS (SELECT conv_id, (conv_id % 50) NOT IN (4, 11) AND (conv_id * 3 % 50) NOT IN (4, 11) AND (conv_id * 7 % 50) NOT IN (4, 11) AS ok FROM conversations WHERE turn = 0)
SELECT count(*)::BIGINT AS questions_before, (count(*) * 3)::BIGINT AS sources_before, count(*) FILTER (ok)::BIGINT AS questions_after, (count(*) FILTER (ok) * 3)::BIGINT AS sources_after FROM q""")
def removal_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    questions = _questions(spark, sf_dir)
    decisions = spark.createDataFrame([("a", "T4", "False"), ("b", "T11", "False")], "original string, matched string, accept string")
    return E.removal_totals(questions, E.accepted_questions(questions, decisions))


@query("SELECT conv_id AS ex_num, text AS question FROM conversations WHERE turn = 0")
def release_questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches = _questions(spark, sf_dir).select("ex_num", "question", F.col("conv_id").alias("pos"))
    release = matches.select("ex_num", "question", F.array(F.lit("step")).alias("decomposition"), F.parse_json(F.lit("[1, true]")).alias("validated_answer"))
    return E.release_questions(matches, release).select("ex_num", "question")


@query("""SELECT conv_id AS ex_num, text AS query, CASE WHEN conv_id % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM conversations WHERE turn = 0""")
def merge_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failed rows of a run replaced by those of a second one."""
    rows = _questions(spark, sf_dir).select("ex_num", F.col("question").alias("query"), F.lit("{}").alias("agent_settings"))
    again = F.col("ex_num") % 5 == 0
    first = rows.withColumn("score", F.when(~again, 0.5))
    return E.merge_runs(first, rows.filter(again).withColumn("score", F.lit(1.0)), ["score"]).select("ex_num", "query", "score")


@query("SELECT conv_id AS ex_num, role AS tool, count(*)::BIGINT AS calls, sum(turn)::BIGINT AS tokens FROM conversations GROUP BY 1, 2")
def token_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    message = F.to_json(F.collect_list(F.struct(F.col("role").alias("name"), F.struct(F.col("turn").alias("total_tokens")).alias("usage"))))
    return E.token_usage(turns.groupBy(F.col("conv_id").alias("ex_num")).agg(message.alias("messages")))


@query("SELECT p_name AS original, p_brand AS matched, max(p_retailprice) AS score, 'True' AS accept, count(DISTINCT p_size % 3)::BIGINT AS n_files FROM part GROUP BY 1, 2")
def replay_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("original"), F.col("p_brand").alias("matched"), F.col("p_retailprice").alias("score"), (F.col("p_size") % 3).alias("file"), "p_partkey")
    decisions = part.select("original", "matched", F.lit("True").alias("accept"))
    return E.replay_decisions(part, decisions).select("original", "matched", "score", "accept", F.size("files").cast("long").alias("n_files"))


@query("SELECT event_type AS tag, count(*) FILTER (value > 5) / count(*) * 100 AS percentage FROM events GROUP BY 1")
def answerable_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").groupBy(F.col("event_type").alias("tag")).agg(F.count_if(F.col("value") > 5).alias("answerable"), F.count("*").alias("total"))
    return E.answerable_share(rows)


def _token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, n_tokens of all whole texts, by a public tokenizer whose file is on every node."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return X_.token_counts(table(spark, sf_dir, "documents").select("doc_id", "lang", "text"), X_.file_encoder(path)).drop("text")


@query()
def token_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every language's texts, whole and in short form."""
    by_lang = _token_counts(spark, sf_dir).groupBy("lang").agg(F.count("*").alias("texts"), F.sum("n_tokens").alias("tokens"))
    return by_lang.select("lang", "texts", "tokens", X.short_count(F.col("tokens")).alias("short"))


@query()
def token_estimate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus's tokens estimated from those of every other text, as a sampling estimate."""
    return E.scaled_tokens(table(spark, sf_dir, "documents"), _token_counts(spark, sf_dir).filter("doc_id % 2 = 0"))


@query("SELECT date_trunc('minute', ts)::TIMESTAMP AS minute, event_type AS event, count(*)::BIGINT AS n FROM events GROUP BY 1, 2")
def turns_by_minute(spark: SparkSession, sf_dir: str) -> DataFrame:
    from graphleaf.streaming.turns import events_by_minute

    rows = table(spark, sf_dir, "events").select(F.col("ts").alias("logged_at"), F.col("event_type").alias("event"))
    return events_by_minute(rows)


@query("SELECT conv_id AS ex_num, text AS query, CASE WHEN conv_id % 5 = 0 THEN 1.0 ELSE 0.5 END::DOUBLE AS score FROM conversations WHERE turn = 0 AND conv_id % 7 <> 3")
def merge_successes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As ``merge_runs``, rows whose judging failed left out; the runs agree in settings and models."""
    rows = _questions(spark, sf_dir).select("ex_num", F.col("question").alias("query"), F.lit("{}").alias("agent_settings"), F.lit("m").alias("models"), (F.col("ex_num") % 7 != 3).alias("success"))
    again = F.col("ex_num") % 5 == 0
    first = rows.withColumn("score", F.when(~again, 0.5))
    return E.merge_runs(first, rows.filter(again).withColumn("score", F.lit(1.0)), ["score"], success_only=True).select("ex_num", "query", "score")


@query("SELECT p_name AS original, p_brand AS matched, p_retailprice AS score, CASE WHEN length(p_name) % 2 = 0 THEN 'True' ELSE 'False' END AS accept FROM part")
def decided_corrections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row of the correction files with its decision."""
    part = table(spark, sf_dir, "part").select(F.col("p_name").alias("original"), F.col("p_brand").alias("matched"), F.col("p_retailprice").alias("score"))
    decisions = part.select("original", "matched", F.when(F.length("original") % 2 == 0, "True").otherwise("False").alias("accept")).distinct()
    return E.decided_rows(part, decisions)


_SPOKEN = "'[' || coalesce(string_agg({}, ',' ORDER BY turn) FILTER (role = 'assistant'), '') || ']'"
_USAGE, _CALL = "'{\"total_tokens\":' || turn || '}'", "'{\"type\":\"function_call\",\"name\":\"t' || turn || '\"}'"


@query(f"SELECT conv_id AS ex_num, {_SPOKEN.format(_USAGE)} AS token_usage, {_SPOKEN.format(_CALL)} AS function_calls, '[]' AS agent_reasoning, max('model') FILTER (role = 'assistant') AS model FROM conversations GROUP BY 1")
def agent_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as agent logs: what each assistant turn used and called."""
    call = F.array(F.struct(F.lit("function_call").alias("type"), F.concat(F.lit("t"), F.col("turn")).alias("name")))
    message = F.struct("turn", F.when(F.col("role") == "assistant", "ai").otherwise("human").alias("type"), call.alias("content"), F.struct(F.col("turn").alias("total_tokens")).alias("usage_metadata"), F.struct(F.lit("model").alias("model_name")).alias("response_metadata"))
    runs = table(spark, sf_dir, "conversations").groupBy(F.col("conv_id").alias("ex_num")).agg(F.to_json(F.sort_array(F.collect_list(message))).alias("messages"))
    return E.agent_records(runs).drop("messages")


def _traces(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Every part's title as a question with a link to it and a link to no page."""
    titles = _titles(spark, sf_dir)
    link = lambda c: F.concat(F.lit("https://x.org/wiki/"), F.replace(c, F.lit(" "), F.lit("%20")))
    url = F.concat(link(F.col("title")), F.lit("\n"), link(F.concat(F.lit("zzz"), F.col("page_id"))))
    return S.process_traces(titles.select(F.col("page_id").alias("ex_num"), F.concat(F.lit("q "), F.col("page_id")).alias("question"), url.alias("source_url")), titles)


@query(f"WITH {_TITLES} SELECT page_id AS ex_num, 'q ' || page_id AS question, (SELECT min(u.page_id) FROM titles u WHERE u.title = t.title)::VARCHAR AS source, title FROM titles t")
def trace_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    matches, _, _ = _traces(spark, sf_dir)
    return matches.select("ex_num", "question", F.explode("sources").alias("s")).select("ex_num", "question", F.col("s.page_id").alias("source"), F.col("s.title").alias("title"))


@query("SELECT p_partkey AS ex_num, 'zzz' || p_partkey AS title FROM part")
def trace_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _traces(spark, sf_dir)[2]


@query("SELECT count(*)::BIGINT AS results, count(*)::BIGINT AS sources, 0::BIGINT AS corrections, count(*)::BIGINT AS unmatched FROM part")
def trace_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return S.trace_counts(*_traces(spark, sf_dir))
