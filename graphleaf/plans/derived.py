"""The derived graph: ``documents`` read as articles, so that graph queries have data and SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.operators.graph import Graph
from graphleaf.operators.layout import save_graph
from graphleaf.tables import written_folder

PARAGRAPHS_IN_SECTION = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def derived_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Lines that are not blank are paragraphs, four to a section; every paragraph links by arithmetic to another article.

    A document's lines are numbered inside its row, without a shuffle."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    n = docs.count()
    lines = F.filter(F.transform(F.split("text", "\n"), lambda t, i: F.struct(i.alias("li"), t.alias("text"))), lambda s: F.trim(s["text"]) != "")
    rows = docs.select(F.col("doc_id").alias("page_id"), F.posexplode(lines).alias("pi", "line"))
    paragraphs = rows.select("page_id", F.floor(F.col("pi") / PARAGRAPHS_IN_SECTION).cast("int").alias("sec_i"), (F.col("pi") % PARAGRAPHS_IN_SECTION).alias("para_i"), F.col("line.text").alias("text"), F.col("line.li").alias("li"))
    sections = docs.select(F.col("doc_id").alias("page_id"), F.size(lines).alias("n")).filter("n > 0").select("page_id", F.explode(F.sequence(F.lit(0), F.floor((F.col("n") - 1) / PARAGRAPHS_IN_SECTION).cast("int"))).alias("sec_i"))
    return Graph(
        articles=docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("Doc "), F.col("doc_id")).alias("title")), sections=sections, paragraphs=paragraphs.drop("li"),
        links=paragraphs.select("page_id", "sec_i", "para_i", ((F.col("page_id") * 7 + F.col("li") * 13 + 3) % n).alias("target")),
        redirects=docs.filter("doc_id % 50 = 49").select(F.col("doc_id").alias("page_id"), (F.col("doc_id") - 1).alias("target")),
    )


_stored: dict[tuple[str, str], Graph] = {}


def stored_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph with its mentions and redirect ends as tables, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _stored:
        _stored[key] = derived_graph(spark, sf_dir).stored()
    return _stored[key]


_kept: dict[tuple[str, str], Graph] = {}


def kept_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The derived graph in bucketed tables, written once in a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _kept:
        _kept[key] = save_graph(derived_graph(spark, sf_dir), written_folder(spark))
    return _kept[key]


def boxed_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """Every document as an article of two sections: an infobox that holds a template and a lead; a heading line with the whole text, and a second infobox."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), "text", "lang", "source")
    paragraph = lambda s, p, text: F.struct(F.lit(s).alias("sec_i"), F.lit(p).alias("para_i"), text.alias("text"))
    parts = F.array(
        paragraph(0, 0, F.concat(F.lit("{{Infobox a|{{b|"), F.col("lang"), F.lit("}}|c}}"))), paragraph(0, 1, F.col("lang")),
        paragraph(1, 0, F.concat(F.lit("== "), F.col("source"), F.lit(" ==\n"), F.col("text"))), paragraph(1, 1, F.concat(F.lit("{{Infobox d|"), F.col("source"), F.lit("}} tail"))),
    )
    paragraphs = docs.select("page_id", F.explode(parts).alias("p")).select("page_id", "p.*")
    none = docs.filter("false").select("page_id", F.col("page_id").alias("target"))
    return Graph(
        articles=docs.select("page_id", F.concat(F.lit("Doc "), F.col("page_id")).alias("title")), sections=paragraphs.select("page_id", "sec_i").distinct(), paragraphs=paragraphs,
        links=none.select("page_id", F.lit(0).alias("sec_i"), F.lit(0).alias("para_i"), "target"), redirects=none,
    )


def derived_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages of wikitext: every document with links by title, by a title in other white space and to no page; every 50th redirects to the one before it."""
    docs = table(spark, sf_dir, "documents")
    n = docs.count()
    text = F.concat(F.col("text"), F.lit("\n\n== links ==\n\nsee [[Doc "), (F.col("doc_id") * 7 + 3) % n, F.lit("|this]] and [[Doc_"), (F.col("doc_id") * 3 + 1) % n, F.lit("#top]] and [[No page]]"))
    redirect = F.when(F.col("doc_id") % 50 == 49, F.concat(F.lit("Doc_"), F.col("doc_id") - 1))
    return docs.select(F.col("doc_id").alias("page_id"), F.concat(F.lit("Doc_"), F.col("doc_id")).alias("title"), redirect.alias("redirect"), text.alias("text"))


#: The same tables for DuckDB.
SQL = """
lines AS (SELECT doc_id, i - 1 AS li, parts[i] AS text FROM (SELECT doc_id, string_split(text, chr(10)) AS parts FROM documents), LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i) WHERE trim(parts[i], ' ') <> ''),
numbered AS (SELECT doc_id AS page_id, li, text, row_number() OVER (PARTITION BY doc_id ORDER BY li) - 1 AS pi FROM lines),
paragraphs AS (SELECT page_id, li, (pi // 4)::INTEGER AS sec_i, (pi % 4)::INTEGER AS para_i, text, 'article:' || page_id || ':s' || (pi // 4) || ':p' || (pi % 4) AS pid FROM numbered),
sections AS (SELECT DISTINCT page_id, sec_i, 'article:' || page_id || ':s' || sec_i AS sid FROM paragraphs),
articles AS (SELECT doc_id AS page_id, 'Doc ' || doc_id AS title FROM documents),
links AS (SELECT page_id, sec_i, para_i, pid, text, (page_id * 7 + li * 13 + 3) % (SELECT count(*) FROM documents) AS target FROM paragraphs),
redirects AS (SELECT doc_id AS page_id, doc_id - 1 AS target FROM documents WHERE doc_id % 50 = 49),
chunks AS (SELECT *, pid || ':c' || chunk_i AS cid, substr(full_text, chunk_i * 460 + 1, 500) AS text FROM (SELECT page_id, sec_i, para_i, pid, text AS full_text, unnest(range(0, CASE WHEN length(text) <= 500 THEN 1 ELSE 1 + ceil((length(text) - 500) / 460.0)::INTEGER END))::INTEGER AS chunk_i FROM paragraphs)),
mentions AS (SELECT DISTINCT page_id, target FROM links)
"""
