"""A graph in bucketed tables: the same answers, and few files and rows read."""

from pyspark.sql import functions as F
from test_vector_index import _metrics

from graphleaf.operators import graph as G
from graphleaf.operators.layout import _name, open_graph, save_graph
from graphleaf.plans.derived import derived_graph


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_reads_are_pruned_and_equal(spark, tmp_path):
    plain = derived_graph(spark, "/root/testdata/sf0.01")
    folder = str(tmp_path / "graph")
    kept = save_graph(plain, folder, buckets=16)
    for title in ("Doc 6", "Doc 49", "nobody"):
        assert rows(G.article_text(kept, title)) == rows(G.article_text(plain, title)) and rows(G.backlinks(kept, title)) == rows(G.backlinks(plain, title))
        assert rows(G.section_titles(kept, title)) == rows(G.section_titles(plain, title))
    assert rows(G.within_distance(kept, "Doc 1", 2)) == rows(G.within_distance(plain, "Doc 1", 2))
    assert rows(G.shortest_path(kept, "Doc 1", "Doc 77")) == rows(G.shortest_path(plain, "Doc 1", "Doc 77"))
    by_title = kept.titles.filter(F.col("title") == "Doc 6")
    own = kept.paragraphs.filter("page_id = 6")
    into = kept.links_in.filter("target = 6")
    for read, table in ((by_title, kept.titles), (own, kept.paragraphs), (into, kept.links_in)):
        read.collect()
        assert 0 < max(m.value() for m in _metrics(read, "numOutputRows")) <= table.count() / 8  # what the scan gives, of one bucket of 16


def test_another_session_opens_the_folder(spark, tmp_path):
    folder = str(tmp_path / "graph")
    kept = save_graph(derived_graph(spark, "/root/testdata/sf0.001"), folder)
    expected = rows(G.article_text(kept, "Doc 6"))
    for table in ("titles", "articles", "sections", "paragraphs", "links", "links_in", "redirects", "mentions", "terminals"):
        spark.sql(f"DROP TABLE {_name(folder, table)}")  # a new session does not know them
    again = open_graph(spark, folder)
    assert expected and rows(G.article_text(again, "Doc 6")) == expected
    own = again.paragraphs.filter("page_id = 6")
    own.collect()
    assert max(m.value() for m in _metrics(own, "numOutputRows")) <= again.paragraphs.count() / 4


def test_backlinks_leave_paragraphs_where_they_are(spark, tmp_path):
    """Where nothing is broadcast, as in large graphs, only the paragraphs of linking pages are dealt anew."""
    kept = save_graph(derived_graph(spark, "/root/testdata/sf0.01"), str(tmp_path / "graph"))
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        found = G.backlinks(kept, "Doc 6")
        assert rows(found)
        assert 0 < sum(m.value() for m in _metrics(found, "shuffleRecordsWritten")) < kept.paragraphs.count() / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
