"""Every registered query with adaptive execution off gives the rows that it gives with it on."""

import pytest

from graphleaf.plans import queries as graph_queries


@pytest.mark.parametrize("name", ["titles_beside_infoboxes", "section_titles_and_infoboxes", "article_infoboxes", "section_titles", "article_text", "backlinks", "window_sections", "batches_32"])
def test_same_rows(spark, sf, name):
    """These order rows or place them; the rest of the queries are compared by ``test_all_queries``."""
    whole = graph_queries.QUERIES[name](spark, sf).collect()
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        assert sorted(map(str, graph_queries.QUERIES[name](spark, sf).collect())) == sorted(map(str, whole))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_all_queries_run(spark, sf):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        for query in graph_queries.QUERIES.values():
            query(spark, sf).write.format("noop").mode("overwrite").save()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
