"""A graph kept in tables that single reads can prune.

Articles are bucketed by title for look-ups and by page for joins, paragraphs, sections, links, redirects and mentions by
page, links once more by target: Spark reads the one bucket that an equal key can be in, and of its
row groups, sorted by the key, those whose range or bloom filter has it. The files are all that a
later session needs; their tables are declared again when it opens the folder.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.operators.graph import Graph

#: Rows that a bucket of the paragraphs shall have, and bytes of a row group.
BUCKET_ROWS, ROW_GROUP = 500_000, 4 << 20
#: Each table's columns, with its key and what its rows are sorted by after it.
TABLES = {
    "titles": ("page_id long, title string", "title", ["page_id"]),
    "articles": ("page_id long, title string", "page_id", ["title"]),
    "sections": ("page_id long, sec_i int", "page_id", ["sec_i"]),
    "paragraphs": ("page_id long, sec_i int, para_i int, text string", "page_id", ["sec_i", "para_i"]),
    "links": ("page_id long, sec_i int, para_i int, target long", "page_id", ["sec_i", "para_i"]),
    "links_in": ("page_id long, sec_i int, para_i int, target long", "target", ["page_id"]),
    "redirects": ("page_id long, target long", "page_id", ["target"]),
    "mentions": ("page_id long, target long", "page_id", ["target"]),
    "terminals": ("page_id long, terminal long", "page_id", []),
}


def _name(folder: str, table: str) -> str:
    return f"graph_{hashlib.sha256(folder.encode()).hexdigest()[:16]}_{table}"


def save_graph(graph: Graph, folder: str, buckets: int | None = None) -> Graph:
    """Write ``graph`` with its mentions and ends of redirects into ``folder``, a new one, and open it."""
    spark = graph.articles.sparkSession
    buckets = buckets or max(8, -(-graph.paragraphs.count() // BUCKET_ROWS))
    frames = {
        "titles": graph.articles, "articles": graph.articles, "sections": graph.sections, "paragraphs": graph.paragraphs, "links": graph.links, "links_in": graph.links,
        "redirects": graph.redirects, "mentions": graph.mentions(), "terminals": graph.terminals(),
    }
    for name, (columns, key, order) in TABLES.items():
        kinds = dict(c.split(" ") for c in columns.split(", "))
        rows = frames[name].select(*[F.col(c).cast(t).alias(c) for c, t in kinds.items()])
        spark.sql(f"DROP TABLE IF EXISTS {_name(folder, name)}")
        # rows are dealt as buckets are, so that each task writes the file of one
        writer = rows.repartition(buckets, key).write.bucketBy(buckets, key).sortBy(key, *order).option("path", f"{folder}/{name}").option("parquet.block.size", str(ROW_GROUP)).option(f"parquet.bloom.filter.enabled#{key}", "true")
        writer.format("parquet").saveAsTable(_name(folder, name))
    spark.createDataFrame([(buckets,)], "buckets int").coalesce(1).write.parquet(f"{folder}/buckets")
    return open_graph(spark, folder, graph.chunk_size, graph.chunk_overlap)


def open_graph(spark: SparkSession, folder: str, chunk_size: int | None = None, chunk_overlap: int | None = None) -> Graph:
    """The graph that ``save_graph`` wrote into ``folder``, in this session or another."""
    buckets = spark.read.parquet(f"{folder}/buckets").first()["buckets"]

    def opened(table: str) -> DataFrame:
        columns, key, order = TABLES[table]
        name = _name(folder, table)
        spark.sql(f"CREATE TABLE IF NOT EXISTS {name} ({columns}) USING parquet CLUSTERED BY ({key}) SORTED BY ({', '.join([key, *order])}) INTO {buckets} BUCKETS LOCATION '{folder}/{table}'")
        return spark.table(name)

    sizes = {k: v for k, v in (("chunk_size", chunk_size), ("chunk_overlap", chunk_overlap)) if v is not None}
    return Graph(
        opened("articles"), opened("sections"), opened("paragraphs"), opened("links"), opened("redirects"), mention_table=opened("mentions"), terminal_table=opened("terminals"),
        titles=opened("titles"), links_in=opened("links_in"), **sizes,
    )
