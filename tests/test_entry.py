import duckdb
import pytest

import __spark_entry__ as entry
from graphleaf.plans import queries as graph_queries


def test_entry(spark):
    assert entry.entry(spark).count() > 0


@pytest.mark.parametrize("name", sorted(graph_queries.QUERIES))
def test_query_matches_its_sql(spark, sf, tmp_path, name):
    out = graph_queries.QUERIES[name](spark, sf)
    out.write.parquet(str(tmp_path / "out"))
    if name not in graph_queries.ORACLES:
        assert spark.read.parquet(str(tmp_path / "out")).columns
        return
    c = duckdb.connect()
    for t in ("part", "orders", "events", "documents", "embeddings", "conversations", "labels", "benchmark", "customer"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    c.execute(f"create table expected as {graph_queries.ORACLES[name]}")
    c.execute(f"create table got as select * from read_parquet('{tmp_path}/out/*.parquet')")
    columns = sorted(r[0] for r in c.execute("describe expected").fetchall())
    assert columns == sorted(r[0] for r in c.execute("describe got").fetchall())
    names = ", ".join(f'"{n}"' for n in columns)
    for a, b in (("expected", "got"), ("got", "expected")):
        assert c.execute(f"select {names} from {a} except all select {names} from {b}").fetchall() == []
