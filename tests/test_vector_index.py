"""The stored vector index against whole scans, and the tools and command that use it."""

import json
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphleaf.commands import main
from graphleaf.operators import search as S
from graphleaf.operators.graph import Graph
from graphleaf.operators.vector_index import build_index, open_index
from graphleaf.plans import queries as Q
from graphleaf.sources import exports as K
from graphleaf.tools import Tools


def answers(df):
    out = {}
    for r in df.collect():
        out.setdefault(r["question"], {})[r["rank"]] = (r["id"], r["score"])
    assert all(sorted(a) == list(range(1, len(a) + 1)) for a in out.values())
    return {q: [a[n] for n in sorted(a)] for q, a in out.items()}


def scans(rows, questions, k, width, digits=6):
    """The same by a scan, for each question."""
    def cosine(a, b):
        return sum(x * y for x, y in zip(a, b, strict=True)) / (math.sqrt(sum(x * x for x in a)) * math.sqrt(sum(x * x for x in b)))
    whole = lambda v: v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v) and any(v)
    use = {(i, tuple(v)) for i, v in rows if i is not None and whole(v)}
    return {q: [(i, round(s, digits)) for s, i in sorted(((cosine(v, x), i) for i, x in use), key=lambda p: (-p[0], p[1]))[:k]] for q, v in questions if whole(v)}


def test_recall_on_all_questions(spark):
    near, exact = (answers(Q.QUERIES[f"vector_index_{n}"](spark, "/root/testdata/sf0.1")) for n in ("near", "exact"))
    assert len(exact) == 40 and all(len(a) == 10 for a in exact.values())
    assert np.mean([len({i for i, _ in near[q]} & {i for i, _ in a}) / 10 for q, a in exact.items()]) >= 0.95
    rows = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    vector = rows.filter("vec_id = 50").first()["embedding"]
    assert exact[50] == [tuple(r) for r in S.vector_topk(rows, vector, 10, "vec_id").select("vec_id", "score").collect()]


@pytest.mark.parametrize("kind", ["long", "string"])
def test_hard_rows(spark, tmp_path, kind):
    rng = np.random.default_rng(3)
    clustered = rng.normal(0, 1, (12, 6))[rng.integers(0, 12, 900)] + rng.normal(0, 0.2, (900, 6))
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(clustered)]
    rows += [(2000 + i, rows[5][1]) for i in range(300)] + [(7, rows[7][1])] * 3 + [(None, rows[1][1]), (3000, None), (3001, [0.0] * 6), (3002, [1.0]), (3003, [1.0, None] * 3), (3004, [float("nan")] * 6)]
    if kind == "string":
        rows = [(None if i is None else f"n{i:05}", v) for i, v in rows]
    index = build_index(spark.createDataFrame(rows, f"id {kind}, embedding array<double>"), str(tmp_path), "id", lists=20)
    questions = [(q, rows[q][1]) for q in (0, 5, 100, 700)] + [(1, [1.0, 0.0, 0.0, 0.0, 0.0, 1.0]), (2, None), (3, [0.0] * 6), (4, [1.0])]
    asked = spark.createDataFrame([*questions, (None, rows[0][1]), questions[0]], "question long, vector array<double>")
    expected = scans(rows, questions, 8, 6)
    for one in (index, open_index(spark, str(tmp_path))):
        got = answers(one.search(asked, 8, exact=True))
        assert got.keys() == expected.keys()
        for q, a in expected.items():  # copies have equal scores but for the last digits
            assert [s for _, s in got[q]] == [s for _, s in a]
        near = answers(one.search(asked, 8))
        assert np.mean([[s for _, s in near[q]] == [s for _, s in a] for q, a in expected.items()]) >= 0.8
    assert answers(index.search(asked, 5000, exact=True))[0] == scans(rows, questions[:1], 5000, 6)[0]


def test_a_question_reads_few_lists(spark, tmp_path):
    rng = np.random.default_rng(1)
    centres = rng.normal(0, 1, (30, 16))
    rows = [(i, [float(x) for x in centres[i % 30] + rng.normal(0, 0.05, 16)]) for i in range(3000)]
    index = build_index(spark.createDataFrame(rows, "id long, embedding array<float>"), str(tmp_path), "id", lists=30)
    assert index.probes <= 3
    asked = spark.createDataFrame([(0, rows[0][1])], "question long, vector array<float>")
    found = index.search(asked, 10)
    assert {i % 30 for i, _ in answers(found)[0]} == {0}
    listed = index.short_list(spark, *_asked_lists(index, rows[0][1]), np.full(1, -np.inf), 40)
    listed.collect()
    text = listed._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [list" in text and "embedding" not in text
    assert sum(m.value() for m in _metrics(listed, "numFiles")) <= index.probes


def test_blocks_list_once_and_broadcast_no_vectors(spark, tmp_path, monkeypatch):
    from graphleaf.operators import vector_index as V

    monkeypatch.setattr(V, "BLOCK", 64)
    rng = np.random.default_rng(2)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (300, 4)))]
    index = build_index(spark.createDataFrame(rows, "id long, embedding array<double>"), str(tmp_path), "id", lists=6)
    assert index.rows(spark) is index.rows(spark)
    found = index.search(spark.createDataFrame(rows[:200], "question long, vector array<double>"), 5, exact=True)
    assert answers(found).keys() == set(range(200))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [list" in plan and "BroadcastHashJoin [list" not in plan
    again = build_index(spark.createDataFrame(rows[:9], "id long, embedding array<double>"), str(tmp_path), "id", lists=2)
    assert again.rows(spark).count() == 9


def test_exact_moves_answers_not_pairs(spark, tmp_path, monkeypatch):
    from graphleaf.operators import vector_index as V

    for name, value in (("ASKED", 16 * 64), ("HELD", 50), ("TILE", 32)):  # several passes, cut often
        monkeypatch.setattr(V, name, value, raising=False)
    rng = np.random.default_rng(4)
    rows = [(i, [float(x) for x in v]) for i, v in enumerate(rng.normal(0, 1, (1500, 16)))]
    rows += [(3000 - i, rows[0][1]) for i in range(40)] + [(9, rows[9][1])] * 40 + [(9, [2 * x for x in rows[9][1]])]
    index = build_index(spark.createDataFrame(rows, "id long, embedding array<double>"), str(tmp_path), "id", lists=20)
    moved, write = [], V.written

    def written(df):
        df.collect()
        moved.extend(m.value() for m in _metrics(df, "shuffleRecordsWritten"))
        return write(df)

    monkeypatch.setattr(V, "written", written)
    found = index.search(spark.createDataFrame(rows[:200], "question long, vector array<double>"), 5, exact=True, digits=12)
    got, expected = answers(found), scans(rows, rows[:200], 5, 16, digits=12)
    for q in expected:  # one row for equal scores of an id
        assert [s for _, s in got[q]] == [s for _, s in _once(rows, rows[q], 5)] if q == 9 else got[q] == expected[q]
    moved += [m.value() for m in _metrics(found, "shuffleRecordsWritten")]
    assert sum(moved) < 1500 * 200 / 5, moved


def _once(rows, question, k):
    every = scans(rows, [question], len(rows), len(question[1]), digits=12)[question[0]]
    return list(dict.fromkeys(every))[:k]


def _metrics(df, name):
    """The metrics of that name of the plan that ran, of its adaptive stages too."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        plan = todo.pop()
        kind = plan.getClass().getSimpleName()
        if kind == "AdaptiveSparkPlanExec":
            todo.append(plan.executedPlan())
        elif kind.endswith("QueryStageExec"):
            todo.append(plan.plan())
        else:
            metric = plan.metrics().get(name)
            found += [metric.get()] if metric.isDefined() else []
            todo += [plan.children().apply(i) for i in range(plan.children().size())]
    return found


def _asked_lists(index, vector):
    x = np.array([vector], np.float32)
    x /= np.linalg.norm(x)
    near = x @ index.quantiser.lists.T
    return x, near >= np.partition(near, -index.probes, 1)[:, -index.probes, None]


def test_nothing_to_index(spark, tmp_path):
    index = build_index(spark.createDataFrame([(1, None), (2, [0.0])], "id long, embedding array<float>"), str(tmp_path), "id")
    asked = spark.createDataFrame([(0, [1.0])], "question long, vector array<float>")
    assert index.search(asked, 5).collect() == [] == index.search(asked, 5, exact=True).collect() == index.search(asked.limit(0), 5).collect()


def test_tools_and_command(spark, tmp_path, capsys):
    vector = lambda i: [math.cos(i), math.sin(i), 0.3]
    g = Graph(
        articles=spark.createDataFrame([(i, f"A{i}") for i in range(6)], "page_id long, title string"), sections=spark.createDataFrame([(i, 0) for i in range(6)], "page_id long, sec_i int"),
        paragraphs=spark.createDataFrame([(i, 0, p, f"text {i} {p}") for i in range(6) for p in range(2)], "page_id long, sec_i int, para_i int, text string"), links=None, redirects=None,
    )
    articles = [(i, vector(i)) for i in range(6)]
    chunks = [(f"article:{i}:s0:p{p}:c{c}", f"article:{i}:s0:p{p}", vector(i + p / 3 + c / 9)) for i in range(6) for p in range(2) for c in range(2)]
    text = lambda v: ";".join(map(str, v))
    nodes = spark.createDataFrame([(f"article:{i}", "Article", "", "", text(v)) for i, v in articles] + [(c, "Chunk", "", "", text(v)) for c, _, v in chunks] + [("article:9", "Article", "", "", None)], "nodeID string, label string, title string, text string, embedding string")
    K.write_nodes(nodes, str(tmp_path / "nodes"), 10)
    shards = sorted(map(str, (tmp_path / "nodes").glob("nodes-*.parquet")))
    for label in ("Article", "Chunk"):
        main(["build_vector_index", *shards, "--folder", str(tmp_path / label), "--label", label], spark)
    assert "Lists:" in capsys.readouterr().out
    plain = Tools(g, lambda text: vector(2.2), spark.createDataFrame(articles, "page_id long, embedding array<float>"), spark.createDataFrame(chunks, "chunk_id string, paragraph_id string, embedding array<float>"))
    indexed = Tools(g, lambda text: vector(2.2), article_index=open_index(spark, str(tmp_path / "Article")), chunk_index=open_index(spark, str(tmp_path / "Chunk")))
    assert json.loads(indexed.vector_search_article("x", 4)) == json.loads(plain.vector_search_article("x", 4))
    assert json.loads(indexed.vector_search_paragraph("x", 4)) == json.loads(plain.vector_search_paragraph("x", 4))
