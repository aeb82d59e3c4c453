import bz2
import json

import pytest

from pyspark.sql import functions as F

from graphleaf.commands import main
from graphleaf.operators import evaluation as E
from graphleaf.sources import exports as K
from graphleaf.tables import numbered
from test_records import PAGES, dump, page_xml  # noqa: F401


def test_build_to_batches(spark, dump, tmp_path, capsys):  # noqa: F811
    at = lambda name: str(tmp_path / name)
    main(["build_index", str(dump), "--output", at("index")], spark)
    main(["wiki2parquet", str(dump), at("index"), at("graph"), "--title", "Gamma"], spark)
    nodes = K.read_shards(spark, at("graph"), "nodes", K.NODE_COLUMNS)
    assert sorted((r["nodeID"], r["title"]) for r in nodes.filter("label = 'Article'").collect()) == [("article:1", ""), ("article:2", "Gamma")]
    with pytest.raises(LookupError, match="Nobody"):
        main(["wiki2parquet", str(dump), at("index"), at("none"), "--title", "Nobody"], spark)
    main(["wiki2parquet", str(dump), at("index"), at("whole"), "--namespace-id", "0", "--shard-size", "5"], spark)
    main(["materialize_mentions", at("whole"), at("more")], spark)
    kinds = {r["rel_type"]: r["count"] for r in K.read_shards(spark, at("more"), "edges", K.EDGE_COLUMNS).groupBy("rel_type").count().collect()}
    assert kinds["MENTIONS"] == 2 == kinds["LINKS_TO"] and kinds["REDIRECTS_TO"] == 1
    main(["list_namespaces", str(dump)], spark)
    assert capsys.readouterr().out.split() == ["0", "1"]
    lines = [r[0] for r in spark.read.text(at("index")).collect()]
    (tmp_path / "folder").mkdir()
    (tmp_path / "folder" / dump.name).write_bytes(dump.read_bytes())
    (tmp_path / "folder" / "w-pages-articles-multistream-index.txt").write_text("\n".join(lines))
    main(["wiki2parquet", at("folder"), "-", at("found"), "--title", "Gamma"], spark)
    assert K.read_shards(spark, at("found"), "nodes", K.NODE_COLUMNS).count() == nodes.count()

    (tmp_path / "traces").mkdir()
    (tmp_path / "traces" / "d_ex_3.json").write_text(json.dumps({"Who?": {"provenance": {"a": [{"source_url": ["https://x/wiki/Gamma", "https://x/wiki/Alpha%20Betta"]}]}}}))
    main(["load_traces", at("index"), at("traces"), at("matches"), at("corrections"), "--unmatched-csv", at("unmatched")], spark)
    assert capsys.readouterr().out.split() == ["Results:", "1", "Sources:", "2", "Corrections:", "1", "Unmatched:", "0"]
    (tmp_path / "decisions.csv").write_text("original,matched,score,accept\nAlpha Betta,Alpha & Beta,90,True\n")
    main(["filter_by_humaneval", at("decisions.csv"), at("matches"), at("kept")], spark)
    (tmp_path / "release.jsonl").write_text("\n".join(json.dumps({"ex_num": 3, "question": "Who?", "decomposition": [d], "validated_answer": ["x", 1, True]}) for d in ("old", "new")))
    main(["filter_questions", at("kept"), at("questions"), "--release-jsonl", at("release.jsonl")], spark)
    got = json.loads(spark.read.text(at("questions")).first()[0])
    assert got == [{"ex_num": 3, "question": "Who?", "decomposition": ["new"], "validated_answer": ["x", 1, True]}]
    main(["make_batches", at("questions"), at("batches")], spark)
    assert spark.read.option("header", True).csv(at("batches")).count() == 1
    assert bz2 and PAGES and page_xml

    (tmp_path / "c.csv").write_text("original,matched,score\nAlpha Betta,Alpha & Beta,90\nAlpha Betta,Alpha & Beta,90\n")
    main(["humaneval_corrections", at("decisions.csv"), at("c.csv")], spark)
    assert [tuple(r) for r in spark.read.option("header", True).csv(at("c-humaneval.csv")).collect()] == [("Alpha Betta", "Alpha & Beta", "90", "True")] * 2
    (tmp_path / "d.csv").write_text("original,matched,score\nX,Y,1\n")
    with pytest.raises(E.RecordError, match="X"):
        main(["humaneval_corrections", at("decisions.csv"), at("d.csv")], spark)


def test_merging_result_files(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    head = "query,ex_num,agent_answer,crag_score,crag_v3_score,success,agent_settings,models\n"
    (tmp_path / "b_1.csv").write_text(head + "q1,1,a,1,1,True,s,m\n")
    (tmp_path / "b_0.csv").write_text(head + 'q0,0,,1,1,False,s,m\nq2,2,"two\nlines ""x""",1,1,True,s,m\n')
    main(["join_batches", at("b_*.csv"), at("joined")], spark)
    joined = K.read_results(spark, at("joined")).collect()
    assert [r["query"] for r in joined] == ["q0", "q2", "q1"] and joined[1]["agent_answer"] == 'two\nlines "x"'
    (tmp_path / "again.csv").write_text(head + "q0,0,now,1,1,True,s,m\n")
    main(["merge_experiments", at("joined"), at("again.csv"), at("merged"), "--success-only"], spark)
    assert sorted((r["query"], r["agent_answer"]) for r in K.read_results(spark, at("merged")).collect()) == [("q0", "now"), ("q1", "a"), ("q2", 'two\nlines "x"')]
    (tmp_path / "other.csv").write_text(head + "q0,0,now,1,1,True,s,another\n")
    with pytest.raises(AssertionError, match="models"):
        main(["merge_experiments", at("joined"), at("other.csv"), at("merged2")], spark)
    with pytest.raises(SystemExit):
        main(["join_batches", at("again.csv"), at("one")], spark)


def test_embedding_goes_on_where_it_stopped(spark, tmp_path):
    nodes = spark.createDataFrame([("article:1", "Article", "One", ""), ("article:1:s0", "Section", "", ""), ("article:1:s0:p0:c0", "Chunk", "", "text")], "nodeID string, label string, title string, text string")
    K.write_nodes(nodes.coalesce(1), str(tmp_path / "in"), shard_rows=2)
    shards = sorted(map(str, (tmp_path / "in").glob("nodes-*.parquet")))
    embedder = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert len(shards) == 2 and K.embed_shards(spark, shards[:1], str(tmp_path / "out"), embedder, prefix="p ") == (1, 0)
    assert K.embed_shards(spark, shards, str(tmp_path / "out"), embedder, prefix="p ") == (1, 1)
    out = K.read_shards(spark, str(tmp_path / "out"), "nodes", K.NODE_COLUMNS | {"embedding": K.EMBEDDING_COLUMN})
    assert {r["nodeID"]: r["embedding"] for r in out.collect()} == {"article:1": "5.0;1.0", "article:1:s0": None, "article:1:s0:p0:c0": "6.0;1.0"}


def test_agent_records(spark):
    messages = [{"type": "human", "content": "hi"}, {"type": "ai", "content": [{"type": "reasoning", "summary": []}, {"type": "function_call", "name": "f", "arguments": "{}"}], "usage_metadata": {"total_tokens": 7}, "response_metadata": {}},
                {"type": "tool", "content": "x"}, {"type": "ai", "content": [{"type": "text", "text": "done"}], "usage_metadata": None, "response_metadata": {"model_name": "m-1"}}]
    runs = spark.createDataFrame([(1, "q", json.dumps(messages)), (2, "r", "broken"), (3, "s", None)], "ex_num long, query string, messages string")
    out = {r["ex_num"]: r for r in E.agent_records(runs).collect()}
    assert json.loads(out[1]["token_usage"]) == [{"total_tokens": 7}, None] and json.loads(out[1]["function_calls"]) == [messages[1]["content"][1]]
    assert json.loads(out[1]["agent_reasoning"]) == [messages[1]["content"][0]] and out[1]["model"] == "m-1"
    assert all(out[k]["token_usage"] == out[k]["function_calls"] == "[]" and out[k]["model"] is None for k in (2, 3))
    rows = {r["ex_num"]: r for r in E.result_rows(E.agent_records(runs).withColumn("error", F.when(F.col("ex_num") == 2, '["no"]')), "{}", "judge", "vectors").collect()}
    assert rows[1]["success"] and not rows[2]["success"] and json.loads(rows[1]["models"]) == {"generator": "m-1", "evaluator_model": "judge", "evaluator_embeddings": "vectors"}


def test_batches_of_several_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for f in range(3):
        (tmp_path / "in" / f"{f}.json").write_text(json.dumps([{"ex_num": 20 * f + i, "question": f"q{i}"} for i in range(20)]))
    main(["make_batches", str(tmp_path / "in"), str(tmp_path / "out")], spark)
    sizes = {r["batch"]: r["count"] for r in spark.read.option("header", True).csv(str(tmp_path / "out")).groupBy("batch").count().collect()}
    assert sizes == {0: 32, 1: 28}
    parts = spark.range(0, 100, 1, 7).union(spark.range(200, 203, 1, 2)).filter("id % 3 <> 0")
    assert sorted(r["pos"] for r in numbered(parts).collect()) == list(range(parts.count())) and numbered(parts.limit(0)).collect() == []


def test_tokens_of_whole_texts(spark, sf):
    import public_tokenizers
    from tokenizers import Tokenizer

    from graphleaf.plans import queries as Q

    tokenizer = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    n = {d["doc_id"]: len(tokenizer.encode(d["text"] or "", add_special_tokens=False).ids) for d in docs}
    totals = {r["lang"]: (r["texts"], r["tokens"]) for r in Q.QUERIES["token_totals"](spark, sf).collect()}
    assert totals == {g: (len(own), sum(own)) for g in {d["lang"] for d in docs} for own in [[n[d["doc_id"]] for d in docs if d["lang"] == g]]}
    half = [v for d, v in n.items() if d % 2 == 0]
    row = Q.QUERIES["token_estimate"](spark, sf).first()
    assert tuple(row) == (len(docs), len(half), sum(half), int(sum(half) / len(half) * len(docs) + 0.5))
