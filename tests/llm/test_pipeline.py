"""The pipeline on planted cases, and its stages one by one on a driver table."""

import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
from graphleaf.llm import packing
from llm_helpers import frame, prose
from tokenizers import Tokenizer


def planted():
    passage, short = prose(900, 120), prose(902, 53)  # the second is shorter than 400 bytes
    texts = {i: prose(i, 60 + i % 40) for i in range(400)}
    for i in range(0, 80):  # toxic, and labelled so
        words = texts[i].split(" ")
        texts[i] = " ".join([*words[:20], "vilest", *words[20:40], "hateful", *words[40:]])
    texts[200], texts[201] = texts[199], texts[199].replace(" ", "  ", 1) + " extra"
    texts[210], texts[211] = prose(210, 30) + " " + passage + " " + prose(2100, 60), prose(211, 90) + " " + passage
    for i in (240, 241, 242):
        texts[i] = prose(i, 50) + " " + short + " " + prose(i + 2000, 50)
    texts[220] = prose(220, 40) + " " + prose(901, 14) + " " + prose(2200, 40)
    texts[230], texts[231] = None, ""
    return texts, passage, short


def test_planted_cases(spark, tmp_path):
    texts, passage, short = planted()
    spark.createDataFrame([(d, t, "en", f"s{d % 3}", None if t is None else len(t)) for d, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(d, 1, int(d < 80)) for d in texts], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, prose(901, 14))], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    kept = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs.columns
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == before
        kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert not set(kept["toxicity"]) & set(range(80)) and len(kept["toxicity"]) >= 316
    assert set(kept["toxicity"]) - set(kept["near_duplicates"]) == {200, 201, 231}
    changed = {d for d, t in kept["repeated_passages"].items() if t != texts[d]}
    assert changed == {211, 241, 242} and all(passage[5:-5] not in kept["repeated_passages"][d] and short[5:-5] not in kept["repeated_passages"][d] for d in changed)
    assert passage in kept["repeated_passages"][210] and short in kept["repeated_passages"][240]
    assert set(kept["repeated_passages"]) - set(kept["decontamination"]) == {220}

    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    expected = {d: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 1] for d, t in kept["decontamination"].items()}
    assert {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in out} == {d: (len(i), zlib.crc32(np.array(i, "<u4").tobytes())) for d, i in expected.items()}
    slots = defaultdict(int)
    for r in sorted(out, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == slots[r["sequence_id"]]
        slots[r["sequence_id"]] += r["length"]
    assert max(slots.values()) <= 4096 and len(slots) == -(-sum(map(len, expected.values())) // 4096)


def test_hard_rows_go_through(spark, tmp_path, sf, hard):
    """Null and empty texts, null ids, an id with two texts, repeated rows, a very long text and columns of clashing names."""
    docs = hard.union(frame(spark, [(5, prose(77, 70)), (None, prose(4, 90)), (None, None)]))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").limit(0 if t == "labels" else 1000).write.parquet(str(tmp_path / f"{t}.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs, before = spark.read.parquet(str(tmp_path / name)), docs
        assert docs.columns == before.columns and docs.dtypes == before.dtypes
        if name == "near_duplicates":
            texts = [(r["doc_id"], r["text"]) for r in docs.collect()]
            assert sorted(d for d, _ in texts if d is not None) == [0, 2, 3, 4, 5, 5, 6, 7, 8, 20] and len({t for d, t in texts if d == 5}) == 2
            assert Counter(t for d, t in texts if d is None) == Counter({prose(4, 90): 2, None: 1})
        if name == "repeated_passages":
            assert docs.count() == before.count() and {r["doc_id"]: r["text"] for r in docs.collect()}[0] is None
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, str(tmp_path)).collect()} == {r["doc_id"] for r in docs.collect()}


def test_an_empty_corpus(spark, tmp_path, sf):
    spark.read.parquet(f"{sf}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    for t in ("labels", "benchmark"):
        spark.read.parquet(f"{sf}/{t}.parquet").write.parquet(str(tmp_path / f"{t}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
