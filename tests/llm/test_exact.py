"""Operators whose results a plain program gives too."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphleaf.llm import chat, chunk_dedup, common, decontaminate, packing, queries, sharding, suffix_dedup
from graphleaf.llm.common import ROLL_A, ROLL_B
from llm_helpers import CLASH, frame, prose


def rows(df):
    return [tuple(r) for r in df.collect()]


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_matches_its_sql(spark, sf, tmp_path, name):
    queries.QUERIES[name](spark, sf).write.parquet(str(tmp_path / "out"))
    c = duckdb.connect()
    for t in ("documents", "benchmark", "conversations", "embeddings"):
        c.execute(f"create view {t} as select * from read_parquet('{sf}/{t}.parquet')")
    c.execute(f"create table expected as {queries.ORACLES[name]}")
    names = ", ".join(r[0] for r in c.execute("describe expected").fetchall())
    got = f"select {names} from read_parquet('{tmp_path}/out/*.parquet')"
    assert c.execute(f"select count(*) from (from expected except all {got})").fetchall() == [(0,)]
    assert c.execute(f"select count(*) from ({got} except all from expected)").fetchall() == [(0,)]


# --- 2: decontamination

def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def hits(text, items):
    w, hit, found = words_of(text), set(), set()
    for item, other in items:
        o = words_of(other)
        for k in range(max(1, len(o) - 9) if o else 0):
            window = o[k : k + 10]
            for i in range(len(w) - len(window) + 1):
                if w[i : i + len(window)] == window:
                    hit |= set(range(i, i + len(window)))
                    if item is not None:
                        found.add(str(item))
    return len(w), hit, sorted(found)


@pytest.fixture(scope="module")
def items(spark):
    long = prose(3, 80).split()
    data = [(1, " ".join(long[20:34])), (2, "ONE"), (3, "x y x y x y x y x y x y"), (None, " ".join(long[50:65])), (4, None), (5, "..."), (1, " ".join(long[20:34])), (6, prose(4, 90)), (7, "éé é")]
    return data, spark.createDataFrame([(*r, "clash") for r in data], "item_id long, text string, n_words string")


@pytest.mark.parametrize("block", [decontaminate.PATTERN_BYTES, 300])
def test_decontamination(hard, items, block):
    got = decontaminate.decontaminate(hard, items[1], pattern_bytes=block).select("text", "n_words", "hit_spans", "hit_items").collect()
    assert len(got) == 16
    for r in got:
        n, hit, found = hits(r["text"], items[0])
        marked = {i for s in r["hit_spans"] for i in range(s["first"], s["past"])}
        assert (r["n_words"], marked, r["hit_items"]) == (n, hit, found)


def test_decontamination_of_nothing(nothing, hard, items, spark):
    assert rows(decontaminate.decontaminate(nothing, items[1])) == []
    none = decontaminate.decontaminate(hard, items[1].limit(0))
    assert none.filter("size(hit_spans) > 0").count() == 0 and none.count() == 16
    kept = decontaminate.remove_contaminated(hard, items[1])
    assert kept.columns == hard.columns and {r["n_words"] for r in kept.collect()} == {"own"} and not {3, 5, 7} & {r["doc_id"] for r in kept.collect()}


@given(st.lists(st.text("ab .", max_size=40), max_size=5), st.lists(st.text("ab .", max_size=60), max_size=6))
@settings(max_examples=60, deadline=None)
def test_search_finds_what_a_plain_search_finds(patterns, texts):
    items = list(enumerate(patterns))
    compiled = decontaminate.Patterns([(str(i), t) for i, t in items])
    raw = [t.encode() for t in texts]
    n, spans, found = decontaminate._scan(compiled, np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64))
    for d, t in enumerate(texts):
        words, hit, ids = hits(t, items)
        assert (n[d], {i for a, b in spans.get(d, []) for i in range(a, b)}, sorted(found.get(d, ()))) == (words, hit, ids)


# --- 3: chat

@given(st.text(st.sampled_from("<[|>]/\\sINSTim_startend\n"), max_size=40))
@settings(max_examples=300)
def test_escape_is_reversible_and_leaves_no_control_string(text):
    out = chat.escape(text)
    assert chat.unescape(out) == text and not any(c in out for c in chat.CONTROL)
    assert chat._role_in(chat._role_out(text)) == text and "\n" not in chat._role_out(text)


@given(st.lists(st.sampled_from(chat.CONTROL + ("\\", "<", "a")), max_size=8))
def test_control_strings_in_a_row(parts):
    text = "".join(parts)
    assert chat.unescape(chat.escape(text)) == text and not any(c in chat.escape(text) for c in chat.CONTROL)


def test_streamed_events_fold(spark):
    log = [(1, 1, "", 0, "message", "user", "hi"), (1, 2, "", 1, "message", "assistant", None), (1, 2, "", 2, "delta", None, "Hel"), (1, 2, "", 4, "delta", None, "!"), (1, 2, "", 3, "delta", None, "lo"),
           (1, 2, "", 5, "regenerate", None, None), (1, 2, "", 6, "delta", None, "Bye"), (1, 1, "", 7, "edit", None, "hello"), (2, 1, "", 0, "delta", "assistant", "</s>"), (None, 1, "", 0, "message", None, None)]
    events = spark.createDataFrame(log, "conv_id long, message long, tie string, seq int, event string, role string, text string")
    out = {r["conv_id"]: r for r in chat.format_events(events).collect()}
    assert out[1]["formatted"] == "<|im_start|>user\nhello<|im_end|>\n<|im_start|>assistant\nBye<|im_end|>\n" and out[1]["turns"] == 2
    s = out[1]["loss_spans"][0]
    assert out[1]["formatted"][s["start"] : s["past"]] == "Bye"
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_events(events)).collect()}
    assert back[2]["loss_chars"] == 4 and back[2]["loss_sha256"] == hashlib.sha256(b"</s>").hexdigest() and back[None]["n_turns"] == 1
    assert back[1]["turns_sha256"] == hashlib.sha256(b"user\nhello\nassistant\nBye\n").hexdigest()


def test_turns_that_repeat_and_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 50)
    turns = [(1, 0, "user", "a"), (1, 0, "user", "a"), (1, None, None, None), (2, 0, "assistant", "b" * 300), (2, 1, "as\\n\nx", "c\n<|im_end|>\n")]
    log = chat.log_of_turns(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string"))
    back = {r["conv_id"]: r for r in chat.read_back(chat.format_events(log)).collect()}
    assert back[1]["n_turns"] == 3 and back[1]["turns_sha256"] == hashlib.sha256(b"\n\nuser\na\nuser\na\n").hexdigest()
    assert back[2]["n_turns"] == 2 and back[2]["turns_sha256"] == hashlib.sha256(("assistant\n" + "b" * 300 + "\nas\\n\nx\nc\n<|im_end|>\n\n").encode()).hexdigest()
    assert rows(chat.read_back(chat.format_events(log.limit(0)))) == []


# --- 5: suffix arrays

def removed(texts, length=400):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[i : i + length] for r in raw for i in range(len(r) - length + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r) + 1, bool)
        for i in range(len(r) - length + 1):
            if seen[r[i : i + length]] > 1:
                gone[i : i + length] = True
        kept = bytes(b for b, g in zip(r, gone, strict=False) if not g)
        out.append((int(gone.sum()), int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(r) else 0, hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("split", [1000, 2])
def test_repeated_passages(spark, hard, monkeypatch, split):
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", split)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    passage, tail = prose(50, 120), prose(51, 90)
    extra = [(100 + i, prose(60 + i, 30) + passage[i % 3 :] + prose(70 + i, 40)) for i in range(7)] + [(120, tail + "é" + passage + "é" + tail), (121, "ü" + prose(52, 100)), (122, "ö" + prose(52, 100))]
    docs = frame(spark, extra).union(hard.filter("doc_id <> 4 or doc_id is null"))
    got = {r["node"].hex(): (r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in suffix_dedup.repeated_passages(docs).collect()}
    texts = [r["text"] for r in docs.select("text").collect()]
    for text, expected in zip(texts, removed(texts), strict=True):
        whole = hashlib.sha256((text or "").encode()).hexdigest()
        assert got.get(whole[:32], (0, 0, whole)) == expected
    assert any(0 < v[0] for v in got.values())


def worded(texts, words=51):
    """Words in passages of so many words that start anywhere else too, and runs of such words, for each text."""
    raw = [(t or "").encode() for t in texts]
    at = [[m.span() for m in re.finditer(rb"[0-9A-Za-z\x80-\xff]+", r)] for r in raw]
    seen = Counter(r[a[i][0] : a[i + words - 1][1]] for r, a in zip(raw, at, strict=True) for i in range(len(a) - words + 1))
    out = []
    for r, a in zip(raw, at, strict=True):
        hit = np.zeros(len(a) + 1, bool)
        for i in range(len(a) - words + 1):
            if seen[r[a[i][0] : a[i + words - 1][1]]] > 1:
                hit[i : i + words] = True
        out.append((int(hit.sum()), int((hit & ~np.concatenate([[False], hit[:-1]])).sum())))
    return out


@pytest.mark.parametrize(("split", "parts"), [(1000, 1 << 19), (2, 97)])
def test_repeated_passages_of_words(spark, hard, monkeypatch, tmp_path, split, parts):
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", split)
    monkeypatch.setattr(suffix_dedup, "SHARD_MARKS", 100)
    monkeypatch.setattr(suffix_dedup, "PART_WORDS", parts)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 900)
    passage, tiny, under = prose(50, 60), " ".join("ab"[i * i % 7 % 2] for i in range(51)), prose(53, 50)
    extra = [(100 + i, prose(60 + i, 30) + " " + passage + "; " + prose(70 + i, 40)) for i in range(7)]
    extra += [(120 + i, f"{prose(80 + i, 20)}, {tiny}. {prose(90 + i, 20)}") for i in range(2)] + [(130 + i, f"{prose(82 + i, 20)} {under} {prose(92 + i, 20)}") for i in range(2)]
    extra += [(140, prose(54, 51).upper()), (141, prose(54, 51)), (142, passage + " " + prose(84, 9) + " " + passage), (143, prose(55, 120))]
    docs = frame(spark, extra).union(hard.filter("doc_id <> 4 or doc_id is null")).select("doc_id", "text")
    docs.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r["doc_id"], r["n_bytes"]): r for r in queries.QUERIES["op5_suffix_dedup"](spark, str(tmp_path)).collect()}
    ids, texts = zip(*docs.collect(), strict=True)
    for d, text, passages, cut in zip(ids, texts, worded(texts), removed(texts), strict=True):
        r = got[d, len((text or "").encode())]
        assert (r["n_passage_words"], r["n_passages"]) == passages, d
        assert (r["n_removed"], r["n_spans"], r["kept_sha256"]) == cut, d
    found = {d: r["n_passage_words"] for (d, _), r in got.items()}
    assert all(found[100 + i] >= 60 for i in range(7)) and found[120] == found[121] == 51 and found[130] == found[131] == found[143] == 0
    assert rows(suffix_dedup.repeated_word_passages(docs.limit(0))) == []


def test_word_anchors_of_a_long_text_in_parts(monkeypatch):
    data = np.frombuffer((prose(5, 700) + "x y " * 300).encode(), np.uint8)
    off = np.array([0, len(data)])

    def of_each_start():
        _, first, n, anchor, _ = suffix_dedup.word_anchors(data, off)
        assert np.array_equal(first, np.concatenate([[0], np.cumsum(n)[:-1]])) and n.sum() == 1250
        return np.repeat(anchor, n)

    whole = of_each_start()
    monkeypatch.setattr(suffix_dedup, "PART_WORDS", 97)
    assert np.array_equal(whole, of_each_start())

    starts = np.arange(0, len(data) - 60, 7)
    marks = suffix_dedup._in_parts(data, starts, starts + 60)
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 900)
    assert np.array_equal(marks, suffix_dedup._in_parts(data, starts, starts + 60))


def kept_first(docs, length, least_words):
    """Texts of (id, text) without the strings that start earlier, in order of id, hash and place; one text for each (id, text)."""
    order = sorted({(d is not None, d or 0, hashlib.sha256((t or "").encode()).digest()[:16], t or "") for d, t in docs})
    seen, out = set(), {}
    for known, d, _, t in order:
        raw, gone = t.encode(), set()
        for i in range(len(raw) - length + 1):
            if raw[i : i + length] in seen:
                gone.update(range(i, i + length))
            seen.add(raw[i : i + length])
        kept, at = b"", 0
        while at < len(raw):
            past = at
            while past < len(raw) and (past in gone) == (at in gone):
                past += 1
            if at not in gone or len(re.findall(rb"[0-9A-Za-z\x80-\xff]+", raw[at:past])) < least_words:
                kept += raw[at:past]
            at = past
        out[(d if known else None, t)] = kept.decode(errors="ignore")
    return out


@pytest.mark.parametrize(("split", "length", "gram", "words"), [(1000, 400, 64, 0), (2, 400, 64, 0), (1, 120, 24, 0), (1000, 250, 48, 51)])
def test_the_first_of_repeated_passages_stays(spark, hard, monkeypatch, split, length, gram, words):
    monkeypatch.setattr(suffix_dedup, "SHARD_SEGMENTS", split)
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", 3000)
    passage, tail, short = prose(50, 120), prose(51, 90), prose(53, 49)
    extra = [(300 - i, prose(60 + i, 30) + passage[i % 3 :] + prose(70 + i, 40)) for i in range(7)] + [(120, tail + passage + " " + tail), (121, prose(52, 100) + short), (122, short + " " + prose(54, 90)), (123, prose(55, 60) + "\n" + short)]
    extra += [(7, prose(3, 80) + prose(56, 20)), (None, prose(57, 20) + passage)]
    docs = frame(spark, extra).union(hard.filter("doc_id <> 4 or doc_id is null"))
    out = suffix_dedup.remove_passages(docs.withColumn("was", F.col("text")), length=length, gram=gram, keep_first=True, least_words=words)
    expected = kept_first([(r["doc_id"], r["text"]) for r in docs.collect()], length, words)
    rows_out = out.collect()
    assert len(rows_out) == docs.count()
    for r in rows_out:
        assert (r["text"] or "") == expected[r["doc_id"], r["was"] or ""], r["doc_id"]
    assert sum(r["text"] != r["was"] for r in rows_out if r["was"]) > 6


def test_built_up_strings_have_hashes_of_their_own():
    word = b"ab"  # the two Thue-Morse words of a length agree in every polynomial modulo a power of two
    for _ in range(11):
        word += word.translate(bytes.maketrans(b"ab", b"ba"))
    other = word.translate(bytes.maketrans(b"ab", b"ba"))
    data = np.frombuffer(word + other, np.uint8)
    for hashed in (ROLL_A, ROLL_B):
        a, b = hashed.of(hashed.running(data), np.array([0, len(word)]), np.array([len(word), len(data)])).tolist()
        assert a != b


@given(st.binary(min_size=2, max_size=60), st.integers(0, 30), st.integers(1, 30))
def test_hashes_do_not_depend_on_place(raw, at, size):
    size = min(size, len(raw))
    moved = bytes(at) + raw
    for hashed in (ROLL_A, ROLL_B):
        one = hashed.of(hashed.running(np.frombuffer(raw, np.uint8)), np.array([0]), np.array([size]))
        assert one == hashed.of(hashed.running(np.frombuffer(moved, np.uint8)), np.array([at]), np.array([at + size]))


def test_anchors_of_a_long_text_in_parts(monkeypatch):
    data = np.frombuffer((prose(5, 700) + "x y " * 300).encode(), np.uint8)
    off = np.array([0, len(data)])

    def of_each_start():
        _, first, n, anchor, _ = suffix_dedup.anchors(data, off)
        assert np.array_equal(first, np.concatenate([[0], np.cumsum(n)[:-1]])) and n.sum() == len(data) - 399
        return np.repeat(anchor, n)

    whole = of_each_start()
    monkeypatch.setattr(suffix_dedup, "PART_BYTES", 997)
    assert np.array_equal(whole, of_each_start())


@pytest.mark.parametrize(("length", "gram"), [(400, 64), (250, 48), (120, 24)])
def test_only_parts_that_may_repeat_are_sorted(length, gram):
    phrase, passage = prose(50, 15)[: gram + 30], prose(51, 200)
    texts = [f"{prose(100 + i, 90)} {phrase} {prose(200 + i, 90)}" for i in range(60)]
    texts += [prose(300 + i, 40 + i) + passage[i * 7 : 900 - i * 11] + phrase + prose(400 + i, 60) for i in range(12)] + [phrase * 12, "x y " * 300, texts[0] + "é"]
    raw = [t.encode() for t in texts]
    data, off = np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)])
    doc, first, n, anchor, digest = suffix_dedup.anchors(data, off, length, gram)
    kinds = {}
    for d, f, m, a, g in zip(doc.tolist(), first.tolist(), n.tolist(), anchor.tolist(), digest.tolist(), strict=True):
        kinds.setdefault((a, g), []).append(raw[d][f : f + m + length - 1])
    kinds = {k: v for k, v in kinds.items() if len(v) > 1 or sum(a == k[0] for a, _ in kinds) > 1}
    segments, counts = [v[0] for v in kinds.values()], np.array([len(v) for v in kinds.values()])
    size, own = np.array([len(s) for s in segments]), np.array([a for a, _ in kinds], np.uint64)
    text, whole = np.frombuffer(b"".join(segments), np.uint8), np.zeros(len(segments), bool)
    part, at, past = suffix_dedup._narrowed(text, size, own, counts, whole, length, gram)
    kept = {(i, s) for i, a, b in zip(part.tolist(), at.tolist(), past.tolist(), strict=True) for s in range(a, b)}
    seen = Counter()
    for s, c in zip(segments, counts.tolist(), strict=True):
        seen.update({s[i : i + length]: c for i in range(len(s) - length + 1)})
    repeated = {(k, i) for k, s in enumerate(segments) for i in range(len(s) - length + 1) if seen[s[i : i + length]] > 1}
    assert repeated and repeated <= kept
    assert len(kept) == (past - at).sum() < len(repeated) + (size - length + 1).sum() / 4
    part, at, past = suffix_dedup._narrowed(text, size, own, counts, ~whole, length, gram)
    assert np.array_equal(part, np.arange(len(segments))) and not at.any() and np.array_equal(past, size - length + 1)


def test_suffixes_that_agree_in_the_depth_have_one_rank():
    parts = [prose(5, 30)[:150] + "x" * 40, "yz" + prose(5, 30)[:130], prose(5, 30)[:99] + "!", "ab" * 40, "ba" * 40]
    raw = [p.encode() for p in parts]
    text = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.repeat(np.cumsum([len(r) for r in raw]), [len(r) for r in raw])
    for depth in (7, 20, 33, 57, 100):
        order, rank = suffix_dedup.suffix_array(text, ends, depth)
        cut = [bytes(text[i : min(ends[i], i + depth)]) for i in range(len(text))]
        assert [cut[i] for i in order] == sorted(cut)
        place = {c: k for k, c in reversed(list(enumerate(sorted(cut))))}
        assert rank.tolist() == [place[c] for c in cut]


@given(st.lists(st.lists(st.booleans(), min_size=1, max_size=9), min_size=1, max_size=6))
def test_spans_end_with_their_segment(flags):
    cut = np.cumsum([0, *map(len, flags)])
    got = suffix_dedup._spans_of(cut, np.flatnonzero([f for fs in flags for f in fs]))
    assert got.type == suffix_dedup._SPANS_ARROW
    assert [[(s["first"], s["past"]) for s in x] for x in got.to_pylist()] == [suffix_dedup._intervals(np.array(fs)) for fs in flags]


def test_tables_of_the_steps_before_are_removed(spark, hard):
    before = len(common._written)
    out = suffix_dedup.remove_passages(hard)
    assert len(common._written) == before + 1 and out.count() == 16


def test_remove_passages_keeps_rows(spark, hard, nothing):
    out = suffix_dedup.remove_passages(hard)
    assert out.columns == hard.columns and out.count() == 16 and {r["_node"] for r in out.collect()} == {"own"}
    by_id = {r["doc_id"]: r for r in out.collect()}
    assert by_id[21]["text"] == "" and by_id[21]["n_chars"] == 0 and by_id[0]["text"] is None and by_id[3]["text"] == "one" and by_id[6]["text"] == ""
    assert rows(suffix_dedup.remove_passages(nothing)) == [] and rows(suffix_dedup.repeated_passages(nothing)) == []


@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=4))
@settings(max_examples=100, deadline=None)
def test_suffix_array_and_prefixes(parts):
    raw = [p.encode() for p in parts]
    text = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.repeat(np.cumsum([len(r) for r in raw]), [len(r) for r in raw])
    order, _ = suffix_dedup.suffix_array(text, ends, 64)
    suffix = [bytes(text[i : ends[i]]) for i in range(len(text))]
    assert [suffix[i] for i in order] == sorted(suffix)
    lcp = suffix_dedup.common_prefixes(text, ends, order, most=12, stretch=4)
    plain = [0] + [min(12, next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))) for a, b in zip((suffix[i] for i in order[:-1]), (suffix[i] for i in order[1:]), strict=True)]
    assert lcp.tolist() == plain


# --- 6: packing

def test_packing(hard, nothing):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(packing.default_tokenizer())
    out = packing.pack(hard, packing.default_tokenizer(), with_ids=True).collect()
    expected = Counter()
    for r in hard.collect():
        ids = [*tokenizer.encode(r["text"] or "", add_special_tokens=False).ids, 1]
        for n, at in enumerate(range(0, len(ids), 4096)):
            own = np.array(ids[at : at + 4096], "<u4").tobytes()
            expected[r["doc_id"], n, at, len(own) // 4, zlib.crc32(own), own] += 1
    assert expected == Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"], bytes(r["ids"])) for r in out)
    check_sequences(out)
    assert rows(packing.pack(nothing, packing.default_tokenizer())) == []


def check_sequences(out):
    by = defaultdict(list)
    for r in out:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in by.values():
        at = 0
        for offset, length in sorted(slots):
            assert offset == at
            at += length
        assert at <= 4096
    assert len(by) >= -(-sum(r["length"] for r in out) // 4096)


@given(st.dictionaries(st.integers(1, 50), st.integers(1, 30), max_size=12))
@settings(max_examples=200)
def test_plan_is_best_fit_decreasing(histogram):
    room = []
    for length in sorted(histogram, reverse=True):
        for _ in range(histogram[length]):
            fit = [i for i, r in enumerate(room) if r >= length]
            if fit:
                room[min(fit, key=room.__getitem__)] -= length
            else:
                room.append(50 - length)
    taken = defaultdict(list)
    covered = Counter()
    for length, first, past, seq, each, at in packing.plan(histogram, 50):
        for nth in range(past - first):
            taken[seq + nth // each].append((at + nth % each * length, length))
        covered[length] += past - first
    assert covered == Counter(histogram) and len(taken) == len(room)
    for slots in taken.values():
        slots.sort()
        assert slots[0][0] == 0 and all(a + n == b for (a, n), (b, _) in zip(slots, slots[1:])) and sum(n for _, n in slots) <= 50


@given(st.lists(st.text(max_size=30), max_size=4))
@settings(max_examples=200, deadline=None)
def test_piece_ids_are_the_tokenizers(texts):
    own = packing._tokenizer(packing.default_tokenizer())
    texts = [t.encode(errors="ignore").decode() for t in texts] + ["it's <|endoftext|> don't", "İ Σ ß ﬁ ½ a\x1cb  c"]
    assert own.of(texts) == [packing._packed(own._encode(t)) for t in texts]


# --- 9: sharding

@pytest.mark.parametrize("shards", [1, 3, 8])
def test_sharding(spark, hard, shards):
    docs = hard.filter("doc_id is null or doc_id <> 4").union(frame(spark, [(1000 + i, prose(i, 20 + i % 60)) for i in range(600)]))
    out = sharding.shard(docs, n_shards=shards).collect()
    expected = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in docs.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == expected
    by, groups = defaultdict(list), defaultdict(set)
    for r in out:
        by[r["shard"]].append((r["slot"], r["size"]))
        groups[r["text_crc32"], r["size"]].add(r["shard"])
    assert all(sorted(s for s, _ in v) == list(range(len(v))) for v in by.values()) and set(by) == set(range(shards))
    assert all(len(g) == 1 for g in groups.values())
    size = [sum(s for _, s in v) for v in by.values()]
    assert max(size) - min(size) <= 0.05 * sum(size) / shards


def plain_leaves(points, dims, left):
    """Shards of points (bytes, coordinates) by recursion: halve the shards at the weighted quantile of the widest dimension."""
    out = {}

    def split(own, a, b):
        if b - a == 1:
            out.update(dict.fromkeys(own, a))
            return
        mid = (a + b) // 2
        width = [max((points[i][1][d] for i in own), default=0) - min((points[i][1][d] for i in own), default=0) for d in range(dims)]
        d = width.index(max(width))
        want = sum(left[a:mid]) / sum(left[a:b]) * sum(points[i][0] for i in own)
        cut, before = 0, 0
        for x in sorted({points[i][1][d] for i in own}):
            at = sum(points[i][0] for i in own if points[i][1][d] == x)
            cut = x + (want - before > at / 2)
            if before + at > want:
                break
            before += at
        split([i for i in own if points[i][1][d] < cut], a, mid)
        split([i for i in own if points[i][1][d] >= cut], mid, b)

    split(list(points), 0, len(left))
    return out


@pytest.mark.parametrize(("n", "shards", "held"), [(300, 8, 4), (80, 7, 1), (5, 6, 2), (40, 1, 4)])
def test_the_tree_is_the_plain_one(spark, monkeypatch, n, shards, held):
    monkeypatch.setattr(sharding, "LEVELS_HELD", held)
    rng = np.random.default_rng(n)
    top = 1 << (sharding.BINS_LOG2 * sharding.ROUNDS)
    points = {i: (int(rng.integers(1, 900)), [int(x) for x in rng.integers(0, [top, top // 3, 50])]) for i in range(n)}
    left = [float(x) for x in rng.integers(1, 9, shards)]
    df = spark.createDataFrame([(i, w, *x) for i, (w, x) in points.items()], "digest int, bytes long, a long, b long, c long")
    got = {r["digest"]: r["leaf"] for r in sharding._grow_tree(df, ["a", "b", "c"], left).collect()}
    assert got == plain_leaves(points, 3, left)


def test_a_group_larger_than_a_shard_is_dealt(spark, nothing):
    docs = frame(spark, [(i, "same text" * 20) for i in range(300)] + [(300 + i, prose(i, 30)) for i in range(100)])
    out = sharding.shard(docs, n_shards=4)
    size = [r[0] for r in out.groupBy("shard").agg(F.sum("size")).select("sum(size)").collect()]
    assert len(size) == 4 and max(size) - min(size) <= 0.05 * sum(size) / 4
    assert out.groupBy("shard").agg((F.max("slot") + 1 == F.count("*")).alias("ok"), (F.countDistinct("slot") == F.count("*")).alias("once")).filter("not ok or not once").count() == 0
    assert rows(sharding.shard(nothing, n_shards=8)) == [] and rows(sharding.shard(nothing, target_bytes=100)) == []
    assert sharding.shard(docs, target_bytes=20_000).select("shard").distinct().count() == -(-docs.select(F.sum(F.octet_length("text") + 1)).first()[0] // 20_000)


def test_texts_of_more_chunks_than_are_remembered(monkeypatch):
    """A text of more distinct chunks than the cap, some of them seen before."""
    monkeypatch.setattr(packing, "MAX_CHUNKS", 50)
    pieces = packing.PieceIds(packing.default_tokenizer())
    for n in (10, 60, 45, 70):
        text = " ".join(f"w{k}x{n if k % 2 else 0}" for k in range(n))
        assert pieces.of([text, "w0x0"]) == [packing._packed(pieces._encode(text)), packing._packed(pieces._encode("w0x0"))]


# --- 1: chunks

def plain_chunks(raw):
    out, at = [], 0
    for end in range(1, len(raw) + 1):
        h = 0
        for b in raw[max(0, end - 32) : end]:
            h = (h * 2 + int(chunk_dedup._GEAR[b])) & 0xFFFFFFFF
        short = end - at < max(chunk_dedup.LEAST, 32 if at == 0 else 0)
        if not short and h >> (32 - chunk_dedup.CUT_BITS) == 0 or end - at == chunk_dedup.MOST or end == len(raw):
            out.append((at, end))
            at = end
    return out


def test_chunks_are_the_plain_ones():
    raw = [prose(i, n).encode() for i, n in enumerate([0, 1, 40, 300, 2])] + [b"a" * 900]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])]).astype(np.int64)
    start, past, before = chunk_dedup.chunks(np.frombuffer(b"".join(raw), np.uint8), off)
    for d, r in enumerate(raw):
        own = slice(before[d], before[d + 1])
        assert list(zip((start[own] - off[d]).tolist(), (past[own] - off[d]).tolist(), strict=True)) == plain_chunks(r)


def test_duplicate_chunks(spark, hard, nothing):
    base = prose(80, 200)
    docs = frame(spark, [(200, base), (201, "inserted " + base), (202, prose(81, 200))]).union(hard)
    got = {r["doc_id"]: r for r in chunk_dedup.duplicate_spans(docs).collect()}
    assert chunk_dedup.duplicate_spans(docs).count() == docs.count()
    seen, expected = {}, defaultdict(list)
    order = sorted({(r["doc_id"] if r["doc_id"] is not None else -1, r["text"] or "") for r in docs.collect()})
    for d, t in order:
        raw = t.encode()
        for a, b in plain_chunks(raw) if len(raw) < 50_000 else []:
            if raw[a:b] in seen:
                expected[d].append((a, b))
            seen.setdefault(raw[a:b], (d, a))
    for d, _ in order:
        if d in (4, 5):  # too long for the plain way; a repeated row, which is the same document
            continue
        spans = []
        for a, b in expected[d]:
            if spans and spans[-1][1] == a:
                spans[-1][1] = b
            else:
                spans.append([a, b])
        assert [(s["first"], s["past"]) for s in got[None if d < 0 else d]["spans"]] == [tuple(s) for s in spans if s[1] - s[0] >= chunk_dedup.RUN], d
    assert sum(s["past"] - s["first"] for s in got[201]["spans"]) > 0.8 * len(base) and not got[202]["spans"] and not got[5]["spans"]
    assert rows(chunk_dedup.duplicate_spans(nothing)) == [] and rows(chunk_dedup.remove_duplicates(nothing)) == []
    every = {r["doc_id"]: r for r in chunk_dedup.duplicate_spans(docs, least_run=0).collect()}
    for d, _ in order:
        if d not in (4, 5):
            assert sum(s["past"] - s["first"] for s in every[None if d < 0 else d]["spans"]) == sum(b - a for a, b in expected[d])
    cut = chunk_dedup.remove_duplicates(docs)
    assert cut.columns == docs.columns and cut.count() == docs.count()
    text_of = {r["doc_id"]: r["text"] for r in docs.collect()}
    for r in cut.collect():
        raw, at, kept = (text_of[r["doc_id"]] or "").encode(), 0, []
        for s in got[r["doc_id"]]["spans"]:
            kept.append(raw[at : s["first"]])
            at = s["past"]
        assert (r["text"] or "") == "".join(k.decode(errors="ignore") for k in [*kept, raw[at:]])
    assert CLASH

def test_passages_of_just_over_fifty_words_are_found(spark):
    """Passages of 51 to 70 words, 6.2 bytes a word, in two otherwise different documents."""
    rng = np.random.default_rng(9)
    text = lambda n: b" ".join(bytes(rng.integers(97, 123, rng.integers(3, 9)).astype(np.uint8)) for _ in range(n // 3))[:n].decode()
    passages = [text(int(words * 6.2)) for words in range(51, 71) for _ in range(10)]
    docs = frame(spark, [(2 * i + late, text(400 + 77 * late) + p + text(300)) for i, p in enumerate(passages) for late in (0, 1)])
    got = {r["doc_id"]: r["spans"] for r in chunk_dedup.duplicate_spans(docs).collect()}
    assert not any(got[2 * i] for i in range(len(passages)))
    assert sum(bool(got[2 * i + 1]) for i in range(len(passages))) >= 0.97 * len(passages)

