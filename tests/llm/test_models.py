"""Fitted and sketched operators: held-out accuracy, plain programs and given cases."""

import hashlib
import random
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphleaf.llm import fingerprints, near_dedup, quality, queries, toxicity
from graphleaf.llm.labelled import training_texts
from llm_helpers import frame, prose


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- 4 and 7: classifiers

@pytest.fixture(scope="module")
def labels(spark):
    return spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def accuracy(spark, name, label, labels, least):
    out = queries.QUERIES[name](spark, "/root/testdata/sf0.1").join(labels, "doc_id").filter("held_out").select("score", "predicted", label).toPandas()
    rank = out["score"].rank().to_numpy()
    y = out[label].to_numpy()
    auc = (rank[y == 1].sum() - y.sum() * (y.sum() + 1) / 2) / (y.sum() * (1 - y).sum())
    assert auc > least and (out["predicted"] == out[label]).mean() > 0.95
    return out


def test_toxicity_on_held_out_rows(spark, labels):
    out = accuracy(spark, "op4_toxicity", "toxic", labels, 0.95)
    assert out[out.toxic == 0]["predicted"].mean() < 0.01


def test_quality_on_held_out_rows(spark, labels):
    accuracy(spark, "op7_quality", "quality", labels, 0.98)


def test_held_out_rows_are_not_learned(spark):
    docs = frame(spark, [(i, f"text {i}") for i in range(50)] + [(None, "no id"), (3, "another")])
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(3, 1), (None, 1), (7, None)], "doc_id long, toxic int")
    texts, y = training_texts(docs, labels, "toxic", 1000, 100)
    assert texts == [("another" if i == 3 else f"text {i}") for i in range(50) if zlib.crc32(str(i).encode()) % 5]
    assert len(training_texts(docs, labels, "toxic", 7, 100)[0]) == 7 and training_texts(docs, labels, "toxic", 9, 3) == ([], [])
    assert set(y) == {0, 1}


def test_toxicity_of_hard_texts(hard, nothing):
    clean = [prose(i, 60) for i in range(60)]
    bad = [prose(i, 30) + " vile" + "abcd"[i % 4] + ". " + prose(i + 500, 30) for i in range(60, 100)]
    model = toxicity.fit(clean + bad, [0] * 60 + [1] * 40)
    scorer = toxicity.Scorer(*model)
    score, worst, _ = scorer.score(prose(900, 30) + ". " + prose(901, 30) + " vileb. " + prose(902, 30))
    assert score > 0.5 and "vileb" in list(toxicity.sentences(prose(900, 30) + ". " + prose(901, 30) + " vileb. " + prose(902, 30)))[worst]
    assert scorer.score(prose(903, 90))[0] < 0.5
    out = toxicity.score(hard, model)
    by = {r["doc_id"]: r for r in out.collect()}
    assert out.count() == 16 and by[0]["toxicity"] == by[1]["toxicity"] == by[2]["toxicity"] == 0 and by[0]["worst_sentence"] == -1
    assert rows(toxicity.score(nothing, model)) == [] and toxicity.remove_toxic(hard, model).columns == hard.columns
    for y in ([], [0, 0], [1, 1]):
        assert 0 <= toxicity.Scorer(*toxicity.fit(["a b"] * len(y), y)).score("a b c")[0] <= 1


@pytest.mark.parametrize("letters", [5, 63, 64, 3000])
def test_words_of_any_length_count(letters):
    word = "q" * letters
    texts = [prose(i, 60) for i in range(40)] + [prose(i, 30) + f" {word} " + prose(i + 500, 30) for i in range(40, 80)]
    scorer = toxicity.Scorer(*toxicity.fit(texts, [0] * 40 + [1] * 40))
    assert scorer.score(prose(900, 30) + f" {word} " + prose(901, 30))[0] > 0.9 and scorer.score(prose(902, 60))[0] < 0.5


@given(st.lists(st.lists(st.sampled_from(["a", "bcd", "vile", "vilest", "x" * 70]), min_size=8, max_size=12), max_size=6), st.integers(0, 9))
def test_scores_are_the_noisy_or_of_sentences(bags, seed):
    weights, bias = np.random.default_rng(seed).normal(size=toxicity.BUCKETS), -2.0
    missed, each = 1.0, []
    for words in bags:
        z = bias + sum(weights[b] for w in set(words) for b in toxicity.features(w))
        each.append(1 / (1 + np.exp(-z)))
        missed *= 1 - each[-1]
    score, at, worst = toxicity.Scorer(weights, bias).score(". ".join(" ".join(w) for w in bags))
    assert np.isclose(score, 1 - missed, atol=1e-9) and (not each or np.isclose(worst, max(each)) and np.isclose(each[at], max(each)))


def test_the_sample_holds_short_texts_only_and_is_full(spark):
    docs = frame(spark, [(i, "long " * 9 if i % 2 else "short") for i in range(100)])
    labels = spark.createDataFrame([(i, 1) for i in range(100)], "doc_id long, toxic int")
    assert training_texts(docs, labels, "toxic", 20, 10)[0] == ["short"] * 20


@pytest.mark.parametrize("module, label, most", [(toxicity, "toxic", 12e6), (quality, "quality", 3e6)])
def test_only_the_model_reaches_the_driver(spark, module, label, most):
    docs = spark.range(2_000).select(F.col("id").alias("doc_id"), F.concat(F.repeat(F.concat(F.lit("word"), F.col("id") % 7, F.lit(" and more. ")), 250), F.when(F.col("id") % 3 == 0, "vile").otherwise("")).alias("text"))
    labels = spark.range(2_000).select(F.col("id").alias("doc_id"), (F.col("id") % 3 == 0).cast("int").alias(label))
    tracemalloc.start()
    try:
        model = module.trained(docs, labels)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < most  # the sample's texts collected and fitted in the driver took 33 and 10 MB
    texts, y = training_texts(docs, labels, label, 6_000, 16_384)
    assert len(texts) > 1_500 and sum(map(len, texts)) > 5e6
    mine = toxicity.fit(texts, y) if module is toxicity else quality.fit_texts(texts, y)
    pairs = zip(model, mine, strict=True) if module is toxicity else ((model[k], mine[k]) for k in mine)
    assert all(np.array_equal(a, b) for a, b in pairs)
    assert module.trained(docs.limit(0), labels) is not None


def test_the_first_split_is_the_best_of_all():
    rng = np.random.default_rng(4)
    x = rng.integers(0, 12, (300, 4)).astype(float)
    y = (x[:, 2] > 6).astype(float)
    y[:20] = 1 - y[:20]
    model = quality.fit(x, y)
    p = y.mean()
    best = None
    for s in range(4):
        for c in np.unique(x[:, s])[:-1]:
            low = x[:, s] <= c
            if min(low.sum(), (~low).sum()) < quality.LEAST_ROWS:
                continue
            gain = sum((p - y[part]).sum() ** 2 / (part.sum() * p * (1 - p) + quality.RIDGE) for part in (low, ~low))
            best = max(best or (gain, s, c), (gain, s, c))
    assert model["statistic"][0][0] == best[1] == 2 and best[2] <= model["cut"][0][0] < best[2] + 1


def test_statistics_by_a_plain_program():
    text = "One two, two THREE!\n\nfour (5) ö-ö\nOne two"
    got = dict(zip(quality.STATISTICS, quality.statistics(text), strict=True))
    raw = text.encode()
    for name, chars in quality._KINDS.items():
        assert np.isclose(got[f"{name}_share"], sum(b in chars for b in raw) / len(raw))
    share = [raw.count(bytes([b])) / len(raw) for b in set(raw)]
    assert np.isclose(got["byte_entropy"], -sum(s * np.log2(s) for s in share)) or np.isclose(got["byte_entropy"], -sum(s * np.log(s) for s in share))
    assert quality.statistics("") == [0.0] * len(quality.STATISTICS)


def test_trees_split_and_predict_alike():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(800, 5))
    y = ((x[:, 1] > 0.3) ^ (x[:, 3] > 0)).astype(float)
    model = quality.fit(x, y)
    score = quality.predict(model, x)
    assert ((score > 0.5) == y).mean() > 0.97

    def one(row):
        raw = model["base"][0]
        for s, c, leaf in zip(model["statistic"], model["cut"], model["leaf"], strict=True):
            node = 0
            while node < len(s):
                node = 2 * node + 1 + int(row[s[node]] > c[node])
            raw += leaf[node - len(s)]
        return 1 / (1 + np.exp(-raw))

    assert np.allclose([one(r) for r in x[:50]], score[:50])
    for few in (x[:0], x[:3]):
        assert np.isfinite(quality.predict(quality.fit(few, np.ones(len(few))), x[:2])).all()


def test_quality_of_hard_texts(hard, nothing):
    model = quality.fit(np.array([quality.statistics(prose(i, 50)) for i in range(30)] + [quality.statistics("x " * i) for i in range(1, 31)]), np.repeat([1.0, 0.0], 30))
    out = quality.score(hard, model).collect()
    assert len(out) == 16 and all(0 <= r["quality"] <= 1 for r in out) and rows(quality.score(nothing, model)) == []
    assert len(quality.statistics("a b")) == len(quality.STATISTICS) == len(quality.statistics(""))


# --- 8: fingerprints

def test_frequencies_and_band(spark, hard):
    got = {r["term"]: r["df"] for r in fingerprints.document_frequencies(hard).collect()}
    plain = Counter()
    for r in hard.collect():
        text = "".join(c.lower() if c.isascii() and (c.isalnum()) else c if not c.isascii() else " " for c in r["text"] or "")
        plain.update(set(text.split()))
    assert sorted(got.values()) == sorted(plain.values())
    n = hard.count()
    band = fingerprints.lexicon(hard, np.log(n / 6.5), np.log(n / 1.5))
    assert len(band) == sum(2 <= v <= 6 for v in plain.values())


def test_edited_texts_and_followers(spark, hard, nothing):
    docs = hard.select("doc_id", "text").filter("doc_id is not null").dropDuplicates(["doc_id"]).union(spark.createDataFrame([(100 + i, prose(i, 40)) for i in range(60)], "doc_id long, text string"))
    fingerprints_of = fingerprints.compare_with_following(docs, fingerprints.lexicon(docs))
    for size in (fingerprints.RANGE_BYTES, 5000):
        fingerprints.RANGE_BYTES, kept = size, fingerprints.RANGE_BYTES
        try:
            out = {r["doc_id"]: r for r in fingerprints.compare_with_following(docs, fingerprints.lexicon(docs)).collect()}
        finally:
            fingerprints.RANGE_BYTES = kept
        texts = sorted((r["doc_id"], r["text"] or "") for r in docs.collect())
        assert len(out) == len(texts) == fingerprints_of.count()
        for (d, text), (_, after) in zip(texts, texts[1:] + texts[:1], strict=True):
            k = len(text) // 4
            assert out[d]["n_chars"] == len(text) and out[d]["edited_sha256"] == hashlib.sha256((text[: len(text) - k] + after[:k]).encode()).hexdigest()
            assert out[d]["near_next"] == 1 or text != after
    assert len({out[20 + i]["fingerprint"] for i in range(5)}) == 1 and out[20]["near_next"] == 1 and out[0]["near_next"] == 1
    assert np.mean([r["near_edited"] for d, r in out.items() if d >= 100]) > 0.3 > np.mean([r["near_next"] for d, r in out.items() if d >= 100])
    assert rows(fingerprints.compare_with_following(nothing.select("doc_id", "text"), np.zeros(0, np.uint64))) == []
    whole = fingerprints.compare_with_following(hard.select("doc_id", "text"), np.zeros(0, np.uint64))
    assert whole.count() == 16 and len(fingerprints.fingerprint(hard, np.zeros(0, np.uint64)).collect()) == 16
    one = fingerprints.compare_with_following(hard.filter("doc_id = 3").select("doc_id", "text"), np.zeros(0, np.uint64)).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1 and len(fingerprints.lexicon(nothing)) == 0


def plain_fingerprint(words, terms):
    """Whole list and subsets of one text, with Python integers; ``terms``: hash of each term of the lexicon."""
    top = (1 << 64) - 1

    def mixed(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & top
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & top
        return x ^ (x >> 31)

    own = sorted({w for w in words if w in terms} or set(words))
    if not own:
        return None, 0, [0] * 48
    level = len(own).bit_length() - 1
    subsets = []
    for density in (level + 1, level + 2):
        for k in range(24):
            seed = mixed((k + 1) * 0x9E3779B97F4A7C15 & top)
            members = [mixed(h ^ seed) for h in own]
            members = [m for m in members if m < (1 << 64) >> density]
            subsets.append(mixed(sum(map(mixed, members)) & top) >> 32 | 1 if members else 0)
    return tuple(own), level, subsets


def test_fingerprints_and_likeness_by_a_plain_program():
    base = [prose(i, n) for i, n in enumerate([0, 1, 2, 3, 7, 30, 31, 64, 500])]
    texts = base + [t[: len(t) - len(t) // 4] + prose(99, 40)[: len(t) // 4] for t in base] + [prose(50, 400)]
    raw = [t.encode() for t in texts]
    off = np.concatenate([[0], np.cumsum([len(r) for r in raw])])
    h, before = fingerprints.word_hashes(np.frombuffer(b"".join(raw), np.uint8), off)
    words = [h[a:b].tolist() for a, b in zip(before[:-1], before[1:], strict=True)]
    terms = sorted({w for own in words for w in own})[::2]
    got = fingerprints.fingerprints(np.frombuffer(b"".join(raw), np.uint8), off, np.array(terms, np.uint64))
    plain = [plain_fingerprint(w, set(terms)) for w in words]
    for row, (_, level, subsets) in zip(got.tolist(), plain, strict=True):
        assert row[2:] == [level, *subsets]
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(texts)), np.arange(len(texts))))
    for x, y, value in zip(i.tolist(), j.tolist(), fingerprints.likeness(got[i], got[j]).tolist(), strict=True):
        (whole, v, s), (other, w, t) = plain[x], plain[y]
        pairs = [(s[24 * a + k], t[24 * b + k]) for a in (0, 1) for b in (0, 1) if v + a == w + b for k in range(24)]
        some = [(a, b) for a, b in pairs if a or b]
        assert value == (1 if whole == other else sum(a == b for a, b in some) / max(1, len(some)))


# --- 10: near-duplicates

def distance(a, b):
    last = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            now.append(min(last[j] + 1, now[-1] + 1, last[j - 1] + (x != y)))
        last = now
    return last[-1]


@given(st.lists(st.integers(0, 3), max_size=14), st.lists(st.integers(0, 3), max_size=14), st.integers(0, 7))
@settings(max_examples=500)
def test_banded_distance(a, b, most):
    assert near_dedup.banded_distance(a, b, most) == min(distance(a, b), most + 1)


@given(st.lists(st.integers(0, 1), min_size=20, max_size=60), st.lists(st.tuples(st.integers(0, 59), st.integers(0, 2)), max_size=8), st.integers(0, 12))
@settings(max_examples=200)
def test_banded_distance_of_edited_sequences(a, edits, most):
    b = list(a)
    for at, kind in edits:
        if kind == 0 and at < len(b):
            b[at] = 2
        elif kind == 1 and at < len(b):
            del b[at]
        else:
            b.insert(at, 3)
    assert near_dedup.banded_distance(a, b, most) == min(distance(a, b), most + 1)


def edited(text, share, seed):
    rng = random.Random(seed)
    return " ".join(rng.choice([prose(seed * 97 + i, 1), ""]) if rng.random() < share else w for i, w in enumerate(text.split())).replace("  ", " ")


def classes_of(out):
    by = defaultdict(set)
    for r in out:
        by[r["class_id"]].add(r["doc_id"])
    return by


@pytest.mark.parametrize("block", [2000, 2])
def test_near_duplicates(spark, hard, nothing, monkeypatch, block):
    monkeypatch.setattr(near_dedup, "BLOCK_ROWS", block)
    bases = [(1000 + 10 * i, prose(200 + i, 60 + 12 * i)) for i in range(12)]
    near = [(d + k, edited(t, 0.06, d + k)) for d, t in bases for k in (1, 2, 3)]
    far = [(d + 9, edited(t, 0.5, d + 9)) for d, t in bases]
    out = near_dedup.near_classes(frame(spark, bases + near + far).union(hard)).collect()
    assert len(out) == 12 * 5 + 16
    by = classes_of(out)
    assert all(by[d] == {d, d + 1, d + 2, d + 3} and by[d + 9] == {d + 9} for d, _ in bases)
    assert by[20] == {20, 21, 22, 23, 24} and by[0] == {0, 1} and by[5] == {5} and by[None] == {None} and by[2] == {2}
    links = {r["doc_id"]: r["n_links"] for r in out}
    assert links[1000] > 0 and links[1009] == links[20] == links[5] == 0
    kept = near_dedup.one_of_each_class(hard)
    assert kept.columns == hard.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([0, 2, 3, 4, 5, 6, None, 7, 8, 20])
    assert rows(near_dedup.near_classes(nothing)) == [] and rows(near_dedup.one_of_each_class(nothing)) == []


def test_one_row_of_each_class_when_an_id_has_two_texts(spark):
    a, b, c = prose(900, 60), prose(901, 60), prose(902, 60)
    docs = frame(spark, [(1, a), (1, b), (2, a), (3, c), (3, c)])
    assert Counter(tuple(r) for r in near_dedup.one_of_each_class(docs).select("doc_id", "text").collect()) == Counter([(1, a), (1, b), (3, c)])


def test_classes_match_all_pairs(spark, sf):
    """Against the alignment of every pair of distinct texts with words in common."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter(F.length("text") < 6000)
    texts = {r["doc_id"]: near_words(r["text"]) for r in docs.collect()}
    ids, parent = sorted(texts), {}

    def root(x):
        while parent.get(x, x) != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            x, y = texts[a], texts[b]
            if min(len(x), len(y)) >= 0.8 * max(len(x), len(y)) and root(a) != root(b) and sum((Counter(x) & Counter(y)).values()) >= 0.8 * max(len(x), len(y)) and near_dedup.aligned(x, y):
                parent[root(b)] = root(a)
    expected = defaultdict(set)
    for d in ids:
        expected[root(d)].add(d)
    got = classes_of(near_dedup.near_classes(docs).collect())
    found = {frozenset(v) for v in got.values()}
    several = [v for v in expected.values() if len(v) > 1]
    assert several and sum(frozenset(v) in found for v in several) >= 0.97 * len(several)
    assert all(any(v <= e for e in expected.values()) for v in got.values())


@pytest.mark.parametrize(("words", "similarity"), [(n, s) for n in (10, 20, 40, 60, 100, 300) for s in (0.8, 0.85, 0.9, 0.95)])
def test_recall_by_similarity(words, similarity):
    """The share of pairs, apart by scattered substitutions, that meet in a table of their own, without a third text."""
    rng, pairs = random.Random(words), 300
    texts = []
    for _ in range(pairs):
        a = [f"w{rng.randrange(20_000)}" for _ in range(words)]
        b = list(a)
        for i in rng.sample(range(words), int((1 - similarity) * words + 1e-9)):
            b[i] = f"x{rng.randrange(20_000)}"
        assert near_dedup.aligned(a, b)
        texts += [" ".join(a).encode(), " ".join(b).encode()]
    _, keys = near_dedup.sketch(np.frombuffer(b"".join(texts), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in texts])]))
    assert ((keys[::2] == keys[1::2]) & (keys[::2] != 0)).any(1).mean() >= 0.9


def near_words(text):
    raw = np.frombuffer(text.encode(), np.uint8)
    h, _ = near_dedup.word_hashes(raw, np.array([0, len(raw)]))
    return (h >> np.uint64(32)).tolist()


def test_components(spark):
    rng = random.Random(5)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(35)] + [(100 + i, 101 + i) for i in range(30)]
    key = lambda n: n.to_bytes(2, "big")
    got = {r["node"]: r["label"] for r in near_dedup.components(spark.createDataFrame([(key(a), key(b)) for a, b in pairs], "a binary, b binary")).collect()}
    near = defaultdict(set)
    for a, b in pairs:
        near[a].add(b)
        near[b].add(a)
    for a in near:
        seen, todo = {a}, [a]
        while todo:
            for x in near[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        assert bytes(got[key(a)]) == key(min(seen))
    assert rows(near_dedup.components(spark.createDataFrame([], "a binary, b binary"))) == []
