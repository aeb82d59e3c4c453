"""Clusters, neighbours and the divergence of sources: SQL, plain programs and given cases."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from graphleaf.llm import centroids, divergence, neighbours, queries
from llm_helpers import prose


def rows(df):
    return [tuple(r) for r in df.collect()]


# --- 11: centroids

def integers(vector, length, scale):
    if vector is None or len(vector) != length or any(x is None or not math.isfinite(x) for x in vector):
        return None
    return [math.floor(scale * x) for x in vector]


def plain_clusters(data, k, rounds, length, scale):
    kept = [(i, q) for i, v in data if (q := integers(v, length, scale))]
    def key(row):
        return hashlib.sha256(f"1:{'' if row[0] is None else row[0]}".encode()).hexdigest(), row[1]
    c = [q for _, q in sorted(kept, key=key)[:k]]
    def far(q, m):
        return sum((a - b) ** 2 for a, b in zip(q, m, strict=True))
    def nearest(q):
        return min((far(q, m), n) for n, m in enumerate(c))
    for _ in range(rounds):
        own = defaultdict(list)
        for _, q in kept:
            own[nearest(q)[1]].append(q)
        c = [[sum(x) // len(own[n]) for x in zip(*own[n], strict=True)] if own[n] else m for n, m in enumerate(c)]
    found = [(i, *nearest(q)) for i, q in kept]
    inside, most = Counter(), (1 << 63) - 1
    for _, d, n in found:
        inside[n] += d
    return Counter((i, n, min(d, most), min(inside[n], most), min(sum(inside.values()), most), hashlib.sha256(",".join(map(str, c[n])).encode()).hexdigest()) for i, d, n in found)


HARD = [None, [], [1.0, 2.0], [1.0, None, 2.0], [1.0, float("nan"), 0.0], [float("inf"), 0.0, 0.0], [0.0] * 3, [-(2.0**-10), 0.0, 0.0]]


def vectors_frame(spark, data, kind="float"):
    return spark.createDataFrame([(i, v, "own", 7, "own") for i, v in data], f"vec_id long, embedding array<{kind}>, cluster string, distance int, rank string")


@pytest.mark.parametrize("wide", [False, True])
def test_clusters_of_hard_rows(spark, wide):
    rng = np.random.default_rng(5)
    data = [(i, [float(np.float32(x)) for x in rng.normal(0, 3, 3)]) for i in range(150)] + [(1000 + i, v) for i, v in enumerate(HARD)]
    data += [(7, [1.0, 1.0, 1.0])] * 40 + [(None, [2.0, 2.0, 2.0]), (None, [0.5, 0.5, -0.5])]
    if wide:  # distances beyond 64 bits, components at the end of float32's range
        data += [(2000 + i, [float(np.float32(x)) for x in rng.choice([-1, 1], 3) * 10.0 ** rng.uniform(5, 38, 3)]) for i in range(60)]
    out = centroids.cluster(vectors_frame(spark, data), k=6, length=3, scale=64)
    assert out.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert Counter(rows(out)) == plain_clusters(data, 6, 3, 3, 64)


def test_few_and_no_vectors(spark):
    few = [(1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None)]
    assert Counter(rows(centroids.cluster(vectors_frame(spark, few), length=2))) == plain_clusters(few, 16, 3, 2, 64)
    none = centroids.cluster(vectors_frame(spark, few[2:]), length=2)
    assert none.collect() == [] and none.columns[-1] == "centroid_sha256"


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.sampled_from([2, 1000, 2**24, 2**40, 2**120]), st.integers(1, 90))
def test_screening_keeps_the_nearest(seed, size, length):
    """Ties and near ties of vectors of any size: the shortlist always holds the exact nearest."""
    rng = random.Random(seed)
    base = [rng.randint(-size, size) for _ in range(length)]
    near = lambda: [b + rng.choice([-1, 0, 0, 1]) for b in base]
    c = [near() for _ in range(9)] + [[rng.randint(-size, size) for _ in range(length)] for _ in range(3)]
    q = np.array([[float(x) for x in near()] for _ in range(20)])
    exact = [[sum((int(x) - y) ** 2 for x, y in zip(row, m, strict=True)) for m in c] for row in q.tolist()]
    assert centroids.Centroids(c).nearest(q).tolist() == [d.index(min(d)) for d in exact]


def test_screening_saves_work():
    rng = np.random.default_rng(2)
    q = np.floor(rng.normal(0, 8, (2000, 64)))
    left = centroids.Centroids(q[:16].astype(int).tolist()).candidates(q)
    assert left.any(1).all() and left.sum() < 1.1 * len(q)


# --- 12: sources

def plain_divergence(docs, least, terms):
    groups, held, counts = set(), Counter(), Counter()
    for text, lang, source in docs:
        text, lang, source = text or "", lang or "", source or ""
        words = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text))
        groups.add((lang, source))
        held.update((lang, w) for w in set(words))
        counts.update((lang, source, w) for w in words)
    out = []
    for lang in {g[0] for g in groups}:
        sources = sorted(s for g, s in groups if g == lang)
        kept = [w for (g, w), n in held.items() if g == lang and n >= least]
        n = {s: sum(counts[lang, s, w] for w in kept) for s in sources}
        def p(count, total):
            return 1 + 10**9 * (count + 5) // (total + 5 * len(kept))
        own = {s: {w: p(counts[lang, s, w], n[s]) for w in kept} for s in sources}
        whole = {w: p(sum(counts[lang, s, w] for s in sources), sum(n.values())) for w in kept}
        for s in sources:
            pair = [(o, sum(abs(own[s][w] - own[o][w]) for w in kept)) for o in sources if o != s]
            more = [(w, own[s][w] - whole[w]) for w in kept if counts[lang, s, w] and own[s][w] > whole[w]]
            for part, found, most in (("pair", pair, len(pair)), ("term", more, terms)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(ranked)]
    return Counter(out)


def test_divergence_of_hard_rows(spark, hard):
    rng = random.Random(3)
    docs = [(prose(i, rng.randrange(120)), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "ü", "B", None])) for i in range(120)]
    docs += [(None, "en", "empty"), ("", "fr", "empty"), ("1 2 !", "xx", "alone"), ("Ähre ÄHRE ähre A\x00a", "yy", "u"), ("𝒳 a", "yy", "v"), (prose(9, 30_000), "en", "a")] + [("same same Same", "en", "b")] * 50
    frame = spark.createDataFrame([(t, g, s, "own", 1, "own") for t, g, s in docs], "text string, lang string, source string, term string, n int, words string")
    for least, terms in ((30, 50), (1, 3), (10_000, 5)):
        assert Counter(rows(divergence.divergence(frame, least, terms))) == plain_divergence(docs, least, terms)
    own = [(r["text"], r["lang"], r["source"]) for r in hard.collect()]
    assert Counter(rows(divergence.divergence(hard, 2))) == plain_divergence(own, 2, 50)
    assert divergence.divergence(frame.limit(0)).collect() == []


def test_shares_are_exact(spark):
    rng = random.Random(1)
    pairs = [(c, c + rng.choice([5, 6, 10**3, 10**9, 10**15])) for c in [0, 1, 10**6, 10**15, *[rng.randrange(10**rng.randrange(1, 15)) for _ in range(200)]]]
    got = spark.createDataFrame(pairs, "c long, d long").select("c", "d", divergence.share(*map(__import__("pyspark").sql.functions.col, "cd"))).collect()
    assert all(p == 1 + 10**9 * (c + 5) // d for c, d, p in got)


# --- 13: neighbours

def plain_neighbours(data, every, k):
    width = max((len(v) for _, v in data if v), default=1)
    use = [(i, np.array(v + [0.0] * (width - len(v)))) for i, v in data if i is not None and v and all(x is not None and math.isfinite(x) for x in v) and any(v)]
    out = {}
    for a, x in use:
        if a % every == 0:
            best = out.setdefault(a, {})
            for b, y in use:
                if a != b:
                    best[b] = max(best.get(b, -math.inf), float((x * y).sum()))
    return {a: sorted(best.items(), key=lambda m: (-m[1], m[0]))[:k] for a, best in out.items() if best}


def as_lists(df):
    out = defaultdict(dict)
    for r in df.collect():
        out[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    assert all(sorted(m) == list(range(1, len(m) + 1)) for m in out.values())
    return {a: [m[n] for n in sorted(m)] for a, m in out.items()}


def recall(got, expected):
    """The share of places filled by a row as near as the true one."""
    return sum(x[1] >= e[-1][1] - 1e-12 for q, e in expected.items() for x in got.get(q, [])) / sum(map(len, expected.values()))


def test_recall_against_brute_force(spark):
    table = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    data = [(r["vec_id"], list(r["embedding"])) for r in table.collect()]
    expected = plain_neighbours(data, 20, 20)
    got = as_lists(queries.QUERIES["op13_nearest_neighbours"](spark, "/root/testdata/sf0.1"))
    assert {q: len(m) for q, m in got.items()} == {q: 20 for q in expected}
    assert recall(got, expected) >= 0.93
    x = {i: np.array(v) for i, v in data}
    assert all(s == float((x[q] * x[v]).sum()) for q, m in got.items() for v, s in m) and all(m == sorted(m, key=lambda p: (-p[1], p[0])) for m in got.values())
    assert as_lists(neighbours.exact(table)) == expected


@pytest.mark.parametrize("kind", ["float", "double"])
def test_neighbours_of_hard_rows(spark, kind, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK_COMPONENTS", 600)  # several blocks, and buckets that are split
    rng = np.random.default_rng(8)
    data = [(i, rng.normal(0, 1 + i % 3, 8).round(2).astype(np.float32).astype(float).tolist()) for i in range(300)]
    same = rng.normal(0, 1, 8).astype(np.float32).astype(float).tolist()
    data += [(1000 + i, same) for i in range(400)] + [(40, same), (40, same), (60, [9.0, 1.0]), (61, [1.0] * 3), (-20, [0.5] * 8), (None, same)]
    data += [(2000 + 20 * i, v) for i, v in enumerate(HARD)]
    expected = plain_neighbours(data, 20, 20)
    frame = vectors_frame(spark, data, kind)
    assert as_lists(neighbours.exact(frame)) == expected
    got = as_lists(neighbours.nearest(frame))
    assert {q: len(m) for q, m in got.items()} == {q: len(m) for q, m in expected.items()} and recall(got, expected) > 0.9


def test_few_and_no_neighbours(spark):
    few = [(0, [1.0, 0.0]), (1, [-1.0, 0.0]), (2, [0.0, 1.0]), (20, [0.5, 0.5])]
    assert as_lists(neighbours.nearest(vectors_frame(spark, few))) == plain_neighbours(few, 20, 20)
    for data in (few[:1], few[1:3], [(0, None)]):
        assert neighbours.nearest(vectors_frame(spark, data)).collect() == []
    assert neighbours.nearest(vectors_frame(spark, few).limit(0)).columns == ["query_id", "rank", "vec_id", "score"]


def test_hashes_do_not_depend_on_company():
    rng = np.random.default_rng(4)
    x = rng.normal(0, 1, (500, 48))
    for joined in (1, 2):
        kind = neighbours.Kind(neighbours.Rotations(48), joined)
        whole = kind.codes(x, 1)
        assert (whole == [kind.codes(one[None], 1)[0] for one in x]).all() and (kind.scores(x, 1).argmax(1) == whole).all()




def test_terms_of_long_documents(monkeypatch):
    monkeypatch.setattr(divergence, "PIECE", 40)
    for text in (prose(3, 300), "x" * 130 + " é " + "y" * 41 + "!", "1" * 100, "ab" * 20 + " " + "ab" * 20, ""):
        terms, n = divergence.long_counted(np.frombuffer(text.encode(), np.uint8)) if text else ([], [])
        assert Counter(dict(zip([str(t) for t in terms], map(int, n), strict=True))) == Counter(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text.lower()))
