import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from graphleaf.functions import text as X
from graphleaf.functions.calculate import calculate_column, evaluate
from graphleaf.functions.fuzzy import partial_ratio, ratio, wratio, wratio_column


def values(spark, texts, expression):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", expression(F.col("t")).alias("v")).orderBy("i").collect()
    return [r["v"] for r in rows]


def chunked(text, size, overlap):
    out, at = [], 0
    while text:
        out.append(text[at : at + size])
        if at + size >= len(text):
            break
        at += size - overlap
    return out


def test_chunks(spark):
    texts = ["", "a" * 500, "b" * 501, "c" * 960, "d" * 961, None, "é" * 1500]
    assert [len(v) for v in values(spark, texts, X.chunks)] == [0, 1, 2, 2, 3, 0, 4]
    assert values(spark, texts, X.chunk_count)[:5] == [0, 1, 2, 2, 3]
    mixed = ["".join(chr(97 + i * 7 % 26) for i in range(n)) for n in range(0, 60)]
    assert values(spark, mixed, lambda c: X.chunks(c, 10, 3)) == [chunked(t, 10, 3) for t in mixed]


@pytest.mark.parametrize(("size", "overlap"), [(0, 0), (-1, 0), (5, 5), (5, 6), (5, -1)])
def test_chunk_arguments(size, overlap):
    with pytest.raises(ValueError):
        X.check_chunking(size, overlap)


def test_titles(spark):
    assert values(spark, [" A_b\n", " x\r\ny ", ""], X.canon_title) == ["A b", "x  y", ""]
    raw = "https://en.x.org/wiki/A%20b_c#frag,http://x.org/wiki/C+D,;\nhttps://x.org/no https://x.org/wiki/100%?q=1"
    assert values(spark, [raw, ""], X.article_titles) == [["A b c", "C+D", "100%"], []]


def spans(text):
    """Infobox spans by walking the marks, the plain way."""
    out, at = [], text.find("{{Infobox")
    while at >= 0:
        opens, pos, k = 0, at, 0
        parts = text[at:].split("}}")
        for k, p in enumerate(parts[:-1]):
            opens += p.count("{{")
            pos += len(p) + 2
            if opens == k + 1:
                out.append(text[at:pos])
                break
        at = text.find("{{Infobox", at + 9)
    return out


def test_infoboxes(spark):
    texts = ["{{Infobox a|{{b}}|{{c|{{d}}}}}} x {{Infobox e}} {{Infobox open", "{{Infobox a {{Infobox b}} }}", "{{{Infobox x}}}", "none", "", "}} {{Infobox a}}", "{{Infobox}}{{Infobox {{x}} {{Infobox y}}"]
    assert values(spark, texts, X.infoboxes) == [spans(t) for t in texts]


def test_headings(spark):
    assert values(spark, ["== A ==\nx\n === B=== \n=", "x == y ==", ""], X.headings) == [["A", "B"], [], []]


def test_ids_and_counts(spark):
    assert values(spark, ["article:7:s1:p2", "article:9", "x"], X.article_of) == ["article:7", "article:9", None]
    rows = spark.createDataFrame([(5,), (1500,), (2_000_000,), (3_100_000_000,)], "n long").select(X.short_count(F.col("n")).alias("v")).collect()
    assert [r["v"] for r in rows] == ["5", "1.5k", "2.0M", "3.1B"]
    assert [r["v"] for r in spark.createDataFrame([([1e-5, 0.5],)], "v array<double>").select(X.vector_text(F.col("v")).alias("v")).collect()] == ["1.0e-05;0.5"]


@pytest.mark.parametrize(("text", "value"), [("3**49", 3**49), ("log(1000, 10)", math.log(1000, 10)), ("7 // 2", 3), ("-2 + min(3, 4) % 2", -1), ("round(pi, 2)", 3.14), ("gcd(12, 18)", 6), ("max(1, 2.5)", 2.5)])
def test_calculate(text, value):
    assert evaluate(text) == value


@pytest.mark.parametrize("text", ["__import__('os')", "(1).__class__", "9**9**9", "factorial(10**9)", "open('x')", "'a'*9", "x", "1 if 2 else 3", "", "lambda: 1"])
def test_calculate_refuses(text):
    with pytest.raises((ValueError, SyntaxError)):
        evaluate(text)


def test_calculate_column(spark):
    assert values(spark, ["1+1", "nope(", None], calculate_column) == ["2", None, None]


def common_by_table(a, b):
    """Longest common subsequence by the usual table."""
    rows = [[0] * (len(b) + 1)]
    for x in a:
        row = [0]
        for j, y in enumerate(b):
            row.append(rows[-1][j] + 1 if x == y else max(rows[-1][j + 1], row[-1]))
        rows.append(row)
    return rows[-1][-1]


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_likeness_by_a_table(a, b):
    plain = lambda x, y: 200 * common_by_table(x, y) / (len(x) + len(y)) if x or y else 100
    assert ratio(a, b) == pytest.approx(plain(a, b))
    if a and b:
        short, long = sorted((a, b), key=len)
        windows = {long[i:j] for i in range(len(long)) for j in range(i + 1, min(len(long), i + len(short)) + 1) if j - i == len(short) or i == 0 or j == len(long)}
        best = max(plain(short, w) for w in windows)
        if len(a) == len(b):
            best = max(best, max(plain(long, short[i:j]) for i in range(len(short)) for j in range(i + 1, len(short) + 1) if i == 0 or j == len(short)))
        assert partial_ratio(a, b) == pytest.approx(best)


def test_wratio():
    assert wratio("abc", "abc") == 100 and wratio("", "a") == 0 and wratio(None, "a") == 0
    assert ratio("this is a test", "this is a test!") == pytest.approx(96.551724)
    assert partial_ratio("this is a test", "this is a test!") == 100
    assert wratio("fuzzy wuzzy was a bear", "wuzzy fuzzy was a bear") == pytest.approx(95.0)


@given(st.text("abc ", max_size=12), st.text("abc ", max_size=12))
def test_wratio_is_symmetric(a, b):
    assert wratio(a, b) == pytest.approx(wratio(b, a)) and 0 <= wratio(a, b) <= 100


def test_wratio_column(spark):
    assert values(spark, ["New York", None], lambda c: wratio_column(c, F.lit("york new"))) == [pytest.approx(wratio("New York", "york new")), 0.0]


def test_many_infoboxes_in_one_text(spark):
    flat = "".join(f"{{{{Infobox {i}|{{{{x}}}}}}}} " for i in range(10_000)) + "{{Infobox open {{"
    nested = "{{Infobox a" * 300 + "}}" * 299
    got = spark.createDataFrame([(flat,), (nested,), (None,)], "t string").select(F.size(X.infoboxes(F.col("t"))).alias("n")).collect()
    assert [r["n"] for r in got] == [10_000, 299, 0]
