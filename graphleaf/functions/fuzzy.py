"""A weighted string likeness from longest common subsequences (WRatio), for use after candidates are few."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN_SCALE, PARTIAL_SCALE, FAR_PARTIAL_SCALE = 0.95, 0.9, 0.6


def _common(a: str, b: str) -> int:
    """Length of the longest common subsequence, a column of bits for each character of ``b``."""
    where: dict[str, int] = {}
    for i, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << i
    full = (1 << len(a)) - 1
    s = full
    for c in b:
        u = s & where.get(c, 0)
        s = ((s + u) | (s - u)) & full
    return len(a) - s.bit_count()


def ratio(a: str, b: str) -> float:
    """200 * common / both lengths; 100 for two empty strings."""
    total = len(a) + len(b)
    return 200.0 * _common(a, b) / total if total else 100.0


def partial_ratio(a: str, b: str) -> float:
    """The best ``ratio`` of the shorter string with a part of the longer no longer than itself."""
    short, long = sorted((a, b), key=len)
    if not short:
        return 100.0 if not long else 0.0
    n = len(short)
    parts = [long[max(0, i) : i + n] for i in range(1 - n, len(long))]
    best = max(ratio(short, p) for p in parts)
    if len(a) == len(b):
        best = max(best, *(ratio(long, short[max(0, i) : i + n]) for i in range(1 - n, n)))
    return best


def _token_parts(a: str, b: str) -> tuple[str, str, str, set[str]]:
    x, y = set(a.split()), set(b.split())
    both = x & y
    return " ".join(sorted(both)), " ".join(sorted(x - y)), " ".join(sorted(y - x)), both


def token_ratio(a: str, b: str) -> float:
    """The larger of the likeness of sorted words and that of common and other words."""
    by_sort = ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split())))
    same, left, right, both = _token_parts(a, b)
    if both and not (left and right):
        return 100.0
    with_left, with_right = f"{same} {left}".strip(), f"{same} {right}".strip()
    by_set = ratio(with_left, with_right)
    if same:
        by_set = max(by_set, ratio(same, with_left), ratio(same, with_right))
    return max(by_sort, by_set)


def partial_token_ratio(a: str, b: str) -> float:
    _, left, right, both = _token_parts(a, b)
    if both:
        return 100.0
    return max(partial_ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))), partial_ratio(left, right))


def wratio(a: str | None, b: str | None) -> float:
    """0 to 100; 0 if either is empty or null."""
    if not a or not b:
        return 0.0
    far = max(len(a), len(b)) / min(len(a), len(b))
    score = ratio(a, b)
    if far < 1.5:
        return max(score, token_ratio(a, b) * TOKEN_SCALE)
    scale = PARTIAL_SCALE if far <= 8 else FAR_PARTIAL_SCALE
    return max(score, partial_ratio(a, b) * scale, partial_token_ratio(a, b) * TOKEN_SCALE * scale)


def _bags(texts: list[str]) -> np.ndarray:
    """How often each of 64 classes of characters occurs in each text: common characters are no fewer in classes."""
    out = np.zeros((len(texts), 64), np.int32)
    for row, text in zip(out, texts, strict=True):
        row += np.bincount(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64).astype(np.int32)
    return out


def _bound(a: str, x: set[str], b: str, common: int) -> float:
    """What ``wratio`` of two strings with ``common`` common characters (x: the words of ``a``) cannot exceed."""
    if not a or not b:
        return 0.0
    if " ".join(a.split()) != a or " ".join(b.split()) != b:
        return 100.0  # white space that joining words changes
    short, total = min(len(a), len(b)), len(a) + len(b)
    y = set(b.split(" "))
    same, left, right = x & y, x - y, y - x
    size = lambda words: sum(map(len, words)) + max(0, len(words) - 1)
    by_bag = 200.0 * common / total
    if max(len(a), len(b)) / short < 1.5:
        if same and not (left and right):
            return 100.0 * TOKEN_SCALE if by_bag < 100.0 * TOKEN_SCALE else by_bag
        with_left, with_right = size(same | left), size(same | right)
        by_set = 200.0 * min(common, with_left, with_right) / max(1, with_left + with_right)
        if same:
            by_set = max(by_set, *(200.0 * size(same) / (size(same) + w) for w in (with_left, with_right)))
        return max(by_bag, max(by_bag, by_set) * TOKEN_SCALE)
    scale = PARTIAL_SCALE if max(len(a), len(b)) / short <= 8 else FAR_PARTIAL_SCALE
    part = lambda n: 200.0 * min(common, n) / max(1, n + min(common, n))
    by_words = 100.0 if same else max(part(short), part(min(size(left), size(right))))
    return max(by_bag, part(short) * scale, by_words * TOKEN_SCALE * scale)


def best_match(query: str, titles: list[str], further: list[tuple]) -> tuple[int, float, int]:
    """The number and likeness of the likest title, equal ones by length next to the query's, then by the greatest of ``further``; and how many were compared.

    Titles are taken in the order of what their likeness cannot exceed, until that is below the best found."""
    common = np.minimum(_bags(titles), _bags([query])).sum(1).tolist()
    x = set(query.split(" "))
    bounds = [_bound(query, x, t, c) for t, c in zip(titles, common, strict=True)]
    best, at, compared = (-1.0,), -1, 0
    for i in sorted(range(len(titles)), key=lambda i: -bounds[i]):
        if bounds[i] + 1e-9 < best[0]:
            break
        compared += 1
        own = (wratio(query, titles[i]), -abs(len(titles[i]) - len(query)), *further[i])
        if own > best:
            best, at = own, i
    return at, best[0], compared


def _wratios(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([wratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def wratio_column(a: Column | str, b: Column | str) -> Column:
    return F.pandas_udf(_wratios, "double")(a, b)
