"""Clusters around integer centroids, exact at the speed of float32.

A vector's components are scaled and floored to integers. To find its nearest centroid, all
products with the centroids are taken as one float32 matrix product of rows that powers of
two bring to a size of about 1. The error of such a product is at most gamma * |x| * |c|,
with gamma = n u / (1 - n u), u = 2**-24 and n two more than the number of components
(rounding either row to float32 counts as one more each), in whatever order the sum is
taken; norms are float64 and their own errors are added. So every squared distance lies in
a known interval. Centroids whose interval starts above the least upper end are out; where
one is left it is the nearest, and where several are, their distances are computed again
in integers, the lowest number winning a tie.

A round is one pass over the vectors: each task adds up its vectors for each centroid, and only
the sums, (centroids x components) numbers a task, are shuffled; the driver gets as many in all,
a number fixed by the parameters. Sums are kept in digits of 32 bits, so that none overflows.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.llm.common import in_small_batches, materialise, released, table
from graphleaf.llm.vectors import finite_rows, matrix

CENTROIDS, ROUNDS, COMPONENTS, SCALE = 16, 3, 64, 64
LONGEST = (1 << 63) - 1
#: Integers below this have squared distances, of up to 1024 components, that fit 64 bits.
SAFE = 1 << 25
_ROWS = 8192


def _scaled(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """float32 rows of a largest component in [1/2, 1], the exponents taken out, and the rows' norms (a little too large)."""
    e = np.frexp(np.abs(x).max(1))[1]
    y = np.ldexp(x, -e[:, None])
    return y.astype(np.float32), e, np.sqrt((y * y).sum(1)) * (1 + 1e-12)


class Centroids:
    """Centroids of exact integers of any size."""

    def __init__(self, values: list[list[int]]):
        self.values = values
        n = len(values[0])
        approximate = np.array([[float(v) for v in row] for row in values])
        self.narrow = np.array([max(map(abs, row)) < SAFE for row in values]) & (n <= 1024)
        self.exact = np.array([[v if ok else 0 for v in row] for row, ok in zip(values, self.narrow, strict=True)], np.int64)
        self.rows, self.exponents, self.norms = _scaled(approximate)
        u = (n + 2) * 2.0**-24
        self.gamma = u / (1 - u) * (1 + 1e-9)
        self.tiny = n * 2.0**-120  # of products below float32's normal range

    def candidates(self, q: np.ndarray) -> np.ndarray:
        """For each row of integers (as float64) the centroids that can be nearest."""
        rows, e, norms = _scaled(q)
        product = (rows @ self.rows.T).astype(np.float64)
        room = self.gamma * norms[:, None] * self.norms + self.tiny
        # all in units of 4**s, so that nothing overflows: |c|^2 - 2 x.c, which differs from the squared distance by |x|^2
        s = np.maximum(e, self.exponents.max())[:, None]
        square = np.ldexp(self.norms**2, 2 * (self.exponents - s))
        cross = np.ldexp(product, 1 + e[:, None] + self.exponents - 2 * s)
        error = np.ldexp(room, 1 + e[:, None] + self.exponents - 2 * s) * (1 + 1e-9) + square * 1e-11 + np.abs(cross) * 1e-15 + 1e-300
        middle = square - cross
        return middle - error <= (middle + error).min(1, keepdims=True)

    def distances(self, q: np.ndarray, at: np.ndarray) -> list[int] | np.ndarray:
        """Exact squared distances of rows ``q`` to the centroids ``at``: int64, or Python integers where those could overflow."""
        if self.narrow[at].all() and (np.abs(q) < SAFE).all():
            d = q.astype(np.int64) - self.exact[at]
            return (d * d).sum(1)
        return [sum((int(x) - c) ** 2 for x, c in zip(row, self.values[k], strict=True)) for row, k in zip(q.tolist(), at.tolist(), strict=True)]

    def nearest(self, q: np.ndarray) -> np.ndarray:
        near = self.candidates(q)
        out = near.argmax(1)
        several = np.flatnonzero(near.sum(1) > 1)
        if len(several):
            which, at = np.nonzero(near[several])
            found = self.distances(q[several[which]], at)
            if isinstance(found, np.ndarray):
                order = np.lexsort((at, found, which))
                first = order[np.flatnonzero(np.diff(which[order], prepend=-1))]
                out[several] = at[first]
            else:
                best: dict[int, tuple[int, int]] = {}
                for w, k, d in zip(which.tolist(), at.tolist(), found, strict=True):
                    best[w] = min(best.get(w, (d, k)), (d, k))
                out[several] = [best[w][1] for w in range(len(several))]
        return out


def digits(values: np.ndarray) -> Iterator[np.ndarray]:
    """Integers (as float64) as sums of int64 digits, the k-th in units of 2**(32 k), the last one signed."""
    while True:
        if (np.abs(values) < 2.0**62).all():
            yield values.astype(np.int64)
            return
        high = np.floor(np.ldexp(values, -32))
        yield (values - np.ldexp(high, 32)).astype(np.int64)
        values = high


def _integers(batch: pa.RecordBatch, length: int, scale: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row numbers and integer rows, a bounded number at a time."""
    for i in range(0, batch.num_rows, _ROWS):
        rows, sizes, values = finite_rows(batch.column(1).slice(i, _ROWS), length)
        with np.errstate(over="ignore"):
            q = np.floor(matrix(sizes, values, length) * scale)
        whole = np.isfinite(q).all(1)
        if whole.any():
            yield rows[whole] + i, q[whole]


def _first(vectors: DataFrame, k: int, length: int, scale: int) -> list[list[int]]:
    """The integer vectors of the ``k`` least hashes of ids; equal ids go by their vectors."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: list[tuple[str, list[float]]] = []
        for batch in batches:
            for rows, q in _integers(batch, length, scale):
                keys = [hashlib.sha256(f"1:{'' if i is None else i}".encode()).hexdigest() for i in batch.column(0).take(pa.array(rows)).to_pylist()]
                last = least[-1][0] if len(least) == k else "g"
                least = heapq.nsmallest(k, least + [(key, row.tolist()) for key, row in zip(keys, q, strict=True) if key <= last])
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in least], pa.string()), pa.array([x[1] for x in least], pa.list_(pa.float64()))], names=["key", "q"])

    return [[int(x) for x in r["q"]] for r in vectors.mapInArrow(released(run), "key string, q array<double>").orderBy("key", "q").limit(k).collect()]


def _moved(vectors: DataFrame, centroids: Centroids, length: int, scale: int) -> list[list[int]]:
    """The floors of the means of each centroid's vectors; centroids without any stay."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        for batch in batches:
            for _, q in _integers(batch, length, scale):
                at = centroids.nearest(q)
                for cluster in np.unique(at).tolist():
                    own = q[at == cluster]
                    for place, digit in enumerate(digits(own)):
                        whole = sums.setdefault((cluster, place), np.zeros(length + 1, object))
                        if (np.abs(digit) < 1 << 40).all():
                            whole[:-1] += digit.sum(0).astype(object)
                        else:
                            whole[:-1] += digit.astype(object).sum(0)
                        whole[-1] += len(own) if place == 0 else 0
        rows = [(cluster, place, i, str(x)) for (cluster, place), whole in sums.items() for i, x in enumerate(whole) if x]
        yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate((pa.int32(), pa.int32(), pa.int32(), pa.string()))], names=["cluster", "place", "i", "s"])

    total = F.sum(F.col("s").cast("decimal(38,0)"))
    parts = vectors.mapInArrow(released(run), "cluster int, place int, i int, s string").groupBy("cluster", "place", "i").agg(total.alias("s")).collect()
    sums = [[0] * (length + 1) for _ in centroids.values]
    for r in parts:
        sums[r["cluster"]][r["i"]] += int(r["s"]) << 32 * r["place"]
    return [[x // own[-1] for x in own[:-1]] if own[-1] else old for own, old in zip(sums, centroids.values, strict=True)]


def cluster(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", k: int = CENTROIDS, rounds: int = ROUNDS, length: int = COMPONENTS, scale: int = SCALE) -> DataFrame:
    """``vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256`` for each row whose vector is whole.

    Vectors that are null, of another length or hold nulls, NaN or infinities (also once scaled) are left out.
    Centroids start as the rows of the least sha256 of ``1:<id>`` (a null id: of ``1:``), equal ids by their vectors;
    with fewer rows than ``k`` each row is a centroid. Repeated rows count each; ties go to the lowest centroid;
    an empty table gives no rows; other columns are ignored. Distances are exact for vectors of any size;
    a distance or inertia above 2**63 - 1 is given as that."""
    source = in_small_batches(vectors).select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding"))
    start = _first(source, k, length, scale)
    schema = "vec_id long, cluster int, distance long"
    if not start:
        none = F.lit(None)
        return source.limit(0).select("vec_id", none.cast("int").alias("cluster"), *[none.cast("long").alias(c) for c in ("distance", "cluster_inertia", "inertia")], none.cast("string").alias("centroid_sha256"))
    centroids = Centroids(start)
    for _ in range(rounds):
        centroids = Centroids(_moved(source, centroids, length, scale))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, q in _integers(batch, length, scale):
                at = centroids.nearest(q)
                found = centroids.distances(q, at)
                found = found if isinstance(found, np.ndarray) else [min(d, LONGEST) for d in found]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), pa.array(at.astype(np.int32)), pa.array(found, pa.int64())], names=["vec_id", "cluster", "distance"])

    assigned = materialise(source.mapInArrow(released(run), schema))
    sums = {r["cluster"]: int(r["s"]) for r in assigned.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("s")).collect()}
    inertia = min(sum(sums.values()), LONGEST)
    about = [(c, min(s, LONGEST), inertia, hashlib.sha256(",".join(map(str, centroids.values[c])).encode()).hexdigest()) for c, s in sums.items()]
    about = source.sparkSession.createDataFrame(about, "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return assigned.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # at most k rows


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clusters of all embeddings: 16 centroids, three rounds."""
    return cluster(table(spark, sf_dir, "embeddings"))


_NEAREST = """
    select v.id, v.vec_id, v.q, arg_min(c.c, struct_pack(d := list_sum(list_transform(list_zip(v.q, c.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), c := c.c)) as c
    from v, {centroids} c group by 1, 2, 3"""
_MEANS = """
    select c.c, coalesce(m.q, c.q) as q from {centroids} c left join (
        select c, list(x order by i) as q from (
            select c, i, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) as x
            from (select c, generate_subscripts(q, 1) as i, unnest(q) as x from {near}) group by 1, 2) group by 1) m using (c)"""

ORACLE_SQL = f"""
with v as materialized (
    select row_number() over () as id, vec_id, list_transform(embedding, lambda x: cast(floor(64 * cast(x as double)) as hugeint)) as q
    from embeddings where len(embedding) = 64 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
c0 as materialized (
    select row_number() over (order by key, q) - 1 as c, q from (
        select sha256('1:' || coalesce(cast(vec_id as varchar), '')) as key, q from v) qualify row_number() over (order by key, q) <= 16),
n0 as materialized ({_NEAREST.format(centroids="c0")}),
c1 as materialized ({_MEANS.format(centroids="c0", near="n0")}),
n1 as materialized ({_NEAREST.format(centroids="c1")}),
c2 as materialized ({_MEANS.format(centroids="c1", near="n1")}),
n2 as materialized ({_NEAREST.format(centroids="c2")}),
c3 as materialized ({_MEANS.format(centroids="c2", near="n2")}),
n3 as materialized ({_NEAREST.format(centroids="c3")}),
d as (
    select n3.vec_id, n3.c, list_sum(list_transform(list_zip(n3.q, c3.q), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) as distance, sha256(array_to_string(c3.q, ',')) as sha
    from n3 join c3 using (c))
select vec_id, cast(c as integer) as cluster, cast(distance as bigint) as distance, cast(sum(distance) over (partition by c) as bigint) as cluster_inertia,
    cast(sum(distance) over () as bigint) as inertia, sha as centroid_sha256
from d
"""
