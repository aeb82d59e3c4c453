"""A stored vector index: inverted lists behind a k-means quantiser, with product codes.

Vectors count by direction (cosine). Each belongs to the list of its nearest centroid; what remains
after the centroid is coded one byte for each of its parts, by a second set of
centroids for each part. The index is a Parquet table with a folder for each list, so that a question
reads the folders of a few lists, and of those first only ids, codes and bounds; the whole vectors
are read for a short list alone, whose cosines are then taken exactly.

Both quantisers are trained by rounds of Lloyd's rule that run as Spark jobs: tasks add up their vectors,
and the driver gets a sum for each centroid. Only centroids are held in the driver and sent to tasks, numbers
that the parameters bound. At the end a bounded sample of the vectors asks the index, and the numbers of
lists and of short-listed rows that a share ``target`` of their true neighbours needs are kept with it.

For an exact answer each list keeps the greatest distance of its rows from its centroid. The best k of a few near
lists give each question a score to reach; lists that cannot reach it are left out. Tasks multiply the vectors of the others with all
questions of a pass and return, of each question, at most the best k of the rows that reach it, so that what is
moved grows with the answers and not with the pairs. The vectors of all answers are looked up in one join.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphleaf.functions import text as X
from graphleaf.tables import tidy, written

#: Rounds of training, rows trained on (a hash chooses them), codes of a part, components of a part, sampled questions, questions in a pass.
ROUNDS, TRAINED, CODES, PART, SAMPLED, BLOCK = 8, 1 << 20, 256, 4, 128, 512
MOST_LISTS, TARGET = 4096, 0.98
#: Of an exact pass: components and answers of its questions, rows and questions multiplied at once, pairs kept before they are cut to the best, tasks for each core.
ASKED, FOUND, TILE, HELD, TASKS = 1 << 19, 1 << 17, 1024, 1 << 18, 4


def _whole(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and unit rows of the vectors of ``width`` finite components that are not all zero."""
    fit = pc.fill_null(pc.equal(pc.list_value_length(column), width), False)
    x = np.asarray(pc.fill_null(column.filter(fit).flatten().cast(pa.float64()), np.nan)).reshape(-1, width)
    norm = np.sqrt((x * x).sum(1))
    good = np.isfinite(norm) & (norm > 0)
    return np.flatnonzero(np.asarray(fit))[good], (x[good] / norm[good, None]).astype(np.float32)


@dataclass(frozen=True)
class Quantiser:
    """Centroids of the lists (lists, width) and of the codes (parts, codes, part's width; parts filled up with zeros)."""

    lists: np.ndarray
    codes: np.ndarray

    def parted(self, x: np.ndarray) -> np.ndarray:
        parts, _, size = self.codes.shape
        return np.pad(x, ((0, 0), (0, parts * size - x.shape[1]))).reshape(len(x), parts, size)

    def coded(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """List, code, what the code leaves out and distance from the centroid of each row."""
        at = _nearest(x, self.lists)
        rest = x - self.lists[at]
        parts = self.parted(rest)
        code = np.stack([_nearest(parts[:, p], self.codes[p]) for p in range(parts.shape[1])], 1)
        left = parts - self.codes[np.arange(parts.shape[1]), code]
        return at, code.astype(np.uint8), np.sqrt((left**2).sum((1, 2))), np.sqrt((rest**2).sum(1))


def _nearest(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    out = np.empty(len(x), np.int64)
    half = (centroids**2).sum(1) / 2
    for i in range(0, len(x), 4096):
        out[i : i + 4096] = (half - x[i : i + 4096] @ centroids.T).argmin(1)
    return out


def _moved(rows: DataFrame, width: int, spaces: np.ndarray, quantiser: Quantiser | None) -> np.ndarray:
    """One round of Lloyd's rule for each space (spaces, centroids, size): the lists' own, or with ``quantiser`` the parts of what its lists leave."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, n = np.zeros(spaces.shape), np.zeros(spaces.shape[:2], np.int64)
        for batch in batches:
            _, x = _whole(batch.column(0), width)
            own = x[:, None] if quantiser is None else quantiser.parted(x - quantiser.lists[_nearest(x, quantiser.lists)])
            for s, centroids in enumerate(spaces):
                at = _nearest(own[:, s], centroids)
                n[s] += np.bincount(at, minlength=len(centroids))
                np.add.at(sums[s], at, own[:, s])
        s, k = np.nonzero(n)
        lists = pa.ListArray.from_arrays(pa.array(np.arange(len(s) + 1, dtype=np.int32) * spaces.shape[2]), pa.array(sums[s, k].ravel()))
        yield pa.RecordBatch.from_arrays([pa.array(s.astype(np.int32)), pa.array(k.astype(np.int32)), pa.array(n[s, k]), lists], names=["s", "k", "n", "v"])

    added = rows.select("embedding").mapInArrow(run, "s int, k int, n long, v array<double>").select("s", "k", "n", F.posexplode("v").alias("i", "v")).groupBy("s", "k", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v"))
    out = spaces.copy()
    got = added.toArrow()  # a number for each component of each centroid
    out[got["s"].to_numpy(), got["k"].to_numpy(), got["i"].to_numpy()] = (got["v"].to_numpy() / got["n"].to_numpy()).astype(np.float32)
    tidy(rows.sparkSession)
    return out


def _sample(rows: DataFrame, n: int, width: int) -> tuple[list, np.ndarray]:
    """Ids and unit rows of the ``n`` rows of the least hash of the id."""
    got = rows.select("id", "embedding").orderBy(F.xxhash64("id"), "id").limit(n).toArrow().combine_chunks()
    if not got.num_rows:
        return [], np.zeros((0, width), np.float32)
    at, x = _whole(got.column("embedding").chunk(0), width)
    return got["id"].take(pa.array(at)).to_pylist(), x


def _files(spark: SparkSession, folder: str, name: str, rows: list[tuple], schema: str) -> None:
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("overwrite").parquet(f"{folder}/{name}")


_opened: dict[tuple[str, str], DataFrame] = {}


@dataclass(frozen=True)
class VectorIndex:
    """An index in ``folder``: its quantiser, its lists' sizes and radii, and the probes and short-listed rows that its sample needed."""

    folder: str
    quantiser: Quantiser
    radius: np.ndarray
    probes: int
    short: int
    kind: str
    id_kind: str = "long"

    @property
    def width(self) -> int:
        return self.quantiser.lists.shape[1]

    def rows(self, spark: SparkSession) -> DataFrame:
        """list, id, code, left, embedding.

        Opened once in a session: to list the folders of all lists is a job of its own, which a search of many blocks must not repeat."""
        key = (spark.sparkContext.applicationId, self.folder)
        if key not in _opened:
            _opened[key] = spark.read.schema(f"list int, id {self.id_kind}, code binary, left float, far float, embedding {self.kind}").parquet(f"{self.folder}/rows")
        return _opened[key]

    def read(self, spark: SparkSession, lists: list[int], *columns: str) -> DataFrame:
        """The rows of these lists, whose many small files are read by a few tasks for each core."""
        return self.rows(spark).filter(F.col("list").isin(lists)).select(*columns).coalesce(TASKS * spark.sparkContext.defaultParallelism)

    def search(self, questions: DataFrame, k: int, exact: bool = False, probes: int | None = None, short: int | None = None, digits: int = 6) -> DataFrame:
        """``question, rank, id, score``: the ``k`` nearest by cosine of each row of (question, vector).

        Whole scores are ranked, equal ones in order of id, and then rounded. Questions without a number and vectors that are null, of another width or zero get no rows; a
        question asked twice is answered once for each different vector. ``exact`` leaves out only what cannot be among the nearest."""
        spark = questions.sparkSession
        fit = questions.select(F.col("question").cast("long").alias("question"), F.col("vector").alias("vector")).filter("question is not null").distinct()
        bucket = F.pmod(F.xxhash64("question", "vector"), F.lit(64))
        numbered = written(fit.withColumn("bucket", bucket).withColumn("block", F.row_number().over(Window.partitionBy("bucket").orderBy("question", "vector"))).withColumn("n", F.col("block").cast("long") * 64 + F.col("bucket")).drop("bucket"))
        # of each of the 64 parts, so that blocks stay bounded; only whole vectors are read in an exact pass, and more questions share the reading
        per = max(1, min(ASKED // self.width, FOUND // k) // 64) if exact else BLOCK // 64
        out = []
        for block in range(-(-(numbered.agg(F.max("block")).first()[0] or 0) // per)):
            asked = numbered.filter((F.col("block") > block * per) & (F.col("block") <= (block + 1) * per)).select("n", "vector").toArrow().combine_chunks()  # at most a block of questions
            pairs = self.nearest(spark, asked, k) if exact else self._near(spark, asked, min(probes or self.probes, len(self.radius)), short or max(self.short, 2 * k))
            if pairs is not None:
                out.append(written(pairs.select("n", "list", "id")))
                tidy(spark)
        if not out:
            return fit.limit(0).select("question", F.lit(0).alias("rank"), F.lit(None).cast(self.id_kind).alias("id"), F.lit(0.0).alias("score"))
        pairs = out[0]
        for more in out[1:]:
            pairs = pairs.union(more)
        return self._ranked(spark, numbered, pairs, k).withColumn("score", F.round("score", digits))

    def _asked(self, asked: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers, unit rows and plain rows of the questions (n, vector) that have a direction."""
        if not asked.num_rows:
            return np.zeros(0, np.int64), np.zeros((0, self.width), np.float32), np.zeros((0, self.width))
        vectors = asked.column("vector").chunk(0)
        at, x = _whole(vectors, self.width)
        return asked["n"].to_numpy()[at], x, _plain(vectors.take(pa.array(at)), self.width)

    def _near(self, spark: SparkSession, asked: pa.Table, probes: int, short: int) -> DataFrame | None:
        """n, list, id: the short lists of a block of questions (n, vector)."""
        n, x, _ = self._asked(asked)
        if not len(x):
            return None
        near = x @ self.quantiser.lists.T
        probed = near >= np.partition(near, -probes, 1)[:, -probes, None] if probes < near.shape[1] else np.ones(near.shape, bool)
        numbers = spark.createDataFrame(pa.table({"q": pa.array(np.arange(len(n), dtype=np.int32)), "n": pa.array(n)}))
        return self.short_list(spark, x, probed, np.full(len(x), -np.inf), short).join(F.broadcast(numbers), "q")  # at most a block of questions

    def nearest(self, spark: SparkSession, asked: pa.Table, k: int) -> DataFrame | None:
        """n, list, id and score: exactly the ``k`` best rows of each of the questions (n, vector); of rows that are repeated one."""
        n, x, plain = self._asked(asked)
        if not len(x):
            return None
        probes = min(self.probes, max(8, len(self.radius) // 16))
        depth = np.concatenate([np.partition(near, -probes, 1)[:, -probes] for near in self._products(x)])
        first = written(self._best(spark, n, x, plain, depth, np.where(np.isfinite(self.radius), 0, -np.inf), np.full(len(x), -np.inf), k))
        at, least = {v: i for i, v in enumerate(n.tolist())}, np.full(len(x), -np.inf)
        for r in first.filter(F.col("r") == k).select("n", "score").collect():  # one row a question
            least[at[r["n"]]] = r["score"]
        return self._best(spark, n, x, plain, least - self._slack, self.radius, least, k)

    @property
    def _slack(self) -> float:
        """More than products of unit rows of single precision can be wrong by."""
        return max(1e-5, (self.width + 8) * 2.0**-23)

    def _products(self, x: np.ndarray) -> Iterator[np.ndarray]:
        """Of the questions with the centroids, a block at a time; lists without rows are last."""
        for i in range(0, len(x), BLOCK):
            yield np.where(np.isfinite(self.radius), x[i : i + BLOCK] @ self.quantiser.lists.T, -np.inf)

    def _best(self, spark: SparkSession, n: np.ndarray, x: np.ndarray, plain: np.ndarray, bar: np.ndarray, reach: np.ndarray, least: np.ndarray, k: int) -> DataFrame:
        """n, list, id, score and rank r of the ``k`` best of the rows that reach ``least``, of lists whose product with the question and ``reach`` come to its ``bar``."""
        centroids, width, slack = self.quantiser.lists, self.width, self._slack
        lists = np.zeros(len(reach), bool)
        for i, near in enumerate(self._products(x)):
            lists |= (near + reach + slack >= bar[i * BLOCK : i * BLOCK + len(near), None]).any(0)
        lists &= np.isfinite(self.radius)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            floor, components, lengths = least.copy(), np.ascontiguousarray(plain.T), np.sqrt(_dots(plain.T, plain.T))
            held: list[tuple[np.ndarray, ...]] = []
            count = 0
            for batch in batches:
                at, unit = _whole(batch.column(2), width)
                rows = batch.take(pa.array(at))
                own, ids = (rows.column(c).to_numpy(zero_copy_only=False) for c in (0, 1))
                row_components = np.ascontiguousarray(_plain(rows.column(2), width).T)
                row_lengths = np.sqrt(_dots(row_components, row_components))
                for one in np.unique(own).tolist():
                    of_list, asking = np.flatnonzero(own == one), np.flatnonzero(x @ centroids[one] + reach[one] + slack >= bar)
                    for i in range(0, len(of_list), TILE):
                        some = of_list[i : i + TILE]
                        once = np.unique(ids[some], return_index=True)[1]
                        for j in range(0, len(asking), TILE):
                            tile = asking[j : j + TILE]
                            for r, q in _reaching(unit[some] @ x[tile].T, floor[tile], once, k, slack):
                                r, q = some[r], tile[q]
                                score = _dots(row_components, components, r, q) / (row_lengths[r] * lengths[q])
                                good = score >= floor[q]
                                held.append((q[good], np.full(good.sum(), one), ids[r[good]], score[good]))
                                count += len(held[-1][0])
                                if count > HELD + 2 * len(x) * k:
                                    held = [_cut(held, k, floor)]
                                    count = len(held[0][0])
            if held:
                q, one, ids, score = _cut(held, k, floor)
                yield pa.RecordBatch.from_arrays([pa.array(n[q]), pa.array(one.astype(np.int32)), pa.array(ids), pa.array(score)], names=["n", "list", "id", "score"])

        found = self.read(spark, np.flatnonzero(lists).tolist(), "list", "id", "embedding").mapInArrow(run, f"n long, list int, id {self.id_kind}, score double")
        order = Window.partitionBy("n").orderBy(F.desc("score"), "id")
        return found.groupBy("n", "id", "score").agg(F.min("list").alias("list")).withColumn("r", F.row_number().over(order)).filter(F.col("r") <= k)

    def short_list(self, spark: SparkSession, x: np.ndarray, probed: np.ndarray, least: np.ndarray, short: int | None) -> DataFrame:
        """q, list, id and rank r of the ``short`` rows of the probed lists with the best codes, or of all rows that can reach ``least``."""
        quantiser, lists = self.quantiser, np.flatnonzero(probed.any(0)).tolist()
        products = np.einsum("qps,pcs->qpc", quantiser.parted(x), quantiser.codes)  # of questions with the codes of each part
        near = x @ quantiser.lists.T

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: list[tuple[np.ndarray, ...]] = []
            for batch in batches:
                own, ids, left = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 1, 3))
                code = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                for one in np.unique(own).tolist():
                    rows, asking = np.flatnonzero(own == one), np.flatnonzero(probed[:, one])
                    for i in range(0, len(rows), 4096):
                        part = rows[i : i + 4096]
                        score = np.repeat(near[asking, one][:, None], len(part), 1)
                        for p in range(code.shape[1]):
                            score += products[asking, p][:, code[part, p]]
                        keep = score + left[part] + 1e-5 >= least[asking][:, None]
                        if short is not None and len(part) > short:
                            keep &= score >= np.partition(score, -short, 1)[:, -short, None]
                        q, r = np.nonzero(keep)
                        best.append((asking[q], np.full(len(q), one), ids[part[r]], score[q, r]))
                if short is None or sum(len(b[0]) for b in best) > 4 * short * max(1, len(x)):
                    yield from _batch(best, short)
                    best = []
            yield from _batch(best, short)

        found = self.read(spark, lists, "list", "id", "code", "left").mapInArrow(run, f"q int, list int, id {self.id_kind}, score float")
        if short is None:
            return found.select("q", "list", "id", F.lit(0).alias("r"))
        order = Window.partitionBy("q").orderBy(F.desc("score"), "id")
        return found.withColumn("r", F.row_number().over(order)).filter(F.col("r") <= short).select("q", "list", "id", "r")

    def _ranked(self, spark: SparkSession, numbered: DataFrame, pairs: DataFrame, k: int) -> DataFrame:
        """The exact ``k`` best of the pairs (n, list, id) of the questions (n, question, vector)."""
        # vectors, pairs and questions grow and are never broadcast; the vectors are dealt once for all blocks
        every = np.flatnonzero(np.isfinite(self.radius)).tolist()
        found = self.read(spark, every, "list", "id", "embedding").join(pairs.hint("merge"), ["list", "id"]).select("n", "id", "embedding")
        scored = found.join(numbered.drop("block").hint("merge"), "n").select("n", "question", "id", X.cosine(F.col("embedding"), F.col("vector")).alias("score")).distinct()
        order = Window.partitionBy("n").orderBy(F.desc("score"), "id")
        return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("question", "rank", "id", "score")


def _plain(column: pa.Array, width: int) -> np.ndarray:
    return np.asarray(column.flatten().cast(pa.float64())).reshape(-1, width)


def _dots(a: np.ndarray, b: np.ndarray, r: np.ndarray | slice = slice(None), q: np.ndarray | slice = slice(None)) -> np.ndarray:
    """Products of columns ``r`` of ``a`` and ``q`` of ``b``, summed in order of the components as ``text.cosine`` does."""
    total = 0.0
    for one, other in zip(a, b, strict=True):
        total = total + one[r] * other[q]
    return total


def _reaching(score: np.ndarray, floor: np.ndarray, once: np.ndarray, k: int, slack: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in a table of products (rows, questions) that may come to the question's floor and be among its ``k`` best here, some at a time. ``once``: a row of each id."""
    floor = floor - slack
    if len(once) > k and (new := np.isneginf(floor)).any():
        floor[new] = np.partition(score[np.ix_(once, new)], -k, 0)[-k] - 2 * slack
    r, q = np.nonzero(score >= floor)
    for i in range(0, len(r), 1 << 16):
        yield r[i : i + (1 << 16)], q[i : i + (1 << 16)]


def _cut(held: list[tuple[np.ndarray, ...]], k: int, floor: np.ndarray) -> tuple[np.ndarray, ...]:
    """Of each question the best ``k`` of (q, list, id, score), repeated rows once; the last of ``k`` is the question's new floor."""
    q, one, ids, score = (np.concatenate(c) for c in zip(*held, strict=True))
    number = np.unique(ids, return_inverse=True)[1]
    order = np.lexsort((number, -score, q))
    q, one, ids, score, number = q[order], one[order], ids[order], score[order], number[order]
    new = np.ones(len(q), bool)
    new[1:] = (q[1:] != q[:-1]) | (score[1:] != score[:-1]) | (number[1:] != number[:-1])
    q, one, ids, score = q[new], one[new], ids[new], score[new]
    rank = np.arange(len(q)) - np.searchsorted(q, q)
    last = rank == k - 1
    floor[q[last]] = score[last]
    return tuple(c[rank < k] for c in (q, one, ids, score))


def _batch(best: list[tuple[np.ndarray, ...]], short: int | None) -> Iterator[pa.RecordBatch]:
    """Rows (q, list, id, score), of each question the best ``short``."""
    if not best:
        return
    q, one, ids, score = (np.concatenate(c) for c in zip(*best, strict=True))
    if short is not None:
        order = np.lexsort((np.unique(ids, return_inverse=True)[1], -score, q))
        q, one, ids, score = q[order], one[order], ids[order], score[order]
        keep = np.arange(len(q)) - np.searchsorted(q, q) < short
        q, one, ids, score = q[keep], one[keep], ids[keep], score[keep]
    yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(one.astype(np.int32)), pa.array(ids), pa.array(score.astype(np.float32))], names=["q", "list", "id", "score"])


def build_index(vectors: DataFrame, folder: str, id_col: str, vector_col: str = "embedding", lists: int | None = None, target: float = TARGET, k: int = 10) -> VectorIndex:
    """Write an index of (id, vector) rows into ``folder`` and open it.

    The width is that of most vectors; others, null and zero vectors and rows without id are left out. There are about twice as many lists as the root of the
    number of rows, at most ``MOST_LISTS``. Repeated rows are kept as they are. Where no vector is left the index is empty and answers nothing."""
    spark = vectors.sparkSession
    id_kind = "string" if dict(vectors.dtypes)[id_col] == "string" else "long"
    rows = vectors.select(F.col(id_col).cast(id_kind).alias("id"), F.col(vector_col).alias("embedding")).filter("id is not null and size(embedding) > 0")
    widths = rows.groupBy(F.size("embedding").alias("w")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "w").first()
    width, n = (widths["w"], widths["n"]) if widths else (1, 0)
    rows = rows.filter(F.size("embedding") == width)
    lists = lists or max(1, min(MOST_LISTS, round(2 * n**0.5)))
    trained = rows if n <= TRAINED else rows.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < max(1, (TRAINED << 20) // n))
    _, start = _sample(rows, max(lists, CODES), width)
    parts = -(-width // PART)
    if not len(start):
        start = np.zeros((1, width), np.float32)
    centroids = start[:lists].copy()[None]
    for _ in range(ROUNDS):
        centroids = _moved(trained, width, centroids, None)
    quantiser = Quantiser(centroids[0], np.zeros((parts, 1, PART), np.float32))
    rest = start - quantiser.lists[_nearest(start, quantiser.lists)]
    quantiser = Quantiser(centroids[0], quantiser.parted(rest)[:CODES].transpose(1, 0, 2).copy())
    for _ in range(ROUNDS):
        quantiser = Quantiser(quantiser.lists, _moved(trained, width, quantiser.codes, quantiser))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, x = _whole(batch.column(1), width)
            own, code, left, far = quantiser.coded(x)
            at = pa.array(at)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), batch.column(0).take(at), pa.array([c.tobytes() for c in code], pa.binary()), pa.array(left.astype(np.float32)), pa.array(far.astype(np.float32)), batch.column(1).take(at)], names=["list", "id", "code", "left", "far", "embedding"])

    kind = dict(rows.dtypes)["embedding"]
    coded = rows.mapInArrow(run, f"list int, id {id_kind}, code binary, left float, far float, embedding {kind}")
    # a list's rows go to neighbouring files, large lists to several: the ranges are of list and id
    spread = max(1, min(4 * lists, n // 100_000 + 1))
    coded.repartitionByRange(spread, "list", "id").sortWithinPartitions("list", "id").write.mode("overwrite").partitionBy("list").parquet(f"{folder}/rows")
    tidy(spark)
    _opened.pop((spark.sparkContext.applicationId, folder), None)
    radius = np.full(len(quantiser.lists), -np.inf, np.float32)
    if n:
        for r in VectorIndex(folder, quantiser, radius, 1, 1, kind, id_kind).rows(spark).groupBy("list").agg(F.max("far").alias("far")).collect():  # a row a list
            radius[r["list"]] = r["far"]
    index = VectorIndex(folder, quantiser, radius, len(quantiser.lists), 4 * k, kind, id_kind)
    if n and np.isfinite(radius).any():
        index = _measured(spark, index, rows, k, target)
    floats = lambda a: [float(v) for v in a]
    _files(spark, folder, "lists", [(i, floats(c), float(r)) for i, (c, r) in enumerate(zip(quantiser.lists, radius, strict=True))], "list int, centroid array<float>, radius float")
    _files(spark, folder, "codes", [(p, c, floats(v)) for p, own in enumerate(quantiser.codes) for c, v in enumerate(own)], "part int, code int, centroid array<float>")
    _files(spark, folder, "settings", [(index.probes, index.short, kind, id_kind)], "probes int, short int, kind string, id_kind string")
    return index


def open_index(spark: SparkSession, folder: str) -> VectorIndex:
    lists = spark.read.parquet(f"{folder}/lists").orderBy("list").collect()
    codes = spark.read.parquet(f"{folder}/codes").orderBy("part", "code").collect()
    settings = spark.read.parquet(f"{folder}/settings").first()
    parts = codes[-1]["part"] + 1
    quantiser = Quantiser(np.array([r["centroid"] for r in lists], np.float32), np.array([r["centroid"] for r in codes], np.float32).reshape(parts, len(codes) // parts, -1))
    return VectorIndex(folder, quantiser, np.array([r["radius"] for r in lists], np.float32), settings["probes"], settings["short"], settings["kind"], settings["id_kind"])


def _measured(spark: SparkSession, index: VectorIndex, rows: DataFrame, k: int, target: float) -> VectorIndex:
    """The index with the probes and short-listed rows that find ``target`` of the sample's true neighbours, each of the two a half of what may be missed."""
    ids, x = _sample(rows, SAMPLED, index.width)
    asked = pa.table({"n": np.arange(len(x)), "vector": pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * index.width), pa.array(x.ravel()))})
    found = index.nearest(spark, asked, k + 1)
    true = [r for r in found.collect() if r["id"] != ids[r["n"]]] if found is not None else []  # at most k a sampled question
    if not true:
        return index
    q = x[[r["n"] for r in true]]
    own = np.array([r["list"] for r in true])
    near = q @ index.quantiser.lists.T
    depth = (near > near[np.arange(len(q)), own, None]).sum(1)
    share = 1 - (1 - target) / 2
    probes = int(np.sort(depth)[int(np.ceil(share * len(depth))) - 1]) + 1
    # how deep a true neighbour's code stands among those of the probed lists
    probed = x @ index.quantiser.lists.T
    probed = probed >= np.partition(probed, -probes, 1)[:, -probes, None]
    most = 64 * k
    ranks = index.short_list(spark, x, probed, np.full(len(x), -np.inf), most)
    wanted = spark.createDataFrame([(r["n"], r["id"]) for r in true], f"q int, id {index.id_kind}")
    found = [r["r"] for r in ranks.join(F.broadcast(wanted), ["q", "id"]).collect()]  # at most k a sampled question
    found = np.sort(found + [most] * int((depth < probes).sum() - len(found)))
    short = int(found[int(np.ceil(share * len(found))) - 1]) if len(found) else most
    return replace(index, probes=probes, short=max(short, k))
