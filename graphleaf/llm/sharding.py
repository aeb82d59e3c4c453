"""K-d tree sharding, with DataFrame operations only.

The points of the tree are groups of equal texts, weighted by their bytes, so that
copies stay together. A node is split along the metadata dimension in which its
points are widest, at the weighted quantile that leaves each side the bytes of its
shards. The quantiles of all nodes of a level are found together: a few rounds of
weighted histograms, each ``BINS`` counts for a node, narrow the cut to a single
coordinate; the bin in which a cut lies is found where the histogram is. Nodes and cuts are
small tables joined with the points by node, and a few numbers for each node reach the driver.

A group above ``1 / (shards * HEAVY)`` of the bytes or rows cannot be cut around
evenly. There are at most ``2 * shards * HEAVY`` such groups whatever the input;
they are dealt first, largest to the emptiest shard, and the tree then fills what
each shard has left. A group larger than a shard's share is dealt row by row.
"""

from __future__ import annotations

import heapq
import json
import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from graphleaf.llm.common import dense_rank_slots, materialise, table

BINS_LOG2, ROUNDS = 12, 4
BINS = 1 << BINS_LOG2
#: Coordinates have BINS_LOG2 * ROUNDS bits: the upper half from the value, the lower half from the group's digest, so that equal values can be cut.
HALF = BINS_LOG2 * ROUNDS // 2
HEAVY = 32
#: Levels of the tree between written tables of the points.
LEVELS_HELD = 4


def _dimensions() -> dict[str, Column]:
    """Metadata dimensions, each scaled to 0..1."""
    unit = lambda c: (F.xxhash64(c).bitwiseAND(F.lit((1 << 40) - 1)) / float(1 << 40))
    return {
        "size": F.least(F.lit(1.0), F.log2(F.col("g_size").cast("double") + 1) / 40.0),
        "id": F.coalesce((F.col("g_id") - F.col("lo_id")) / F.greatest(F.col("hi_id") - F.col("lo_id"), F.lit(1)), F.lit(0.0)),
        "lang": unit(F.coalesce(F.col("g_lang"), F.lit(""))),
        "source": unit(F.coalesce(F.col("g_source"), F.lit(""))),
    }


def _small_table(session: SparkSession, rows: list[tuple], schema: str) -> DataFrame:
    """A table of the driver's ``rows``, made by the JVM alone from one literal."""
    names = [c.split()[0] for c in schema.split(", ")]
    text = json.dumps([dict(zip(names, r, strict=True)) for r in rows])
    kind = ", ".join(":".join(c.split()) for c in schema.split(", "))
    return session.range(1).select(F.explode(F.from_json(F.lit(text), f"array<struct<{kind}>>")).alias("r")).select("r.*")


def shard(docs: DataFrame, target_bytes: int | None = None, n_shards: int | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Deal ``docs`` into shards of nearly equal bytes.

    Give ``target_bytes`` (shards = bytes / target, rounded up) or ``n_shards``.
    Returns ``doc_id, size, text_crc32, shard, slot``: one row for each input row,
    size = UTF-8 bytes + 1, slots gapless from 0 within a shard.

    Null texts count as empty; null ids, languages and sources are values like any
    other; repeated rows each keep a row of their own, their slots in no order; texts may be
    of any length, one above a shard's share fills a shard; an empty table gives no rows;
    other columns are ignored, ``lang`` and ``source`` may be missing."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    meta = [F.col(c).cast("string").alias(a) if c in docs.columns else F.lit(None).cast("string").alias(a) for c, a in (("lang", "lang"), ("source", "source"))]
    rows = materialise(docs.select(F.col(id_col).cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(1)).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("digest"), *meta))
    total = rows.agg(F.count("*"), F.coalesce(F.sum("size"), F.lit(0)), F.min("doc_id"), F.max("doc_id")).first()
    n_rows, n_bytes, lo, hi = total
    if n_shards is None:
        n_shards = max(1, math.ceil(n_bytes / max(1, int(target_bytes))))
    groups = rows.groupBy("digest").agg(
        F.sum("size").alias("bytes"), F.count("*").alias("rows"), F.max("size").alias("g_size"), F.min("doc_id").alias("g_id"),
        F.min(F.struct("lang", "source")).alias("m"),
    ).select("digest", "bytes", "rows", "g_size", "g_id", F.col("m.lang").alias("g_lang"), F.col("m.source").alias("g_source"))
    tie = F.conv(F.substring(F.hex("digest"), 1, 12), 16, 10).cast("long")
    dims = _dimensions()
    groups = groups.withColumns({"lo_id": F.lit(lo if lo is not None else 0), "hi_id": F.lit(hi if hi is not None else 0)})
    points = materialise(groups.select("digest", "bytes", "rows", *[F.least((c * (1 << HALF)).cast("long"), F.lit((1 << HALF) - 1)).bitwiseOR(F.lit(0)).alias(f"v_{d}") for d, c in dims.items()], tie.bitwiseAND(F.lit((1 << HALF) - 1)).alias("tie")))
    points = points.select("digest", "bytes", "rows", *[(F.shiftleft(F.col(f"v_{d}"), HALF) + F.col("tie")).alias(d) for d in dims])

    heavy_bytes, heavy_rows = n_bytes / (n_shards * HEAVY), n_rows / (n_shards * HEAVY)
    is_heavy = (F.col("bytes") > heavy_bytes) | (F.col("rows") > heavy_rows)
    heavy = points.filter(is_heavy).select("digest", "bytes", "rows").orderBy(F.desc("bytes"), "digest").collect()  # at most 2 * n_shards * HEAVY
    load = [0.0] * n_shards
    emptiest = [(0.0, k) for k in range(n_shards)]  # a heap
    goal = n_bytes / n_shards
    whole: list[tuple[bytearray, int]] = []
    spread: list[tuple[bytearray, int, int]] = []  # digest, shard, rows up to which the shard takes them
    for g in heavy:
        if g["bytes"] <= goal or g["rows"] == 1:
            k = emptiest[0][1]
            load[k] += g["bytes"]
            heapq.heapreplace(emptiest, (load[k], k))
            whole.append((g["digest"], k))
            continue
        one, given = g["bytes"] / g["rows"], 0
        for k in sorted(range(n_shards), key=load.__getitem__):
            take = min(g["rows"] - given, max(0, math.ceil((goal - load[k]) / one)))
            if take:
                given += take
                load[k] += take * one
                spread.append((g["digest"], k, given))
        if given < g["rows"]:
            spread[-1] = (g["digest"], spread[-1][1], g["rows"])
        emptiest = [(x, k) for k, x in enumerate(load)]
        heapq.heapify(emptiest)
    light = points.filter(~is_heavy)
    left = [max(0.0, goal - x) for x in load]
    leaf_of = _grow_tree(light, list(dims), left)
    session = docs.sparkSession
    fixed = _small_table(session, [(bytes(d).hex(), k, None) for d, k in whole] + [(bytes(d).hex(), k, n) for d, k, n in spread], "digest string, shard int, upto long").withColumn("digest", F.unhex("digest"))
    plain = rows.join(F.broadcast(fixed.select("digest").distinct()), "digest", "left_anti")  # bounded: see is_heavy
    placed = plain.join(leaf_of, "digest").select("doc_id", "size", "text_crc32", F.col("leaf").cast("int").alias("shard"))
    kept = rows.join(F.broadcast(fixed.filter("upto is null").select("digest", "shard")), "digest").select("doc_id", "size", "text_crc32", "shard")
    out = placed.unionByName(kept)
    if spread:
        out = out.unionByName(_dealt(rows, fixed.filter("upto is not null")))
    return dense_rank_slots(materialise(out), ["shard"], ["doc_id", "text_crc32", "size"], "slot")


def _dealt(rows: DataFrame, fixed: DataFrame) -> DataFrame:
    """Rows of groups larger than a shard, by their number within the group."""
    hot = rows.join(F.broadcast(fixed.select("digest").distinct()), "digest")
    ranked = dense_rank_slots(materialise(hot), ["digest"], ["doc_id"], "nth")
    first = fixed.groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("upto", "shard"))).alias("parts"))  # at most a part for each shard
    part = F.expr("filter(parts, p -> nth < p.upto)[0].shard")
    return ranked.join(F.broadcast(first), "digest").select("doc_id", "size", "text_crc32", part.cast("int").alias("shard"))


def _grow_tree(points: DataFrame, dims: list[str], left: list[float]) -> DataFrame:
    """digest and leaf (a shard) of each point: the shards take their share of ``left``."""
    session = points.sparkSession
    moved = points.select("digest", "bytes", *dims, F.lit(0 if len(left) > 1 else -1).alias("node"))  # a leaf is -1 - shard
    room = [0.0]
    for x in left:
        room.append(room[-1] + x)
    open_nodes, fresh, level = ({0: (0, len(left))} if len(left) > 1 else {}), 1, 0
    while open_nodes:
        here = moved.filter("node >= 0")
        spans = here.groupBy("node").agg(F.sum("bytes").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dims])
        widest = F.array_position(F.array(*dims), F.greatest(*dims)) - 1  # the first of equals
        of_node = {r["node"]: r for r in spans.select("node", "bytes", widest.cast("int").alias("dim")).collect()}  # a row for each node
        dim = {k: of_node[k]["dim"] if k in of_node else 0 for k in open_nodes}
        want, prefix, before, size = {}, dict.fromkeys(open_nodes, 0), dict.fromkeys(open_nodes, 0), dict.fromkeys(open_nodes, 0)
        for k, (a, b) in open_nodes.items():
            mid, own = (a + b) // 2, room[b] - room[a]
            share = (room[mid] - room[a]) / own if own > 0 else (mid - a) / (b - a)
            want[k] = share * (of_node[k]["bytes"] if k in of_node else 0)
        for step in range(ROUNDS):
            down = BINS_LOG2 * (ROUNDS - step)
            goals = _small_table(session, [(k, dim[k], prefix[k], want[k] - before[k]) for k in open_nodes], "node int, dim int, prefix long, goal double")
            x = F.element_at(F.array(*dims), F.col("dim") + 1)
            part = here.join(F.broadcast(goals), "node").filter(F.shiftright(x, down) == F.col("prefix"))  # goals: a row for each node
            bins = part.groupBy("node", "goal", F.shiftright(x, down - BINS_LOG2).bitwiseAND(F.lit(BINS - 1)).alias("b")).agg(F.sum("bytes").alias("w"))
            passed = F.sum("w").over(Window.partitionBy("node").orderBy("b").rowsBetween(Window.unboundedPreceding, Window.currentRow))  # at most BINS rows a node
            found = F.struct("b", (F.col("run") - F.col("w")).alias("before"), "w")
            picks = bins.withColumn("run", passed).groupBy("node").agg(F.coalesce(F.min(F.when(F.col("run") > F.col("goal"), found)), F.max(found)).alias("at"))
            bin_of = {r["node"]: r["at"] for r in picks.collect()}  # a row for each node
            for k in open_nodes:
                b, passed_by, w = bin_of.get(k, (0, 0, 0))
                before[k] += passed_by
                size[k] = w
                prefix[k] = (prefix[k] << BINS_LOG2) + b
        cuts, following = [], {}
        for k, (a, b) in open_nodes.items():
            mid = (a + b) // 2
            cut = prefix[k] + (1 if want[k] - before[k] > size[k] / 2 else 0)  # the point at the cut goes to the side that it suits
            child = []
            for lo, hi in ((a, mid), (mid, b)):
                if hi - lo == 1:
                    child.append(-1 - lo)
                else:
                    following[fresh] = (lo, hi)
                    child.append(fresh)
                    fresh += 1
            cuts.append((k, dim[k], cut, *child))
        table_of = _small_table(session, cuts, "node int, dim int, cut long, low int, high int")
        below = F.element_at(F.array(*dims), F.col("dim") + 1) < F.col("cut")
        moved = moved.join(F.broadcast(table_of), "node", "left").select("digest", "bytes", *dims, F.coalesce(F.when(below, F.col("low")).otherwise(F.col("high")), "node").alias("node"))
        open_nodes, level = following, level + 1
        if open_nodes and level % LEVELS_HELD == 0:
            moved = materialise(moved)
    return moved.select("digest", (-F.col("node") - F.lit(1)).alias("leaf"))


def op9_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in eight shards of nearly equal bytes."""
    out = shard(table(spark, sf_dir, "documents"), n_shards=8)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
