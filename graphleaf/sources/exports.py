"""Node and edge files for bulk import, their embedding column, and small result files."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.functions import text as X

#: Column names of the import files, fixed by the format.
NODE_COLUMNS = {"nodeID": "nodeID:ID(wiki)", "label": ":LABEL", "title": "title:string", "text": "text:string"}
EDGE_COLUMNS = {"start_id": ":START_ID(wiki)", "end_id": ":END_ID(wiki)", "rel_type": ":TYPE"}
EMBEDDING_COLUMN = "embedding:float[]"
SHARD_ROWS = 1_000_000
#: What is embedded of each kind of node.
EMBEDDED = {"Article": "title", "Chunk": "text"}


def write_shards(rows: DataFrame, folder: str, prefix: str, columns: dict[str, str], shard_rows: int = SHARD_ROWS, first: int = 0) -> int:
    """Write ``prefix-00000.parquet`` and on, of at most ``shard_rows`` rows each; returns the number after the last.

    Parquet 1.0 without compression or dictionaries. Tasks write side by side; the driver only renames the files."""
    spark = rows.sparkSession
    named = rows.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) if c != "embedding" else F.col(c).alias(n) for c, n in columns.items()])
    at = f"{folder}/_{prefix}"
    named.write.mode("overwrite").option("maxRecordsPerFile", shard_rows).option("compression", "none").option("parquet.enable.dictionary", "false").option("parquet.writer.version", "v1").parquet(at)
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(at)
    files = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = sorted(s.getPath().getName() for s in files.listStatus(path) if s.getPath().getName().startswith("part-"))
    for k, name in enumerate(names):
        files.rename(jvm.org.apache.hadoop.fs.Path(f"{at}/{name}"), jvm.org.apache.hadoop.fs.Path(f"{folder}/{prefix}-{first + k:05d}.parquet"))
    files.delete(path, True)
    return first + len(names)


def write_nodes(nodes: DataFrame, folder: str, shard_rows: int = SHARD_ROWS) -> int:
    columns = NODE_COLUMNS | ({"embedding": EMBEDDING_COLUMN} if "embedding" in nodes.columns else {})
    return write_shards(nodes, folder, "nodes", columns, shard_rows)


def write_edges(edges: DataFrame, folder: str, shard_rows: int = SHARD_ROWS, first: int = 0) -> int:
    return write_shards(edges, folder, "edges", EDGE_COLUMNS, shard_rows, first)


def read_shards(spark: SparkSession, folder: str, prefix: str, columns: dict[str, str]) -> DataFrame:
    """Shards under their short column names; a missing column raises ValueError."""
    rows = spark.read.parquet(f"{folder}/{prefix}-*.parquet")
    if missing := [n for n in columns.values() if n not in rows.columns]:
        raise ValueError(f"columns {missing} are missing in {folder}")
    return rows.select(*[F.col(f"`{n}`").alias(c) for c, n in columns.items()])


def embedded_nodes(nodes: DataFrame, embedder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 256, prefix: str = "") -> DataFrame:
    """Add ``embedding`` (text of numbers parted by ``;``): titles of articles and texts of chunks if not blank, else null. ``prefix`` is put before each. ``embedder`` makes the model once in each worker task."""
    marked = nodes.withColumn("_input", F.when((F.col("label") == "Article") & (X.strip(F.col("title")) != ""), F.col("title")).when((F.col("label") == "Chunk") & (X.strip(F.col("text")) != ""), F.col("text")))

    names = [*nodes.columns, "embedding"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = embedder()
        for rows in batches:
            texts = rows.column(rows.num_columns - 1).to_pylist()
            at = [i for i, t in enumerate(texts) if t is not None]
            out: list[str | None] = [None] * len(texts)
            for k in range(0, len(at), batch):
                part = at[k : k + batch]
                for i, vector in zip(part, model([prefix + texts[i] for i in part]), strict=True):
                    out[i] = ";".join(repr(float(x)) for x in vector)
            yield pa.RecordBatch.from_arrays([*rows.columns[:-1], pa.array(out, pa.string())], names=names)

    return marked.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*nodes.dtypes, ("embedding", "string")]))


def embed_shards(spark: SparkSession, shards: list[str], folder: str, embedder: Callable[[], Callable[[list[str]], list[list[float]]]], batch: int = 256, prefix: str = "") -> tuple[int, int]:
    """Write each node shard with its embeddings under its own name in ``folder``; numbers of shards written and skipped.

    A shard that is there whole is skipped, so that a run that was cut short goes on where it stopped."""
    jvm = spark.sparkContext._jvm
    written = 0
    for shard in shards:
        name = shard.rstrip("/").rsplit("/", 1)[-1]
        done = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}/_SUCCESS")
        if done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
            continue
        rows = spark.read.parquet(shard)
        if missing := [n for n in NODE_COLUMNS.values() if n not in rows.columns]:
            raise ValueError(f"columns {missing} are missing in {shard}")
        nodes = rows.select(*[F.col(f"`{n}`").alias(c) for c, n in NODE_COLUMNS.items()])
        named = NODE_COLUMNS | {"embedding": EMBEDDING_COLUMN}
        embedded_nodes(nodes, embedder, batch, prefix).select(*[F.col(c).alias(n) for c, n in named.items()]).write.mode("overwrite").parquet(f"{folder}/{name}")
        written += 1
    return written, len(shards) - written


def token_counts(texts: DataFrame, encoder: Callable[[], Callable[[list[str]], list[int]]], text_col: str = "text") -> DataFrame:
    """Add ``n_tokens``; ``encoder`` makes, once in each task, a function from texts to their token counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = encoder()
        for rows in batches:
            own = rows.column(rows.schema.names.index(text_col)).to_pylist()
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(count([t or "" for t in own]), pa.int64())], names=[*rows.schema.names, "n_tokens"])

    return texts.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in [*texts.dtypes, ("n_tokens", "long")]))


def file_encoder(path: str) -> Callable[[], Callable[[list[str]], list[int]]]:
    """An encoder for ``token_counts`` of a tokenizer file; texts go to it together, up to 1 MB at a time."""

    def encoder() -> Callable[[list[str]], list[int]]:
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)

        def count(texts: list[str]) -> list[int]:
            out, held, size = [], [], 0
            for t in [*texts, None]:
                if t is None or size + len(t) > 1 << 20:
                    out += [len(e.ids) for e in tokenizer.encode_batch(held, add_special_tokens=False)]
                    held, size = [], 0
                if t is not None:
                    held.append(t)
                    size += len(t)
            return out

        return count

    return encoder


def write_batches(batched: DataFrame, folder: str) -> None:
    """A CSV folder for each ``batch``."""
    batched.write.mode("overwrite").partitionBy("batch").option("header", True).csv(folder)


def as_json_list(rows: DataFrame, order: str) -> DataFrame:
    """One row: all rows as a JSON list in ``order``, for result files of a few thousand questions."""
    fields = F.struct(*[c for c in rows.columns if c != order])
    return rows.agg(F.to_json(F.transform(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), fields.alias("row"))), lambda x, y: F.when(x["o"] < y["o"], -1).when(x["o"] > y["o"], 1).otherwise(0)), lambda x: x["row"])).alias("value"))


def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """Result CSVs with ``file``; texts may hold line breaks and quotes."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(pattern).withColumn("file", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1))
