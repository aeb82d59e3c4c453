"""Command lines of the build and evaluation steps: ``python -m graphleaf.commands <command> ...``.

Each takes paths that Spark can read and write; worker counts and devices are the cluster's matter.
"""

from __future__ import annotations

import argparse

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphleaf.functions import text as X
from graphleaf.functions.english import english_words
from graphleaf.operators import evaluation as E
from graphleaf.operators import graph as G
from graphleaf.operators import search as S
from graphleaf.operators import vector_index as V
from graphleaf.operators.text_index import build_text_index
from graphleaf.session import session
from graphleaf.sources import dump as D
from graphleaf.sources import exports as K
from graphleaf.sources.traces import read_traces
from graphleaf.tables import numbered, written_folder

#: Up to so many streams are picked by their offsets; more are read whole and joined.
MOST_OFFSETS = 50_000
MATCHES = "ex_num long, question string, sources array<struct<page_id: string, title: string>>"


def index_files(a: argparse.Namespace, dump: str) -> list[str]:
    """The index named, or with ``-`` those beside the dump or the dumps of the folder."""
    if a.index != "-":
        return [a.index]
    found = [index for _, index in D.index_pairs(dump)]
    if not found:
        raise SystemExit(f"no index beside {dump}: make one with build_index")
    return found


def build_index(spark: SparkSession, a: argparse.Namespace) -> None:
    D.index_lines(spark, a.dump).write.mode("overwrite").text(a.output)


def wanted_pages(spark: SparkSession, a: argparse.Namespace) -> DataFrame | None:
    """page_id of the pages chosen by ids in matches; null if none are chosen that way."""
    if not a.matches_jsonl:
        return None
    rows = spark.read.schema(MATCHES).json(a.matches_jsonl)
    if a.question:
        rows = rows.filter(F.col("ex_num").isin(*a.question))
    return rows.select(F.explode("sources").alias("s")).select(F.col("s.page_id").cast("long").alias("page_id")).distinct()


def wiki2parquet(spark: SparkSession, a: argparse.Namespace) -> None:
    """Nodes and edges of a dump, or of the chosen pages of it with stubs for what they refer to."""
    X.check_chunking(a.chunk_size, a.chunk_overlap)
    index = D.read_index(spark, index_files(a, a.dump))
    ids, pages = wanted_pages(spark, a), None
    if a.title or ids is not None:
        titles = spark.createDataFrame([(t,) for t in a.title], "title string") if a.title else None
        found = D.matched_entries(index, titles, ids)
        if titles is not None:
            D.require_all(titles.select(X.canon_title(F.col("title")).alias("title")), found, "title")
        if ids is not None:
            D.require_all(ids, found, "page_id")
        offsets = [r[0] for r in found.select("offset").distinct().limit(MOST_OFFSETS + 1).collect()]
        pages = D.multistream(spark, a.dump, offsets=offsets if len(offsets) <= MOST_OFFSETS else None).join(found.select("page_id").distinct(), "page_id", "left_semi")
        D.require_all(found, pages, "page_id")
    else:
        pages = D.multistream(spark, a.dump)
    if a.namespace_id:
        pages = pages.filter(F.col("ns").isin(*a.namespace_id))
    D.require_unique(pages)
    graph = D.graph_of_pages(pages, index, a.chunk_size, a.chunk_overlap)
    K.write_nodes(G.nodes(graph), a.output, a.shard_size)
    K.write_edges(G.edges(graph), a.output, a.shard_size)


def materialize_mentions(spark: SparkSession, a: argparse.Namespace) -> None:
    """The edges of one folder and their MENTIONS, in another."""
    edges = K.read_shards(spark, a.input, "edges", K.EDGE_COLUMNS)
    first = K.write_edges(edges, a.output)
    K.write_edges(G.mentions_of_edges(edges), a.output, first=first)


def load_traces(spark: SparkSession, a: argparse.Namespace) -> None:
    titles = D.read_index(spark, index_files(a, a.dump)).select("page_id", "title")
    index = build_text_index(titles, a.title_index or written_folder(spark), english_words)
    matches, corrections, unmatched = S.process_traces(read_traces(spark, a.traces), titles, a.fts_limit, index)
    matches.write.mode("overwrite").json(a.matches)
    corrections.write.mode("overwrite").option("header", True).csv(a.corrections)
    if a.unmatched_csv:
        unmatched.write.mode("overwrite").option("header", True).csv(a.unmatched_csv)
        unmatched = spark.read.schema("ex_num long, title string").option("header", True).csv(a.unmatched_csv)
    row = S.trace_counts(spark.read.schema(MATCHES).json(a.matches), spark.read.option("header", True).csv(a.corrections), unmatched).first()
    print(f"Results: {row['results']}\nSources: {row['sources']}\nCorrections: {row['corrections']}\nUnmatched: {row['unmatched']}")


def humaneval_corrections(spark: SparkSession, a: argparse.Namespace) -> None:
    """Each corrections file with the decisions on its rows, beside it as ``...-humaneval.csv``."""
    decisions = spark.read.option("header", True).csv(a.decisions)
    for path in a.files:
        rows = E.decided_rows(spark.read.option("header", True).csv(path), decisions)
        rows.write.mode("overwrite").option("header", True).csv(f"{path.rstrip('/').removesuffix('.csv')}-humaneval.csv")


def join_batches(spark: SparkSession, a: argparse.Namespace) -> None:
    """The result files of one experiment as one, in order of file name."""
    rows = K.read_results(spark, a.files)
    if rows.select("file").distinct().limit(2).count() < 2:
        raise SystemExit("at least two files are needed")
    E.merge_batches(rows).drop("file").write.mode("overwrite").option("header", True).option("escape", '"').csv(a.output)


def merge_experiments(spark: SparkSession, a: argparse.Namespace) -> None:
    """Failed rows of a run replaced by those of its repeat."""
    first, again = (K.read_results(spark, p).drop("file") for p in (a.original, a.repeats))
    merged = E.merge_runs(first, again, ["agent_answer", "crag_score", "crag_v3_score"], success_only=a.success_only)
    merged.write.mode("overwrite").option("header", True).option("escape", '"').csv(a.output)


def embed_parquet(spark: SparkSession, a: argparse.Namespace) -> None:
    """Node shards with embeddings in another folder; shards that are there are skipped."""

    def embedder():
        from sentence_transformers import SentenceTransformer

        model = SentenceTransformer(a.model)
        return lambda texts: model.encode(texts, batch_size=a.batch_size).tolist()

    written, skipped = K.embed_shards(spark, a.files, a.out_dir, getattr(a, "embedder", embedder), a.batch_size, a.prefix)
    print(f"Written: {written}\nSkipped: {skipped}")


def build_vector_index(spark: SparkSession, a: argparse.Namespace) -> None:
    """An index of the embeddings of one label's nodes: an article's id is its page's number, other ids are node ids."""
    nodes = spark.read.parquet(*a.files)
    id_column, label = (F.col(f"`{K.NODE_COLUMNS[c]}`") for c in ("nodeID", "label"))
    own = nodes.filter((label == a.label) & F.col(f"`{K.EMBEDDING_COLUMN}`").isNotNull())
    page = F.regexp_extract(id_column, "^article:([0-9]+)$", 1).try_cast("long")
    rows = own.select((page if a.label == "Article" else id_column).alias("id"), F.split(F.col(f"`{K.EMBEDDING_COLUMN}`"), ";").cast("array<float>").alias("embedding"))
    index = V.build_index(rows, a.folder, "id")
    print(f"Lists: {len(index.radius)}\nProbed: {index.probes}\nShort list: {index.short}")


def filter_by_humaneval(spark: SparkSession, a: argparse.Namespace) -> None:
    decisions = spark.read.option("header", True).csv(a.decisions)
    E.accepted_questions(spark.read.schema(MATCHES).json(a.matches), decisions).write.mode("overwrite").json(a.output)


def filter_questions(spark: SparkSession, a: argparse.Namespace) -> None:
    """Matched questions with the release's decomposition and answers, as a JSON list."""
    raw = spark.read.text(a.release_jsonl).withColumn("pos", F.monotonically_increasing_id())
    parsed = raw.select("pos", F.from_json("value", "ex_num long, question string, decomposition array<string>, validated_answer variant").alias("r"))
    release = E.last_of_each(parsed.select("pos", "r.*"), "ex_num", "pos").drop("pos")
    matches = spark.read.schema(MATCHES).json(a.matches).select("ex_num", "question", F.monotonically_increasing_id().alias("pos"))
    ordered = E.release_questions(matches, release).join(matches.select("ex_num", "pos"), "ex_num")
    K.as_json_list(ordered, "pos").write.mode("overwrite").text(a.output)


def list_namespaces(spark: SparkSession, a: argparse.Namespace) -> None:
    for r in D.namespaces(D.multistream(spark, a.dump)).collect():
        print(r["ns"])


def count_tokens(spark: SparkSession, a: argparse.Namespace) -> None:
    nodes = K.read_shards(spark, a.nodes, "nodes", K.NODE_COLUMNS).filter(X.strip(F.col(a.text_col)) != "")
    row = K.token_counts(nodes, K.file_encoder(a.tokenizer), a.text_col).agg(F.count("*").alias("texts"), F.coalesce(F.sum("n_tokens"), F.lit(0)).alias("tokens")).select("texts", "tokens", X.short_count(F.col("tokens")).alias("short")).first()
    print(f"Texts: {row['texts']}\nTokens: {row['tokens']} ({row['short']})")


def make_batches(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = numbered(spark.read.option("multiLine", True).json(a.questions))
    text = {c: F.to_json(c) if t.startswith("array") else F.col(c).cast("string") for c, t in rows.dtypes if c != "pos"}
    K.write_batches(E.batches(rows.select("pos", *[v.alias(c) for c, v in text.items()])), a.output)


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="graphleaf")
    commands = top.add_subparsers(dest="command", required=True)

    def add(run, *positional: str) -> argparse.ArgumentParser:
        p = commands.add_parser(run.__name__, help=run.__doc__)
        for name in positional:
            p.add_argument(name)
        p.set_defaults(run=run)
        return p

    add(build_index, "dump").add_argument("--output", required=True)
    p = add(wiki2parquet, "dump", "index", "output")
    p.add_argument("--title", action="append", default=[])
    p.add_argument("--namespace-id", action="append", type=int, default=[])
    p.add_argument("--matches-jsonl")
    p.add_argument("--question", action="append", type=int, default=[])
    p.add_argument("--shard-size", type=int, default=K.SHARD_ROWS)
    p.add_argument("--chunk-size", type=int, default=X.CHUNK_SIZE)
    p.add_argument("--chunk-overlap", type=int, default=X.CHUNK_OVERLAP)
    add(materialize_mentions, "input", "output")
    p = add(load_traces, "index", "traces", "matches", "corrections")
    p.add_argument("--dump", help="with index -: the dump or folder of dumps that the indexes are beside")
    p.add_argument("--fts-limit", type=int, default=S.FTS_LIMIT)
    p.add_argument("--title-index", help="folder to keep the titles' full-text index in")
    p.add_argument("--unmatched-csv")
    add(humaneval_corrections, "decisions").add_argument("files", nargs="+")
    add(join_batches, "files", "output")
    add(merge_experiments, "original", "repeats", "output").add_argument("--success-only", action="store_true")
    p = add(embed_parquet)
    p.add_argument("files", nargs="+")
    p.add_argument("--model", required=True)
    p.add_argument("--batch-size", type=int, default=256)
    p.add_argument("--prefix", default="")
    p.add_argument("--out-dir", required=True)
    p = add(build_vector_index)
    p.add_argument("files", nargs="+")
    p.add_argument("--folder", required=True)
    p.add_argument("--label", default="Article", choices=["Article", "Chunk"])
    add(filter_by_humaneval, "decisions", "matches", "output")
    add(filter_questions, "matches", "output").add_argument("--release-jsonl", required=True)
    add(list_namespaces, "dump")
    p = add(count_tokens, "nodes")
    p.add_argument("--tokenizer", required=True)
    p.add_argument("--text-col", default="text")
    add(make_batches, "questions", "output")
    return top


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    a = parser().parse_args(arguments)
    a.run(spark or session(), a)


if __name__ == "__main__":
    main()
