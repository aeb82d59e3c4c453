"""Joining, filtering, batching and merging of evaluation records."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BATCH_ROWS = 32
SCORES = ("factual_correctness_precision_score", "factual_correctness_recall_score", "crag_score", "crag_v3_score", "answer_relevancy_score")
#: Columns of an experiment's result rows, fixed by the files.
RESULT_SCHEMA = (
    "ex_num long, query string, expected_answer string, decomposition string, agent_answer string, agent_explanation string, agent_references string, error string, success boolean, "
    + ", ".join(f"{s} double" for s in SCORES)
    + ", agent_settings string, models string, agent_reasoning string, function_calls string, token_usage string, timestamp timestamp_ntz"
)


class RecordError(ValueError):
    """Records that contradict each other."""


def last_of_each(rows: DataFrame, key: str, position: str) -> DataFrame:
    """Of rows with one key the one with the highest position."""
    rank = Window.partitionBy(key).orderBy(F.desc(position))
    return rows.withColumn("_r", F.row_number().over(rank)).filter("_r = 1").drop("_r")


def release_questions(matches: DataFrame, release: DataFrame) -> DataFrame:
    """ex_num, question, decomposition, validated_answer of matched questions, in order of ``pos``.

    A match without release row, or with another question text, raises RecordError."""
    own = release.select("ex_num", F.col("question").alias("released"), "decomposition", "validated_answer")
    joined = matches.join(own, "ex_num", "left")
    wrong = joined.filter(F.col("released").isNull() | (F.col("released") != F.col("question"))).select("ex_num").limit(20).collect()
    if wrong:
        raise RecordError(f"questions that are missing or differ in the release: {[r[0] for r in wrong]}")
    return joined.orderBy("pos").select("ex_num", "question", "decomposition", "validated_answer")


def accepted_questions(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """Matches none of whose sources has a title rejected in ``decisions`` (matched, accept as text)."""
    rejected = decisions.filter("accept = 'False'").select(F.col("matched").alias("title")).distinct()
    hit = matches.select("ex_num", F.explode("sources").alias("s")).select("ex_num", F.col("s.title").alias("title")).join(rejected, "title", "left_semi").select("ex_num").distinct()
    return matches.join(hit, "ex_num", "left_anti")


def removal_totals(before: DataFrame, after: DataFrame) -> DataFrame:
    """questions and sources before and after, one row."""
    count = lambda df, p: df.agg(F.count("*").alias(f"questions_{p}"), F.coalesce(F.sum(F.size("sources")), F.lit(0)).alias(f"sources_{p}"))
    return count(before, "before").join(count(after, "after"))


def replay_decisions(corrections: DataFrame, decisions: DataFrame) -> DataFrame:
    """original, matched, score, accept, files of corrections (with ``file``) that were decided before; a row for each pair."""
    pairs = corrections.groupBy("original", "matched").agg(F.max("score").alias("score"), F.sort_array(F.collect_set("file")).alias("files"))
    decided = decisions.groupBy("original", "matched").agg(F.max("accept").alias("accept"))
    return pairs.join(decided, ["original", "matched"]).select("original", "matched", "score", "accept", "files")


def decided_rows(corrections: DataFrame, decisions: DataFrame) -> DataFrame:
    """original, matched, score, accept: every correction row with the decision on its pair.

    A pair without a decision raises RecordError."""
    decided = decisions.groupBy("original", "matched").agg(F.max("accept").alias("accept"))
    rows = corrections.join(decided, ["original", "matched"], "left").select("original", "matched", "score", "accept")
    open_pairs = rows.filter("accept is null").select("original", "matched").distinct().limit(20).collect()
    if open_pairs:
        raise RecordError(f"corrections without a decision: {[tuple(r) for r in open_pairs]}")
    return rows


def batches(questions: DataFrame, rows: int = BATCH_ROWS, order: str = "pos") -> DataFrame:
    """Add ``batch``: 0 for the first ``rows`` positions (gapless from 0), and so on."""
    return questions.withColumn("batch", F.floor(F.col(order) / rows).cast("int"))


def merge_runs(originals: DataFrame, repeats: DataFrame, not_null: list[str], settings: tuple[str, ...] = ("agent_settings", "models"), key: tuple[str, ...] = ("query", "ex_num"), success_only: bool = False) -> DataFrame:
    """Rows of both runs with all of ``not_null`` present.

    Raises AssertionError if the runs differ in a column of ``settings`` that they have, and KeyError if a key occurs twice."""
    kept = originals.dropna(subset=not_null).unionByName(repeats.dropna(subset=not_null))
    if success_only:
        kept = kept.filter(F.col("success").cast("boolean"))
    for column in settings:
        if column in kept.columns and kept.select(column).distinct().limit(2).count() > 1:
            raise AssertionError(f"the runs differ in {column}")
    twice = kept.groupBy(*key).count().filter("count > 1").limit(1).collect()
    if twice:
        raise KeyError(f"{dict(zip(key, twice[0], strict=False))} occurs more than once")
    return kept


def merge_batches(files: DataFrame) -> DataFrame:
    """Result rows of several files (with ``file``) in order of file name."""
    return files.orderBy("file")


def token_usage(runs: DataFrame) -> DataFrame:
    """ex_num, tool, calls, tokens from runs whose ``messages`` are JSON arrays of {name, usage: {total_tokens}}."""
    kind = "array<struct<name: string, usage: struct<total_tokens: long>>>"
    each = runs.select("ex_num", F.explode(F.from_json("messages", kind)).alias("m"))
    return each.groupBy("ex_num", F.coalesce("m.name", F.lit("")).alias("tool")).agg(F.count("*").alias("calls"), F.coalesce(F.sum("m.usage.total_tokens"), F.lit(0)).alias("tokens"))


def agent_records(runs: DataFrame) -> DataFrame:
    """``runs`` with ``token_usage``, ``function_calls``, ``agent_reasoning`` (JSON lists) and ``model`` of its ``messages``.

    ``messages`` is a JSON array as agents log it; only those of type ``ai`` count: their usage_metadata,
    the items of their content by type, and the first model_name. Messages that cannot be read give empty lists."""
    kind = "array<struct<type: string, content: array<string>, usage_metadata: string, response_metadata: struct<model_name: string>>>"
    spoken = F.filter(F.coalesce(F.from_json("messages", kind), F.from_json(F.lit("[]"), kind)), lambda m: m["type"] == "ai")
    items = F.flatten(F.transform(spoken, lambda m: F.coalesce(m["content"], F.expr("cast(array() AS array<string>)"))))
    as_list = lambda values: F.concat(F.lit("["), F.array_join(values, ",", "null"), F.lit("]"))
    of_type = lambda name: as_list(F.filter(items, lambda i: F.get_json_object(i, "$.type") == name))
    models = F.filter(F.transform(spoken, lambda m: m["response_metadata"]["model_name"]), lambda n: n.isNotNull())
    return runs.withColumns({"token_usage": as_list(F.transform(spoken, lambda m: m["usage_metadata"])), "function_calls": of_type("function_call"), "agent_reasoning": of_type("reasoning"), "model": F.try_element_at(models, F.lit(1))})


def result_rows(runs: DataFrame, settings: str, evaluator: str, embeddings: str) -> DataFrame:
    """Result rows (``RESULT_SCHEMA``) of judged runs: ``agent_records`` with ex_num, query, expected_answer, decomposition, the agent's answer and the scores; absent columns are null.

    ``error`` is a JSON list; a run succeeded if it is empty."""
    named = {f.split()[0]: f.split()[1] for f in RESULT_SCHEMA.split(", ")}
    models = F.to_json(F.struct(F.col("model").alias("generator"), F.lit(evaluator).alias("evaluator_model"), F.lit(embeddings).alias("evaluator_embeddings")))
    error = F.coalesce(F.col("error"), F.lit("[]")) if "error" in runs.columns else F.lit("[]")
    made = {"error": error, "success": error == "[]", "agent_settings": F.lit(settings), "models": models}
    return runs.select(*[(made[c] if c in made else F.col(c) if c in runs.columns else F.lit(None)).cast(t).alias(c) for c, t in named.items()])


def answerable_share(summary: DataFrame) -> DataFrame:
    """tag, percentage of answerable questions."""
    return summary.select("tag", (F.col("answerable") / F.col("total") * 100).alias("percentage"))


def scaled_tokens(texts: DataFrame, counted: DataFrame) -> DataFrame:
    """texts, tokens, estimate for all ``texts`` in proportion to those ``counted`` (n_tokens)."""
    part = counted.agg(F.count("*").alias("counted"), F.sum("n_tokens").alias("tokens"))
    return texts.agg(F.count("*").alias("texts")).join(part).select("texts", "counted", "tokens", F.round(F.col("tokens") / F.col("counted") * F.col("texts")).cast("long").alias("estimate"))
