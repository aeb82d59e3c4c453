"""Execution traces: JSON files whose top-level key is the question itself."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A key that marks the data set and is no question.
CANARY = "canary"


def read_traces(spark: SparkSession, folder: str) -> DataFrame:
    """ex_num (from ``..._ex_<n>.json``), question, source_url: a row for each link, one with a null link for a question without any."""
    raw = spark.read.text(f"{folder}/*_ex_*.json", wholetext=True).select(F.regexp_extract(F.col("_metadata.file_path"), r"_ex_(\d+)\.json$", 1).cast("long").alias("ex_num"), F.map_entries(F.from_json("value", "map<string, string>")).alias("entries"))
    own = raw.select("ex_num", F.get(F.filter("entries", lambda e: e["key"] != CANARY), F.lit(0)).alias("e")).select("ex_num", F.col("e.key").alias("question"), F.from_json("e.value", "struct<provenance: map<string, string>>").alias("body"))
    parts = F.filter(F.coalesce(F.map_values("body.provenance"), F.expr("cast(array() AS array<string>)")), lambda p: p.startswith("["))
    links = F.flatten(F.transform(parts, lambda p: F.flatten(F.transform(F.from_json(p, "array<struct<source_url: array<string>>>"), lambda d: F.coalesce(d["source_url"], F.expr("cast(array() AS array<string>)"))))))
    return own.select("ex_num", "question", F.explode_outer(links).alias("source_url"))
