"""The turn log: one JSON event a line, appended while experiments run.

The log may be read as a table or followed as a stream; the stream's counts of each
event a minute are an addition of this engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TURN_SCHEMA = "event string, logged_at timestamp, ex_num long, name string, tool string, message string"
#: Names of the events that the log may hold.
EVENTS = ("question", "status", "llm_start", "llm_end", "llm_error", "tool_start", "tool_end", "tool_error", "evaluator_call_start", "judge", "judge_error")


def turn_log(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(TURN_SCHEMA).json(path).filter(F.col("event").isin(*EVENTS))


def turn_stream(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(TURN_SCHEMA).json(path).filter(F.col("event").isin(*EVENTS))


def events_by_minute(turns: DataFrame, late: str = "10 minutes") -> DataFrame:
    """minute, event, n; on a stream, events more than ``late`` behind are dropped."""
    own = turns.withWatermark("logged_at", late) if turns.isStreaming else turns
    return own.groupBy(F.window("logged_at", "1 minute").alias("w"), "event").agg(F.count("*").alias("n")).select(F.col("w.start").alias("minute"), "event", "n")
