"""A cleaning pipeline over ``documents``: each stage takes what the one before kept.

toxicity drops documents scored toxic; near_duplicates keeps one document of each class;
repeated_passages cuts passages of over 50 words that occur before out of the texts;
decontamination drops documents that hold a benchmark window; packing places what is left
in token sequences.

Every stage takes null and empty texts, null ids, ids that repeat, repeated rows, texts of
any length, empty tables and any further columns, and but for the last returns the columns
that it got. What becomes of each case is said at the stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graphleaf.llm import decontaminate, near_dedup, packing, suffix_dedup, toxicity
from graphleaf.llm.common import materialise, table


#: Strings of so many bytes that start again are found, and cut where a run of them has so many words; 51 words of prose take some 300 bytes.
PASSAGE_BYTES, PASSAGE_GRAM, PASSAGE_WORDS = 250, 48, 51


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose text scores below 0.5 for toxicity; null and empty texts score 0 and stay, repeated rows score alike."""
    return toxicity.remove_toxic(docs, toxicity.trained(docs, table(spark, sf_dir, "labels")))


def keep_one_of_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates, of its least id; null and empty texts are one class, rows without id all stay, and an id that has several texts keeps those that lead a class."""
    return near_dedup.one_of_each_class(docs)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without passages of over 50 words that occur before (by id, then place); every row stays, a text that repeats whole becoming empty, a null text null."""
    return suffix_dedup.remove_passages(docs, length=PASSAGE_BYTES, gram=PASSAGE_GRAM, keep_first=True, least_words=PASSAGE_WORDS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a word inside a benchmark window; texts without words stay, and with an empty benchmark all do."""
    return decontaminate.remove_contaminated(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The place of each piece of each document's token ids; null and empty texts are the end id alone, repeated rows are packed each."""
    return packing.pack(docs, packing.default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", keep_one_of_near_duplicates),
    ("repeated_passages", cut_repeated_passages),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL cannot say the fitted scores, sketches or token ids; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
