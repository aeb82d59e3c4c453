"""Texts and frames for the tests of the training-data operators."""

import random

WORDS = [a + b for a in "bcdfghklmnprst" for b in ("a", "en", "io", "ur", "é", "ond", "ist")]


def prose(seed: int, n: int) -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) + rng.choice(["", "", "", ".", ",", "\n"]) for _ in range(n))


#: Names that clash with columns that the operators make.
CLASH = "doc_id long, text string, lang string, source string, n_chars long, node string, label string, spans string, slot int, toxicity double, quality double, fingerprint string, n_words string, hit_items string, _node string, sequence_id string, shard string, class_id string, `a b` string"


def frame(spark, rows):
    """Documents of (doc_id, text) with every extra column set."""
    return spark.createDataFrame([(d, t, "en" if d else None, f"src{(d or 0) % 3}", None if t is None else len(t), *["own"] * 3, 1, 0.5, 0.5, *["own"] * 8) for d, t in rows], CLASH)
