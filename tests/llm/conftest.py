import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

from llm_helpers import frame, prose  # noqa: E402


@pytest.fixture(scope="session")
def hard(spark):
    """Null, empty, wordless, short, very long and equal texts, repeated rows and null ids."""
    long = prose(1, 60_000)
    copies = [(20 + i, prose(2, 150)) for i in range(5)]
    rows = [(0, None), (1, ""), (2, "!!! ... "), (3, "one"), (4, long), (5, prose(3, 80)), (5, prose(3, 80)), (6, "é" * 700), (None, prose(4, 90)), (7, "x y " * 400), (8, prose(2, 150) + " " + prose(5, 100)), *copies]
    return frame(spark, rows)


@pytest.fixture(scope="session")
def nothing(spark):
    return frame(spark, [(1, "x")]).limit(0)
