import random
import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))

#: Columns whose names the operators use themselves.
CLASHING = "key string, home string, component_id string, n_words string, rest string, chunk string, label string"


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(["alpha", "Beta", "gamma", "dé", "x1", "über", "the", "of", "and", "zeta", f"w{rng.randint(0, 400)}"]) for _ in range(n)) + "."


@pytest.fixture(scope="session")
def texts():
    """Nulls, empty and blank texts, very long ones, copies, near copies and shared passages."""
    shared = prose(99, 60)
    out = {1: prose(1, 200), 2: None, 3: "", 4: " \n\t ", 5: prose(5, 30_000), 6: "one", 7: "one two", 8: prose(1, 200), 9: prose(1, 200) + " tail"}
    out |= {i: prose(i, 80) + " " + shared + "\n" + prose(i + 1000, 40) for i in range(10, 30)}
    out |= {i: prose(7, 90) for i in range(30, 45)}
    out[45] = "Line one here is fine.\n" + "Home | About | Contact | Map\n" * 3 + prose(3, 120)
    out[46] = "\x1c odd \x85 white　space ﻿ \U0001f600 don't <|endoftext|> <|im_end|>\n\n  two"
    return out


@pytest.fixture(scope="session")
def docs(spark, texts):
    """With a clash of names in other columns, which are null."""
    return spark.createDataFrame([(i, t, *([None] * 7)) for i, t in texts.items()], f"doc_id long, text string, {CLASHING}").repartition(3)


@pytest.fixture(scope="session")
def odd(spark):
    """Rows without an id, and rows twice."""
    return spark.createDataFrame([(None, prose(1, 100)), (None, None), (1, prose(1, 100)), (1, prose(1, 100)), (2, None)], "doc_id long, text string")


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], "doc_id long, text string")
