import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, th string, n int, keys string, spans string, rest string"


@pytest.fixture(scope="session")
def make_docs():
    """A table of documents with extra columns whose names clash with those that operators use inside."""

    def make(spark, rows):
        return spark.createDataFrame([(i, t, "en", "s", len(t) if t is not None else None, "th", 1, "k", "s", "r") for i, t in rows], SCHEMA)

    return make


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls, empty and long texts, copies, near copies, a repeated row, a null id, shared passages, other scripts."""
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)] + ["Ünï", "漢字", "it's"]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = say(70), say(120)
    near = base.split()
    near[60] = "changed"
    rows = [(1, None), (2, ""), (3, "  \n\t"), (4, base), (5, base), (6, " ".join(near)), (7, say(30) + " " + passage + " " + say(20)), (8, say(10) + "\n" + passage + "\t" + say(40)), (9, say(9000)), (10, "a" * 900), (11, "x y " * 300)]
    rows += [(12, say(50)), (12, rows[-1][1]), (13, "one"), (14, "one two"), (15, "One TWO"), (None, base), (None, None)]
    rows.append((16, rows[11][1]))
    rows.append((16, rows[11][1]))
    return rows
