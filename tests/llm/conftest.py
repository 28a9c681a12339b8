import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def phrase(rng, n, stock=400):
    return " ".join(f"w{rng.randrange(stock)}{'ä' if rng.random() < 0.1 else ''}" for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows with nulls, empty and long texts, exact and near copies, shared passages, repeated lines and rows."""
    rng = random.Random(5)
    passage, boiler = phrase(rng, 60, 4000), phrase(rng, 6, 4000)
    rows = [(None, None, None, None, None), (0, "", "en", "a", 0), (1, " \t\n ", "en", "a", 4), (2, None, "en", None, 0), (3, "two words", "en", "b", 9)]
    bases = [phrase(rng, rng.randrange(40, 160), 4000) for _ in range(12)]
    i = 10
    for k, base in enumerate(bases):
        rows.append((i, base, "en", "abc"[k % 3], len(base)))
        i += 1
    for _ in range(15):  # exact copies
        rows.append((i, bases[0], "en", "a", len(bases[0])))
        i += 1
    for k in range(15):  # near copies
        w = bases[1].split(" ")
        w[(7 * k) % len(w)] = f"edit{k}"
        rows.append((i, " ".join(w), "de", "b", 1))
        i += 1
    for _ in range(10):  # a passage, a common line and lines of their own
        own = [phrase(rng, 25, 4000) for _ in range(3)]
        rows.append((i, "\n".join([own[0], boiler, passage, own[1], "", own[2]]), "fr", "c", 1))
        i += 1
    rows.append((i, " ".join(["spam"] * 300), "en", "a", 1))
    rows.append((i + 1, " ".join(f"x{n}" for n in range(20000)), "en", "d", 1))
    rows += [rows[12], rows[12]]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    # extra columns that clash with names the operators use
    return spark.createDataFrame([(*r, 1, "x", 2.5) for r in corpus], DOCS + ", size int, key_a string, weight double").repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
