"""Small tables with everything that can go wrong in them, and plain Python versions of the results."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FOLD = str.maketrans(UPPER, UPPER.lower())

#: Names that operators might use themselves.
CLASHING = ("_row", "_h1", "key", "kept", "term", "pos", "low", "label", "bucket", "n_hit", "row", "length", "lang_pred", "first")

LONG = " ".join(f"wort{i % 911} und x{i % 37}" for i in range(30_000))

DOCUMENTS = [
    (1, "One two three four five six seven eight nine ten eleven twelve.", "en", "s", 1),
    (2, "one TWO three four five six seven eight nine ten eleven twelve.", "en", "s", None),
    (2, "one TWO three four five six seven eight nine ten eleven twelve.", "en", "s", None),
    (3, "", "en", None, 0),
    (4, None, None, None, None),
    (5, LONG, "de", "s", 9),
    (6, "   \n\t ", "de", "s", 9),
    (None, "null ids have a text as well", None, "s", 9),
    (None, None, None, None, None),
    (7, "word", "en", "s", 9),
    (7, "another text under the same id, mail a.b@c.de or +49 (30) 1234-5678", "en", "s", 9),
    (8, "Ünïcode ßtraße 日本語 \U0001f600 10.0.0.1 und 4111 1111 1111 1111", "de", "s", 9),
    (9, "word", "en", "s", 9),
    (10, "12345 67890 --- !!!", "en", "s", 9),
]


def documents(spark: SparkSession, rows=DOCUMENTS) -> DataFrame:
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({name: F.lit(f"mine {name}") for name in CLASHING})


def no_documents(spark: SparkSession) -> DataFrame:
    return documents(spark, [])


def words(text: str | None) -> list[str]:
    """Words of the benchmark search."""
    return re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", (text or "").translate(FOLD))


def shingles(text: str | None, n: int) -> frozenset[tuple[str, ...]]:
    w = re.findall("[^\x20\x09-\x0d]+", (text or "").translate(FOLD))
    return frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset()


def find_components(sets: list[frozenset], percent: int = 80) -> list[int]:
    """For each set the first number of its component; empty sets are alone."""
    root = list(range(len(sets)))

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * min(len(a), len(b)) >= percent * max(len(a), len(b)) and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((top(i), top(j)))
                root[y] = x
    return [top(i) for i in range(len(sets))]
