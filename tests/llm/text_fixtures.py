"""Fixtures and rows that the text tests share."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import types as T

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
        *[T.StructField(n, T.StringType()) for n in ("block", "kept", "n", "score", "epoch", "ID", "key")],
        T.StructField("marks", T.ArrayType(T.IntegerType())),
    ]
)


def prose(rng: random.Random, n: int) -> str:
    parts = ("er th on an re he in ed ha at en or ti ing tion ou st sh é ß ñ").split()
    return " ".join("".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(n))


def texts() -> list[str | None]:
    """Null, empty, blank, short, exact and near copies, shared passages, junk and one long text."""
    rng = random.Random(3)
    long = prose(rng, 6000)
    passage, base = prose(rng, 90), prose(rng, 200)
    near = base.split(" ")
    near[40], near[120] = "changed", "again"
    out = [None, "", " \n\t ", "one", "one", "One", "a b c", "a b c d e f", long]
    out += [base, base, base, " ".join(near), base.upper(), f"{prose(rng, 60)}\n{passage}\n{prose(rng, 30)}"]
    out += [f"{passage} {prose(rng, 50)}", f"{prose(rng, 20)}  {passage}", "Der " * 300, "x" * 3000, "ab" * 900]
    out += [prose(rng, 80).upper().replace(" ", "!! ") + "!!", prose(rng, 60).replace(" ", "### ")]
    out += ["same line here\n" * 6 + prose(rng, 40), "🙂 日本語 é " * 70, "\x1c\x85 ​ mixed space"]
    out += [prose(rng, rng.randint(1, 120)) for _ in range(40)]
    out += [prose(rng, 300) + " " + long[5000:9000]]
    return out


def frame(spark, values, first: int = 1):
    rows = []
    for i, t in enumerate(values, first):
        lang, source = (None, None) if i % 11 == 0 else (("en", "de", "fr")[i % 3], f"src{i % 3 * (i % 2)}")
        rows.append((i, t, lang, source, None if t is None else len(t), "b", "k", "n", "s", "e", None, "y", [i]))
    return spark.createDataFrame(rows, DOCS).repartition(3)


@pytest.fixture(scope="session")
def docs(spark):
    return frame(spark, texts()).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def lone_docs(spark):
    """Rows without id, a row that comes twice, and nulls in every column."""
    rows = [(None, t, None, None, None, *[None] * 8) for t in (None, "", "one two three", "one two three")]
    rows += [(7, "again and again", "en", "src1", 15, *["x"] * 7, [1])] * 2
    return spark.createDataFrame(rows, DOCS)
