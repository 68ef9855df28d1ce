import random

import pytest
from pyspark.sql import types as T

SCHEMA = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("text", T.StringType()),
    T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()),
    T.StructField("n_chars", T.LongType()),
    # names that the operators use themselves
    T.StructField("row", T.StringType()),
    T.StructField("bits", T.LongType()),
    T.StructField("kept", T.StringType()),
    T.StructField("score", T.StringType()),
    T.StructField("part", T.StringType()),
    T.StructField("length", T.StringType()),
])


def words(seed, count, letters="abcdefgh"):
    draw = random.Random(seed)
    return " ".join("".join(draw.choice(letters) for _ in range(draw.randint(1, 7))) for _ in range(count))


def texts():
    """Prose in two made-up languages, copies, near copies, repeated lines, one very long text."""
    found = [words(i, 60 + 7 * i, "abcdefgh" if i % 2 else "nopqrstuv") for i in range(40)]
    found += [found[0]] * 5 + [found[1] + " tail"] * 3
    found += ["shared line of text\n" + words(100 + i, 30) + "\n  SHARED line of text " for i in range(12)]
    found += [words(7, 30_000), "one", "two words", "é ü 日本 😀\n\n\tX", "   \n ", "### $$$ ||| <x> & %"]
    return found


@pytest.fixture(scope="session")
def corpus(spark):
    rows = [(i, t, "a" if i % 2 else "b", f"s{i % 2}", len(t), "x", i, None, "y", "z", "w") for i, t in enumerate(texts())]
    rows += [(900, None, None, None, None, None, None, None, None, None, None), (901, "", "a", "s0", 0, None, None, None, None, None, None)]
    rows += [rows[3], rows[3], (None, "no id here", None, "s1", 10, None, None, None, None, None, None)]
    return spark.createDataFrame(rows, SCHEMA).repartition(5).cache()


@pytest.fixture(scope="session")
def no_rows(spark):
    return spark.createDataFrame([], SCHEMA)
