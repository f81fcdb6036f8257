import re

import pytest
from pyspark.sql import types as T

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))


def _document(rng, n):
    return " ".join("".join(rng.choice("aeioutnrs") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.StringType())])


@pytest.fixture(scope="session")
def odd_rows():
    """Nulls everywhere, empty and long texts, repeated rows, a column named like a result."""
    import random
    rng = random.Random(5)
    long = _document(rng, 12_000)
    base = _document(rng, 80)
    texts = [None, "", " ", "\n\n", "a", "Z z", "été \U0001f600\U0001f600 x\U0001f600y", base, base, base.replace("a", "A"), long, base + " more",
             "tab\tand\x0bfeed\r\n", "<s>[INST] \\ </s>", "▁ ▁▁ x"]
    rows = [(i, t, "en" if i % 2 else None, None if i % 3 else "s", None, "clash") for i, t in enumerate(texts)]
    return [*rows, rows[7], (None, base, None, None, None, None), (None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd(spark, odd_rows):
    return spark.createDataFrame(odd_rows, DOCUMENTS)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCUMENTS)
