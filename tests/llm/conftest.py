import pytest
from pyspark.sql import types as T


@pytest.fixture(scope="session")
def documents(spark):
    """A small documents table with awkward rows: nulls in every column, empty and long texts, ties, repeats, more columns."""
    import random

    rng = random.Random(7)
    words = ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randint(2, 8))) for _ in range(3000)]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", "", ",", ".\n"]) for _ in range(n))
    base, passage, long = prose(200), prose(80), prose(30_000)
    texts = [base, base, base.replace(base.split()[5], "changed"), prose(150) + " " + passage + " " + prose(100), passage + " " + prose(60), prose(50), None, "", "   \n ", "x", "A b", long, "12 34 !!", prose(300)]
    rows = [(i, t, ["en", "de", None][i % 3], f"src{i % 2}", None if t is None else len(t), "clash", i) for i, t in enumerate(texts)]
    rows += [rows[0], rows[0], (None, prose(40), None, None, None, None, None), (None, None, None, None, None, None, None), (-5, base + " tail", "en", "s", 1, "z", 2)]
    schema = T.StructType(
        [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
        + [T.StructField("score", T.StringType()), T.StructField("n", T.LongType())]
    )
    return spark.createDataFrame(rows, schema).repartition(3).cache()


@pytest.fixture(scope="session")
def rows_of(documents):
    return sorted(((r["doc_id"], r["text"]) for r in documents.collect()), key=repr)


@pytest.fixture(scope="session")
def no_documents(documents):
    return documents.limit(0)
