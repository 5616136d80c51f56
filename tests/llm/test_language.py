import random
import re
import zlib

import numpy as np
import pytest

import emberline.llm.queries as queries
from emberline.llm.language_id import DIMENSIONS, SEED, held_out, identify, learn_prototypes


def test_held_out_accuracy(spark):
    found = queries.op2_language(spark, "/root/testdata/sf0.01").collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang").collect()}
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1 for r in found)
    held = [r for r in found if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in held) >= 0.99 * len(held) and len(found) == len(truth)


def test_awkward_rows(documents, no_documents):
    learned = learn_prototypes(documents.where(~held_out()))
    assert set(learned) <= {"en", "de"}
    found = identify(documents, learned)
    assert found.count() == documents.count() and found.columns == ["doc_id", "text", "lang", "source", "n_chars", "n", "lang_pred", "score"]
    for r in found.collect():
        letters = any(c.isalpha() for c in r["text"] or "")
        assert (r["lang_pred"] == "und") == (not letters) and (letters or r["score"] == 0)
    assert identify(no_documents, learned).count() == 0
    assert learn_prototypes(no_documents) == {}
    assert {r["lang_pred"] for r in identify(documents, {}).collect()} == {"und"}


def test_prediction_sees_the_text_alone(spark):
    rows = [(1, "der die das und nicht schön", "de"), (2, "the and of with that", "en"), (4, "den dem des auch", "de"), (6, "this those from", "en")]
    learned = learn_prototypes(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    swapped = spark.createDataFrame([(9, "und das schöne", "en"), (10, "that and the", "de"), (11, None, "en")], "doc_id long, text string, lang string")
    assert {r["doc_id"]: r["lang_pred"] for r in identify(swapped, learned).collect()} == {9: "de", 10: "en", 11: "und"}


@pytest.mark.parametrize("limit", [5, 10**9])
def test_training_sample_is_bounded_and_repeatable(spark, limit):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a, b = (learn_prototypes(docs, max_rows=limit) for _ in range(2))
    assert a.keys() == b.keys() and all((a[k] == b[k]).all() for k in a)


def slow_vector(text):
    """Trigram by trigram: the product of the letters' signs, each turned by its place, added up."""
    cleaned = " " + re.sub(" +", " ", "".join(c if c.isalpha() else " " for c in (text or "").lower())).strip(" ") + " "
    sign = lambda c: 2 * np.random.default_rng([SEED, ord(c)]).integers(0, 2, DIMENSIONS, dtype=np.int8).astype(np.int64) - 1
    total = np.zeros(DIMENSIONS, np.int64)
    for i in range(len(cleaned) - 2):
        total += np.prod([np.roll(sign(c), place) for place, c in enumerate(reversed(cleaned[i : i + 3]))], axis=0)
    return total if cleaned.strip() else None


def test_scores_equal_brute_force(spark):
    words = "der die das und nicht schön the of and with that É x1y ß straße".split()
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 12))), ["en", "de", None][i % 3]) for i in range(60)] + [(60, None, "en"), (61, "12 !", "de")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    vectors = {d: slow_vector(t) for d, t, _ in rows}
    sums = {}
    for d, _, lang in rows:
        if lang and vectors[d] is not None:
            sums[lang] = sums.get(lang, 0) + vectors[d] / np.linalg.norm(vectors[d])
    for r in identify(docs, learn_prototypes(docs)).collect():
        v = vectors[r["doc_id"]]
        cosines = {} if v is None else {k: float(s @ v / np.linalg.norm(s) / np.linalg.norm(v)) for k, s in sums.items()}
        best = max(cosines, key=cosines.get, default="und")
        assert r["lang_pred"] == best and abs(r["score"] - max(0, cosines.get(best, 0))) < 1e-3
