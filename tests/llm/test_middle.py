import hashlib
import itertools
import random
import re
import time

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from emberline.llm.fill_in_middle import SkipList, fill_in_middle, restored, transform, unit_widths

UNITS = re.compile(r"[A-Za-z]+|[^A-Za-z]", re.S)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=400))
def test_ranks_are_reached_exactly(widths):
    lanes = SkipList(np.array(widths, dtype=np.int64))
    assert [lanes.place(rank) for rank in range(len(widths) + 2)] == [*itertools.accumulate(widths, initial=0), sum(widths)]
    for units, points, _ in lanes.lanes[1:]:
        assert units.sum() <= len(widths) and points.sum() <= sum(widths) and (units > 0).all()


def test_long_lists_are_descended_not_walked():
    widths = np.random.default_rng(1).integers(1, 9, 3_000_000)
    lanes, ends = SkipList(widths), np.cumsum(widths)
    began = time.perf_counter()
    for rank in np.random.default_rng(2).integers(1, len(widths), 200).tolist():
        assert lanes.place(rank) == ends[rank - 1]
    assert time.perf_counter() - began < 2


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("abZ@[`{ 1é\n中\U0001f600<>PSM"), st.characters(exclude_categories=["Cs"])), max_size=60))
def test_units(text):
    assert unit_widths(text).tolist() == [len(x) for x in UNITS.findall(text)]


def slow(text, key, seed=1, rate=90, spm=20):
    """(n, form, prefix_chars, middle_chars, output) by a list of units."""
    text, digest = text or "", hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    a, b, c, d = (int(digest[i : i + 8], 16) for i in range(0, 32, 8))
    units = UNITS.findall(text)
    n = len(units)
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or c % 100 >= rate:
        return n, "plain", None, None, text
    low, high = sorted((a % (n + 1), b % (n + 1)))
    prefix, middle, suffix = ("".join(x) for x in (units[:low], units[low:high], units[high:]))
    if d % 100 < spm:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_a_list_of_units(spark, documents, no_documents):
    rng = random.Random(9)
    made = [(i, "".join(rng.choice("<>PSM aé") for _ in range(rng.randint(0, 40)))) for i in range(3000)]
    made += [(-1, "<P"), (-2, "S>M<"), (-3, "word " * 1_000_000), (-4, "x" * 1_000_000), (None, "no id"), (None, None)]
    for docs in (spark.createDataFrame(made, "doc_id long, text string"), documents):
        found = fill_in_middle(docs).withColumn("again", restored(F.col("output"), F.col("form"))).collect()
        rows = docs.collect()
        assert sorted(repr((r["doc_id"], r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"], r["again"])) for r in found) == sorted(repr((r["doc_id"], *slow(r["text"], r["doc_id"]), r["text"] or "")) for r in rows)
    forms = {r["form"] for r in fill_in_middle(spark.createDataFrame(made, "doc_id long, text string")).select("form").distinct().collect()}
    assert forms == {"plain", "psm", "spm"}
    assert fill_in_middle(documents).columns == ["doc_id", "lang", "source", "n_chars", "score", "n", "form", "prefix_chars", "middle_chars", "output"]
    assert fill_in_middle(no_documents).count() == 0


def test_other_sentinels(spark):
    docs = spark.createDataFrame([(i, f"some text number {i}, and more of it") for i in range(300)], "doc_id long, text string")
    own = ("[pre]", "[suf]", "[mid]")
    found = fill_in_middle(docs, 7, 100, 50, own).withColumn("again", restored(F.col("output"), F.col("form"), own)).join(docs, "doc_id")
    assert found.where("again = text AND form <> 'plain'").count() == 300 and found.where("form = 'spm'").count() > 50
    for bad in (("<a", "a<", "x"), ("aba", "c", "d"), ("a", "a", "b"), ("ab", "b", "c"), ("", "b", "c")):
        with pytest.raises(ValueError):
            fill_in_middle(docs, sentinels=bad)


def test_a_word_of_a_megabyte_is_one_unit():
    n, form, prefix, middle, output = transform("x" * 1_000_000, 5, 1, 100, 0, ("<P>", "<S>", "<M>"))
    assert n == 1 and {prefix, middle} <= {0, 1_000_000} and len(output) == 1_000_009
