import random
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from emberline.llm import token_encoding
from emberline.llm.packing import pack_documents, plan_packing
from emberline.llm.token_encoding import WordEncoder
from emberline.llm.token_files import EliasFano, read_token_files, write_token_files

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
ENCODER = WordEncoder(PATH)


def ids(text, end):
    return np.array([*LIBRARY.encode(text or "", add_special_tokens=False).ids, end], dtype="<u4")


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="abAB.,!'éÉßİΣς \n\t’12 ́ \x1c中", max_size=60)), max_size=6))
def test_words_encode_like_whole_texts(texts):
    found = [ids[a:b].tolist() for ids, bounds in ENCODER.encode(pa.array(texts, pa.string()), 7) for a, b in zip(bounds, bounds[1:])]
    assert found == [[*LIBRARY.encode(text, add_special_tokens=False).ids, 7] for text in texts]


def test_slices_and_memo_do_not_show(monkeypatch):
    rng = random.Random(3)
    texts = [None, "", "x" * 5000, *(" ".join("".join(rng.choice("abcdeé.,<") for _ in range(rng.randint(1, 9))) for _ in range(rng.randint(0, 80))) for _ in range(200)), "<|endoftext|> ends"]
    expected = [[*LIBRARY.encode(text or "", add_special_tokens=False).ids, 7] for text in texts]
    monkeypatch.setattr(token_encoding, "SLICE_BYTES", 1500)
    monkeypatch.setattr(token_encoding, "MEMO_BYTES", 20_000)
    own = WordEncoder(PATH)
    assert [ids[a:b].tolist() for ids, bounds in own.encode(pa.array(texts, pa.string()), 7) for a, b in zip(bounds, bounds[1:])] == expected
    assert own.held < 100_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3000), max_size=900), st.data())
def test_elias_fano(gaps, data):
    values = np.cumsum(np.array(gaps, dtype=np.uint64), dtype=np.uint64)
    coded = EliasFano.encode(values)
    a = data.draw(st.integers(0, len(values)))
    b = data.draw(st.integers(a, len(values)))
    assert coded.slice(a, b).tolist() == values[a:b].tolist()
    if len(values) > 300:
        assert sum(map(len, coded.parts())) < 4 * len(values)


@pytest.mark.parametrize("limits", [{}, {"shard_docs": 1}, {"shard_ids": 500}])
def test_token_files(documents, no_documents, rows_of, tmp_path, limits):
    shards = write_token_files(documents, PATH, 2, str(tmp_path / "out"), **limits)
    found = sorted(read_token_files(shards).collect(), key=lambda r: r["start"])
    assert [r["doc_id"] for r in found] == sorted((d for d, _ in rows_of), key=lambda d: (d is not None, d))
    assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in found])[:-1]]).tolist()
    expected = Counter((d, len(ids(t, 2)), zlib.crc32(ids(t, 2).tobytes())) for d, t in rows_of)
    assert Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in found) == expected
    assert read_token_files(write_token_files(no_documents, PATH, 2, str(tmp_path / "none"))).count() == 0


def test_a_task_goes_on_with_another_shard(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(token_encoding, "SLICE_BYTES", 2000)
    docs = spark.createDataFrame([(None if i < 3 else i - 500, f"some words of number {i} " * (i % 9)) for i in range(2000)], "doc_id long, text string").coalesce(1)
    # A slice of texts is what a shard grows by, and 1,000 rows a batch.
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        shards = write_token_files(docs, PATH, 2, str(tmp_path / "out"), shard_docs=150)
        rows = shards.orderBy("part").collect()
        tasks = {r["part"] >> 32 for r in rows}
        assert len(rows) > len(tasks) and sum(r["docs"] for r in rows) == 2000
        assert [r["start"] for r in rows] == np.concatenate([[0], np.cumsum([r["tokens"] for r in rows])[:-1]]).tolist()
        found = sorted(read_token_files(shards).collect(), key=lambda r: r["start"])
        assert [r["doc_id"] for r in found] == [None] * 3 + list(range(-497, 1500))
        assert [r["start"] for r in found] == np.concatenate([[0], np.cumsum([r["n_tokens"] for r in found])[:-1]]).tolist()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def check_packing(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for placed in by.values():
        placed.sort()
        assert [o for o, _ in placed] == np.concatenate([[0], np.cumsum([n for _, n in placed])[:-1]]).tolist()
        assert sum(n for _, n in placed) <= capacity
    return len(by)


@pytest.mark.parametrize("capacity", [4096, 16])
def test_packing(documents, no_documents, rows_of, capacity):
    found = pack_documents(documents, PATH, 1, capacity).collect()
    expected = Counter()
    for d, t in rows_of:
        own = ids(t, 1)
        for k in range(0, len(own), capacity):
            part = own[k : k + capacity]
            expected[d, k // capacity, k, len(part), zlib.crc32(part.tobytes())] += 1
    assert Counter(tuple(r)[:5] for r in found) == expected
    assert check_packing(found, capacity) >= -(-sum(r["length"] for r in found) // capacity)
    assert pack_documents(no_documents, PATH, 1).count() == 0


def optimum(items, capacity):
    best = [len(items)]

    def place(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(items):
            best[0] = len(bins)
            return
        for k in {b: j for j, b in enumerate(bins)}.values():
            if bins[k] + items[i] <= capacity:
                place(i + 1, [*bins[:k], bins[k] + items[i], *bins[k + 1 :]])
        place(i + 1, [*bins, items[i]])

    place(0, [])
    return best[0]


def test_dominance_and_best_fit_against_the_optimum():
    rng, lost = random.Random(3), 0
    for _ in range(150):
        capacity = rng.choice([10, 20, 50])
        items = sorted((rng.randint(max(1, capacity // 6), capacity) for _ in range(rng.randint(1, 9))), reverse=True)
        plan = plan_packing(dict(Counter(items)), capacity)
        bins, ranks = Counter(), Counter()
        for length, rank, count, first, _ in plan.steps:
            assert rank == ranks[length]
            ranks[length] += count
            for k in range(count):
                bins[first + k] += length
        assert ranks == Counter(items) and max(bins.values()) <= capacity and len(bins) == plan.sequences
        lost += plan.sequences - optimum(items, capacity)
    assert lost <= 2


def test_planning_depends_on_lengths_not_on_counts():
    plan = plan_packing({n: 10_000_000 + n for n in range(1, 4097)}, 4096)
    assert len(plan.steps) < 40_000
    assert plan.sequences <= 1.001 * sum(n * (10_000_000 + n) for n in range(1, 4097)) / 4096
