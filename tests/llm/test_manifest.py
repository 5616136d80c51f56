import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F

from emberline.llm.merkle import Parent, document_manifest, numbered, subtree


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(r, text):
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    return H(*map(field, (r["doc_id"], r["source"], r["lang"], r["n_chars"], text)))


def grown(nodes):
    """The levels of a tree, leaves first."""
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([H(*levels[-1][i : i + 16]) for i in range(0, len(levels[-1]), 16)])
    return levels


def siblings(levels, i):
    """Per level (left, right) of the node above leaf i."""
    found = []
    for level in levels[:-1]:
        first = i // 16 * 16
        found.append((level[first:i], level[i + 1 : first + 16]))
        i //= 16
    return found


def slow(rows, tampered):
    lower = lambda t: None if t is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t)
    groups = {}
    for r in rows:
        groups.setdefault(r["source"], []).append(r)
    trees = {}
    for source, own in groups.items():
        own.sort(key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, leaf_of(r, r["text"])))
        trees[source] = grown([leaf_of(r, r["text"]) for r in own])
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    top = grown([trees[s][-1][0] for s in order])
    found = []
    for k, source in enumerate(order):
        for i, r in enumerate(groups[source]):
            path = siblings(trees[source], i) + siblings(top, k)
            at = leaf_of(r, lower(r["text"]) if tampered(r) else r["text"])
            for left, right in path:
                at = H(*left, at, *right)
            root = top[-1][0]
            found.append((r["doc_id"], trees[source][0][i], trees[source][-1][0], root, H(*(x for left, right in path for x in (*left, *right))), at, at == root))
    return found


def by_crc(r):
    return r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0


TAMPERED = "crc32(cast(doc_id AS string)) % 5 = 0"


def test_a_slot_resumes_as_if_hashed_anew():
    rng = random.Random(3)
    for n in range(1, 17):
        children = [H(str(rng.random())).encode() for _ in range(n)]
        parent = Parent(children)
        for slot in range(n):
            other = H("other").encode()
            assert parent.folded(slot, other).decode() == hashlib.sha256(b"".join([*children[:slot], other, *children[slot + 1 :]])).hexdigest()
            assert parent.folded(slot, children[slot]) == parent.digest
    assert [len(level) for level in subtree([b"x"] * 250, 2)] == [16, 1]


def test_awkward_rows(documents, no_documents):
    rows = [r.asDict() for r in documents.collect()]
    for tampered, how in ((F.expr(TAMPERED), by_crc), (F.lit(True), lambda r: True), (F.lit(None).cast("boolean"), lambda r: False)):
        found = document_manifest(documents, tampered).collect()
        assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, slow(rows, how)))
    assert document_manifest(no_documents, F.expr(TAMPERED)).count() == 0
    assert document_manifest(documents.limit(1), F.expr(TAMPERED)).count() == 1


@pytest.mark.parametrize("sizes", [[1], [2], [16, 17, 1], [255, 256, 257, 0], [4097, 300]])
def test_trees_of_all_shapes(spark, sizes):
    rows = [(i * 7 % 5003, f"{'É' * (k % 3)}s{k}" if k else None, None, i, f"Text {i}") for k, n in enumerate(sizes) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    found = document_manifest(docs, F.expr(TAMPERED)).collect()
    want = slow([r.asDict() for r in docs.collect()], by_crc)
    assert sorted(map(repr, map(tuple, found))) == sorted(map(repr, want))
    assert {r["verified"] for r in found} == ({True, False} if len(rows) > 16 else {r[-1] for r in want})


def test_many_groups(spark):
    rows = [(i, f"host{i % 300}", "en", 1, f"A{i}") for i in range(900)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string")
    assert sorted(map(repr, map(tuple, document_manifest(docs, F.expr(TAMPERED)).collect()))) == sorted(map(repr, slow([r.asDict() for r in docs.collect()], by_crc)))


def test_numbers_of_a_large_group(spark):
    rows = spark.range(5000).select((F.col("id") * 37 % 5000).alias("v"), F.when(F.col("id") % 4 > 0, "hot").alias("g"))
    found = numbered(rows, "g", [F.asc_nulls_first("v")]).collect()
    for g in ("hot", None):
        own = sorted((r["rank"], r["v"]) for r in found if r["g"] == g)
        assert [k for k, _ in own] == list(range(len(own))) and [v for _, v in own] == sorted(v for _, v in own)
        assert {r["n"] for r in found if r["g"] == g} == {len(own)}


def test_long_texts_and_names_of_columns(spark):
    docs = spark.createDataFrame([(1, "s", "x" * 5_000_000, "en", 3, 1, 2), (2, "s", "WORD " * 1_000_000, "en", 3, 1, 2)], "doc_id long, source string, text string, lang string, n_chars long, rank int, leaf int")
    found = document_manifest(docs, F.lit(True)).collect()
    assert sorted((r["doc_id"], r["verified"]) for r in found) == [(1, True), (2, False)]
