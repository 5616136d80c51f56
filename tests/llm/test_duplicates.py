import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from brute import components, likeness
from brute import repeated_passages as repeated_runs
from hypothesis import given, settings
from hypothesis import strategies as st

from emberline.llm import jaccard_join, suffix_dedup
from emberline.llm.components import connected_components
from emberline.llm.fingerprints import CELLS, compare_versions, fingerprint, paragraph_digests, recover
from emberline.llm.jaccard_join import Join, drop_near_duplicates, jaccard_components
from emberline.llm.suffix_dedup import repeated_passages

TEXTS = "doc_id long, text string"


def variants(rng, count=60):
    """Texts around a few originals, at similarities about the threshold, of many sizes."""
    words = ["".join(rng.choice("abcdef") for _ in range(4)) for _ in range(500)]
    rows = []
    for base in range(6):
        size = [3, 5, 8, 14, 60, 300][base]
        original = [rng.choice(words) for _ in range(size)]
        for _ in range(count // 6):
            text = list(original)
            for _ in range(rng.randint(0, max(1, size // 50))):
                text[rng.randrange(len(text))] = rng.choice(words)
            rows.append((len(rows) * 3, " ".join(text) + rng.choice(["", " tail", "  \n"])))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("size", "percent", "seed", "tile"), [(4, 85, 1, 2048), (3, 70, 2, 2)])
def test_components_equal_brute_force(spark, monkeypatch, size, percent, seed, tile):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    rows = variants(random.Random(seed))
    found = jaccard_components(spark.createDataFrame(rows, TEXTS).repartition(4), size, percent).collect()
    assert Counter(map(tuple, found)) == Counter(components(rows, size, percent))


def test_components_of_awkward_rows(documents, no_documents, rows_of):
    found = jaccard_components(documents, 4, 85)
    assert Counter(map(tuple, found.collect())) == Counter(components(rows_of, 4, 85))
    assert jaccard_components(no_documents, 4, 85).count() == 0
    kept = drop_near_duplicates(documents)
    assert kept.columns == documents.columns
    firsts = {c for d, _, c in components(rows_of, 5, 80) if d is not None}
    assert {r["doc_id"] for r in kept.collect()} == firsts | {None}
    assert drop_near_duplicates(no_documents).count() == 0


def test_copies_with_null_and_repeated_ids(spark):
    a, b, c = ("".join(f"{w}{i} " for i in range(20)) for w in "abc")
    rows = [(None, a), (7, a), (9, a), (3, b), (3, b), (None, b), (None, c), (None, c), (7, b + "tail"), (None, None), (None, "")]
    docs = spark.createDataFrame(rows, TEXTS)
    assert Counter(map(tuple, jaccard_components(docs, 5, 80).collect())) == Counter(components(rows, 5, 80))
    assert Counter(map(tuple, drop_near_duplicates(docs).collect())) == Counter([(7, a), (3, b), (None, c), (None, None), (None, "")])


def test_linked_sets_always_share_a_segment():
    rng = np.random.default_rng(5)
    for percent in (70, 80, 85, 95):
        join = Join(4, percent)
        for n in [6, 7, 10, 13, 30, 100, 400, 401, 402, 1500]:
            for _ in range(30):
                a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
                gone = rng.integers(0, join.differ(n, n) + 1)
                b = a[rng.permutation(len(a))[: max(1, len(a) - gone)]]
                b = np.unique(np.concatenate([b, rng.integers(0, 2**63, int(rng.integers(0, join.differ(n, n) + 1 - gone + 1)), dtype=np.uint64)]))
                if join.links(a, b) and (len(a) != len(b) or (a != b).any()):
                    (a_keys, a_tiles, a_needs), (b_keys, b_tiles, b_needs) = join.segment_keys(a), join.segment_keys(b)
                    enough = False
                    for tile in set(a_tiles) & set(b_tiles):
                        shared = len(np.intersect1d(a_keys[a_tiles == tile], b_keys[b_tiles == tile]))
                        needs = [x[t == tile][0] for x, t in ((a_needs, a_tiles), (b_needs, b_tiles))]
                        enough |= shared > 0 and (0 in needs or shared >= max(needs))
                    assert enough, (percent, n, len(b))


def test_bitmap_bound_never_rejects_a_link():
    rng = np.random.default_rng(1)
    join, kept = Join(4, 85), []
    for n in (1, 10, 85, 86, 300, 341, 342, 3000):
        for drop in (0, 1, n // 10, n // 6, n // 2):
            a = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
            b = a[drop:] if drop < len(a) else a
            kept.append(join.may_link(jaccard_join.bitmap(a), jaccard_join.bitmap(b)))
            assert kept[-1] or not join.links(a, b)
    assert not all(kept)


def test_tiles_leave_every_link():
    rng = np.random.default_rng(2)
    join = Join(4, 85)
    base = [np.unique(rng.integers(0, 2**63, n, dtype=np.uint64)) for n in (5, 40, 300, 2000)]
    sets = [np.unique(np.concatenate([b[rng.random(len(b)) > drop], rng.integers(0, 2**63, int(more * len(b)), dtype=np.uint64)])) for b in base for drop in (0, 0.02, 0.1, 0.3) for more in (0, 0.02, 0.1)]
    held = Counter(x for s in sets for x in s.tolist())
    folded = [np.bitwise_or.reduce(np.frombuffer(jaccard_join.bitmap(s), np.uint64, offset=8).reshape(-1, jaccard_join.FOLDED), axis=0) for s in sets]
    ids = np.arange(len(sets))
    rows = {"set": ids, "c": ids, "n": np.array([len(s) for s in sets]), "s": np.array([sum(held[x] > 1 for x in s.tolist()) for s in sets]), "own": ids % 2, "bits": np.array(folded)}
    links = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if join.links(sets[i], sets[j])}
    for crossed in (False, True):
        found = set(zip(*(x.tolist() for x in jaccard_join._within_tile(join, rows, crossed))))
        assert {(i, j) for i, j in links if not crossed or (i + j) % 2} <= found and len(found) < len(sets) ** 2 / 4


def shuffled(spark, run):
    """Bytes that the executors write for shuffles while `run` runs."""
    context = spark.sparkContext._jsc.sc()

    def written():
        context.listenerBus().waitUntilEmpty()
        found = context.statusStore().executorList(False)
        return sum(found.apply(i).totalShuffleWrite() for i in range(found.size()))

    before = written()
    run()
    return written() - before


def test_keys_move_once_and_tables_are_few(spark, monkeypatch):
    rng, tables = random.Random(4), []
    monkeypatch.setattr(jaccard_join, "BUCKETS", 6, raising=False)
    monkeypatch.setattr(jaccard_join, "staged", lambda df, name, stage=jaccard_join.staged: tables.append(name) or stage(df, name))
    rows = [(i, " ".join(str(rng.randrange(10**6)) for _ in range(400))) for i in range(800)]
    keys = sum(len(Join(4, 85).segment_keys(s)[0]) for s in jaccard_join.shingle_sets(pa.array([t for _, t in rows]), 4))
    docs = spark.createDataFrame([*rows, (900, rows[5][1] + " tail"), (901, "tail " + rows[5][1])], TEXTS)
    found = []
    assert shuffled(spark, lambda: found.extend(jaccard_components(docs, 4, 85).collect())) < 16 * keys
    assert len(tables) < 30
    assert {r["doc_id"]: r["component_id"] for r in found} == {i: i for i, _ in rows} | {900: 5, 901: 5}


def test_keys_recur_where_several_sets_have_them(spark, monkeypatch):
    monkeypatch.setattr(jaccard_join, "BUCKETS", 3)
    monkeypatch.setattr(jaccard_join, "CHUNK", 50)
    rng = random.Random(6)
    text = " ".join(str(rng.randrange(10**6)) for _ in range(120))
    rows = [(1, text), (2, text), (3, text + " tail"), (4, text.upper()), (5, "alone " * 3), (6, None), (7, "")]
    found = jaccard_join._recurring(jaccard_join._rows(spark.createDataFrame(rows, TEXTS).repartition(3), Join(4, 85))).collect()
    a, b = jaccard_join.shingle_sets(pa.array([text, text + " tail"]), 4)
    both = set(Join(4, 85).segment_keys(a)[0].tolist()) & set(Join(4, 85).segment_keys(b)[0].tolist())
    assert len(found) == 2 * len(both) and {r["sharing"] for r in found} == {2}
    assert len({(r["key"], r["set"]) for r in found}) == len(found)


def test_connected_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(100, 100 + i) for i in range(1, 30)] + [(rng.randint(200, 300), rng.randint(200, 300)) for _ in range(60)] + [(5, 5)]
    root = {n: n for e in edges if e[0] != e[1] for n in e}
    for _ in range(100):
        for u, v in edges:
            if u != v:
                root[u] = root[v] = min(root[u], root[v])
    found = connected_components(spark.createDataFrame(edges, "u long, v long"))
    assert {r["node"]: r["component"] for r in found.collect()} == root
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def from_texts(a, b):
    """The likeness of two fingerprints from their texts alone; None where a block can't be peeled."""

    def read(text):
        size, level, blocks = text.split("|")
        cells = [[tuple(int(x, 16) if i else int(x) for i, x in enumerate(c.split(":"))) if c else (0, 0, 0) for c in b.split(",")] for b in blocks.split(";")]
        return int(size), int(level), cells

    (n, la, x), (m, lb, y) = read(a), read(b)
    add = lambda p, q, sign=1: [(c[0] + sign * d[0], c[1] ^ d[1], c[2] ^ d[2]) for c, d in zip(p, q)]
    while la > lb:
        x, la = [add(x[2 * i], x[2 * i + 1]) for i in range(len(x) // 2)], la - 1
    while lb > la:
        y, lb = [add(y[2 * i], y[2 * i + 1]) for i in range(len(y) // 2)], lb - 1
    differing = 0
    for p, q in zip(x, y, strict=True):
        cells = add(p, q, -1)
        assert len(cells) == 3 * CELLS
        while pure := [c for c in cells if abs(c[0]) == 1 and c[2] == sums(c[1])[0]]:
            sign, k, h = pure[0]
            differing += 1
            for j, place in enumerate(sums(k)[1]):
                at = j * CELLS + place
                cells[at] = (cells[at][0] - sign, cells[at][1] ^ k, cells[at][2] ^ h)
        if any(c != (0, 0, 0) for c in cells):
            return None
    return (n + m - differing) / (n + m + differing) if n + m else 1.0


def sums(digest):
    """The checksum and the three places of a digest, as Spark's xxhash64 of its 8 bytes and then an int each gives them."""
    signed = digest - (1 << 64) if digest >= 1 << 63 else digest

    def chained(*ints):
        seed = 42
        for value in (signed.to_bytes(8, "little", signed=True), *(i.to_bytes(4, "little", signed=True) for i in ints)):
            seed = xxhash.xxh64_intdigest(value, seed)
        return seed

    places = [chained(0, j) for j in range(3)]
    return chained(-1) >> 32, [(p - (1 << 64) if p >= 1 << 63 else p) % CELLS for p in places]


def test_versions_equal_brute_force(documents, no_documents, rows_of):
    found = compare_versions(documents).collect()
    rows = sorted(rows_of, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    expected = Counter()
    for i, (d, text) in enumerate(rows):
        text, following = text or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(text) // 2
        edited = text[: len(text) - half] + following[:half]
        expected[d, len(text), hashlib.sha256(edited.encode()).hexdigest(), round(likeness(text, edited), 9), round(likeness(text, following), 9)] += 1
    assert Counter((r["doc_id"], r["n_chars"], r["edited_sha256"], round(r["near_edited"], 9), round(r["near_next"], 9)) for r in found) == expected
    peeled = 0
    for r in found:
        likely = from_texts(r["fingerprint"], r["edited_fingerprint"])
        peeled += likely is not None
        assert likely is None or abs(likely - r["near_edited"]) < 1e-12
    assert peeled > 0.8 * len(found)
    prints = defaultdict(set)
    for r, (_, text) in zip(sorted(found, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["n_chars"])), sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, len(r[1] or "")))):
        prints[text or ""].add(r["fingerprint"])
    assert all(len(p) == 1 for p in prints.values())
    assert compare_versions(no_documents).count() == 0
    assert compare_versions(documents.where("doc_id = 5")).first()["near_next"] == 1


def test_peeling_recovers_the_differing_digests(spark):
    rng = random.Random(9)
    rows = []
    for n in (0, 1, 3, 8, 20, 60, 300, 900):
        for share in (0, 0.5, 0.95, 1):
            a = [rng.getrandbits(64) - (1 << 63) for _ in range(n)]
            rows.append((a, [x for x in a if rng.random() < share] + [rng.getrandbits(63) for _ in range(int(n * (1 - share)))]))
    frame = spark.createDataFrame(rows, "a array<long>, b array<long>").selectExpr("a", "b", f"{fingerprint('a')} AS fa", f"{fingerprint('b')} AS fb")
    found = frame.selectExpr("a", "b", f"{recover('fa', 'fb', 'a', 'b')} AS d").collect()
    for r in found:
        assert sorted(r["d"]) == sorted(set(r["a"]) ^ set(r["b"]))


def test_paragraphs(spark):
    text = "one two\n\n \nthree\tfour\n" + " ".join(str(i) for i in range(100)) + "\n one two\none two"
    sizes = spark.createDataFrame([(text,), ("",), (" \n",)], "t string").selectExpr(f"size({paragraph_digests('t')})").collect()
    assert [r[0] for r in sizes] == [5, 0, 0]


@pytest.mark.parametrize(("seed", "together"), [(1, 4_000), (2, 40)])
def test_passages_equal_brute_force(spark, monkeypatch, seed, together):
    monkeypatch.setattr(suffix_dedup, "TOGETHER", together)
    rng = random.Random(seed)
    prose = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    shared = [prose(n) for n in (49, 50, 51, 75, 130, 400)]
    rows = []
    for i in range(60):
        parts = [prose(rng.randint(0, 120)), rng.choice(shared), prose(rng.randint(0, 60)), rng.choice(shared), prose(rng.randint(0, 90))]
        rows.append((i, " ".join(parts[: rng.randint(1, 5)])))
    tail = prose(13)  # ends the passage of two texts and stands in many others
    rows += [(200 + i, f"{prose(30)} {tail} {prose(30)}") for i in range(80)] + [(300 + i, f"{prose(9)} {passage} {prose(9)}") for i, passage in enumerate([prose(37) + " " + tail] * 2)]
    rows += [(100, rows[3][1]), (101, prose(49)), (102, "to " * 500), (103, shared[4]), (104, shared[4]), (105, "to be " * 300), (106, "x to " + "to " * 80)]
    frame = spark.createDataFrame(rows, TEXTS).repartition(5)
    found = repeated_passages(frame).collect()
    expected = [(rows[i][0], a, b) for i, a, b, _ in repeated_runs(rows)]
    assert sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in found) == sorted(expected)
    least, sizes = {}, Counter()
    for i, a, _, c in repeated_runs(rows):
        least[c] = min(least.get(c, (1 << 60, 0)), (rows[i][0], a))
        sizes[c] += 1
    classes = {(rows[i][0], a): (*least[c], sizes[c]) for i, a, _, c in repeated_runs(rows)}
    assert {(r["doc_id"], r["start_word"]): (r["class_doc_id"], r["class_start"], r["n_in_class"]) for r in found} == classes


def test_passages_of_a_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text")
    rows = [tuple(r) for r in docs.collect()]
    found = sorted((r["doc_id"], r["start_word"], r["end_word"]) for r in repeated_passages(docs).collect())
    assert found == sorted((rows[i][0], a, b) for i, a, b, _ in repeated_runs(rows))


def test_passages_of_awkward_rows(documents, no_documents):
    found = repeated_passages(documents).collect()
    assert {0, 1, 2, 3, 4, -5} <= {r["doc_id"] for r in found} <= {0, 1, 2, 3, 4, -5}
    assert all(r["n_words"] >= 50 and r["n_words"] == r["end_word"] - r["start_word"] for r in found)
    assert repeated_passages(no_documents).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(alphabet="aB \t\n\x0b\x0c\xa0é", max_size=8), max_size=12))
def test_shingles_are_the_contract_s(parts):
    from brute import shingle_set

    text = " ".join(parts)
    found = [len(x) for x in jaccard_join.shingle_sets(pa.array([None, text, text + ' tail']), 4)]
    assert found == [0, len(shingle_set(text, 4)), len(shingle_set(text + ' tail', 4))]
