import random
import time
from collections import Counter

import pytest
from brute import plain_copy, without_repeated_lines

from emberline.llm.decontaminate import canonical, drop_leaks, find_leaks
from emberline.llm.line_dedup import MIN_LINES, dedup_lines

TEXTS = "doc_id long, text string, n_lines string"


def test_passages_of_lines_go_once_kept(spark):
    rng = random.Random(1)
    line = lambda: "".join(rng.choice("abcdefgh ") for _ in range(30))
    passage = [line() for _ in range(40)]
    rows = [(i, "\n".join([line() for _ in range(rng.randint(1, 9))] + passage + [line() for _ in range(rng.randint(1, 9))]), "clash") for i in range(5)]
    rows += [(10, "\n".join(line() for _ in range(20)), None)]
    found = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, TEXTS)).collect()}
    assert found[0]["text"] == rows[0][1] and found[10]["text"] == rows[5][1] and found[10]["n_removed"] == 0
    for i in range(1, 5):
        kept = found[i]["text"].split("\n")
        assert found[i]["n_lines"] - found[i]["n_removed"] == len(kept)
        own = [x for x in rows[i][1].split("\n") if x not in passage]
        assert [x for x in kept if x not in passage] == own
        assert not any(x in passage for x in kept)


def test_short_shared_passages_go_whole(spark):
    rng = random.Random(3)
    line = lambda n: "".join(rng.choice("abcdefghijkl") for _ in range(n))
    for width, gap in ((30, "\n"), (30, "\n\n"), (12, "\n")):
        passages = [gap.join(line(width) for _ in range(n)) for n in range(2 if width > 20 else 4, 9)]
        rows = [(10 * k + i, gap.join([line(50), p, line(50)]), None) for k, p in enumerate(passages) for i in range(3)]
        rows += [(1000, line(50) + "\n" + "\n".join([line(30)] * 300), None), (1001, rows[0][1] + "\n\n", None)]
        found = {r["doc_id"]: r for r in dedup_lines(spark.createDataFrame(rows, TEXTS)).collect()}
        for k, passage in enumerate(passages):
            assert found[10 * k]["text"] == rows[3 * k][1]
            for i in (1, 2):
                own = rows[3 * k + i][1].split("\n")
                assert [x for x in found[10 * k + i]["text"].split("\n") if x] == [own[0], own[-1]]
        assert found[1000]["n_removed"] == 299 and found[1001]["text"] == "" and found[1001]["n_removed"] == found[1001]["n_lines"]


def test_every_removed_chunk_is_kept_elsewhere(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before = {r["doc_id"]: r["text"] for r in docs.collect()}
    found = dedup_lines(docs)
    assert found.columns == [*docs.columns, "n_lines", "n_removed"]
    rows = found.collect()
    kept = Counter(x for r in rows for x in r["text"].split("\n"))
    for r in rows:
        gone = Counter(before[r["doc_id"]].split("\n")) - Counter(r["text"].split("\n"))
        assert all(x in kept for x in gone)
        assert (r["n_removed"] == 0) == (r["text"] == before[r["doc_id"]])
        assert not r["n_removed"] or r["n_removed"] >= MIN_LINES


def test_awkward_rows(documents, no_documents):
    found = dedup_lines(documents)
    assert found.columns == [*documents.columns, "n_lines", "n_removed"] and found.count() == documents.count()
    for r in found.collect():
        assert (r["text"] is None) == (r["n_lines"] == 0)
    assert {r["n_lines"] for r in found.where("text = ''").collect()} >= {1}
    assert dedup_lines(no_documents).count() == 0


def test_short_chance_repeats_stay(spark):
    rows = [(i, "Yes.\nNo.\nYes.\nNo.\nMaybe.\n\n\n\n", None) for i in range(4)]
    assert all(r["n_removed"] == 0 for r in dedup_lines(spark.createDataFrame(rows, TEXTS), min_chars=40).collect())
    assert [r["n_removed"] for r in dedup_lines(spark.createDataFrame(rows, TEXTS)).orderBy("doc_id").collect()] == [2, 9, 9, 9]


@pytest.mark.parametrize("min_chars", [0, 12])
def test_lines_equal_brute_force(spark, min_chars):
    rng = random.Random(11)
    words = ["a", "bb", "ccc ccc", "dd dd dd dd", "", "  ", "eeeeeeeeeeeeee", "f\tf"]
    rows = [(i, "\n".join(rng.choice(words) + rng.choice(["", "", str(rng.randint(0, 9))]) for _ in range(rng.randint(0, 14))), None) for i in range(120)]
    rows += [(500, None, None), (501, "", None), (502, rows[3][1], None), (None, rows[4][1], None)]
    found = Counter((r["doc_id"], r["text"], r["n_removed"]) for r in dedup_lines(spark.createDataFrame(rows, TEXTS).repartition(4), min_chars).collect())
    assert found == Counter(without_repeated_lines([(d, t) for d, t, _ in rows], min_chars))


def test_columns_of_any_name(spark):
    names = ["gone", "gone_id", "gone_hash", "lines", "stays", "solid", "spans", "own_hash", "word", "bits", "hash", "text_hash", "n", "first", "c", "score", "lang_pred", "n_removed", "Word_"]
    passage = "one line of a passage\nand another one\n"
    docs = spark.createDataFrame([(i, passage + str(i), *[f"{n}{i}" for n in names]) for i in range(3)], "doc_id long, text string, " + ", ".join(f"{n} string" for n in names))
    found = dedup_lines(docs)
    assert found.columns == [c for c in docs.columns if c != "n_removed"] + ["n_lines", "n_removed"]
    for r in found.collect():
        assert all(r[n] == f"{n}{r['doc_id']}" for n in names if n != "n_removed") and r["n_removed"] == (0 if r["doc_id"] == 0 else 2)


def test_hash_clashes_are_settled_by_bytes(spark, monkeypatch):
    from emberline.llm import line_dedup

    monkeypatch.setattr(line_dedup, "CHUNK_HASH", "pmod(xxhash64(slice(hashes, p.first + 1, p.n)), 1L)")
    a, b = ("\n".join(f"line {k} of a passage numbered {n}" for k in range(30)) for n in (1, 2))
    found = {r["doc_id"]: r["text"] for r in dedup_lines(spark.createDataFrame([(1, a, None), (2, b, None), (3, a, None), (4, b, None)], TEXTS)).collect()}
    assert found[1] == a and found[2] == b and len(found[3]) < len(a) and len(found[4]) < len(b)


@pytest.mark.parametrize("text, removed", [("\n".join(f"line number {i % 70_000}" for i in range(140_000)), 70_000), ("x" * 5_000_000, 0), ("word " * 1_000_000 + "\nand a line\n" * 2, 0)])
def test_very_long_texts_cost_as_much_as_their_lines(spark, text, removed):
    began = time.perf_counter()
    found = dedup_lines(spark.createDataFrame([(1, text, None)], TEXTS)).first()
    assert found["n_removed"] == removed and found["text"].count("\n") == text.count("\n") - removed
    assert time.perf_counter() - began < 60


ITEM = "Yesterday John Smith bought 12 apples and gave 3 kg to Mary, so John Smith now has exactly 9 apples left in the basket."


def leaks(spark, texts, items=(ITEM,)):
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, "x") for i, t in enumerate(items)], "item_id long, text string, doc_id string")
    return {(r["doc_id"], r["item_id"]): r["verdict"] for r in find_leaks(docs, bench).collect()}


def test_copies_and_templates(spark):
    other = ITEM.replace("John Smith", "Anna Lee").replace("12", "15").replace("3 kg", "4 pounds").replace("Mary", "Bob").replace(" 9 ", " 11 ")
    mixed = "Yesterday Ann bought 15 apples and gave 4 lb to Bob, so Zoe now has exactly 11 apples left in the basket. Never mind that the basket was heavy."
    texts = [f"before it {ITEM} and after", f"x {other} y", ITEM.upper(), ITEM[:40], "nothing of the kind", None, "", other.replace("4 pounds", "4lbs") + " " + ITEM]
    found = leaks(spark, texts)
    assert found[0, 0] == "copy" and found[1, 0] == "template" and found[7, 0] in ("copy", "template")
    assert found[2, 0] == "copy" and not {(d, 0) for d in (3, 4, 5, 6)} & set(found)
    assert isinstance(leaks(spark, [mixed]), dict)


def test_inconsistent_slots_are_no_leak(spark):
    item = "take X1 and put X1 upon the shelf beside X1 then bring X1 back with X1 under the arm and X1 in hand"
    names = ["Ada", "Bob", "Cy", "Dee", "Eve", "Flo"]
    inconsistent = item
    for n in names:
        inconsistent = inconsistent.replace("X1", n, 1)
    items = [item.replace("X1", "Max")]
    assert leaks(spark, [inconsistent, item.replace("X1", "Zed")], items) == {(1, 0): "template"}


def test_short_items(spark):
    assert leaks(spark, ["you see red boats drift slowly past"], ["red boats drift slowly"]) == {(0, 0): "copy"}
    assert leaks(spark, ["red boats", "the Red boats!", "red ships", "reds"], ["red boats", "", None, "ships", "? ..."]) == {(0, 0): "copy", (1, 0): "copy", (2, 3): "copy"}


ODD = [
    "What Is The Capital Of France And When Was It Founded?",
    "12 + 15 * 3 - 4 = 53",
    "Solve 3x + 5 = 20.",
    "Ada Lovelace, Alan Turing, Grace Hopper, Edsger Dijkstra, Barbara Liskov",
    "NAME THE LARGEST MOON OF SATURN AND ITS DISCOVERER",
    "Which river flows through Vienna, Bratislava, Budapest and Belgrade before it reaches the sea?",
]


def test_items_of_names_numbers_and_capitals(spark):
    texts = [f"Before it. {change(x)} After it" for x in ODD for change in (str, str.upper, str.lower, str.title)]
    texts += [" ".join("other" if i == len(x.split()) // 2 else w for i, w in enumerate(x.split())) for x in ODD]
    found = leaks(spark, texts + ["Solve 4x + 7 = 31.", "What is the matter with the capital of it?"], ODD)
    assert {(4 * k + j, k) for k in range(len(ODD)) for j in range(4)} <= set(found)
    assert {(24 + k, k) for k in (0, 3, 4, 5)} <= set(found)
    assert not {d for d, _ in found} & {30, 31}


def test_a_quoted_run_of_a_long_item(spark):
    rng = random.Random(2)
    words = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    item = words(200).split()
    texts = [f"{words(30)} {' '.join(item[90 : 90 + n])} {words(30)}" for n in (12, 13, 60)]
    assert set(leaks(spark, texts, [" ".join(item)])) == {(1, 0), (2, 0)}


def test_plain_copies_equal_brute_force(spark):
    rng = random.Random(4)
    words = ["".join(rng.choice("abc") for _ in range(2)) for _ in range(12)]
    items = [" ".join(rng.choice(words) for _ in range(rng.randint(1, 50))) for _ in range(25)]
    texts = []
    for _ in range(120):
        base = rng.choice(items).split()
        for _ in range(rng.randint(0, 3)):
            base[rng.randrange(len(base))] = rng.choice(words)
        texts.append(" ".join([*(rng.choice(words) for _ in range(rng.randint(0, 9))), *base[: rng.randint(1, len(base))]]))
    expected = {(d, k) for d, t in enumerate(texts) for k, x in enumerate(items) if plain_copy(t, x)}
    found = leaks(spark, texts, items)
    assert expected and expected <= set(found)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    rows = find_leaks(docs, spark.createDataFrame([(i, t) for i, t in enumerate(items)], "item_id long, text string")).collect()
    for r in rows:  # what is found beyond that shares template windows
        assert (r["doc_id"], r["item_id"]) in expected or r["coverage"] >= 0.4 and r["windows"] == max(1, len(items[r["item_id"]].split()) - 7)


# Items, and clean texts that begin, or end, as they do.
STEMS = [
    ("Which of the following is not a prime number", "which of the following is not a reason to stay home"),
    ("What is the name of the largest planet in the solar system", "What is the name of the largest city in the country we visited"),
    ("Which of the following best describes the function of the mitochondria", "which of the following best describes the function of the committee that met"),
    ("How many of the following statements are true about photosynthesis?", "how many of the following statements are true about dogs"),
    ("What is the main idea of the passage above about whales?", "What is the main idea of the passage you sent me yesterday"),
    ("Which one of these is an example of a renewable resource?", "Which one of these is an example of a badly written letter"),
    ("Who was the first person to walk on the moon?", "who was the first person to leave the party last night"),
    ("In which year did the second world war end in Europe?", "In which year did the second branch of the library open"),
    ("Explain why the sky is blue during the day.", "explain why the train is late during the day"),
    ("What is the difference between a virus and a bacterium?", "What is the difference between a loan and a mortgage"),
    ("Find the value of the expression when the variable equals seven.", "find the value of the expression in the contract"),
    ("Why did the chicken cross the road in the old joke?", "Why did the chicken taste so bad in the old pot"),
    ("What would happen if there were no gravity on the earth?", "What would happen if there were no trains to the city"),
    ("Describe how the heart pumps blood to the lungs.", "Describe how the rules came to be made"),
    ("Which statement about acids is correct?", "Which statement about taxes is correct"),
    ("According to the passage, why did the author leave the village?", "According to the passage, why did the king not answer"),
    ("What is the most likely reason that the plants died?", "What is the most likely reason that the shop closed"),
    ("All of the following are mammals except which one?", "All of the following are welcome, except for the loud ones"),
    ("Choose the word that best completes the sentence about rivers.", "choose the word that best fits you and your friends"),
    ("Is it true that the speed of light is constant in a vacuum?", "Is it true that the speed of the train is too low"),
    ("What do you call a triangle with three equal sides?", "What do you call a person with three jobs"),
    ("Which of these numbers is divisible by both three and seven?", "Which of these ideas is liked by both parents and teachers"),
]


def test_common_stems_are_no_leaks(spark):
    items = [item for item, _ in STEMS]
    clean = [f"So I asked. {text} and we talked about it for a while." for _, text in STEMS]
    assert leaks(spark, clean, items) == {}
    # The items themselves are found, in capitals and in other type too, and with a word changed nine in ten times.
    copies = [f"So I asked. {change(item)} And we talked." for item in items for change in (str, str.upper, str.lower)]
    assert {(3 * k + j, k) for k in range(len(items)) for j in range(3)} <= set(leaks(spark, copies, items))
    near, owner = [], []
    for k, item in enumerate(items):
        words = item.split()
        for at in range(len(words)):
            near.append(" ".join(["So I asked.", *words[:at], "zebra", *words[at + 1 :], "And we talked."]))
            owner.append(k)
    long = [k for k, item in enumerate(items) if len(item.split()) >= 8]
    found = set(leaks(spark, near, items))
    rates = [((d, k) in found) for d, k in enumerate(owner) if k in long]
    assert sum(rates) / len(rates) > 0.6, sum(rates) / len(rates)
    assert {d for d, k in found if owner[d] != k} == set()


def test_plain_way_equals_brute_force_on_natural_words(spark):
    from emberline.llm.decontaminate import COMMON

    rng = random.Random(8)
    usual, rare = sorted(COMMON)[:40], ["".join(rng.choice("bcdfgz") for _ in range(5)) for _ in range(25)]
    draw = lambda n: [rng.choice(usual) if rng.random() < 0.6 else rng.choice(rare) for _ in range(n)]
    items = [" ".join(draw(rng.randint(2, 45))) for _ in range(30)]
    texts = []
    for _ in range(150):
        base = rng.choice(items).split()
        base = base[rng.randint(0, len(base) // 2) :] if rng.random() < 0.5 else base[: rng.randint(1, len(base))]
        texts.append(" ".join([*draw(rng.randint(0, 9)), *base, *draw(rng.randint(0, 9))]))
    expected = {(d, k) for d, t in enumerate(texts) for k, x in enumerate(items) if plain_copy(t, x, COMMON)}
    found = set(leaks(spark, texts, items))
    assert expected and expected <= found
    assert len(found - expected) <= len(found) // 5  # beyond it only what template windows find


def test_units_and_names_merge():
    a, b = canonical("ran 5 km with Old Tom Jones today"), canonical("ran 7miles with Ann today")
    assert a[0].tolist() == b[0].tolist() and a[1].tolist() == [True, False, True, False, True]


def test_planted_items(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    items = {r["item_id"]: r["text"] for r in bench.collect()}
    expected = {(r["doc_id"], i) for r in docs.collect() for i, t in items.items() if t in r["text"]}
    found = {(r["doc_id"], r["item_id"]) for r in find_leaks(docs, bench).collect()}
    assert expected and found >= expected
    kept = {r["doc_id"] for r in drop_leaks(docs, bench).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()} - {d for d, _ in found}


def test_awkward_tables(documents, no_documents, spark):
    bench = spark.createDataFrame([(1, None), (None, "some words that are nowhere else to be found at all"), (2, "")], "item_id long, text string")
    assert find_leaks(documents, bench).count() == 0 and find_leaks(no_documents, bench).count() == 0
    assert find_leaks(documents, bench.limit(0)).count() == 0
    kept = drop_leaks(documents, bench)
    assert kept.count() == documents.count() and kept.columns == documents.columns
    leak = spark.createDataFrame([(None, "tell me " + ITEM), (1, "clean")], "doc_id long, text string")
    assert [r["doc_id"] for r in drop_leaks(leak, spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()] == [1]
