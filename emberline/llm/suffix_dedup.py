"""Repeated passages by a sparse suffix array.

Suffixes are kept where a minimiser stands: the least hash of GRAM words among WINDOW that follow each
other. Every passage of WORDS words holds such a place, the same wherever it is repeated.
Only places whose GRAM words recur are kept. Spark brings the suffixes of equal first words together and sorts them; in a group they are
ordered by their words to the right and by those to the left, and the lengths that neighbours have in common cut
both orders into classes: two places share a passage of WORDS words exactly if they are of one class l words
to the left and WORDS - l to the right, for some l. So every match is found and extended, however many stand between.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .memory import lean
from .shared import hash_filter, may_hold, staged
from .words import hashed_words

#: Least length of a passage; words of an anchor; anchors among which a minimiser is chosen, so that GRAM + WINDOW <= WORDS.
WORDS, GRAM, WINDOW = 50, 12, 38
#: Suffixes of one group that meet in one task, about; a larger group is dealt to several, which then exchange what windows they hold.
TOGETHER = 4_000
_ODD = np.uint64(0x9E3779B97F4A7C15)


def minimisers(words: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, anchor hash) of the least anchor of every run of WINDOW, the first of equals, in texts that follow each other in `words`.

    Anchors are ordered by 32 bits of their hashes and then by place, which depends on the run's words alone.
    """
    n = max(0, len(words) - GRAM + 1)
    anchors = np.zeros(n, np.uint64)
    for j in range(GRAM):
        anchors = (anchors ^ words[j : j + n]) * _ODD
        anchors ^= anchors >> np.uint64(32)
    least = anchors >> np.uint64(32) << np.uint64(32) | np.arange(n, dtype=np.uint64)
    reach = 1
    while 2 * reach <= WINDOW:
        least = np.minimum(least[: max(0, len(least) - reach)], least[reach:])
        reach *= 2
    least = np.minimum(least[: max(0, len(least) - (WINDOW - reach))], least[WINDOW - reach :])
    text = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    run = WINDOW + GRAM - 1
    inside = text[: len(least)] == text[run - 1 : run - 1 + len(least)]
    at = (least[inside] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    at = at[np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]]
    return text[at], at - bounds[text[at]], anchors[at]


def _places(texts: DataFrame) -> DataFrame:
    """(anchor, text_hash, place, n_words) of every minimiser; a text that a task has seen is not sent again."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            new = pa.array([h not in seen and not seen.add(h) for h in batch["text_hash"].to_pylist()], pa.bool_())
            batch, at = batch.filter(new), 0
            for words, bounds in hashed_words(batch["text"]):
                hashes = batch["text_hash"].slice(at, len(bounds) - 1).to_numpy(zero_copy_only=False)
                text, place, anchor = minimisers(words, bounds)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(anchor.view(np.int64)), pa.array(hashes[text]), pa.array(place), pa.array(np.diff(bounds)[text])], names=["anchor", "text_hash", "place", "n_words"]
                )
                at += len(bounds) - 1

    return texts.mapInArrow(lean(find), "anchor long, text_hash long, place long, n_words long")


_SUFFIX = "anchor long, salt int, right binary, left binary, text_hash long, place long"


def _suffixes(texts: DataFrame) -> DataFrame:
    """The words around each place, 4 bytes of hash each: to the right from it on, to the left backwards from it."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = 0
            for words, bounds in hashed_words(batch["text"]):
                for i, (begin, end) in enumerate(zip(bounds.tolist(), bounds[1:].tolist()), at):
                    own = words[begin:end].astype("<u4")
                    ahead, back, n = own.tobytes(), own[::-1].tobytes(), end - begin
                    places = batch["places"][i].as_py()
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([p["anchor"] for p in places], pa.int64()),
                            pa.array([p["salt"] for p in places], pa.int32()),
                            pa.array([ahead[4 * p["place"] : 4 * (p["place"] + WORDS)] for p in places], pa.binary()),
                            pa.array([back[4 * (n - p["place"]) : 4 * (n - p["place"] + WORDS - GRAM)] for p in places], pa.binary()),
                            pa.array([batch["text_hash"][i].as_py()] * len(places), pa.int64()),
                            pa.array([p["place"] for p in places], pa.int64()),
                        ],
                        names=[x.split()[0] for x in _SUFFIX.split(", ")],
                    )
                at += len(bounds) - 1

    return texts.mapInArrow(lean(cut), _SUFFIX)


def _matrix(column: pa.Array, words: int) -> tuple[np.ndarray, np.ndarray]:
    raw = b"".join([x.ljust(4 * words, b"\0") for x in column.to_pylist()])
    return np.frombuffer(raw, "<u4").reshape(len(column), words), pc.binary_length(column).to_numpy(zero_copy_only=False) // 4


def _common(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> np.ndarray:
    """Words that each row has in common with the row before from the start; -1 where that is of another group."""
    found = np.full(len(rows), -1, np.int64)
    if len(rows) > 1:
        differ = rows[1:] != rows[:-1]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
        found[1:] = np.where(group[1:] == group[:-1], np.minimum(first, np.minimum(sizes[1:], sizes[:-1])), -1)
    return found


def _running(rows: np.ndarray) -> list[np.ndarray]:
    """A hash of the first k words of each row, for every k."""
    found = [np.ones(len(rows), np.uint64)]
    for k in range(rows.shape[1]):
        mixed = (found[-1] ^ rows[:, k].astype(np.uint64)) * _ODD
        found.append(mixed ^ mixed >> np.uint64(29))
    return found


class Matches:
    """The places among whole groups of suffixes that share a passage with another text.

    rows: the places; start and end: what their passages of WORDS cover, all of which hold the place; of and lead: places and the first of a
    class each is in. Of groups that stand in several tasks also windows: (place, words to its left, hash) of the passages that others may hold.
    """

    def __init__(self, table: pa.Table):
        table = table.combine_chunks()
        texts, places, anchor, salt = (table[c].to_numpy() for c in ("text_hash", "place", "anchor", "salt"))
        changed = lambda *columns: np.concatenate([[True], np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])[: len(texts)]
        once = changed(anchor, salt, texts, places)  # a text may come from several tasks; its suffixes are neighbours then
        table = table.filter(pa.array(once)).combine_chunks()
        texts, places, anchor, salt = (x[once] for x in (texts, places, anchor, salt))
        group = np.cumsum(changed(anchor, salt))
        right, right_n = _matrix(table["right"].chunk(0), WORDS)
        left, left_n = _matrix(table["left"].chunk(0), WORDS - GRAM)
        order = pc.sort_indices(pa.table({"group": group, "left": table["left"]}), sort_keys=[("group", "ascending"), ("left", "ascending")]).to_numpy()
        ahead, behind = _common(right, right_n, group), _common(left[order], left_n[order], group[order])
        near, spread, m = np.append(ahead[1:], -1), salt > 0, len(texts)
        low, high, pairs, windows = np.full(m, WORDS), np.full(m, -1), [], []
        by_right, by_left = (_running(right), _running(left)) if spread.any() else (None, None)
        for to_left in range(WORDS - GRAM + 1):
            to_right = WORDS - to_left
            fits = (right_n >= to_right) & (left_n >= to_left) & ((ahead >= to_right) | (near >= to_right) | spread)
            at = np.flatnonzero(fits)
            if not len(at):
                continue
            left_class = np.empty(m, np.int64)
            left_class[order] = np.cumsum(behind < to_left)
            key = np.cumsum(ahead < to_right)[at] * (m + 1) + left_class[at]
            _, first, number = np.unique(key, return_index=True, return_inverse=True)
            lead = at[first][number]
            several = np.bincount(number, weights=texts[at] != texts[lead]) > 0
            hit = several[number]
            low[at[hit]] = np.minimum(low[at[hit]], to_left)
            high[at[hit]] = to_left
            pairs.append(at[hit] * m + lead[hit])
            if by_right is not None:
                tell = at[spread[at] & (~hit | (at == lead))]
                windows.append((texts[tell], places[tell], np.full(len(tell), to_left), (by_right[to_right][tell] * _ODD ^ by_left[to_left][tell]).view(np.int64)))
        rows = np.flatnonzero(high >= 0)
        self.texts, self.places = texts[rows], places[rows]
        self.start, self.end = places[rows] - high[rows], places[rows] + WORDS - low[rows]
        both = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, np.int64)
        self.of, lead = np.searchsorted(rows, both // m) if len(rows) else both, both % max(1, m)
        self.lead_texts, self.lead_places = texts[lead], places[lead]
        self.windows = [np.concatenate(c) for c in zip(*windows)] if windows else None


_FOUND = "text_hash long, place long, start long, end long, leads array<struct<text_hash: long, place: long>>, window long"
_KINDS = [pa.int64()] * 4 + [pa.list_(pa.struct([("text_hash", pa.int64()), ("place", pa.int64())])), pa.int64()]


def _matches(suffixes: DataFrame) -> DataFrame:
    """Matched places with what they cover and the leads of their classes; with `window` not null, what a task holds of a group spread over several."""
    names = [x.split()[0] for x in _FOUND.replace("array<struct<text_hash: long, place: long>>", "x").split(", ")]

    def batch_of(table: pa.Table) -> Iterator[pa.RecordBatch]:
        found = Matches(table)
        ends = np.searchsorted(found.of, np.arange(len(found.texts) + 1))
        leads = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays([pa.array(found.lead_texts), pa.array(found.lead_places)], names=["text_hash", "place"]))
        yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (found.texts, found.places, found.start, found.end)), leads, pa.nulls(len(found.texts), pa.int64())], names=names)
        if found.windows is not None:
            texts, places, to_left, hashes = found.windows
            for at in range(0, len(texts), 100_000):
                t, p, w, h = (c[at : at + 100_000] for c in (texts, places, to_left, hashes))
                yield pa.RecordBatch.from_arrays([*(pa.array(c) for c in (t, p, p - w, p - w + WORDS)), pa.nulls(len(t), _KINDS[4]), pa.array(h)], names=names)

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            waiting.append(batch)
            if sum(b.num_rows for b in waiting) >= TOGETHER:
                table = pa.Table.from_batches(waiting)
                anchor, salt = table["anchor"].to_numpy(), table["salt"].to_numpy()
                last = np.flatnonzero((anchor != anchor[-1]) | (salt != salt[-1]))
                if len(last):  # the last group may go on
                    yield from batch_of(table.slice(0, last[-1] + 1))
                    waiting = table.slice(last[-1] + 1).to_batches()
        if waiting:
            yield from batch_of(pa.Table.from_batches(waiting))

    key = ["anchor", "salt"]
    return suffixes.repartition(*key).sortWithinPartitions(*key, "right", "text_hash", "place").mapInArrow(lean(compare), _FOUND)


def repeated_passages(docs: DataFrame) -> DataFrame:
    """Passages of WORDS words or more that stand in another document too.

    A row per document and passage: doc_id, start_word, end_word (not included), n_words, class_doc_id, class_start and n_in_class. Matches that
    overlap or touch in a document are one passage. Passages that share WORDS words are of one class, and so are those that a third
    links. A class is named by its first passage, the smallest doc_id that holds one and where it starts there; n_in_class counts its passages in all documents.
    Words are what ASCII blanks part; passages match by 32 bits of each word's hash, whole texts by 64 bits of their bytes' hash. What a document
    repeats of itself alone does not count. Null and short texts have none. Rows that share a doc_id are
    documents of their own, so a repeated row repeats itself; null ids stay null; an empty table
    gives no rows; further columns are ignored.
    """
    texts = docs.where("text IS NOT NULL").select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    places = staged(_places(texts.select("text", "text_hash")), "minimisers")
    counted = places.groupBy("anchor").agg(F.count("*").alias("n"), F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low <> high")
    recurring = staged(counted.select("anchor", F.when(F.col("n") > TOGETHER, F.ceil(F.col("n") / TOGETHER)).otherwise(0).cast("int").alias("salts")), "recurring-anchors")
    salt = F.when(F.col("salts") > 0, 1 + F.pmod(F.xxhash64("text_hash", "place"), F.col("salts"))).otherwise(0).cast("int").alias("salt")
    found = places.join(recurring, "anchor").select("text_hash", F.struct("anchor", "place", salt).alias("p"))
    wanted = staged(found.groupBy("text_hash").agg(F.collect_set("p").alias("places")), "recurring-places")
    copies = texts.groupBy("text_hash").agg(F.count("*").alias("copies"), F.min("doc_id").alias("first_id"))
    sizes = places.groupBy("text_hash").agg(F.max("n_words").alias("n_words"))
    owners = staged(copies.join(sizes, "text_hash"), "text-owners")

    near = may_hold(texts.select("text", "text_hash"), hash_filter(wanted, "text_hash", "wanted-cells"), "text_hash")
    bodies = near.join(wanted, "text_hash").select("text_hash", "text", "places")
    matches = staged(_matches(_suffixes(bodies)), "suffix-matches")
    met = matches.where("window IS NULL").drop("window")
    if not recurring.where("salts > 0").isEmpty():
        windows = matches.where("window IS NOT NULL").drop("leads")
        lead = F.min(F.struct("text_hash", "place")).alias("lead")
        heads = windows.groupBy("window").agg(lead, F.min("text_hash").alias("low"), F.max("text_hash").alias("high")).where("low <> high").select("window", F.array("lead").alias("leads"))
        met = met.unionByName(windows.join(staged(heads, "shared-windows"), "window").drop("window"))

    whole = owners.where(f"copies > 1 AND n_words >= {WORDS}").select("text_hash", F.col("n_words").alias("all_words"))
    order = Window.partitionBy("text_hash").orderBy("start", "end")
    upto = F.max("end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(F.col("start") <= upto, 0).otherwise(1)).over(order)
    placed = met.withColumn("run", run).join(whole, "text_hash", "left").withColumn("run", F.when(F.col("all_words").isNull(), F.col("run")).otherwise(0))
    runs = staged(placed.select("text_hash", "place", "start", "end", "leads", F.xxhash64("text_hash", F.col("run").cast("long")).alias("node"), F.col("all_words").isNotNull().alias("copied")), "passage-places")
    node_of = runs.select(F.col("text_hash").alias("t"), F.col("place").alias("p"), F.col("node").alias("v")).distinct()
    linked = runs.select("node", F.explode("leads").alias("lead")).select("node", F.col("lead.text_hash").alias("t"), F.col("lead.place").alias("p")).distinct()
    links = linked.join(staged(node_of, "nodes-of-places"), ["t", "p"]).where("node <> v").select(F.col("node").alias("u"), "v").distinct()
    labels = staged(connected_components(links), "passage-classes")

    merged = runs.where("NOT copied").groupBy("text_hash", "node").agg(F.min("start").alias("start"), F.max("end").alias("end"))
    spans = merged.unionByName(whole.select("text_hash", F.xxhash64("text_hash", F.lit(0).cast("long")).alias("node"), F.lit(0).cast("long").alias("start"), F.col("all_words").alias("end")))
    spans = staged(spans.join(labels, "node", "left").join(owners, "text_hash").select("text_hash", "start", "end", F.coalesce("component", "node").alias("class"), "copies", "first_id"), "passages")
    classes = staged(spans.groupBy("class").agg(F.min(F.when(F.col("first_id").isNotNull(), F.struct("first_id", "start"))).alias("first"), F.sum("copies").alias("n_in_class")), "classes")
    named = staged(spans.join(classes, "class").select("text_hash", "start", "end", F.col("first.first_id").alias("class_doc_id"), F.col("first.start").alias("class_start"), "n_in_class"), "classed-passages")
    return texts.select("doc_id", "text_hash").join(named, "text_hash").select(
        "doc_id", F.col("start").alias("start_word"), F.col("end").alias("end_word"), (F.col("end") - F.col("start")).alias("n_words"), "class_doc_id", "class_start", "n_in_class"
    )
