"""Benchmark decontamination by canonical templates.

A text's words become canonical tokens: a number with its unit is one placeholder, a run of
capitalised words (names) another, every other word itself in lower case without outer punctuation.
Windows of WINDOW tokens are hashed and joined with those of the benchmark. Windows that lie on one
diagonal pair the values that stand in the placeholders; a copy, re-parameterised or not, gives each
value of the item one value in the document.

Beside the template, a text has its plain tokens: all words in lower case, numbers and names too. Their windows find copies of
items that are mostly names and numbers, in capitals, or too short for a template.

Questions begin alike. So beside its share of windows a leak must cover a share of the item's content: tokens are weighed, and the words that
questions of all kinds are made of weigh next to nothing. The weights don't depend on the corpus: an item that a third of all documents hold is as much of a leak.
"""

from __future__ import annotations

import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .memory import MEMOS, lean
from .shared import FILTER_BITS, hash_filter, staged, unused

#: Tokens to a template window; items shorter than that give one window, with LEAST tokens or more.
WINDOW, LEAST = 8, 4
#: Share of an item's template windows, and of placeholder values in agreement, that make a leak.
COVERAGE, AGREEMENT = 0.4, 0.8
#: Plain windows: for items of so many tokens and more, the window's length and the share of windows that makes a leak. Shorter items are one window.
PLAIN = ((32, 8, 0.4), (16, 4, 0.5), (8, 3, 0.5))
#: Share of an item's weight that its matched windows must cover, for items of so many tokens and more; content words in a run that is a leak by itself.
CONTENT, RUN_CONTENT = ((32, 0.4), (16, 0.5), (0, 0.7)), 4
#: What a common word weighs, where others weigh 1.
COMMON_WEIGHT = 0.1
#: Diagonals that plain windows of one copy may spread over; plain windows of 8 on one diagonal that make a leak whatever their share (13 tokens or more).
BAND, RUN = 16, 6
#: Words that a worker remembers; bytes of text that are read at once, one text at least.
MEMO, SLICE_BYTES = 100_000, 2_000_000

LITERAL, NUMBER, NAME, UNIT = 0, 1, 2, 3
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
OUTER = string.punctuation.replace("%", "") + "«»“”„‘’…–—¿¡"
OPERATORS = frozenset("+-*/=<>^×÷−")
NUMERIC = re.compile(r"\d[\d.,:/]*(?:st|nd|rd|th)?(?P<unit>%|[a-zA-Z°²³]{0,5})")
# Number words and units of measure.
NUMBER_WORDS = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion half dozen".split())
UNITS = frozenset(
    "% percent mm cm m km in inch inches ft foot feet yd yard yards mi mile miles meter meters metre metres kilometer kilometers kilometre kilometres mg g kg t ton tons"
    " gram grams kilogram kilograms oz ounce ounces lb lbs pound pounds ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours"
    " day days week weeks month months year years kmh mph hz khz mhz ghz v volt volts w watt watts kw kwh j joule joules cal calories kcal c f k degrees"
    " dollar dollars cent cents euro euros usd eur gbp b kb mb gb tb bytes bits".split()
)

# Words that questions of all kinds are made of.
COMMON = frozenset(
    "a about above after all also an and any are as at be because been before being below best between both but by called can choose consider correct correctly could describe described describes did"
    " do does done each either every example explain false few find following for form found from get give given had has have he her here his how i idea if in incorrect into is it its itself kind known least less like likely main"
    " make may mean means might more most much many must name named no none not of on one only option options or other our out over part passage people person question same select she should show so"
    " some statement statements such term than that the their them then there these they thing things this those to true type under up us use used using value very was we were what when where which while who whom whose why will"
    " with would write you your".split()
)
_COMMON_HASHES = np.array(sorted(xxhash.xxh3_64_intdigest(word) | 4 for word in COMMON), np.uint64)


class Canon(dict):
    """word -> (kind, token hash, plain token hash), made at first sight; kind -1 is no template token, a plain hash of 0 no plain one."""

    def __missing__(self, word: str) -> tuple[int, int, int]:
        core = word.strip(OUTER)
        lower = core.lower()
        number = NUMERIC.fullmatch(core)
        if not core:
            kind = -1
        elif lower in NUMBER_WORDS or number and (not number["unit"] or number["unit"].lower() in UNITS):
            kind = NUMBER
        elif lower in UNITS:
            kind = UNIT
        elif core[0].isupper():
            kind = NAME
        else:
            kind = LITERAL
        if len(self) > MEMO:
            self.clear()
        own = xxhash.xxh3_64_intdigest(lower) | 4
        plain = own if core else xxhash.xxh3_64_intdigest(word) | 4 if word and OPERATORS.issuperset(word) else 0
        made = kind, {NUMBER: 1, NAME: 2}.get(kind) or own, plain
        if len(word) <= 64:
            self[word] = made
        return made


_CANON = Canon()
MEMOS["canon"] = _CANON.clear


class Tokens:
    """The canonical and the plain tokens of a slice of texts, with the text each belongs to."""

    def __init__(self, texts: pa.Array):
        lists = pc.utf8_split_whitespace(texts)
        self.words = lists.flatten().dictionary_encode()
        made = [_CANON[w] for w in self.words.dictionary.to_pylist()]
        word = self.words.indices.to_numpy(zero_copy_only=False)
        text = np.repeat(np.arange(len(texts)), np.diff(lists.offsets.to_numpy()))
        kinds, hashes, plain = (np.array([m[i] for m in made], dtype)[word] for i, dtype in enumerate((np.int8, np.uint64, np.uint64)))
        place = np.flatnonzero(kinds >= 0)
        kinds = kinds[place]
        before = np.concatenate([[LITERAL], kinds[:-1]]).astype(np.int8)[: len(kinds)]
        fresh = np.concatenate([[True], np.diff(text[place]) != 0])[: len(place)]
        starts = fresh | ~((kinds == NAME) & (before == NAME) | (kinds == UNIT) & (before == NUMBER))
        self.first = place[starts]
        self.hashes, self.text = hashes[self.first], text[self.first]
        self.literal = (kinds[starts] == LITERAL) | (kinds[starts] == UNIT)
        self.ends = np.append(self.first[1:], len(word))
        last = np.searchsorted(text, self.text, "right")
        self.ends = np.minimum(self.ends, last)
        self.plain, self.plain_text = plain[plain != 0], text[plain != 0]

    def weights(self, plain: bool) -> np.ndarray:
        """What each token weighs as evidence; a placeholder as little as a common word."""
        common = np.isin(self.plain, _COMMON_HASHES) if plain else np.isin(self.hashes, _COMMON_HASHES) | (self.hashes < 4)
        return np.where(common, COMMON_WEIGHT, 1.0)

    def windows(self, length: int, plain: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(start, text, hash) of every usable window of `length` tokens; at least half of a template window is literal."""
        tokens, text = (self.plain, self.plain_text) if plain else (self.hashes, self.text)
        n = max(0, len(tokens) - length + 1)
        total = np.full(n, length + 1000 * plain, np.uint64)
        for j in range(length):
            total = (total ^ tokens[j : j + n]) * MULTIPLIER
            total ^= total >> np.uint64(29)
        usable = text[:n] == text[length - 1 : length - 1 + n]
        if not plain:
            sums = np.concatenate([[0], np.cumsum(self.literal)])
            usable &= 2 * (sums[length : length + n] - sums[:n]) >= length
        at = np.flatnonzero(usable)
        return at, text[at], total[at]

    def values(self, at: int, length: int) -> list[str]:
        """What stands in a template window's placeholders, in order."""
        found = []
        for i in range(at, at + length):
            if not self.literal[i]:
                words = self.words[int(self.first[i]) : int(self.ends[i])].to_pylist()
                found.append(" ".join(w for w in (x.strip(OUTER) for x in words) if w))
        return found


def canonical(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each canonical token of a text, whether it is literal)."""
    tokens = Tokens(pa.array([text or ""], pa.string()))
    return tokens.hashes, tokens.literal


def template_length(n: int) -> int:
    return min(WINDOW, max(LEAST, n))


def plain_length(n: int) -> int:
    return next((length for least, length, _ in PLAIN if n >= least), max(1, n))


_HITS = "id long, pos int, hash long, plain boolean, length int, n int, slots array<string>"


def _windows(table: DataFrame, id_column: str, lengths: list[tuple[bool, int]] | None = None, cells: np.ndarray | None = None) -> DataFrame:
    """Usable windows (id, pos, hash, plain, length, n windows of the text, slots): of documents those of all `lengths` that the
    filter's cells hold; of items, without `lengths`, those of the lengths that go with their numbers of tokens."""

    def hits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.string()))
        for batch in batches:
            keys, texts = batch["id"].to_pylist(), batch["text"].cast(pa.string()).fill_null("")
            sizes, at = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)), 0
            while at < len(texts):
                upto = max(at + 1, int(np.searchsorted(sizes, (sizes[at - 1] if at else 0) + SLICE_BYTES, "right")))
                tokens = Tokens(texts.slice(at, upto - at))
                first = [np.searchsorted(t, np.arange(upto - at + 1)) for t in (tokens.text, tokens.plain_text)]
                counts = [np.diff(f) for f in first]
                own = [np.array([f(n) for n in c.tolist()], np.int64) for f, c in zip((template_length, plain_length), counts)] if lengths is None else None
                wanted = lengths if own is None else sorted({(bool(p), int(n)) for p in (0, 1) for n in own[p]})
                out: list[list] = [[] for _ in kinds]
                for plain, length in wanted:
                    start, text, hashes = tokens.windows(length, plain)
                    keep = own[plain][text] == length if own is not None else (cells[(hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] >> (hashes & np.uint64(63))) & np.uint64(1) != 0
                    start, text, hashes = start[keep], text[keep], hashes[keep]
                    n = np.bincount(text, minlength=upto - at)
                    for column, values in zip(out, ([keys[at + t] for t in text.tolist()], (start - first[plain][text]).tolist(), hashes.view(np.int64).tolist(), [plain] * len(start), [length] * len(start), n[text].tolist())):
                        column.extend(values)
                    out[-1].extend([None] * len(start) if plain else [tokens.values(a, length) for a in start.tolist()])
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["id", "pos", "hash", "plain", "length", "n", "slots"])
                at = upto

    return table.select(F.col(id_column).alias("id"), "text").mapInArrow(lean(hits, "canon"), _HITS)


def _item_weights(benchmark: DataFrame) -> DataFrame:
    """(id, plain, weights): what each token of an item weighs; of rows that share an id the longest one's."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for key, text in zip(batch["id"].to_pylist(), batch["text"].cast(pa.string()).fill_null("").to_pylist()):
                tokens = Tokens(pa.array([text], pa.string()))
                weights = [tokens.weights(plain).tolist() for plain in (False, True)]
                yield pa.RecordBatch.from_arrays([pa.array([key] * 2, pa.int64()), pa.array([False, True]), pa.array(weights, pa.list_(pa.float64()))], names=["id", "plain", "weights"])

    rows = benchmark.select(F.col("item_id").alias("id"), "text").mapInArrow(lean(weigh, "canon"), "id long, plain boolean, weights array<double>")
    return rows.groupBy("id", "plain").agg(F.max(F.struct(F.size("weights").alias("size"), "weights")).alias("w")).select("id", "plain", "w.weights")


def _covered(at: str, length: str = "length") -> str:
    """SQL of the item's tokens that the windows at these places cover."""
    return f"array_distinct(flatten(transform({at}, p -> sequence(p, p + {length} - 1))))"


def _weight(places: str) -> str:
    """SQL of the weight of an item's tokens at these places."""
    return f"aggregate({places}, 0D, (s, i) -> s + coalesce(get(weights, i), 0D))"


def _content(covered: str) -> Column:
    """Whether the tokens at these places are enough of the item's weight."""
    least = F.lit(0.0)
    for tokens, share in CONTENT[::-1]:
        least = F.when(F.size("weights") >= tokens, share).otherwise(least)
    return F.expr(_weight(covered)) >= least * F.expr("aggregate(weights, 0D, (s, w) -> s + w)") - F.lit(1e-9)


def _templates(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs that share template windows whose values agree: matched, windows, agreement, differ."""
    diagonal = ["doc_id", "item_id", "diagonal"]
    pairs = hits.select(*diagonal, F.explode(F.arrays_zip("item_slots", "doc_slots")).alias("s")).groupBy(*diagonal, "s.item_slots", "s.doc_slots").agg(F.count("*").alias("n"))
    by_value = pairs.groupBy(*diagonal, "item_slots").agg(F.max("n").alias("most"), F.sum("n").alias("all"), F.max(F.col("item_slots") != F.col("doc_slots")).alias("differ"))
    agreed = by_value.groupBy(*diagonal).agg((F.sum("most") / F.sum("all")).alias("agreement"), F.max("differ").alias("differ"))
    same = [F.col(f"h.{c}").eqNullSafe(F.col(f"g.{c}")) for c in diagonal]
    judged = (
        hits.select(*diagonal, "item_pos").alias("h").join(agreed.alias("g"), same, "left")
        .select(*[F.col(f"h.{c}").alias(c) for c in diagonal], "item_pos", F.coalesce("agreement", F.lit(1.0)).alias("agreement"), F.coalesce("differ", F.lit(False)).alias("differ"))
    )
    consistent = judged.where(F.col("agreement") >= AGREEMENT)
    matched = consistent.groupBy("doc_id", "item_id").agg(F.collect_set("item_pos").alias("at"), F.min("agreement").alias("agreement"), F.max("differ").alias("differ"))
    matched = matched.withColumn("matched", F.size("at").cast("long"))
    sized = matched.alias("m").join(sizes.where("NOT plain").alias("z"), F.col("m.item_id").eqNullSafe(F.col("z.id")))
    return sized.where((F.col("matched") / F.col("windows") >= COVERAGE) & _content(_covered("at"))).select("doc_id", "item_id", "matched", "windows", "agreement", "differ")


def _copies(hits: DataFrame, sizes: DataFrame) -> DataFrame:
    """Pairs that share plain windows about one diagonal."""
    per_diagonal = hits.groupBy("doc_id", "item_id", "diagonal").agg(F.countDistinct("item_pos").alias("run"), F.collect_set("item_pos").alias("at"))
    # A copy spreads over fewer diagonals than half a band, so one of two bands that overlap by half holds it.
    band = F.explode(F.array(*[F.floor((F.col("diagonal") + shift) / BAND) * 2 + half for half, shift in enumerate((0, BAND // 2))])).alias("band")
    banded = per_diagonal.select("doc_id", "item_id", "run", "at", band).groupBy("doc_id", "item_id", "band").agg(F.max("run").alias("run"), F.flatten(F.collect_list("at")).alias("at"))
    matched = banded.withColumn("at", F.array_distinct("at")).withColumn("matched", F.size("at").cast("long"))
    sized = matched.alias("m").join(sizes.where("plain").alias("z"), F.col("m.item_id").eqNullSafe(F.col("z.id")))
    share = F.lit(1.0)
    for _, length, least in PLAIN[::-1]:
        share = F.when((F.col("length") == length) & (F.col("windows") > 1), least).otherwise(share)
    sized = sized.withColumn("covered", F.expr(_covered("at")))
    long_run = (F.col("run") >= RUN) & (F.col("length") == WINDOW) & F.expr(f"size(filter(covered, i -> get(weights, i) = 1D)) >= {RUN_CONTENT}")
    found = sized.where((F.col("matched") >= share * F.col("windows")) & _content("covered") | long_run).groupBy("doc_id", "item_id").agg(F.max("matched").alias("matched"), F.first("windows").alias("windows"))
    return found.select("doc_id", "item_id", "matched", "windows", F.lit(1.0).alias("agreement"), F.lit(False).alias("differ"))


def find_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Pairs (doc_id, item_id) of a document and a benchmark item whose text or template it holds.

    With matched (windows of the item found), windows (all its usable ones), coverage, agreement
    (of the values in placeholders, 1 without any) and verdict: `copy`, or `template` where
    values differ; of a pair found both ways the plain one counts. Null texts hold nothing, rows that share a doc_id or an item_id are judged together, null ids
    too; an item without a word can't be found; an empty table gives no rows. Further columns are ignored.
    """
    items = staged(_windows(benchmark, "item_id"), "benchmark-windows")
    sizes = items.select("id", "pos", "plain", "length").distinct().groupBy("id", "plain").agg(F.count("*").alias("windows"), F.max("length").alias("length"))
    weights = _item_weights(benchmark)
    sizes = staged(sizes.alias("z").join(weights.alias("w"), F.col("z.id").eqNullSafe(F.col("w.id")) & (F.col("z.plain") == F.col("w.plain"))).select("z.*", "w.weights"), "benchmark-items")
    lengths = sorted((r["plain"], r["length"]) for r in items.select("plain", "length").distinct().collect())  # a dozen rows or so
    held = hash_filter(items, "hash", "benchmark-cells").toArrow()  # 2 ** FILTER_BITS rows of 16 bytes at most
    cells = np.zeros(1 << FILTER_BITS, np.uint64)
    cells[held["word"].to_numpy()] = held["bits"].to_numpy().view(np.uint64)
    found = _windows(docs, "doc_id", lengths, cells)
    joined = found.select(F.col("id").alias("doc_id"), F.col("pos").alias("doc_pos"), "hash", F.col("slots").alias("doc_slots")).join(
        items.select(F.col("id").alias("item_id"), F.col("pos").alias("item_pos"), "hash", "plain", F.col("slots").alias("item_slots")), "hash"
    )
    hits = staged(joined.withColumn("diagonal", F.col("doc_pos") - F.col("item_pos")).drop("hash", "doc_pos"), "template-hits")
    templates = _templates(hits.where("NOT plain"), sizes).withColumn("plain", F.lit(False))
    copies = _copies(hits.where("plain"), sizes).withColumn("plain", F.lit(True))
    best = F.max(F.struct("plain", "matched", "windows", "agreement", "differ")).alias("b")
    return templates.unionByName(copies).groupBy("doc_id", "item_id").agg(best).select(
        "doc_id", "item_id", "b.matched", "b.windows", (F.col("b.matched") / F.col("b.windows")).alias("coverage"), "b.agreement", F.when(F.col("b.differ"), "template").otherwise("copy").alias("verdict")
    )


def drop_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents, all columns, in which no benchmark item was found; null doc_ids go together."""
    (leaked,) = unused(docs.columns, "leaked")
    found = staged(find_leaks(docs, benchmark).select(F.col("doc_id").alias(leaked)).distinct(), "leaked-documents")
    return docs.join(found, F.col("doc_id").eqNullSafe(F.col(leaked)), "left_anti")
