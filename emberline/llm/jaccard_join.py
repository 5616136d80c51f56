"""Exact Jaccard join of word n-gram sets over whole texts, with components of its links.

Equal sets are one set from the start. Sets are dealt to tiles of like size (bands), and in a tile to
segments: every shingle belongs to one of K segments by its hash. Two sets that differ in at most D
shingles agree on all but D of the segments at most, so with K above the band's D they share a segment whole, and
only sets that do are compared. More: a set with F filled segments shares F - D of them at least with every
set it links to, so a set that shares fewer with the whole corpus has no link in that tile and leaves it, and
one that shares S keeps the S - (F - D) + 1 rarest: the rarest that two linked sets have in common is among these for both.
Where too few segments hold anything, the set is dealt anew by other hashes. So no link is lost, and a
passage that many documents share brings them together only where it fills most of them.

Of the sets that are left, shingles that stand in one set alone bound the overlap with any other from above, which
parts copies that were edited too much from each other without comparing them.

Pairs are compared where they can still join components: first every set with one of the best connected
sets of its segments, then the rest across components. Bitmaps as wide as
the sets are large bound the overlap from above, and only pairs that they leave are compared by their sorted shingle arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .components import connected_components
from .memory import lean
from .shared import hash_filter, may_hold, partitions, staged, unused
from .words import hashed_words

#: Segments beyond D + 1, as a share.
SLACK = 0.2
#: Buckets of hashes, two to this power at least; hashes that a task gathers before it deals them to buckets.
BUCKETS, CHUNK = 12, 1 << 18
#: Bits of a bitmap for each shingle, and in all at least; groups that a leader's members are dealt to, at most.
DENSITY, LEAST_BITS, GROUPS = 3, 1024, 256
#: 64-bit words of the small bitmap that tiles compare, those of the least one; sets of a segment that meet in one tile, about, or with those of another.
FOLDED, TILE = LEAST_BITS // 64, 2048
_ODD = np.uint64(0x9E3779B97F4A7C15)
_SHIFT = np.uint64(31)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _SHIFT)) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def shingle_sets(texts: pa.Array, size: int) -> Iterator[np.ndarray]:
    """Per text the sorted distinct hashes of its word n-grams; a shorter text is one shingle.

    Words are what ASCII blanks part, with A-Z in lower case.
    """
    for words, bounds in hashed_words(texts, lower=True):
        total = np.full(max(0, len(words) - size + 1), size, np.uint64)
        for j in range(size):
            total = _mix(total * _ODD + words[j : j + len(total)])
        for begin, end in zip(bounds.tolist(), bounds[1:].tolist()):
            if end - begin >= size:
                found = np.sort(total[begin : end - size + 1])
                yield found[np.concatenate([[True], found[1:] != found[:-1]])]
            else:
                whole = np.full(min(1, end - begin), end - begin, np.uint64)
                for j in range(begin, end):
                    whole = _mix(whole * _ODD + words[j])
                yield whole


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def bitmap(hashes: np.ndarray) -> bytes:
    """The set's size in 8 bytes, and a bit for each cell that a shingle falls in; a power of two of cells, by the size."""
    cells = max(LEAST_BITS, 1 << (DENSITY * len(hashes) - 1).bit_length())
    bits = np.zeros(cells, np.uint8)
    bits[hashes & np.uint64(cells - 1)] = 1
    return len(hashes).to_bytes(8, "little") + np.packbits(bits, bitorder="little").tobytes()


@dataclass(frozen=True)
class Join:
    """Shingle size, and the least Jaccard similarity in hundredths.

    Below 70 hundredths linked sets may differ in so many shingles that no segment need be common.
    """

    size: int
    percent: int

    def __post_init__(self) -> None:
        if not 70 <= self.percent <= 100 or self.size < 1:
            raise ValueError("percent must be from 70 to 100 and size 1 at least")

    def differ(self, a: int, b: int) -> int:
        """The most shingles by which linked sets of these sizes differ."""
        return (a + b) * (100 - self.percent) // (100 + self.percent)

    def may_link(self, a: bytes, b: bytes) -> bool:
        """Whether the sizes and bitmaps of two sets leave room for a link."""
        n, m = int.from_bytes(a[:8], "little"), int.from_bytes(b[:8], "little")
        if 100 * min(n, m) < self.percent * max(n, m):
            return False
        x, y = np.frombuffer(a, np.uint64, offset=8), np.frombuffer(b, np.uint64, offset=8)
        cells = min(len(x), len(y))  # a wider bitmap folds to a narrower one
        x, y = (np.bitwise_or.reduce(z.reshape(-1, cells), axis=0) if len(z) > cells else z for z in (x, y))
        most = min(n - int(np.bitwise_count(x & ~y).sum()), m - int(np.bitwise_count(y & ~x).sum()))
        return 100 * most >= self.percent * (n + m - most)

    def links(self, a: np.ndarray, b: np.ndarray) -> bool:
        both = len(np.intersect1d(a, b, assume_unique=True))
        return 100 * both >= self.percent * (len(a) + len(b) - both)

    def bands(self, upto: int) -> list[int]:
        """First sizes of the bands; a linked pair lies in one band or two that follow each other."""
        edges = [1]
        while edges[-1] <= upto:
            edges.append(edges[-1] + max(1, int(edges[-1] * ((100 / self.percent) ** 3 - 1))))
        return edges

    def tiles(self, n: int) -> list[tuple[int, int, int]]:
        """(tile, segments, D of a set of this size) for each tile in which the set meets others."""
        edges = self.bands(n)
        band = len(edges) - 2
        found = []
        for tile, other in ((band, n * 100 // self.percent), (band - 1, edges[band] - 1)):
            if tile >= 0 and (tile == band or n * self.percent <= 100 * (edges[band] - 1)):
                top = edges[tile + 1] - 1
                most = self.differ(top, top * 100 // self.percent)
                own = self.differ(n, other)
                if own:
                    found.append((tile, most + 1 + int(np.ceil(SLACK * (most + 1))), own))
        return found

    def segment_keys(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(keys, tiles, needs): the keys of all filled segments, and how many of a tile's the set shares with each set it
        links to there; 0 where the set had to be dealt anew, so that it can't be told."""
        keys, tiles, needs = [np.zeros(0, np.uint64)], [], []
        for tile, k, own in self.tiles(len(hashes)):
            round_no = 0
            while True:
                base = np.uint64((tile << 20 | round_no) * int(_ODD) % (1 << 64))
                spread = _mix(hashes + base)
                segment = (spread % np.uint64(k)).astype(np.int64)
                sums = np.zeros(k, np.uint64)
                np.add.at(sums, segment, _mix(spread))
                filled = np.flatnonzero(np.bincount(segment, minlength=k))
                keys.append(_mix(_mix(sums[filled] + base) + filled.astype(np.uint64) * _ODD))
                tiles.append(np.full(len(filled), tile, np.int32))
                done = len(filled) > own
                needs.append(np.full(len(filled), len(filled) - own if done and not round_no else 0, np.int64))
                if done:
                    break
                round_no += 1
        return np.concatenate(keys), np.concatenate([np.zeros(0, np.int32), *tiles]), np.concatenate([np.zeros(0, np.int64), *needs])


_ROWS = "doc_id long, set long, n int, text_hash long, bits binary, even int, odd int, keys binary"


def _rows(docs: DataFrame, join: Join) -> DataFrame:
    """Per document its set's hash (null without shingles), n its size, the text's hash, and for the first document of a set in a
    task the set's bits, its needs in the even and in the odd tile, and its keys, whose last bit tells which of the two."""

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent: set[int] = set()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets, sizes, bits, keys, needs = [], [], [], [], ([], [])
                for hashes in shingle_sets(some["text"], join.size):
                    own = _signed(xxhash.xxh3_64_intdigest(hashes.tobytes())) if len(hashes) else None
                    sets.append(own)
                    sizes.append(len(hashes))
                    new = own is not None and own not in sent
                    bits.append(bitmap(hashes) if new else None)
                    if new:
                        sent.add(own)
                        key, tile, need = join.segment_keys(hashes)
                        odd = (tile & 1).astype(np.uint64)
                        keys.append((key & ~np.uint64(1) | odd).tobytes())
                    else:
                        keys.append(None)
                    for side in (0, 1):
                        needs[side].append(int(need[odd == side].max(initial=0)) if new else None)
                yield pa.RecordBatch.from_arrays(
                    [some["doc_id"].cast(pa.int64()), pa.array(sets, pa.int64()), pa.array(sizes, pa.int32()), some["text_hash"], pa.array(bits, pa.binary()), *(pa.array(x, pa.int32()) for x in needs), pa.array(keys, pa.binary())],
                    names=["doc_id", "set", "n", "text_hash", "bits", "even", "odd", "keys"],
                )

    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash")).mapInArrow(lean(make), _ROWS)


def _packed(df: DataFrame, read: Callable[[pa.RecordBatch], Iterator[tuple[np.ndarray, np.ndarray]]]) -> DataFrame:
    """(bucket, pack), the rows of a bucket together: hashes and the sets that hold them, as `read` finds them in a batch.

    A bucket is the first bits of its hashes. A pack has many pairs in 12 bytes each: the sets, then the last 32 bits of the hashes.
    """
    power = max(BUCKETS, (4 * partitions(df.sparkSession)).bit_length())

    def deal(some: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        hashes, sets = (np.concatenate(x) for x in zip(*some))
        bucket = hashes >> np.uint64(64 - power)
        order = np.argsort(bucket.astype(np.uint16) if power <= 16 else bucket, kind="stable")
        bucket, last, sets = bucket[order].astype(np.int64), hashes[order].astype(np.uint32), sets[order]
        begins = np.flatnonzero(np.diff(bucket, prepend=-1)).tolist()
        packs = [sets[b:e].tobytes() + last[b:e].tobytes() for b, e in zip(begins, [*begins[1:], len(bucket)])]
        return pa.RecordBatch.from_arrays([pa.array(bucket[begins]), pa.array(packs, pa.binary())], names=["bucket", "pack"])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting, held = [], 0
        for batch in batches:
            for hashes, sets in read(batch):
                waiting.append((hashes, sets))
                held += len(hashes)
                if held >= CHUNK:
                    yield deal(waiting)
                    waiting, held = [], 0
        if held:
            yield deal(waiting)

    return df.mapInArrow(lean(pack), "bucket long, pack binary").repartition("bucket").sortWithinPartitions("bucket")


def _buckets(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(bucket, hashes, sets) of each bucket whole, the hashes by their last 32 bits and in their order."""
    now, packs = None, []

    def whole() -> tuple[int, np.ndarray, np.ndarray]:
        sizes = [len(x) // 12 for x in packs]
        last = np.concatenate([np.frombuffer(x, np.uint32, n, 8 * n) for x, n in zip(packs, sizes)])
        sets = np.concatenate([np.frombuffer(x, np.int64, n) for x, n in zip(packs, sizes)])
        order = np.argsort(last)
        return now, last[order], sets[order]

    for batch in batches:
        for bucket, pack in zip(batch["bucket"].to_pylist(), batch["pack"].to_pylist()):
            if bucket != now:
                if packs:
                    yield whole()
                now, packs = bucket, []
            packs.append(pack)
    if packs:
        yield whole()


def _several(last: np.ndarray) -> np.ndarray:
    """Which of the sorted hashes stand there more than once."""
    same = last[1:] == last[:-1]
    return np.append(same, False) | np.append(False, same)


def _recurring(rows: DataFrame) -> DataFrame:
    """(key, set, sharing) of the keys that several sets have; keys that agree in what is left of them count as one."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for own, keys in zip(batch["set"].to_pylist(), batch["keys"].to_pylist()):
            found = np.frombuffer(keys, np.uint64)
            yield found, np.full(len(found), own, np.int64)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, last, sets in _buckets(batches):
            some = _several(last)
            last, sets = last[some], sets[some]
            order = np.lexsort((sets, last))
            last, sets = last[order], sets[order]
            new = np.append(True, (last[1:] != last[:-1]) | (sets[1:] != sets[:-1]))[: len(last)]  # copies in several tasks send a set's keys more than once
            last, sets = last[new], sets[new]
            _, group, sharing = np.unique(last, return_inverse=True, return_counts=True)
            sharing = sharing[group]
            for at in range(0, len(last), 100_000):
                part = [x[at : at + 100_000][sharing[at : at + 100_000] > 1] for x in (last, sets, sharing)]
                yield pa.RecordBatch.from_arrays([pa.array(part[0].astype(np.int64) | bucket << 32), pa.array(part[1]), pa.array(part[2])], names=["key", "set", "sharing"])

    return _packed(rows.where("keys IS NOT NULL").select("set", "keys"), read).mapInArrow(lean(meet), "key long, set long, sharing long")


def _compared(pairs: DataFrame, data: DataFrame, read: Callable[[pa.Array], Iterator], test: Callable[..., bool]) -> DataFrame:
    """The pairs (u member, v leader) that pass the test of their sets' data (set, data).

    A leader's members are dealt to GROUPS at most; a task meets the leader's data first and then one member at a time.
    """
    groups = pairs.select("u", "v", F.pmod(F.xxhash64("u"), F.lit(GROUPS)).cast("int").alias("salt"))
    members = groups.join(data.withColumnRenamed("set", "u"), "u").select("v", "salt", F.col("u").alias("member"), "data")
    leaders = groups.select("v", "salt").distinct().join(data.withColumnRenamed("set", "v"), "v").select("v", "salt", F.lit(None).cast("long").alias("member"), "data")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, leader = None, None
        for batch in batches:
            us, vs = [], []
            for v, salt, member, own in zip(batch["v"].to_pylist(), batch["salt"].to_pylist(), batch["member"].to_pylist(), read(batch["data"])):
                if member is None:
                    group, leader = (v, salt), own
                elif group == (v, salt) and test(leader, own):
                    us.append(member)
                    vs.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(us, pa.int64()), pa.array(vs, pa.int64())], names=["u", "v"])

    ordered = leaders.unionByName(members).repartition("v", "salt").sortWithinPartitions("v", "salt", F.asc_nulls_first("member"))
    return ordered.mapInArrow(lean(compare), "u long, v long")


def _bounded(pairs: DataFrame, facts: DataFrame, join: Join) -> DataFrame:
    """The pairs whose sizes and bitmaps leave room for a link."""
    return _compared(pairs, facts.select("set", F.col("bits").alias("data")), lambda column: iter(column.to_pylist()), join.may_link)


def _verified(pairs: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """The pairs that link, by exact intersection."""
    return _compared(pairs, texts.select("set", F.col("text").alias("data")), lambda column: shingle_sets(column, join.size), join.links)


def _linked(pairs: DataFrame, facts: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """The pairs that link, compared by size and bitmap before their texts move."""
    return staged(_verified(staged(_bounded(pairs, facts, join), "bounded-pairs"), texts, join), "links")


def _texts_of(docs: DataFrame, facts: DataFrame) -> DataFrame:
    """(set, text) of the sets, by one document of each; a hash filter spares the shuffle most other texts."""
    wanted = staged(facts.select("set", "doc_id", "text_hash"), "wanted-texts")
    hashed = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    near = may_hold(hashed, hash_filter(wanted, "text_hash", "wanted-cells"), "text_hash")
    joined = near.alias("d").join(wanted.alias("w"), F.col("d.doc_id").eqNullSafe(F.col("w.doc_id")) & (F.col("d.text_hash") == F.col("w.text_hash")))
    return staged(joined.select("w.set", "d.text").dropDuplicates(["set"]), "candidate-texts")


def _known(facts: DataFrame, texts: DataFrame, join: Join) -> DataFrame:
    """The sets with s, how many of their shingles other sets hold too; without those that this alone keeps from every link."""

    def read(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for own, found in zip(batch["set"].to_pylist(), shingle_sets(batch["text"], join.size)):
            yield found, np.full(len(found), own, np.int64)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, last, sets in _buckets(batches):
            own, times = np.unique(sets[~_several(last)], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(times)], names=["set", "times"])

    alone = staged(_packed(texts, read).mapInArrow(lean(count), "set long, times long").groupBy("set").agg(F.sum("times").alias("alone")), "own-shingles")
    counted = facts.join(alone, "set", "left").withColumn("s", (F.col("n") - F.coalesce("alone", F.lit(0))).cast("int")).drop("alone")
    return staged(counted.where(F.col("s") * F.lit(100).cast("long") >= join.percent * F.col("n")), "known-sets")


def _room(join: Join, a: str, b: str) -> Column:
    """Whether the shingles that two sets can have in common at most are enough for a link."""
    most = f"cast(least({a}s, {b}s) AS long)"
    return F.expr(f"100 * {most} >= {join.percent} * ({a}n + {b}n - {most})")


def _within_tile(join: Join, rows: dict[str, np.ndarray], crossed: bool) -> tuple[np.ndarray, np.ndarray]:
    """(u, v) of the pairs of sets of a tile that are of several components and that sizes, shingles of their own and folded bitmaps leave; between two blocks only if `crossed`."""
    order = np.argsort(rows["n"], kind="stable")
    sets, c, n, s, own, bits = (rows[name][order] for name in ("set", "c", "n", "s", "own", "bits"))
    upto = np.searchsorted(n, n * 100 // join.percent, "right")
    us, vs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    for i in range(len(sets) - 1):
        j = np.arange(i + 1, upto[i])
        most = np.minimum(s[i], s[j])
        j = j[(c[j] != c[i]) & (100 * most >= join.percent * (n[i] + n[j] - most)) & ((own[j] != own[i]) | (not crossed))]
        if len(j):
            gone = [np.bitwise_count(x).sum(axis=1).astype(np.int64) for x in (bits[i] & ~bits[j], bits[j] & ~bits[i])]
            most = np.minimum(np.minimum(s[i], s[j]), np.minimum(n[i] - gone[0], n[j] - gone[1]))
            j = j[100 * most >= join.percent * (n[i] + n[j] - most)]
            us.append(np.minimum(sets[i], sets[j]))
            vs.append(np.maximum(sets[i], sets[j]))
    return np.concatenate(us), np.concatenate(vs)


def _tiled(segments: DataFrame, facts: DataFrame, join: Join) -> DataFrame:
    """The pairs (u, v) of sets under one key and of several components that may link.

    The sets of a key are dealt to blocks of about TILE, and a tile is a block with itself or with another, so no key
    needs one task; pairs are compared where they stand, and only those that pass leave it.
    """
    hot = staged(segments.groupBy("key").agg(F.ceil(F.count("*") / TILE).alias("blocks")).where("blocks > 1"), "crowded-keys")
    dealt = segments.join(hot, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("own", F.pmod(F.xxhash64("set"), F.col("blocks")))
    tiles = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "own", "set", "c")
    small = staged(facts.join(segments.select("set").distinct(), "set", "left_semi").mapInArrow(lean(_fold), "set long, n long, s long, bits binary"), "folded-bitmaps")
    ordered = tiles.join(small, "set").repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[pa.RecordBatch] = []
        for batch in _and_end(batches):
            if batch is not None and batch.num_rows:
                waiting.append(batch)
            if not waiting or batch is not None and sum(b.num_rows for b in waiting) < 2 * TILE:
                continue
            table = pa.Table.from_batches(waiting).combine_chunks()
            tile = np.stack([table[name].to_numpy() for name in ("key", "low", "high")])
            ends = np.append(np.flatnonzero((tile[:, 1:] != tile[:, :-1]).any(axis=0)) + 1, table.num_rows)
            rows = {name: table[name].to_numpy() for name in ("set", "c", "n", "s", "own")}
            rows["bits"] = np.frombuffer(b"".join(table["bits"].to_pylist()), np.uint64).reshape(-1, FOLDED)
            begin, found = 0, []
            for end in ends.tolist() if batch is None else ends[:-1].tolist():  # the last tile may go on
                found.append(_within_tile(join, {name: column[begin:end] for name, column in rows.items()}, bool(tile[1, begin] != tile[2, begin])))
                begin = end
            waiting = table.slice(begin).to_batches()
            if found:
                u, v = (np.concatenate(x) for x in zip(*found))
                u, v = np.unique(np.stack([u, v]), axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    return ordered.mapInArrow(lean(compare), "u long, v long").distinct()


def _and_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch | None]:
    yield from batches
    yield None


def _fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmaps folded to FOLDED words."""
    for batch in batches:
        small = [np.bitwise_or.reduce(np.frombuffer(raw, np.uint64, offset=8).reshape(-1, FOLDED), axis=0).tobytes() for raw in batch["bits"].to_pylist()]
        yield pa.RecordBatch.from_arrays([batch["set"], batch["n"].cast(pa.int64()), batch["s"].cast(pa.int64()), pa.array(small, pa.binary())], names=["set", "n", "s", "bits"])


def jaccard_components(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row of `docs`: doc_id, n_shingles and component_id, the smallest doc_id reachable by links.

    Texts link when 100 * intersection >= percent * union of their sets of `size`-word shingles. Null,
    empty and blank texts have no shingle and no link; equal sets always link. Rows that repeat a
    doc_id are joined each; null doc_ids count as no doc_id of their component. An empty table gives no rows;
    further columns are ignored. Exact up to chance equality of 64-bit hashes.
    """
    return _labelled(docs, size, percent).select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def _rarest(keys: DataFrame, needs: DataFrame) -> DataFrame:
    """The rows (key, set) that the rarest key in common of two linked sets can be in, of rows (key, set, sharing).

    None of a set that shares fewer keys in a tile than its need, and the others' rarest that suffice; in no order of the keys may
    the first one in common of two sets come later.
    """
    own = Window.partitionBy("set", "side")
    sided = keys.join(needs, "set").withColumn("side", F.col("key").bitwiseAND(F.lit(1))).withColumn("need", F.expr("if(side = 0, even, odd)"))
    ranked = sided.withColumn("place", F.row_number().over(own.orderBy("sharing", "key"))).withColumn("n", F.count("*").over(own))
    return ranked.where("need = 0 OR n >= need AND place <= n - need + 1").select("key", "set")


def _labelled(docs: DataFrame, size: int, percent: int) -> DataFrame:
    """Per row of `docs`: doc_id, text_hash, n its shingles, c its component (null without shingles) and component_id, the least doc_id there."""
    join = Join(size, percent)
    rows = staged(_rows(docs, join), "segments")
    members = rows.select("doc_id", "set", "n", "text_hash", "bits")
    needs = rows.where("keys IS NOT NULL").groupBy("set").agg(F.max("even").alias("even"), F.max("odd").alias("odd"))
    rare = staged(_rarest(_recurring(rows), needs), "rare-keys")
    shared = staged(rare.join(rare.groupBy("key").agg(F.count("*").alias("sharing")).where("sharing > 1"), "key"), "shared-keys")

    fame = staged(shared.groupBy("set").agg(F.sum("sharing").alias("fame")), "fame")
    sets = members.where("set IS NOT NULL").groupBy("set").agg(F.min("doc_id").alias("least"))
    candidates = members.join(fame, "set").groupBy("set")
    facts = staged(candidates.agg(F.first("fame").alias("fame"), F.first("n").alias("n"), F.first("bits", True).alias("bits"), F.min(F.struct("doc_id", "text_hash")).alias("who")).select("set", "fame", "n", "bits", "who.*"), "candidate-sets")
    texts = _texts_of(docs, facts)
    facts = _known(facts, texts, join)
    placed = staged(shared.select("key", "set").join(facts.select("set", "fame", "n", "s"), "set"), "placed-segments")

    lead = F.max(F.struct("fame", "set", "n", "s")).alias("lead")
    leaders = staged(placed.groupBy("key").agg(lead).select("key", "lead.*").toDF("key", *(f"leader_{c}" for c in ("fame", "set", "n", "s"))), "leaders")
    led = placed.join(leaders, "key").where((F.col("set") != F.col("leader_set")) & _room(join, "", "leader_"))
    often = led.groupBy(F.col("set").alias("u"), F.col("leader_set").alias("v")).agg(F.count("*").alias("times"), F.max("leader_fame").alias("fame"))
    best = staged(often.groupBy("u").agg(F.max(F.struct("times", "fame", "v")).alias("m")).select("u", F.col("m.v").alias("v")), "best-pairs")
    links = _linked(best, facts, texts, join)
    labels = staged(connected_components(links), "labels")

    # What is left are keys that sets of several components have.
    now = placed.select("key", "set").join(labels.select(F.col("node").alias("set"), "component"), "set", "left").select("key", "set", F.coalesce("component", "set").alias("c"))
    several = now.groupBy("key").agg(F.min("c").alias("low"), F.max("c").alias("high")).where("low <> high").select("key")
    mixed = staged(now.join(several, "key", "left_semi"), "mixed-segments")
    tested = best.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct()
    last = staged(_tiled(mixed, facts, join).join(tested, ["u", "v"], "left_anti"), "last-pairs")
    if not last.isEmpty():
        labels = staged(connected_components(links.unionByName(_linked(last, facts, texts, join))), "labels")

    smallest = sets.select("set", F.col("least").alias("doc_id")).join(labels.withColumnRenamed("node", "set"), "set", "left").select("set", F.coalesce("component", "set").alias("c"), "doc_id")
    roots = smallest.groupBy("c").agg(F.min("doc_id").alias("component_id"))
    of_set = staged(smallest.join(roots, "c").select("set", "c", "component_id"), "set-components")
    return members.select("doc_id", "text_hash", "set", "n").join(of_set, "set", "left").drop("set")


def drop_near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """The documents, all columns, that are the first of their component: one row each, with the component's smallest
    doc_id, null only where all its ids are. Texts without shingles all stay."""
    rows = _labelled(docs, size, percent)
    counted = rows.where("c IS NOT NULL").groupBy("c", "doc_id", "text_hash").agg(F.count("*").alias("times"))
    firsts = counted.groupBy("c").agg(F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_hash", "times")).alias("f"))
    blank = rows.where("c IS NULL").select("doc_id", "text_hash", F.lit(1).cast("long").alias("times")).distinct()
    hashed, kept_id, kept_text, times = unused(docs.columns, "hash", "kept_id", "kept_text", "times")
    kept = staged(firsts.select("f.doc_id", "f.text_hash", "f.times").unionByName(blank).toDF(kept_id, kept_text, times), "kept-documents")
    found_in = docs.withColumn(hashed, F.xxhash64("text"))
    same = F.col("doc_id").eqNullSafe(F.col(kept_id)) & (F.col(hashed) == F.col(kept_text))
    once, repeated = kept.where(F.col(times) == 1), kept.where(F.col(times) > 1)
    found = found_in.join(once, same, "left_semi")
    if not repeated.isEmpty():
        found = found.unionByName(found_in.join(repeated, same, "left_semi").dropDuplicates(["doc_id", hashed]))
    return found.drop(hashed)
