"""Merkle manifest of a dataset by trees of SHA-256 midstates.

A row is a leaf; per group the leaves, in order, form a tree in which every FANOUT consecutive nodes hash to one, and the groups' roots,
in order, form another above them. Every hash is of its inputs' hexadecimal texts one after another.

A parent keeps a copy of its hash state before each child's slot. To see what a replaced child makes of the root, the state of its slot is
resumed with the replacement and the siblings to its right only, level by level; what stands to its left is never hashed again.

Leaves are numbered in their group by a sort over ranges, and a block of FANOUT ** LEVELS consecutive ones is a row: the part of the tree that
a task holds at once. Blocks reduce to the leaves of the next tier, which is smaller by that factor, until one is left in each group. The way
down gives each block its path: per level above it, the siblings to the left and to the right of the node it leads to. So a task proves and folds the
leaves of a block with nothing but the block and its path, and no task, group or driver holds a level of the tree.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .memory import lean
from .shared import staged, unused

#: Children of a node at most; levels of a tree that a block spans.
FANOUT, LEVELS = 16, 2
BLOCK = FANOUT**LEVELS


class Parent:
    """A node's hash, made with the state before each child's slot kept."""

    __slots__ = ("children", "states", "digest")

    def __init__(self, children: list[bytes]):
        state, self.children, self.states = hashlib.sha256(), children, []
        for child in children:
            self.states.append(state.copy())
            state.update(child)
        self.digest = state.hexdigest().encode()

    def folded(self, slot: int, child: bytes) -> bytes:
        """The hash with another child in a slot: the slot's state goes on with it and what is to its right."""
        state = self.states[slot].copy()
        state.update(child)
        for right in self.children[slot + 1 :]:
            state.update(right)
        return state.hexdigest().encode()

    def siblings(self, slot: int) -> tuple[bytes, bytes]:
        """What is to the left of a slot, and to its right."""
        return b"".join(self.children[:slot]), b"".join(self.children[slot + 1 :])


class Step:
    """A level of a path above a block: the siblings, and the state before the node's slot."""

    __slots__ = ("left", "right", "state")

    def __init__(self, left: bytes, right: bytes):
        self.left, self.right, self.state = left, right, hashlib.sha256(left)

    def folded(self, child: bytes) -> bytes:
        state = self.state.copy()
        state.update(child)
        state.update(self.right)
        return state.hexdigest().encode()


def subtree(leaves: list[bytes], levels: int) -> list[list[Parent]]:
    """The levels of parents above a block's leaves, lowest first."""
    found, below = [], leaves
    for _ in range(levels):
        found.append([Parent(below[i : i + FANOUT]) for i in range(0, len(below), FANOUT)])
        below = [parent.digest for parent in found[-1]]
    return found


def levels_of(n: int) -> int:
    """Levels that a block of a group of n nodes spans."""
    found = 0
    while found < LEVELS and n > FANOUT**found:
        found += 1
    return found


def field_text(column: Column, is_text: bool) -> Column:
    """`-` if null, else the value's bytes as a decimal number, `:` and the value."""
    value = column if is_text else column.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_hash(*fields: Column) -> Column:
    """Lowercase hexadecimal SHA-256 of the fields' texts one after another."""
    return F.sha2(F.concat(*fields), 256)


_TIER = "g long, rank long, n long, digest string"


def numbered(rows: DataFrame, group: str, order: list[Column]) -> DataFrame:
    """The rows with rank, their place in their group from 0, and n, how many the group has. Null is a group.

    The rows are sorted over ranges, so a large group fills many tasks; counts per range and group alone are summed up.
    """
    part, place, held, first, before, key = unused(rows.columns, "range_no", "range_place", "held", "first", "before", "group_key")
    ranged = rows.repartitionByRange(F.asc_nulls_first(group), *order).sortWithinPartitions(F.asc_nulls_first(group), *order)
    placed = staged(ranged.withColumn(part, F.spark_partition_id()).withColumn(place, F.monotonically_increasing_id()), "numbered-rows")
    counts = placed.groupBy(F.col(group).alias(key), F.col(part).alias(f"{part}_")).agg(F.count("*").alias(held), F.min(place).alias(first))
    by = Window.partitionBy(key)
    offsets = counts.withColumn(before, F.coalesce(F.sum(held).over(by.orderBy(f"{part}_").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("n", F.sum(held).over(by))
    joined = placed.join(offsets, F.col(group).eqNullSafe(F.col(key)) & (F.col(part) == F.col(f"{part}_")))
    return joined.withColumn("rank", F.col(place) - F.col(first) + F.col(before)).select(*rows.columns, "rank", "n")


def _blocks(nodes: DataFrame, *more: str) -> DataFrame:
    """A row per block: g, block, n, and its nodes in order with the columns in `more`."""
    node = F.struct("rank", "digest", *more)
    return nodes.groupBy("g", F.floor(F.col("rank") / BLOCK).alias("block")).agg(F.first("n").alias("n"), F.array_sort(F.collect_list(node)).alias("nodes"))


def _reduced(blocks: DataFrame) -> DataFrame:
    """The next tier: each block's digest is a node of its group."""

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for n, nodes in zip(batch["n"].to_pylist(), batch["digests"].to_pylist()):
                above = subtree([d.encode() for d in nodes], levels_of(n))
                digests.append(above[-1][0].digest.decode() if above else nodes[0])
            sizes = pa.array([-(-n // BLOCK) for n in batch["n"].to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([batch["g"], batch["block"], sizes, pa.array(digests, pa.string())], names=["g", "rank", "n", "digest"])

    return blocks.select("g", "block", "n", F.col("nodes.digest").alias("digests")).mapInArrow(lean(reduce), _TIER)


def _led(blocks: DataFrame) -> DataFrame:
    """Per node of the blocks, which have their paths: g, rank, and its path (lefts, rights) up to the last node."""

    def lead(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g, n, nodes, *above in zip(*(batch[c].to_pylist() for c in ("g", "n", "nodes", "lefts", "rights"))):
                levels = subtree([x["digest"].encode() for x in nodes], levels_of(n))
                paths: tuple[list, list] = [], []
                for i in range(len(nodes)):
                    own = [parents[i // FANOUT ** (k + 1)].siblings(i // FANOUT**k % FANOUT) for k, parents in enumerate(levels)]
                    for side in (0, 1):
                        paths[side].append([*(s[side].decode() for s in own), *above[side]])
                ranks = pa.array([x["rank"] for x in nodes], pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(nodes), pa.int64()), ranks, *(pa.array(p, pa.list_(pa.string())) for p in paths)], names=["g", "rank", "lefts", "rights"])

    return blocks.mapInArrow(lean(lead), "g long, rank long, lefts array<string>, rights array<string>")


def _with_paths(blocks: DataFrame, paths: DataFrame) -> DataFrame:
    """The blocks with the paths of the nodes that they reduce to."""
    return blocks.join(paths.withColumnsRenamed({"rank": "block"}), ["g", "block"])


def _tiers(blocks: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """The blocks of every tier above, lowest first, and the last nodes: one a group."""
    found: list[DataFrame] = []
    nodes = staged(_reduced(blocks), "tree-tier")
    while nodes.where("n > 1").limit(1).count():
        found.append(staged(_blocks(nodes), "tree-blocks"))
        nodes = staged(_reduced(found[-1]), "tree-tier")
    return found, nodes


def _paths_down(tiers: list[DataFrame], tops: DataFrame) -> DataFrame:
    """The paths of the nodes of the lowest tier; `tops` are those of the last nodes."""
    for blocks in reversed(tiers):
        tops = staged(_led(_with_paths(blocks, tops)), "tree-paths")
    return tops


_PROVED = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean"


def prove(leaves: DataFrame) -> DataFrame:
    """Per row (g group, doc_id, leaf, claim): doc_id, leaf, subroot, root, proof_sha256, folded_root and verified.

    `claim` is the leaf that is said to stand there, null where it is the leaf itself; folded_root is the root that it makes. A group's
    leaves ascend by doc_id, null ones first, and equal ids by their leaves; groups are in order of their bytes, null first. proof_sha256 is the hash of all
    siblings on the way up. An empty table gives no rows.
    """
    order = [F.asc_nulls_first("doc_id"), F.asc("leaf")]
    ranked = numbered(leaves, "g", order)
    sources = staged(ranked.groupBy(F.col("g").alias("source")).agg(F.first("n").alias("size")), "tree-groups")
    groups = staged(numbered(sources.withColumn("one", F.lit(0)), "one", [F.asc_nulls_first("source")]).select("source", F.col("rank").alias("g"), F.col("n").alias("groups")), "tree-group-numbers")
    coded = ranked.withColumnRenamed("g", "named").join(groups, F.col("named").eqNullSafe(F.col("source"))).select("g", "rank", "n", F.col("leaf").alias("digest"), "doc_id", "claim")
    blocks = staged(_blocks(coded, "doc_id", "claim"), "leaf-blocks")
    tiers, subroots = _tiers(blocks)

    # The groups' roots are the leaves of one more tree, group 0 of its tiers.
    upper = subroots.select("digest", "g").join(groups, "g").select(F.lit(0).cast("long").alias("g"), F.col("g").alias("rank"), F.col("groups").alias("n"), "digest")
    upper_blocks = staged(_blocks(upper), "tree-blocks")
    upper_tiers, last = _tiers(upper_blocks)
    top = last.first()  # the root alone
    root = None if top is None else top["digest"]
    none = F.array().cast("array<string>")
    above = _paths_down([upper_blocks, *upper_tiers], last.select("g", "rank", none.alias("lefts"), none.alias("rights")))
    paths = _paths_down(tiers, above.select(F.col("rank").alias("g"), F.lit(0).cast("long").alias("rank"), "lefts", "rights"))
    whole = _with_paths(blocks, paths).join(subroots.select("g", F.col("digest").alias("subroot")), "g")

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, nodes, lefts, rights, subroot in zip(*(batch[c].to_pylist() for c in ("n", "nodes", "lefts", "rights", "subroot"))):
                hashes = [x["digest"].encode() for x in nodes]
                levels, path = subtree(hashes, levels_of(n)), [Step(left.encode(), right.encode()) for left, right in zip(lefts, rights)]
                upper_siblings = b"".join(chain.from_iterable((s.left, s.right) for s in path))
                proofs, folded = [], []
                for i, node in enumerate(nodes):
                    proof, at = hashlib.sha256(), hashes[i] if node["claim"] is None else node["claim"].encode()
                    for k, parents in enumerate(levels):
                        parent, slot = parents[i // FANOUT ** (k + 1)], i // FANOUT**k % FANOUT
                        for side in parent.siblings(slot):
                            proof.update(side)
                        at = parent.folded(slot, at)
                    proof.update(upper_siblings)
                    for step in path:
                        at = step.folded(at)
                    proofs.append(proof.hexdigest())
                    folded.append(at.decode())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([x["doc_id"] for x in nodes], pa.int64()), pa.array([x["digest"] for x in nodes], pa.string()), pa.array([subroot] * len(nodes), pa.string()),
                        pa.array([root] * len(nodes), pa.string()), pa.array(proofs, pa.string()), pa.array(folded, pa.string()), pa.array([f == root for f in folded], pa.bool_()),
                    ],
                    names=[f.split()[0] for f in _PROVED.split(", ")],
                )

    return whole.select("n", "nodes", "lefts", "rights", "subroot").mapInArrow(lean(judge), _PROVED)


def document_manifest(docs: DataFrame, tampered: Column) -> DataFrame:
    """The manifest of a documents table, a tree per source, held against a copy in which the rows of `tampered` have a text with A-Z in lower case.

    A leaf is the hash of doc_id, source, lang, n_chars and text. Null fields are `-`, null texts can't be tampered with, a null source is a group of its own;
    a null `tampered` is false; rows that repeat a doc_id are leaves each; an empty table gives no rows. Further columns are ignored. See prove.
    """
    fields = lambda text: (field_text(F.col("doc_id"), False), *(field_text(F.col(c), c != "n_chars") for c in ("source", "lang", "n_chars")), field_text(text, True))
    lower = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    leaves = docs.select(F.col("source").alias("g"), F.col("doc_id").cast("long").alias("doc_id"), leaf_hash(*fields(F.col("text"))).alias("leaf"), F.when(tampered, leaf_hash(*fields(lower))).alias("claim"))
    return prove(staged(leaves, "leaves"))
