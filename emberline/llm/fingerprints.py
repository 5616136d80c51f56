"""Document fingerprints as invertible Bloom lookup sketches of paragraph digests.

A paragraph is a line; a longer line is cut at sentence ends or, for want of them, after MOST words. A sketch has three
subtables of cells, each with a count, the exclusive or of the digests that fall there, and that of
their checksums. Subtracting one text's sketch from another's cancels the shared paragraphs;
peeling cells that hold a single digest recovers the others.

A fingerprint deals a text's digests by their first bits to blocks of BLOCK or fewer on average and holds a sketch for each, so it
grows with the text. Cells add up: two blocks' cells are those of the block they came from, so
the finer of two fingerprints folds to the grain of the other. Where peeling a block gets stuck, larger sketches of its digests
are made and subtracted. Everything is a Spark SQL expression.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import partitions

#: Words to a piece of a long line at least and at most; digests to a block about; cells of a first subtable.
LEAST, MOST, BLOCK, CELLS = 24, 40, 8, 8
#: Rounds of peeling, and sketch sizes tried, each double the one before.
ROUNDS, SIZES = 10, 7
#: Ranges of doc_id per shuffle partition at least; rows to a range about; ranges at most (their bounds are one literal).
RANGES, RANGE_ROWS, MOST_RANGES = 8, 2_000, 16_384


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` standing for `value`, computed once."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _check(digest: str) -> str:
    """32 bits that tell a digest from an exclusive or of several."""
    return f"shiftrightunsigned(xxhash64({digest}, -1), 32)"


def _places(digest: str, size: str, cells: str) -> str:
    """The digest's cell in each of the three subtables."""
    return "array(" + ", ".join(f"{j} * {cells} + pmod(xxhash64({digest}, {size}, {j}), {cells})" for j in range(3)) + ")"


_WORD = r"\\S++[ \\t]*+"
_PIECE = rf"(?:{_WORD}){{1,{LEAST}}}+(?:(?:(?!\\S*[.!?](?!\\S)){_WORD}){{0,{MOST - LEAST - 1}}}(?:{_WORD}))?"


def paragraph_digests(text: str) -> str:
    """The distinct digests of a text's paragraphs."""
    return f"array_distinct(transform(regexp_extract_all({text}, '{_PIECE}', 0), x -> xxhash64(x)))"


def sketch(digests: str, size: str, cells: str) -> str:
    """Cells (n, k, h): how many digests, their exclusive or, and that of their checksums."""
    entries = f"transform({digests}, d -> named_struct('k', d, 'h', {_check('d')}, 'p', {_places('d', size, cells)}))"
    held = f"filter(es, e -> e.p[cast(c div {cells} AS int)] = c)"
    cell = "named_struct('n', size(f), 'k', aggregate(f, 0L, (a, e) -> a ^ e.k), 'h', aggregate(f, 0L, (a, e) -> a ^ e.h))"
    return _let("es", entries, f"transform(sequence(0L, 3 * {cells} - 1), c -> {_let('f', held, cell)})")


def subtract(a: str, b: str) -> str:
    return f"zip_with({a}, {b}, (x, y) -> named_struct('n', x.n - y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"


def peel(cells_array: str, size: str, cells: str) -> str:
    """The digests that a subtracted sketch holds, null if it can't be emptied."""
    pure = (
        f"array_distinct(transform(filter(s.cells, c -> abs(c.n) = 1 AND c.h = {_check('c.k')}),"
        f" c -> named_struct('n', c.n, 'k', c.k, 'h', c.h, 'p', {_places('c.k', size, cells)})))"
    )
    taken = (
        f"transform(s.cells, (c, i) -> aggregate(filter(pure, e -> e.p[cast(i div {cells} AS int)] = i), c,"
        " (a, e) -> named_struct('n', a.n - e.n, 'k', a.k ^ e.k, 'h', a.h ^ e.h)))"
    )
    step = _let("pure", pure, f"if(size(pure) = 0, s, named_struct('cells', {taken}, 'found', concat(s.found, transform(pure, e -> e.k))))")
    done = "if(forall(s.cells, c -> c.n = 0 AND c.k = 0L AND c.h = 0L), s.found, cast(NULL AS array<bigint>))"
    start = f"named_struct('cells', {cells_array}, 'found', cast(array() AS array<bigint>))"
    return f"aggregate(sequence(1, {ROUNDS}), {start}, (s, r) -> {step}, s -> {done})"


def _blocks(digests: str, levels: str, shift: str) -> str:
    """The digests in 2 ** levels blocks, in order of their bits: at level lv that at `shift`."""
    split = ", ".join(f"filter(blk, d -> (shiftrightunsigned(d, {shift}) & 1L) = {bit}L)" for bit in (0, 1))
    return f"if({levels} = 0, array({digests}), aggregate(sequence(1, {levels}), array({digests}), (bs, lv) -> flatten(transform(bs, blk -> array({split})))))"


def _levels(count: str) -> str:
    return f"cast(greatest(0, ceil(log2(greatest(1, {count}) / {BLOCK}))) AS int)"


def _larger(a: str, b: str) -> str:
    """The digests that are in one of two arrays only, by sketches of smaller blocks, of more cells where those fail."""
    cells = f"shiftleft({CELLS}L, lvl)"
    attempt = _let("m", cells, peel(subtract(sketch("ba", "lvl", "m"), sketch("bb", "lvl", "m")), "lvl", "m"))
    tries = f"aggregate(sequence(0, {SIZES - 1}), cast(NULL AS array<bigint>), (got, lvl) -> if(got IS NOT NULL, got, {attempt}))"
    exact = "concat(array_except(ba, bb), array_except(bb, ba))"  # two digests that share all cells at every size
    return _let("nl", _levels(f"size({a}) + size({b})"), f"flatten(zip_with({_blocks(a, 'nl', 'lv - 1')}, {_blocks(b, 'nl', 'lv - 1')}, (ba, bb) -> coalesce({tries}, {exact})))")


def fingerprint(digests: str) -> str:
    """struct(size: the number of digests, level, blocks: a sketch for each of 2 ** level blocks)."""
    blocks = f"transform({_blocks(digests, 'fl', '64 - lv')}, blk -> {sketch('blk', '0', f'{CELLS}L')})"
    return _let("fl", _levels(f"size({digests})"), f"named_struct('size', size({digests}), 'level', fl, 'blocks', {blocks})")


def _folded(fp: str, level: str) -> str:
    """The blocks of a fingerprint at a coarser level."""
    add = "zip_with(bs[2 * i], bs[2 * i + 1], (x, y) -> named_struct('n', x.n + y.n, 'k', x.k ^ y.k, 'h', x.h ^ y.h))"
    return f"if({fp}.level = {level}, {fp}.blocks, aggregate(sequence({level} + 1, {fp}.level), {fp}.blocks, (bs, lv) -> transform(sequence(0, size(bs) div 2 - 1), i -> {add})))"


def recover(fa: str, fb: str, a: str, b: str) -> str:
    """The digests that are in one of two texts only, from their fingerprints; only blocks that can't be peeled turn to the digests a and b."""
    block = lambda digests: f"if(cl = 0, {digests}, filter({digests}, d -> shiftrightunsigned(d, 64 - cl) = bi))"
    larger = _let("da", block(a), _let("db", block(b), _larger("da", "db")))
    found = f"coalesce({peel(subtract('xa', 'gb[bi]'), '0', f'{CELLS}L')}, {larger})"
    return _let("cl", f"least({fa}.level, {fb}.level)", _let("gb", _folded(fb, "cl"), f"flatten(transform({_folded(fa, 'cl')}, (xa, bi) -> {found}))"))


def likeness(fa: str, fb: str, differing: str) -> str:
    """Jaccard similarity of the paragraph sets, from their sizes and the number of differing digests."""
    both = f"({fa}.size + {fb}.size)"
    return f"if({both} = 0, 1.0D, cast({both} - size({differing}) AS double) / ({both} + size({differing})))"


def as_text(fp: str) -> str:
    """A fingerprint as text: size|level|blocks parted by `;`, cells by `,`, each count:digests:checksums in hexadecimal or empty."""
    cell = "if(c.n = 0, '', concat(c.n, ':', lower(hex(c.k)), ':', lower(hex(c.h))))"
    return f"concat({fp}.size, '|', {fp}.level, '|', array_join(transform({fp}.blocks, b -> array_join(transform(b, c -> {cell}), ',')), ';'))"


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """Adds next, a struct of the `columns` of the document that follows in ascending doc_id order.

    After the last comes the first; null doc_ids come first; rows that share a doc_id follow each other by
    text. The rows are dealt to ranges of doc_id. The ranges' bounds are ids of the table, and the
    rows at a bound also go to the range before, as its last; so one shuffle serves, and no
    range needs another's rows.
    """
    wanted = min(MOST_RANGES, max(RANGES * partitions(docs.sparkSession), docs.count() // RANGE_ROWS))
    shares = [i / wanted for i in range(1, wanted)]
    facts = docs.agg(
        F.percentile_approx("doc_id", shares, 20 * wanted).alias("bounds") if shares else F.lit(None).alias("bounds"),
        F.min("doc_id").alias("least"), F.count_if(F.col("doc_id").isNull()).alias("nulls"),
    ).first()
    bounds = sorted(set(facts["bounds"] or []))
    first = F.col("doc_id").isNull() if facts["nulls"] else F.col("doc_id") == F.lit(facts["least"])
    if bounds:
        steps = max(1, math.ceil(math.log2(len(bounds) + 1)))
        table = f"from_json('{bounds}', 'array<bigint>')"
        closer = f"if({table}[cast(mid AS int)] <= doc_id, named_struct('lo', mid + 1, 'hi', s.hi), named_struct('lo', s.lo, 'hi', mid))"
        halve = f"if(s.lo < s.hi, {_let('mid', '(s.lo + s.hi) div 2', closer)}, s)"
        below = f"aggregate(sequence(1, {steps}), named_struct('lo', 0L, 'hi', {len(bounds)}L), (s, i) -> {halve}, s -> s.lo)"
        place = F.when(F.col("doc_id").isNull(), F.lit(0).cast("long")).otherwise(F.expr(below))
        at_bound = F.expr(f"range_no > 0 AND {table}[cast(range_no - 1 AS int)] = doc_id")
    else:
        place, at_bound = F.lit(0).cast("long"), F.lit(False)
    copies = F.array_compact(
        F.array(
            F.struct(F.col("range_no").alias("r"), F.lit(False).alias("guest")),
            F.when(F.coalesce(at_bound, F.lit(False)), F.struct((F.col("range_no") - 1).alias("r"), F.lit(True).alias("guest"))),
            F.when(first, F.struct(F.lit(len(bounds)).cast("long").alias("r"), F.lit(True).alias("guest"))),
        )
    )
    dealt = docs.withColumn("range_no", place).withColumn("copy", F.explode(copies)).select(*docs.columns, "copy.*")
    order = Window.partitionBy("r").orderBy("guest", F.asc_nulls_first("doc_id"), "text")
    return dealt.withColumn("next", F.lead(F.struct(*columns)).over(order)).where(~F.col("guest")).drop("r", "guest")


def compare_versions(docs: DataFrame) -> DataFrame:
    """Fingerprints of every whole text and of its edited version, and their likenesses.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next document's. Null texts are empty; two empty texts are alike (1). Equal texts get
    equal fingerprints; rows that share a doc_id are documents of their own; a single row is
    its own next; an empty table gives no rows; further columns are ignored. Returns doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint, near_edited, near_next, and as differing_edited the digests by which the
    versions differ.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text"))
    own = texts.withColumn("digests", F.expr(paragraph_digests("text")))
    follows = with_next(own, ["text", "digests"])
    cut = follows.select(
        "doc_id", "digests", F.col("next.digests").alias("next_digests"), F.char_length("text").cast("long").alias("n_chars"),
        F.expr("concat(substring(text, 1, char_length(text) - char_length(text) div 2), substring(next.text, 1, cast(char_length(text) div 2 AS int)))").alias("edited"),
    )
    digested = cut.select(
        "doc_id", "n_chars", "digests", "next_digests", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), F.expr(paragraph_digests("edited")).alias("edited_digests")
    )
    printed = digested.select("*", *[F.expr(fingerprint(f"{name}digests")).alias(f"{name}print") for name in ("", "edited_", "next_")])
    compared = printed.select(
        "*", F.expr(recover("print", "edited_print", "digests", "edited_digests")).alias("differing_edited"), F.expr(recover("print", "next_print", "digests", "next_digests")).alias("differing_next")
    )
    return compared.select(
        "doc_id", "n_chars", "edited_sha256", F.expr(as_text("print")).alias("fingerprint"), F.expr(as_text("edited_print")).alias("edited_fingerprint"),
        F.expr(likeness("print", "edited_print", "differing_edited")).alias("near_edited"), F.expr(likeness("print", "next_print", "differing_next")).alias("near_next"), "differing_edited",
    )
