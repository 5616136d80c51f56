"""Line dedup by content-defined chunks of lines.

A chunk starts at every line that isn't blank and ends where it holds MIN_LINES such lines and `min_chars` of
their characters; where short lines follow each other, another ends at every line and starts where it is as
full. So each line of a repeated passage that is long enough for a chunk lies in a chunk inside the passage,
wherever the passage stands. Chunks that occur more than once in the corpus are compared byte by byte; the
first occurrence stays and the lines of the others go. Everything is a Spark SQL expression.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import hash_filter, lacks, may_hold, staged, unused

#: Solid lines to a chunk at least.
MIN_LINES = 2


def _filled(sizes: str, min_chars: int) -> str:
    """How many of the sizes fill a chunk, 0 if all don't."""
    full = f"s.n >= {MIN_LINES} AND s.chars >= {min_chars}"
    return f"aggregate({sizes}, named_struct('n', 0, 'chars', 0), (s, x) -> IF({full}, s, named_struct('n', s.n + 1, 'chars', s.chars + x)), s -> IF({full}, s.n, 0))"


#: A span of lines as one number, first << 32 | stop: arrays of numbers are made distinct by hash, those of structs by comparing all pairs.
_SPAN = "(shiftleft(cast({first} AS bigint), 32) | cast({stop} AS bigint))"


def _spans(min_chars: int) -> dict[str, str]:
    """SQL of the chunks' first lines and the lines after them, by name. A solid line has a character at least, so `min_chars` lines
    fill any chunk. Two lines that do are found without the search; where any two do, those that follow each other are the chunks."""
    found = {"lines": "lines", "solid": r"filter(sequence(0, size(lines) - 1), i -> lines[i] RLIKE '\\S')"}
    if min_chars <= MIN_LINES == 2:
        found["spans"] = f"if(size(solid) < 2, cast(array() AS array<bigint>), transform(sequence(0, size(solid) - 2), i -> {_SPAN.format(first='solid[i]', stop='(solid[i + 1] + 1)')}))"
    else:
        most = max(min_chars, MIN_LINES)
        ahead = f"IF(i + 1 < size(sizes) AND x + get(sizes, i + 1) >= {min_chars}, {MIN_LINES}, {_filled(f'slice(sizes, i + 1, {most})', min_chars)})"
        back = f"IF(i = 0 OR x + get(sizes, i - 1) >= {min_chars}, 0, {_filled(f'reverse(slice(sizes, greatest(i - {most - 2}, 1), least(i + 1, {most})))', min_chars)})"
        found |= {
            "sizes": "transform(solid, i -> length(lines[i]))",
            "ahead": f"transform(sizes, (x, i) -> named_struct('at', i, 'n', {ahead}))",
            "back": f"transform(sizes, (x, i) -> {back})",
            "spans": "array_distinct(concat("
            f"transform(filter(ahead, s -> s.n > 0), s -> {_SPAN.format(first='solid[s.at]', stop='(solid[s.at + s.n - 1] + 1)')}),"
            f"transform(filter(transform(back, (n, i) -> named_struct('at', i, 'n', n)), s -> s.n > 0), s -> {_SPAN.format(first='solid[s.at - s.n + 1]', stop='(solid[s.at] + 1)')})))",
        }
    return found | {"hashes": "transform(lines, x -> xxhash64(x))"}


#: SQL of a chunk's hash, from those of its lines.
CHUNK_HASH = "xxhash64(slice(hashes, p.first + 1, p.n))"


def _chunks(with_text: bool) -> str:
    """SQL of the chunks; their bytes are cut here, so that no row of a chunk needs the text's other lines. Lines hold no line feed, so equal bytes mean equal lines."""
    first, n = "cast(shiftright(s, 32) AS int)", "cast((s & 4294967295L) - shiftright(s, 32) AS int)"
    text = ", 'chunk', array_join(slice(lines, p.first + 1, p.n), '\\n')" if with_text else ""
    placed = f"transform(spans, s -> named_struct('first', {first}, 'n', {n}))"
    return f"transform({placed}, p -> named_struct('first', p.first, 'n', p.n, 'hash', {CHUNK_HASH}{text}))"


def _let(name: str, value: str, body: str) -> str:
    """`body` with `name` for a value that is computed once, whatever lambda in it uses the name."""
    return f"transform(array({value}), {name} -> {body})[0]"


def _occurrences(docs: DataFrame, min_chars: int, with_text: bool = False) -> DataFrame:
    """A row per chunk (doc_id, text_hash, first line from 0, n lines, hash, and its bytes as chunk); text_hash tells apart rows of one doc_id."""
    chunks = _chunks(with_text)
    for name, value in reversed(_spans(min_chars).items()):
        chunks = _let(name, value, chunks)
    split = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.split(F.coalesce(F.col("text"), F.lit("")), "\n").alias("lines"))
    rows = split.select("doc_id", "text_hash", F.explode(F.expr(chunks)).alias("c"))
    return rows.select("doc_id", "text_hash", "c.*")


def _recurring(docs: DataFrame, min_chars: int) -> DataFrame:
    """A filter of the hashes of chunks that occur more than once; hashes and counts alone are shuffled."""
    counted = _occurrences(docs, min_chars).groupBy("hash").agg(F.count("*").alias("times")).where("times > 1")
    return hash_filter(counted, "hash", "recurring-chunks")


def _place() -> Column:
    return F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text_hash", "first")


def repeated_chunks(chunks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Of occurrences with their bytes, the chunks that occur more than once: (hash, keeper) where all bytes agree, and (hash, chunk, keeper)
    for the chunks of those hashes under which different bytes met.

    The keeper is the least place (doc_id, text_hash, first line), null doc_ids first. Counts, places and the distinct bytes are
    combined before the shuffle, so no group of copies meets in one task and a task sends the bytes of a chunk once.
    """
    counted = chunks.groupBy("hash").agg(F.count("*").alias("times"), F.min(_place()).alias("keeper"), F.collect_set("chunk").alias("bytes")).where("times > 1")
    repeated = staged(counted.select("hash", "keeper", (F.size("bytes") == 1).alias("agree")), "repeated-chunks")
    clashes = repeated.where(~F.col("agree")).select("hash")
    clashing = chunks.join(clashes, "hash", "left_semi").groupBy("hash", "chunk").agg(F.count("*").alias("times"), F.min(_place()).alias("keeper")).where("times > 1").drop("times")
    return repeated.where("agree").drop("agree"), clashing if not clashes.isEmpty() else clashing.limit(0)


def dedup_lines(docs: DataFrame, min_chars: int = 0, counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All columns of `docs` with text rid of repeated chunks, and n_lines, n_removed, or by the names in `counts`.

    A null text stays null with no lines, an empty one has one empty line. A text loses the lines of chunks that
    stand at an earlier place too. The first place of a line in the corpus is the first of every chunk it lies in
    there, so each lost line stays there. A text that loses all its solid lines becomes ''. Rows that repeat doc_id
    and text are one document to the comparison and get the same result; an empty table gives no rows. Columns of these names are
    replaced, others stay as they are, whatever their names. Only documents that lose lines, and few others, are shuffled.
    """
    kept = [c for c in docs.columns if c not in counts]
    cells = _recurring(docs, min_chars)
    # The bytes are cut and combined once; written out they would take more than the corpus where lines recur, so the places are hashed again.
    with_bytes, chunks = (may_hold(_occurrences(docs, min_chars, with_text), cells, "hash") for with_text in (True, False))
    agreed, clashing = repeated_chunks(with_bytes)
    places = ["doc_id", "text_hash", "first", "n"]
    other = ~_place().eqNullSafe(F.col("keeper"))
    removed = chunks.join(agreed, "hash").where(other).select(*places)
    if not clashing.isEmpty():
        removed = removed.unionByName(with_bytes.join(clashing, ["hash", "chunk"]).where(other).select(*places))
    per_doc = removed.groupBy("doc_id", "text_hash").agg(F.collect_set(F.struct("first", "n")).alias("gone"))
    gone_id, gone_hash, spans, own, lines, gone, stays, solid = unused(docs.columns, "gone_id", "gone_hash", "spans", "own_hash", "lines", "gone", "stays", "solid")
    found = staged(per_doc.select("doc_id", "text_hash", "gone").toDF(gone_id, gone_hash, spans), "removed-chunks")
    losing = hash_filter(found, gone_hash, "losing-documents")

    hashed = docs.select(*kept).withColumn(own, F.xxhash64("text"))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.size(F.split("text", "\n")))
    untouched = lacks(hashed, losing, own).select(*kept, n_lines.alias(counts[0]), F.lit(0).alias(counts[1]))

    joined = may_hold(hashed, losing, own).join(found, F.col("doc_id").eqNullSafe(F.col(gone_id)) & (F.col(own) == F.col(gone_hash)), "left")
    split = joined.withColumn(lines, F.split("text", "\n"))
    marked = split.withColumn(gone, F.expr(f"array_distinct(flatten(transform({spans}, g -> sequence(g.first, g.first + g.n - 1))))"))
    marked = marked.withColumn(stays, F.expr(f"transform(array_except(sequence(0, size({lines}) - 1), {gone}), i -> {lines}[i])"))
    marked = marked.withColumn(solid, F.expr(f"exists({stays}, x -> x RLIKE '\\\\S')"))
    text = F.when(F.col(spans).isNull(), F.col("text")).when(F.col(solid), F.array_join(stays, "\n")).otherwise("").alias("text")
    touched = marked.select(
        *[text if c == "text" else F.col(c) for c in kept],
        n_lines.alias(counts[0]),
        F.when(F.col(spans).isNull(), 0).when(F.col(solid), F.size(gone)).otherwise(F.size(lines)).alias(counts[1]),
    )
    return untouched.unionByName(touched)
