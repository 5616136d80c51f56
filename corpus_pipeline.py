"""A corpus pipeline: each stage works on what its predecessor kept, written and read again as Parquet.

Every stage but the last returns the columns it was given, whatever their names, and an empty table for an empty one. Rows that
share a doc_id are documents of their own, and a null doc_id is one like others, except where a stage says so.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from emberline.llm.decontaminate import drop_leaks
from emberline.llm.jaccard_join import drop_near_duplicates
from emberline.llm.language_id import identify, learn_prototypes
from emberline.llm.line_dedup import dedup_lines
from emberline.llm.packing import pack_documents
from emberline.llm.shared import staged, unused
from emberline.shipping import ship

#: Texts less like every learned language than this are rejected: the cosines of unrelated texts spread by 1 / sqrt(1024) = 0.03 about 0.
LEAST_SCORE = 0.12
#: Texts of fewer letters are too short to be told from noise and stay.
LEAST_LETTERS = 20


def known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in no learned language.

    Null and empty texts and those without a letter go, short ones with a letter stay. Languages are learned from the rows with a
    text and a lang; if there are none, nothing is known and only texts without letters go. Repeated rows are judged alike.
    """
    ship(spark)
    prototypes = learn_prototypes(docs)
    predicted, score = unused(docs.columns, "lang_pred", "score")
    judged = identify(docs, prototypes, columns=(predicted, score))
    letters = F.char_length(F.regexp_replace(F.coalesce(F.col("text"), F.lit("")), r"\P{L}", ""))
    if not prototypes:
        return docs.where(letters > 0)
    return judged.where((F.col(predicted) != "und") & ((F.col(score) >= LEAST_SCORE) | (letters < LEAST_LETTERS))).select(*docs.columns)


def without_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts chunks of lines that stand at an earlier place too, in the order of doc_ids, null ones first; documents of which nothing is left go.

    Null and empty texts lose nothing and stay. Rows that repeat doc_id and text keep or lose the same lines. A column n_chars is counted anew.
    """
    ship(spark)
    lines, removed = unused(docs.columns, "n_lines", "n_removed")
    cleaned = dedup_lines(docs, counts=(lines, removed)).where((F.col(removed) == 0) | (F.trim("text") != ""))
    return cleaned.select(*[F.char_length("text").cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def without_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document of the smallest doc_id of every group of near duplicates: five-word shingles, Jaccard similarity 0.8.

    Repeated rows are copies, one of which stays; a null doc_id stays only where no document of the group has one. Null, empty
    and blank texts are near no other and stay, one of each doc_id and text.
    """
    ship(spark)
    return drop_near_duplicates(docs, size=5, percent=80)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or its template.

    Null and empty texts stay. Rows that share a doc_id are judged together and go together, null ids too. Items of a null text count for nothing.
    """
    ship(spark)
    return drop_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs the documents' tokens into sequences of 4096: a row per piece in place of the documents' columns.

    A null or empty text is its end token; repeated rows are packed each.
    """
    ship(spark)
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", known_language),
    ("line-dedup", without_repeated_lines),
    ("near-duplicates", without_near_duplicates),
    ("decontamination", without_benchmark),
    ("packing", packed),
]

#: Learned language profiles and a tokenizer's ids are beyond SQL; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
