import random
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from brute import components
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from emberline.llm.decontaminate import find_leaks
from emberline.llm.language_id import identify, learn_prototypes
from emberline.llm.line_dedup import dedup_lines

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    from emberline.llm.shared import staged

    tables = [spark.read.parquet(f"{SF}/documents.parquet")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(staged(stage(spark, tables[-1], SF), f"test-{name}"))
    return tables


def test_columns(stages):
    assert all(t.columns == stages[0].columns for t in stages[:-1])


def test_each_stage_does_what_its_operator_decides(spark, stages):
    rows = [{r["doc_id"]: r for r in t.collect()} for t in stages[:-1]]
    judged = {r["doc_id"]: r for r in identify(stages[0], learn_prototypes(stages[0])).collect()}
    letters = lambda text: sum(c.isalpha() for c in text)
    assert set(rows[1]) == {d for d, r in judged.items() if r["lang_pred"] != "und" and (r["score"] >= 0.12 or letters(r["text"]) < 20)}
    assert all(letters(r["text"]) == 0 for d, r in judged.items() if d not in rows[1])  # the table holds no other language
    lines = {r["doc_id"]: r["text"] for r in dedup_lines(stages[1]).collect()}
    assert {d: r["text"] for d, r in rows[2].items()} == {d: t for d, t in lines.items() if t == rows[1][d]["text"] or t.strip()}
    assert all(r["n_chars"] == len(r["text"]) for r in rows[2].values())
    found = components([(d, r["text"]) for d, r in rows[2].items()], 5, 80)
    assert set(rows[3]) == {d for d, _, c in found if d == c} and all(rows[3][d] == rows[2][d] for d in rows[3])
    leaked = {r["doc_id"] for r in find_leaks(stages[3], spark.read.parquet(f"{SF}/benchmark.parquet")).collect()}
    assert set(rows[4]) == set(rows[3]) - leaked and leaked
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    packed = stages[5].collect()
    lengths = {d: len(tokenizer.encode(r["text"], add_special_tokens=False).ids) + 1 for d, r in rows[4].items()}
    assert {d: sum(p["length"] for p in packed if p["doc_id"] == d) for d in lengths} == lengths and {p["doc_id"] for p in packed} == set(lengths)
    used = np.zeros(1 + max(p["sequence_id"] for p in packed), int)
    for p in packed:
        used[p["sequence_id"]] += p["length"]
    assert used.max() <= 4096 and np.count_nonzero(used) <= -(-sum(lengths.values()) // 4096) + 1


def test_run_equals_its_stages(spark, stages):
    found = __spark_entry__.queries()["pipeline"](spark, SF)
    count = lambda df: sorted(map(tuple, df.select("doc_id", "piece", "start", "length", "ids_crc32").collect()))
    assert count(found) == count(stages[5])


def test_every_operator_is_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_unlearned_languages_go_and_short_texts_stay(spark):
    rng = random.Random(6)
    odd = ["абвгдежзийклмнопрстуфхцчшщыэюя", "αβγδεζηθικλμνξοπρστυφχψω", "אבגדהוזחטיכלמנסעפצקרשת"]
    texts = [" ".join("".join(rng.choice(letters) for _ in range(rng.randint(3, 9))) for _ in range(n)) for letters in odd for n in (5, 30, 300) for _ in range(20)]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    short = [(20_000 + i, t) for i, t in enumerate(["Of the.", "x", "el es", "123", ""])]
    more = spark.createDataFrame([(10_000 + i, t) for i, t in enumerate(texts)] + short, "doc_id long, text string")
    kept = {r["doc_id"] for r in corpus_pipeline.known_language(spark, docs.unionByName(more, allowMissingColumns=True), SF).select("doc_id").collect()}
    assert len([d for d in kept if 10_000 <= d < 20_000]) <= len(texts) // 50
    assert {d for d in kept if d >= 20_000} == {20_000, 20_001, 20_002}


def test_stages_on_awkward_rows(spark, documents, no_documents, tmp_path):
    names = ["lang_pred", "n_removed", "n_lines", "kept_id", "leaked", "gone", "hash", "item_id"]
    docs = documents.withColumns({n: F.concat(F.lit(n), F.coalesce(F.col("doc_id").cast("string"), F.lit("?"))) for n in names})
    spark.createDataFrame([(1, "nowhere to be found are these few words"), (None, None)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        found = stage(spark, docs, str(tmp_path))
        assert found.columns == docs.columns, name
        rows = found.collect()
        assert rows and all(r[n] == n + ("?" if r["doc_id"] is None else str(r["doc_id"])) for r in rows for n in names)
        assert stage(spark, no_documents, str(tmp_path)).count() == 0
        whole = [(r["doc_id"], r["text"]) for r in documents.collect()]
        if name == "language":
            assert Counter((r["doc_id"], r["text"]) for r in rows) == Counter((d, t) for d, t in whole if any(c.isalpha() for c in t or ""))
        if name == "decontamination":
            assert len(rows) == len(whole)
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path))
    assert Counter(r["doc_id"] for r in pieces.where("start = 0").collect()) == Counter(d for d, _ in whole)
    unlabelled = corpus_pipeline.known_language(spark, docs.withColumn("lang", F.lit(None).cast("string")), str(tmp_path))
    assert unlabelled.count() == sum(any(c.isalpha() for c in t or "") for _, t in whole)
