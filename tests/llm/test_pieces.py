import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from emberline.llm import piece_encoding, queries
from emberline.llm.piece_encoding import PieceEncoder, decode_pieces, encode_pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
LIBRARY = SentencePieceProcessor(model_file=PATH)
ENCODER = PieceEncoder(PATH)


def encoded(code, texts, end=None):
    return [ids[a:b].tolist() for ids, bounds in code.encode(pa.array(texts, pa.string()), end) for a, b in zip(bounds, bounds[1:])]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet="  ▁the inga\n\t.é中\x00<s>", max_size=80)), max_size=6))
def test_marked_words_encode_like_whole_texts(texts):
    assert encoded(ENCODER, texts) == LIBRARY.encode(texts)


def test_slices_and_table_do_not_show(monkeypatch):
    rng = random.Random(5)
    texts = [None, "", " ", "x" * 5000, " " * 700, *(" ".join("".join(rng.choice("abcé▁,") for _ in range(rng.randint(0, 9))) for _ in range(rng.randint(0, 80))) for _ in range(200)), "a ", " a"]
    monkeypatch.setattr(piece_encoding, "SLICE_BYTES", 1500)
    monkeypatch.setattr(piece_encoding, "TABLE_BYTES", 20_000)
    own = PieceEncoder(PATH)
    assert encoded(own, texts, 2) == [[*LIBRARY.encode(text or ""), 2] for text in texts]
    assert own.held < 200_000


@pytest.mark.parametrize("text", ["word " * 1_000_000, "line of text\n" * 400_000, "x" * 1_000_000])
def test_very_long_texts(text):
    assert encoded(ENCODER, [text])[0] == LIBRARY.encode(text)


def test_models_that_do_not_fit_are_refused(monkeypatch):
    monkeypatch.setattr(SentencePieceProcessor, "id_to_piece", lambda self, ids: [*(["x"] * (len(ids) - 1)), "of▁the"])
    with pytest.raises(ValueError):
        PieceEncoder(PATH)


def test_frames(documents, no_documents, monkeypatch):
    monkeypatch.setattr(piece_encoding, "SLICE_IDS", 500)
    more = documents.withColumnRenamed("n", "IDs")
    made = encode_pieces(more, PATH)
    assert made.columns == ["doc_id", "lang", "source", "n_chars", "score", "ids"]
    found = sorted(map(repr, ((r["doc_id"], r["ids"], r["text"]) for r in decode_pieces(made, PATH).collect())))
    want = [(r["doc_id"], [*LIBRARY.encode(r["text"] or ""), 2]) for r in documents.collect()]
    assert found == sorted(repr((d, ids, LIBRARY.decode(ids))) for d, ids in want)
    assert encode_pieces(documents, PATH, end=False).where("ids = array()").count() == sum(not r["text"] for r in documents.collect())
    nothing = documents.sparkSession.createDataFrame([(1, None), (2, [])], "k int, ids array<int>")
    assert sorted(map(tuple, decode_pieces(nothing, PATH).select("k", "text").collect())) == [(1, None), (2, "")]
    assert encode_pieces(no_documents, PATH).count() == 0


def test_query(spark):
    folder = "/root/testdata/sf0.001"
    hexed = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for r in spark.read.parquet(f"{folder}/documents.parquet").collect():
        ids = [*LIBRARY.encode(r["text"] or ""), LIBRARY.eos_id()]
        want.append((r["doc_id"], len(ids), hexed(" ".join(map(str, ids))), hexed(LIBRARY.decode(ids))))
    assert sorted(map(tuple, queries.op11_sentencepiece(spark, folder).collect())) == sorted(want)
