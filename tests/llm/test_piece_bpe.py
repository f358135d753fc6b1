import hashlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import SentencePieceProcessor

from tests.llm.conftest import ODD_TEXTS, TOKENIZERS
from tidepane.llm import piece_bpe
from tidepane.llm.queries import QUERIES

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"
LIBRARY = SentencePieceProcessor(model_file=MODEL)


def ids_of(texts):
    ids, counts = piece_bpe.load(MODEL).encode(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def expected(texts):
    return LIBRARY.encode(texts, add_bos=True, add_eos=True, num_threads=1)


def test_same_ids_as_the_library():
    texts = [t or "" for t in ODD_TEXTS] + ["▁", " ▁ x", " " * 77 + "t", "ab" * 4000, "é" * 900, "日" * 500 + "☃" * 50, "<s>a</s>"]
    assert ids_of(texts) == expected(texts)


@given(st.lists(st.text(st.sampled_from("abeinrthLZ's09  \t\n!-日é☃▁�\x00"), max_size=40), min_size=1, max_size=5))
@settings(max_examples=200, deadline=None)
def test_same_ids_on_any_text(texts):
    assert ids_of(texts) == expected(texts)


@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 31999), st.sampled_from([0, 1, 2, 259, 28705, 35, 229, 153, 132])), max_size=8))
@settings(max_examples=200, deadline=None)
def test_any_ids_decode_like_the_library(ids):
    got = piece_bpe.load(MODEL).decode(np.array(ids, np.uint32), np.array([len(ids)]))
    assert got.to_pylist() == [LIBRARY.decode(ids)]


def test_few_remembered_pairs_change_nothing(monkeypatch, small_texts):
    texts = [t for t in small_texts[:40]]
    monkeypatch.setattr(piece_bpe, "PAIRS", 3)
    model = piece_bpe.PieceBpe(MODEL)
    ids, _ = model.encode(pa.array(texts))
    assert ids.tolist() == [i for part in expected(texts) for i in part]
    assert len(model.agree) <= 3


def test_longest_pieces_are_not_always_taken():
    model = piece_bpe.load(MODEL)
    words = ["hethe", "therein", "inginer", "andthest", "onlythe", "reentering"]
    others = 0
    for word in words:
        text, longest, at = " " + word, [], 0
        while at < len(text):
            longest.append(next(t for to in range(len(text), at, -1) if (t := model.automaton.get(text[at:to], -1)) >= 0))
            at += model.size[longest[-1]]
        got = model.pieces(text)
        assert [1, *got, 2] == expected([word])[0]
        others += got != longest
    assert others


def test_texts_are_cut_anywhere(small_texts):
    """Cuts at blanks and whole texts give the same ids."""
    model = piece_bpe.PieceBpe(MODEL)
    model.cut_at_blanks = False
    texts = pa.array(small_texts[:30])
    assert model.encode(texts)[0].tolist() == piece_bpe.load(MODEL).encode(texts)[0].tolist()


def test_query(spark, small_texts):
    got = {r.doc_id: r for r in QUERIES["op11_piece_round_trip"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(small_texts)
    for doc_id, (text, ids) in enumerate(zip(small_texts, expected([t or "" for t in small_texts]))):
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids).encode()).hexdigest()


def test_columns(spark, make_docs):
    docs = make_docs(ODD_TEXTS, both=["x"] * len(ODD_TEXTS))
    rows = docs.select("*", piece_bpe.encode("text", MODEL).alias("coded")).withColumn("decoded", piece_bpe.decode("coded", MODEL)).orderBy("doc_id").collect()
    for row, ids in zip(rows, expected([t or "" for t in ODD_TEXTS])):
        assert row.coded == ids and row.decoded == LIBRARY.decode(ids) and row.both == "x"
    assert docs.limit(0).select(piece_bpe.round_trip("text", MODEL)).count() == 0
    assert spark.sql("select cast(null as array<int>) as ids").select(piece_bpe.decode("ids", MODEL).alias("t")).collect()[0].t == ""


def test_other_models_are_refused(tmp_path):
    path = tmp_path / "other.model"
    path.write_bytes(b"\x12\x02\x18\x01\x1a\x02\x18\x01")
    with pytest.raises(ValueError):
        piece_bpe.PieceBpe(str(path))
