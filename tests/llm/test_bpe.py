import hashlib
import json

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_TEXTS, TOKENIZERS
from tidepane.llm import bpe, token_counts
from tidepane.llm.queries import QUERIES

WORD = f"{TOKENIZERS}/word_bpe_49k.json"
BYTE = f"{TOKENIZERS}/byte_bpe_50k.json"
LIBRARY = Tokenizer.from_file(WORD)


def ids_of(texts):
    ids, counts = bpe.load(WORD).encode(pa.array(texts, pa.string()))
    return [part.tolist() for part in np.split(ids, np.cumsum(counts)[:-1])]


def expected(texts):
    return [e.ids for e in LIBRARY.encode_batch(texts, add_special_tokens=False)]


def test_same_ids_as_the_library():
    texts = [t or "" for t in ODD_TEXTS] + ["abcab" * 500 + "!" * 900, "x " * 3000]
    assert ids_of(texts) == expected(texts)


@given(st.lists(st.text(st.sampled_from("abeLZé's0９ \t\n!?-日Σ\x1d"), max_size=30), min_size=1, max_size=5))
@settings(max_examples=150, deadline=None)
def test_same_ids_on_any_text(texts):
    assert ids_of(texts) == expected(texts)


def test_long_words_merge_like_short_ones(monkeypatch):
    texts = ["internationalisation", "aaaaabaaaab", "thethethethe"]
    usual = ids_of(texts)
    monkeypatch.setattr(bpe, "LONG_WORD", 2)
    assert ids_of(texts) == usual


def test_round_trip_query(spark, small_texts):
    got = {r.doc_id: r for r in QUERIES["op1_bpe_round_trip"](spark, "/root/testdata/sf0.001").collect()}
    for doc_id, (text, ids) in enumerate(zip(small_texts, expected(small_texts))):
        row = got[doc_id]
        assert row.n_tokens == len(ids)
        assert row.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert row.decoded_sha256 == hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_columns(spark, make_docs):
    docs = make_docs(ODD_TEXTS, both=["x"] * len(ODD_TEXTS))
    rows = docs.select("*", bpe.encode("text", WORD).alias("ids"), bpe.encode_packed("text", WORD).alias("packed")).withColumn(
        "decoded", bpe.decode_packed("packed", WORD)
    ).orderBy("doc_id").collect()
    for row, ids in zip(rows, expected([t or "" for t in ODD_TEXTS])):
        assert row.ids == ids and row.both == "x"
        assert np.frombuffer(row.packed, "<u4").tolist() == ids
        assert row.decoded == LIBRARY.decode(ids, skip_special_tokens=False)
    assert docs.limit(0).select(bpe.encode("text", WORD)).count() == 0


@pytest.mark.parametrize("limit", [1, 7, 1000])
def test_pieces_of_long_texts_add_up(limit, small_texts):
    library = Tokenizer.from_file(BYTE)
    for text in [*small_texts[:20], "no boundary anywhere".replace(" ", ""), "a <|endoftext|> b  c\n d"]:
        parts = list(token_counts.pieces(text, limit))
        assert "".join(parts) == text
        assert sum(len(library.encode(p).ids) for p in parts) == len(library.encode(text).ids)


def test_token_count_query(spark, small_texts):
    library = Tokenizer.from_file(BYTE)
    got = {r.doc_id: r for r in QUERIES["op7_token_counts"](spark, "/root/testdata/sf0.001").collect()}
    for doc_id, text in enumerate(small_texts):
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (got[doc_id].n_tokens, got[doc_id].n_bytes, got[doc_id].over_limit) == (n, len(text.encode()), n > 512)


def test_token_counts_of_odd_texts(make_docs):
    library = Tokenizer.from_file(BYTE)
    rows = token_counts.with_token_counts(make_docs(ODD_TEXTS), BYTE, prefix="p_").orderBy("doc_id").collect()
    assert [r.p_n_tokens for r in rows] == [len(library.encode(t or "").ids) for t in ODD_TEXTS]
    rows = make_docs(ODD_TEXTS).select(token_counts.token_count("text", f"{TOKENIZERS}/piece_bpe_32k.model").alias("n")).collect()
    assert rows[0].n == 0 and rows[4].n > 0
    with pytest.raises(ValueError):
        token_counts.Counter("vocabulary.txt")


def test_ranks_count_like_the_library(small_texts):
    """Every kind of character, special strings and long runs, by ranks and by the library."""
    library = Tokenizer.from_file(BYTE)
    counter = token_counts.load(BYTE)
    assert token_counts.ranked(BYTE) is not None
    points = [c for c in range(0, 0x30000, 7) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)}b 1{chr(c)}2 !{chr(c)}{chr(c)} x  {chr(c)}" for c in points[i : i + 50]) for i in range(0, len(points), 50)]
    texts += [t or "" for t in ODD_TEXTS] + small_texts + [" " * 50_000 + "x", "a" * 50_000, "x<|endoftext|><|endof" * 9]
    assert counter.count(texts).tolist() == [len(library.encode(t).ids) for t in texts]
    assert token_counts.Counter(BYTE, by_ranks=False).count(texts[:99]).tolist() == counter.count(texts[:99]).tolist()


def test_other_vocabularies_are_left_to_the_library(tmp_path):
    assert token_counts.ranked(WORD) is None
    spec = json.loads(open(BYTE, encoding="utf-8").read())
    merges = spec["model"]["merges"]
    merges[300], merges[301] = merges[301], merges[300]
    path = tmp_path / "other.json"
    path.write_text(json.dumps(spec))
    assert token_counts.ranked(str(path)) is None
