import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from tests.llm.conftest import ODD_TEXTS
from tidepane.llm import line_dedup, quality_model, quality_rules
from tidepane.llm.queries import ORACLES, QUERIES


def same_as_sql(spark, name, sf="0.001"):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '/root/testdata/sf{sf}/documents.parquet'")
    df = QUERIES[name](spark, f"/root/testdata/sf{sf}")
    result = con.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    got = {tuple(r[c] for c in result.columns) for r in df.collect()}
    assert got == set(result.fetchall())


@pytest.mark.parametrize("name", ["op6_line_dedup", "op10_quality_rules"])
def test_query_against_sql(spark, name):
    same_as_sql(spark, name)


# -- classifier --------------------------------------------------------------------------------------------------------


def test_held_out_accuracy(spark):
    rows = {r.doc_id: r for r in QUERIES["op5_quality_scores"](spark, "/root/testdata/sf0.01").collect()}
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items())
    held = [(rows[x.doc_id].predicted, x.quality) for x in labels if rows[x.doc_id].held_out]
    assert len(held) > 50
    assert sum(p == q for p, q in held) / len(held) > 0.97
    assert all(p == 1 for p, q in held if q == 1)


def test_scores_are_sparse_dot_products():
    """The batched mean of weights is the dot product with the values the model is trained on."""
    texts = pa.array(["a b c a b", "The The The", "", "x", "don't!! stop## now $$"])
    weights = np.random.default_rng(1).standard_normal((1 << quality_model.BITS) + 1).astype(np.float32)
    plain = [
        1 / (1 + np.exp(-float(weights[at].astype(float) @ x)))
        for at, x in quality_model.rows_of(texts, quality_model.BITS)
    ]
    assert np.allclose(quality_model.scores(texts, weights), plain)
    assert plain[2] == pytest.approx(1 / (1 + np.exp(-float(weights[-1]))))


def test_ftrl_separates():
    texts = pa.array(["good fine words here"] * 20 + ["bad## worse## words## here##"] * 20)
    labels = np.array([1.0] * 20 + [0.0] * 20)
    order = np.random.default_rng(0).permutation(40)
    weights = quality_model.fit(texts.take(pa.array(order)), labels[order])
    score = quality_model.scores(texts, weights)
    assert score[:20].min() > 0.8 and score[20:].max() < 0.2


def test_shapes():
    assert [quality_model.shape(w) for w in ("Don't", "THE!!", "x12", "über", "a")] == ["a'a", "A!", "a0", "a", "a"]


def test_classifier_on_odd_and_empty_tables(spark, make_docs):
    docs = make_docs(ODD_TEXTS)
    labels = spark.createDataFrame([(4, 1), (None, 0), (5, None)], "doc_id bigint, quality int")
    weights = quality_model.train(docs, labels)
    rows = docs.select(quality_model.score("text", weights).alias("s")).collect()
    assert len(rows) == len(ODD_TEXTS) and all(0 <= r.s <= 1 for r in rows)
    assert not quality_model.train(docs, labels.limit(0)).any()
    assert docs.limit(0).select(quality_model.score("text", weights)).count() == 0


# -- rules -------------------------------------------------------------------------------------------------------------

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)
    )


def test_measures_of_odd_texts(make_docs):
    texts = ODD_TEXTS + [
        "a b c d e f a b c d e", "x x x x x x x", "a b c d e " * 4, "one\none\n\n\ntwo\none", "# | a <b>", "a b c d e f g h i j " * 300,
    ]
    docs = make_docs(texts, host=["h"] * len(texts))
    rows = quality_rules.measure(docs).orderBy("doc_id").collect()
    assert [tuple(r[c] for c in quality_rules.MEASURES) for r in rows] == [plain_measures(t) for t in texts]
    judged = quality_rules.judge(docs, host="host").orderBy("doc_id").collect()
    assert [r.base_failed for r in judged] == [
        n < 10 or 100 * again > 20 * n for n, *_, again in map(plain_measures, texts)
    ]
    assert not any(r.kept for r in judged if r.base_failed)
    assert quality_rules.judge(docs.limit(0)).count() == 0


def test_bad_hosts_are_held_to_every_rule(spark):
    clean = "all of these words are plain and none of them comes twice in a window here"
    mild = clean + " ##"
    poor = "too short"
    rows = [(f"good{i}", clean) for i in range(30)] + [("good", clean)] * 5 + [("good", mild)] + [("bad", poor)] * 40 + [("bad", mild), ("bad", clean)]
    rows += [(None, clean)] * 2
    docs = spark.createDataFrame([(i, t, h) for i, (h, t) in enumerate(rows)], "doc_id bigint, text string, source string")
    judged = {(r.source, rows[r.doc_id][1]): r.kept for r in quality_rules.judge(docs).collect()}
    assert judged["good", mild] and judged["bad", clean] and judged[None, clean]
    assert not judged["bad", mild] and not judged["bad", poor]


def test_documents_with_columns_named_like_results(make_docs):
    names = ["host_rate", "base_failed", "kept", "n_words", "n_repeat_words", "suspect"]
    docs = make_docs(["too short", None], **{c: ["x", "y"] for c in names})
    judged = quality_rules.judge(docs)
    assert len(set(judged.columns)) == len(judged.columns)
    assert [(r.suspect, r.n_words, r.base_failed) for r in judged.orderBy("doc_id").collect()] == [("x", 2, True), ("y", 0, True)]


# -- lines -------------------------------------------------------------------------------------------------------------


def test_shared_passage_goes_wherever_it_stands(make_docs):
    long = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(3)]
    passage = "\n".join(long)
    texts = [f"own one\n{passage}\nmore", f"{passage}\nother", f"a\nb\nc\nd\ne\nf\n{passage}", "own one\nmore", None, ""]
    docs = make_docs(texts, **{c: ["x"] * len(texts) for c in ("lines", "spans", "hash", "first", "start", "n_lines", "gone")})
    rows = line_dedup.without_repeats(docs, removed="gone").orderBy("doc_id").collect()
    assert [r.text for r in rows] == [texts[0], "other", "a\nb\nc\nd\ne\nf", "own one\nmore", None, ""]
    assert [r.gone for r in rows] == [0, 3, 3, 0, 0, 0]


def test_repeats_inside_a_text_and_equal_ids(make_docs):
    line = " ".join(f"word{j}" for j in range(60))
    texts = [f"{line}\nmid\n{line}", f"{line}\nmid\n{line}", line, line]
    rows = line_dedup.without_repeats(make_docs(texts, ids=[7, 7, 9, None])).collect()
    assert sorted((r.doc_id or 0, r.text) for r in rows) == [(0, ""), (7, f"{line}\nmid"), (7, f"{line}\nmid"), (9, "")]


def test_small_lines_stay(make_docs):
    texts = ["short line"] * 5
    assert [r.text for r in line_dedup.without_repeats(make_docs(texts)).collect()] == texts
    assert line_dedup.without_repeats(make_docs(texts).limit(0)).count() == 0
