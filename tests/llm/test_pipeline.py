"""Every stage of the pipeline against a plain version over the rows that its predecessor kept."""

import hashlib

import pytest

import corpus_pipeline
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_packing import check
from tests.llm.test_shingle_join import plain_kept
from tests.llm.test_spans import plain_private
from tidepane.llm import line_dedup

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def kept(spark, tmp_path_factory):
    """Rows after each stage, written and read again."""
    folder = tmp_path_factory.mktemp("stages")
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, SF).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        frames.append(docs)
    return [f.collect() for f in frames]


def texts(rows):
    return {r.doc_id: r.text for r in rows}


def plain_chunks(text):
    lines = text.split("\n")
    hashes = [int(hashlib.md5(x.encode()).hexdigest()[:15], 16) % line_dedup._MODULUS for x in lines]
    long = [len(x.split()) > line_dedup.LONG for x in lines]
    start = 0
    for i in range(len(lines)):
        rolling = sum(hashes[i - j] * 31**j for j in range(min(3, i + 1))) % line_dedup._MODULUS
        last = i == len(lines) - 1
        if last or rolling % line_dedup.DIVISOR == 0 or long[i] or long[i + 1]:
            yield lines[start : i + 1], i > start or long[i]
            start = i + 1


def plain_lines(rows):
    seen, out = set(), {}
    for doc_id, text in sorted(rows.items()):
        left = []
        for lines, counts in plain_chunks(text):
            chunk = "\n".join(lines)
            if not counts or chunk not in seen:
                left += lines
            if counts:
                seen.add(chunk)
        out[doc_id] = "\n".join(left)
    return out


def test_columns(kept):
    for rows in kept[1:-1]:
        assert all(r.asDict().keys() == dict.fromkeys(COLUMNS).keys() and r.n_chars == len(r.text) for r in rows)


def test_quality_keeps_clean_documents(spark, kept):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    left = texts(kept[1])
    assert left.items() <= texts(kept[0]).items()
    good = [i for i, q in labels.items() if q == 1]
    bad = [i for i, q in labels.items() if q == 0]
    assert all(i in left for i in good) and sum(i in left for i in bad) <= len(bad) // 4


def test_lines(kept):
    assert texts(kept[2]) == plain_lines(texts(kept[1]))


def test_near_copies(kept):
    rows = sorted(texts(kept[2]).items())
    assert texts(kept[3]) == {rows[k][0]: rows[k][1] for k in plain_kept([t for _, t in rows])}


def test_personal_data_goes(kept):
    before, after = texts(kept[3]), texts(kept[4])
    assert before.keys() == after.keys()
    for doc_id, text in after.items():
        assert not plain_private(text)
        if text != before[doc_id]:
            assert "[EMAIL]" in text or "[IP]" in text or "[CARD]" in text or "[PHONE]" in text
    clean = [i for i, t in before.items() if not any(c in t for c in "0123456789@")]
    assert all(after[i] == before[i] for i in clean)


def test_packing(kept):
    rows = sorted(texts(kept[4]).items())
    bins, bound = check(kept[5], [t for _, t in rows], [i for i, _ in rows], 4096)
    assert bins <= bound + 1


def test_run_is_the_chain_of_the_stages(spark, kept):
    got = corpus_pipeline.run(spark, SF)
    key = lambda r: (r.doc_id, r.piece, r.start, r.length, r.ids_crc32)
    assert sorted(map(key, got.collect())) == sorted(map(key, kept[5]))


def test_odd_texts_and_empty_tables(spark, make_docs):
    docs = make_docs(ODD_TEXTS, rank=["x"] * len(ODD_TEXTS))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, docs, SF)
        assert after.columns == docs.columns
        assert after.count() <= len(ODD_TEXTS)
        assert stage(spark, docs.limit(0), SF).count() == 0
