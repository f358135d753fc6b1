import hashlib

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import ODD_TEXTS
from tidepane.llm import syncmers
from tidepane.llm.queries import QUERIES


@pytest.fixture(scope="module")
def hashes(spark):
    """Spark's hash of strings and of runs of hashes, one call for many."""

    def run(values):
        if not values:
            return []
        kind = "string" if isinstance(values[0], str) else "array<bigint>"
        df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
        if kind == "string":
            out = F.xxhash64("v")
        else:
            n = len(values[0])
            out = F.xxhash64(*[F.get("v", j) for j in range(n)])
        return [r.h for r in df.select("i", out.alias("h")).orderBy("i").collect()]

    return run


def plain_sketch(text, hashes, k=syncmers.K, s=syncmers.S):
    import re

    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    words = hashes(list(text) if len(text) <= 64 or len(text) > 16 * len(words) else words)
    runs = hashes([words[i : i + s] for i in range(len(words) - s + 1)]) if len(words) >= k else []
    starts = [
        i for i in range(len(words) - k + 1) if min(runs[i : i + k - s + 1]) in (runs[i], runs[i + k - s])
    ]
    whole = hashes([[runs[i + j] for j in sorted({*range(0, k - s + 1, s), k - s})] for i in starts])
    places = {}
    for h, i in zip(whole, starts):
        places.setdefault(h & 0xFFFFFFFF, i)
    places = places or {hashes([text])[0] & 0xFFFFFFFF: 0}
    return [h << 25 | i << 1 for h, i in sorted(places.items())]


def plain_likeness(a, b):
    left, right = ({v >> 25: v >> 1 & 0xFFFFFF for v in x} for x in (a, b))
    shifts = [d - i for i, d in sorted((left[h], right[h]) for h in left.keys() & right.keys())]
    agreed = sum(
        len(shifts) == 1 or any(abs(d - e) <= syncmers.SLACK for e in shifts[max(n - 1, 0) : n] + shifts[n + 1 : n + 2])
        for n, d in enumerate(shifts)
    )
    return 2 * agreed / (len(left) + len(right))


def test_query_against_brute_force(spark, small_texts, hashes):
    got = {r.doc_id: r for r in QUERIES["op8_syncmer_fingerprints"](spark, "/root/testdata/sf0.001").collect()}
    assert len(got) == len(small_texts)
    text_of = lambda s: "".join(f"{a >> 1:014x}" for a in s)
    for i, text in enumerate(small_texts):
        row, following = got[i], small_texts[(i + 1) % len(small_texts)]
        n = len(text) // 4
        edited = text[: len(text) - n] + following[:n]
        assert row.n_chars == len(text) and row.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        if i % 20 == 0:
            own, other = plain_sketch(text, hashes), plain_sketch(edited, hashes)
            assert (row.fingerprint, row.edited_fingerprint) == (text_of(own), text_of(other))
            assert row.near_edited == pytest.approx(plain_likeness(own, other))
            assert row.near_next == pytest.approx(plain_likeness(own, plain_sketch(following, hashes)))


def test_likeness_tells_edits_from_other_texts(spark):
    rows = QUERIES["op8_syncmer_fingerprints"](spark, "/root/testdata/sf0.01").filter("n_chars >= 400").collect()
    assert sum(r.near_edited for r in rows) / len(rows) > 0.7
    assert sum(r.near_edited > r.near_next for r in rows) / len(rows) > 0.99


def test_equal_texts_and_shifts(make_docs):
    words = " ".join(f"w{i}" for i in range(60))
    docs = make_docs([words, "lead in " + words, "nothing alike at all in this text"]).withColumn("t", F.col("text"))
    sketched = syncmers.with_sketch(docs, "t", "s")
    pairs = sketched.alias("a").join(sketched.alias("b"), F.col("a.doc_id") <= F.col("b.doc_id")).select(
        F.col("a.doc_id").alias("x"), F.col("b.doc_id").alias("y"), F.col("a.s").alias("l"), F.col("b.s").alias("r")
    )
    near = {(r.x, r.y): r.near for r in syncmers.with_likeness(pairs, "l", "r", "near").collect()}
    assert near[0, 0] == near[1, 1] == near[2, 2] == 1.0
    assert near[0, 1] > 0.9 and near[0, 2] == near[1, 2] == 0.0


def likeness(make_docs, text, other):
    docs = make_docs([text]).withColumn("other", F.lit(other))
    both = syncmers.with_sketch(syncmers.with_sketch(docs, "text", "s"), "other", "t")
    return syncmers.with_likeness(both, "s", "t", "near").first()


def test_words_put_in_midway_and_parts_exchanged(make_docs):
    words = [f"w{i}" for i in range(3000)]
    put_in = [*words[:1500], *(f"new{i}" for i in range(40)), *words[1500:]]
    row = likeness(make_docs, " ".join(words), " ".join(put_in))
    assert row.near > 0.95 and len(row.s) > 1500  # no anchor is cut off
    assert likeness(make_docs, " ".join(words), " ".join(words[1000:] + words[:1000])).near > 0.95
    shared = [f"x{i}" for i in range(2000)] + words[200:400] + [f"y{i}" for i in range(2000)]
    assert 0.03 < likeness(make_docs, " ".join(words), " ".join(shared)).near < 0.08


def test_short_texts_and_scripts_without_blanks(make_docs):
    assert 0.4 < likeness(make_docs, "three short words", "three short wonder").near < 1
    text = "".join(chr(0x4E00 + i * 37 % 5000) for i in range(800))
    assert 0.6 < likeness(make_docs, text, text[:600] + "".join(chr(0x6E00 + i) for i in range(200))).near < 0.9
    assert likeness(make_docs, "", "").near == likeness(make_docs, "a", "a").near == 1.0


def test_narrow_sketches(spark):
    """Ends of the ranges of hashes and positions come back as they were."""
    anchors = [[h << 25 | i << 1 for h, i in [(0, 0), (1, 65535), (2**31, 65536), (2**32 - 1, 2**24 - 1)]], [], None]
    rows = spark.createDataFrame([(a,) for a in anchors], "a array<bigint>").select("a", syncmers._narrow("a").alias("n"))
    assert [r.b for r in rows.select(syncmers._wide("n").alias("b")).collect()] == anchors


def test_next_ids(spark):
    rows = spark.createDataFrame([(i, 1) for i in [5, -3, 9, 9, None, 200, 7]], "id bigint, take int")
    assert {r.id: r.next_id for r in syncmers.next_ids(rows).collect()} == {-3: 5, 5: 7, 7: 9, 9: 200, 200: -3}
    alone = spark.createDataFrame([(4, 1)], "id bigint, take int")
    assert [r.next_id for r in syncmers.next_ids(alone).collect()] == [4]


def test_odd_texts_and_ids(make_docs):
    ids = [*range(len(ODD_TEXTS) - 3), None, 2, 2]
    docs = make_docs(ODD_TEXTS, ids=ids, head=["x"] * len(ids))
    rows = syncmers.with_likeness(syncmers.fingerprints(docs), "sketch", "next_sketch", "near").collect()
    assert len(rows) == len(ids) and all(r.sketch and r.edited_sketch for r in rows)
    assert [r.near for r in rows if r.doc_id is None] == [None]
    assert syncmers.fingerprints(docs.limit(0)).count() == 0
