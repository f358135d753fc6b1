"""Near copies by shingles against brute-force Jaccard pairs."""

import random

import corpus_pipeline
from tests.llm.conftest import ODD_TEXTS
from tests.llm.test_near_copies import plain_fingerprint
from tidepane.llm import shingle_join


def plain_set(text, shingle=5):
    words = (text or "").encode().lower().split()
    return {tuple(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))}


def plain_kept(texts):
    """Smallest index of each component over links of similarity 0.8."""
    sets = [plain_set(t) for t in texts]
    label = list(range(len(texts)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            if 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i for i in range(len(texts)) if root(i) == i}


def edited_copies(seed=5):
    """Edited copies, a chain of edits of one text, and texts that share a common head only."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    head = rng.choices(words, k=30)
    texts = []
    for k in range(25):
        base = (head if k % 2 else []) + rng.choices(words, k=rng.randint(3, 160))
        texts.append(" ".join(base))
        for _ in range(rng.randint(0, 4)):
            copy = list(base)
            for _ in range(rng.randint(1, 4)):
                copy[rng.randrange(len(copy))] = f"new{rng.randrange(10**6)}"
            texts.append(" ".join(copy))
    chain = rng.choices(words, k=150)
    for _ in range(40):
        chain[rng.randrange(150)] = f"new{rng.randrange(10**6)}"
        texts.append(" ".join(chain))
    rng.shuffle(texts)
    return texts + ODD_TEXTS


def test_stage_keeps_one_of_each_component(spark, make_docs):
    texts = edited_copies()
    kept = plain_kept(texts)
    assert len(kept) < len(texts) - 60
    rows = corpus_pipeline.near_copies(spark, make_docs(texts), "").collect()
    assert {r.doc_id for r in rows} == kept and len(rows) == len(kept)
    assert all(r.text == texts[r.doc_id] for r in rows)


def test_order_of_shingles_changes_nothing(make_docs, monkeypatch):
    texts = edited_copies(8)
    monkeypatch.setattr(shingle_join, "FREQUENT", 0)
    assert {r.doc_id for r in shingle_join.keep_one(make_docs(texts)).collect()} == plain_kept(texts)


def test_long_texts_of_unlike_widths(make_docs):
    """Sets of sizes on both sides of a power of two, whose bitmaps have two widths."""
    words = [f"w{i}" for i in range(2400)]
    texts = [" ".join(words[:n]) for n in (950, 1020, 1040, 1200, 1900, 2040, 2060, 2400)]
    texts.append(" ".join(words[:1000] + [f"x{i}" for i in range(1000)]))
    rows = shingle_join.keep_one(make_docs(texts)).collect()
    assert {r.doc_id for r in rows} == plain_kept(texts) and len(rows) == 3


def test_rows_without_ids(make_docs):
    texts = ["one two three", "one  TWO three", "four five six", "seven"]
    rows = shingle_join.keep_one(make_docs(texts, ids=[None, None, None, 4])).collect()
    assert sorted(r.text.lower().split()[0] for r in rows) == ["four", "one", "seven"]
    assert shingle_join.keep_one(make_docs(texts).limit(0)).count() == 0


def test_two_near_copies_of_a_hundred_thousand_words(make_docs):
    words = [f"w{i}" for i in range(100_000)]
    texts = [" ".join(words), " ".join([*words[:50_000], "new", *words[50_001:]]), " ".join(words[:70_000])]
    assert {r.doc_id for r in shingle_join.keep_one(make_docs(texts)).collect()} == {0, 2}


def test_many_short_texts_that_share_a_shingle(spark, make_docs):
    """They meet in one bucket; no more than pairs of near size are made of them."""
    texts = [f"all of these begin alike then {i} {i * 7} {i * 11} {i * 13}" for i in range(3000)]
    assert shingle_join.keep_one(make_docs(texts)).count() == len(texts)


def test_near_fingerprints_are_linked(make_docs):
    """The SimHash step alone links copies whose fingerprints are within its radius."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        base = [f"w{rng.randrange(10**6)}" for _ in range(500)]
        texts += [" ".join(base), " ".join([*base[:250], "new", *base[251:]])]
    docs = make_docs(texts)
    facts = shingle_join.signatures(docs, "text", "doc_id", 5, shingle_join.frequent(docs, "text", 5))
    cls = {r.id: r.cls for r in facts.collect()}
    links = {frozenset(r) for r in shingle_join._printed_alike(facts, docs, "text", 5).collect()}
    prints = [plain_fingerprint(t, 5) for t in texts]
    near = [k for k in range(0, 24, 2) if (prints[k] ^ prints[k + 1]).bit_count() <= shingle_join.RADIUS]
    assert near and links == {frozenset((cls[k], cls[k + 1])) for k in near}


def test_pairs_only_where_a_shared_shingle_can_be_the_first(spark):
    rows = spark.createDataFrame([(100, i, [0] * 8) for i in (0, 5, 11, 15)], "n bigint, i int, narrow array<bigint>")
    met = rows.alias("a").join(rows.alias("b"), shingle_join._may_meet()).selectExpr("a.i AS i", "b.i AS j").collect()
    assert {max(r) for r in met} == {0, 5, 11} and len(met) == 9
