import random
import re

import numpy as np
import pytest
import xxhash

from tests.llm.conftest import ODD_TEXTS
from tidepane.llm import components, simhash
from tidepane.llm.queries import QUERIES


def plain_fingerprint(text, shingle=3):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered)
    if not words:
        return 0
    parts = [" ".join(words[i : i + shingle]) for i in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(p.encode(), 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """Smallest index reachable over links of at most two bits."""
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return [root(i) for i in range(len(prints))]


def test_masks_cover_every_pair_of_bits():
    masks = simhash.covering_masks()
    for i in range(64):
        for j in range(64):
            assert any(not m >> i & 1 and not m >> j & 1 for m in masks)


def test_query_against_brute_force(spark, small_texts):
    got = {r.doc_id: r for r in QUERIES["op3_simhash_components"](spark, "/root/testdata/sf0.001").collect()}
    prints = [plain_fingerprint(t) for t in small_texts]
    for i, c in enumerate(plain_components(prints)):
        assert (got[i].fingerprint, got[i].component_id) == (f"{prints[i]:016x}", c)


def test_crowded_buckets_lose_no_link(spark):
    """A ball of near fingerprints, chains of links, and far ones: as many rows as a bucket needs to be crowded."""
    rng = random.Random(3)
    centre = rng.getrandbits(64)
    prints = {centre}
    for _ in range(150):
        prints.add(centre ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    chain = rng.getrandbits(64)
    for _ in range(40):
        chain ^= 1 << rng.randrange(64) ^ 1 << rng.randrange(64)
        prints.add(chain)
    prints |= {rng.getrandbits(64) for _ in range(60)}
    prints = sorted(prints)
    signed = np.array(prints, np.uint64).view(np.int64).tolist()
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(signed)], "doc_id bigint, fp bigint")
    got = {r.fp: r.component_id for r in simhash.classes(rows).collect()}
    assert [got[v] for v in signed] == plain_components(prints)


def test_odd_texts_and_repeated_rows(make_docs):
    ids = [*range(len(ODD_TEXTS) - 2), None, None]
    docs = make_docs(ODD_TEXTS, ids=ids, fp=["x"] * len(ids))
    rows = simhash.near_duplicates(docs).collect()
    assert len(rows) == len(ODD_TEXTS)
    assert {r.component_id for r in rows if r.fingerprint == 0} == {0}
    kept = simhash.keep_one(docs)
    assert kept.columns == docs.columns
    texts = [r.text for r in kept.collect()]
    assert texts.count("same text") == 1 and sum(t is None or not t.strip() for t in texts) == 1
    assert simhash.near_duplicates(docs.limit(0)).count() == 0
    twice = docs.union(docs)
    assert simhash.keep_one(twice).count() == len(texts)


def test_a_long_chain(spark):
    """Many rounds: plans must not grow from one to the next."""
    links = spark.range(3000).selectExpr("(id * 7919) % 3001 AS u", "((id + 1) * 7919) % 3001 AS v")
    found = components.component_roots(links)
    assert (found.count(), found.filter("root <> 0").count()) == (3001, 0)


@pytest.mark.parametrize("links, expected", [
    ([], {}),
    ([(1, 1)], {}),
    ([(5, 4), (4, 3), (3, 2), (2, 1), (9, 8)], {1: 1, 2: 1, 3: 1, 4: 1, 5: 1, 8: 8, 9: 8}),
    ([(i, 100) for i in range(30)] + [(200, 100), (200, 201)], {**{i: 0 for i in range(30)}, 100: 0, 200: 0, 201: 0}),
])
def test_components(spark, links, expected):
    found = components.component_roots(spark.createDataFrame(links, "u bigint, v bigint"))
    assert {r.node: r.root for r in found.collect()} == expected
