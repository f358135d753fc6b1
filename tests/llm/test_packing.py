import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.conftest import ODD_TEXTS, TOKENIZERS
from tidepane.llm import packing
from tidepane.llm.queries import QUERIES

WORD = f"{TOKENIZERS}/word_bpe_49k.json"


def fewest(sizes, capacity):
    """Exact number of bins, by the best (bins, load of the last one) of every subset."""
    best = [(99, 0)] * (1 << len(sizes))
    best[0] = (1, 0)
    for held in range(1, len(best)):
        for i, size in enumerate(sizes):
            if held >> i & 1:
                bins, load = best[held ^ 1 << i]
                best[held] = min(best[held], (bins, load + size) if load + size <= capacity else (bins + 1, size))
    return best[-1][0]


def gapless(bins, offsets, sizes, capacity):
    for b in set(bins.tolist()):
        at = np.flatnonzero(bins == b)
        at = at[np.argsort(offsets[at])]
        ends = np.cumsum(sizes[at])
        assert offsets[at].tolist() == [0, *ends[:-1].tolist()] and ends[-1] <= capacity


def test_small_groups_are_packed_optimally():
    rng = random.Random(1)
    for _ in range(300):
        capacity = rng.choice([10, 20, 50, 100])
        sizes = np.array([rng.randint(1, capacity) for _ in range(rng.randint(1, 10))])
        bins, offsets = packing.pack_sizes(sizes, capacity)
        gapless(bins, offsets, sizes, capacity)
        exact = fewest(sizes.tolist(), capacity)
        assert len(set(bins.tolist())) == exact
        assert packing.lower_bound(sorted(sizes.tolist(), reverse=True), capacity) <= exact


def test_bin_completion_beats_best_fit():
    sizes = sorted([6, 6, 4, 4, 4, 3, 3] * 3, reverse=True)  # best fit joins 6 and 4, and then 4, 3 and 3
    worse = [[6], [6], [4, 4], [4, 3], [3]] * 3
    found = packing.complete(sizes, 10, worse, nodes=5000)
    assert len(found) == fewest([6, 6, 4, 4, 4, 3, 3], 10) * 3
    assert sorted(s for b in found for s in b) == sorted(sizes) and all(sum(b) <= 10 for b in found)


def test_fillings_are_not_dominated():
    assert packing.fillings([2, 3, 5, 7], 8)[0] in ([5, 3], [7])
    assert packing.fillings([], 8) == [[]] and packing.fillings([9], 8) == [[]]
    assert [8] in packing.fillings([1, 2, 8], 8)


def test_large_groups_reach_the_bound():
    sizes = np.random.default_rng(0).lognormal(6.4, 1, 20000).astype(int).clip(1, 4096)
    bins, offsets = packing.pack_sizes(sizes, 4096)
    gapless(bins, offsets, sizes, 4096)
    assert len(set(bins.tolist())) <= 1 + packing.lower_bound(sorted(sizes.tolist(), reverse=True), 4096)


def test_lengths_between_a_quarter_and_a_half():
    """Best fit leaves its emptiest sequences alike here, so packing those anew gains nothing."""
    sizes = np.random.default_rng(2).integers(1100, 1630, 20000)
    falling = sorted(sizes.tolist(), reverse=True)
    bins, offsets = packing.pack_sizes(sizes, 4096)
    gapless(bins, offsets, sizes, 4096)
    assert len(set(bins.tolist())) < 0.97 * len(packing.best_fit(falling, 4096))


def test_fillings_are_all_there():
    rng = random.Random(4)
    for _ in range(100):
        left, room = sorted(rng.choices(range(1, 15), k=9)), rng.randint(5, 40)
        fits = {tuple(sorted(c)) for n in range(10) for c in itertools.combinations(left, n) if sum(c) <= room}
        left_over = lambda c: list((Counter(left) - Counter(c)).elements())
        whole = {c for c in fits if sum(c) + min(left_over(c), default=99) > room}
        found = packing.fillings(left, room)
        assert {tuple(sorted(f)) for f in found} == whole and len(found) == len(whole)
        assert [sum(f) for f in found] == sorted(map(sum, found), reverse=True)


def plain_pieces(texts, ids, capacity):
    library = Tokenizer.from_file(WORD)
    out = []
    for doc_id, text in zip(ids, texts):
        tokens = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for p in range(0, len(tokens), capacity):
            part = tokens[p : p + capacity]
            out.append((doc_id, p // capacity, p, len(part), zlib.crc32(part.tobytes())))
    return sorted(out, key=repr)


def check(rows, texts, ids, capacity):
    got = sorted(((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows), key=repr)
    assert got == plain_pieces(texts, ids, capacity)
    sizes = np.array([r.length for r in rows])
    names = np.unique([r.sequence_id for r in rows], return_inverse=True)[1]
    gapless(names, np.array([r.offset for r in rows]), sizes, capacity)
    return len(set(names.tolist())), -(-int(sizes.sum()) // capacity)


def test_query(spark, small_texts):
    rows = QUERIES["op9_packed_sequences"](spark, "/root/testdata/sf0.001").collect()
    bins, bound = check(rows, small_texts, range(len(small_texts)), 4096)
    assert bins <= bound + 1


@pytest.mark.parametrize("capacity", [1, 3, 8])
def test_odd_texts(make_docs, capacity):
    ids = [*range(len(ODD_TEXTS) - 2), None, 3]
    docs = make_docs(ODD_TEXTS, ids=ids, offset=["x"] * len(ids))
    check(packing.pack_documents(docs, WORD, capacity).collect(), ODD_TEXTS, ids, capacity)


def test_groups_and_empty_tables(spark, make_docs):
    texts = ["some words here"] * 40
    cut = packing.pieces(make_docs(texts).select("doc_id", "text"), WORD, 16).drop("ids")
    rows = packing.pack(cut, 16, group=10).collect()
    assert len(rows) == 40 and len({r.sequence_id >> 32 for r in rows}) == 4
    assert packing.pack_documents(make_docs(texts).limit(0), WORD).count() == 0
