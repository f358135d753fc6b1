import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidepane.llm import hard_negatives
from tidepane.llm.queries import QUERIES

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def plain(rows, every=100):
    """Brute force over ``(vec_id, vector, label)``."""
    kept = []
    for vec_id, vector, label in rows:
        if label is None or vector is None or any(x is None or not math.isfinite(x) for x in vector):
            continue
        label = (label + 1) % 10 if vec_id is not None and vec_id % 7 == 0 else label
        kept.append((vec_id, [math.floor(256 * float(np.float32(x))) for x in vector], label))
    order = lambda r: (-r[0], r[1] is None, r[1] or 0)
    out, answered = set(), set()
    for vec_id, vector, label in kept:
        if vec_id is None or vec_id % every or (vec_id, label, tuple(vector)) in answered:
            continue
        answered.add((vec_id, label, tuple(vector)))
        scored = [(sum(x * y for x, y in zip(vector, v)), i, k == label) for i, v, k in kept if i != vec_id]
        for number, (score, positive, _) in enumerate(sorted((s for s in scored if s[2]), key=order)[:5], 1):
            fits = [s for s in scored if not s[2] and 80 * score <= 100 * s[0] <= 100 * score]
            for rank, (other, negative, _) in enumerate(sorted(fits, key=order)[:5], 1):
                out.add((vec_id, positive, rank, negative, score, other, number))
    return out


def answers(spark, rows, every=100):
    whole = hard_negatives.whole_numbers(spark.createDataFrame(rows, SCHEMA).repartition(3))
    whole = whole.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    got = [tuple(r) for r in hard_negatives.mine(whole, F.col("vec_id") % every == 0, vector="embedding").collect()]
    assert len(got) == len(set(got))
    return set(got)


def vectors(seed, n, width, spread=1.0):
    r = np.random.default_rng(seed)
    middle = r.normal(size=(4, width))
    out = []
    for i in range(n):
        v = middle[i % 4] + spread * r.normal(size=width)
        v *= r.choice([0.2, 1.0, 1.0, 3.0]) / np.linalg.norm(v)
        out.append((i, [float(np.float32(x)) for x in v], int(r.integers(0, 3))))
    return out


@pytest.mark.parametrize("block, spread", [(16_384, 1.0), (7, 1.0), (7, 0.1), (40, 3.0)])
def test_equal_to_brute_force(spark, monkeypatch, block, spread):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", block)
    rows = vectors(block, 400, 12, spread)
    assert answers(spark, rows, 20) == plain(rows, 20)


def test_odd_rows_ties_and_repeats(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "BLOCK_ROWS", 5)
    rows = [(i, [0.5, 0.5], i % 2) for i in range(40)] + [(None, [0.5, 0.5], 0), (100, [0.0, 0.0], 1), (101, [-0.5, 0.1], 1), (200, [0.5], 0)]
    rows += [(102, [1.0, None], 0), (103, [1.0, float("nan")], 0), (104, [1.0, float("inf")], 0), (105, None, 0), (106, [1.0, 1.0], None)]
    rows += [(0, [0.5, 0.5], 0), (300, [], 1), (400, [900.0, -3.5], 0)]
    assert answers(spark, rows) == plain(rows)


def test_empty_table(spark):
    assert answers(spark, []) == set()


def test_candidates_miss_no_row():
    r = np.random.default_rng(3)
    for width in (1, 2, 8, 64):
        rows = (r.normal(size=(300, width)) * r.choice([1, 40, 300], size=(300, 1))).astype(np.int64)
        rows[:3] = 0
        block = hard_negatives.Block(np.arange(300), list(rows))
        for anchor in [*rows[:20], *(r.normal(size=(20, width)) * 100).astype(np.int64)]:
            scores = rows @ anchor
            for least in [1, int(np.quantile(scores, 0.5)), int(np.quantile(scores, 0.9)), int(scores.max())]:
                found = set(block.candidates(anchor, least).tolist())
                assert found >= set(np.flatnonzero(scores >= least).tolist())


def test_pruning_leaves_few_rows():
    """Rows far from the anchor are not verified."""
    r = np.random.default_rng(4)
    rows = r.normal(size=(2000, 16))
    rows = (300 * rows / np.linalg.norm(rows, axis=1)[:, None]).astype(np.int64)
    block = hard_negatives.Block(np.arange(2000), list(rows))
    left = [len(block.candidates(a, int(0.9 * (a @ a)))) for a in rows[:50]]
    assert np.mean(left) < 100


def test_large_components_are_exact():
    rows = np.array([[1 << 40, 3], [1 << 40, 4]], np.int64)
    block = hard_negatives.Block(np.arange(2), list(rows))
    anchor = np.array([1 << 21, 1], np.int64)
    assert list(block.scores(anchor, np.arange(2))) == [(1 << 61) + 3, (1 << 61) + 4]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    random.Random(1).shuffle(rows)
    assert {tuple(r) for r in QUERIES["op12_hard_negatives"](spark, "/root/testdata/sf0.01").collect()} == plain(rows)
