"""Hard negatives for contrastive training, by exact inner products behind length buckets and coordinate pruning.

For each anchor the best rows of its own label (positives) are found, then for each positive the best rows of other
labels whose score lies between a share of the positive's score and that score. Scores are inner products of whole
numbers, so they are exact; equal scores are ordered by id.

**Method.** Rows are dealt into buckets by label and length, buckets into blocks of about ``BLOCK_ROWS``. A block keeps a
sorted list of values for each coordinate of its unit vectors. An anchor with a lowest useful score skips a block whose
longest vector can't reach it. Otherwise the score bounds the angle between anchor and row, and the angle bounds the
values a row may have in the anchor's largest coordinates (the focus): these ranges are looked up in the sorted lists,
the candidates of the narrowest are intersected with the other ranges, rows too short to reach the score are left out,
and what is left is verified by its exact score.
The lowest useful scores come from a first round over one block of each label (no row of which has to be among the
answers: it only gives scores that are reached for sure) and, for negatives, from the share of the positive's score.

**Scale.** Anchors are a stated query set, so their number times the number of blocks is the size of the task; buckets
that an anchor's score rules out are dropped before rows move. Each block is one group of bounded size in one task,
and anchors stream past it. A label or length that most rows have makes more blocks, not larger ones. Only the best
rows of each anchor, range and block leave a task, and they are cut again before and after the last shuffle.

**Cases.** Rows with a null label or vector, or a null or non-finite component, take no part. A null id is never an
anchor; it comes last among equal scores. Repeated rows are candidates of their own, a repeated anchor is answered
once, and no row with the anchor's id is its positive. Vectors of different dimension score as if filled up with
zeros. Scores must fit a long. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tidepane.operators.joins import attach
from tidepane.session import cut_lineage

#: Rows of a block; bounds a task's memory (64 components: 16 MB of whole numbers and unit vectors), not the result.
BLOCK_ROWS = 16_384
#: Length buckets for each doubling of the length.
STEPS = 4
#: Largest coordinates of an anchor whose value ranges are intersected.
FOCUS = 6
_SLACK = 1e-9
_NO_ID = (1 << 63) - 1
_LEAST, _MOST = -(1 << 63), (1 << 63) - 1

_BLOCK = ["__label", "__bucket", "__salt"]
_FOUND = "anchor_id bigint, __version bigint, range int, id bigint, score bigint"


def whole_numbers(vectors: DataFrame, vector: str = "embedding", unit: int = 256) -> DataFrame:
    """Rows that take part, their components as ``floor(unit * x)`` in ``array<bigint>``."""
    x = F.col(vector)
    sound = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")))
    kept = vectors.filter(F.col("label").isNotNull() & x.isNotNull() & F.coalesce(sound, F.lit(False)))
    return kept.withColumn(vector, F.transform(x, lambda v: F.floor(v.cast("double") * unit)))


def _length(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda s, v: s + v.cast("double") * v.cast("double")))


def _in_blocks(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, label, vector`` with their block, and the blocks with the greatest length in their bucket."""
    length = _length(F.col("vector"))
    measured = rows.withColumn("__length", length).withColumns(
        {
            "__label": F.col("label"),
            "__bucket": F.when(F.col("__length") > 0, F.floor(F.log2("__length") * STEPS).cast("int")).otherwise(-(1 << 30)),
        }
    )
    figures = (
        measured.groupBy("__label", "__bucket")
        .agg(F.count(F.lit(1)).alias("__rows"), F.max("__length").alias("__longest"))
        .withColumn("__salts", F.ceil(F.col("__rows") / BLOCK_ROWS).cast("int"))
    )
    figures = cut_lineage(figures)
    dealt = attach(measured, figures, ["__label", "__bucket"])
    salt = F.pmod(F.xxhash64("id", "vector"), F.col("__salts")).cast("int")
    blocks = figures.select(
        "__label", "__bucket", "__rows", "__longest", F.explode(F.sequence(F.lit(0), F.col("__salts") - 1)).alias("__salt")
    )
    return dealt.withColumn("__salt", salt).select(*_BLOCK, "id", "vector"), blocks


class Block:
    """Rows of one block with sorted lists of the coordinates of their unit vectors."""

    def __init__(self, ids: np.ndarray, vectors: list[np.ndarray]):
        self.ids = ids
        self.width = max((len(v) for v in vectors), default=0)
        self.rows = np.zeros((len(vectors), self.width), np.int64)
        for row, v in zip(self.rows, vectors):
            row[: len(v)] = v
        real = self.rows.astype(np.float64)
        lengths = np.sqrt((real * real).sum(axis=1))
        self.lengths, self.longest = lengths, float(lengths.max(initial=0.0))
        self.unit = real / np.where(lengths > 0, lengths, 1.0)[:, None]
        self.most = float(np.abs(real).max(initial=0.0))
        self.lists: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def sorted_list(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        """Values of coordinate ``k`` in order and the rows they are from."""
        if k not in self.lists:
            order = np.argsort(self.unit[:, k], kind="stable")
            self.lists[k] = (self.unit[order, k], order)
        return self.lists[k]

    def candidates(self, anchor: np.ndarray, least: int) -> np.ndarray:
        """Rows that can have a score of ``least`` or more; none that has is missing."""
        if least <= 0:
            return np.arange(len(self.ids))
        real = anchor.astype(np.float64)
        length = float(np.sqrt((real * real).sum()))
        bound = length * self.longest
        if least > bound * (1 + _SLACK):
            return np.zeros(0, np.int64)
        cosine = min(1.0, least / bound)
        unit = real / length
        focus = np.argsort(-np.abs(unit), kind="stable")[:FOCUS]
        focus = focus[focus < self.width]
        angle = np.arccos(cosine)
        own = np.arccos(np.clip(unit[focus], -1, 1))
        low = np.cos(np.minimum(np.pi, own + angle)) - _SLACK
        high = np.cos(np.maximum(0.0, own - angle)) + _SLACK
        lists = [self.sorted_list(int(k)) for k in focus]
        cut = [(np.searchsorted(v, lo, "left"), np.searchsorted(v, hi, "right")) for (v, _), lo, hi in zip(lists, low, high)]
        if not cut:
            return np.arange(len(self.ids))
        order = sorted(range(len(cut)), key=lambda i: cut[i][1] - cut[i][0])
        first = order[0]
        found = lists[first][1][cut[first][0] : cut[first][1]]
        for i in order[1:]:
            values = self.unit[found, focus[i]]
            found = found[(values >= low[i]) & (values <= high[i])]
        return found[self.lengths[found] * length * (1 + _SLACK) >= least]

    def scores(self, anchor: np.ndarray, found: np.ndarray) -> np.ndarray:
        a = np.zeros(self.width, np.int64)
        a[: min(self.width, len(anchor))] = anchor[: self.width]
        rows = self.rows[found]
        most = self.most * float(np.abs(a.astype(np.float64)).max(initial=0.0)) * max(1, self.width)
        if most < 2**52:
            return (rows.astype(np.float64) @ a.astype(np.float64)).astype(np.int64)
        return rows @ a if most < 2**62 else rows.astype(object) @ a.astype(object)

    def best(self, anchor: np.ndarray, own: int, lows: list[int], highs: list[int], k: int) -> Iterator[tuple[int, int, int]]:
        """``(range, id, score)`` of the first ``k`` rows of every range of scores, rows with the id ``own`` left out."""
        found = self.candidates(anchor, min(lows))
        if not len(found):
            return
        scores, ids = self.scores(anchor, found), self.ids[found]
        for n, (low, high) in enumerate(zip(lows, highs)):
            at = np.flatnonzero((scores >= low) & (scores <= high) & (ids != own))
            if len(at) > 4 * k:
                floor = np.partition(scores[at], len(at) - k)[len(at) - k]
                at = at[scores[at] >= floor]
            for i in sorted(at.tolist(), key=lambda i: (-scores[i], ids[i]))[:k]:
                yield n, int(ids[i]), int(scores[i])


def _lists(column: pa.Array) -> list[np.ndarray]:
    flat, ends = column.flatten().to_numpy(), np.cumsum(column.value_lengths().fill_null(0).to_numpy())
    return [flat[a:b] for a, b in zip([0, *ends[:-1]], ends)]


def _visited(batches: Iterator[pa.RecordBatch], schema: pa.Schema, k: int) -> Iterator[pa.RecordBatch]:
    """Every block's rows (kind 0) come before its visits (kind 1)."""
    key, ids, vectors, block = None, [], [], None
    for batch in batches:
        columns = {n: batch.column(n) for n in batch.schema.names}
        keys = list(zip(*(columns[c].to_pylist() for c in _BLOCK)))
        kinds, whole = columns["__kind"].to_pylist(), _lists(columns["vector"])
        held = columns["id"].fill_null(_NO_ID).to_numpy()
        versions, lows, highs = (columns[c].to_pylist() for c in ("__version", "lows", "highs"))
        out = []
        for i, here in enumerate(keys):
            if here != key:
                key, ids, vectors, block = here, [], [], None
            if kinds[i] == 0:
                ids.append(held[i])
                vectors.append(whole[i].copy())
                continue
            if block is None:
                block = Block(np.array(ids, np.int64), vectors)
            for n, found, score in block.best(whole[i], held[i], lows[i], highs[i], k):
                out.append((int(held[i]), versions[i], n, None if found == _NO_ID else found, score))
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _visit(dealt: DataFrame, visits: DataFrame, k: int) -> DataFrame:
    """The first ``k`` rows of each anchor's ranges over all blocks that it visits."""
    rows = dealt.select(*_BLOCK, F.lit(0).alias("__kind"), "id", "vector")
    guests = visits.select(*_BLOCK, F.lit(1).alias("__kind"), F.col("anchor_id").alias("id"), "vector", "__version", "lows", "highs")
    both = guests.unionByName(rows, allowMissingColumns=True).repartition(*_BLOCK).sortWithinPartitions(*_BLOCK, "__kind")
    kinds = StructType.fromDDL(_FOUND)
    schema = to_arrow_schema(kinds)
    best = both.mapInArrow(lambda batches: _visited(batches, schema, k), kinds)
    order = Window.partitionBy("anchor_id", "__version", "range").orderBy(F.desc("score"), F.asc_nulls_last("id"))
    return best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def _visits(anchors: DataFrame, blocks: DataFrame, same_label: bool) -> DataFrame:
    """Anchors beside every block they may find rows in, met by slots so that no product of two tables is made at once."""
    slots = max(1, int(blocks.count() ** 0.5))
    spread = anchors.withColumn("__slot", F.explode(F.sequence(F.lit(0), F.lit(slots - 1))))
    dealt = blocks.withColumn("__slot", F.pmod(F.xxhash64(*_BLOCK), F.lit(slots)).cast("int"))
    if same_label:
        met = anchors.join(blocks, anchors["label"] == blocks["__label"])
    else:
        met = spread.join(dealt, (spread["__slot"] == dealt["__slot"]) & (spread["label"] != dealt["__label"]))
    least = F.array_min("lows").cast("double")
    reach = F.col("__norm") * F.col("__longest") * (1 + 1e-6)
    return met.filter((least <= 0) | (least <= reach)).select(*_BLOCK, "anchor_id", "__version", "vector", "lows", "highs")


def _one_of_each_label(blocks: DataFrame) -> DataFrame:
    order = Window.partitionBy("__label").orderBy(F.desc("__rows"), F.desc("__bucket"))
    return blocks.filter(F.col("__salt") == 0).withColumn("__first", F.row_number().over(order)).filter("__first = 1")


def _kth(found: DataFrame, k: int) -> DataFrame:
    """The k-th best score of each anchor and range, where there are k."""
    return found.filter(F.col("rank") == k).select("anchor_id", "__version", "range", F.col("score").alias("__reached"))


def mine(
    vectors: DataFrame, anchor: Column, id_col: str = "vec_id", label: str = "label", vector: str = "vector",
    positives: int = 5, negatives: int = 5, least_percent: int = 80,
) -> DataFrame:
    """``anchor_id, positive_id, rank, negative_id, positive_score, negative_score`` and ``positive_rank``.

    ``vectors`` hold whole numbers (see :func:`whole_numbers`); rows where the condition ``anchor`` holds are the anchors.
    A negative's score is at least ``least_percent`` of the positive's score and at most that score.
    """
    flagged = vectors.select(
        F.col(id_col).cast("bigint").alias("id"), F.col(label).alias("label"), F.col(vector).alias("vector"),
        (F.coalesce(anchor, F.lit(False)) & F.col(id_col).isNotNull()).alias("__anchor"),
    )
    dealt, blocks = _in_blocks(flagged)
    blocks = cut_lineage(blocks)
    few = _one_of_each_label(blocks)
    key = ["anchor_id", "__version"]
    anchors = cut_lineage(
        flagged.filter("__anchor")
        .select(F.col("id").alias("anchor_id"), F.xxhash64("label", "vector").alias("__version"), "label", "vector", _length(F.col("vector")).alias("__norm"))
        .dropDuplicates(key)
    )
    everything = {"lows": F.array(F.lit(_LEAST)), "highs": F.array(F.lit(_MOST))}
    seeds = _kth(_visit(dealt, _visits(anchors.withColumns(everything), few, same_label=True), positives), positives)
    known = anchors.join(seeds.drop("range"), key, "left").withColumns(
        {"lows": F.array(F.coalesce("__reached", F.lit(_LEAST))), "highs": everything["highs"]}
    )
    best = cut_lineage(_visit(dealt, _visits(known, blocks, same_label=True), positives))
    pairs = best.select(*key, F.col("id").alias("positive_id"), F.col("rank").alias("positive_rank"), F.col("score").alias("positive_score"))
    # the least whole number that is at least the share
    lowest = F.ceil(F.col("positive_score").cast("decimal(38,0)") * least_percent / 100).cast("bigint")
    ranges = (
        pairs.withColumn("low", lowest)
        .filter(F.col("low") <= F.col("positive_score"))
        .groupBy(*key)
        .agg(F.sort_array(F.collect_list(F.struct("positive_rank", "positive_id", "positive_score", "low"))).alias("ranges"))
    )
    asked = cut_lineage(anchors.join(ranges, key).withColumns({"lows": F.col("ranges.low"), "highs": F.col("ranges.positive_score")}))
    seeds = _kth(_visit(dealt, _visits(asked, few, same_label=False), negatives), negatives)
    reached = seeds.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("range", "__reached"))).alias("__reached"))
    raised = F.transform("lows", lambda low, n: F.greatest(low, F.coalesce(F.element_at("__reached", n), low)))
    known = asked.join(reached, key, "left").withColumn("lows", F.coalesce(raised, F.col("lows")))
    found = _visit(dealt, _visits(known, blocks, same_label=False), negatives)
    named = found.join(asked.select(*key, "ranges"), key).withColumn("pair", F.element_at("ranges", F.col("range") + 1))
    return named.select(
        "anchor_id",
        "pair.positive_id",
        F.col("rank").cast("int").alias("rank"),
        F.col("id").alias("negative_id"),
        "pair.positive_score",
        F.col("score").alias("negative_score"),
        "pair.positive_rank",
    )


ORACLE = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS vec
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
         CAST(list_inner_product(a.vec, b.vec) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score,
         CAST(row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS INTEGER) AS positive_rank
  FROM scored WHERE same QUALIFY positive_rank <= 5
)
SELECT p.anchor_id, p.positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor_id, p.positive_id ORDER BY s.score DESC, s.other_id) AS INTEGER) AS rank,
       s.other_id AS negative_id, p.positive_score, s.score AS negative_score, p.positive_rank
FROM positives p JOIN scored s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * p.positive_score <= 100 * s.score AND s.score <= p.positive_score
QUALIFY rank <= 5
"""
