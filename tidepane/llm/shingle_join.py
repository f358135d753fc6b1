"""Near copies by SimHash and the exact Jaccard similarity of their word shingles: every pair of at least 0.8 is linked.

First the method of ``simhash.py``, with a wider radius: texts meet by fingerprints of their shingles under covering masks, and
what is within ``RADIUS`` bits is compared exactly. Texts of similarity 0.8 differ in up to 20 of 64 bits, more than masks can
cover, so what it leaves apart is joined by shingles, which misses no pair.

The shingles of a text are hashed to 64 bits and put into one order for the whole table. Two sets of similarity 0.8
share a shingle among the first ``n - ceil(0.8 n) + 1`` of each, so texts meet by these prefixes and no pair is missed. Shingles
that are frequent in a sample of texts come last in the order. The sample only saves work: any order finds all pairs. Of texts
that meet, sizes, places of the shared shingle and a parity bitmap of the set (bits that differ are at most the shingles that differ)
each bound the overlap from above; what is left is compared exactly.

In each bucket all texts are first compared with one of them, which is linear in the bucket: the one whose prefix is shared
most, as the text that a group was edited from is near more of the group than the edited ones are. Only texts of one bucket
that are then still in different components are compared in pairs, within one class of sizes and its neighbour, so a
large group of near copies makes no squares. A pair is wanted in the bucket of its first shared shingle alone, where all that
stands before it in either text counts as different; most of the other buckets that it shares drop out by that.

Null texts count as empty; texts without words are all alike. Texts of equal words are one class, known by a 64-bit hash
of them. Rows with equal ids are rows of their own. A component of rows without ids has a null id.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.llm.bpe import slices
from tidepane.llm.components import component_roots
from tidepane.llm.simhash import hashes_fingerprint, hub_links
from tidepane.operators.joins import attach
from tidepane.session import cut_lineage

#: Bits by which fingerprints of texts that are compared first differ at most; 31 masks cover it.
RADIUS = 4
#: Texts whose shingles are counted for the order, and the most shingles that go last.
SAMPLE_TEXTS = 5_000
FREQUENT = 200_000
#: Bytes of text whose shingles are held at a time in a task; doesn't change a result.
CHUNK_BYTES = 4 << 20
#: Least longs of a parity bitmap; it has at least a bit for each shingle, so long texts are told apart as well.
WIDTH = 8


def _words(text: bytes) -> list[bytes]:
    return text.lower().split()  # on bytes: A-Z only, and blanks U+0009-U+000D and U+0020 only


def text_class(text: str | Column) -> Column:
    """A long that texts of equal words share."""

    @F.arrow_udf("bigint")
    def hashed(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch, "").cast(pa.binary())  # one text at a time becomes a Python object
            out = (xxhash.xxh64_intdigest(b" ".join(_words(t.as_py())), 7) for t in texts)
            yield pa.array(np.fromiter(out, np.uint64, len(texts)).view(np.int64))

    return hashed(F.col(text) if isinstance(text, str) else text)


def shingle_hashes(text: bytes, shingle: int) -> np.ndarray:
    """Hashes of the shingles of a text, repeats included; a text of fewer words is one shingle."""
    words = _words(text)
    if not words:
        return np.empty(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    first, last = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    return np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), np.uint64, len(first))


def shingle_set(text: bytes, shingle: int) -> np.ndarray:
    """Distinct hashes of the shingles of a text, rising."""
    return np.unique(shingle_hashes(text, shingle).view(np.int64))


def prefix_length(n: int) -> int:
    """Shingles of a set of ``n`` of which a set of similarity 0.8 must hold one."""
    return n - -(-4 * n // 5) + 1


def _parity(hashes: np.ndarray) -> np.ndarray:
    wide = max(64 * WIDTH, 1 << (len(hashes) - 1).bit_length()) if len(hashes) else 64 * WIDTH
    bits = np.bincount((hashes >> 8) & (wide - 1), minlength=wide) & 1
    return np.packbits(bits.astype(np.uint8), bitorder="little").view("<i8")


def _by_size(batches: Iterator[pa.RecordBatch], at: int) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Parts of the batches with about ``CHUNK_BYTES`` of text in column ``at``, and that text without nulls."""
    for batch in batches:
        done = 0
        for texts in slices(pc.fill_null(batch.column(at), "").cast(pa.binary()), CHUNK_BYTES):
            yield batch.slice(done, len(texts)), texts
            done += len(texts)


def _sets(docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """``docs`` (of few columns) with ``text`` replaced by ``shingles`` (array)."""
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _by_size(batches, at):
            found = pa.array([shingle_set(t.as_py(), shingle) for t in texts], pa.list_(pa.int64()))
            left = [batch.column(k) for k in range(batch.num_columns) if k != at]
            names = [c for k, c in enumerate(batch.schema.names) if k != at]
            yield pa.RecordBatch.from_arrays([*left, found], [*names, "shingles"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in docs.dtypes if c != text)
    return docs.mapInArrow(run, f"{kinds}{', ' if kinds else ''}shingles array<bigint>")


def frequent(docs: DataFrame, text: str, shingle: int) -> np.ndarray:
    """Shingles that stand in more than one text of a sample, rising."""
    share = max(1, docs.count() // SAMPLE_TEXTS)
    sample = docs.select(text).filter(F.pmod(F.xxhash64(text), F.lit(share)) == 0).distinct()
    counted = _sets(sample, text, shingle).select(F.explode("shingles").alias("s")).groupBy("s").count().filter("count > 1")
    row = counted.orderBy(F.desc("count"), "s").limit(FREQUENT).agg(F.sort_array(F.collect_list("s")).alias("all")).first()
    return np.array(row["all"], np.int64)


def signatures(docs: DataFrame, text: str, id_col: str, shingle: int, last: np.ndarray) -> DataFrame:
    """``id, cls, fp, n, parity, narrow, prefix`` of each row; ``last`` are the shingles that come last in the order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in _by_size(batches, 2):
            prints, sizes, parities, narrow, prefixes = [], [], [], [], []
            for t in texts:
                hashes = shingle_hashes(t.as_py(), shingle)
                prints.append(hashes_fingerprint(hashes))
                found = np.unique(hashes.view(np.int64))
                sizes.append(len(found))
                parities.append(_parity(found))
                narrow.append(np.bitwise_xor.reduce(parities[-1].reshape(-1, WIDTH), axis=0))
                need = prefix_length(len(found)) if len(found) else 0
                late = np.isin(found, last, assume_unique=True) if len(last) else np.zeros(len(found), bool)
                prefixes.append(np.concatenate((found[~late], found[late]))[:need])
            longs = pa.list_(pa.int64())
            signed = pa.array(np.array(prints, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), signed, pa.array(sizes, pa.int64()), pa.array(parities, longs), pa.array(narrow, longs), pa.array(prefixes, longs)],
                ["id", "cls", "fp", "n", "parity", "narrow", "prefix"],
            )

    kind = dict(docs.dtypes)[id_col]
    given = docs.select(F.col(id_col).alias("id"), text_class(text).alias("cls"), F.col(text).alias("text"))
    return given.mapInArrow(run, f"id {kind}, cls bigint, fp bigint, n bigint, parity array<bigint>, narrow array<bigint>, prefix array<bigint>")


def _may_meet() -> Column:
    """Whether members ``a`` and ``b`` of a bucket can have a similarity of 0.8 by their sizes, places and narrow bitmaps if its
    shingle is the first one they share: 9 shared >= 4 of both sizes."""
    n, m, i, j = (F.col(c) for c in ("a.n", "b.n", "a.i", "b.i"))
    flips = F.zip_with("a.narrow", "b.narrow", lambda k, l: F.bit_count(k.bitwiseXOR(l)))
    return (
        (F.least(n, m) * 5 >= F.greatest(n, m) * 4)
        & (F.least(n - i, m - j) * 9 >= (n + m) * 4)
        & (F.aggregate(flips, F.lit(0), lambda s, k: s + k) * 9 <= n + m)
    )


def _size_class() -> Column:
    """Sizes of which the smaller is 0.8 of the larger or more are one class apart at most."""
    return F.floor(F.log(F.greatest(F.col("n"), F.lit(1))) / math.log(1.26)).cast("int")


def _alike(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    """Those of ``pairs`` (classes ``u, v``) whose parity bitmaps allow a similarity of 0.8.

    Bitmaps are as long as their texts, so they are fetched once for each pair; the rows of buckets hold one of fixed
    width, the exclusive or of its parts.
    """
    left = facts.select(F.col("cls").alias("u"), F.col("n").alias("n"), F.col("parity").alias("x"))
    right = facts.select(F.col("cls").alias("v"), F.col("n").alias("m"), F.col("parity").alias("y"))
    both = pairs.join(left, "u").join(right, "v")
    # the halves of a bitmap together are the bitmap of half the width; near sizes have equal widths or one the double
    x, y = F.col("x"), F.col("y")
    wide = F.least(F.size(x), F.size(y))
    half = lambda p: F.when(F.size(p) == wide, p).otherwise(
        F.zip_with(F.slice(p, 1, wide), F.slice(p, wide + 1, wide), lambda k, l: k.bitwiseXOR(l))
    )
    flips = F.zip_with(half(x), half(y), lambda k, l: F.bit_count(k.bitwiseXOR(l)))
    differing = F.aggregate(flips, F.lit(0), lambda s, k: s + k)
    return both.filter(differing * 9 <= F.col("n") + F.col("m")).select("u", "v")


def _confirmed(pairs: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Those of ``pairs`` (classes ``u, v``) whose exact similarity is 0.8 or more."""
    wanted = pairs.select(F.col("u").alias("cls")).union(pairs.select("v")).distinct()
    classed = docs.select(text_class(text).alias("cls"), F.col(text).alias("text"))
    held = attach(classed, wanted, ["cls"], "inner").dropDuplicates(["cls"])
    sets = cut_lineage(_sets(held, "text", shingle))
    left = sets.select(F.col("cls").alias("u"), F.col("shingles").alias("x"))
    right = sets.select(F.col("cls").alias("v"), F.col("shingles").alias("y"))
    joined = pairs.join(left, "u").join(right, "v")
    shared = F.size(F.array_intersect("x", "y"))
    return joined.filter(shared * 9 >= (F.size("x") + F.size("y")) * 4).select("u", "v")


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """Those of ``pairs`` (classes ``u, v``) that are in different components."""
    left = roots.select(F.col("cls").alias("u"), F.col("root").alias("x"))
    right = roots.select(F.col("cls").alias("v"), F.col("root").alias("y"))
    both = pairs.join(left, "u", "left").join(right, "v", "left")
    return both.filter(F.coalesce("x", "u") != F.coalesce("y", "v")).select("u", "v")


def _printed_alike(facts: DataFrame, docs: DataFrame, text: str, shingle: int) -> DataFrame:
    """Links ``u, v`` of classes whose fingerprints are near and whose exact similarity is 0.8 or more."""
    prints = cut_lineage(facts.groupBy("fp").agg(F.min("cls").alias("least")))
    equal = facts.join(prints, "fp").filter("cls <> least").select(F.col("least").alias("u"), F.col("cls").alias("v"))
    near = hub_links(prints.select("fp"), RADIUS)
    near = near.join(prints.select(F.col("fp").alias("u"), F.col("least").alias("x")), "u")
    near = near.join(prints.select(F.col("fp").alias("v"), F.col("least").alias("y")), "v")
    pairs = equal.union(near.select(F.least("x", "y").alias("u"), F.greatest("x", "y").alias("v")))
    return cut_lineage(_confirmed(cut_lineage(_alike(pairs, facts)), docs, text, shingle))


def classes(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5) -> DataFrame:
    """``cls, root, component_id`` of each class of texts; the id is the smallest one of the component."""
    signed = cut_lineage(signatures(docs, text, id_col, shingle, frequent(docs, text, shingle)))
    facts = signed.groupBy("cls").agg(F.min("id").alias("rep"), *[F.first(c).alias(c) for c in ("fp", "n", "parity", "narrow")])
    facts = cut_lineage(facts)
    links = _printed_alike(facts, docs, text, shingle)
    roots = component_roots(links).withColumnRenamed("node", "cls")

    keyed = signed.select("cls", F.posexplode("prefix").alias("i", "key"))
    shared = keyed.groupBy("key").agg(F.count(F.lit(1)).alias("crowd"), F.min("cls").alias("x"), F.max("cls").alias("y"))
    met = keyed.join(shared.filter("x < y").select("key", "crowd"), "key").distinct()
    members = cut_lineage(met.join(facts.select("cls", "n", "narrow"), "cls"))

    pull = members.groupBy("cls").agg((F.sum("crowd") / (F.first("n") + 4)).alias("pull"))
    chosen = members.select("key", "cls", "i").join(pull, "cls").groupBy("key").agg(F.max(F.struct("pull", "cls", "i")).alias("hub"))
    chosen = cut_lineage(chosen.select("key", F.col("hub.cls").alias("cls"), F.col("hub.i").alias("i")))
    hubs = chosen.join(facts.select("cls", "n", "narrow"), "cls").alias("a")
    stars = hubs.join(members.alias("b"), (F.col("a.key") == F.col("b.key")) & (F.col("a.cls") != F.col("b.cls")) & _may_meet())
    stars = _apart(stars.select(F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v")).distinct(), roots)
    stars = cut_lineage(_alike(stars, facts))
    links = cut_lineage(links.union(_confirmed(stars, docs, text, shingle)))
    roots = component_roots(links).withColumnRenamed("node", "cls")

    rooted = members.join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    split = rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).filter("x < y").select("key")
    split = split.join(chosen.select("key", F.col("cls").alias("hub")), "key")
    rest = rooted.join(split, "key").filter("cls <> hub").withColumn("size", _size_class())
    rest = cut_lineage(rest.select("key", "size", "cls", "i", "n", "narrow", "root"))
    # sizes of near texts are in one class or in neighbouring ones
    near = rest.withColumn("size", F.explode(F.array(F.col("size"), F.col("size") + 1)))
    pairs = rest.alias("a").join(
        near.alias("b"),
        (F.col("a.key") == F.col("b.key"))
        & (F.col("a.size") == F.col("b.size"))
        & (F.col("a.cls") != F.col("b.cls"))
        & (F.col("a.root") != F.col("b.root"))
        & _may_meet(),
    )
    pairs = pairs.select(F.least("a.cls", "b.cls").alias("u"), F.greatest("a.cls", "b.cls").alias("v")).distinct()
    pairs = cut_lineage(_alike(pairs.join(stars, ["u", "v"], "left_anti"), facts))
    links = cut_lineage(links.union(_confirmed(pairs, docs, text, shingle)))
    roots = component_roots(links).withColumnRenamed("node", "cls")
    rooted = facts.select("cls", "rep").join(roots, "cls", "left").withColumn("root", F.coalesce("root", "cls"))
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(smallest, "root").select("cls", "root", "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 5) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, any one of equal ids."""
    known = classes(docs, text, id_col, shingle).select(
        F.col("cls").alias("__cls"), F.col("root").alias("__root"), F.col("component_id").alias("__component")
    )
    printed = docs.withColumn("__cls", text_class(text)).join(known, "__cls")
    first = printed.filter(F.col(id_col).eqNullSafe(F.col("__component")))
    return first.dropDuplicates(["__root"]).select(*docs.columns)
