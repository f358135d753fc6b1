"""SimHash near-duplicates: fingerprints, covering locality-sensitive hashing and components of their links.

Fingerprints that differ in at most two bits are linked. Structured masks make the search complete: every bit gets
one of the seven non-zero vectors of three bits, and table v keeps the bits whose vector has an odd product
with v. Two differing bits span at most two dimensions, so some v is orthogonal to both and their table keeps neither:
the pair has one key there. Only distinct fingerprints are searched; a bucket of two is compared directly. In a larger
bucket no pairs are made: each fingerprint names the values within one bit of it that agree with the key, and two
fingerprints are at most two bits apart exactly if they share such a value. A value is shared by 65 fingerprints at
most, so work stays linear in the size of a bucket, however hot it is.

Null texts count as empty; texts without words have fingerprint zero and are linked like any others. Equal texts have
equal fingerprints. Rows with equal ids are rows of their own. A component of rows without ids has a null id.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.llm.components import component_roots
from tidepane.session import cut_lineage

BITS = 64
#: Shingles whose bits are counted at a time, to bound the memory of a long text.
BLOCK = 1 << 15


def hashes_fingerprint(hashes: np.ndarray) -> int:
    """Unsigned fingerprint of the hashes of a text's shingles, repeats included."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), BLOCK):
        octets = hashes[at : at + BLOCK].astype("<u8").view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    set_bits = np.packbits((2 * counts > len(hashes)).astype(np.uint8), bitorder="little")
    return int(set_bits.view("<u8")[0])


def text_fingerprint(text: bytes, shingle: int = 3) -> int:
    """Unsigned fingerprint of a UTF-8 text: bit set if it is set in over half the shingle hashes."""
    words = text.lower().split()  # on bytes: A-Z only, and blanks U+0009-U+000D and U+0020 only
    if not words:
        return 0
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    span = min(shingle, len(words))
    first, last = starts[: len(words) - span + 1].tolist(), ends[span - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    return hashes_fingerprint(np.fromiter((digest(joined[a:b], 42) for a, b in zip(first, last)), "<u8", len(first)))


def fingerprint(text: str | Column, shingle: int = 3) -> Column:
    """Fingerprint of each text as a long with the same 64 bits."""

    @F.arrow_udf("bigint")
    def simhash(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch, "").cast(pa.binary())
            out = np.fromiter((text_fingerprint(t.as_py(), shingle) for t in texts), np.uint64, len(texts))
            yield pa.array(out.view(np.int64))

    return simhash(F.col(text) if isinstance(text, str) else text)


def covering_masks(bits: int = BITS, radius: int = 2) -> list[int]:
    """Masks, seven for a radius of two, of which one keeps none of any ``radius`` given bits."""
    last = (2 << radius) - 1
    vectors = [1 + i % last for i in range(bits)]
    return [sum(1 << i for i, m in enumerate(vectors) if (m & v).bit_count() % 2) for v in range(1, last + 1)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >= 1 << 63 else value


def links(prints: DataFrame) -> DataFrame:
    """Links ``u, v`` that connect all fingerprints within two bits. ``prints`` has distinct values in ``fp``."""
    masks = covering_masks()
    tables = F.array(*[
        F.struct(F.lit(k).alias("t"), F.col("fp").bitwiseAND(F.lit(_signed(m))).alias("key")) for k, m in enumerate(masks)
    ])
    keyed = prints.select("fp", F.inline(tables))
    buckets = (
        keyed.groupBy("t", "key")
        .agg(F.count(F.lit(1)).alias("n"), F.min("fp").alias("u"), F.max("fp").alias("v"))
        .filter("n > 1")
    )
    buckets = cut_lineage(buckets)
    pairs = buckets.filter("n = 2").filter("bit_count(u ^ v) <= 2").select("u", "v")
    # values within one bit that agree with the key: the fingerprint itself and a flip of each bit the mask leaves out;
    # the bits are gathered over the tables first, so that a fingerprint names each value once
    free = F.array(*[F.lit(_signed(~m & (1 << BITS) - 1)) for m in masks])
    flips = F.array(F.lit(0).cast("bigint"), *[F.lit(_signed(1 << i)) for i in range(BITS)])
    crowded = buckets.filter("n > 2").select("t", "key")
    loose = keyed.join(crowded, ["t", "key"]).groupBy("fp").agg(F.bit_or(free[F.col("t")]).alias("free"))
    named = F.filter(flips, lambda b: (b == 0) | (F.col("free").bitwiseAND(b) != 0))
    near = loose.select("fp", F.explode(F.transform(named, lambda b: F.col("fp").bitwiseXOR(b))).alias("value"))
    hubs = near.groupBy("value").agg(F.min("fp").alias("u"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    stars = near.join(hubs.select("value", "u"), "value").filter("fp <> u").select("u", F.col("fp").alias("v"))
    return pairs.union(stars).distinct()


def hub_links(prints: DataFrame, radius: int) -> DataFrame:
    """Pairs ``u, v`` of fingerprints within ``radius`` bits, one of them the least of a bucket.

    Every two fingerprints so near share a bucket; work is linear in it. For callers that have a way of their own for the
    pairs of a bucket without its least one.
    """
    keys = [F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for k, m in enumerate(covering_masks(radius=radius))]
    keyed = prints.select("fp", F.explode(F.array(*keys)).alias("key"))
    hubs = keyed.groupBy("key").agg(F.min("fp").alias("u"), F.max("fp").alias("other")).filter("u < other").select("key", "u")
    near = keyed.join(hubs, "key").filter((F.col("fp") != F.col("u")) & (F.expr("bit_count(fp ^ u)") <= radius))
    return near.select("u", F.col("fp").alias("v")).distinct()


def classes(rows: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``fp, component_id`` of each distinct fingerprint of ``rows``; the id is the smallest one of the component."""
    distinct = cut_lineage(rows.groupBy("fp").agg(F.min(id_col).alias("rep")))
    roots = component_roots(links(distinct.select("fp")))
    rooted = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn(
        "root", F.coalesce("root", "fp")
    )
    smallest = rooted.groupBy("root").agg(F.min("rep").alias("component_id"))
    return rooted.join(smallest, "root").select("fp", "component_id")


def near_duplicates(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``id_col``, ``fingerprint`` (long) and ``component_id`` of each row of ``docs``."""
    rows = cut_lineage(docs.select(F.col(id_col), fingerprint(text, shingle).alias("fp")))
    return rows.join(classes(rows, id_col), "fp").select(id_col, F.col("fp").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", id_col: str = "doc_id", shingle: int = 3) -> DataFrame:
    """``docs`` with one row of each component: that of the smallest id, the first of equal ids by its columns' hash."""
    printed = docs.withColumn("__fp", fingerprint(text, shingle))
    rows = cut_lineage(printed.select(F.col(id_col), F.col("__fp").alias("fp")))
    known = classes(rows, id_col).select(F.col("fp").alias("__fp"), F.col("component_id").alias("__component"))
    first = printed.join(known, "__fp").filter(F.col(id_col).eqNullSafe(F.col("__component")))
    return first.dropDuplicates(["__component"]).select(*docs.columns)
