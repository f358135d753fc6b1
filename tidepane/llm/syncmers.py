"""Document fingerprints from closed syncmers; built-in functions only.

The words of a text (between white space) are its symbols; a text of at most ``SHORT`` characters, or of over ``LONG_WORD``
characters a word (scripts without blanks), has its characters instead. A window of ``k`` symbols is an anchor if the least of
the hashes of its inner runs of ``s`` symbols is that of the first or the last run. That depends on the window alone, so
an edit elsewhere moves no anchor, and one of every ``k - s`` windows in a row is an anchor. A fingerprint holds all distinct
anchors of the text by hash, each with the position of its first place.

Anchors that two fingerprints share are put in order of their places in the first one. One counts if its shift, the
difference of its two places, is within ``SLACK`` of that of the shared anchor before or after it, so text may be put in or
taken out anywhere; an only shared anchor counts. The likeness is twice the anchors that count over the anchors of both.

Null texts count as empty. A text without an anchor (always if it has fewer than ``k`` symbols) has the hash of the
whole text for its only one. Equal texts have equal fingerprints. Next to a row stands the one with the next larger id,
after the last id the first; of rows with equal ids the one with the least text hash is taken. Rows without id have
no next row: their edited text ends where the last quarter began, and ``near_next`` is null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepane.session import cut_lineage

K = 4
S = 2
#: Symbols by which the shifts of neighbouring shared anchors may differ.
SLACK = 8
#: Texts of at most so many characters, and of more characters a word than this, are read by characters.
SHORT = 64
LONG_WORD = 16

WORD = r"[^\x20\x09-\x0D]+"
# An anchor is a long: 32 bits of hash, 24 of position, and a low bit that tells two fingerprints apart.
_POSITION_BITS = 24


def _symbols(text: str):
    """Hashes of the words of ``text`` (given as ``__w``), or of its characters."""
    by_character = (F.length(text) <= SHORT) | (F.length(text) > LONG_WORD * F.size("__w"))
    characters = F.regexp_extract_all(F.col(text), F.lit("(?s)."), F.lit(0))
    return F.transform(F.when(by_character, characters).otherwise(F.col("__w")), lambda w: F.xxhash64(w))


def with_sketch(docs: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """``docs`` with the anchors of ``text`` (not null) as a sorted ``array<bigint>`` in ``out``.

    Arrays that are read by index are columns of their own, made once for a text.
    """
    inner = k - s
    steps = docs.withColumn("__w", F.regexp_extract_all(F.col(text), F.lit(WORD), F.lit(0)))
    steps = steps.withColumn("__w", _symbols(text))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("__w") - s), lambda i: F.xxhash64(*[F.get("__w", i + j) for j in range(s)])
    )
    steps = steps.withColumn("__s", F.when(F.size("__w") >= k, runs))

    def closed(i):
        run = [F.get("__s", i + j) for j in range(inner + 1)]
        return F.least(run[0], run[-1]) == F.least(*run)

    def anchor(i):
        # runs s apart and, if k is no multiple of s, the last one cover all symbols of the window
        whole = F.xxhash64(*[F.get("__s", i + j) for j in sorted({*range(0, inner + 1, s), inner})])
        return _packed(whole, i)

    starts = F.filter(F.sequence(F.lit(0), F.size("__w") - k), closed)
    found = F.when(F.col("__s").isNotNull(), F.transform(starts, anchor))
    steps = steps.withColumn("__found", found)
    alone = F.array(_packed(F.xxhash64(text), F.lit(0)))
    steps = steps.withColumn("__all", F.when(F.size("__found") > 0, F.sort_array("__found")).otherwise(alone))
    # of anchors with equal hashes the first one
    first = F.filter("__all", lambda a, i: (i == 0) | (_hash(a) != _hash(F.get("__all", i - 1))))
    return steps.withColumn(out, first).drop("__w", "__s", "__found", "__all")


def _packed(hashed, position):
    place = F.least(position, F.lit((1 << _POSITION_BITS) - 1)).cast("bigint")
    return F.shiftleft(hashed.bitwiseAND(F.lit(0xFFFFFFFF)), _POSITION_BITS + 1) + F.shiftleft(place, 1)


def _hash(anchor):
    return F.shiftright(anchor, _POSITION_BITS + 1)


def _position(anchor):
    return F.shiftright(anchor, 1).bitwiseAND(F.lit((1 << _POSITION_BITS) - 1))


def _narrow(sketch: str):
    """A sketch in about six bytes an anchor for the way between tasks: hashes, and low and high parts of positions."""
    return F.struct(
        F.transform(sketch, lambda a: (_hash(a) - (1 << 31)).cast("int")).alias("hashes"),
        F.transform(sketch, lambda a: (_position(a) % (1 << 16) - (1 << 15)).cast("smallint")).alias("low"),
        F.transform(sketch, lambda a: (F.shiftright(_position(a), 16) - (1 << 7)).cast("tinyint")).alias("high"),
    )


def _wide(narrow: str):
    """The sketch that :func:`_narrow` was given; null for null."""

    def anchor(h, i):
        low = F.get(f"{narrow}.low", i).cast("bigint") + (1 << 15)
        high = F.get(f"{narrow}.high", i).cast("bigint") + (1 << 7)
        return F.shiftleft(h.cast("bigint") + (1 << 31), _POSITION_BITS + 1) + F.shiftleft(F.shiftleft(high, 16) + low, 1)

    return F.transform(f"{narrow}.hashes", anchor)


def as_text(sketch: str):
    """Anchors in hexadecimal, 8 digits of hash and 6 of position each."""
    return F.array_join(F.transform(sketch, lambda a: F.lower(F.lpad(F.hex(F.shiftright(a, 1)), 14, "0"))), "")


def with_likeness(docs: DataFrame, left: str, right: str, out: str) -> DataFrame:
    """Likeness from 0 to 1 of two sketches; null if one is null."""
    both = F.sort_array(F.concat(left, F.transform(right, lambda a: a.bitwiseOR(F.lit(1).cast("bigint")))))
    steps = docs.withColumn("__both", both)
    # a hash stands once in a sketch; where places are equal too, the left anchor comes first by its low bit
    ours = lambda a: a.bitwiseAND(F.lit(1).cast("bigint")) == 0
    twice = F.filter(
        F.sequence(F.lit(0), F.size("__both") - 2),
        lambda i: _hash(F.get("__both", i)) == _hash(F.get("__both", i + 1)),
    )

    def places(i):
        a, b = F.get("__both", i), F.get("__both", i + 1)
        x, y = _position(a), _position(b)
        return F.shiftleft(F.when(ours(a), x).otherwise(y), _POSITION_BITS) + F.when(ours(a), y).otherwise(x)

    shared = F.when(F.size("__both") > 1, F.sort_array(F.transform(twice, places)))
    shift = lambda p: p.bitwiseAND(F.lit((1 << _POSITION_BITS) - 1)) - F.shiftright(p, _POSITION_BITS)
    steps = steps.withColumn("__shifts", F.transform(shared, shift))
    near = lambda d, i: F.coalesce(F.abs(d - F.get("__shifts", i)) <= SLACK, F.lit(False))
    agreed = F.size(F.filter("__shifts", lambda d, i: near(d, i - 1) | near(d, i + 1) | (F.size("__shifts") == 1)))
    value = F.when(F.size("__both") > 0, 2.0 * F.greatest(agreed, F.lit(0)) / F.size("__both")).otherwise(F.lit(0.0))
    value = F.when(F.col("__both").isNotNull(), value)
    return steps.withColumn(out, value).drop("__both", "__shifts")


def next_ids(rows: DataFrame) -> DataFrame:
    """``id, take, next_id`` of each id of ``rows`` (``id, take``); ``take`` is the largest of equal ids.

    Ids alone are dealt by range and numbered inside the ranges; only the first id of each range meets the others.
    """
    ids = rows.filter("id IS NOT NULL").groupBy("id").agg(F.max("take").alias("take"))
    ranged = cut_lineage(ids.repartitionByRange("id").withColumn("part", F.spark_partition_id()))
    inside = ranged.withColumn("next_id", F.lead("id").over(Window.partitionBy("part").orderBy("id")))
    firsts = ranged.groupBy("part").agg(F.min("id").alias("first"))
    everything = Window.orderBy("part")  # a row per range
    firsts = firsts.select(
        F.col("part"),
        F.coalesce(F.lead("first").over(everything), F.first("first").over(everything)).alias("following"),
    )
    return inside.join(firsts, "part").select("id", "take", F.coalesce("next_id", "following").alias("next_id"))


def fingerprints(docs: DataFrame, text: str = "text", id_col: str = "doc_id", share: int = 4) -> DataFrame:
    """``id_col, n_chars, edited`` (text), sketches ``sketch``, ``edited_sketch``, ``next_sketch`` of each row.

    The last ``1 / share`` of a text's characters are replaced by as many first ones of the next text.
    """
    every = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = every.filter("id IS NOT NULL")  # on both sides of the joins below, so texts are dealt by id once
    measured = rows.withColumn("take", F.floor(F.length("text") / share).cast("int"))
    following = next_ids(measured.select("id", "take")).withColumnRenamed("id", "for_id")
    heads = rows.join(following, rows["id"] == following["next_id"]).select("for_id", "take", "text")
    heads = with_sketch(heads, "text", "next_sketch").select(
        "for_id", F.xxhash64("text").alias("h"), F.expr("substring(text, 1, take)").alias("head"), _narrow("next_sketch").alias("s")
    )
    # of several rows with the next id one is taken; the rows are placed by for_id for the join below in any case
    chosen = heads.groupBy("for_id").agg(F.min(F.struct("h", "head", "s")).alias("n"))
    joined = rows.join(chosen, rows["id"] == chosen["for_id"], "left").select(
        "id", "text", F.col("n.head").alias("head"), _wide("n.s").alias("next_sketch")
    )
    nothing = F.lit(None)
    joined = joined.union(
        every.filter("id IS NULL").select("id", "text", nothing.cast("string"), nothing.cast("array<bigint>"))
    )
    edited = F.expr(
        f"concat(substring(text, 1, length(text) - cast(floor(length(text) / {int(share)}) AS INT)), "
        f"substring(coalesce(head, ''), 1, cast(floor(length(text) / {int(share)}) AS INT)))"
    )
    joined = joined.withColumn("n_chars", F.length("text").cast("bigint")).withColumn("edited", edited)
    sketched = with_sketch(with_sketch(joined, "text", "sketch"), "edited", "edited_sketch")
    return sketched.select(
        F.col("id").alias(id_col), "n_chars", "edited", "sketch", "edited_sketch", "next_sketch"
    )
