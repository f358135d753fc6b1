"""Quality classifier: hashed word n-grams, logistic regression by follow-the-regularised-leader, sparse dot products.

Words lie between white space. Each has two forms: itself in lower case, and its shape, in which runs of letters and
digits are written as one sign while punctuation stays. N-grams of both forms are hashed into ``2**bits`` places: words
and pairs of words, shapes, pairs and triples of shapes, and pairs whose two words are the same. The value of a place
is the share of the text's n-grams of that family that fall on it, so long and short texts are alike, and the score of
a text is the logistic function of a sparse dot product.

The model is fitted in one task on a bounded sample: the labelled rows with the smallest id hashes, ``sample_rows`` on
average. Everything else runs over all rows. Null and empty texts have no n-grams and score the model's bias. Without labelled rows
every score is 0.5. Ids, languages, sources and labels are never features.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.llm.bpe import slices

BITS = 18
#: Rows the model is fitted on, on average.
SAMPLE_ROWS = 8_000
CHUNK_BYTES = 4 << 20

_RUNS = re.compile(r"(?P<u>[^\W\d_a-zß-ÿ]{2,})|(?P<l>[^\W\d_]+)|(?P<d>\d+)|(?P<p>([^\w\s])\5*)")
_SIGN = {"u": "A", "l": "a", "d": "0"}
# Odd multipliers that tell the families of n-grams apart; any would do.
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x27D4EB2F165667C5], np.uint64)
#: Weight of each family: words, pairs of words, shapes, pairs of shapes, triples of shapes, same pairs.
FAMILIES = 6


def shape(word: str) -> str:
    """``Don't`` → ``a'a``, ``THE!!`` → ``A!``, ``x12`` → ``a0``."""
    if word.isalpha():
        return "A" if len(word) > 1 and word.isupper() else "a"
    return _RUNS.sub(lambda m: _SIGN.get(m.lastgroup) or m[0][0], word)


def _hash(text: str) -> int:
    return xxhash.xxh64_intdigest(text.encode("utf-8", "surrogatepass"))


def features(texts: pa.Array, bits: int = BITS) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each family the place of every n-gram and the number of n-grams of each text, in text order."""
    lists = pc.utf8_split_whitespace(texts)
    counts = np.diff(lists.offsets.to_numpy()).astype(np.int64)
    flat = lists.flatten()
    empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
    owner = np.repeat(np.arange(len(counts)), counts)
    if empty.any():
        counts = counts - np.bincount(owner[empty], minlength=len(counts))
        flat, owner = flat.filter(pa.array(~empty)), owner[~empty]
    coded = flat.dictionary_encode()
    codes = coded.indices.to_numpy()
    names = coded.dictionary.to_pylist()
    shapes: dict[str, int] = {}
    shape_of = np.empty(len(names), np.uint64)
    for k, name in enumerate(names):
        s = shape(name)
        if s not in shapes:
            shapes[s] = _hash("shape " + s)
        shape_of[k] = shapes[s]
    word = np.fromiter((_hash(n.lower()) for n in names), np.uint64, len(names))[codes]
    form = shape_of[codes]
    shift = np.uint64(64 - bits)
    pair = owner[1:] == owner[:-1] if len(owner) > 1 else np.zeros(0, bool)
    triple = owner[2:] == owner[:-2] if len(owner) > 2 else np.zeros(0, bool)
    same = codes[1:] == codes[:-1] if len(codes) > 1 else np.zeros(0, bool)

    def places(value: np.ndarray) -> np.ndarray:
        return ((value * _MIX[0]) >> shift).astype(np.int32)

    two, three = np.maximum(counts - 1, 0), np.maximum(counts - 2, 0)
    pairs = form[:-1] * _MIX[1] + form[1:] * _MIX[2]
    return [
        (places(word), counts),
        (places(word[:-1] * _MIX[1] + word[1:] * _MIX[3])[pair], two),
        (places(form), counts),
        (places(pairs)[pair], two),
        (places(form[:-2] * _MIX[3] + form[1:-1] * _MIX[1] + form[2:] * _MIX[2])[triple], three),
        (places(np.where(same, _MIX[1], _MIX[2]) + form[1:] * _MIX[3])[pair], two),
    ]


class FtrlModel:
    """Logistic regression with per-coordinate FTRL-proximal updates."""

    def __init__(self, bits: int = BITS, alpha: float = 0.5, beta: float = 1.0, l1: float = 1e-3, l2: float = 1e-4):
        self.alpha, self.beta, self.l1, self.l2 = alpha, beta, l1, l2
        self.z = np.zeros((1 << bits) + 1)  # the last place is the bias
        self.n = np.zeros_like(self.z)

    def weights(self, at: np.ndarray | slice) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        w = -(z - np.sign(z) * self.l1) / ((self.beta + np.sqrt(n)) / self.alpha + self.l2)
        return np.where(np.abs(z) <= self.l1, 0.0, w)

    def update(self, at: np.ndarray, x: np.ndarray, y: float) -> None:
        w = self.weights(at)
        p = 1 / (1 + np.exp(-np.clip(w @ x, -30, 30)))
        g = (p - y) * x
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[at] = n + g * g


def rows_of(texts: pa.Array, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Distinct places and their values of each text, with the bias as last place."""
    parts = features(texts, bits)
    bounds = [np.concatenate(([0], np.cumsum(c))) for _, c in parts]
    for i in range(len(texts)):
        at = [p[b[i] : b[i + 1]] for (p, _), b in zip(parts, bounds)]
        x = np.concatenate([np.full(len(a), 1 / max(len(a), 1)) for a in at])
        places, inverse = np.unique(np.concatenate(at), return_inverse=True)
        yield np.append(places, 1 << bits), np.append(np.bincount(inverse, x, minlength=len(places)), 1.0)


def fit(texts: pa.Array, labels: np.ndarray, bits: int = BITS, updates: int = SAMPLE_ROWS) -> np.ndarray:
    """Weights of a model run over the rows in their order, 4 to 40 times, until it has seen about ``updates`` rows.

    They are float32, to halve what is sent around.
    """
    epochs = min(40, max(4, updates // max(len(texts), 1)))
    model = FtrlModel(bits)
    rows = [(at, x.astype(np.float32)) for part in slices(texts, CHUNK_BYTES) for at, x in rows_of(part, bits)]
    for _ in range(epochs):
        for (at, x), y in zip(rows, labels):
            model.update(at, x, float(y))
    return model.weights(slice(None)).astype(np.float32)


def scores(texts: pa.Array, weights: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Score of each text: mean weight of its n-grams, family by family, through the logistic function."""
    total = np.full(len(texts), float(weights[-1]))
    for places, counts in features(texts, bits):
        sums = np.concatenate(([0.0], np.cumsum(weights[places], dtype=np.float64)))
        ends = np.cumsum(counts)
        total += (sums[ends] - sums[ends - counts]) / np.maximum(counts, 1)
    return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth row by a checksum of its id; a null id counts as an empty one."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def train(
    docs: DataFrame,
    labels: DataFrame,
    text: str = "text",
    id_col: str = "doc_id",
    label: str = "quality",
    sample_rows: int = SAMPLE_ROWS,
    bits: int = BITS,
) -> np.ndarray:
    """Weights fitted on a bounded sample of the labelled rows that aren't held out.

    A row is in the sample if the hash of its id is below a bound that lets ``sample_rows`` through on average; the
    bound is applied to both tables before they meet, so only the sample is shuffled.
    """
    known = labels.filter(F.col(label).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col))
    found = known.select(F.col(id_col).alias("__id"), F.col(label).cast("double").alias("__y"))
    share = min(1.0, sample_rows / max(found.count(), 1))
    bound = int(min(share * 2**63, 2**63 - 1))
    order = F.xxhash64("__id").bitwiseAND(F.lit(2**63 - 1))
    rows = docs.select(F.col(id_col).alias("__id"), F.coalesce(F.col(text), F.lit("")).alias("__text"))
    sample = (
        rows.filter(order <= bound)
        .join(found.filter(order <= bound), "__id")
        .select(order.alias("__order"), "__id", "__text", "__y")
        .repartition(1)
        .sortWithinPartitions("__order", "__id", "__y", F.xxhash64("__text"))
    )

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        texts = table.column("__text").combine_chunks().cast(pa.string())
        weights = fit(texts, table.column("__y").to_numpy(), bits)
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary())], ["weights"])

    row = sample.select("__text", "__y").mapInArrow(fitted, "weights binary").first()
    if row is None:
        return np.zeros((1 << bits) + 1, np.float32)
    return np.frombuffer(row.weights, np.float32)


def score(text: str | Column, weights: np.ndarray, bits: int = BITS) -> Column:
    """Quality of each text between 0 and 1; ``weights`` has ``2**bits + 1`` places, whatever the size of the table."""

    @F.arrow_udf("double")
    def quality(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            texts = pc.fill_null(batch, "").cast(pa.string())
            done = [scores(part, weights, bits) for part in slices(texts, CHUNK_BYTES)]
            yield pa.array(np.concatenate(done) if done else np.zeros(0))

    return quality(F.col(text) if isinstance(text, str) else text)
