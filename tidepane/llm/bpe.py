"""BPE encoding and decoding of whole texts: batched numpy merge rounds over many words at once.

All words of an Arrow batch are split off and made distinct inside Arrow, so a word that occurs often is merged
once. The symbols of the distinct words lie in one flat array; a round finds the merge rank of every neighbouring
pair by binary search over the sorted pair keys, takes the lowest rank of each word and joins those pairs. Words with no
mergeable pair leave the array, so rounds get smaller. A word of more than ``LONG_WORD`` symbols is merged with a heap
(same order, n log n), since rounds over one endless word would be quadratic.

Null texts count as empty and give no ids. Equal texts give equal ids on any executor; no row depends on another.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Symbols of a word above which it is merged on its own with a heap.
LONG_WORD = 400
#: Bytes of text worked on at a time inside a task; bounds the memory of a worker, not the result.
CHUNK_BYTES = 4 << 20

_NO_RANK = np.int32(2**31 - 1)
# White space of the tokenizer's pattern; unlike str.split() it leaves out U+001C to U+001F.
_WORD = regex.compile(r"[^\t-\r \x85\xa0  -     　]+")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    table, free = {}, 256
    for byte in range(256):
        if byte in plain:
            table[byte] = chr(byte)
        else:
            table[byte] = chr(free)
            free += 1
    return [table[b] for b in range(256)]


class WordBpe:
    """A word-level BPE vocabulary file: NFC, lower case, white space dropped, ``end_of_word_suffix`` on last symbols."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        vocab, end = model["vocab"], model["end_of_word_suffix"] or ""
        symbols = byte_symbols()
        self.byte_id = np.array([vocab[s] for s in symbols], np.int32)
        self.end_id = np.array([vocab[s + end] for s in symbols], np.int32)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("|".join(regex.escape(s) for s in self.special)) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.piece = regex.compile(split["pattern"]["Regex"])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 32) | vocab[b] for a, b in pairs], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int32)
        self.joined = np.array([vocab[a + b] for a, b in pairs], np.int32)
        size = max([*vocab.values(), *self.special.values()]) + 1
        names = [""] * size
        for token, i in [*vocab.items(), *self.special.items()]:
            names[i] = token
        self.tokens = pa.array(names, pa.string())

    # -- merging ---------------------------------------------------------------------------------------------------

    def rank_of(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Merge rank of each pair by binary search; ``_NO_RANK`` if the pair isn't merged."""
        key = (left.astype(np.int64) << 32) | right
        at = np.searchsorted(self.keys, key)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == key, self.ranks[at], _NO_RANK)

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of all pieces and their counts."""
        n = len(pieces)
        sizes = np.fromiter(map(len, pieces), np.int64, n)
        data = np.frombuffer(b"".join(pieces), np.uint8)
        ends = np.cumsum(sizes)
        symbols = self.byte_id[data]
        filled = sizes > 0
        symbols[ends[filled] - 1] = self.end_id[data[ends[filled] - 1]]
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for i in np.flatnonzero(sizes > LONG_WORD):
            ids = self.merge_long(symbols[ends[i] - sizes[i] : ends[i]])
            out.append((np.array([i]), np.array([len(ids)]), ids))
        usual = (sizes <= LONG_WORD) & filled
        word = np.flatnonzero(usual)
        symbols = symbols[np.repeat(usual, sizes)] if not usual.all() else symbols
        size = sizes[word]
        rank = None
        while len(word):
            start = np.cumsum(size) - size
            if rank is None:
                rank = np.full(len(symbols), _NO_RANK, np.int32)
                if len(symbols) > 1:
                    rank[:-1] = self.rank_of(symbols[:-1], symbols[1:])
                rank[start + size - 1] = _NO_RANK
            low = np.minimum.reduceat(rank, start)
            done = low == _NO_RANK
            if done.any():
                gone = np.repeat(done, size)
                out.append((word[done], size[done], symbols[gone]))
                symbols, rank = symbols[~gone], rank[~gone]
                word, size, low = word[~done], size[~done], low[~done]
                if not len(word):
                    break
            hit = rank == np.repeat(low, size)
            hit = self._alternate(hit)
            at = np.flatnonzero(hit)
            symbols[at] = self.joined[rank[at]]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            owner = np.repeat(np.arange(len(word)), size)
            size = size - np.bincount(owner[at], minlength=len(word))
            rank[at] = rank[at + 1]  # the right neighbour of the joined symbol, or the end of the word
            symbols, rank = symbols[keep], rank[keep]
            at = at - np.arange(len(at))  # places after the removal
            last = np.zeros(len(symbols), bool)
            last[np.cumsum(size) - 1] = True
            fresh = at[~last[at]]
            rank[at] = _NO_RANK
            rank[fresh] = self.rank_of(symbols[fresh], symbols[fresh + 1])
            before = at[at > 0] - 1
            before = before[~last[before]]
            rank[before] = self.rank_of(symbols[before], symbols[before + 1])
        counts = np.zeros(n, np.int64)
        for words, lengths, _ in out:
            counts[words] = lengths
        flat = np.empty(int(counts.sum()), np.int32)
        starts = np.cumsum(counts) - counts
        for words, lengths, ids in out:
            flat[spread(starts[words], lengths)] = ids
        return flat, counts

    @staticmethod
    def _alternate(hit: np.ndarray) -> np.ndarray:
        """In a run of overlapping equal pairs only every second one is joined, from the left."""
        run = hit[1:] & hit[:-1]
        if not run.any():
            return hit
        place = np.arange(len(hit))
        first = hit & ~np.concatenate(([False], hit[:-1]))
        begin = np.maximum.accumulate(np.where(first, place, 0))
        return hit & ((place - begin) % 2 == 0)

    def merge_long(self, symbols: np.ndarray) -> np.ndarray:
        """One long word: lowest rank first, leftmost first, with a heap over linked symbols."""
        ids = symbols.tolist()
        n = len(ids)
        after = [*range(1, n), -1]
        before = [-1, *range(n - 1)]
        table = self._table()
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := table.get((ids[i], ids[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            rank, i, a, b = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != a or ids[j] != b:
                continue
            ids[i], ids[j] = int(self.joined[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            after[j] = -1
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := table.get((ids[x], ids[y]))) is not None:
                    heapq.heappush(heap, (r, x, ids[x], ids[y]))
        return np.array([s for s in ids if s >= 0], np.int32)

    @lru_cache(maxsize=1)  # noqa: B019 - one vocabulary for a worker's life
    def _table(self) -> dict[tuple[int, int], int]:
        return dict(zip(zip((self.keys >> 32).tolist(), (self.keys & 0xFFFFFFFF).tolist()), self.ranks.tolist()))

    # -- whole texts -----------------------------------------------------------------------------------------------

    def words(self, texts: pa.Array) -> tuple[pa.DictionaryArray, np.ndarray]:
        """Words of all texts between white space, dictionary-encoded, and the number of words of each text."""
        odd = np.zeros(len(texts), bool)
        if has_separators(texts):
            odd |= pc.match_substring_regex(texts, "[\x1c-\x1f]").to_numpy(zero_copy_only=False)
        if self.special:
            for content in self.special:
                odd |= pc.match_substring(texts, content).to_numpy(zero_copy_only=False)
        if odd.any():
            lists = pa.array([self._odd_words(t) for t in texts.to_pylist()], pa.list_(pa.string()))
        else:
            lists = pc.utf8_split_whitespace(texts)
        flat, counts = lists.flatten(), np.diff(lists.offsets.to_numpy())
        empty = pc.equal(pc.binary_length(flat), 0).to_numpy(zero_copy_only=False)
        if empty.any():
            owner = np.repeat(np.arange(len(counts)), counts)
            counts = counts - np.bincount(owner[empty], minlength=len(counts))
            flat = flat.filter(pa.array(~empty))
        return flat.dictionary_encode(), counts

    def _odd_words(self, text: str) -> list[str]:
        if not self.special_pattern:
            return _WORD.findall(text)
        out, at = [], 0
        for m in self.special_pattern.finditer(text):
            out += [*_WORD.findall(text[at : m.start()]), m[0]]
            at = m.end()
        return out + _WORD.findall(text[at:])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) and the number of ids of each text."""
        coded, n_words = self.words(texts)
        ids, counts = self._encode_words(coded.dictionary.to_pylist())
        codes = coded.indices.to_numpy()
        starts = np.cumsum(counts) - counts
        each = counts[codes]
        flat = ids[spread(starts[codes], each)]
        bounds = np.concatenate(([0], np.cumsum(each)))
        upto = bounds[np.concatenate(([0], np.cumsum(n_words)))]
        return flat, np.diff(upto)

    def _encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        pieces: list[str] = []
        per_word = np.empty(len(words), np.int64)
        for k, word in enumerate(words):
            if word in self.special:
                pieces.append(word)
                per_word[k] = 1
                continue
            if not word.isascii():
                word = unicodedata.normalize("NFC", word).replace("Σ", "σ")
            word = word.lower()
            if word.isalpha():
                pieces.append(word)
                per_word[k] = 1
            else:
                found = self.piece.findall(word)
                pieces += found
                per_word[k] = len(found)
        coded = pa.array(pieces, pa.string()).dictionary_encode()
        names = coded.dictionary.to_pylist()
        ids, counts = self.merge([b"" if s in self.special else s.encode() for s in names])
        if any(s in self.special for s in names):
            ids, counts = self._insert_special(names, ids, counts)
        codes = coded.indices.to_numpy()
        starts = np.cumsum(counts) - counts
        each = counts[codes]
        total = np.concatenate(([0], np.cumsum(each)))
        at = np.concatenate(([0], np.cumsum(per_word)))
        return ids[spread(starts[codes], each)], np.diff(total[at])

    def _insert_special(self, names, ids, counts):
        parts = np.split(ids, np.cumsum(counts)[:-1])
        for k, name in enumerate(names):
            if name in self.special:
                parts[k] = np.array([self.special[name]], np.int32)
        return np.concatenate(parts), np.array([len(p) for p in parts], np.int64)

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Token strings joined by blanks, as a vocabulary without a decoder gives them."""
        offsets = np.concatenate(([0], np.cumsum(counts)))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.tokens.take(pa.array(ids)))
        return pc.binary_join(lists, " ")


def spread(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Positions ``starts[i] … starts[i] + counts[i] - 1`` of all i, in order."""
    total = int(counts.sum())
    before = np.cumsum(counts) - counts
    return np.repeat(starts - before, counts) + np.arange(total)


def has_separators(texts: pa.Array) -> bool:
    """Whether U+001C to U+001F, which split words in Python and Arrow but not in the tokenizer, occur at all."""
    data = texts.buffers()[-1]
    if data is None or not len(texts):
        return False
    bounds = np.frombuffer(texts.buffers()[1], np.int32)
    view = np.frombuffer(data, np.uint8)[bounds[texts.offset] : bounds[texts.offset + len(texts)]]
    return bool(((view >= 0x1C) & (view <= 0x1F)).any())


def chunks(texts: pa.Array, limit: int = CHUNK_BYTES) -> Iterator[pa.Array]:
    """Slices of about ``limit`` bytes with nulls made empty; one longer text makes a slice of its own."""
    return slices(pc.fill_null(texts, "").cast(pa.string()), limit)


def slices(texts: pa.Array, limit: int) -> Iterator[pa.Array]:
    """Consecutive slices of a string or binary array of about ``limit`` bytes each."""
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        done = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + limit, "right")))
        yield texts.slice(at, to - at)
        at = to


@lru_cache(maxsize=4)
def load(path: str) -> WordBpe:
    """One parsed vocabulary per worker process."""
    return WordBpe(path)


def encode_packed(text: str | Column, path: str) -> Column:
    """Ids of each text as little-endian unsigned 32-bit integers in a binary column; null texts give no bytes."""

    @F.arrow_udf("binary")
    def bpe_encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for batch in batches:
            done = [_packed(*bpe.encode(part)) for part in chunks(batch)]
            yield pa.concat_arrays(done) if done else pa.array([], pa.binary())

    return bpe_encode(F.col(text) if isinstance(text, str) else text)


def _packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts * 4))).astype(np.int32)
    buffers = [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))]
    return pa.Array.from_buffers(pa.binary(), len(counts), buffers)


def round_trip(text: str | Column, path: str) -> Column:
    """``ids`` (packed) and ``decoded`` of each text in one struct, made by one worker instead of one for each way."""

    @F.arrow_udf("ids binary, decoded string")
    def bpe_round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])
        for batch in batches:
            done = []
            for part in chunks(batch):
                ids, counts = bpe.encode(part)
                done.append(pa.StructArray.from_arrays([_packed(ids, counts), bpe.decode(ids, counts)], fields=list(kind)))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return bpe_round_trip(F.col(text) if isinstance(text, str) else text)


def encode(text: str | Column, path: str) -> Column:
    """Ids of each text as ``array<int>``; null and empty texts give an empty array."""

    @F.arrow_udf("array<int>")
    def bpe_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for batch in batches:
            done = []
            for part in chunks(batch):
                ids, counts = bpe.encode(part)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                done.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return bpe_ids(F.col(text) if isinstance(text, str) else text)


def decode_packed(ids: str | Column, path: str) -> Column:
    """The decoded text of packed ids: token strings joined by blanks, special tokens kept; null gives ''."""

    @F.arrow_udf("string")
    def bpe_decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        bpe = load(path)
        for batch in batches:
            done = []
            for part in slices(pc.fill_null(batch, b"").cast(pa.binary()), CHUNK_BYTES):
                counts = pc.binary_length(part).to_numpy(zero_copy_only=False).astype(np.int64) // 4
                ids = np.frombuffer(b"".join(part.to_pylist()), "<u4")
                done.append(bpe.decode(ids, counts))
            yield pa.concat_arrays(done) if done else pa.array([], pa.string())

    return bpe_decode(F.col(ids) if isinstance(ids, str) else ids)
