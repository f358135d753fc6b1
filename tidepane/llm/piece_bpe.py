"""SentencePiece encoding and decoding of whole texts for models of the merge type, by backtracking.

The encoding of a text under a merge-type model is the only sequence of pieces in which the first piece and every two
neighbours are what merging their own characters gives. So it is found from left to right without merging the text:
an Aho-Corasick automaton over all pieces gives the longest piece at every place; the longest one that agrees with the
piece before it is taken, and if none does, the last piece is given back and a shorter one tried. A place from which no
piece led on is marked in a bitfield and not entered again, so the work is linear in the text. Whether two pieces agree
is found by merging their characters anew, once for each pair a worker meets (``PAIRS`` of them are remembered).

Texts are cut where no piece of the vocabulary can reach over (before a blank that follows another character, if the
vocabulary has no piece with such an inside), and equal cuts of a batch are encoded once. Characters outside the
vocabulary become bytes. Null texts count as empty and give the begin and end ids only; no row depends on another.

Read are models of type BPE with byte fallback, without a character map, with or without the leading blank; others
raise ValueError.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

from tidepane.llm.bpe import chunks, slices, spread

#: Pairs of pieces remembered in a worker; all are forgotten when there are more. Doesn't change a result.
PAIRS = 400_000
#: Bytes of text (of packed ids) worked on at a time inside a task.
CHUNK_BYTES = 4 << 20

# The model file's mark for a blank, its kinds of pieces and of models.
BLANK = "▁"
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
BPE_MODEL = 2


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        value |= (data[at] & 127) << shift
        shift += 7
        at += 1
        if data[at - 1] < 128:
            return value, at


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Numbered fields of a protocol-buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        if key & 7 == 0:
            value, at = _varint(data, at)
        else:
            size, at = _varint(data, at) if key & 7 == 2 else ({1: 8, 5: 4}[key & 7], at)
            value, at = data[at : at + size], at + size
        yield key >> 3, value


class PieceBpe:
    """One merge-type vocabulary; blanks stand for its blank mark throughout."""

    def __init__(self, path: str):
        with open(path, "rb") as file:
            model = list(_fields(file.read()))
        trainer = dict(_fields(next(v for k, v in model if k == 2)))
        rules = dict(_fields(next(v for k, v in model if k == 3)))
        if trainer.get(3, 1) != BPE_MODEL or not trainer.get(35) or rules.get(2) or rules.get(4, 1) or not rules.get(5, 1):
            raise ValueError(f"not a merge-type model with byte fallback and plain texts: {path}")
        self.lead = bool(rules.get(3, 1))
        self.begin, self.end = trainer.get(41, 1), trainer.get(42, 2)
        self.names: list[str] = []
        self.size: list[int] = []
        self.kinds: list[int] = []
        self.rank: dict[str, float] = {}
        for token, piece in enumerate(v for k, v in model if k == 1):
            fields = dict(_fields(piece))
            kind = fields.get(3, NORMAL)
            name = fields[1].decode().replace(BLANK, " ")
            if kind not in (NORMAL, UNKNOWN, CONTROL, BYTE):
                raise ValueError(f"pieces of kind {kind} are not read: {path}")
            self.names.append(name)
            self.size.append(len(name))
            self.kinds.append(kind)
            if kind == NORMAL:
                self.rank[name] = -struct.unpack("<f", fields.get(2, bytes(4)))[0]
        self.of_byte = [0] * 256
        self.automaton = ahocorasick.Automaton()
        for token, (name, kind) in enumerate(zip(self.names, self.kinds)):
            if kind == BYTE:
                self.of_byte[int(name[1:-1], 16)] = token
            elif kind == NORMAL:
                self.automaton.add_word(name, token)
        #: The longest piece that is a proper beginning of each piece, or -1.
        self.shorter = [-1] * len(self.names)
        for name in self.rank:
            for size in range(len(name) - 1, 0, -1):
                if name[:size] in self.rank:
                    self.shorter[self.automaton.get(name)] = self.automaton.get(name[:size])
                    break
        self.automaton.make_automaton()
        self.cut_at_blanks = not any(" " in name.lstrip(" ") for name in self.rank)
        self.agree: dict[int, bool] = {}
        unknown = trainer.get(44, " ⁇ ".encode())
        table = [n.encode() for n in self.names]
        for token, kind in enumerate(self.kinds):
            if kind != NORMAL:
                table[token] = {UNKNOWN: unknown, CONTROL: b""}.get(kind) if kind != BYTE else bytes([int(self.names[token][1:-1], 16)])
        self.table = pa.array(table, pa.binary())
        self.is_byte = np.array([k == BYTE for k in self.kinds])
        self.starts_blank = np.array([k == NORMAL and n[0] == " " for n, k in zip(self.names, self.kinds)])

    # -- encoding --------------------------------------------------------------------------------------------------

    def agrees(self, left: int, right: int) -> bool:
        """Whether merging the characters of both pieces gives these two; ``left`` -1: whether it gives ``right``."""
        key = (left << 32) + right
        known = self.agree.get(key)
        if known is None:
            if len(self.agree) >= PAIRS:
                self.agree.clear()
            known = self.agree[key] = self._remerge(self.names[left] if left >= 0 else "", self.names[right])
        return known

    def _remerge(self, left: str, right: str) -> bool:
        rank, symbols, border = self.rank, [*left, *right], len(left)
        while True:
            best = at = None
            for i in range(len(symbols) - 1):
                r = rank.get(symbols[i] + symbols[i + 1])
                if r is not None and (best is None or r < best):
                    best, at = r, i
            if at is None:
                return len(symbols) == (2 if left else 1)
            if at == border - 1:
                return False  # a merge over the border is never undone
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
            border -= at < border

    def pieces(self, text: str) -> list[int]:
        """Pieces of one cut, with blanks for the vocabulary's blank mark."""
        whole = self.automaton.get(text, -1)
        if whole >= 0 and self.agrees(-1, whole):
            return [whole]
        size = self.size
        longest = [-1] * len(text)
        for last, token in self.automaton.iter(text):
            longest[last + 1 - size[token]] = token  # of pieces from one place the longest ends last
        if -1 not in longest:
            return self._backtrack(longest, 0, len(text))
        longest.append(-1)
        out: list[int] = []
        at = 0
        while at < len(text):
            if longest[at] < 0:
                out += [self.of_byte[b] for b in text[at].encode()]
                at += 1
            else:
                to = longest.index(-1, at)
                out += self._backtrack(longest, at, to)
                at = to
        return out

    def _backtrack(self, longest: list[int], at: int, to: int) -> list[int]:
        """Pieces of the known characters from ``at`` to ``to``."""
        size, shorter, agree = self.size, self.shorter, self.agree
        failed = bytearray((to - at >> 3) + 1)
        base, path, before = at, [], -1
        token = longest[at]
        while True:
            while token >= 0:
                end = at + size[token]
                bit = end - base
                if not failed[bit >> 3] >> (bit & 7) & 1:
                    fits = agree.get((before << 32) + token)
                    if self.agrees(before, token) if fits is None else fits:
                        break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                if end == to:
                    return path
                at, before, token = end, token, longest[end]
            else:
                bit = at - base
                failed[bit >> 3] |= 1 << (bit & 7)
                token = path.pop()
                at -= size[token]
                before = path[-1] if path else -1
                token = shorter[token]

    def cuts(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """Parts of all texts that are encoded on their own, and the number of parts of each text."""
        if pc.any(pc.match_substring(texts, BLANK)).as_py():
            texts = pc.replace_substring(texts, BLANK, " ")
        filled = pc.greater(pc.binary_length(texts), 0)
        if self.lead:
            texts = pc.if_else(filled, pc.binary_join_element_wise(" ", texts, ""), texts)
        if not self.cut_at_blanks:
            return texts, np.ones(len(texts), np.int64)
        bounds = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
        data = texts.buffers()[2]
        view = np.frombuffer(data, np.uint8)[: bounds[-1]] if data is not None else np.zeros(0, np.uint8)
        blank = view == 0x20
        starts = np.zeros(len(view) + 1, bool)
        starts[1:-1] = blank[1:] & ~blank[:-1]
        starts[: bounds[0]] = False
        starts[bounds[:-1]] = True
        starts[bounds[-1]] = False
        first = np.flatnonzero(starts)
        offsets = np.append(first, bounds[-1]).astype(np.int32)
        if not len(first):
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        parts = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), data)
        upto = np.searchsorted(first, bounds)
        return parts, np.diff(upto)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids (int32) of texts without nulls, begin and end ids included, and the number of ids of each."""
        parts, n_parts = self.cuts(texts)
        coded = parts.dictionary_encode()
        known = [self.pieces(part) for part in coded.dictionary.to_pylist()]
        sizes = np.fromiter(map(len, known), np.int64, len(known))
        ids = np.fromiter((i for part in known for i in part), np.int32, int(sizes.sum()))
        del known
        codes = coded.indices.to_numpy()
        begin = np.cumsum(sizes) - sizes
        each = sizes[codes]
        total = np.concatenate(([0], np.cumsum(each)))
        bounds = total[np.concatenate(([0], np.cumsum(n_parts)))]
        counts = np.diff(bounds) + 2
        flat = np.empty(int(counts.sum()), np.int32)
        ends = np.cumsum(counts)
        inner = np.ones(len(flat), bool)
        inner[ends - 1] = inner[ends - counts] = False
        flat[inner] = ids[spread(begin[codes], each)]
        flat[ends - counts], flat[ends - 1] = self.begin, self.end
        return flat, counts

    # -- decoding --------------------------------------------------------------------------------------------------

    def decode(self, ids: np.ndarray, counts: np.ndarray) -> pa.Array:
        """Texts of the ids: blanks for blank marks, without the leading one; bytes that are no UTF-8 as U+FFFD each."""
        offsets = np.concatenate(([0], np.cumsum(counts)))
        lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), self.table.take(pa.array(ids)))
        joined = pc.binary_join(lists, b"")
        first = self._first(ids, offsets)
        odd = [k for k in np.flatnonzero(self.is_byte[ids[first]] & (counts > 0))] if len(ids) else []
        try:
            whole = joined.cast(pa.string())
        except pa.ArrowInvalid:
            odd, whole = range(len(counts)), pa.nulls(len(counts), pa.string())
        if self.lead and len(ids):
            leads = self.starts_blank[ids[first]] & (counts > 0)
            whole = pc.if_else(pa.array(leads), pc.utf8_slice_codeunits(whole, 1), whole)
        if not len(odd):
            return whole
        out = whole.to_pylist()
        for k in odd:
            out[k] = self._decode_one(ids[offsets[k] : offsets[k + 1]].tolist())
        return pa.array(out, pa.string())

    def _first(self, ids: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Place of each list's first id that isn't a control id, or of its last id."""
        if not len(ids):
            return np.zeros(0, np.int64)
        plain = np.flatnonzero(np.array(self.kinds)[ids] != CONTROL)
        at = np.searchsorted(plain, offsets[:-1])
        place = np.append(plain, len(ids))[at]
        return np.clip(np.minimum(place, offsets[1:] - 1), 0, len(ids) - 1)

    def _decode_one(self, ids: list[int]) -> str:
        out: list[str] = []
        run = bytearray()
        leading, table = self.lead, self.table
        for token in [*ids, self.begin]:
            if self.kinds[token] == BYTE:
                run += table[token].as_py()
                continue
            while run:
                for size in range(min(4, len(run)), 0, -1):
                    try:
                        char = run[:size].decode()
                    except UnicodeDecodeError:
                        continue
                    if len(char) == 1:
                        break
                else:
                    size, char = 1, "�"
                out.append(char)
                del run[:size]
            leading = leading and not out
            text = table[token].as_py().decode()
            if leading and self.starts_blank[token]:
                text, leading = text[1:], False
            if text:
                out.append(text)
        return "".join(out)


@lru_cache(maxsize=4)
def load(path: str) -> PieceBpe:
    """One parsed vocabulary per worker process."""
    return PieceBpe(path)


def _packed(ids: np.ndarray, counts: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(counts * 4))).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(counts), [None, pa.py_buffer(offsets), pa.py_buffer(ids.astype("<u4"))])


def encode(text: str | Column, path: str) -> Column:
    """Ids of each text, begin and end ids included, as ``array<int>``; null texts count as empty."""

    @F.arrow_udf("array<int>")
    def piece_ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        for batch in batches:
            done = []
            for part in chunks(batch, CHUNK_BYTES):
                ids, counts = model.encode(part)
                offsets = np.concatenate(([0], np.cumsum(counts))).astype(np.int32)
                done.append(pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids)))
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(pa.int32()))

    return piece_ids(F.col(text) if isinstance(text, str) else text)


def decode(ids: str | Column, path: str) -> Column:
    """Text of each ``array<int>`` of ids; null gives ''."""

    @F.arrow_udf("string")
    def piece_text(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        for batch in batches:
            filled = batch.cast(pa.list_(pa.int32()))
            counts = pc.fill_null(pc.list_value_length(filled), 0).to_numpy().astype(np.int64)
            done, at = [], 0
            packed = _packed(filled.flatten().to_numpy(), counts)
            for part in slices(packed, CHUNK_BYTES):
                n = counts[at : at + len(part)]
                done.append(model.decode(np.frombuffer(b"".join(part.to_pylist()), "<u4"), n))
                at += len(part)
            yield pa.concat_arrays(done) if done else pa.array([], pa.string())

    return piece_text(F.col(ids) if isinstance(ids, str) else ids)


def round_trip(text: str | Column, path: str) -> Column:
    """``ids`` (packed as little-endian unsigned 32-bit integers) and ``decoded`` of each text in one struct."""

    @F.arrow_udf("ids binary, decoded string")
    def piece_round_trip(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(path)
        kind = pa.struct([("ids", pa.binary()), ("decoded", pa.string())])
        for batch in batches:
            done = []
            for part in chunks(batch, CHUNK_BYTES):
                ids, counts = model.encode(part)
                done.append(pa.StructArray.from_arrays([_packed(ids, counts), model.decode(ids, counts)], fields=list(kind)))
            yield pa.concat_arrays(done) if done else pa.array([], kind)

    return piece_round_trip(F.col(text) if isinstance(text, str) else text)
