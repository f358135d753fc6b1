"""Personal data in texts: fixed patterns, and spans added by a trained character tagger.

The tagger (:mod:`tidepane.llm.tagger`) is trained here on labelled spans: those the patterns find in a bounded sample
of texts, and made-up ones in many notations set into words of that sample. It reads windows of ``WINDOW`` characters every ``STRIDE``
characters, so every character is read in two windows with context on both sides. Scores and label
distributions of a character are averaged, with more weight where it lies further inside, over the whole text. Where
anything but plain text has a chance, whole stretches are decoded at once by the best path through the averaged
scores and the learned transitions. A span is added if its mean probability is high, it overlaps no span of the patterns and its
kind's own check holds (a card passes Luhn, an address has four parts up to 255 …).

Every kind needs a digit, an at sign or a bracketed "at"; windows are read around those only, which loses nothing since a span without any
fails its check. Null texts count as empty and have no spans. Positions are code points, ends exclusive.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepane.llm import tagger
from tidepane.llm.bpe import chunks

#: Kinds in the order they are listed; the label of a character is 0, or 1 + 2 * kind at a start, or 2 + 2 * kind inside.
KINDS = ["email", "ip", "card", "phone"]
LABELS = 1 + 2 * len(KINDS)
WINDOW, STRIDE = 96, 48
#: Texts the tagger is trained on, on average, besides made-up ones.
SAMPLE_TEXTS = 400
EXAMPLES = 4_000
#: Labelled windows and words that one text of the sample gives at most, drawn from the whole of it.
TEXT_WINDOWS, TEXT_WORDS = 20, 50
#: Least mean probability of an added span.
CERTAIN = 0.6
#: Characters that are plain text with no more than this chance against it are not decoded.
DOUBT = 0.01
#: Windows read at a time.
BLOCK = 512
#: Windows whose lines of characters are held at a time, and by which the parts of a longer text overlap.
PART, MARGIN = 8 * BLOCK, 8
#: Bytes of text held as Python strings at a time in a task; doesn't change a result.
CHUNK_BYTES = 4 << 20

# The base patterns. Local parts of addresses are read backwards from the sign, see base_spans().
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_CUE = re.compile(r"[0-9@]|[(\[](?i:at)[)\]]")
_AT = re.compile(r"\s*[(\[](?i:at)[)\]]\s*")
_DOT = re.compile(r"\s*[(\[](?:(?i:dot)|\.)[)\]]\s*")

Span = tuple[int, int, int]


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = ord(d) - 48
        total += n if i % 2 == 0 else (2 * n if n < 5 else 2 * n - 9)
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end)`` of the patterns' matches, leftmost without overlap within a kind, by kind and start."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((0, start, m.end()))
            done = m.end()
        at = text.find("@", max(at + 1, done))
    for m in _IP.finditer(text):
        if all(int(p) <= 255 for p in (q[-20:].lstrip("0") or "0" for q in m[0].split("."))) and _short(m[0]):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _digits(m[0])
        if 16 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    for m in _PHONE.finditer(text):
        if 8 <= len(_digits(m[0])) <= 15:
            out.append((3, *m.span()))
    return out


def _short(address: str) -> bool:
    """Parts may have leading zeros but no more than 20 other digits, so that none is cut off before it is compared."""
    return all(len(p.lstrip("0")) <= 20 for p in address.split("."))


def plausible(kind: int, text: str) -> bool:
    """Whether a tagged text can be what it is tagged as."""
    if kind == 0:
        plain = _DOT.sub(".", _AT.sub("@", text))
        name, sign, host = plain.partition("@")
        return bool(sign and name and all(c in _LOCAL for c in name) and _DOMAIN.fullmatch(host))
    if kind == 1:
        parts = _DOT.sub(".", text).split(".")
        return len(parts) == 4 and all(re.fullmatch("[0-9]{1,3}", p) and int(p) <= 255 for p in parts)
    digits = _digits(text)
    if kind == 2:
        return 15 <= len(digits) <= 19 and luhn(digits) and not re.search("[^0-9 .-]", text)
    return 8 <= len(digits) <= 15 and bool(re.fullmatch(r"(\+|00)?[0-9(][0-9() ./-]*[0-9]", text)) and (
        text[0] in "+(" or text.startswith("00") or len(re.findall("[0-9]+", text)) >= 3
    )


# -- training ----------------------------------------------------------------------------------------------------------


def _number(rng, n: int) -> str:
    return "".join(map(str, rng.integers(0, 10, n)))


def _word(rng, least: int = 2, most: int = 9) -> str:
    return "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), rng.integers(least, most)))


def made_up(rng: np.random.Generator, kind: int) -> str:
    """One piece of personal data in one of several notations; 4 and more give look-alikes."""
    pick = int(rng.integers(0, 6))
    if kind == 0:
        name = rng.choice([_word(rng), f"{_word(rng)}.{_word(rng)}", f"{_word(rng)}.{_number(rng, 2)}", _number(rng, 2),
                           f"{_word(rng)}+{_word(rng)}", f"{_word(rng)}_{_number(rng, 3)}".title()])
        host = rng.choice([f"{_word(rng)}.com", f"mail{_number(rng, 1)}.{_word(rng)}.com", f"{_word(rng)}-{_word(rng)}.org",
                           f"{_word(rng)}.co.uk", f"{_word(rng)}.de"])
        if pick == 0:
            return f"{name} (at) {str(host).replace('.', ' (dot) ')}"
        if pick == 1:
            return f"{name}[at]{str(host).replace('.', '[dot]')}"
        return f"{name}@{host}"
    if kind == 1:
        return ("[.]" if pick == 0 else ".").join(map(str, rng.integers(0, 256, 4)))
    if kind == 2:
        body = _number(rng, int(rng.choice([15, 15, 15, 16, 18, 14])))
        card = next(body + str(d) for d in range(10) if luhn(body + str(d)))
        if pick < 3 or len(card) != 16:
            return card
        return (" ", "-", ".")[pick - 3].join(card[i : i + 4] for i in range(0, 16, 4))
    if kind == 3:
        area, left, right = _number(rng, 3), _number(rng, 3), _number(rng, 4)
        return (
            f"+1 ({area}) {left}-{right}", f"+{rng.integers(1, 99)} {_number(rng, 2)} {_number(rng, 7)}",
            f"({area}) {left}-{right}", f"{area}-{left}-{right}", f"+{_number(rng, 11)}", f"00{rng.integers(10, 99)} {area} {left}{right}",
        )[pick]
    return str((
        "".join(rng.choice(list("0123456789abcdef"), 40)), _number(rng, int(rng.integers(1, 13))),
        f"{rng.integers(0, 99)}.{_number(rng, 2)}", f"{rng.integers(1990, 2030)}-0{rng.integers(1, 9)}-{rng.integers(10, 30)}",
        f"{rng.integers(0, 24)}:{_number(rng, 2)}", f"{rng.integers(0, 9)}.{rng.integers(0, 9)}.{rng.integers(0, 20)}",
        f"@{_word(rng)}", f"{_word(rng)}@{_word(rng)}", f"978-{_number(rng, 1)}-{_number(rng, 2)}-{_number(rng, 6)}-{_number(rng, 1)}",
        f"{_word(rng)}{_number(rng, 3)}", f"{rng.integers(1, 99)}-{rng.integers(100, 300)}", f"${rng.integers(1, 99)},{_number(rng, 3)}.{_number(rng, 2)}",
        f"{_word(rng)} (at) {_word(rng)}", _number(rng, int(rng.integers(22, 40))),
    )[int(rng.integers(0, 14))])


def _labelled(text: str, spans: list[Span], start: int) -> tuple[np.ndarray, np.ndarray]:
    x = np.full(WINDOW, tagger.FILL, np.uint8)
    y = np.zeros(WINDOW, np.int64)
    points = np.frombuffer(text[max(start, 0) : start + WINDOW].encode("utf-32-le", "surrogatepass"), np.uint32)
    at = max(-start, 0)
    x[at : at + len(points)] = tagger.classes(points)
    for kind, a, b in spans:
        a, b = a - start, b - start
        if b > 0 and a < WINDOW:
            y[max(a, 0) : b] = 2 + 2 * kind
            if a >= 0:
                y[a] = 1 + 2 * kind
    return x, y


def labelled(text: str) -> tuple[list[tuple[np.ndarray, np.ndarray]], list[str]]:
    """Windows around some matches of the patterns with their labels, and some words without data, of all the text."""
    rng = np.random.default_rng(zlib.crc32(text.encode("utf-8", "surrogatepass")))
    spans, rows = base_spans(text), []
    for at in rng.permutation(len(spans))[:TEXT_WINDOWS].tolist():
        _, a, b = spans[at]
        start = int(rng.integers(b - WINDOW, a + 1)) if b - a < WINDOW else a
        # a span of two neighbouring numbers that fails as one isn't labelled data; leave such windows out
        if not _CARD.search(text[max(start, 0) : a][-30:]) and not _CARD.search(text[b : max(start, 0) + WINDOW]):
            rows.append(_labelled(text, spans, start))
    words = sorted({w for w in text.split() if len(w) <= WINDOW and not _CUE.search(w)})
    return rows, [words[k] for k in rng.permutation(len(words))[:TEXT_WORDS].tolist()]


def examples(
    rows: list[tuple[np.ndarray, np.ndarray]], words: list[str], n: int = EXAMPLES, seed: int = 11
) -> tuple[np.ndarray, np.ndarray]:
    """Windows and labels: ``rows``, at most half of all, and made-up data among ``words``, or made-up ones if there are none."""
    rng = np.random.default_rng(seed)
    pool = np.array(sorted(set(words)) or [_word(rng) for _ in range(500)], object)

    def some(n: int) -> str:
        return " ".join(pool[rng.integers(0, len(pool), n)])

    rows = rows[: n // 2]
    while len(rows) < n:
        parts, spans, at, kind = [], [], 0, int(rng.integers(0, 6))
        for _ in range(int(rng.integers(1, 4))):
            # neighbours without a word between them, often of one kind, are what the patterns miss
            filling = some(int(rng.integers(1, 8))) if rng.random() < 0.6 else ""
            filling += rng.choice([" ", " ", " ", ": ", " | ", "\n", "", "=", " \"", ". "]) if filling else ""
            kind = kind if rng.random() < 0.3 else int(rng.integers(0, 6))
            item = made_up(rng, kind)
            if kind < len(KINDS):
                spans.append((kind, at + len(filling), at + len(filling) + len(item)))
            parts += [filling, item, str(rng.choice([" ", " ", " ", ", ", ". ", "\n", " | ", ")", "\" "]))]
            at += sum(map(len, parts[-3:]))
        text = "".join(parts) + some(8)
        rows.append(_labelled(text, spans, int(rng.integers(-WINDOW // 2, max(1, at - WINDOW // 2)))))
    return np.stack([r[0] for r in rows]), np.stack([r[1] for r in rows])


def train(docs: DataFrame, text: str = "text", sample_texts: int = SAMPLE_TEXTS) -> tagger.Params:
    """A tagger fitted to a sample of ``docs``: the rows whose text hash is below a bound, ``sample_texts`` on average.

    Each text of the sample becomes a few windows and words where it lies; only these go to the task that trains.
    """
    rows = docs.select(F.coalesce(F.col(text), F.lit("")).alias("t"))
    share = min(1.0, sample_texts / max(rows.count(), 1))
    order = F.xxhash64("t").bitwiseAND(F.lit(2**63 - 1))
    sample = rows.filter(order <= int(min(share * 2**63, 2**63 - 1))).select(order.alias("o"), "t")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for o, t in zip(batch.column(0), batch.column(1)):
                found, words = labelled(t.as_py())
                x, y = (b"".join(r[k].astype(np.uint8).tobytes() for r in found) for k in (0, 1))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([o.as_py()], pa.int64()), pa.array([x], pa.binary()), pa.array([y], pa.binary()), pa.array([words], pa.list_(pa.string()))],
                    ["o", "x", "y", "words"],
                )

    def fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, words = [], []
        for batch in batches:
            for x, y, some in zip(*(batch.column(c).to_pylist() for c in ("x", "y", "words"))):
                wide = (np.frombuffer(v, np.uint8).reshape(-1, WINDOW) for v in (x, y))
                found += [(a, b.astype(np.int64)) for a, b in zip(*wide)]
                words += some
        params = tagger.train(*examples(found, words), LABELS)
        yield pa.RecordBatch.from_arrays([pa.array([tagger.to_bytes(params)], pa.binary())], ["params"])

    # copies of one text give equal rows: one of them is enough, and no group of copies fills the sample
    parts = sample.mapInArrow(cut, "o bigint, x binary, y binary, words array<string>").distinct()
    parts = parts.orderBy("o", "x", "words").limit(2 * sample_texts).repartition(1).sortWithinPartitions("o", "x", "words")
    row = parts.mapInArrow(fit, "params binary").first()
    return tagger.from_bytes(row.params) if row else tagger.train(*examples([], []), LABELS, steps=1)


# -- reading -----------------------------------------------------------------------------------------------------------


def find(texts: list[str], params: tagger.Params) -> list[list[tuple[int, int, int, bool]]]:
    """``(kind, start, end, base)`` of all spans of each text, by kind and start."""
    found: list[list[tuple[int, int, int, bool]]] = [[] for _ in texts]
    windows: list[tuple[int, int]] = []
    held: dict[int, np.ndarray] = {}
    accepted: dict[int, tuple[int, int]] = {}
    size = 0
    for i, text in enumerate(texts):
        if not _CUE.search(text):
            continue
        found[i] = [(k, a, b, True) for k, a, b in base_spans(text)]
        held[i] = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        cells = {m.start() // STRIDE for m in _CUE.finditer(text)}
        cells |= {c - 1 for c in cells} | {c + 1 for c in cells}
        cells = sorted(c for c in cells if 0 <= c * STRIDE < len(text))
        size += len(text)
        # a text of very many windows is read in parts that overlap by MARGIN windows; a span counts in one of them
        for at in range(0, len(cells), PART):
            low = 0 if at == 0 else cells[at] * STRIDE
            high = cells[at + PART] * STRIDE if at + PART < len(cells) else len(text)
            windows += [(i, c) for c in cells[max(at - MARGIN, 0) : at + PART + MARGIN]]
            accepted[i] = (low, high)
            if len(windows) >= PART or size > 4_000_000:
                _tag(texts, held, windows, accepted, params, found)
                windows, accepted = [], {}
                held, size = ({i: held[i]}, len(text)) if at + PART < len(cells) else ({}, 0)
    if windows:
        _tag(texts, held, windows, accepted, params, found)
    return found


def _tag(texts, held, windows, accepted, params, found) -> None:
    """Adds the tagger's spans of the texts in ``windows``, a sorted list of (text, cell), that begin where they are accepted."""
    lead = (WINDOW - STRIDE) // 2
    n = len(windows)
    x = np.full((n, WINDOW), tagger.FILL, np.uint8)
    for k, (i, cell) in enumerate(windows):
        start = cell * STRIDE - lead
        points = held[i][max(start, 0) : start + WINDOW]
        at = max(-start, 0)
        x[k, at : at + len(points)] = tagger.classes(points)
    # windows in a row overlap: their sums lie on one line of characters, with a gap after the last of a row
    cell = np.array([c for _, c in windows])
    owner = np.array([i for i, _ in windows])
    new_row = np.ones(n, bool)
    new_row[1:] = (owner[1:] != owner[:-1]) | (cell[1:] != cell[:-1] + 1)
    place = np.arange(n) * STRIDE + np.cumsum(new_row) * WINDOW
    weight = np.minimum(np.arange(WINDOW) + 1, WINDOW - np.arange(WINDOW)).astype(np.float32)
    total = np.zeros(place[-1] + WINDOW + 1, np.float32)
    scores, line = (np.zeros((len(total), LABELS), np.float32) for _ in range(2))
    for first in range(0, n, BLOCK):
        some = place[first : first + BLOCK]
        both = [v.transpose(1, 0, 2) for v in tagger.read(params, np.ascontiguousarray(x[first : first + BLOCK].T))]
        for k in range(0, WINDOW, STRIDE):  # in two steps, so no place is added to twice at once
            at = (some[:, None] + np.arange(k, k + STRIDE)[None, :]).ravel()
            part = weight[None, k : k + STRIDE, None]
            total[at] += np.tile(weight[k : k + STRIDE], len(some))
            for sums, each in zip((scores, line), both):
                sums[at] += (each[:, k : k + STRIDE] * part).reshape(-1, LABELS)
    seen = total > 0
    for sums in (scores, line):
        sums[seen] /= total[seen, None]
    open_ = np.concatenate(([False], seen & (line[:, 0] < 1 - DOUBT), [False]))
    edges = np.flatnonzero(open_[1:] != open_[:-1])
    label = tagger.decode(scores, edges[::2], edges[1::2], params["trans"])
    begin = label % 2 == 1
    kind = (label + 1) // 2
    by_kind = line[:, 1::2] + line[:, 2::2]
    firsts = np.flatnonzero(begin)
    stops = np.flatnonzero((kind > 0) & np.concatenate(((label[1:] == 0) | begin[1:], [True])))
    chance = np.concatenate(([0.0], np.cumsum(by_kind[np.arange(len(kind)), np.maximum(kind - 1, 0)], dtype=np.float64)))
    for a, b in zip(firsts.tolist(), (stops + 1).tolist()):
        if (chance[b] - chance[a]) / (b - a) < CERTAIN:
            continue
        k = int(np.searchsorted(place, a, "right")) - 1
        i = windows[k][0]
        start = int(cell[k] * STRIDE - lead + (a - place[k]))
        if accepted[i][0] <= max(start, 0) < accepted[i][1]:
            _add(texts[i], found[i], int(kind[a]) - 1, start, start + b - a)
    for i in accepted:
        found[i].sort()


def _add(text: str, spans: list, kind: int, start: int, end: int) -> None:
    start, end = max(start, 0), min(end, len(text))
    word = text[start:end]
    start += len(word) - len(word.lstrip())
    end -= len(word) - len(word.rstrip())
    if plausible(kind, text[start:end]):
        parts = [(start, end)]
    else:  # neighbours of one kind may be tagged as one: try what stands between blanks
        parts = [(start + m.start(), start + m.end()) for m in re.finditer(r"\S+", text[start:end])]
    for start, end in parts:
        if text[start].isdigit() and text[start - 1 : start].isdigit() or text[end - 1].isdigit() and text[end : end + 1].isdigit():
            continue  # a part of a longer number is no number
        if plausible(kind, text[start:end]) and not any(a < end and start < b for _, a, b, _ in spans):
            spans.append((kind, start, end, False))


_SPAN = pa.struct([("rank", pa.int32()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])


def private_spans(text: str | Column, params: tagger.Params) -> Column:
    """All spans of each text as ``array<struct<rank, start, end, base>>`` by kind and start; ``rank`` is the kind's place."""

    @F.arrow_udf("array<struct<rank:int,start:int,end:int,base:boolean>>")
    def find_private(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for part in chunks(batch, CHUNK_BYTES):
                rows = find(part.to_pylist(), params)
                flat = [s for spans in rows for s in spans]
                offsets = np.concatenate(([0], np.cumsum([len(r) for r in rows]))).astype(np.int32)
                columns = [pa.array([s[j] for s in flat], field.type) for j, field in enumerate(_SPAN)]
                done.append(pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(columns, fields=list(_SPAN))))
            yield pa.concat_arrays(done) if done else pa.array([], pa.list_(_SPAN))

    return find_private(F.col(text) if isinstance(text, str) else text)


def redacted(text: str | Column, params: tagger.Params) -> Column:
    """Each text with its spans replaced by their kinds, as in ``[EMAIL]``; texts without spans, and nulls, stay."""

    @F.arrow_udf("string")
    def redact(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            done = []
            for part in chunks(batch, CHUNK_BYTES):
                texts = part.to_pylist()
                done.append(pa.array([replace(t, spans) for t, spans in zip(texts, find(texts, params))], pa.string()))
            whole = pa.concat_arrays(done) if done else pa.array([], pa.string())
            yield pc.if_else(batch.is_valid(), whole, pa.scalar(None, pa.string()))

    return redact(F.col(text) if isinstance(text, str) else text)


def replace(text: str, spans: list[tuple[int, int, int, bool]]) -> str:
    """Spans of different kinds may overlap: their union is replaced once, by the kind that starts first."""
    out, at = [], 0
    for start, end, kind in sorted((a, b, k) for k, a, b, _ in spans):
        if start >= at:
            out += [text[at:start], f"[{KINDS[kind].upper()}]"]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text
