"""Best-fit packing of token pieces into sequences by bin completion.

Texts are encoded, closed with an end id and cut into pieces only where they exceed a sequence. Pieces are dealt into
groups of about ``GROUP`` pieces of the table, and each group is packed in one task from the numbers of its pieces: a group
loses less than one sequence against packing all at once. Inside a group best fit over the lengths, longest first,
gives the first solution. If it needs more sequences than the lower bound, the first descent of bin completion runs over
the whole group, and the better of both counts. Then bin completion looks for a better one for ``TAIL`` sequences
together (all of them in a small group), the emptiest ones or these mixed with full ones: depth first, it takes the
longest piece left, lists the fillings around it that leave no room for another piece, the fullest first, and drops a
branch once its waste exceeds what a better solution may waste. A search ends at the bound or after ``NODES`` nodes
and the best solution so far counts; no piece is ever left out.

A null text is empty and makes a piece of the end id alone. Rows with equal ids, and null ids, are rows of their own.
"""

from __future__ import annotations

import random
from bisect import bisect_right, insort
from collections import Counter
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepane.llm import bpe
from tidepane.session import cut_lineage

#: Pieces packed together in one task. More of them give groups more, not larger tasks.
GROUP = 100_000
#: Nodes of the search for a better solution than best fit; a limit of effort only.
NODES = 2_000
#: Sequences that are packed anew together, and how often.
TAIL = 64
ROUNDS = 50
#: Rounds in a row without a gain after which no more are tried; a limit of effort only.
MISSES = 8


def pieces(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text") -> DataFrame:
    """``docs`` without ``text``, a row per piece, with ``piece``, ``start``, ``length`` and ``ids`` (packed) added."""
    end = F.lit(int(end_id).to_bytes(4, "little"))
    whole = docs.withColumn("__ids", F.concat(bpe.encode_packed(text, path), end)).drop(text)
    total = F.octet_length("__ids") / 4
    cut = F.transform(
        F.sequence(F.lit(0), (F.ceil(total / capacity) - 1).cast("int")),
        lambda p: F.struct(
            p.alias("piece"),
            (p.cast("bigint") * capacity).alias("start"),
            F.substring("__ids", p * (4 * capacity) + 1, F.lit(4 * capacity)).alias("ids"),
        ),
    )
    columns = [c for c in whole.columns if c != "__ids"]
    return whole.select(*columns, F.inline(cut)).withColumn(
        "length", (F.octet_length("ids") / 4).cast("bigint")
    )


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Fillings of best fit over sizes, longest first; open room is a bit set, so a search is one bit scan."""
    room_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins = 0, []
    for size in sizes:
        fitting = rooms >> size
        if fitting:
            room = size + ((fitting & -fitting).bit_length() - 1)
            at = room_bins[room].pop()
            if not room_bins[room]:
                rooms ^= 1 << room
            bins[at].append(size)
        else:
            room, at = capacity, len(bins)
            bins.append([size])
        left = room - size
        if left:
            room_bins[left].append(at)
            rooms |= 1 << left
    return bins


def lower_bound(sizes: list[int], capacity: int) -> int:
    """The most of the volume bound and the bounds of Martello and Toth; ``sizes`` in falling order."""
    upward = sizes[::-1]
    sums = [0, *accumulate(upward)]
    n = len(upward)
    best = -(-sums[-1] // capacity)
    half = bisect_right(upward, capacity // 2)
    for k in sorted({s for s in upward[:half]}):
        big = bisect_right(upward, capacity - k)
        low = bisect_right(upward, k - 1)
        room = (half_n := big - half) * capacity - (sums[big] - sums[half])
        rest = sums[half] - sums[low] - room
        best = max(best, n - big + half_n + max(0, -(-rest // capacity)))
    return best


def lazy_fillings(left: list[int], room: int) -> Iterator[list[int]]:
    """Every set of ``left`` (rising, with repeats) that fits ``room`` and leaves no room for another piece, fullest first.

    Fillings that another one dominates are never fuller than it; all that are not dominated are among these. Sums that
    the smaller sizes can reach are bit sets, so the search for the sets of one sum enters no dead end.
    """
    counts = Counter(left[: bisect_right(left, room)])
    sizes = sorted(counts)
    reach = [1]
    for size in sizes:
        sums, copies, step = reach[-1], min(counts[size], room // size), 1
        while copies:
            step = min(step, copies)
            sums |= sums << (size * step)
            copies -= step
            step *= 2
        reach.append(sums & ((1 << (room + 1)) - 1))

    def sets(total: int, k: int) -> Iterator[list[int]]:
        if not total:
            yield []
            return
        size = sizes[k - 1]
        for copies in range(min(counts[size], total // size), -1, -1):
            rest = total - copies * size
            if reach[k - 1] >> rest & 1:
                for found in sets(rest, k - 1):
                    yield [size] * copies + found

    for total in range(reach[-1].bit_length() - 1, -1, -1):
        if reach[-1] >> total & 1:
            for found in sets(total, len(sizes)):
                taken = Counter(found)
                smallest = next((s for s in sizes if counts[s] > taken[s]), room + 1)
                if total + smallest > room:
                    yield found


def fillings(left: list[int], room: int) -> list[list[int]]:
    """All of :func:`lazy_fillings`."""
    return list(lazy_fillings(left, room))


def descend(sizes: list[int], capacity: int) -> list[list[int]]:
    """The first descent of bin completion over a whole group: around the largest piece left the fullest filling.

    Sizes are held as counts, and those left as a bit set. Up to three sizes are looked for at once, smaller ones fill the rest.
    """
    counts = Counter(sizes)
    there = sum(1 << s for s in counts)
    under = lambda room: (there & ((1 << (room + 1)) - 1)).bit_length() - 1  # noqa: E731  largest size that fits, or -1

    def take(size: int) -> int:
        nonlocal there
        counts[size] -= 1
        if not counts[size]:
            there ^= 1 << size
        return size

    def put(size: int) -> None:
        nonlocal there
        counts[size] += 1
        there |= 1 << size

    bins = []
    while there:
        chosen = [take(there.bit_length() - 1)]
        room = capacity - chosen[0]
        best: list[int] = []
        full = 0
        a = under(room)
        while a > 0 and full < room:
            take(a)
            second = under(room - a)
            found = [a]
            if second > 0:
                found.append(take(second))
                third = under(room - a - second)
                if third > 0:
                    found.append(third)
                put(second)
            put(a)
            if sum(found) > full:
                best, full = found, sum(found)
            if 3 * a <= full:  # three sizes of at most a can't be fuller
                break
            a = under(a - 1)
        for size in best:
            take(size)
        chosen += best
        room -= full
        while (size := under(room)) > 0:
            chosen.append(take(size))
            room -= size
        bins.append(chosen)
    return bins


def complete(sizes: list[int], capacity: int, incumbent: list[list[int]], nodes: int = NODES) -> list[list[int]]:
    """Bin completion by branch and bound, starting from ``incumbent``; ``sizes`` in falling order."""
    bound = lower_bound(sizes, capacity)
    volume = sum(sizes)
    left = sizes[::-1]
    done: list[list[int]] = []
    waste = 0
    # a frame: choices still open around the longest piece left, and what the current choice took and wasted
    frames: list[tuple[Iterator[list[int]], list[int], int]] = []

    def choices() -> Iterator[list[int]]:
        return lazy_fillings(left[:-1], capacity - left[-1])

    current, taken, lost = choices(), [], 0
    while nodes and len(incumbent) > bound:
        allowed = (len(incumbent) - 1) * capacity - volume  # more waste can't give a better solution
        filling = next(current, None)
        nodes -= 1
        if filling is None or waste > allowed:
            if not frames:
                break
            for s in taken:
                insort(left, s)
            waste -= lost
            done.pop()
            current, taken, lost = frames.pop()
            continue
        largest = left[-1]
        free = capacity - largest - sum(filling)
        chosen = [largest, *filling]
        rest = left[:-1]
        for s in filling:
            rest.pop(bisect_right(rest, s) - 1)
        while free and rest and rest[0] <= free:  # small pieces that still fit never hurt
            s = rest.pop(bisect_right(rest, free) - 1)
            chosen.append(s)
            free -= s
        if waste + free > allowed:
            continue
        left = rest
        done.append(chosen)
        frames.append((current, taken, lost))
        taken, lost = chosen, free
        waste += free
        if not left:
            incumbent = [list(b) for b in done]
            continue
        current = choices() if left else iter(())
    return incumbent


def improve(bins: list[list[int]], capacity: int, bound: int) -> list[list[int]]:
    """Bin completion of some bins at a time, while there are more bins than ``bound``.

    First of the emptiest bins; where that saves none, of half as many of the emptiest with as many drawn from all
    others, full ones among them. It ends after ``MISSES`` rounds in a row that save none.
    """
    rng = random.Random(len(bins))
    misses = 0
    for _ in range(ROUNDS):
        if len(bins) <= bound or misses == MISSES:
            break
        bins = sorted(bins, key=sum)
        if misses and len(bins) > TAIL:
            half = bins[TAIL // 2 :]
            rng.shuffle(half)
            bins = bins[: TAIL // 2] + half
        some, rest = bins[:TAIL], bins[TAIL:]
        packed = complete(sorted((s for b in some for s in b), reverse=True), capacity, some)
        misses = misses + 1 if len(packed) == len(some) else 0
        bins = packed + rest
    return bins


def pack_sizes(sizes: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of every piece of one group."""
    order = np.argsort(-sizes, kind="stable")
    falling = sizes[order].tolist()
    full = bisect_right([-s for s in falling], -capacity)
    rest = falling[full:]
    bins = [[capacity]] * full
    if rest:
        solution = best_fit(rest, capacity)
        bound = lower_bound(rest, capacity)
        if len(solution) > bound:
            solution = min(solution, descend(rest, capacity), key=len)
        bins = bins + improve(solution, capacity, bound)
    # pieces of one length are alike: hand the places of a length out in order
    flat = np.array([s for b in bins for s in b], np.int64)
    counts = np.array([len(b) for b in bins], np.int64)
    owner = np.repeat(np.arange(len(bins)), counts)
    before = np.cumsum(flat) - flat
    offset = before - np.repeat(before[np.cumsum(counts) - counts], counts) if len(flat) else before
    place = np.argsort(-flat, kind="stable")
    out_bin, out_offset = np.empty(len(sizes), np.int64), np.empty(len(sizes), np.int64)
    out_bin[order], out_offset[order] = owner[place], offset[place]
    return out_bin, out_offset


def pack(rows: DataFrame, capacity: int = 4096, group: int = GROUP) -> DataFrame:
    """``rows`` (with ``length`` from 1 to ``capacity``) with ``sequence_id`` and ``offset`` added.

    ``rows`` must not change when read again: pass a saved table. Groups are dealt in turn, so no key makes one large.
    """
    groups = max(1, -(-rows.count() // group))
    dealt = rows.repartition(groups).withColumn("__group", F.spark_partition_id().cast("bigint"))
    at = len(rows.columns)

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        bins, offsets = pack_sizes(table.column("length").to_numpy().astype(np.int64), capacity)
        first = table.column(at)[0].as_py() << 32
        table = table.remove_column(at)
        table = table.append_column("sequence_id", pa.array(bins + first)).append_column("offset", pa.array(offsets))
        yield from table.to_batches()

    kinds = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return dealt.mapInArrow(packed, f"{kinds}, `sequence_id` bigint, `offset` bigint")


def pack_documents(
    docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1, text: str = "text", id_col: str = "doc_id"
) -> DataFrame:
    """Place of every piece: ``id_col, piece, start, length, ids_crc32, sequence_id, offset``."""
    cut = pieces(docs.select(id_col, text), path, capacity, end_id, text)
    saved = cut_lineage(cut.select(id_col, "piece", "start", "length", F.crc32("ids").alias("ids_crc32")))
    return pack(saved, capacity)
