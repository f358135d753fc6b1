"""Cheapest repair of the structure of conversations, with an audit of its edits.

A conversation is repaired when the initials of its roles read ``(s?(ua)+)?``: nothing, or an optional system turn and
then user and assistant in turn. Rows are kept (cost 0), given the role user or assistant (3) or deleted (4, the only
choice for blank and duplicate rows); turns of empty text can be inserted (3); a truncated row that stays costs 3 more.
The audit is the string of the edits' initials; of all cheapest ones the least in ASCII order is taken.

**Method.** A dynamic program over rows and the four states of the pattern. The audits of a state are not copied: an
edit is a node linked to the audit it prolongs, with its depth, a rolling hash of the letters up to it and one further
ancestor (of skew-binary lengths, so any ancestor is a logarithmic number of steps away). Audits of equal cost are
compared by searching the longest common prefix over hashes of ancestors; the letters of a prefix that the hashes call
equal are compared as well, up to the first node both share. Audits of equal cost and equal rows never are prefixes of
each other (letters fix the cost), so the least audit of a state stays the least whatever follows.

**Scale.** Only keys, roles, digests and marks of rows are sorted for the program, by ranges of conversation and turn,
so one endless conversation spreads over many tasks; each task sums up its stretch as the best audits from every entry
to every exit state, at most ``BLOCK`` rows at a time, and the stretches of a conversation are put together after.
Rows seen before are found by a grouping and a join. Repaired texts are put out conversation by conversation from
sorted partitions, a batch at a time.

**Cases.** A null role or text counts as one blank; null conversation ids make one conversation; null turns come first.
Rows of equal turn follow each other by role, then by the digest of their text, so repeated rows are neighbours. A role
without a usable initial (blank, empty, other) can't stay as it is. Further columns are not looked at. An empty table
gives an empty result; a conversation without rows has an empty audit of cost 0.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

#: Rows summed up at a time; bounds the memory of a worker, not the result.
BLOCK = 10_000
#: Characters of repaired text put out at a time.
OUT_CHARS = 4 << 20
#: Modulus and base of the rolling hash; any values give the same audits.
MODULUS, BASE = (1 << 61) - 1, 1_000_003

KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 3, 4, 3, 3
#: Pattern states: nothing yet, after system, after user, after assistant; the role that leads on from each.
START, SYSTEM, USER, ASSISTANT = range(4)
STATES = (START, SYSTEM, USER, ASSISTANT)
STEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
NEXT = (USER, USER, ASSISTANT, USER)
NEXT_ROLE = ("user", "user", "assistant", "user")
LEGAL = {"su", "ua", "au"}
_WHITE = " \t\n\v\f\r"

_ORDER = ["conv_id", "__turn", "role", "__digest"]


class Audits:
    """A forest of edits; a node stands for the string of letters from its root."""

    def __init__(self):
        self.parent, self.jump, self.depth, self.hash, self.letter = [0], [0], [0], [0], [""]

    def add(self, node: int, letter: str) -> int:
        parent, jump, depth = self.parent, self.jump, self.depth
        far = jump[node]
        here = len(parent)
        # two jumps of equal length join into one, as carries do in skew-binary numbers
        jump.append(jump[far] if depth[node] - depth[far] == depth[far] - depth[jump[far]] else node)
        parent.append(node)
        depth.append(depth[node] + 1)
        self.hash.append((self.hash[node] * BASE + ord(letter)) % MODULUS)
        self.letter.append(letter)
        return here

    def ancestor(self, node: int, depth: int) -> int:
        while self.depth[node] > depth:
            far = self.jump[node]
            node = far if self.depth[far] >= depth else self.parent[node]
        return node

    def less(self, one: int, other: int) -> bool:
        """Whether the string of ``one`` comes before that of ``other``."""
        depth = min(self.depth[one], self.depth[other])
        a, b = self.ancestor(one, depth), self.ancestor(other, depth)
        first = None
        if self.hash[a] != self.hash[b]:
            while self.hash[self.parent[a]] != self.hash[self.parent[b]]:
                x, y = self.jump[a], self.jump[b]
                # equal depths have jumps of equal length
                a, b = (x, y) if self.hash[x] != self.hash[y] else (self.parent[a], self.parent[b])
            first = (self.letter[a], self.letter[b])
            a, b = self.parent[a], self.parent[b]
        while a != b:  # the prefix the hashes call equal, letter by letter up to the shared node
            if self.letter[a] != self.letter[b]:
                first = (self.letter[a], self.letter[b])
            a, b = self.parent[a], self.parent[b]
        if first is not None and first[0] != first[1]:
            return first[0] < first[1]
        return self.depth[one] < self.depth[other]

    def text(self, node: int) -> str:
        out = []
        while node:
            out.append(self.letter[node])
            node = self.parent[node]
        return "".join(reversed(out))


class Program:
    """The dynamic program from one entry state."""

    def __init__(self, entry: int):
        self.audits = Audits()
        self.best: list[tuple[int, int] | None] = [None] * 4
        self.best[entry] = (0, 0)
        self._insert(self.best)

    def _offer(self, best, state: int, cost: int, node: int, letter: str) -> None:
        held = best[state]
        if held is not None and held[0] < cost:
            return
        grown = self.audits.add(node, letter)
        if held is None or cost < held[0] or self.audits.less(grown, held[1]):
            best[state] = (cost, grown)

    def _insert(self, best) -> None:
        """Inserted turns; two in a row at most, as going round costs and leads nowhere."""
        for state in (START, SYSTEM, ASSISTANT, USER):
            if best[state] is not None:
                self._offer(best, NEXT[state], best[state][0] + INSERT, best[state][1], "I")

    def row(self, initial: str, unwanted: bool, truncated: bool) -> None:
        best: list[tuple[int, int] | None] = [None] * 4
        more = TRUNCATED if truncated else 0
        for state in STATES:
            if (held := self.best[state]) is None:
                continue
            cost, node = held
            self._offer(best, state, cost + DELETE, node, "D")
            if unwanted:
                continue
            if (to := STEP[state].get(initial)) is not None:
                self._offer(best, to, cost + KEEP + more, node, "K")
            self._offer(best, NEXT[state], cost + REROLE + more, node, "R")
        self._insert(best)
        self.best = best

    def results(self) -> list[tuple[int, str] | None]:
        return [None if held is None else (held[0], self.audits.text(held[1])) for held in self.best]


def _white_free(text: Column) -> Column:
    return F.translate(text, _WHITE, "")


def marked(rows: DataFrame) -> DataFrame:
    """Slim rows of ``conv_id, turn, role, text``: order, digest and marks in place of the text."""
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    last = F.substring(F.rtrim(text, F.lit(_WHITE)), -1, 1)
    return rows.select(
        "conv_id",
        F.col("turn").alias("__turn"),
        role.alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("__digest"),
        (_white_free(text) == "").alias("__blank"),
        (~last.isin(".", "!", "?")).alias("__cut"),
        (F.coalesce(F.col("__dropped"), F.lit(False)) if "__dropped" in rows.columns else F.lit(False)).alias("__dropped"),
    )


def _with_first(slim: DataFrame) -> DataFrame:
    """``__later``: whether the same role and text stand at an earlier turn."""
    same = ["conv_id", "role", "__digest"]
    turn = F.struct(F.col("__turn").isNotNull().alias("set"), F.col("__turn").alias("turn"))
    first = (
        slim.filter(~F.col("__blank") & ~F.col("__dropped"))
        .groupBy(*same)
        .agg(F.min(turn).alias("__first"), F.max(turn).alias("__last"))
        .filter(~F.col("__first").eqNullSafe(F.col("__last")))
        .select(*[F.col(c).alias(f"__of_{c}") for c in same], "__first")
    )
    on = [slim[c].eqNullSafe(F.col(f"__of_{c}")) for c in same]
    later = F.coalesce(turn > F.col("__first"), F.lit(False))
    return slim.join(first, on, "left").select(slim["*"], later.alias("__later"))


_BLOCKS = """part int, number int, n bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint,
 initials string, turns bigint, low bigint, high bigint, entries array<int>, exits array<int>, costs array<bigint>,
 audits array<string>"""


class _Stretch:
    """The rows of one conversation that follow each other in one task, up to ``BLOCK``."""

    def __init__(self, conv, number: int, anywhere: bool):
        self.conv, self.number = conv, number
        self.entries = STATES if anywhere else (START,)
        self.programs = [Program(e) for e in self.entries]
        self.n = self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = ""
        self.low = self.high = None

    def add(self, turn, initial: str, blank: bool, duplicate: bool, cut: bool) -> None:
        if turn is not None and turn != self.high:
            self.turns += 1
            self.low = turn if self.low is None else self.low
            self.high = turn
        if self.n:
            self.illegal += self.last + initial not in LEGAL
        else:
            self.first = initial
        self.last = initial
        self.n += 1
        self.blank += blank
        self.duplicate += duplicate and not blank
        cut = cut and not blank and not duplicate
        self.truncated += cut
        for program in self.programs:
            program.row(initial, blank or duplicate, cut)

    def out(self, part: int) -> tuple:
        found = [
            (e, x, cost, audit)
            for e, program in zip(self.entries, self.programs)
            for x, held in enumerate(program.results())
            if held is not None
            for cost, audit in [held]
        ]
        # one mark for a missing initial keeps both ends apart
        ends = f"{self.first or ' '}{self.last or ' '}" if self.n else ""
        return (
            self.conv, part, self.number, self.n, self.blank, self.duplicate, self.truncated, self.illegal, ends,
            self.turns, self.low, self.high, *map(list, zip(*found)),
        )


def _summed_up(batches: Iterator[pa.RecordBatch], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Stretches of sorted rows; only a task's first conversation may have begun in another."""
    part = TaskContext.get().partitionId()
    done: list[tuple] = []
    now, before, started, waiting = None, None, False, 0

    for rows in batches:
        for conv, turn, role, digest, blank, cut, dropped, later in zip(*(c.to_pylist() for c in rows.columns)):
            if not started or conv != now.conv:
                if started:
                    done.append(now.out(part))
                    waiting += now.n
                now, before, started = _Stretch(conv, 0, anywhere=not started), None, True
            elif now.n >= BLOCK:
                done.append(now.out(part))
                waiting += now.n
                now = _Stretch(conv, now.number + 1, anywhere=True)
            if dropped:
                continue
            same = (turn, role, digest)
            now.add(turn, role[:1], blank, later or same == before, cut)
            before = same
            if waiting >= BLOCK:
                yield _arrow(done, schema)
                done, waiting = [], 0
    if started:
        done.append(now.out(part))
    if done:
        yield _arrow(done, schema)


def fold(blocks: list[dict]) -> dict:
    """One conversation from its stretches in order."""
    best: list[tuple[int, tuple] | None] = [(0, ()), None, None, None]
    turns, low, high, illegal, last = 0, None, None, 0, ""
    for block in sorted(blocks, key=lambda b: (b["part"], b["number"])):
        if block["n"]:
            turns += block["turns"] - (block["low"] is not None and block["low"] == high)
            low = block["low"] if low is None else low
            high = block["high"] if block["high"] is not None else high
            illegal += block["illegal"] + bool(last and last + block["initials"][0] not in LEGAL)
            last = block["initials"][1]
        grown: list[tuple[int, tuple] | None] = [None] * 4
        for entry, leave, cost, audit in zip(block["entries"], block["exits"], block["costs"], block["audits"]):
            if best[entry] is None:
                continue
            held, offer = grown[leave], (best[entry][0] + cost, (best[entry][1], audit))
            if held is None or offer[0] < held[0] or offer[0] == held[0] and _chain_less(offer[1], held[1]):
                grown[leave] = offer
        best = grown
    ends = [b for b in (best[START], best[ASSISTANT]) if b is not None]
    cheapest = min(b[0] for b in ends)
    audit = min(_joined(b[1]) for b in ends if b[0] == cheapest)
    total = {k: sum(b[k] for b in blocks) for k in ("blank", "duplicate", "truncated")}
    return total | {"gaps": 0 if low is None else high - low + 1 - turns, "illegal": illegal, "cost": cheapest, "audit": audit}


def _joined(chain: tuple) -> str:
    parts = []
    while chain:
        chain, part = chain
        parts.append(part)
    return "".join(reversed(parts))


def _chain_less(one: tuple, other: tuple) -> bool:
    """Compares from the stretch on in which both chains part."""
    a, b = [], []
    while one is not other and one and other:
        (one, x), (other, y) = one, other
        a.append(x)
        b.append(y)
    return "".join(reversed(a)) < "".join(reversed(b))


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string"


def audits(rows: DataFrame) -> DataFrame:
    """One row per ``conv_id`` of ``rows`` (conv_id, turn, role, text): faults, cost and audit of the cheapest repair.

    ``gaps`` are turns missing between the least and the greatest; a row's first fault of ``blank``, ``duplicate`` (same
    role and text earlier) and ``truncated`` (no ``. ! ?`` at its end) counts; ``illegal`` are neighbouring roles
    out of order. Rows marked by a boolean column ``__dropped`` only name their conversation.
    """
    slim = _with_first(marked(rows))
    order = [F.col(c).asc_nulls_first() for c in _ORDER]
    ordered = slim.repartitionByRange(*order).sortWithinPartitions(*order)
    kinds = StructType([slim.schema["conv_id"], *_struct(_BLOCKS)])
    schema = to_arrow_schema(kinds)

    def sum_up(batches):
        return _summed_up(batches, schema)

    blocks = ordered.select("conv_id", "__turn", "role", "__digest", "__blank", "__cut", "__dropped", "__later").mapInArrow(sum_up, kinds)
    every = F.collect_list(F.struct(*[c for c in kinds.names if c != "conv_id"])).alias("blocks")
    result = _struct(_RESULT)
    result_kind = pa.struct(list(to_arrow_schema(result)))

    @F.arrow_udf(result)
    def folded(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            yield pa.array([fold(stretches) for stretches in batch.to_pylist()], result_kind)

    one = blocks.groupBy("conv_id").agg(every).select("conv_id", folded("blocks").alias("found"))
    return one.select("conv_id", "found.*")


def _edited(rows: Iterator[tuple], audit: str) -> Iterator[tuple[str, str]]:
    """Role and text of every turn after the edits."""
    state, row = START, iter(rows)
    for letter in audit:
        if letter == "I":
            role, text = NEXT_ROLE[state], ""
        else:
            role, text = next(row)
            if letter == "D":
                continue
            role = NEXT_ROLE[state] if letter == "R" else role
        yield role, text
        state = STEP[state][role[:1]]


def _with_audits(rows: DataFrame, found: DataFrame) -> DataFrame:
    """Every conversation's audit (``__kind`` 0, with all of ``found``) followed by its rows in order, in one partition."""
    dropped = F.coalesce(F.col("__dropped"), F.lit(False)) if "__dropped" in rows.columns else F.lit(False)
    text, role = F.coalesce(F.col("text"), F.lit(" ")), F.coalesce(F.col("role"), F.lit(" "))
    turns = rows.filter(~dropped).select(
        "conv_id",
        F.lit(1).alias("__kind"),
        F.col("turn").alias("__turn"),
        role.alias("role"),
        F.unhex(F.sha2(text.cast("binary"), 256)).alias("__digest"),
        text.alias("text"),
    )
    heads = found.select("conv_id", F.lit(0).alias("__kind"), F.col("audit").alias("text"), F.struct(*found.columns).alias("__found"))
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "__kind", "__turn", "role", "__digest")]
    both = heads.unionByName(turns, allowMissingColumns=True)
    return both.repartition("conv_id").sortWithinPartitions(*order).select("__kind", "role", "text", "__found")


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict, Iterator[tuple[str, str]]]]:
    """Each conversation's audit and its repaired turns, which must be read before the next one."""
    rows = (r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns)))
    following: list = [next(rows, None)]

    def turns():
        for kind, role, text, found in rows:
            if kind == 0:
                following[0] = (kind, role, text, found)
                return
            yield role, text

    while following[0] is not None:
        _, _, audit, found = following[0]
        following[0] = None
        raw = turns()
        yield found, _edited(raw, audit)
        for _ in raw:  # deleted rows at the end, and the next head
            pass


def _arrow(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def repaired(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``conv_id, place, role, text`` of the repaired conversations; ``found`` are the :func:`audits` of ``rows``."""
    kinds = StructType([found.schema["conv_id"], *_struct("place bigint, role string, text string")])
    schema = to_arrow_schema(kinds)

    def edit(batches):
        out, size = [], 0
        for head, turns in _conversations(batches):
            for place, (role, text) in enumerate(turns):
                out.append((head["conv_id"], place, role, text))
                size += len(text)
                if size > OUT_CHARS or len(out) >= BLOCK:
                    yield _arrow(out, schema)
                    out, size = [], 0
        if out:
            yield _arrow(out, schema)

    return _with_audits(rows, found).mapInArrow(edit, kinds)


def with_digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``found`` with ``repaired_sha256``, of the repaired ``role:text`` lines joined by newlines, hashed as they come by."""
    kinds = StructType([*found.schema, *_struct("repaired_sha256 string")])
    schema = to_arrow_schema(kinds)

    def digest(batches):
        out = []
        for head, turns in _conversations(batches):
            total = hashlib.sha256()
            for place, (role, text) in enumerate(turns):
                total.update((f"\n{role}:{text}" if place else f"{role}:{text}").encode())
            out.append((*head.values(), total.hexdigest()))
            if len(out) >= BLOCK:
                yield _arrow(out, schema)
                out = []
        if out:
            yield _arrow(out, schema)

    return _with_audits(rows, found).mapInArrow(digest, kinds)


def _struct(ddl: str) -> StructType:
    return StructType.fromDDL(ddl)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows with planted faults, chosen by ``crc32("conv_id:turn") % 20``: 0 drops the row (``__dropped``), 1 empties
    its text, 2 takes ``. ! ?`` out of it, 3 repeats the row, 4 makes the role user. Nulls count as one blank."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank))
    code = F.crc32(key.cast("binary")) % 20
    text, role = F.coalesce(F.col("text"), blank), F.coalesce(F.col("role"), blank)
    return conversations.select(
        "conv_id",
        "turn",
        F.when(code == 4, "user").otherwise(role).alias("role"),
        F.when(code == 1, "").when(code == 2, F.translate(text, ".!?", "")).otherwise(text).alias("text"),
        (code == 0).alias("__dropped"),
        F.explode(F.sequence(F.lit(1), F.when(code == 3, 2).otherwise(1))).alias("__copy"),
    ).drop("__copy")
