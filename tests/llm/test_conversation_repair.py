import hashlib
import random
import re
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidepane.llm import conversation_repair as repair
from tidepane.llm.queries import QUERIES

SCHEMA = "conv_id bigint, turn bigint, role string, text string"
WHITE = " \t\n\v\f\r"


def plain_damage(rows):
    out = []
    for conv, turn, role, text in rows:
        code = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = role if role is not None else " ", text if text is not None else " "
        if code == 1:
            text = ""
        if code == 2:
            text = re.sub("[.!?]", "", text)
        if code == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if code == 0 else 2 if code == 3 else 1)
    return out


def plain_faults(rows):
    """(fault or None) of rows in order."""
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(WHITE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def plain_repair(rows):
    """Every sequence of edits, cheapest first, without sharing: audits as strings by state."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    lead = {"": "user", "s": "user", "a": "user", "u": "assistant"}
    held = {"": (0, "", ())}

    def offer(best, state, found):
        if state not in best or found[:2] < best[state][:2]:
            best[state] = found

    def inserted(best):
        for _ in range(3):
            for state, (cost, audit, turns) in list(best.items()):
                offer(best, step[state, lead[state][0]], (cost + 3, audit + "I", (*turns, (lead[state], ""))))
        return best

    held = inserted(held)
    for (_, role, text), fault in zip(rows, plain_faults(rows)):
        best, more = {}, 3 if fault == "truncated" else 0
        for state, (cost, audit, turns) in held.items():
            offer(best, state, (cost + 4, audit + "D", turns))
            if fault in ("blank", "duplicate"):
                continue
            if (state, role[:1]) in step:
                offer(best, step[state, role[:1]], (cost + more, audit + "K", (*turns, (role, text))))
            offer(best, step[state, lead[state][0]], (cost + 3 + more, audit + "R", (*turns, (lead[state], text))))
        held = inserted(best)
    return min(held[s] for s in ("", "a") if s in held)


def plain(rows):
    """Expected rows by conversation, of rows before damage."""
    convs = {}
    for row in rows:
        convs.setdefault(row[0], [])
    for conv, turn, role, text in plain_damage(rows):
        convs[conv].append((turn, role, text))
    out = {}
    for conv, found in convs.items():
        digest = lambda t: hashlib.sha256(t.encode()).digest()
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], digest(r[2])))
        turns = [t for t, _, _ in found if t is not None]
        faults = plain_faults(found)
        cost, audit, repaired = plain_repair(found)
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0,
            *[faults.count(f) for f in ("blank", "duplicate", "truncated")],
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(found, found[1:])),
            cost,
            audit,
            hashlib.sha256("\n".join(f"{r}:{t}" for r, t in repaired).encode()).hexdigest(),
        )
    return out


def answers(rows):
    damaged = repair.damaged(rows)
    return {r[0]: tuple(r)[1:] for r in repair.with_digests(damaged, repair.audits(damaged)).collect()}


def run_program(rows):
    program = repair.Program(repair.START)
    for (_, role, _), fault in zip(rows, plain_faults(rows)):
        program.row(role[:1], fault in ("blank", "duplicate"), fault == "truncated")
    return min(r for r in (program.results()[repair.START], program.results()[repair.ASSISTANT]) if r)


TURNS = st.lists(
    st.tuples(st.just(0), st.sampled_from(["user", "assistant", "system", "tool", " "]), st.sampled_from(["a.", "b!", "cut", " ", "c?"])),
    max_size=9,
)


@given(TURNS)
@settings(max_examples=400, deadline=None)
def test_cheapest_and_least_audit(rows):
    assert run_program(rows) == plain_repair(rows)[:2]


@given(TURNS)
@settings(max_examples=200, deadline=None)
def test_colliding_hashes_change_nothing(rows):
    usual = repair.MODULUS
    try:
        repair.MODULUS = 2
        assert run_program(rows) == plain_repair(rows)[:2]
    finally:
        repair.MODULUS = usual


@given(st.lists(st.tuples(st.integers(0, 60), st.sampled_from("DIKR")), min_size=2, max_size=60), st.sampled_from([1, 3, (1 << 61) - 1]))
@settings(max_examples=200, deadline=None)
def test_audits_compare_like_strings(edits, modulus):
    usual = repair.MODULUS
    try:
        repair.MODULUS = modulus
        forest, texts = repair.Audits(), [""]
        for at, letter in edits:
            node = at % len(texts)
            forest.add(node, letter)
            texts.append(texts[node] + letter)
        for one in range(len(texts)):
            assert forest.text(one) == texts[one]
            for other in range(0, len(texts), 7):
                assert forest.less(one, other) == (texts[one] < texts[other])
    finally:
        repair.MODULUS = usual


@given(TURNS, st.integers(1, 4))
@settings(max_examples=150, deadline=None)
def test_stretches_put_together(rows, size):
    """Summed up from every state in small stretches, the program gives the same audit."""
    marks = [(t, r[:1], f == "blank", f == "duplicate", f == "truncated") for (t, r, _), f in zip(rows, plain_faults(rows))]
    names = [f.strip().split(" ")[0] for f in repair._BLOCKS.split(",")]
    blocks = []
    for at in range(0, max(1, len(marks)), size):
        stretch = repair._Stretch(1, at // size, anywhere=at > 0)
        for mark in marks[at : at + size]:
            stretch.add(*mark)
        blocks.append(dict(zip(names, stretch.out(0)[1:])))
    whole = repair.fold(blocks)
    assert (whole["cost"], whole["audit"]) == plain_repair(rows)[:2]


def random_rows(seed, convs, most):
    r = random.Random(seed)
    return [
        (r.choice([conv, conv, conv, None]) if conv % 9 == 0 else conv, r.choice([t, t, t, r.randrange(most), None]),
         r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""]), r.choice(["yes.", "no!", "  ", None, "cut", "wait? ", f"text {t}.", "é.\n"]))
        for conv in range(convs) for t in range(r.randrange(most))
    ]


@pytest.mark.parametrize("block", [10_000, 3])
def test_whole_operator(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = random_rows(block, 60, 14)
    got = answers(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got == plain(rows)


def test_one_long_conversation_over_many_tasks(spark):
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant", "system"]), r.choice(["yes.", f"{t}.", f"{t}", " "])) for t in range(3000)]
    rows += [(c, 0, "user", "hi.") for c in range(3)]
    assert answers(spark.createDataFrame(rows, SCHEMA).repartition(9)) == plain(rows)


def test_repaired_rows_are_the_hashed_ones(spark):
    rows = random_rows(3, 20, 9)
    damaged = repair.damaged(spark.createDataFrame(rows, SCHEMA))
    turns = {}
    for row in repair.repaired(damaged, repair.audits(damaged)).collect():
        turns.setdefault(row.conv_id, []).append((row.place, row.role, row.text))
    for conv, expected in plain(rows).items():
        found = sorted(turns.get(conv, []))
        assert hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in found).encode()).hexdigest() == expected[-1]
        assert re.fullmatch("(s?(ua)+)?", "".join(r[:1] for _, r, _ in found))


def test_empty_tables_extra_columns_and_text_ids(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert answers(empty) == {}
    rows = spark.createDataFrame([("x", 0, "user", "a.", "1"), ("x", 1, "assistant", "b.", "2")], "conv_id string, turn int, role string, text string, audit string")
    found = repair.audits(rows).collect()
    assert [(r.conv_id, r.cost, r.audit) for r in found] == [("x", 0, "KK")]


def test_query(spark):
    rows = [tuple(r) for r in spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r[0]: tuple(r)[1:] for r in QUERIES["op13_conversation_repair"](spark, "/root/testdata/sf0.01").collect()}
    assert got == plain(rows)
