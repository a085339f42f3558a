"""The repair of conversations against all paths by dynamic programming, and damage against plain Python."""

import collections
import hashlib
import random
import zlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from ridgeweave.llm import conversation as C

ROWS = "conv_id long, turn long, role string, text string, digest string, kind int, cost long, at string"


def plainly_damaged(rows):
    out = []
    for conv_id, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        die = zlib.crc32(f"{show(conv_id)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        if die == 1:
            text = ""
        if die == 2:
            text = "".join(c for c in text if c not in ".!?")
        if die == 4:
            role = "user"
        out += [(conv_id, turn, role, text)] * (0 if die == 0 else 2 if die == 3 else 1)
    return out


def digest(role, text):
    return hashlib.sha256(f"{len(role)}:{role}:{text}".encode()).digest()


def faults(rows):
    """(role, text, fault) in order, by (turn, role, text)."""
    seen, out = set(), []
    for _, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, digest(r[1] or " ", r[2]))):
        role = role or " "
        core = text.rstrip(" \t\n\v\f\r")
        out.append((role, text, "blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else ""))
        seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, audit, written rows) by relaxing every path forward, state by state."""
    best = {"": (0, "", [])}

    def legal(shape, initial):
        return {"s": "s" if shape == "" else None, "u": "u" if shape in ("", "s", "a") else None, "a": "a" if shape == "u" else None}.get(initial)

    def inserted(states):
        for _ in range(4):
            for shape, (cost, audit, done) in list(states.items()):
                for role in ("user", "assistant"):
                    then = legal(shape, role[0])
                    if then:
                        new = (cost + 3, audit + "I", [*done, f"{role}:"])
                        if then not in states or new[:2] < states[then][:2]:
                            states[then] = new
        return states

    best = inserted(best)
    for role, text, fault in rows:
        new = {}

        def offer(shape, option, new=new):
            if shape not in new or option[:2] < new[shape][:2]:
                new[shape] = option

        for shape, (cost, audit, done) in best.items():
            offer(shape, (cost + 4, audit + "D", done))
            if fault in ("blank", "duplicate"):
                continue
            charge = 3 if fault else 0
            if then := legal(shape, role[0]):
                offer(then, (cost + charge, audit + "K", [*done, f"{role}:{text}"]))
            for other in ("user", "assistant"):
                if then := legal(shape, other[0]):
                    offer(then, (cost + 3 + charge, audit + "R", [*done, f"{other}:{text}"]))
        best = inserted(new)
    return min((best[s] for s in ("", "a") if s in best), key=lambda x: x[:2])


def expected(rows, every):
    by = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        by[conv_id].append((turn, role, text))
    out = []
    for conv_id in every:
        marked = faults(by[conv_id])
        turns = [t for t, _, _ in by[conv_id] if t is not None]
        cost, audit, done = cheapest(marked)
        pairs = [a[0][0] + b[0][0] for a, b in zip(marked, marked[1:], strict=False)]
        n = collections.Counter(f for _, _, f in marked)
        gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
        out.append((conv_id, gaps, n["blank"], n["duplicate"], n["truncated"], sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest()))
    return sorted(out, key=repr)


def conversations(seed, n):
    r = random.Random(seed)
    texts = ["One.", "Two!", "Three?", "cut", "", " \n", "So it goes. ", "é.", None, "a\nb."]
    roles = ["system", "user", "assistant", "user", "assistant", "tool", "", None]
    out = []
    for conv_id in range(n):
        for k in range(r.randint(1, 12)):
            out.append((conv_id, r.choice([k, k, k, 2 * k, None]), r.choice(roles), r.choice(texts)))
    return [*out, *out[:5], (None, 1, "user", "Who?"), (None, None, None, None), (n, 0, "user", "long " * 50_000 + ".")]


def frame(spark, rows):
    return spark.createDataFrame([(*x, "d", 1, 2, "z") for x in rows], ROWS).repartition(3)


@pytest.mark.parametrize("seed", [1, 2])
def test_damaged_conversations_are_repaired_at_least_cost(spark, seed):
    rows = conversations(seed, 120)
    df = frame(spark, rows)
    hurt = plainly_damaged(rows)
    assert sorted(map(repr, map(tuple, C.damaged(df).collect()))) == sorted(map(repr, hurt))
    got = sorted((tuple(x) for x in C.report(C.damaged(df), df).collect()), key=repr)
    assert got == expected(hurt, {x[0] for x in rows})


@pytest.mark.parametrize("block", [1, 3, 50])
def test_blocks_make_no_difference(spark, monkeypatch, block):
    r = random.Random(block)
    rows = [(7, k, r.choice(["user", "assistant", "system", "tool"]), r.choice(["Yes.", f"Row {k}.", f"cut {k}", ""])) for k in range(400)]
    kinds = faults([x[1:] for x in rows])
    now = C.Conversation(7)
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    seen = set()
    for role, text, _ in kinds:
        now.add(0, role, text, (role, text) not in seen)
        seen.add((role, text))
    cost, audit, done = cheapest(kinds)
    out = now.result()
    assert (out[6], out[7], out[8]) == (cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    assert block > 3 or max(len(o.audit) for o in now.open.values()) < 100


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("suat "), st.integers(0, 3)), max_size=9))
def test_every_short_conversation(rows):
    names = ("", "blank", "duplicate", "truncated")
    ((cost, audit, _),) = C.search(rows, {C.START: (0, "")}, frozenset((C.START, C.ASSISTANT))).values()
    assert (cost, audit) == cheapest([(i, "x", names[f]) for i, f in rows])[:2]


def test_a_conversation_of_a_third_of_all_rows_streams(spark):
    rows = [(1, k, ("user", "assistant")[k % 2], f"Line {k // 3}.") for k in range(6000)] + [(2 + k // 4, k % 4, ("user", "assistant")[k % 2], f"Line {k}.") for k in range(12_000)]
    got = {x.conv_id: x for x in C.report(frame(spark, rows)).collect()}
    marked = faults([x[1:] for x in rows if x[0] == 1])
    cost, audit, done = cheapest(marked)
    assert (got[1].cost, got[1].audit, got[1].repaired_sha256) == (cost, audit, hashlib.sha256("\n".join(done).encode()).hexdigest())
    assert len(got) == 3001 and all(x.cost == 0 and x.audit == "KKKK" for x in got.values() if x.conv_id > 1)


def test_conversations_without_rows_and_empty_tables(spark):
    df = frame(spark, [(1, 0, "user", "A.")])
    (out,) = C.report(df.limit(0), df).collect()
    assert tuple(out) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    assert C.report(df.limit(0)).count() == 0 and C.repaired(df.limit(0)).count() == 0


def test_repaired_rows(spark):
    rows = conversations(3, 60)
    got = collections.defaultdict(list)
    for x in C.repaired(frame(spark, rows)).orderBy("place").collect():
        got[x.conv_id].append(f"{x.role}:{x.text}")
    for conv_id in {x[0] for x in rows}:
        mine = [(t, " " if role is None else role, " " if text is None else text) for c, t, role, text in rows if c == conv_id]
        assert got[conv_id] == cheapest(faults(mine))[2]
