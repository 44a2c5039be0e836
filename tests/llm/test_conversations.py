"""The repair of conversations against all edits of short ones, and over segments, hot and odd rows."""

import hashlib
import re
import zlib
from itertools import product

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from strandloom.llm import conversations as C

SCHEMA = "conv_id long, turn long, role string, text string, score double, `a.b` string"


def brute_damage(rows):
    """{conv_id: [(turn, role, text)]} after damage, in order."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        case = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if case == 0:
            continue
        if case == 1:
            text = ""
        if case == 2:
            text = re.sub("[.!?]", "", text)
        mine += [(turn, "user" if case == 4 else role, text)] * (2 if case == 3 else 1)
    return {k: sorted(v, key=lambda x: (x[0] is not None, x[0] or 0, x[1], x[2])) for k, v in out.items()}


def brute_faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        words = re.sub(r"[\x20\x09-\x0D]+\Z", "", text)
        out.append("blank" if not words else "duplicate" if (role, text) in seen else "truncated" if words[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def brute_search(rows, faults, most_inserts=2):
    """Every choice of edits, the shortest inserts anywhere."""
    best = None
    choices = [["D"] if f in ("blank", "duplicate") else ["K", "Ru", "Ra", "D"] for f in faults]
    gaps = ["".join(x) for n in range(most_inserts + 1) for x in product("ua", repeat=n)]
    for edits in product(*choices):
        for inserted in product(gaps, repeat=len(rows) + 1):
            cost, audit, turns = 0, "", []
            for i in range(len(rows) + 1):
                for x in inserted[i]:
                    cost, audit = cost + 3, audit + "I"
                    turns.append(({"u": "user", "a": "assistant"}[x], ""))
                if i == len(rows):
                    break
                _, role, text = rows[i]
                audit += edits[i][0]
                if edits[i] == "D":
                    cost += 4
                    continue
                cost += 3 * (faults[i] == "truncated") + 3 * (edits[i] != "K")
                turns.append(({"K": role, "Ru": "user", "Ra": "assistant"}[edits[i]], text))
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in turns)):
                key = (cost, audit, "\n".join(f"{r}:{t}" for r, t in turns))
                best = key if best is None or key < best else best
    return best


def brute_row(rows, inserts=2):
    faults = brute_faults(rows)
    initials = [r[1][:1] for r in rows]
    turns = {r[0] for r in rows} - {None}
    cost, audit, said = brute_search(rows, faults, inserts)
    return (
        max(turns) - min(turns) + 1 - len(turns) if turns else 0,
        *(faults.count(x) for x in ("blank", "duplicate", "truncated")),
        sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:], strict=False)),
        cost,
        audit,
        hashlib.sha256(said.encode()).hexdigest(),
    )


def run(rows):
    now = C.Running()
    for (turn, role, text), fault in zip(rows, brute_faults(rows), strict=True):
        now.add(turn, role, text, ["", "blank", "duplicate", "truncated"].index(fault))
    return now.result()


row = st.tuples(st.sampled_from(["user", "assistant", "system", "tool", "", " "]), st.sampled_from(["Hi.", "Yes!", "no", "", " \t", "Why?\n"]))


@settings(max_examples=60, deadline=None)
@given(st.lists(row, max_size=3))
def test_search_as_all_edits(rows):
    rows = [(i, *r) for i, r in enumerate(rows)]
    assert run(rows) == brute_row(rows)


@settings(max_examples=80, deadline=None)
@given(st.lists(row, max_size=14), st.integers(1, 5))
def test_segments_change_nothing(rows, segment):
    rows = [(i, *r) for i, r in enumerate(rows)]
    whole = run(rows)
    held, C.SEGMENT = C.SEGMENT, segment
    try:
        assert run(rows) == whole
    finally:
        C.SEGMENT = held


def odd_rows():
    rows = [(None, None, None, None), (None, 3, "user", "A."), (None, None, "assistant", None), (7, None, "user", "Null turn."), (7, -5, "assistant", "x" * 300_000 + "."), (7, 9, "user", "End.")]
    rows += [(8, 1, "user", "Twice."), (8, 1, "user", "Twice."), (8, 2, "assistant", "Yes."), (8, 2, "", "No role.")]
    rows += [(c, t, ["user", "assistant"][t % 2], f"Turn {t % 3}" + "." * (t % 4 > 0)) for c in range(100, 140) for t in range(c % 4)]
    return rows


def test_odd_rows_as_by_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, 0.5, "x") for r in rows], SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repairs(C.damaged(df)).collect()}
    broken = brute_damage(rows)
    assert set(got) == set(broken)
    for conv, mine in broken.items():
        assert got[conv] == brute_row(mine, 1 if len(mine) > 3 else 2), conv


def test_dropped_conversations_and_empty_tables(spark):
    lost = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = spark.createDataFrame([(lost, 0, "user", "Gone.", 1.0, "")], SCHEMA)
    assert [tuple(r) for r in C.repairs(C.damaged(df)).collect()] == [(lost, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert C.repairs(C.damaged(df.limit(0))).collect() == []
    assert C.repaired_turns(C.given(df.limit(0))).collect() == []


def test_one_hot_conversation_over_many_segments(spark):
    n = 3 * C.SEGMENT + 17
    df = spark.range(n).selectExpr("5L as conv_id", "id as turn", "if(id % 2 = 0 or id % 97 = 0, 'user', 'assistant') as role", "concat('Turn ', id, if(id % 31 = 0, '', '.')) as text")
    found = C.repairs(C.given(df))
    (got,) = found.collect()
    turns = C.repaired_turns(C.given(df), found).orderBy("place").collect()
    assert got["gaps"] == 0 and len(got["audit"].replace("I", "")) == n
    assert re.fullmatch("(s?(ua)+)?", "".join(t["role"][0] for t in turns))
    said = "\n".join(f"{t['role']}:{t['text']}" for t in turns)
    assert hashlib.sha256(said.encode()).hexdigest() == got["repaired_sha256"]
    assert [t["place"] for t in turns] == list(range(len(turns)))


@pytest.mark.parametrize("name", ["op11_conversation_repair"])
def test_query_on_the_given_table(spark, sf, name):
    from strandloom.llm.queries import QUERIES

    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in QUERIES[name](spark, sf).collect()}
    broken = brute_damage(rows)
    assert got.keys() == broken.keys()
    for conv, mine in broken.items():
        assert got[conv] == run(mine)
        if len(mine) < 4:
            assert got[conv] == brute_row(mine)
