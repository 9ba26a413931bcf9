"""Conversation repair against an exhaustive search over edits."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from tabloom.llm import conversation as C
from tabloom.llm.queries import QUERIES, damaged

ROLES = ["user", "assistant", "system", "tool", " "]


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        end = re.sub(r"[\x20\x09-\x0d]+$", "", text)
        out.append("blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def exhaustive(rows):
    """(cost, audit, repaired turns) of the best edits, from all edits with up to two rows put in at each place."""
    best, marks = None, faults(rows)
    ways = []
    for (role, text), mark in zip(rows, marks):
        own = [("D", 4, None)]
        if mark not in ("blank", "duplicate"):
            more = 3 if mark == "truncated" else 0
            own += [("K", more, (role, text)), ("R", 3 + more, ("user", text)), ("R", 3 + more, ("assistant", text))]
        ways.append(own)
    put = [[], ["user"], ["assistant"], ["user", "assistant"], ["assistant", "user"]]
    for chosen in itertools.product(*ways):
        for gaps in itertools.product(put, repeat=len(rows) + 1):
            cost, audit, out = 0, "", []
            for i, gap in enumerate(gaps):
                cost, audit, out = cost + 3 * len(gap), audit + "I" * len(gap), out + [(r, "") for r in gap]
                if i < len(rows):
                    letter, price, turn = chosen[i]
                    cost, audit, out = cost + price, audit + letter, out + ([turn] if turn else [])
            if re.fullmatch("(s?(ua)+)?", "".join(r[:1] for r, _ in out)) and (best is None or (cost, audit) < best[:2]):
                best = (cost, audit, out)
    return best


def chain(rows):
    """The same for long conversations: cheapest (cost, audit, turns) by what the last kept role was."""
    nexts = {"": "su", "s": "u", "u": "a", "a": "u"}
    state = {"": (0, "", ())}

    def put(at, key, value):
        if key not in at or value[:2] < at[key][:2]:
            at[key] = value

    def grown(state):
        for _ in range(3):
            for last, (c, a, out) in list(state.items()):
                for r in ("user", "assistant"):
                    if r[0] in nexts[last]:
                        put(state, r[0], (c + 3, a + "I", (*out, (r, ""))))
        return state

    for (role, text), mark in zip(rows, faults(rows)):
        after = {}
        for last, (c, a, out) in grown(state).items():
            put(after, last, (c + 4, a + "D", out))
            if mark in ("blank", "duplicate"):
                continue
            c += 3 if mark == "truncated" else 0
            if role[:1] and role[:1] in nexts[last]:
                put(after, role[:1], (c, a + "K", (*out, (role, text))))
            for r in ("user", "assistant"):
                if r[0] in nexts[last]:
                    put(after, r[0], (c + 3, a + "R", (*out, (r, text))))
        state = after
    return min((v for k, v in grown(state).items() if k in ("", "a")), key=lambda v: v[:2])


def random_rows(rng, n):
    return [(rng.choice(ROLES), rng.choice(["yes.", "no", "why? ", " \t", "", f"w{rng.randrange(9)}!"])) for _ in range(n)]


def test_parser_against_all_edits():
    rng = random.Random(3)
    for n in [0, 1, 1, 2, 2, 2, 3, 3, 3, 3]:
        rows = random_rows(rng, n)
        kinds = {"blank": C.BLANK, "duplicate": C.DUPLICATE, "truncated": C.CUT_OFF, "": C.SOUND}
        parsed = [C.Row(r, t, kinds[f]) for (r, t), f in zip(rows, faults(rows))]
        cost, audit, _ = C.finish(C.parse(parsed))
        want = exhaustive(rows)
        assert (cost, audit) == want[:2] == chain(rows)[:2]
        assert C.apply(parsed, audit) == want[2] == list(chain(rows)[2])


def expected(conversation):
    """Report of a conversation given as (turn, role, text, copies), by the rules of the contract."""
    rows = [(t, " " if r is None else r, " " if x is None else x) for t, r, x, n in conversation for _ in range(n)]
    rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [(r, x) for _, r, x in rows]
    marks, (cost, audit, out) = faults(pairs), chain(pairs)
    initials = [r[:1] for r, _ in pairs]
    return {"gaps": max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **{f: marks.count(f) for f in ("blank", "duplicate", "truncated")},
            "illegal": sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), "cost": cost, "audit": audit,
            "sha": hashlib.sha256("\n".join(f"{r}:{x}" for r, x in out).encode()).hexdigest()}


def run(spark, conversations):
    rows = [(c, t, r, x, n, "clash") for c, own in conversations for t, r, x, n in own]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, n int, audit string")
    found = C.repair(df, copies=F.col("n"))
    signed = {r["conv_id"]: r["repaired_sha256"] for r in C.digests(found.turns).collect()}
    empty = hashlib.sha256(b"").hexdigest()
    return {r["conv_id"]: {k: r[k] for k in r.asDict() if k != "conv_id"} | {"sha": signed.get(r["conv_id"], empty)} for r in found.reports.collect()}


@pytest.mark.parametrize("block", [2_000, 3])
def test_repair_of_many_conversations(spark, monkeypatch, block):
    """Nulls, ties, repeated and dropped rows, a long conversation and one without id, at any size of blocks."""
    monkeypatch.setattr(C, "BLOCK_ROWS", block)
    rng = random.Random(7)
    made = [(i, [(t, r, x, rng.choice([1, 1, 1, 2, 0])) for t, (r, x) in enumerate(random_rows(rng, rng.randrange(1, 9)))]) for i in range(60)]
    made += [(100, [(None, "user", "a.", 1), (None, None, None, 1), (2, "assistant", "b.", 1), (2, "assistant", "b.", 1), (2, "user", "", 1)])]
    made += [(101, [(0, "user", "x.", 0)]), (102, [(5, "assistant", "only", 1)]), (103, [(None, "system", "s.", 1)])]
    made += [(None, [(t, *random_rows(rng, 1)[0], 1) for t in range(40)]), (104, [(t // 2, rng.choice(ROLES), f"text {t}.", 1) for t in range(300)])]
    got = run(spark, made)
    assert got == {c: expected(own) for c, own in made}


def test_very_long_rows_and_empty_table(spark, monkeypatch):
    monkeypatch.setattr(C, "BLOCK_CHARS", 1000)
    long = [(1, [(0, "user", "word " * 5000 + ".", 1), (1, "assistant", "x" * 3000, 1), (2, "user", "?", 1)])]
    assert run(spark, long) == {1: expected(long[0][1])}
    assert run(spark, [(0, [])]) == {}


def test_query_damages_by_hash(spark, tmp_path):
    rng, rows = random.Random(5), []
    for c in [*range(40), None]:
        rows += [(c, t, r, x) for t, (r, x) in enumerate(random_rows(rng, 6))] + [(c, None, "user", None)]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    made: dict = {}
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if d == 1 else re.sub("[.!?]", "", " " if x is None else x) if d == 2 else x
        made.setdefault(c, []).append((t, "user" if d == 4 else r, x, {0: 0, 3: 2}.get(d, 1)))
    got = {r["conv_id"]: r for r in QUERIES["op11_conversation_repair"](spark, str(tmp_path)).collect()}
    assert set(got) == set(made)
    for c, own in made.items():
        want = expected(own)
        assert {k: got[c][k] for k in want if k != "sha"} | {"sha": got[c]["repaired_sha256"]} == want
    assert damaged(spark.read.parquet(f"{tmp_path}/conversations.parquet")).count() == len(rows)
