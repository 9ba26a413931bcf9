"""Repair of conversations by a generalised LR parser over the roles, with weighted edits.

The role grammar ``(s? (u a)+)?`` becomes an SLR automaton. A row is kept, given another role or deleted, and empty rows
may be put in anywhere; every edit has a price. All parses run together on a graph-structured stack: stacks share what
lies below, and stacks with equal tops merge into the one with the least (cost, audit). The audit names the edits in
order, so two audits of equal cost never start one with the other, and the least of them stays the least whatever follows.

Conversations of any length are cut into blocks that Spark sorts by range. A block that may lie inside a conversation is
parsed from every stack the grammar can reach; folding the blocks of a conversation then picks the cheapest chain.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import cache
from typing import NamedTuple

from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from tabloom.functions.skew import join_hot_keys
from tabloom.llm.common import SPACES, stored

#: Capital letters are parts of the grammar, small ones the initials of roles; what may follow each part.
RULES = (("C", ""), ("C", "P"), ("C", "sP"), ("P", "Pua"), ("P", "ua"))
FOLLOW = {"C": "$", "P": "u$"}
REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NEW_ROLES = {"u": "user", "a": "assistant"}
#: Adjacent initials that are in order.
LEGAL = {"su", "ua", "au"}
#: Rows and characters of a block at most (a longer row is a block of its own).
BLOCK_ROWS, BLOCK_CHARS = 2_000, 1 << 20
#: What a row may lack: it must be deleted, or is finished at a price.
BLANK, DUPLICATE, CUT_OFF, SOUND = range(4)

Stack = tuple  # (state, stack below or None)


class Row(NamedTuple):
    role: str
    text: str
    fault: int


@cache
def _closure(items: frozenset) -> frozenset:
    todo, seen = list(items), set(items)
    while todo:
        rule, dot = todo.pop()
        for i, (part, _) in enumerate(RULES):
            if RULES[rule][1][dot:dot + 1] == part and (i, 0) not in seen:
                seen.add((i, 0))
                todo.append((i, 0))
    return frozenset(seen)


@cache
def _after(state: frozenset, symbol: str) -> frozenset | None:
    moved = frozenset((r, d + 1) for r, d in state if RULES[r][1][d:d + 1] == symbol)
    return _closure(moved) if moved else None


#: The stack before any row: all rules of the whole are open.
EMPTY: Stack = (_closure(frozenset((i, 0) for i, (part, _) in enumerate(RULES) if part == "C")), None)


def _reduced(stack: Stack, ahead: str) -> Iterator[Stack]:
    """``stack`` and what it reduces to when ``ahead`` comes next; ``None`` stands for the whole."""
    todo = [stack]
    while todo:
        top = todo.pop()
        yield top
        if top is None:
            continue
        for rule, dot in top[0]:
            part, body = RULES[rule]
            if dot == len(body) and ahead in FOLLOW[part]:
                below = top
                for _ in body:
                    below = below[1]
                # the whole is complete only on the bottom of the stack
                if part == "C" and below[1] is None:
                    todo.append(None)
                elif part != "C" and _after(below[0], part):
                    todo.append((_after(below[0], part), below))


@cache
def shifts(stack: Stack, initial: str) -> tuple[Stack, ...]:
    """The stacks after reading one more role."""
    return tuple((_after(s[0], initial), s) for s in _reduced(stack, initial) if s and _after(s[0], initial)) if initial in NEW_ROLES or initial == "s" else ()


@cache
def accepts(stack: Stack) -> bool:
    return None in _reduced(stack, "$")


def _reachable() -> list[Stack]:
    # after a reduction equal prefixes have equal stacks, so there are few
    seen = [EMPTY]
    for s in seen:
        seen += [x for r in "sua" for x in shifts(s, r) if x not in seen]
        if len(seen) > 100:
            raise ValueError("the grammar's stacks don't end")
    return seen


STACKS = _reachable()
NUMBER = {s: i for i, s in enumerate(STACKS)}

Tops = dict  # state on top -> (cost, audit, stack)


def _put(tops: Tops, cost: int, audit: str, stack: Stack) -> bool:
    """Merge a stack into those with its top; whether it stays."""
    old = tops.get(stack[0])
    if old and (old[0], old[1]) <= (cost, audit):
        return False
    tops[stack[0]] = (cost, audit, stack)
    return True


def _insert(tops: Tops) -> Tops:
    """The stacks that rows put in here lead to, as well as those without."""
    todo = list(tops.values())
    while todo:
        cost, audit, stack = todo.pop()
        for r in NEW_ROLES:
            for s in shifts(stack, r):
                if _put(tops, cost + INSERT, audit + "I", s):
                    todo.append(tops[s[0]])
    return tops


def parse(rows: Iterable[Row], start: Stack = EMPTY) -> Tops:
    """The cheapest edits to every stack top that ``rows`` can lead to from ``start``."""
    tops: Tops = {start[0]: (0, "", start)}
    for row in rows:
        after: Tops = {}
        for cost, audit, stack in _insert(tops).values():
            _put(after, cost + DELETE, audit + "D", stack)
            if row.fault in (BLANK, DUPLICATE):
                continue
            cost += TRUNCATED if row.fault == CUT_OFF else 0
            for s in shifts(stack, row.role[:1]):
                _put(after, cost, audit + "K", s)
            for r in NEW_ROLES:
                for s in shifts(stack, r):
                    _put(after, cost + REROLE, audit + "R", s)
        tops = after
    return tops


def finish(tops: Tops) -> tuple[int, str, Stack]:
    """The cheapest edits that end in a whole conversation."""
    return min((t for t in _insert(dict(tops)).values() if accepts(t[2])), key=lambda t: t[:2])


def apply(rows: Iterable[Row], audit: str, start: Stack = EMPTY) -> list[tuple[str, str]]:
    """``(role, text)`` of the rows after the edits of ``audit``."""
    out, rows, stack = [], iter(rows), start
    for edit in audit:
        row = Row("", "", SOUND) if edit == "I" else next(rows)
        if edit == "D":
            continue
        initial = row.role[:1] if edit == "K" else next(r for r in NEW_ROLES if shifts(stack, r))
        stack = shifts(stack, initial)[0]
        out.append((row.role if edit == "K" else NEW_ROLES[initial], row.text))
    return out


def _fault(text: str, again: bool) -> int:
    end = text.rstrip(SPACES)
    return BLANK if not end else DUPLICATE if again else SOUND if end[-1] in ".!?" else CUT_OFF


_BLOCK = "conv_id {0}, part int, block int, starts boolean, faults array<bigint>, first string, last string, illegal long, rows array<struct<role:string,text:string,fault:int>>, ways array<struct<start:int,end:int,cost:bigint,audit:string>>"


def _cut(kind: str):
    """Sorted rows of a task into blocks: runs of one conversation, each parsed from the stacks that may lead to it."""
    schema = to_arrow_schema(StructType.fromDDL(_BLOCK.format(kind)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        part, block, held, out, chars = TaskContext.get().partitionId(), 0, [], [], 0

        def close(conv, starts: bool) -> None:
            nonlocal block
            ways = []
            for start in [EMPTY] if starts else STACKS:
                ways += [{"start": NUMBER[start], "end": NUMBER[s], "cost": c, "audit": a} for c, a, s in parse(held, start).values()]
            initials = [r.role[:1] for r in held]
            out.append({
                "conv_id": conv, "part": part, "block": block, "starts": starts, "first": initials[0], "last": initials[-1],
                "faults": [sum(r.fault == f for r in held) for f in (BLANK, DUPLICATE, CUT_OFF)],
                "illegal": sum(a + b not in LEGAL for a, b in zip(initials, initials[1:])), "rows": [r._asdict() for r in held], "ways": ways})
            block += 1
            held.clear()

        conv, size, starts = None, 0, False
        for b in batches:
            for c, role, text, copies, again in zip(*[b.column(i).to_pylist() for i in range(5)]):
                for copy in range(copies):
                    if held and (c != conv or len(held) >= BLOCK_ROWS or size >= BLOCK_CHARS):
                        # the first rows of a task may go on from the task before
                        close(conv, starts)
                        starts, size = c != conv, 0
                    conv = c
                    held.append(Row(role, text, _fault(text, again or copy > 0)))
                    size, chars = size + len(text), chars + len(text)
                if chars >= BLOCK_CHARS or len(out) >= 1000:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out.clear()
                    chars = 0
        if held:
            close(conv, starts)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _runs(batches: Iterator, key: str) -> Iterator[list[dict]]:
    """Rows of a sorted stream, gathered by key."""
    held: list[dict] = []
    for b in batches:
        for row in b.to_pylist():
            if held and row[key] != held[0][key]:
                yield held
                held = []
            held.append(row)
    if held:
        yield held


_REPORT = "conv_id {0}, blank long, duplicate long, truncated long, illegal long, cost long, audit string, chosen array<struct<part:int,block:int,start:int,audit:string>>"


def _fold(kind: str):
    """Blocks of each conversation, in order, into its report and the edits chosen for each block."""
    schema = to_arrow_schema(StructType.fromDDL(_REPORT.format(kind)))

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        out: list[dict] = []
        for blocks in _runs(batches, "conv_id"):
            # how the cheapest chain to each top came there: block, start, edits and what was before
            tops, chains = {EMPTY[0]: (0, "", EMPTY)}, {EMPTY[0]: None}
            for b in blocks:
                after: Tops = {}
                later: dict = {}
                for cost, audit, stack in tops.values():
                    for w in b["ways"]:
                        if w["start"] == NUMBER[stack]:
                            end = STACKS[w["end"]]
                            if _put(after, cost + w["cost"], audit + w["audit"], end):
                                later[end[0]] = ((b["part"], b["block"], w["start"], w["audit"]), chains[stack[0]])
                tops, chains = after, later
            (cost, audit), last = min(((finish({s: t})[:2], s) for s, t in tops.items()), key=lambda x: x[0])
            chain, chosen = chains[last], []
            while chain:
                (part, block, start, piece), chain = chain
                chosen.append({"part": part, "block": block, "start": start, "audit": piece})
            # rows put in behind the last block belong to it
            chosen[0]["audit"] += audit[len(tops[last][1]):]
            faults = [sum(b["faults"][i] for b in blocks) for i in range(3)]
            illegal = sum(b["illegal"] for b in blocks) + sum(a["last"] + b["first"] not in LEGAL for a, b in zip(blocks, blocks[1:]))
            out.append(dict(zip(("blank", "duplicate", "truncated"), faults)) | {"conv_id": blocks[0]["conv_id"], "illegal": illegal, "cost": cost, "audit": audit, "chosen": chosen[::-1]})
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist(out, schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    return run


def _apply_blocks(batches: Iterator) -> Iterator:
    import pyarrow as pa

    kind = pa.list_(pa.struct([("role", pa.string()), ("text", pa.string())]))
    for b in batches:
        for at in range(0, b.num_rows, 64):
            few = b.slice(at, 64)
            turns = [[{"role": r, "text": t} for r, t in apply([Row(**r) for r in row["rows"]], row["audit"], STACKS[row["start"]])]
                     for row in few.select(["rows", "start", "audit"]).to_pylist()]
            yield pa.record_batch([few.column(i) for i in range(3)] + [pa.array(turns, kind)], names=["conv_id", "part", "block", "turns"])


class Repair(NamedTuple):
    """``reports``: a row per conversation; ``turns``: its repaired turns, in arrays in order of (part, block)."""

    reports: DataFrame
    turns: DataFrame


def repair(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", copies: Column | None = None) -> Repair:
    """Repair every conversation at the least (cost, audit).

    A conversation's rows are taken by turn (nulls first), then role and text. ``copies`` tells how often a row is there
    (once by default); a conversation all of whose rows have none is still reported. Null roles and texts are one space;
    a null id is a conversation of its own. A blank row counts as blank only, one whose role and text came before as
    duplicate only, and one that doesn't end in ``.``, ``!`` or ``?`` as truncated. ``gaps`` are turns missing between
    the first and the last. Repeated rows are duplicates. An empty table gives empty results.
    """
    space = F.lit(" ")
    rows = turns.select(
        F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), space).alias("role"), F.coalesce(F.col(text_col), space).alias("text"),
        (F.lit(1) if copies is None else copies).cast("int").alias("copies"), F.monotonically_increasing_id().alias("at"))
    key = F.concat(F.coalesce(F.concat(F.lit("i"), F.col("conv_id").cast("string")), F.lit("n")), F.lit(":"), F.length("role").cast("string"), F.lit(":"), "role", "text")
    rows = stored(rows.withColumn("same", F.unhex(F.sha2(key, 256))), "turns")
    present = rows.where("copies > 0")
    # the first place of each text within its conversation; a key of many rows is never gathered
    places = present.select("same", "at", F.struct(F.col("turn").isNotNull().alias("known"), "turn", "at").alias("place"))
    firsts = stored(places.groupBy("same").agg(F.min("place").alias("first"), F.count("*").alias("times")).where("times > 1"), "repeated-turns")
    again = join_hot_keys(places, firsts, ["same"], "times").where(F.col("place") > F.col("first")).select(F.col("at").alias("again_at"))
    marked = present.hint("merge").join(again, F.col("at") == F.col("again_at"), "left").withColumn("again", F.col("again_at").isNotNull())
    order = [F.col(c).asc_nulls_first() for c in ("conv_id", "turn", "role", "text", "at")]
    ranged = marked.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "role", "text", "copies", "again")
    kind = rows.schema["conv_id"].dataType.simpleString()
    blocks = stored(ranged.mapInArrow(_cut(kind), _BLOCK.format(kind)), "blocks")
    slim = blocks.drop("rows").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    found = stored(slim.mapInArrow(_fold(kind), _REPORT.format(kind)), "reports")
    chosen = found.select(F.explode("chosen").alias("c")).select(F.col("c.part").alias("c_part"), F.col("c.block").alias("c_block"), "c.start", "c.audit")
    edited = blocks.select("conv_id", "part", "block", "rows").hint("merge").join(chosen, (F.col("part") == F.col("c_part")) & (F.col("block") == F.col("c_block")))
    repaired = edited.select("conv_id", "part", "block", "rows", "start", "audit").mapInArrow(
        _apply_blocks, f"conv_id {kind}, part int, block int, turns array<struct<role:string,text:string>>")
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = rows.groupBy("conv_id").agg(F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    named = found.drop("chosen").withColumnRenamed("conv_id", "f_conv")
    reports = gaps.hint("merge").join(named, F.col("conv_id").eqNullSafe(F.col("f_conv")), "left").select("conv_id", "gaps", *zero, F.coalesce("audit", F.lit("")).alias("audit"))
    return Repair(reports, stored(repaired, "repaired"))


def digests(turns: DataFrame) -> DataFrame:
    """``(conv_id, repaired_sha256)``: SHA-256 of the ``role:text`` of each conversation's turns, joined by line feeds.

    A digest is made in order, so the blocks of one conversation go through one task, one block at a time.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()

    def run(batches: Iterator) -> Iterator:
        import hashlib

        import pyarrow as pa

        state = conv = None
        done: list = []
        for b in batches:
            for c, block in zip(b.column(0).to_pylist(), b.column(3)):
                if state is None or c != conv:
                    done += [(conv, state.hexdigest())] if state else []
                    state, conv, first = hashlib.sha256(), c, True
                for t in block.as_py():
                    state.update(("" if first else "\n").encode() + f"{t['role']}:{t['text']}".encode("utf-8", "surrogatepass"))
                    first = False
            if len(done) >= 1000:
                yield pa.record_batch([pa.array([d[0] for d in done], b.column(0).type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])
                done = []
        if state:
            done.append((conv, state.hexdigest()))
            yield pa.record_batch([pa.array([d[0] for d in done], b.column(0).type), pa.array([d[1] for d in done], pa.string())], names=["conv_id", "repaired_sha256"])

    ordered = turns.select("conv_id", "part", "block", "turns").repartition("conv_id").sortWithinPartitions("conv_id", "part", "block")
    return ordered.mapInArrow(run, f"conv_id {kind}, repaired_sha256 string")
