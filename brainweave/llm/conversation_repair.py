"""Operator 11, conversation structure repair, by a rank-compressed dynamic programme.

A conversation's turns are kept, reroled to user or assistant, or deleted, and empty turns are inserted, at the least cost, until their
role initials read ``(s?(ua)+)?``. Among the cheapest ways the one whose audit (the edits' initials in order) comes first wins.

The programme has a layer per turn, and in each layer a cell per state of that grammar. A macro edit is a run of inserts and then
the turn's own edit: ``K``, ``IR``, ``IID`` and so on, of which no code begins with another. So audits of as many macros compare
like their sequences of codes, and a cell need not hold its audit: it holds the audit's rank in its layer. The next layer's audits are
ordered by (rank of the parent, code) and get ranks of their own; parent pointers give the audits back in the end.

Ranks also make stretches of a conversation composable: a block's cells are (entry state, exit state) with a cost and a rank, and
two blocks join as (cost + cost, (rank, rank)). So a conversation of any length is many blocks, in many tasks.

How it is spread: identical rows become one with a count; later copies are found by an aggregation and a join on the rows' own keys.
Rows are then dealt by ranges of (conversation, turn, role, text), so a conversation of any size is spread over tasks too.
Each task cuts what it has of a conversation into blocks of at most ``block`` rows. A conversation that lies whole in one block, as
almost all do, is finished there. Of the others only blocks' cells (at most 16 numbers each) are gathered per conversation, as a stream;
the chosen entry and exit states go back to the blocks, which rebuild their parts. Last the parts are joined in order; the
hash of a text is sequential, so a task reads one conversation's parts one after another, and holds only its audit.

Defined cases: a null role or text is one blank, so the turn is blank or can't be kept. Null turns come first; rows of one turn are ordered
by role, then text. Null ids form one conversation with a null id. Roles other than those that begin with s, u or a (among them
the empty one) can't be kept. Repeated rows are later copies. An empty table gives an empty result. Texts of any length are
moved, not changed. Columns other than the four are not read, whatever they are called.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from brainweave.llm import common

#: The grammar (s?(ua)+)? as an automaton: state -> {initial: next state}.
GRAMMAR = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
START, ENDS = 0, (0, 3)
INSERTED = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Characters other than the blank and 0x09 to 0x0D, as a class of a regular expression; marks that end a sentence.
SOLID, CLOSING = r"[^\x20\x09-\x0D]", "[.!?]"


# ---- damage and faults: DataFrame operations


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text: rows dropped, emptied, stripped of closing marks, repeated or given to the user, by a hash of their key."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(text("conv_id"), F.lit(":"), text("turn")).cast("binary")) % 20
    return (
        turns.select("conv_id", "turn", text("role").alias("role"), text("text").alias("text"), kind.alias("kind"))
        .filter("kind != 0")
        .select(
            "conv_id",
            "turn",
            F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"),
            F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", CLOSING, "")).otherwise(F.col("text")).alias("text"),
            F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("copy"),
        )
        .drop("copy")
    )


def fault(text: Column) -> Column:
    """BLANK, CUT (truncated) or 0, by the text alone."""
    last = F.substr(F.rtrim(text, F.lit(" \t\n\x0b\x0c\r")), F.lit(-1), F.lit(1))
    return F.when(~F.rlike(text, F.lit(SOLID)), BLANK).when(~F.rlike(last, F.lit(CLOSING)), CUT).otherwise(0)


def with_faults(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, fault (of the first of n identical rows), n: a row per distinct row."""
    digest = F.sha2(F.concat_ws("\x00", "role", "text"), 256)
    keyed = turns.select("*", digest.alias("digest"))
    rows = keyed.groupBy("conv_id", "turn", "digest").agg(
        F.first("role").alias("role"), F.first("text").alias("text"), F.count(F.lit(1)).alias("n")
    )
    when = F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))
    firsts = (
        keyed.groupBy("conv_id", "digest")
        .agg(F.min(when)["turn"].alias("first_turn"))
        .select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first_turn").alias("t"), F.lit(True).alias("is_first"))
    )
    same = F.col("conv_id").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & (F.col("digest") == F.col("d"))
    found = fault(F.col("text"))
    judged = F.when(found == BLANK, BLANK).when(F.col("is_first").isNull(), DUPLICATE).otherwise(found)
    return rows.join(firsts, same, "left").select("conv_id", "turn", "role", "text", judged.cast("int").alias("fault"), "n")


# ---- the programme: small helpers of the tasks


@cache
def runs(state: int) -> dict[int, int]:
    """The shortest runs of inserts from a state: {state reached: inserts}."""
    found, edge = {state: 0}, [state]
    for s in edge:
        for initial, to in GRAMMAR[s].items():
            if initial in INSERTED and to not in found:
                found[to] = found[s] + 1
                edge.append(to)
    return found


@cache
def macros(state: int, initial: str, fault: int) -> list[tuple[str, int, int]]:
    """Macro edits of a turn met in a state: (code, cost, state after it)."""
    out, more = [], TRUNCATED if fault == CUT else 0
    for at, inserts in runs(state).items():
        own = [("D", DELETE, at)]
        if fault not in (BLANK, DUPLICATE):
            own += [("K", more, GRAMMAR[at][initial])] if initial in GRAMMAR[at] else []
            own += [("R", REROLE + more, to) for x, to in GRAMMAR[at].items() if x in INSERTED]
        out += [("I" * inserts + edit, INSERT * inserts + cost, to) for edit, cost, to in own]
    return out


#: Cells of a layer, sorted: ((entry state, state), cost above the least, rank).
Cells = tuple[tuple[tuple[int, int], int, int], ...]


@lru_cache(1 << 16)
def layer(cells: Cells, initial: str, fault: int) -> tuple[Cells, int, dict[tuple[int, int], tuple[int, str]]]:
    """The next layer: its cells, what was taken off their costs, and parent pointers {cell: (state before, code)}.

    Costs are kept relative and audits are ranks, so few layers differ, and most rows find theirs made already.
    """
    best: dict = {}
    for (entry, state), cost, rank in cells:
        for code, more, to in macros(state, initial, fault):
            new, cell = (cost + more, (rank, code), (state, code)), (entry, to)
            if cell not in best or new < best[cell]:
                best[cell] = new
    least = min(v[0] for v in best.values())
    ranks = {order: i for i, order in enumerate(sorted({v[1] for v in best.values()}))}
    return tuple((c, v[0] - least, ranks[v[1]]) for c, v in sorted(best.items())), least, {c: v[2] for c, v in best.items()}


def opened(entries: Iterable[int]) -> Cells:
    return tuple(((e, e), 0, i) for i, e in enumerate(entries))


def solved(turns: Iterable[tuple[str, int]], entries: Iterable[int]) -> tuple[Cells, int, list[dict]]:
    """(cells, cost below all of them, parent pointers by layer) of turns (initial, fault)."""
    cells, base, pointers = opened(entries), 0, []
    for initial, fault in turns:
        cells, more, parents = layer(cells, initial if initial in ("s", "u", "a") else "", fault)
        base += more
        pointers.append(parents)
    return cells, base, pointers


def codes(pointers: list[dict], entry: int, state: int) -> list[str]:
    """The macros on the best way from entry to state, one a turn."""
    out = []
    for parents in reversed(pointers):
        state, code = parents[entry, state]
        out.append(code)
    return out[::-1]


def best_end(cells: dict[int, tuple[int, int]]) -> tuple[int, int, str]:
    """(cost, state before the last run of inserts, that run) of the best end; cells: {state: (cost, rank)}."""
    cost, (_, tail), state = min(
        (cost + INSERT * n, (rank, "I" * n), s) for s, (cost, rank) in cells.items() for at, n in runs(s).items() if at in ENDS
    )
    return cost, state, tail


def rebuilt(edits: Iterable[str], turns: Iterable[tuple[str, str]], state: int, tail: str) -> list[str]:
    """The repaired lines ``role:text`` of turns (role, text) that begin in a state."""
    lines = []
    for code, (role, text) in zip([*edits, *tail], [*turns, *[("", "")] * len(tail)]):
        for edit in code:
            if edit != "D":
                initial = role[:1] if edit == "K" else next(x for x in GRAMMAR[state] if x in INSERTED)
                lines.append(f"{role if edit == 'K' else INSERTED[initial]}:{'' if edit == 'I' else text}")
                state = GRAMMAR[state][initial]
    return lines


@dataclass
class Counts:
    """What is counted over a stretch of rows in order; stretches add up."""

    blank: int = 0
    duplicate: int = 0
    truncated: int = 0
    illegal: int = 0
    turns: int = 0  # distinct ones
    low: int | None = None
    high: int | None = None
    head: str | None = None  # initials of the first and last role
    last: str | None = None

    def add(self, other: Counts) -> None:
        met = self.last is not None and other.head is not None and self.last + other.head not in ("su", "ua", "au")
        self.illegal += other.illegal + met
        self.turns += other.turns - (self.high is not None and self.high == other.low)
        for name in ("blank", "duplicate", "truncated"):
            setattr(self, name, getattr(self, name) + getattr(other, name))
        self.low = other.low if self.low is None else self.low
        self.high = self.high if other.high is None else other.high
        self.head = other.head if self.head is None else self.head
        self.last = self.last if other.last is None else other.last

    def row(self, turn: int | None, role: str, fault: int) -> None:
        kinds = {BLANK: "blank", DUPLICATE: "duplicate", CUT: "truncated"}
        new = Counts(turns=int(turn is not None), low=turn, high=turn, head=role[:1], last=role[:1])
        if fault:
            setattr(new, kinds[fault], 1)
        self.add(new)

    def gaps(self) -> int:
        return 0 if self.low is None else self.high - self.low + 1 - self.turns


NUMBERS = "blank long, duplicate long, truncated long, illegal long"
COUNTS = f"{NUMBERS}, turns long, low long, high long, head string, last string"
ROW = "role string, text string, fault int, n long"


def types(kind: str) -> dict[str, str]:
    """Schemas of the tables, given the type of conv_id."""
    done = f"conv_id {kind}, gaps long, {NUMBERS}, cost long, audit string, repaired_sha256 string"
    block = f"part int, seq int, counts struct<{COUNTS}>, cells array<struct<entry int, state int, cost long, rank int>>, rows array<struct<{ROW}>>"
    return {
        "blocks": f"{done}, {block}",
        "done": done,
        "ways": f"conv_id {kind}, part int, seq int, entry int, state int, tail string, cost long",
        "parts": f"conv_id {kind}, part int, seq int, cost long, counts struct<{COUNTS}>, audit string, lines string",
    }


def emitted(rows: Iterator[dict], schema: pa.Schema, each: int = 256, chars: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Record batches of rows, of some MB each. ``_size`` of a row: its characters."""
    held, size = [], 0
    for row in rows:
        size += row.pop("_size", 0)
        held.append(row)
        if len(held) >= each or size >= chars:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    yield pa.RecordBatch.from_pylist(held, schema)


def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for at in range(0, batch.num_rows, 512):
            yield from batch.slice(at, 512).to_pylist()


def hashed(lines: Iterable[str]) -> str:
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()


def expanded(rows: list[dict]) -> Iterator[tuple[str, str, int]]:
    """(role, text, fault) of every row: identical later ones are blank or duplicates."""
    for r in rows:
        yield r["role"], r["text"], r["fault"]
        for _ in range(r["n"] - 1):
            yield r["role"], r["text"], BLANK if r["fault"] == BLANK else DUPLICATE


def cut(rows: Iterator[dict], block: int, chars: int) -> Iterator[tuple[object, int, bool, list[dict]]]:
    """(conv_id, number of the block, whether it is the last here, rows) of stretches of sorted rows, in order."""
    held: list[dict] = []
    conv, seq, count, size = None, 0, 0, 0
    for r in rows:
        if held and r["conv_id"] != conv:
            yield conv, seq, True, held
            held, seq, count, size = [], 0, 0, 0
        conv, left, fault = r["conv_id"], r["n"], r["fault"]
        while left:
            if held and (count >= block or size >= chars):
                yield conv, seq, False, held
                held, seq, count, size = [], seq + 1, 0, 0
            take = max(1, min(left, block - count))
            held.append(r | {"n": take, "fault": fault})
            fault = BLANK if fault == BLANK else DUPLICATE
            left, count, size = left - take, count + take, size + len(r["text"])
    if held:
        yield conv, seq, True, held


def blocks_of(rows: Iterator[dict], part: int, block: int, chars: int) -> Iterator[dict]:
    """A finished row per conversation that lies whole here; an open row per block of others."""
    from_here = True  # the first conversation may have begun in the task before
    stretches = cut(rows, block, chars)
    now = next(stretches, None)
    while now is not None:
        conv, seq, last, held = now
        now = next(stretches, None)
        counts = Counts()
        turns = []
        for r in held:
            for role, _, fault in expanded([r]):
                counts.row(r["turn"], role, fault)
                turns.append((role[:1], fault))
        whole = last and seq == 0 and not from_here and now is not None  # the last one may go on in the next task
        cells, base, pointers = solved(turns, (START,) if whole else GRAMMAR)
        row = {"conv_id": conv}
        if whole:
            cost, state, tail = best_end({s: (c + base, rank) for (_, s), c, rank in cells})
            edits = codes(pointers, START, state)
            lines = rebuilt(edits, [(role, text) for role, text, _ in expanded(held)], START, tail)
            row |= {"gaps": counts.gaps(), "blank": counts.blank, "duplicate": counts.duplicate, "truncated": counts.truncated}
            row |= {"illegal": counts.illegal, "cost": cost, "audit": "".join(edits) + tail, "repaired_sha256": hashed(lines), "part": -1}
        else:
            row |= {"part": part, "seq": seq, "counts": vars(counts), "rows": held, "_size": sum(len(r["text"]) for r in held)}
            row["cells"] = [{"entry": e, "state": s, "cost": c + base, "rank": rank} for (e, s), c, rank in cells]
        yield row
        from_here = from_here and not last


def ways_of(rows: Iterator[dict]) -> Iterator[dict]:
    """The entry and exit state of every block, from the cells of all of a conversation's blocks in order."""
    for conv, blocks in groupby(rows, lambda r: r["conv_id"]):
        cells, at, parents = {START: (0, 0)}, [], []
        for b in blocks:
            best: dict = {}
            for c in b["cells"]:
                if c["entry"] in cells:
                    cost, rank = cells[c["entry"]]
                    new = (cost + c["cost"], (rank, c["rank"]), c["entry"])
                    if c["state"] not in best or new < best[c["state"]]:
                        best[c["state"]] = new
            ranks = {order: i for i, order in enumerate(sorted({v[1] for v in best.values()}))}
            cells = {s: (v[0], ranks[v[1]]) for s, v in best.items()}
            parents.append({s: v[2] for s, v in best.items()})
            at.append((b["part"], b["seq"]))
        cost, state, tail = best_end(cells)
        out = []
        for (part, seq), before in zip(reversed(at), reversed(parents)):
            out.append({"conv_id": conv, "part": part, "seq": seq, "entry": before[state], "state": state, "tail": tail, "cost": cost})
            state, tail = before[state], ""
        yield from out


def parts_of(rows: Iterator[dict]) -> Iterator[dict]:
    """The audit and the repaired lines of every block, given its entry and exit state."""
    for r in rows:
        turns = list(expanded(r["rows"]))
        _, _, pointers = solved([(role[:1], fault) for role, _, fault in turns], GRAMMAR)
        edits = codes(pointers, r["entry"], r["state"])
        lines = rebuilt(edits, [(role, text) for role, text, _ in turns], r["entry"], r["tail"])
        text = "\n".join(lines) if lines else None
        yield {k: r[k] for k in ("conv_id", "part", "seq", "cost", "counts")} | {
            "audit": "".join(edits) + r["tail"],
            "lines": text,
            "_size": len(text or ""),
        }


def joined(rows: Iterator[dict]) -> Iterator[dict]:
    """A finished row per conversation, from its parts in order: only one part's text is held at a time."""
    for conv, parts in groupby(rows, lambda r: r["conv_id"]):
        counts, audit, sha, cost, any_lines = Counts(), [], hashlib.sha256(), 0, False
        for p in parts:
            counts.add(Counts(**p["counts"]))
            audit.append(p["audit"])
            cost = p["cost"]
            if p["lines"] is not None:
                sha.update((("\n" if any_lines else "") + p["lines"]).encode())
                any_lines = True
        yield {
            "conv_id": conv, "gaps": counts.gaps(), "blank": counts.blank, "duplicate": counts.duplicate, "truncated": counts.truncated,
            "illegal": counts.illegal, "cost": cost, "audit": "".join(audit), "repaired_sha256": sha.hexdigest(),
        }


# ---- the jobs


def _mapped(df: DataFrame, run: Callable[[Iterator[dict]], Iterator[dict]], schema: str) -> DataFrame:
    """df with run over the rows of each partition."""
    spark = df.sparkSession
    out = to_arrow_schema(spark.createDataFrame([], schema).schema)
    return df.mapInArrow(common.lean(lambda batches: emitted(run(rows_of(batches)), out)), schema)


def repair(turns: DataFrame, conversations: DataFrame, block: int = 4096, chars: int = 4 << 20) -> DataFrame:
    """A row per conv_id of conversations, from turns (conv_id, turn, role, text; role and text not null).

    block, chars: rows and characters of a block; they bound memory and change no result.
    """
    kind = turns.schema["conv_id"].dataType.simpleString()
    of = types(kind)
    order = ["conv_id", "turn", "role", "text"]
    dealt = with_faults(turns).repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = common.materialise(
        _mapped(dealt, lambda rows: blocks_of(rows, TaskContext.get().partitionId(), block, chars), of["blocks"]), "repair-blocks"
    )
    open_ = blocks.filter("part >= 0")
    own = ["conv_id", "part", "seq"]
    ways = _mapped(open_.select(*own, "cells").repartition("conv_id").sortWithinPartitions(*own), ways_of, of["ways"])
    same = F.col("conv_id").eqNullSafe(F.col("_conv_id")) & (F.col("part") == F.col("_part")) & (F.col("seq") == F.col("_seq"))
    found = open_.select(*own, "counts", "rows").join(ways.withColumnsRenamed({c: f"_{c}" for c in own}), same).drop(*[f"_{c}" for c in own])
    parts = _mapped(found, parts_of, of["parts"])
    late = _mapped(parts.repartition("conv_id").sortWithinPartitions(*own), joined, of["done"])
    done = blocks.filter("part < 0").select(*late.columns).unionByName(late)
    ids = conversations.select(F.col("conv_id").alias("_id")).distinct()
    numbers = [c for c in late.columns[1:] if c not in ("audit", "repaired_sha256")]
    return ids.join(done, F.col("_id").eqNullSafe(F.col("conv_id")), "left").select(
        F.col("_id").alias("conv_id"),
        *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce("audit", F.lit("")).alias("audit"),
        F.coalesce("repaired_sha256", F.lit(hashed([]))).alias("repaired_sha256"),
    )


def repair_damaged(conversations: DataFrame, block: int = 4096) -> DataFrame:
    """The repairs of conversations (conv_id, turn, role, text) after ``damage``."""
    return repair(damage(conversations), conversations, block)
