import hashlib
import random
import re
import zlib

import pytest

from brainweave.llm import conversation_repair as repair

SOLID = re.compile(r"[^\x20\x09-\x0D]")
SCHEMA = "conv_id long, turn long, role string, text string"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = role if role is not None else " ", text if text is not None else " "
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        row = (conv, turn, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        out += [] if kind == 0 else [row] * (2 if kind == 3 else 1)
    return out


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        solid = SOLID.findall(text)
        out.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Best (cost, audit, repaired lines) by a programme that holds whole strings, an insert at a time."""
    state = {"": (0, "", ())}  # role initials so far, shortened to the last two
    keep = lambda x: x if len(x) < 3 else ("s" if x[0] == "s" else "") + "ua" + ("u" if x[-1] == "u" else "")

    def better(into, key, value):
        if re.fullmatch(r"s?(ua)*u?", key) and (keep(key) not in into or value < into[keep(key)]):
            into[keep(key)] = value

    def inserted(now):
        for _ in range(3):
            new = dict(now)
            for x, (c, a, r) in now.items():
                for i, name in (("u", "user"), ("a", "assistant")):
                    better(new, x + i, (c + 5, a + "I", (*r, f"{name}:")))
            now = new
        return now

    for (_, role, text), fault in zip(rows, faults(rows)):
        new, more = {}, 5 if fault == "truncated" else 0
        for x, (c, a, r) in inserted(state).items():
            better(new, x, (c + 2, a + "D", r))
            if fault not in ("blank", "duplicate"):
                if role[:1]:
                    better(new, x + role[:1], (c + more, a + "K", (*r, f"{role}:{text}")))
                for i, name in (("u", "user"), ("a", "assistant")):
                    better(new, x + i, (c + more + 1, a + "R", (*r, f"{name}:{text}")))
        state = new
    return min(v for x, v in inserted(state).items() if GRAMMAR.fullmatch(x))


def brute(rows):
    out, after = [], damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted(((t, r, x) for c, t, r, x in after if c == conv), key=lambda v: (v[0] is not None, v[0] or 0, v[1].encode(), v[2].encode()))
        turns = {t for t, _, _ in own if t is not None}
        found = faults(own)
        cost, audit, lines = cheapest(own)
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:]))
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        out.append((conv, gaps, *(found.count(k) for k in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha))
    return sorted(out, key=repr)


def conversations(seed, count=60, most=9):
    r = random.Random(seed)
    texts = ["Yes.", "No!", "cut", "cut ", " ", "", "é?", "a\nb.", "Same text.", None, "\t\r\n", "x. "]
    rows = []
    for conv in [*range(count), None]:
        turn = r.randrange(3)
        for _ in range(r.randrange(1, most)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", "u", "", None])
            rows.append((conv, r.choice([turn, turn, None]) if r.random() < 0.1 else turn, role, r.choice(texts)))
            turn += r.choice([0, 1, 1, 1, 1, 3])
    return rows


@pytest.mark.parametrize("seed, block", [(1, 4096), (2, 1), (3, 3)])
def test_agrees_with_brute_force(spark, seed, block):
    rows = conversations(seed) + [(99, 5, "user", "Same.")] * 40 + [(98, i, "user", "Hot.") for i in range(30)]
    r = random.Random(seed)
    rows += [(97, i, r.choice(["user", "assistant", "system"]), f"{r.random()}{r.choice(['.', ''])}") for i in range(80)]
    got = repair.repair_damaged(spark.createDataFrame(rows, SCHEMA).repartition(3), block)
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == brute(rows)


def test_blocks_compose(spark):
    """Cells of blocks, joined, give what one block gives, wherever it is cut."""
    r = random.Random(5)
    for _ in range(200):
        rows = [{"conv_id": 1, "turn": i, "role": r.choice(["user", "assistant", "system", "tool"]), "text": f"{i}.", "fault": r.choice([0, 0, 0, 1, 2, 3]), "n": r.choice([1, 1, 1, 3])} for i in range(r.randrange(1, 25))]
        results = set()
        for block in (1, 2, 7, 1000):
            open_ = list(repair.blocks_of(iter(rows), 0, block, 1 << 20))
            ways = {w["seq"]: w for w in repair.ways_of(iter(open_))}
            parts = list(repair.parts_of(iter([b | ways[b["seq"]] for b in open_])))
            (done,) = repair.joined(iter(parts))
            results.add(tuple(done.values()))
        assert len(results) == 1


def test_codes_are_prefix_free():
    for initial in ("s", "u", "a", ""):
        for state in repair.GRAMMAR:
            found = {code for code, _, _ in repair.macros(state, initial, 0)}
            assert not any(a != b and b.startswith(a) for a in found for b in found)


def test_empty_null_and_clashing_columns(spark):
    assert repair.repair_damaged(spark.createDataFrame([], SCHEMA)).count() == 0
    wide = spark.createDataFrame([(1, 0, "user", "Hi.", 3, "x"), (1, 1, "assistant", "Yo." * 500_000, 4, "y")], SCHEMA + ", n int, fault string")
    (row,) = repair.repair_damaged(wide).collect()
    assert (row.cost, row.audit) == (0, "KK")
    dropped = next(i for i in range(1000) if zlib.crc32(f"{i}:0".encode()) % 20 == 0)
    (row,) = repair.repair_damaged(spark.createDataFrame([(dropped, 0, "user", "Hi.")], SCHEMA)).collect()
    assert tuple(row) == (dropped, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
