"""Conversation repair against exhaustive search in plain Python, with damage, nulls, ties and long conversations."""

import hashlib
import heapq
import random
import re
import zlib
from collections import defaultdict

import pytest

from sparrowmill.llm import conversation_repair as repair

TURNS = "conv_id long, turn long, role string, text string, audit string, gaps int, state long, edit string"
WHITE = " \t\n\v\f\r"


def damage(rows):
    """Rows by conversation, in order; conversations without rows too."""
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        out[conv] += []
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            out[conv] += [(turn, "user" if h == 4 else role, text)] * (2 if h == 3 else 1)
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())) for c, rs in out.items()}


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        shown = text.rstrip(WHITE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows):
    """Uniform-cost search over whole label strings and role initials, without any machine: the grammar is a regex."""
    marks, queue, done = faults(rows), [(0, "", 0, "", ())], set()
    while queue:
        cost, labels, i, roles, out = heapq.heappop(queue)
        if i == len(rows) and re.fullmatch("(s?(ua)+)?", roles):
            return cost, labels, "\n".join(out)
        key = (i, roles[-1:])
        if (key, "all") in done or not re.fullmatch("s?(ua)*u?", roles):
            continue
        # a state is left once, by its least (cost, labels)
        done.add((key, "all"))
        for r in "ua":
            heapq.heappush(queue, (cost + 5, labels + "I", i, roles + r, (*out, {"u": "user", "a": "assistant"}[r] + ":")))
        if i < len(rows):
            _, role, text = rows[i]
            heapq.heappush(queue, (cost + 2, labels + "D", i + 1, roles, out))
            if marks[i] not in ("blank", "duplicate"):
                more = 5 if marks[i] == "truncated" else 0
                if role:
                    heapq.heappush(queue, (cost + more, labels + "K", i + 1, roles + role[0], (*out, f"{role}:{text}")))
                for r in ("user", "assistant"):
                    heapq.heappush(queue, (cost + 1 + more, labels + "R", i + 1, roles + r[0], (*out, f"{r}:{text}")))


def brute(rows, damaged=True):
    by = damage(rows) if damaged else None
    out = []
    for conv, rs in by.items():
        marks = faults(rs)
        turns = {t for t, *_ in rs if t is not None}
        illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rs, rs[1:]))
        cost, labels, text = cheapest(rs)
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *[marks.count(m) for m in ("blank", "duplicate", "truncated")], illegal, cost, labels, hashlib.sha256(text.encode()).hexdigest()))
    return sorted(out, key=str)


def table(spark, rows):
    return spark.createDataFrame([(*r, "a", 1, 2, "e") for r in rows], TURNS).repartition(3)


def conversations(n, seed):
    rnd = random.Random(seed)
    rows = []
    for conv in range(n):
        turn = rnd.randrange(3)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 5, 8, 14])):
            role = rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "usher"])
            text = rnd.choice(["a.", "b!", "c? \n", "cut", "", " \v", None, "é.", "漢", "x." + rnd.choice("abcdef") + "?", "z\u0085", "new. " + str(rnd.random()) + "."])
            rows.append((rnd.choice([conv] * 30 + [None]), rnd.choice([turn] * 12 + [None]), role, text))
            turn += rnd.choice([0, 1, 1, 1, 1, 2, 4])
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_like_exhaustive_search(spark, seed):
    rows = conversations(120, seed)
    got = sorted(map(tuple, repair.repair_report(table(spark, rows), damage=True).collect()), key=str)
    assert got == brute(rows)


def test_long_and_empty(spark):
    assert repair.repair_report(table(spark, []), damage=True).count() == 0
    rnd = random.Random(9)
    rows = [(1, i, rnd.choice(["user", "assistant"]), f"text {rnd.random()}" + rnd.choice([".", "!", ""])) for i in range(3000)]
    rows += [(2, i, "user", "same.") for i in range(2000)]
    dropped = next(i for i in range(10_000) if zlib.crc32(f"3:{i}".encode()) % 20 == 0)
    rows.append((3, dropped, "user", "gone."))
    got = {r.conv_id: r for r in repair.repair_report(table(spark, rows), damage=True).collect()}
    assert sorted(map(tuple, got.values()), key=str) == brute(rows)
    assert tuple(got[3])[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())


def test_no_texts_are_held_however_long_a_conversation_is():
    """Even where paths never agree: of users alone, the first row's edit depends on how many follow."""
    rnd = random.Random(4)
    for roles in (["user", "assistant"], ["user"], ["user", "assistant", "tool", "system"]):
        now = repair.Conversation(1, keep=False)
        for i in range(4000):
            now.add(i, rnd.choice(roles), f"t{i}.", rnd.choice([None, None, "truncated", "blank"]))
            assert not now.rows and len(now.paths) <= 4
        assert len(now.end()[7]) >= 4000
    now = repair.Conversation(1, keep=False)
    for i in range(20_000):
        now.add(i, "user", f"t{i}.", None)
    assert now.end()[6] == 10_000


def test_repaired_turns_make_up_the_report(spark):
    rows = conversations(60, 7)
    report = {r.conv_id: r for r in repair.repair_report(table(spark, rows), damage=True).collect()}
    turns = defaultdict(list)
    for r in sorted(repair.repaired_turns(table(spark, rows), damage=True).collect(), key=lambda r: (str(r.conv_id), r.at)):
        turns[r.conv_id].append(r)
    for conv, r in report.items():
        assert "".join(t.edit for t in turns[conv]) == r.audit
        kept = [t for t in turns[conv] if t.edit != "D"]
        assert hashlib.sha256("\n".join(f"{t.role}:{t.text}" for t in kept).encode()).hexdigest() == r.repaired_sha256
        assert re.fullmatch("(s?(ua)+)?", "".join(t.role[0] for t in kept))


def test_without_damage(spark):
    rows = [(1, 0, "user", "Hi."), (1, 1, "assistant", "Yes."), (2, 0, "user", "Hi"), (2, 1, "user", "Ho."), (2, 3, "user", "Ho.")]
    got = {r.conv_id: (r.gaps, r.duplicate, r.truncated, r.illegal, r.cost, r.audit) for r in repair.repair_report(table(spark, rows)).collect()}
    assert got == {1: (0, 0, 0, 0, 0, "KK"), 2: (1, 1, 1, 2, 6, "DDD")}
