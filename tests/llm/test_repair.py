"""Conversation repair against a plain shortest-path search over whole audits, and against itself in small blocks."""

import hashlib
import itertools
import random
import re
import zlib
from collections import defaultdict

import pytest

from learntrail.llm import repair


def brute_damage(rows):
    out = defaultdict(list)
    for conv, turn, role, text in rows:
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        own = out[conv]
        if k == 1:
            text = ""
        elif k == 2:
            text = re.sub("[.!?]", "", text)
        elif k == 4:
            role = "user"
        own += [] if k == 0 else [(turn, role, text)] * (2 if k == 3 else 1)
    return out


def brute(rows):
    """A conversation's result: weights of all states by rows, audits compared whole."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    seen, faults = set(), []
    for _, role, text in rows:
        signs = [c for c in text if c not in " \t\n\v\f\r"]
        faults.append("blank" if not signs else "duplicate" if (role, text) in seen else "" if signs[-1] in ".!?" else "truncated")
        seen.add((role, text))
    # the best audits for each emitted string's state: 0 nothing, 1 s, 2 ..u, 3 ..a
    def inserts(best):
        for _ in range(4):
            for q, to in ((0, 2), (1, 2), (3, 2), (2, 3)):
                if q in best:
                    w = (best[q][0] + 2, best[q][1] + "I", best[q][2] + [("user" if to == 2 else "assistant") + ":"])
                    best[to] = min(best.get(to, w), w)
        return best

    best = inserts({0: (0, "", [])})
    for (_, role, text), fault in zip(rows, faults, strict=True):
        new = {}

        def put(q, w, new=new):
            new[q] = min(new.get(q, w), w)

        for q, (cost, audit, lines) in best.items():
            put(q, (cost + 3, audit + "D", lines))
            if fault in ("blank", "duplicate"):
                continue
            cut = fault == "truncated"
            to = 3 if q == 2 else 2
            put(to, (cost + 2 + cut, audit + "R", lines + [("user" if to == 2 else "assistant") + ":" + text]))
            kept = {"s": 1 if q == 0 else None, "u": 2 if q != 2 else None, "a": 3 if q == 2 else None}.get(role[:1])
            if kept is not None:
                put(kept, (cost + cut, audit + "K", lines + [role + ":" + text]))
        best = inserts(new)
    cost, audit, lines = min(best[q] for q in (0, 3) if q in best)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in itertools.pairwise(rows))
    return (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, faults.count("blank"), faults.count("duplicate"), faults.count("truncated"), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def all_audits(signs):
    """Every audit of up to so many edits, checked by the form of what it emits."""
    n = len(signs) // 2
    for size in range(2 * n + 3):
        for audit in map("".join, itertools.product("DIKR", repeat=size)):
            if len(audit) - audit.count("I") != n:
                continue
            for free in itertools.product("ua", repeat=audit.count("I") + audit.count("R")):
                i, cost, out, choice, ok = 0, 0, "", iter(free), True
                for e in audit:
                    if e == "I":
                        cost, out = cost + 2, out + next(choice)
                        continue
                    role, fault = signs[2 * i], signs[2 * i + 1]
                    i += 1
                    ok &= e == "D" or fault != "!"
                    cost += {"D": 3, "K": 0, "R": 2}[e] + (e != "D" and fault == "-")
                    out += {"D": "", "K": role, "R": ""}[e] or ("" if e == "D" else next(choice))
                if ok and re.fullmatch("(s?(ua)+)?", out):
                    yield cost, audit


def test_agenda_finds_the_least_of_all_audits():
    rng = random.Random(1)
    cases = ["", *("".join(p) for p in itertools.product("suat", ".-!"))] + ["".join(rng.choice("suat") + rng.choice("..-!") for _ in range(rng.randint(2, 3))) for _ in range(25)]
    for signs in cases:
        assert repair.lightest(signs, goal=True)[-1] == min(all_audits(signs)), signs


def test_segments_join_to_the_same_repair():
    rng = random.Random(2)
    for _ in range(300):
        signs = "".join(rng.choice("suat") + rng.choice("...-!") for _ in range(rng.randint(0, 14)))
        cuts = sorted({0, len(signs), *(2 * rng.randint(0, len(signs) // 2) for _ in range(3))})
        parts = [signs[a:b] for a, b in itertools.pairwise(cuts)] or [""]
        items = [{(q, after): w for q in repair.STATES for after, w in repair.lightest(p, q).items()} for p in parts]
        weight, own = repair.joined_repair(items)
        assert weight == repair.lightest(signs, goal=True)[-1] and "".join(p for _, p in own) == weight[1]


def conversations(rng, n, longest, hot=0):
    texts = ["Yes.", "No", "", " \t", "What is it?", "Fine! ", "ends here. \x1c", "日本。", None, "é!"]
    roles = ["user", "assistant", "system", "user", "assistant", "tool", None, "", "unknown"]
    rows = []
    for conv in range(n):
        for turn in range(hot if conv == 0 and hot else rng.randint(1, longest)):
            if rng.random() < 0.95:
                rows.append((conv, turn, rng.choice(roles), rng.choice(texts) if rng.random() < 0.4 else f"say {rng.randrange(10**6)}" + rng.choice([".", "?", ""])))
    return rows


def result(df):
    return {r.conv_id: tuple(r)[1:] for r in df.collect()}


@pytest.mark.parametrize("hot,rows", [(0, 1024), (700, 16)])
def test_repairs_equal_brute_force(spark, monkeypatch, hot, rows):
    monkeypatch.setattr(repair, "ROWS", rows)
    data = conversations(random.Random(3), 150, 9, hot)
    df = spark.createDataFrame([(*r, 1, "x") for r in data], "conv_id long, turn long, role string, text string, block int, signs string").repartition(7)
    found = repair.repair_conversations(repair.damaged(df)).collect()
    assert len(found) == len({r[0] for r in data})
    assert {r.conv_id: tuple(r)[1:] for r in found} == {c: brute(own) for c, own in brute_damage(data).items()}


def test_odd_rows(spark):
    data = [(1, None, "user", "a."), (1, 5, "assistant", None), (2, None, None, None), (None, 1, "user", "a."), (None, 2, "assistant", "b."), (4, 9, "", "x" * 200_000), (5, 3, "user", "only\v"), (2**60 + 1, 1, "assistant", "far.")]
    schema = "conv_id long, turn long, role string, text string"
    found = result(repair.repair_conversations(repair.damaged(spark.createDataFrame(data, schema))))
    assert found == {c: brute(own) for c, own in brute_damage(data).items()}
    assert repair.repair_conversations(repair.damaged(spark.createDataFrame([], schema))).count() == 0
    gone = next(k for k in range(100) if zlib.crc32(f"{k}:0".encode()) % 20 == 0)
    nothing = result(repair.repair_conversations(repair.damaged(spark.createDataFrame([(gone, 0, "user", "x.")], schema))))
    assert nothing == {gone: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_rows_of_one_turn_are_ordered_and_repeats_are_neighbours(spark):
    data = [(1, 1, "user", "b."), (1, 1, "user", "a."), (1, 1, "user", "b."), (1, None, "user", "c.")]
    df = lambda rows: spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "false AS gone")
    one, two = (result(repair.repair_conversations(df(rows))) for rows in (data, data[::-1]))
    assert one == two and one[1][2] == 1


def test_query(spark, sf_dir):
    data = [(r.conv_id, r.turn, r.role, r.text) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()]
    assert result(repair.op12_repair(spark, sf_dir)) == {c: brute(own) for c, own in brute_damage(data).items()}
