"""Conversation repair against a search over all states, and its SQL twin's small cases."""

import random
import zlib
from hashlib import sha256

import pytest

from revlens.llm import repair

SPACE = " \t\n\x0b\x0c\r"


def fault(role, text, seen):
    bare = text.strip(SPACE)
    out = "b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "-"
    seen.add((role, text))
    return out


def cheapest(rows):
    """(cost, letters, lines) by keeping the least of each state after each row; inserts are tried until nothing gets less."""
    best = {"": (0, "", ())}
    follows = {"": {"s": "s", "u": "u"}, "s": {"u": "u"}, "u": {"a": "a"}, "a": {"u": "u"}}
    names = {"u": "user", "a": "assistant"}

    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value
            return True
        return False

    def inserted(table):
        while any([better(table, to, (c + 5, a + "I", o + (names[x] + ":",))) for s, (c, a, o) in list(table.items()) for x, to in follows[s].items() if x in names]):
            pass

    inserted(best)
    for role, text, kind in rows:
        after = {}
        for state, (cost, letters, lines) in best.items():
            better(after, state, (cost + 2, letters + "D", lines))
            if kind in "-t":
                more = 5 * (kind == "t")
                for x, to in follows[state].items():
                    if role[:1] == x:
                        better(after, to, (cost + more, letters + "K", (*lines, f"{role}:{text}")))
                    if x in names:
                        better(after, to, (cost + more + 1, letters + "R", (*lines, f"{names[x]}:{text}")))
        inserted(after)
        best = after
    return min(best[s] for s in ("", "a") if s in best)


def expected(turns):
    """Rows (conv_id, turn, role, text) to digests, one chat at a time."""
    chats = {}
    for conv, turn, role, text in turns:
        own = chats.setdefault(conv, [])
        role, text = (" " if x is None else x for x in (role, text))
        kind = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if kind == 1 else "".join(c for c in text if c not in ".!?") if kind == 2 else text
        own += [(turn is not None, turn or 0, "user" if kind == 4 else role, text, turn)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    out = []
    for conv, own in chats.items():
        own.sort(key=lambda x: (x[0], x[1], x[2].encode(), x[3].encode()))
        seen = set()
        faults = [fault(x[2], x[3], seen) for x in own]
        at = [x[4] for x in own if x[4] is not None]
        pairs = [a[2][:1] + b[2][:1] for a, b in zip(own, own[1:], strict=False)]
        cost, letters, lines = cheapest([(x[2], x[3], f) for x, f in zip(own, faults, strict=True)])
        gaps = max(at) - min(at) + 1 - len(set(at)) if at else 0
        illegal = sum(p not in ("su", "ua", "au") for p in pairs)
        out.append((conv, gaps, *(faults.count(f) for f in "bdt"), illegal, cost, letters, sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def chats(seed, n, longest):
    rng = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(rng.randint(1, longest)):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "Übung", None, "", "aide"])
            text = rng.choice(["Yes.", "No!", "Why", "Why?", "", " \n", None, "ok . ", "a\x85", "語", "x" * 50, f"t{turn}."])
            rows.append((conv, rng.choice([turn, turn, turn, turn * 3, None, turn // 2]), role, text))
    rows += [(None, i, r, f"n{i}.") for i, r in enumerate(["user", "assistant", "user"])] + rows[:20]
    return rows


@pytest.mark.parametrize("segment", [128, 3, 1])
def test_random_chats(spark, monkeypatch, segment):
    monkeypatch.setattr(repair, "SEGMENT", segment)
    rows = chats(segment, 120, 14) + [(1000, i, ["user", "assistant", "system", "user", "user"][i * i % 5], f"w{i % 61}" + "." * (i % 3)) for i in range(300)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as pos", "1 as seg", "2 as code", "3 as `left`").repartition(5)
    assert sorted(map(tuple, repair.repaired_after_damage(df).collect()), key=repr) == expected(rows)


def test_costs_are_those_of_the_auction():
    rng = random.Random(3)
    for _ in range(300):
        codes = "".join(rng.choice("suax") + rng.choice("--bdt") for _ in range(rng.randint(0, 12)))
        cost, letters, after = repair.solved(codes, repair.END, repair.NOTHING)
        want = cheapest([({"x": "?"}.get(codes[i], codes[i]), "", codes[i + 1]) for i in range(0, len(codes), 2)])
        assert (cost, letters) == want[:2] and after in (repair.NOTHING, repair.AFTER_A)


def test_long_chat(spark):
    rows = [(1, i, "user" if i % 3 else "assistant", f"{i}." if i % 7 else f"{i}") for i in range(3000)] + [(2, 0, "user", "long " * 200_000 + ".")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    assert sorted(map(tuple, repair.repaired_after_damage(df).collect()), key=repr) == expected(rows)


def test_edits_and_empty(spark):
    rows = [("a", 0, "user", "Hi."), ("a", 1, "user", "Hi."), ("a", 2, "tool", "Done.")]
    df = spark.createDataFrame(rows, "conv_id string, turn long, role string, text string")
    got = [(r["at"], r["edit"], r["turn"], r["was"], r["role"]) for r in repair.repaired(df).orderBy("at").collect()]
    assert got == [(0, "K", 0, "user", "user"), (1, "D", 1, "user", "user"), (2, "R", 2, "tool", "assistant")]
    assert repair.repaired_after_damage(df.limit(0)).collect() == []
