"""Conversation repair against a plain search for the least edits."""

import hashlib
import random
import zlib
from functools import cache

import pytest
from agvlens.llm import turns

SPACE = " \t\n\x0b\x0c\r"


def plain_damage(rows):
    out = {}
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        role, text = show(role), show(text)
        mine = out.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else text.translate({ord(c): None for c in ".!?"}) if fate == 2 else text
        mine += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
    return out


def plain_repair(rows):
    """Rows (turn, role, text) in order; the report's fields."""
    seen, kinds = set(), []
    for _, role, text in rows:
        solid = text.strip(SPACE)
        kinds.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}

    @cache
    def best(i, q, inserted):
        ways = []
        if i == len(rows) and q in (0, 3):
            ways.append((0, "", ()))
        for letter, to in step[q].items():
            if letter != "s" and inserted < 2:
                c, a, r = best(i, to, inserted + 1)
                ways.append((5 + c, "I" + a, ({"u": "user", "a": "assistant"}[letter] + ":", r)))
        if i < len(rows):
            _, role, text = rows[i]
            c, a, r = best(i + 1, q, 0)
            ways.append((2 + c, "D" + a, r))
            if kinds[i] not in ("blank", "duplicate"):
                more = 5 if kinds[i] else 0
                for letter, to in step[q].items():
                    c, a, r = best(i + 1, to, 0)
                    if role[:1] == letter:
                        ways.append((more + c, "K" + a, (f"{role}:{text}", r)))
                    if letter != "s":
                        ways.append((more + 1 + c, "R" + a, ({"u": "user", "a": "assistant"}[letter] + f":{text}", r)))
        return min(ways, key=lambda w: w[:2], default=(10**9, "", ()))

    cost, audit, left = best(0, 0, 0)
    lines = []
    while left:
        lines.append(left[0])
        left = left[1]
    ts = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:], strict=False)]
    return (max(ts) - min(ts) + 1 - len(set(ts)) if ts else 0, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")],
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


FIELDS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
SCHEMA = "conv_id long, turn long, role string, text string"


def conversations_of(seed, n, longest):
    dice = random.Random(seed)
    rows = []
    for conv in range(n):
        for turn in range(dice.randint(0, longest)):
            role = dice.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            text = dice.choice(["Yes.", "No!", "cut", "", " \t", None, f"t{conv}-{turn}.", f"t{conv}-{turn} \n", "　"])
            rows.append((conv, turn + dice.choice([0, 0, 0, 100]) if dice.random() > 0.02 else None, role, text))
    return rows


def ordered(spark, rows):
    """Rows of each conversation in the operator's order; ties by digest are taken from Spark."""
    from pyspark.sql import functions as F

    flat = [(c, *r) for c, rs in rows.items() for r in rs]
    df = spark.createDataFrame(flat, SCHEMA).select("*", F.xxhash64("text").alias("a"), F.xxhash64(F.lit(1), F.col("text")).alias("b"))
    out = {c: [] for c in rows}
    for r in sorted(df.collect(), key=lambda r: (r["turn"] is not None, r["turn"] or 0, r["role"].encode(), r["a"], r["b"])):
        out[r["conv_id"]].append((r["turn"], r["role"], r["text"]))
    return out


@pytest.mark.parametrize("bits,longest", [(12, 9), (1, 14), (0, 6)])
def test_equals_a_plain_search(spark, monkeypatch, bits, longest):
    monkeypatch.setattr(turns, "SLICE_BITS", bits)
    rows = conversations_of(bits, 60, longest) + [(None, 0, "user", "Hi."), (None, None, None, None), (9000, 3, "user", "x" * 300_000 + ".")]
    got = {r["conv_id"]: tuple(r[f] for f in FIELDS) for r in turns.report(spark.createDataFrame(rows, SCHEMA)).collect()}
    want = {c: plain_repair(r) for c, r in ordered(spark, plain_damage(rows)).items()}
    assert got == want


def test_repaired_turns_and_clashing_columns(spark):
    rows = [(1, t, ("user", "assistant")[t % 2], f"say {t}.", 1, "x") for t in range(40)]
    df = spark.createDataFrame(rows, SCHEMA + ", at long, ck string")
    got = [(r["role"], r["text"]) for r in turns.repaired(df).orderBy("position").collect()]
    report = turns.report(df).first()
    assert report["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for r, t in got).encode()).hexdigest()
    assert len(got) % 2 == 0 and [r for r, _ in got] == ["user", "assistant"] * (len(got) // 2)
    assert turns.report(df.limit(0)).count() == 0 and turns.repaired(df.limit(0)).count() == 0


def test_repeated_rows_are_counted_not_carried(spark):
    turn = next(t for t in range(100) if zlib.crc32(f"7:{t}".encode()) % 20 > 4)
    df = spark.range(5000).selectExpr("7L as conv_id", f"{turn}L as turn", "'user' as role", "'Same.' as text")
    r = turns.report(df).first()
    assert (r["duplicate"], r["illegal"], r["cost"], r["audit"]) == (4999, 4999, 10000, "D" * 5000)


def test_block_tables_equal_single_steps():
    t, dice = turns.tables(), random.Random(5)
    assert len(t.vectors) < 200
    for _ in range(300):
        symbols = [dice.randrange(9) for _ in range(dice.randint(0, 30))]
        costs = turns._closed([0, turns.FAR, turns.FAR, 0])
        for s in reversed(symbols):
            costs = turns._before(s, costs)
        seen, passed = t.back(symbols, turns.ACCEPT)
        assert [c + passed for c in t.vectors[seen[0]]] == costs
        between = t.between(symbols)
        assert t.vectors[t.earlier(between, turns.ACCEPT)] == t.vectors[seen[0]]
