"""Periodic runs against brute force."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from agvlens.llm import runs


def plain_runs(w):
    """All maximal stretches, each with its smallest period."""
    found = {}
    n = len(w)
    for p in range(1, n // 2 + 1):
        i = 0
        while i + p < n:
            if w[i] != w[i + p]:
                i += 1
                continue
            s = i
            while i + p < n and w[i] == w[i + p]:
                i += 1
            if i + p - s >= max(12, 2 * p):
                found.setdefault((s, i + p), p)
    return sorted((s, e - s, p) for (s, e), p in found.items())


def plain_report(doc_id, text):
    w = (text or "").encode().split()
    n = len(w)
    h = zlib.crc32(str(doc_id).encode())
    if n and h % 10 == 0:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, length, p in found for i in range(s + p, s + length)}
    s, length, p = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    return (len(found), s, length, p, 1000 * length // p if found else None, hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in sorted(found, key=lambda r: (r[0], r[2]))).encode()).hexdigest(),
            hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest())


def texts_of(seed):
    dice = random.Random(seed)
    out = [None, "", " \t\n", "a", "a " * 11, "a " * 12, "a " * 500, "ab ba " * 30, "x\x85y　z " * 9, "\x1cw " * 12]
    for _ in range(60):
        word = lambda: dice.choice("abcd"[:dice.randint(1, 4)])
        parts = [word() for _ in range(dice.randint(0, 60))]
        for _ in range(dice.randint(0, 3)):
            piece = [word() for _ in range(dice.randint(1, 15))]
            parts += piece * dice.randint(1, 5) + piece[:dice.randint(0, len(piece))]
        out.append(" ".join(parts))
    fib = ["a", "b"]
    while len(fib[-1]) < 400:
        fib.append(fib[-1] + fib[-2])
    return [*out, " ".join(fib[-1]), " ".join(f"w{i}" for i in range(700)) + " q r" * 40]


@pytest.mark.parametrize("pack", [50, 150_000])
def test_report_equals_brute_force(documents, monkeypatch, pack):
    monkeypatch.setattr(runs, "PACK", pack)
    monkeypatch.setattr(runs, "GRID", 1 + pack // 2)
    texts = texts_of(pack)
    docs = documents(*texts, extra=True)
    names = [c.split()[0] for c in runs.COLUMNS.split(", ")]
    got = {r["doc_id"]: tuple(r[c] for c in names) for r in runs.report(docs).collect()}
    assert got == {i: plain_report(i, t) for i, t in enumerate(texts)}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 3
    listed = sorted((r["doc_id"], r["start"], r["length"], r["period"]) for r in runs.runs(docs).collect())
    assert listed == sorted((i, *r) for i, t in enumerate(texts) for r in plain_runs((t or "").encode().split()))


def test_ids_and_empty_tables(documents):
    docs = documents(("a " * 40, "en", "s", None), ("b c d " * 9, "en", "s", 2**60 + 1), ("b c d " * 9, "en", "s", 2**60 + 1))
    got = sorted(((r["doc_id"], r["n_runs"], r["period"]) for r in runs.report(docs).collect()), key=str)
    assert got == [(2**60 + 1, 1, 3)] * 2 + [(None, 1, 1)]
    assert runs.report(docs.limit(0)).count() == 0 and runs.runs(docs.limit(0)).count() == 0


def test_extensions_equal_comparison():
    dice = np.random.default_rng(1)
    for size, letters in ((300, 2), (300, 1), (2000, 3), (40_000, 30)):
        body = dice.integers(0, letters, size)
        body[size // 2:size // 2 + size // 4] = body[:size // 4]
        s = np.concatenate([[-1], body, [-2], body[: size // 2], [-3]])
        grammar = runs.Grammar(s)
        i, j = dice.integers(1, size // 2, 400), dice.integers(size // 2, size, 400)
        i, j = np.append(i, 1), np.append(j, 1 + size // 2)
        ok = s[i] == s[j]
        i, j = i[ok], j[ok]
        ahead, back = grammar.extend(i, j), grammar.extend(i, j, True)
        for a, b, f, g in zip(i.tolist(), j.tolist(), ahead.tolist(), back.tolist(), strict=True):
            assert (s[a:a + f] == s[b:b + f]).all() and s[a + f] != s[b + f]
            assert (s[a - g + 1:a + 1] == s[b - g + 1:b + 1]).all() and s[a - g] != s[b - g]
        assert len(grammar.levels) < 90


def test_a_very_long_text():
    word = [b"w%d" % (i * i % 9973) for i in range(200_000)]
    start, end, period, _ = runs.find_runs([word])
    assert (start[0] - 1, end[0] - 1, period[0]) == (0, 200_000, 9973) and len(start) < 1000
