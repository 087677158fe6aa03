"""Substring dedup against brute force."""

import hashlib
import random

import numpy as np
import pytest
from agvlens.llm import relative_lz


def plain(rows):
    """(n_words, n_removed, kept_sha256) of rows (doc_id, text), in order."""
    words = [(t or "").encode().split() for _, t in rows]
    first = {}
    for (k, _), w in zip(rows, words, strict=True):
        for y in range(len(w) - 49):
            if k is not None:
                g = tuple(w[y:y + 50])
                first[g] = min(first.get(g, k), k)
    out = []
    for (k, _), w in zip(rows, words, strict=True):
        gone = set()
        for y in range(len(w) - 49):
            if k is not None and first[tuple(w[y:y + 50])] < k:
                gone.update(range(y, y + 50))
        out.append((k, len(w), len(gone), hashlib.sha256(b" ".join(x for i, x in enumerate(w) if i not in gone)).hexdigest()))
    return sorted(out, key=str)


def rows_of(seed):
    dice = random.Random(seed)
    fresh = lambda n: [f"w{dice.randrange(900)}" for _ in range(n)]
    passages = [fresh(n) for n in (49, 50, 51, 60, 90, 200)]
    base = fresh(400)
    rows = [(7, " ".join(base)), (3, " ".join(base)), (7, " ".join(base)), (7, " ".join(fresh(80) + base[:120])), (None, " ".join(base)), (None, None), (1, None), (2, " \t\n"), (4, "short text")]
    for i in range(20, 90):
        parts = fresh(dice.randint(0, 70))
        for _ in range(dice.randint(0, 3)):
            parts += dice.choice(passages) + fresh(dice.choice([0, 0, 1, 30]))
        rows.append((dice.randrange(1000), " ".join(parts)))
    for i in range(12):  # near copies of several originals
        copy = list(base)
        for at in range(dice.randrange(60), 400, dice.randint(45, 130)):
            copy[at] = f"new{i}"
        del copy[dice.randrange(400)]
        rows.append((100 + i, " ".join(copy[dice.randrange(30):])))
    same = ["la"] * 130
    rows += [(500, " ".join(same)), (400, " ".join(same[:70])), (600, " ".join(same[:49])), (450, " ".join(fresh(5) + same[:100] + fresh(5) + same[:60]))]
    return rows


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_equals_brute_force(documents, monkeypatch, seed):
    monkeypatch.setattr(relative_lz, "PACK", (150_000, 500, 1)[seed - 1])
    rows = rows_of(seed)
    docs = documents(*[(t, "en", "s", k) for k, t in rows], extra=True)
    got = relative_lz.dedup(docs).collect()
    want = plain(rows)
    assert sorted(((r["doc_id"], r["n_words"], r["n_removed"], r["kept_sha256"]) for r in got), key=str) == want
    assert sum(n > 0 for _, _, n, _ in want) > 30
    texts = {}
    for k, t in rows:
        texts.setdefault(k, []).append((t or "").split())
    for r in got:  # factors are true copies, and the kept words are what they leave
        assert hashlib.sha256(r["kept"].encode()).hexdigest() == r["kept_sha256"]
        for start, length, ref, at in r["factors"]:
            assert ref < r["doc_id"] and length >= 50
            assert any(w[start:start + length] == v[at:at + length] for w in texts[r["doc_id"]] for v in texts[ref])


def test_empty_and_very_long(documents):
    dice = np.random.default_rng(4)
    long = " ".join(f"x{i}" for i in dice.integers(0, 5000, 150_000))
    docs = documents(long, "intro " + long, "a")
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], len(r["factors"])) for r in relative_lz.dedup(docs, texts=False).collect()}
    assert got == {0: (150_000, 0, 0), 1: (150_001, 150_000, 1), 2: (1, 0, 0)}
    assert relative_lz.dedup(docs.limit(0)).count() == 0


def test_blocks_cover_all_windows_once():
    dice = random.Random(9)
    texts = [[b"%d" % dice.randrange(50) for _ in range(n)] for n in (0, 10, 50, 51, 400)]
    for words, (at, anchor, content) in zip(texts, relative_lz.blocks(texts), strict=True):
        assert relative_lz._windows_of(at)[1].tolist() == list(range(max(0, len(words) - 49)))
        assert len(at) == len(anchor) == len(content)
