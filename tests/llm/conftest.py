from __future__ import annotations

import random

import pytest

DOC = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Documents from texts or (text, lang, source); ids count up unless given as a fourth item."""
    def build(*rows, extra: bool = False):
        full = []
        for i, r in enumerate(rows):
            r = r if isinstance(r, tuple) else (r,)
            text, lang, source, doc_id = (*r, *("en", "a", i)[len(r) - 1:])
            row = (doc_id, text, lang, source, None if text is None else len(text))
            full.append((*row, *((7, "x", 1) if extra else ())))
        return spark.createDataFrame(full, DOC + (", n_lines long, __key string, pool int" if extra else ""))

    return build


@pytest.fixture
def prose():
    """Deterministic made-up sentences."""
    def make(seed: int, n: int) -> str:
        dice = random.Random(seed)
        words = ["".join(dice.choice("aeioulnrst") for _ in range(dice.randint(2, 9))) for _ in range(n)]
        return " ".join(w + ("." if i % 11 == 10 else "") for i, w in enumerate(words))

    return make
