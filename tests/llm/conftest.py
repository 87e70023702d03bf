from __future__ import annotations

import random

import pytest

WORDS = [a + b for a in ("ka", "lo", "mi", "ne", "pu", "ra", "si", "te", "vo", "zu") for b in ("ba", "de", "fi", "go", "hu", "ja", "ke", "li", "mo", "nu")]


def prose(seed: int, n: int) -> str:
    r = random.Random(seed)
    out = []
    while len(out) < n:
        k = min(n - len(out), r.randint(4, 12))
        out += " ".join(r.choices(WORDS, k=k)).capitalize().split(" ")
        out[-1] += "."
    return " ".join(out)


@pytest.fixture(scope="session")
def docs(spark):
    """Small documents with every awkward case, and clashing extra columns."""
    base = prose(1, 200)
    r = random.Random(2)
    near = base.split(" ")
    near[50] = "changed"
    rows = [
        (0, base), (1, base.swapcase()[:1] + base[1:]), (2, " ".join(near)), (3, prose(2, 300)), (4, None), (5, ""), (6, "   \n\t "), (7, "one"), (8, "One"),
        (9, "a b"), (10, prose(3, 4000)), (11, "x" * 40_000), (12, "é É ß “quoted” 漢字 😀 don't it's"), (12, "é É ß “quoted” 漢字 😀 don't it's"),
        (13, "HEY!! " * 60), (14, " | ".join(r.choices(WORDS, k=80))), (15, "same same same same same same same same " * 20),
        (16, base + "\n" + "LOUD!! " * 20 + "\n" + prose(4, 100)),
    ]
    rows += [(100 + i, prose(5, 60)) for i in range(40)]
    full = [(i, t, "en", None if i == 7 else f"src{i % 3 if i < 100 else 9}", None, True, "x", 5, "clash") for i, t in rows]
    schema = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, keep_id string, block int, host string"
    return spark.createDataFrame(full, schema).repartition(3)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.where("false")
