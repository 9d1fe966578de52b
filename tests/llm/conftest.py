import os
import random
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

DOC = "doc_id long, text string, lang string, score double, kept string, component_id long"


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with extra columns whose names clash with those of the operators."""
    def make(rows):
        return spark.createDataFrame([(d, t, "xx", 0.5, "other", -1) for d, t in rows], DOC)
    return make


@pytest.fixture(scope="session")
def corpus():
    """Unique documents: exact copies, near copies of a few sizes, shared passages, periodic and odd texts."""
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in "the of Und que éa tion".split() for b in "ab cd ef gh ij kl mn op".split()]

    def text(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    def edited(w, n):
        w = list(w)
        for _ in range(n):
            w[rng.randrange(len(w))] = f"new{rng.randrange(10**6)}"
        return w

    rows, passage, long = [], text(60), text(30)
    for size in (3, 5, 8, 12, 16, 25, 60, 150, 400):
        origin = text(size)
        rows += [edited(origin, k) for k in (0, 0, 1, 1, 2, 3, 5)]
        rows.append(origin + text(1))
    rows += [text(40) + passage + text(20) for _ in range(12)]
    rows += [text(200) + long + text(200) + long for _ in range(3)]
    rows += [["again"] * 90, ["a", "b"] * 45, text(3000), text(19), text(20), text(21)]
    texts = [" ".join(w) for w in rows]
    texts += ["", None, " \t\n", "\x0b one\tTWO\nthree  four ", "word", "WORD", "x" * 5000, "éé  éé\r\néé", "NaN | ## !!"]
    order = list(range(len(texts)))
    rng.shuffle(order)
    return [(10 * k, texts[i]) for k, i in enumerate(order)]
