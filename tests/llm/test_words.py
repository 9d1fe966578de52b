"""Hashes of words and runs decide equality: no pattern of letters may make unlike ones equal."""

import random

import numpy as np
import pyarrow as pa
import pytest

from ledgerloom.llm import jaccard, substrings, tokens, words


def thue_morse(size, a, b):
    """The word of two letters whose two halves cancel in any polynomial over a power of two."""
    turns = [0]
    while len(turns) < size:
        turns += [1 - t for t in turns]
    return "".join((a, b)[t] for t in turns)


PAIRS = [(thue_morse(n, a, b), thue_morse(n, b, a)) for n in (1024, 4096, 16384) for a, b in (("a", "b"), ("abcdefgh", "hgfedcba"))]


def hashed(texts, **kind):
    data, offsets = words.buffer_of(pa.array(texts))
    split = words.split(data, offsets)
    return split, words.hashes(data, split, **kind)


@pytest.mark.parametrize("seed", range(3))
def test_patterned_words_differ_under_every_seed(seed):
    for a, b in PAIRS:
        assert len(set(hashed([a, b], seed=seed)[1].tolist())) == 2


def test_hashes_are_equal_for_equal_words_only():
    rng = random.Random(1)
    plain = ["".join(rng.choice("abAB") for _ in range(rng.randrange(1, 30))) for _ in range(20_000)]
    _, h = hashed([" ".join(plain[:7000]), "", " ".join(plain[7000:])])
    known = {}
    assert all(known.setdefault(w.lower(), x) == x for w, x in zip(plain, h.tolist()))
    assert len(set(known.values())) == len(known)
    few = h[:2000] % np.uint64(3)
    for n in range(1, 25):
        found = words.runs(few, n)
        known = {}
        assert len(found) == len(few) - n + 1
        assert all(known.setdefault(few[i:i + n].tobytes(), x) == x for i, x in enumerate(found.tolist()))
        assert len(set(known.values())) == len(known)


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_patterned_words_keep_their_own_tokens(name):
    path = tokens.tokenizer_path(name)
    texts = [w for pair in PAIRS[:3] for w in pair]
    ids, n = tokens.encoder(path).encode(pa.array(texts))
    ends = np.cumsum(n)
    for text, a, b in zip(texts, ends - n, ends):
        assert ids[a:b].tolist() == tokens.encoder(path)._plain(text)


def test_patterned_words_are_unlike_texts(spark, frame):
    a, b = PAIRS[0]
    fill = [f"w{i}" for i in range(30)]
    rows = [(1, " ".join([a, *fill])), (2, " ".join([b, *fill[:25], "x", "y", "z", "u", "v"])), (3, a), (4, b)]
    got = {r.doc_id: r.component_id for r in jaccard.join_similar(frame(rows), 4, 85).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 4}
    rows = [(1, " ".join([a, *fill[:19]])), (2, " ".join([b, *fill[:19]]))]
    assert [r.n_removed for r in substrings.remove_repeats(frame(rows), 20).collect()] == [0, 0]
