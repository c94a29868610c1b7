"""The n-gram join over edited texts against all pairs: no link may be lost."""

import random

import pytest

from kelpline.llm import ngram_join

from test_operators import brute_components


def edited_texts(seed, n=360):
    """Texts of 3 to 70 words in chains of edits: words replaced, put in and taken out."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    bases = [[rng.choice(words) for _ in range(rng.randint(3, 70))] for _ in range(40)]
    out = []
    while len(out) < n:
        text = list(rng.choice(bases)) if rng.random() < 0.7 or not out else out[rng.randrange(len(out))].split()
        for _ in range(rng.randint(0, 4)):
            at, kind = rng.randrange(len(text) + 1), rng.random()
            if kind < 0.4 and text:
                text[min(at, len(text) - 1)] = rng.choice(words)
            elif kind < 0.7:
                text.insert(at, rng.choice(words))
            elif len(text) > 3:
                del text[min(at, len(text) - 1)]
        out.append(" ".join(text))
    return out


@pytest.mark.parametrize("first", [1, 6, 11, 16])
def test_no_link_is_lost(spark, first):
    """Five seeds in one table, as texts of different seeds hardly meet."""
    rows = [(1000 * seed + i, f"{t} s{seed}" if len(t) > 40 else t) for seed in range(first, first + 5) for i, t in enumerate(edited_texts(seed))]
    random.Random(first).shuffle(rows)
    _, want = brute_components(rows)
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: r.component_id for r in ngram_join.link_components(table).collect()}
    assert got == want


def test_sketches_never_tell_more_differences_than_there_are():
    import numpy as np

    rng = np.random.default_rng(5)
    for _ in range(300):
        both = rng.integers(0, 2**64, rng.integers(0, 400), np.uint64)
        one, other = (np.unique(np.r_[both, rng.integers(0, 2**64, rng.integers(0, 200), np.uint64)]) for _ in range(2))
        found = ngram_join.least_difference(ngram_join.sketch(one), ngram_join.sketch(other))
        apart = len(np.setxor1d(one, other))
        assert found <= apart and (found > 0 or apart < 8)
