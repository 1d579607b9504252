"""Likeness of texts against the definition, one pair at a time."""

import difflib
import random

import numpy as np
import pytest

from verdance.functions.likeness import ratios


@pytest.mark.parametrize("cells", [1 << 21, 50])
def test_against_the_definition(cells):
    rng = random.Random(1)
    texts = ["", "a", "aaaa", "abab", "The answer is x=3", "answer: x = 3", "é\U0001f600é", "x" * 250, "ab" * 150, "the cat " * 40, "a cat the " * 30]
    texts += ["".join(rng.choice("ab ") for _ in range(rng.randint(0, 30))) for _ in range(40)]
    texts += ["".join(rng.choice("abcdefgh xyz=+") for _ in range(rng.randint(150, 320))) for _ in range(6)]
    pairs = [(x, y) for x in texts for y in rng.sample(texts, 12)]
    for x in texts[-6:]:  # near copies of long texts
        cut = rng.randrange(100)
        pairs += [(x, x[:cut] + "q" + x[cut + 5 :]), (x[cut:] + x[:cut], x), (x, x)]
    got = ratios([x for x, _ in pairs], [y for _, y in pairs], cells)
    want = np.array([difflib.SequenceMatcher(None, x, y).ratio() for x, y in pairs])
    assert np.abs(got - want).max() < 1e-12
    assert len(ratios([], [])) == 0
