"""Matching blocks of many pairs at once, against difflib."""

import random
from difflib import SequenceMatcher

import pytest

from heddle.functions import blocks


@pytest.mark.parametrize("cells", [1, 500, blocks.CELLS])
def test_ratios_are_those_of_difflib(cells, monkeypatch):
    monkeypatch.setattr(blocks, "CELLS", cells)
    rnd = random.Random(1)
    word = lambda letters, n: "".join(rnd.choice(letters) for _ in range(n))
    pairs = [("", ""), ("a", ""), ("", "b"), ("tide", "diet"), ("diet", "tide"), ("é🙂", "🙂é")]
    pairs += [(word("ab", rnd.randrange(9)), word("ab", rnd.randrange(9))) for _ in range(300)]
    pairs += [(word("abcdefgh ", rnd.randrange(30)), word("abcdefgh ", rnd.randrange(30))) for _ in range(150)]
    pairs += [(word("abcdefghijklmnopqrstuvwxyz", rnd.randrange(150, 260)), word(rnd.choice(["abc", "abcdefghijklmnopqrstuvwxyz"]), rnd.randrange(195, 320))) for _ in range(25)]
    text = word("abcdefghijklmnopqrstuvwxyz0123456789" * 9, 400)
    pairs += [(text, text[:200] + "x" + text[200:]), (text, text), ("é" + text, text[3:] + "zz")]
    want = [SequenceMatcher(None, a, b).ratio() for a, b in pairs]
    assert blocks.ratios([a for a, _ in pairs], [b for _, b in pairs]).tolist() == want
    assert blocks.ratios([], []).tolist() == []
