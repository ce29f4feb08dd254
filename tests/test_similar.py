"""Similar strings: what is compared at all, and pairs across the classes of length."""

import random
from difflib import SequenceMatcher

from tradewind.functions import similar


def test_names_of_few_letters_in_use_meet_only_if_alike(spark):
    rng = random.Random(5)
    ours = ["".join(rng.choice("0123456789abcdef") for _ in range(11)) for _ in range(2000)]
    theirs = [s[:4] + "x" + s[5:] for s in ours[:500]] + ["".join(rng.choice("0123456789abcdef") for _ in range(11)) for _ in range(1500)]
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "s string")
    # of four million pairs, nearly all of which share pairs of characters
    assert similar.candidates(rows(ours), rows(theirs), 0.85).count() < 600
    assert {(r.a, r.b) for r in similar.similar_strings(rows(ours), rows(theirs)).collect()} >= set(zip(ours[:500], theirs[:500]))


def test_pairs_across_lengths(spark):
    rng = random.Random(6)
    made = []
    for n in [1, 2, 3, 5, 8, 11, 12, 13, 14, 15, 16, 18, 20, 35, 39, 40, 41, 43, 50, 60]:
        s = "".join(rng.choice("abcde") for _ in range(n))
        made += [s, s + "ab", s[: n // 2] + "e" + s[n // 2 :], "dd" + s[: max(1, n - 1)], s[1:] or "a"]
    ours, theirs = made[::2], made[1::2]
    rows = lambda xs: spark.createDataFrame([(x,) for x in xs], "s string")
    for least in (0.801, 0.9):
        want = {(a, b) for a in ours for b in theirs if SequenceMatcher(None, a, b).ratio() >= least}
        assert {(r.a, r.b) for r in similar.similar_strings(rows(ours), rows(theirs), least).collect()} == want
        assert any(len(a) <= 14 < len(b) for a, b in want)
