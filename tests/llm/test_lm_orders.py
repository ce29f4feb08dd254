"""The automaton against the smoothed model written out, for every order."""

import math
import zlib
from collections import Counter
from random import Random

import pytest

from tradewind.llm.exchange import pack_counts, pack_sorted, unpack_counts, unpack_sorted
from tradewind.llm.lm_scoring import score


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_scores_equal_the_interpolated_model(spark, order):
    rng = Random(order)
    texts = [" ".join(rng.choice("abcdef"[: rng.randrange(2, 7)]) for _ in range(rng.randrange(40))) for _ in range(60)] + [None, "", "zz a zz b", "a b c a b c"]
    held = [zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))]
    prior = (10.0, 3.0)
    grams, history = [Counter() for _ in range(order)], [Counter() for _ in range(order)]
    framed = [["^", *(t or "").split(), "$"] for t in texts]
    for own, out in zip(framed, held):
        for at in range(1, len(own)):
            for k in range(order):
                if not out and at - k >= 0:
                    grams[k][tuple(own[at - k : at + 1])] += 1
                    history[k][tuple(own[at - k : at])] += 1
    n, v = sum(grams[0].values()), len(grams[0])
    ones, twos = (sum(c == k for c in grams[0].values()) for k in (1, 2))
    d = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5

    def p(h: tuple, w: str) -> float:
        if not h:
            return (grams[0][(w,)] - d) / n if grams[0][(w,)] else d * v / n
        weight = prior[min(len(h) - 1, 1)]
        return (grams[len(h)][(*h, w)] + weight * p(h[1:], w)) / (history[len(h)][h] + weight)

    want = [sum(math.log10(p(tuple(own[max(0, at - order + 1) : at]), own[at])) for at in range(1, len(own))) for own in framed]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").repartition(3)
    for lane in (3, 512):
        got = {r.doc_id: r.score for r in score(table, order=order, prior=prior, lane=lane).collect()}
        assert [got[i] for i in range(len(texts))] == pytest.approx(want, abs=1e-9)


def test_repeated_rows_and_null_ids(spark):
    """Every row counts; a null id is training text."""
    table = spark.createDataFrame([(None, "x y"), (None, "x y"), (1, "x y"), (1, "x y"), (None, None)], "doc_id bigint, text string")
    got = score(table).collect()
    assert len(got) == 5 and {r.train_tokens for r in got} == {13 if zlib.crc32(b"1") % 7 != 2 else 7}
    assert len({(r.doc_id, r.score) for r in got}) == 3 and not any(r.held_out for r in got if r.doc_id is None)


def test_counts_of_any_size():
    import numpy as np

    n = np.array([0, 254, 255, 256, 7, 1 << 40])
    assert unpack_counts(pack_counts(n)).tolist() == n.tolist() and unpack_counts(pack_counts(n[:0])).tolist() == []


def test_sorted_values():
    import numpy as np

    for own in ([], [7], [0, 0, 5, 5, 300], [3, (1 << 64) - 1], sorted(Random(1).getrandbits(64) for _ in range(1000))):
        values = np.array(own, np.uint64)
        assert unpack_sorted(pack_sorted(values)).tolist() == own
