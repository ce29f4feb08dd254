"""Hashes of words and runs, with patterns that a polynomial modulo 2 ** 64 takes for each other."""

import hashlib
import random

import numpy as np

from tradewind.llm.hashing import BYTE_REACH, WORD_REACH, RunHashes, byte_grams, word_grams, words_of


def thue_morse(n: int, a: str, b: str) -> tuple[list[str], list[str]]:
    """A sequence of 2 ** n items and its complement."""
    bits = [i.bit_count() & 1 for i in range(1 << n)]
    return [(a, b)[x] for x in bits], [(b, a)[x] for x in bits]


def test_words_of_regular_patterns_differ():
    for n in (3, 6, 10, 12):
        x, y = ("".join(s).encode() for s in thue_morse(n, "a", "b"))
        hashes, counts = words_of([x + b" " + y, x, y.upper() + b"\n" + x], lower=True)
        assert counts.tolist() == [2, 1, 2]
        assert len(set(hashes.tolist())) == 2 and hashes[0] == hashes[2] == hashes[4] and hashes[1] == hashes[3]


def test_words_equal_where_texts_are():
    rng = random.Random(2)
    words = ["".join(rng.choice("abé日") for _ in range(rng.choice([1, 2, 5, 70, 200]))) for _ in range(300)]
    texts = [" ".join(rng.choices(words, k=rng.randrange(9))).encode() for _ in range(400)]
    hashes, counts = words_of(texts, lower=False)
    own = [w for t in texts for w in t.split()]
    assert counts.tolist() == [len(t.split()) for t in texts] and len({*zip(own, hashes.tolist())}) == len(set(own)) == len(set(hashes.tolist()))


def test_runs():
    rng = np.random.default_rng(5)
    data = rng.integers(97, 99, 4000, dtype=np.uint8)
    x, y = ("".join(s).encode() for s in thue_morse(10, "a", "b"))
    data = np.concatenate((data, np.frombuffer(x + y, np.uint8)))
    runs = RunHashes(byte_grams(data), BYTE_REACH)
    fixed = runs.fixed(20)
    want = {}
    for at in range(len(data) - 19):
        assert want.setdefault(bytes(data[at : at + 20]), fixed[at]) == fixed[at]
    assert len(set(want.values())) == len(want) and len(fixed) == len(data) - 19
    a, b = runs.of(np.array([4000, 5024]), np.array([5024, 6048]))
    assert a != b
    words = rng.integers(0, 3, 500).astype(np.uint64)
    pairs = RunHashes(word_grams(words), WORD_REACH)
    found = {}
    for at, h in enumerate(pairs.fixed(4)):
        assert found.setdefault(tuple(words[at : at + 4]), h) == h
    assert len(set(found.values())) == len(found)


def test_long_words_are_told_apart_by_the_operators(spark):
    """A window and a count that differ only in one of two such words."""
    from tradewind.llm.debruijn_dedup import repeated_passages
    from tradewind.llm.lm_scoring import score

    x, y = ("".join(s) for s in thue_morse(10, "a", "b"))
    rest = " ".join(f"w{i}" for i in range(34))
    table = spark.createDataFrame([(1, f"{x} {rest}"), (2, f"{y} {rest}")], "doc_id bigint, text string")
    got = repeated_passages(table).collect()
    assert [r.n_removed for r in got] == [0, 0]
    assert {r.kept_sha256 for r in got} == {hashlib.sha256(f"{z} {rest}".encode()).hexdigest() for z in (x, y)}
    import zlib

    held = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 == 2)
    train = next(i for i in range(100) if zlib.crc32(str(i).encode()) % 7 != 2)
    scored = {r.doc_id: r for r in score(spark.createDataFrame([(train, x), (held, y)], "doc_id bigint, text string")).collect()}
    assert (scored[train].n_known, scored[held].n_known) == (2, 1)
