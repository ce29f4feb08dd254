"""Accounts of one person: similar names against all pairs, classes of any size, collisions."""

import random
from difflib import SequenceMatcher

import pytest

from tradewind.functions.similar import similar_strings
from tradewind.operators.people import alias_suggestions, collisions, similar_names


def norm(s):
    return "".join(c for c in s.lower() if c.isascii() and c.isalnum())


def words(s):
    return "".join(sorted("".join(c if c.isascii() and c.isalnum() else " " for c in s.lower()).split()))


def names(n):
    rng = random.Random(11)
    syllables = ["an", "be", "ka", "lo", "mi", "ro", "sh", "tu", "x", "yo"]
    made = []
    for _ in range(n):
        if made and rng.random() < 0.5:
            s = list(rng.choice(made))
            for _ in range(rng.randrange(3)):
                i = rng.randrange(len(s) + 1)
                s[i : i + rng.randrange(2)] = rng.choice(["", "e", "Q", " ", "_"])
            made.append("".join(s) or "z")
        else:
            made.append(" ".join("".join(rng.choice(syllables) for _ in range(rng.randrange(1, 5))) for _ in range(rng.randrange(1, 4))))
    return made


def test_similar_strings_equal_all_pairs(spark):
    left, right = [norm(s) for s in names(1000)], [norm(s) for s in names(2000)[1000:]]
    both = lambda xs: spark.createDataFrame([(x,) for x in xs] + [(None,), ("",)], "s string")
    ratios = {(a, b): SequenceMatcher(None, a, b).ratio() for a in set(left) - {""} for b in set(right) - {""} if 2 * min(len(a), len(b)) >= 0.8 * (len(a) + len(b))}
    for least in (0.85, 0.95, 0.801):
        got = {(r.a, r.b): r.ratio for r in similar_strings(both(left), both(right), least).collect()}
        assert got == {p: r for p, r in ratios.items() if r >= least} and len(got) > 50
    with pytest.raises(ValueError, match="above 0.8"):
        similar_strings(both(left), both(right), 0.8)


def test_similar_names(spark):
    given = names(500)
    players = [(i, s, "melee" if i % 3 == 0 else "rph") for i, s in enumerate(given)] + [(900, "Berg Anna", "melee"), (901, "anna b erg", "rph"), (902, "日本", "melee"), (903, None, "rph"), *((1000 + i, "Twin Nameq", "rph") for i in range(5)), (999, "Twin Name", "melee")]
    rph = [(i, s) for i, s, p in players if p == "rph" and norm(s or "")]
    held = {norm(s) for _, s in rph}
    want = set()
    for i, s, p in players:
        if p != "melee" or not norm(s) or norm(s) in held:
            continue
        scored = []
        for j, t in rph:
            raw = SequenceMatcher(None, norm(s), norm(t)).ratio()
            best = max(raw, SequenceMatcher(None, words(s), words(t)).ratio() if words(t) != norm(t) else raw)
            if best >= 0.85:
                scored.append((-best, j))
        want |= {(i, j, round(-r, 3)) for r, j in sorted(scored)[:3]}
    got = similar_names(spark.createDataFrame(players, "player_id int, name string, platform string"), "melee", "rph")
    assert {tuple(r) for r in got.collect()} == want and {(999, 1000), (999, 1001), (999, 1002)} <= {(a, b) for a, b, _ in want}


def test_a_name_of_very_many_accounts(spark):
    players = spark.range(1002).selectExpr("id AS player_id", "'Chris' AS name", "CASE WHEN id = 7 THEN 'melee' ELSE 'rph' END AS platform")
    got = alias_suggestions(players).collect()
    assert len(got) == 1002 and {r.class_id for r in got} == {0} and {r.evidence for r in got} == {"exact"} and sorted({r.n_other for r in got}) == [1, 1001]
    assert alias_suggestions(players.where("player_id <> 7")).count() == 0


def test_collisions(spark):
    players = spark.createDataFrame([(1, "LoL_X", "rph"), (2, "lol x", "rph"), (3, "LOLX", "rph"), (4, "lolx", "melee"), (5, "LoL X", "rph"), (6, "--", "rph"), (7, "..", "rph")], "player_id int, name string, platform string")
    played = [("a", 1, 9), ("b", 1, 8), ("c", 1, 2), ("d", 3, 9), ("e", 3, 8), (None, 5, 9), ("a", 4, 9)]
    got = {r.player_id: tuple(r)[1:] for r in collisions(players, spark.createDataFrame(played, "store string, player1_id int, player2_id int")).collect()}
    # 2 has played the busiest; 3 shares two opponents with it; 5 shares one
    assert got == {3: (1, 0.9, 0, 2), 5: (1, 0.5, 0, 1)}


@pytest.mark.parametrize(("few", "tile"), [(64, 8192), (2, 3)])
def test_linked_accounts_equal_all_pairs(spark, monkeypatch, few, tile):
    from tradewind.operators import people

    monkeypatch.setattr(people, "FEW", few)
    monkeypatch.setattr(people, "TILE", tile)
    rng = random.Random(5)
    shown = ["Anna Berg", "anna-berg", "Berg Anna", "BERG  anna", "AnnaBerg", "An naberg", "Solo", "--", None]
    players = [(i, "Only One" if i == 60 else rng.choice(shown), rng.choice(["melee", "rph", "rph", None])) for i in range(61)]
    entries = [(rng.choice([*range(12), None]), rng.randrange(70)) for _ in range(110)]
    split = lambda s: " ".join(sorted("".join(c if c.isalnum() else " " for c in (s or "").lower()).split()))
    at = {p: {e for e, q in entries if q == p and e is not None} for p, *_ in players}
    want = set()
    for i, s, p in players:
        named = [(j, t, q) for j, t, q in players if norm(s or "") and norm(t or "") and (norm(s) == norm(t) or split(s) == split(t))]
        links = [x for x in named if x[0] != i]
        if links:
            across = [(t, q) for j, t, q in links if norm(t) == norm(s) and p and q and p != q]
            evidence = "exact" if any(t == s for t, _ in across) else "normalized" if across else None
            ids = (min(j for j, t, _ in named if norm(t) == norm(s)), min(j for j, t, _ in named if split(t) == split(s)))
            counts = (len(across), len(links), sum(t == s for _, t, _ in links), sum(not at[i] & at[j] for j, *_ in links))
            want.add((i, *ids, p, evidence, {"exact": 1.0, "normalized": 0.95, None: None}[evidence], *counts))
    got = people.linked_accounts(spark.createDataFrame(players, "player_id bigint, name string, platform string"), spark.createDataFrame(entries, "event_id int, player_id bigint")).collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    # accounts of one platform, turned words and pairs that met are all there
    assert any(r[4] is None for r in want) and any(r[1] != r[2] for r in want) and any(r[-1] < r[-3] for r in want)
