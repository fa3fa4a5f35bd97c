import random
from itertools import combinations

import pytest

from recordloom.llm import set_join


def brute(sets, t):
    keys = sorted(sets)
    return {(a, b) for a, b in combinations(keys, 2) if sets[a] and sets[b] and len(sets[a] & sets[b]) / len(sets[a] | sets[b]) >= t - 1e-9}


def found(spark, rows, t, least=1):
    df = spark.createDataFrame(rows, "id string, side string, tokens array<string>, sid int, key string")
    members, sets = set_join.distinct_sets(df, least)
    return {tuple(r) for r in set_join.expand(members, set_join.similar_sets(sets, t)).collect()}


@pytest.mark.parametrize("t", [0.5, 0.6, 0.8])
def test_all_pairs(spark, t):
    rng = random.Random(5)
    common, rare = [f"c{i}" for i in range(6)], [f"r{i}" for i in range(300)]
    sets = {}
    for i in range(300):
        base = sets[rng.choice(sorted(sets))] if sets and rng.random() < 0.6 else set(rng.sample(common, rng.randint(0, 4)) + rng.sample(rare, rng.randint(1, 9)))
        s = {x for x in base if rng.random() < 0.9} | ({rng.choice(rare)} if rng.random() < 0.4 else set())
        sets[f"x{i:03d}"] = s or {"r1"}
    rows = [(k, "a", sorted(v), 1, "clash") for k, v in sets.items()]
    assert found(spark, rows, t) == brute(sets, t)


def test_spelling_nulls_ties_and_repeated_rows(spark):
    rows = [
        ("a", "a", ["X", " y", "z ", "w", "w"], 0, ""), ("a", "a", ["x", "y"], 0, ""), ("b", "a", ["x", "Y", "Z", "W", None, " "], 0, ""), ("c", "a", None, 0, ""), ("d", "a", [], 0, ""),
        (None, "a", ["x", "y", "z", "w"], 0, ""), ("e", "a", ["x", "y", "z"], 0, ""), ("f", "a", ["x", "y", "z", "w"], 0, ""),
    ]
    assert found(spark, rows, 0.6, 4) == {("a", "b"), ("a", "f"), ("b", "f")}
    assert found(spark, rows, 0.6) == {("a", "b"), ("a", "e"), ("b", "e"), ("a", "f"), ("b", "f"), ("e", "f")}


def test_empty(spark):
    assert found(spark, [], 0.6) == set()


def test_hot_group_of_copies(spark):
    rows = [(f"k{i:03d}", "a", ["p", "q", "r", "s"], 0, "") for i in range(60)] + [("z", "a", ["p", "q", "r", "s", "t"], 0, "")]
    assert len(found(spark, rows, 0.6, 4)) == 60 * 59 // 2 + 60


def test_budgets_cover_every_difference():
    for a in range(1, 15):
        m = set_join.segments(a, 0.6)
        for b in range(a, int(a / 0.6) + 1):
            need = set_join.most_differing(a, b, 0.6) + 1
            plan = set_join.budgets([1.0] * m, [2.0] * m, need)
            assert sum(e + 1 for e in plan) >= need


def test_between_two_tables(spark):
    rng = random.Random(8)
    sets = {(f"x{i:03d}", rng.choice(["left", "right"])): set(rng.sample(range(14), rng.randint(1, 7))) for i in range(120)}
    sets |= {("x000", s): {1, 2, 3} for s in ("left", "right")}
    rows = [(i, s, [str(x) for x in v], 0, "") for (i, s), v in sets.items()]
    members, found = set_join.distinct_sets(spark.createDataFrame(rows, "id string, side string, tokens array<string>, sid int, key string"))
    got = {tuple(r) for r in set_join.between(members, set_join.similar_sets(found, 0.6)).collect()}
    want = {(i, j) for (i, s), x in sets.items() for (j, t), y in sets.items() if s == "left" and t == "right" and len(x & y) / len(x | y) >= 0.6 - 1e-9}
    assert got == want


def test_keys_without_tokens_are_held_only_where_asked_for(spark):
    import pandas as pd

    sets = pd.DataFrame({"sid": range(400), "sides": 3, "tokens": [[f"t{i}", f"u{i}", f"v{i}", f"w{i}"] for i in range(400)]})
    total = 1600
    held = pd.concat(set_join._held(0.6)(iter([sets])))
    asked = pd.concat(set_join._asked(0.6, {}, total)(iter([sets])))
    live = held[~held["bare"] | held["key"].isin(asked[asked["bare"]]["key"])]
    # Without the rule every set would hold the keys of its empty segments.
    assert held["bare"].sum() > 200 and held["key"].value_counts().max() > 50
    assert asked["bare"].mean() < 0.2 and len(live) <= len(held)


def test_long_sets(spark):
    sets = {f"l{k}": {f"t{i}" for i in range(k, k + 90)} for k in (0, 6, 20, 30, 120)}
    rows = [(k, "a", sorted(v), 0, "") for k, v in sets.items()]
    assert found(spark, rows, 0.6) == brute(sets, 0.6)
