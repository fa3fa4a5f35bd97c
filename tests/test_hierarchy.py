import random

import pytest

from recordloom.operators import hierarchy


def brute(parent):
    nodes = set(parent) | set(parent.values())
    paths = {}
    for v in nodes:
        path, x = [v], v
        while x in parent and len(path) <= len(nodes) + 1:
            x = parent[x]
            path.append(x)
        paths[v] = None if x in parent else path[::-1]
    below = dict.fromkeys(nodes, 0)
    for p in filter(None, paths.values()):
        for a in p[:-1]:
            below[a] += 1
    return paths, below


@pytest.mark.parametrize(("n", "fragment"), [(60, 7), (250, 40), (250, 20)])
def test_matches_walking_up(spark, n, fragment):
    rng = random.Random(n)
    ids = [f"n{i:04d}" for i in range(n)]
    parent = {ids[i]: ids[max(0, i - rng.randint(1, 3))] if rng.random() < 0.9 else rng.choice(ids) for i in range(1, n) if rng.random() < 0.9}
    df = spark.createDataFrame(list(parent.items()), "node string, parent string")
    got = {r.node: r for r in hierarchy.resolve_hierarchy(df, fragment, True).collect()}
    paths, below = brute(parent)
    assert set(got) == set(paths)
    for v, p in paths.items():
        want = ("cycle", -1, -1, None) if p is None else (p[0], len(p) - 1, below[v], p)
        assert (got[v].root, got[v].depth, got[v].descendants, got[v].path) == want


def test_nulls_repeats_self_links_and_extra_columns(spark):
    rows = [("a", "b", 1), ("a", "b", 2), ("b", None, 3), (None, "b", 4), ("s", "s", 5), ("d", "z", 6), ("d", "y", 7)]
    df = spark.createDataFrame(rows, "node string, parent string, depth int")
    got = {r.node: (r.root, r.depth, r.descendants) for r in hierarchy.resolve_hierarchy(df).collect()}
    assert got == {"a": ("b", 1, 0), "b": ("b", 0, 1), "s": ("cycle", -1, -1), "d": ("y", 1, 0), "y": ("y", 0, 1), "z": ("z", 0, 0)}


def test_cycle_inside_a_fragment_entered_from_others(spark):
    links = [("a0", "a1"), ("a1", "a0")] + [(f"m{i}", "a0") for i in range(6)] + [(f"z{i}", f"m{i}") for i in range(6)] + [("y1", "y0"), ("z9", "y1")]
    got = {r.node: (r.root, r.depth, r.descendants, r.path) for r in hierarchy.resolve_hierarchy(
        spark.createDataFrame(links, "node string, parent string"), 4, True,
    ).collect()}
    assert all(got[n] == ("cycle", -1, -1, None) for n in ["a0", "a1", *[f"{c}{i}" for c in "mz" for i in range(6)]])
    assert got["z9"] == ("y0", 2, 0, ["y0", "y1", "z9"]) and got["y0"][2] == 2


def test_empty(spark):
    df = spark.createDataFrame([], "node string, parent string")
    assert hierarchy.resolve_hierarchy(df).collect() == []


def test_hot_parent_and_closure(spark):
    df = spark.createDataFrame([(f"c{i:03d}", "hub") for i in range(200)] + [("hub", "top")], "node string, parent string")
    got = hierarchy.resolve_hierarchy(df, 30, True)
    rows = {r.node: r for r in got.collect()}
    assert (rows["top"].descendants, rows["hub"].descendants, rows["c007"].path) == (201, 200, ["top", "hub", "c007"])
    assert hierarchy.closure(got).count() == 200 * 2 + 1


def test_long_chain_under_random_keys_contracts_every_round(spark):
    rng, n = random.Random(3), 3000
    keys = [f"k{i:05d}" for i in rng.sample(range(100_000), n)]
    parent = dict(zip(keys[1:], keys, strict=False))
    sizes = []
    got = {r.node: (r.root, r.depth, r.descendants) for r in hierarchy.resolve_hierarchy(
        spark.createDataFrame(list(parent.items()), "node string, parent string"), 250, sizes=sizes,
    ).collect()}
    assert got == {k: (keys[0], i, n - 1 - i) for i, k in enumerate(keys)}
    # The first cut goes by key, which is random here; from then on nodes go with the heads above them.
    assert len(sizes) > 3 and all(b < 0.6 * a for a, b in zip(sizes[1:], sizes[2:], strict=False))
