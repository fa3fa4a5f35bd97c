import random
from collections import deque

import pytest

from recordloom.operators import graph

FIELDS = graph.EDGE_TYPES


def frame(spark, links):
    rows = [(i, *[l.get(f) if f != "superseded_by" else (l.get(f) or [None])[0] for f in FIELDS], l.get("title"), "clash") for i, l in links.items()]
    kinds = ", ".join(f"{f} string" if f == "superseded_by" else f"{f} array<string>" for f in FIELDS)
    return spark.createDataFrame(rows, f"id string, {kinds}, title string, dst string")


def world(seed, n=30):
    rng = random.Random(seed)
    ids = [f"ms_{i:03d}" for i in range(n)]
    return {i: {f: [rng.choice([*ids, "ms_LOST"]) for _ in range(rng.randint(0, 1 if f == "superseded_by" else 2))] for f in FIELDS} for i in ids}


def walk(links, seeds, depth, cap):
    seen, out, queue = set(seeds), [], deque((s, s, 0) for s in seeds)
    while queue:
        at, seed, hop = queue.popleft()
        if hop == depth:
            continue
        for f in FIELDS:
            for dst in links.get(at, {}).get(f) or []:
                if dst not in seen:
                    seen.add(dst)
                    out.append((dst, seed, f, hop + 1))
                    queue.append((dst, seed, hop + 1))
                    if len(out) == cap:
                        return out
    return out


@pytest.mark.parametrize(("seed", "depth", "cap"), [(1, 1, 50), (2, 2, 50), (3, 3, 5), (4, 3, 17), (5, 3, 50)])
def test_expansion_is_a_queue_walk(spark, seed, depth, cap):
    links = world(seed)
    seeds = ["ms_003", "ms_001", "ms_LOST"]
    edges = graph.edges_view(frame(spark, links))
    got = graph.expand_graph(spark.createDataFrame([(s, k) for k, s in enumerate(seeds)], "id string, pos int"), edges, depth, cap)
    assert [(r.id, r.from_id, r.edge_type, r.hops) for r in got.orderBy("pos").collect()] == walk(links, seeds, depth, cap)


def test_edges_skip_blank_and_null(spark):
    df = frame(spark, {"ms_A": {"refines": [" ms_b ", None, "", "MS_C"]}, "ms_B": {}})
    assert [(r.dst, r.arr_pos) for r in graph.edges_view(df).collect()] == [("ms_B", 0), ("ms_C", 3)]
    assert graph.edges_view(df.limit(0)).count() == 0


def test_chain_and_closure(spark):
    links = {f"ms_{i}": {"refines": [f"ms_{i + 1}"], "supersedes": [f"ms_{(i + 1) % 6}"]} for i in range(6)} | {"ms_9": {"refines": ["ms_9", "ms_LOST"]}}
    df = frame(spark, links)
    got = {(r.id, r.target): r.hops for r in graph.relation_chain(df, "refines").collect()}
    assert got == {(f"ms_{i}", f"ms_{j}"): j - i for i in range(6) for j in range(i + 1, min(i + 4, 6))}
    before, after = graph.lineage(df)
    assert before.count() == 30 and after.count() == 0
