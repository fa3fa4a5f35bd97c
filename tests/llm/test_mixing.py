from collections import Counter

import numpy as np
import pytest

from recordloom.llm import mixing


def frames(spark, docs, targets):
    d = spark.createDataFrame([(i, s, t, 1) for i, s, t in docs], "doc_id long, source string, text string, tokens int")
    return d, spark.createDataFrame([(*t, "x") for t in targets], "source string, weight double, max_repeats int, tokens string")


@pytest.fixture(scope="module")
def world(spark):
    docs = [(i, "Big " if i % 7 else "BIG", "alpha beta gamma delta " * 20) for i in range(300)] + [(1000 + i, "small", "one two " * 15) for i in range(30)] + [
        (2000, "other", "x"), (2001, None, "y"), (2002, "small", None), (2003, "small", ""),
    ]
    d, t = frames(spark, docs, [("big", 0.6, 1), ("SMALL", 0.3, 2), ("none", 0.1, 5)])
    return mixing.sized(d, t, mixing.default_tokenizer()), t


def test_counts_agree_with_the_json_tokenizer(spark):
    tokenizers = pytest.importorskip("tokenizers")
    texts = ["Hello, world! It's 2024.", "  spaces\n\n and\ttabs ", "naïve café", ""]
    full = tokenizers.Tokenizer.from_file(mixing.default_tokenizer().replace(".tiktoken", ".json"))
    df = spark.createDataFrame([(t,) for t in texts], "text string").coalesce(1)
    got = [r.n for r in df.select(mixing.token_counter(mixing.default_tokenizer())("text").alias("n")).collect()]
    assert got == [len(full.encode(t, add_special_tokens=False).ids) for t in texts]


def test_supply_and_reach(spark, world):
    sizes, t = world
    rows = {r.source: r for r in mixing.supply(sizes, t, 64).collect()}
    assert set(rows) == {"big", "small", "none"}
    assert rows["big"].documents == 300 and rows["small"].documents == 32 and rows["none"].tokens == 0
    total = rows["big"].tokens + rows["small"].tokens
    for r in rows.values():
        assert r.reachable == (r.tokens * r.max_repeats >= r.weight * total)
    assert not rows["small"].reachable and not rows["none"].reachable and rows["big"].reachable


def test_blocks_hold_every_token_once(spark, world):
    sizes, _ = world
    want = {r.doc_id: r.tokens for r in sizes.collect() if r.tokens}
    for chunk in (7, 100_000):
        got, per_block = Counter(), Counter()
        for r in mixing.packed(sizes, 64, chunk).collect():
            got[r.doc_id] += r.to_token - r.from_token
            per_block[r.source, r.block] += r.to_token - r.from_token
        assert got == want and max(per_block.values()) == 64
        assert sum(v < 64 for v in per_block.values()) <= 2


def test_mixture_repeats_no_block_too_often(spark, world):
    sizes, t = world
    slots, supplies = mixing.mixture(sizes, t, 64, 16)
    rows, limits = slots.collect(), {r.source: r for r in supplies.collect()}
    used = Counter((r.source, r.block) for r in rows)
    assert rows and all(n <= limits[s].max_repeats for (s, _), n in used.items())
    assert len({(r.shard, r.slot) for r in rows}) == len(rows)
    assert all(0 <= r.block < limits[r.source].blocks for r in rows)
    whole = mixing.assembled(slots, mixing.packed(sizes, 64))
    tokens = sum(r.to_token - r.from_token for r in whole.collect())
    report = {r.source: r for r in mixing.report(slots, supplies, 64).collect()}
    assert tokens == sum(r.drawn_tokens for r in report.values())
    assert abs(sum(r.share for r in report.values()) - 1) < 1e-9
    assert report["small"].drawn_tokens <= report["small"].capacity


def test_permutation():
    for n in (1, 2, 3, 100, 1025):
        got = mixing._permute(np.arange(n), np.full(n, n), np.full(n, 99, np.uint64))
        assert sorted(got) == list(range(n))


def test_empty(spark):
    d, t = frames(spark, [], [("a", 1.0, 1)])
    sizes = mixing.sized(d, t, mixing.default_tokenizer())
    slots, supplies = mixing.mixture(sizes, t)
    assert slots.count() == 0 and mixing.report(slots, supplies).first().share == 0.0
    d, t = frames(spark, [(1, "a", "hello")], [])
    slots, supplies = mixing.mixture(mixing.sized(d, t, mixing.default_tokenizer()), t)
    assert slots.count() == 0 and supplies.count() == 0


def test_shares_meet_the_weights_within_the_stated_bound(spark):
    import random

    rng = random.Random(1)
    weights = {f"s{k}": w for k, w in enumerate((0.3, 0.2, 0.15, 0.1, 0.1, 0.05, 0.05, 0.05))}
    sizes = spark.createDataFrame([(i, f"s{i % 8}", rng.randint(50, 900)) for i in range(1600)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([(s, w, 4) for s, w in weights.items()], "source string, weight double, max_repeats int")
    block = mixing.block_size(sizes)
    slots, supplies = mixing.mixture(sizes, targets, block)
    got = {r.source: r for r in mixing.reached(mixing.assembled(slots, mixing.packed(sizes, block)), supplies).collect()}
    assert mixing.LEAST_BLOCK <= block < mixing.BLOCK_TOKENS
    assert all(abs(got[s].share - w) < 0.005 and abs(got[s].share_of_asked - w) < 0.005 for s, w in weights.items())
    by_slots = {r.source: r.drawn_tokens for r in mixing.report(slots, supplies, block).collect()}
    assert by_slots == {s: r.drawn_tokens for s, r in got.items()}


def test_a_source_that_runs_out_leaves_its_slots_empty(spark):
    sizes = spark.createDataFrame([(i, "big" if i % 10 else "small", 400) for i in range(1000)], "doc_id long, source string, tokens long")
    targets = spark.createDataFrame([("big", 0.5, 2), ("small", 0.5, 2)], "source string, weight double, max_repeats int")
    slots, supplies = mixing.mixture(sizes, targets, 80)
    got = {r.source: r for r in mixing.reached(mixing.assembled(slots, mixing.packed(sizes, 80)), supplies).collect()}
    assert abs(got["small"].share_of_asked - 0.2) < 1e-6 and abs(got["big"].share_of_asked - 0.5) < 0.005
    assert abs(got["small"].share - 0.2 / 0.7) < 0.005 and not got["small"].reachable
