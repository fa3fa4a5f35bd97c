import random

import numpy as np

from recordloom.llm import leakage


def test_index_counts_and_locates():
    rng = np.random.default_rng(2)
    docs = [rng.integers(1, 6, rng.integers(3, 40)) for _ in range(30)]
    docs += [docs[0], docs[0], np.array([3] * 50)]
    seq = np.concatenate([np.append(d, 0) for d in docs])
    assert [tuple(seq[i:]) for i in leakage.suffix_array(seq)] == sorted(tuple(seq[i:]) for i in range(len(seq)))
    index = leakage.FMIndex.load(leakage.FMIndex.of(seq, 4).arrays())
    assert (index.tree.get(np.arange(len(seq))) == seq[leakage.suffix_array(seq) - 1]).all()
    phrases = np.array([seq[i : i + 3] for i in range(len(seq) - 3) if (seq[i : i + 3] > 0).all()] + [[5, 5, 9], [1, 7, 1]])
    lo, hi = index.search(phrases)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(seq) - 2) if (seq[i : i + 3] == p).all()]
        assert b - a == len(want)
        assert sorted(index.locate(np.arange(a, b))) == want


def frames(spark, docs, items):
    return spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int"), spark.createDataFrame(
        [(i, t, "test", 1) for i, t in items], "item_id long, text string, split string, doc_id int",
    )


def brute(docs, items, n=13):
    w = lambda t: leakage._WORD.findall((t or "").lower())
    grams = lambda t: {tuple(x[k : k + n]) for x in [w(t)] for k in range(len(x) - n + 1)}
    return {(d, i) for d, t in docs for i, u in items if grams(t) & grams(u)}


def test_matches_brute_force_in_small_shards_and_blocks(spark):
    rng = random.Random(4)
    word = lambda: f"w{rng.randrange(60)}"
    items = [(i, " ".join(word() for _ in range(rng.randint(5, 40)))) for i in range(30)]
    docs = []
    for d in range(120):
        ws = [word() for _ in range(rng.randint(0, 80))]
        if rng.random() < 0.5:
            part = items[rng.randrange(30)][1].split()
            k = rng.randrange(len(part))
            ws[len(ws) // 2 : len(ws) // 2] = [x.upper() + "," for x in part[k : k + rng.randint(8, 20)]]
        docs.append((d, " ".join(ws)))
    docs += [(500, None), (501, ""), (502, docs[3][1]), (503, " ".join(t for _, t in docs))]
    d, i = frames(spark, docs, items)
    want = brute(docs, items)
    assert len(want) > 20
    for more in ({}, {"shard_words": 200}, {"shard_words": 500, "block_words": 150}):
        assert {tuple(r) for r in leakage.leaked(d, i, 13, **more).collect()} == want


def test_spans_merge(spark):
    item = " ".join(f"a{k}" for k in range(40))
    d, i = frames(
        spark, [(1, "x y " + " ".join(item.split()[:20]) + " z " + " ".join(item.split()[10:24])), (1, None)],
        [(9, item), (8, None), (7, "too short")],
    )
    assert sorted(tuple(r) for r in leakage.leaked_spans(d, i).collect()) == [(1, 9, 2, 22), (1, 9, 23, 37)]
    report = {r.item_id: (r.documents, r.leaked) for r in leakage.item_report(i, leakage.leaked_spans(d, i)).collect()}
    assert report == {9: (1, True), 8: (0, False), 7: (0, False)}


def test_empty(spark):
    d, i = frames(spark, [], [])
    assert leakage.leaked(d, i).count() == 0
    d, i = frames(spark, [(1, "a " * 30)], [])
    assert leakage.leaked(d, i).count() == 0


def test_long_documents_are_cut_and_their_spans_joined(spark):
    item = " ".join(f"a{k}" for k in range(300))
    text = " ".join(f"x{k}" for k in range(150)) + " " + item + " end " + " ".join(f"y{k}" for k in range(500)) + " " + " ".join(item.split()[100:113])
    d, i = frames(spark, [(1, text), (1, text), (2, "a b c")], [(9, item)])
    got = sorted(tuple(r) for r in leakage.leaked_spans(d, i, 13, shard_words=100).collect())
    assert got == [(1, 9, 150, 450), (1, 9, 150, 450), (1, 9, 951, 964), (1, 9, 951, 964)]


def test_one_build_serves_all_blocks(spark):
    items = [(k, " ".join(f"i{k}w{j}" for j in range(30))) for k in range(40)]
    d, i = frames(spark, [(k, "so " + t) for k, t in items], items)
    indexes = leakage.shard_indexes(d, 300)
    assert indexes.count() > 3
    got = {tuple(r) for r in leakage.leaked(d, i, 13, block_words=100, indexes=indexes).collect()}
    assert got == {(k, k) for k, _ in items}
