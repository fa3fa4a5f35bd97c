import random
from collections import Counter
from datetime import datetime
from itertools import combinations

from recordloom.llm import near_dup

AT = datetime(2024, 1, 1)


def frame(spark, rows):
    return spark.createDataFrame([(i, AT, t, "x", 7) for i, t in rows], "id string, at timestamp_ntz, text string, rep string, row int")


def share(a, b):
    x, y = Counter(near_dup.words(a)), Counter(near_dup.words(b))
    return (x & y).total() / (x | y).total()


def corpus():
    rng = random.Random(9)
    vocabulary = [f"w{i}" for i in range(400)] + ["the"] * 60
    texts = {}
    for i in range(240):
        if texts and rng.random() < 0.6:
            ws = near_dup.words(texts[rng.choice(sorted(texts))])
            for _ in range(rng.randint(0, 14)):
                k = rng.randrange(len(ws))
                ws[k : k + rng.randint(0, 1)] = [rng.choice(vocabulary)] * rng.randint(0, 2)
            if rng.random() < 0.3:
                rng.shuffle(ws)
        else:
            ws = [rng.choice(vocabulary) for _ in range(rng.randint(25, 90))]
        texts[f"t{i:03d}"] = " ".join(ws).title()
    return texts


def test_finds_the_pairs(spark):
    texts = corpus()
    members, links = near_dup.similar_classes(frame(spark, sorted(texts.items())), 0.7, 20)
    got = {tuple(r) for r in near_dup.expand(members, links).collect()}
    want = {(a, b) for a, b in combinations(sorted(texts), 2) if min(len(near_dup.words(texts[x])) for x in (a, b)) >= 20 and share(texts[a], texts[b]) >= 0.7}
    assert got <= want and len(got) >= 0.99 * len(want) > 50


def test_groups_are_connected_components(spark):
    texts = corpus()
    members, links = near_dup.similar_classes(frame(spark, sorted(texts.items())), 0.7, 20)
    pairs = [tuple(r) for r in near_dup.expand(members, links).collect()]
    root = {r.id: r.id for r in members.collect()}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    assert {r.id: r.group_id for r in near_dup.groups(members, links).collect()} == {i: find(i) for i in root}


def test_nulls_empty_long_and_repeated(spark):
    long = " ".join(f"word{i % 5000}" for i in range(60_000))
    rows = [
        ("a", "one two three " * 10), ("a", "one two three " * 10), ("b", "ONE, two; three! " * 10), ("c", None), ("d", ""), ("e", "short"),
        (None, "one two three " * 10), ("f", long), ("g", long + " more"),
    ]
    members, links = near_dup.similar_classes(frame(spark, rows), 0.7, 20)
    assert {r.id for r in members.collect()} == {"a", "b", "f", "g"}
    assert {tuple(r) for r in near_dup.expand(members, links).collect()} == {("a", "b"), ("f", "g")}
    assert {r.id: r.group_id for r in near_dup.groups(members, links).collect()} == {"a": "a", "b": "a", "f": "f", "g": "f"}


def test_empty(spark):
    members, links = near_dup.similar_classes(frame(spark, []), 0.7, 20)
    assert members.count() == 0 and near_dup.expand(members, links).count() == 0 and near_dup.groups(members, links).count() == 0


def test_exact_candidates_find_every_pair(spark):
    texts = corpus()
    members, links = near_dup.similar_classes(frame(spark, sorted(texts.items())), 0.7, 20, exact=True)
    want = {(a, b) for a, b in combinations(sorted(texts), 2) if min(len(near_dup.words(texts[x])) for x in (a, b)) >= 20 and share(texts[a], texts[b]) >= 0.7}
    assert {tuple(r) for r in near_dup.expand(members, links).collect()} == want


def test_row_of_a_repeated_id_and_its_text_agree(spark):
    x, near = "alpha beta gamma delta " * 6, "alpha beta gamma delta " * 6 + "more"
    y = "one two three four five " * 6
    for times in ([None, AT], [AT, AT]):
        rows = [("a", times[0], x), ("a", times[1], y), ("b", AT, near), ("c", AT, y + "six")]
        members, links = near_dup.similar_classes(spark.createDataFrame(rows, "id string, at timestamp_ntz, text string"), 0.7, 20)
        got = {tuple(r) for r in near_dup.expand(members, links).collect()}
        # Of equal times one of the two texts counts, with all its links.
        assert got == {("a", "b")} or (times[0] is not None and got == {("a", "c")})


def test_earliest_row_decides_whether_a_record_is_long_enough(spark):
    rows = [("a", datetime(2024, 1, 1), "too short"), ("a", datetime(2024, 2, 1), "one two three " * 10), ("b", AT, "one two three " * 10)]
    members, _ = near_dup.similar_classes(spark.createDataFrame(rows, "id string, at timestamp_ntz, text string"), 0.7, 20)
    assert {r.id for r in members.collect()} == {"b"}


def test_a_band_of_ten_thousand_is_cut_into_bounded_groups(spark):
    reps = spark.range(10_000).selectExpr("id AS row", "array(7L, id + 100) AS bands")
    large = near_dup.large_bands(reps)
    assert [r.band for r in large.collect()] == [7]
    keyed = reps.selectExpr("explode(bands) AS band", "row", "0L AS s")
    left, right = near_dup.in_blocks(keyed, large)
    sizes = left.groupBy("band", "i", "j").count().join(right.groupBy("band", "i", "j").agg({"*": "count"}), ["band", "i", "j"]).collect()
    blocks = large.first().blocks
    assert len(sizes) == blocks * (blocks + 1) // 2 and max(max(r[3], r[4]) for r in sizes) < 2 * near_dup.BAND_ROWS


def test_blocks_lose_and_repeat_no_pair(spark, monkeypatch):
    monkeypatch.setattr(near_dup, "BAND_ROWS", 5)
    monkeypatch.setattr(near_dup, "COUNTED", 1)
    rows = [(f"v{i:02d}", " ".join(f"w{j}" for j in range(40)) + f" end{i}") for i in range(40)]
    members, links = near_dup.similar_classes(frame(spark, rows), 0.7, 20)
    got = [tuple(r) for r in near_dup.expand(members, links).collect()]
    assert sorted(got) == list(combinations([i for i, _ in rows], 2))
