import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from recordloom.functions import porter
from recordloom.functions.records import Settings
from recordloom.functions.text import prefix_stem
from recordloom.operators import search


def now():
    return F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")


SCHEMA = "id string, type string, title string, tags array<string>, body string, created timestamp_ntz, length int, x0 int, t_title string"


def frame(spark, rows):
    from datetime import datetime

    return spark.createDataFrame([(i, t, a, g, b, datetime(2024, 1, d), 0, 7, "clash") for i, t, a, g, b, d in rows], SCHEMA)


def full_text(rows, expression, tokenizer="unicode61"):
    con = sqlite3.connect(":memory:")
    try:
        con.execute(f"create virtual table f using fts5(id unindexed, title, tags, body, tokenize='{tokenizer}')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    con.executemany("insert into f values (?, ?, ?, ?)", [(i, a, " ".join(g or []), b) for i, _, a, g, b, _ in rows])
    return {i: round(-s, 6) for i, s in con.execute("select id, bm25(f, 0, 5, 1, 1) from f where f match ?", (expression,))}


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(8)
    words = "cache token router café auth build deploy naïve schema index configured migration the of".split()
    return [(
        f"r{i:02d}", rng.choice(["fact", "decision"]), " ".join(rng.choices(words, k=4)), rng.sample(words, 2),
        " ".join(rng.choices(words, k=rng.randint(0, 40))), 1 + i % 28,
    ) for i in range(60)]


@pytest.mark.parametrize(
    ("query", "expression", "stage"),
    [
        ("cache router", '"cache" AND "router"', "and"), ("Cafe", '"cafe"', "and"), ("auth-token", '"auth token"', "and"),
        ("cache zzz", '"cache" OR "zzz"', "or"), ("configurat migrat", '"config"* AND "migrat"*', "and_prefix"),
    ],
)
def test_scores_agree_with_a_full_text_engine(spark, corpus, query, expression, stage):
    if stage == "and_prefix":
        expression = " AND ".join(f'"{prefix_stem(t)}"*' for t in query.split())
    want = full_text(corpus, expression)
    got = {r.id: r.bm25 for r in search.matches(frame(spark, corpus), query, stage=stage).collect()}
    assert set(got) == set(want)
    assert all(abs(got[k] - want[k]) < 2e-6 for k in want)


def test_stages_fall_back(spark):
    df = frame(spark, [("a", "fact", "configure deployments", [], "", 1), ("b", "fact", "other", None, None, 1), ("c", None, None, [], "deploy cache", 1)])
    ids = lambda q, **k: {r.id for r in search.matches(df, q, **k).collect()}
    assert ids("configure deployments") == {"a"}
    assert ids("configuration deployment") == {"a"}
    assert ids("cache nowhere") == {"c"}
    assert ids("cache nowhere", types=["fact"]) == set()
    assert ids("") == ids("!!!") == ids("nowhere") == set()


def test_rerank_prefers_phrases_and_types(spark):
    df = frame(
        spark,
        [
            ("a", "fact", "token cache notes", [], "x", 1), ("b", "fact", "cache token", [], "x", 1),
            ("c", "decision", "cache", ["token"], "y", 28), *[(f"o{i}", "fact", "other", [], "words", 1) for i in range(9)],
        ],
    )
    top = [r.id for r in search.search(df, "cache token", now(), 3).orderBy("rank").collect()]
    assert top[0] == "b" and set(top) == {"a", "b", "c"}
    assert [r.id for r in search.search(df, "cache token", now(), 3, types=["decision"]).collect()] == ["c"]
    assert {(r.length, r.x0, r.t_title) for r in search.search(df, "cache token", now(), 3).collect()} == {(0, 7, "clash")}
    assert search.search(df.limit(0), "cache", now()).count() == 0
    assert search.search(df, "cache", now(), 1, settings=Settings(relevance=0.0, recency=1.0)).first().id == "c"


def test_layers_keep_their_order(spark):
    high, low = frame(spark, [("a", "fact", "cache", [], "", 1)]), frame(spark, [("a", "fact", "cache cache", [], "", 1), ("b", "fact", "cache", [], "", 1)])
    got = search.search_layers([("high", high), ("low", low)], "cache", now()).collect()
    assert [(r.from_layer, r.id) for r in got] == [("high", "a"), ("low", "b")]


def test_stems_agree_with_the_published_algorithm(spark):
    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(t, tokenize='porter unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    con.execute("create virtual table v using fts5vocab(f, 'row')")
    words = """caresses ponies ties cats feed agreed plastered bled motoring sing conflated troubled sized hopping tanned falling hissing fizzed failing filing happy sky relational conditional
    rational valenci hesitanci digitizer conformabli radicalli differentli vileli analogousli vietnamization predication operator feudalism decisiveness hopefulness callousness formaliti sensitiviti
    sensibiliti triplicate formative formalize electriciti electrical hopeful goodness revival allowance inference airliner gyroscopic adjustable defensible irritant replacement adjustment dependent
    adoption homologou communism activate angulariti homologous effective bowdlerize probate rate cease controll roll configured configuration migrations generalizations oscillators""".split()
    for w in words:
        con.execute("delete from f")
        con.execute("insert into f values (?)", (w,))
        assert porter.stem(w) == con.execute("select term from v").fetchone()[0], w
    df = spark.createDataFrame([(w,) for w in words[:5]] + [(None,)], "term string")
    assert {r.term: r.stem for r in search.stemmed_vocabulary(df).collect()} == {w: porter.stem(w) for w in words[:5]}


def test_cosine(spark):
    df = spark.createDataFrame([([1.0, 0.0], [0.0, 1.0]), ([1.0, 2.0], [2.0, 4.0]), ([0.0, 0.0], [1.0, 1.0])], "a array<double>, b array<double>")
    assert [round(r.c, 6) for r in df.select(search.cosine(F.col("a"), F.col("b")).alias("c")).collect()] == [0.0, 1.0, 0.0]
    with pytest.raises(Exception, match="differ"):
        spark.createDataFrame([([1.0], [1.0, 2.0])], "a array<double>, b array<double>").select(search.cosine(F.col("a"), F.col("b"))).collect()
    got = search.embed(spark.createDataFrame([("ab",), (None,)], "body string"), lambda texts: [[float(len(t))] for t in texts])
    assert sorted(r.embedding[0] for r in got.collect()) == [0.0, 2.0]


def test_words_are_found_by_their_stems(spark):
    rows = [
        ("a", "fact", "record of caches", ["running"], "happy 2020s auth tokens ponies", 1),
        ("b", "fact", "recorded", ["cache"], "records recording cached runs happily", 1),
        ("c", "fact", "recorder", [], "happiness 2020 auth token pony cat", 1),
    ]
    rows += [(f"o{i}", "fact", "other", [], "words", 1) for i in range(9)]
    for query, expression, stage in [
        ("record", "record", "and"), ("records caching", "records AND caching", "and"), ("auth-token", '"auth token"', "and"),
        ("2020s", "2020s", "and"), ("ponies zzz", "ponies OR zzz", "or"), ("happiness", "happi*", "and_prefix"),
        ("recordings", "record*", "and_prefix"), ("auth-tokens", '"auth token" *', "and_prefix"),
    ]:
        want = full_text(rows, expression, "porter unicode61")
        got = {r.id: r.bm25 for r in search.matches(frame(spark, rows), query, stage=stage).collect()}
        assert set(got) == set(want) and all(abs(got[k] - want[k]) < 2e-6 for k in want), query
    assert {r.id for r in search.matches(frame(spark, rows), "record", stem=False).collect()} == {"a"}
    assert {r.id for r in search.search(frame(spark, rows), "record", now()).collect()} == {"a", "b", "c"}


def test_stems_of_any_token():
    assert [porter.stem(w) for w in ("2020s", "v0s", "ies", "sses", "as", "x" * 70 + "s")] == ["2020", "v0", "ie", "sse", "as", "x" * 70 + "s"]


def test_every_layer_is_searched_and_ranked_on_its_own(spark, sf, tmp_path):
    from recordloom.plans import records

    assert {r.from_layer for r in records.search_layers(spark, sf).collect()}
    # The one record with the words of the query lies in the last layer, then in one the table does not know.
    names = [r.name for r in spark.read.parquet(f"{sf}/layers.parquet").orderBy(F.desc("priority"), "name").collect()]
    for layer in (names[-1], "elsewhere"):
        d = tmp_path / layer
        d.mkdir()
        spark.read.parquet(f"{sf}/layers.parquet").write.parquet(str(d / "layers.parquet"))
        for name in ("memory_records", "archive_records"):
            rows = spark.read.parquet(f"{sf}/{name}.parquet")
            hit = F.col("id") == spark.read.parquet(f"{sf}/memory_records.parquet").where("state = 'active'").agg(F.min("id")).first()[0]
            rows = rows.withColumns({
                "title": F.when(hit, "router supersedes").otherwise("other"), "body": F.lit("words"),
                "tags": F.array().cast("array<string>"), "layer": F.when(hit, layer).otherwise(F.lit(names[0])),
            })
            rows.write.parquet(str(d / f"{name}.parquet"))
        assert [(r.from_layer, r["rank"]) for r in records.search_layers(spark, str(d)).collect()] == [(layer, 1)]


def test_layers_at_once_equal_layers_one_by_one(spark, corpus):
    parts = [frame(spark, corpus[k::3]) for k in range(3)]
    for query in ("cache router", "migrations zzz", "configurat", "nowhere"):
        got = search.search_layers([(str(k), p) for k, p in enumerate(parts)], query, now(), 100)
        want = {(str(k), r["rank"], r.id, r.bm25, r.score) for k, p in enumerate(parts) for r in search.search(p, query, now(), 100).collect()}
        assert {(r.from_layer, r["rank"], r.id, r.bm25, r.score) for r in got.collect()} == want


def test_marks_fold_as_in_a_full_text_engine(spark):
    from recordloom.functions.text import tokens

    con = sqlite3.connect(":memory:")
    try:
        con.execute("create virtual table f using fts5(t, tokenize='unicode61')")
    except sqlite3.OperationalError:
        pytest.skip("no full-text module")
    con.execute("create virtual table v using fts5vocab(f, 'row')")
    words = ["šž", "ćő", "naïve", "Ångström", "ÿ", "đ", "ß", "ĳ", "ệ", "Ǘ", "œuvre", "ł"]
    want = {}
    for w in words:
        con.execute("delete from f")
        con.execute("insert into f values (?)", (w,))
        want[w] = [r[0] for r in con.execute("select term from v")]
    got = {r.w: r.t for r in spark.createDataFrame([(w,) for w in words], "w string").select("w", tokens(F.col("w")).alias("t")).collect()}
    assert got == want


def test_vectors_in_blocks(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.uniform(-1, 1) for _ in range(4)]) for i in range(30)] + [(99, [0.0] * 4)]
    v = spark.createDataFrame(rows, "id long, embedding array<double>")
    q = spark.createDataFrame(rows[:5], "query_id long, query array<double>")
    whole = sorted(map(tuple, search.similarities(v, q).collect()))
    assert len(whole) == 5 * 31
    monkeypatch.setattr(search, "QUERY_BLOCK", 2)
    assert sorted(map(tuple, search.similarities(v, q).collect())) == whole
    near = search.nearest_vectors(v, q, 3).collect()
    assert len(near) == 15 and all(r.similarity == 1.0 for r in near if r["rank"] == 1)
    assert search.similarities(v, q.limit(0)).count() == 0 == search.nearest_vectors(v.limit(0), q, 3).count()
