from pyspark.sql import functions as F

from recordloom.llm import reading_level


def test_prose_leaves_out_what_is_none(spark):
    text = "---\ntitle: x\n---\n# Heading\n\nOne two\nthree. Four `a/b.py` five!\n\n```py\nno = 1\n```\n| a | b |\n|---|---|\n- Six seven.\n12:30 Eight.\nuser: Nine?\nsee https://x.y/z, e.g. sec. 3 (approx.)\n> Ten, e.g. eleven.\n~~~\nopen fence"
    df = spark.createDataFrame([("a", text), ("b", None), ("c", ""), ("d", "```\nonly code")], "id string, text string")
    got = {r.id: (r.sentence, list(r.w)) for r in reading_level.measured(df).collect()}
    assert got["a"][1] == "one two three four code five six seven eight nine ten e g eleven".split()
    assert got["b"] == got["c"] == got["d"] == (0.0, [])


def test_coverage_rank(spark):
    df = spark.createDataFrame([("a", "x x x y"), ("b", "x y z. x y q"), ("c", "")], "id string, text string")
    read = reading_level.measured(df)
    ranks = reading_level.ranked(read)
    assert {r.word: r["rank"] for r in ranks.collect()} == {"x": 1, "y": 2, "z": 4, "q": 4}
    got = {r.id: round(float(r["rank"]), 6) for r in reading_level.profiles(read, ranks, 0.75).select("id", F.expm1("rank").alias("rank")).collect()}
    assert got == {"a": 1.0, "b": 4.0, "c": 0.0}
    new = reading_level.measured(spark.createDataFrame([("d", "unseen words")], "id string, text string"))
    assert [round(float(r["rank"]), 6) for r in reading_level.profiles(new, ranks, 0.75).select(F.expm1("rank").alias("rank")).collect()] == [5.0]


def test_rare_words_rank_the_same_by_the_shuffled_way(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("lang = 'en'").select(F.col("doc_id").alias("id"), "text")
    read = reading_level.measured(docs)
    ranks = reading_level.ranked(read)
    want = {r.id: (r.length, r["rank"]) for r in reading_level.profiles(read, ranks).collect()}
    monkeypatch.setattr(reading_level, "COMMON_WORDS", 50)
    assert {r.id: (r.length, r["rank"]) for r in reading_level.profiles(read, ranks).collect()} == want


def test_held_out_samples(spark, sf):
    """Every third sample is judged by levels fitted on the others."""
    samples = spark.read.parquet(f"{sf}/level_samples.parquet")
    train = samples.where("sample_id % 3 <> 0")
    held = samples.where("sample_id % 3 = 0").select(F.col("sample_id").alias("id"), "text", F.col("level").alias("truth"), F.lit(1).alias("level"))
    got = reading_level.levels(held, train).join(held.select("id", "truth"), "id").collect()
    assert len(got) > 15 and sum(r.level == r.truth for r in got) >= 0.9 * len(got)


def test_nulls_long_and_empty(spark, sf):
    samples = spark.read.parquet(f"{sf}/level_samples.parquet")
    docs = spark.createDataFrame([("n", None), ("e", ""), ("s", "   "), ("l", "The cat sees the dog. " * 5000)], "id string, text string")
    got = {r.id: r.level for r in reading_level.levels(docs, samples).collect()}
    assert got == {"n": 1, "e": 1, "s": 1, "l": 1}
    assert reading_level.levels(docs.limit(0), samples).count() == 0
    assert [r.level for r in reading_level.levels(docs, samples.limit(0)).collect()] == [None] * 4
