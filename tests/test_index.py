import pytest
from pyspark.sql import functions as F

from recordloom.operators import index, search


@pytest.fixture(scope="module")
def active(spark, sf):
    rows = spark.read.parquet(f"{sf}/memory_records.parquet").dropDuplicates(["id"])
    return rows.select("id", "type", "title", "tags", "body").cache()


@pytest.mark.parametrize(
    "query",
    ["router", "router supersedes", "migrat normaliz", "hierarchy zzzunknown", "the-hidden each", "v0-30 the", "", "!!", "nowhere"],
)
@pytest.mark.parametrize("types", [None, ["decision"]])
def test_same_scores_as_without_an_index(spark, active, tmp_path_factory, query, types):
    path = str(tmp_path_factory.getbasetemp() / "index")
    got = index.matches(index.open_or_build(active, path), query, types)
    assert {(r.id, r.bm25) for r in got.collect()} == {(r.id, r.bm25) for r in search.matches(active, query, types).select("id", "bm25").collect()}


def test_rebuilt_only_when_content_changes(spark, active, tmp_path):
    path = str(tmp_path / "i")
    first = index.open_or_build(active, path)
    assert index.open_or_build(active.orderBy(F.rand()), path).fingerprint == first.fingerprint
    fewer = active.where("type = 'fact'")
    again = index.open_or_build(fewer, path)
    assert again.fingerprint != first.fingerprint and again.records == fewer.count()


def test_empty(spark, active, tmp_path):
    none = index.build(active.limit(0), str(tmp_path / "e"))
    assert index.matches(none, "router").count() == 0


def test_terms_reach_the_scan(spark, active, tmp_path):
    plan = index.matches(index.build(active, str(tmp_path / "p")), "router")._jdf.queryExecution().toString()
    assert "PushedFilters" in plan and "StringStartsWith(term,router)" in plan


@pytest.mark.parametrize("stem", [True, False])
def test_stemmed_or_as_written(spark, active, tmp_path, stem):
    path = str(tmp_path / "i")
    index.open_or_build(active, path, stem=not stem)
    got = index.matches(index.open_or_build(active, path, stem=stem), "records superseding", stage="or")
    want = search.matches(active, "records superseding", stage="or", stem=stem)
    assert {(r.id, r.bm25) for r in got.collect()} == {(r.id, r.bm25) for r in want.collect()}
    rows = active.selectExpr("id", "lower(concat_ws(' ', title, array_join(tags, ' '), body)) AS t")
    assert got.count() > rows.where(r"t rlike '\\b(records|superseding)\\b'").count() or not stem


def test_a_named_version_is_opened_without_reading_the_records(spark, active, tmp_path):
    path = str(tmp_path / "v")
    first = index.open_or_build(active, path, version="1")
    unread = active.withColumn("body", F.raise_error(F.lit("read")).cast("string"))
    assert index.open_or_build(unread, path, version="1").fingerprint == first.fingerprint
    assert index.open_or_build(active.where("type = 'fact'"), path, version="2").records < first.records
