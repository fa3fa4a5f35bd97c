from datetime import datetime

from recordloom.operators import orphans


def frame(spark, rows):
    return spark.createDataFrame(rows, "ref_table string, id string, field string, target_id string, first_load timestamp_ntz, deleted string")


def loads(spark, rows):
    return spark.createDataFrame(rows, "id string, first_load timestamp_ntz")


D = [datetime(2024, 1, d) for d in range(1, 10)]


def test_reasons(spark):
    refs = frame(
        spark,
        [
            ("m", "a", "refines", "b", D[0], "x"), ("m", "a", "refines", "gone", D[0], "x"), ("m", "a", "refines", "never", D[0], None),
            ("m", "a", "superseded_by", "b", D[0], "x"), ("m", "b", "refines", "a", D[1], "x"), ("m", "a", "refines", None, D[0], "x"),
        ],
    )
    state = orphans.fold(
        orphans.reference_deltas(refs), orphans.existence_deltas(loads(spark, [("a", D[0]), ("b", D[1])])),
        orphans.removal_deltas(spark.createDataFrame([("gone",), (None,), ("b",)], "id string")),
    )
    got = {(r.id, r.field, r.target_id, r.reason, r.period) for r in orphans.report(refs, state, ("superseded_by",)).collect()}
    assert got == {("a", "refines", "b", "late", "2024-01"), ("a", "refines", "gone", "deleted", "2024-01"), ("a", "refines", "never", "missing", "2024-01")}
    assert {(r.key, r.reason) for r in orphans.orphan_keys(state).collect()} == {("gone", "deleted"), ("never", "missing")}


def test_states_take_later_deltas(spark):
    refs = frame(spark, [("m", "a", "refines", "b", D[0], "")])
    first = orphans.fold(orphans.reference_deltas(refs), orphans.existence_deltas(loads(spark, [("a", D[0])])))
    assert [r.key for r in orphans.orphan_keys(first).collect()] == ["b"]
    second = orphans.fold(first, orphans.existence_deltas(loads(spark, [("b", D[1])])))
    assert orphans.orphan_keys(second).count() == 0
    third = orphans.fold(second, orphans.existence_deltas(loads(spark, [("b", D[1])]), -1))
    assert [r.key for r in orphans.orphan_keys(third).collect()] == ["b"]
    assert orphans.orphan_keys(orphans.fold(third, orphans.reference_deltas(refs, -1))).count() == 0


def test_empty(spark):
    refs = frame(spark, [])
    state = orphans.fold(orphans.reference_deltas(refs))
    assert orphans.report(refs, state).count() == 0


def test_a_record_that_goes_and_comes_back_counts_from_its_return(spark):
    from datetime import datetime

    load = lambda month: spark.createDataFrame([("t", datetime(2024, month, 1))], "id string, first_load timestamp_ntz")
    refs = spark.createDataFrame(
        [("m", "a", "refines", "t", datetime(2024, 2, 1))],
        "ref_table string, id string, field string, target_id string, first_load timestamp_ntz",
    )
    state = orphans.fold(orphans.reference_deltas(refs), orphans.existence_deltas(load(1)))
    assert orphans.report(refs, state).count() == 0
    gone = orphans.fold(state, orphans.existence_deltas(load(1), -1))
    assert [r.reason for r in orphans.report(refs, gone).collect()] == ["missing"]
    back = orphans.fold(gone, orphans.existence_deltas(load(3)))
    assert [r.reason for r in orphans.report(refs, back).collect()] == ["late"]
    assert orphans.fold(back, orphans.reference_deltas(refs, -1), orphans.existence_deltas(load(3), -1)).count() == 0
