import json

from recordloom.operators import schema_drift as sd


def lines(spark, files):
    rows = [(stream, seq, json.dumps(r) if isinstance(r, dict) else r, 1) for (stream, seq), recs in files.items() for r in recs]
    return spark.createDataFrame(rows, "stream string, file_seq int, raw string, id int")


def ids(n):
    return [f"ms_{i:026d}" for i in range(n)]


def found(spark, files):
    changes, fields = sd.drift(lines(spark, files))
    return {tuple(r) for r in changes.collect()}, changes, fields


def test_renames_types_and_plain_changes(spark):
    i = ids(6)
    a = [{"id": x, "check_by": "2024-01-02T03:04:05.678Z", "state": s, "conf": c, "owner": f"team-{k % 3}", "n": k} for k, (x, s, c) in enumerate(zip(i, ["active", "retired"] * 3, [0.5, 0.25, 0.7, 0.1, 0.33, 0.9], strict=True))]
    b = [{"id": r["id"], "review_at": {"at": r["check_by"], "policy": "ttl"}, "status": {"active": 1, "retired": 2}[r["state"]], "ext": {"conf": round(r["conf"] * 100)}, "locale": "en" if k % 4 else "fr", "n": str(r["n"])} for k, r in enumerate(a)]
    got, changes, fields = found(spark, {("s", 1): a, ("s", 3): [*b, '{"id": "broken', "", None]})
    assert got == {
        ("s", 3, "renamed", "check_by", "review_at"), ("s", 3, "retyped", "check_by", "review_at"), ("s", 3, "renamed", "state", "status"), ("s", 3, "retyped", "state", "status"),
        ("s", 3, "renamed", "conf", "ext.conf"), ("s", 3, "retyped", "conf", "ext.conf"), ("s", 3, "removed", "owner", ""), ("s", 3, "added", "", "locale"), ("s", 3, "retyped", "n", "n"),
    }
    names = {r.field: r.canonical for r in sd.canonical_names(changes).collect()}
    assert names["review_at"] == names["check_by"] == "check_by"
    rows = sd.unify(fields, changes).collect()
    assert len(rows) == 12 and {"check_by", "state", "conf"} <= set(rows[0].header)


def test_nulls_repeats_and_unrelated_streams(spark):
    i = ids(3)
    a = [{"id": x, "v": k, "gone": None} for k, x in enumerate(i)]
    got, _, _ = found(spark, {("s", 1): a + a, ("s", 2): [{"id": x, "v": k} for k, x in enumerate(i)], ("t", 5): [{"id": i[0], "w": 1}], (None, 1): a})
    assert got == set()


def test_empty_and_unreadable(spark):
    assert found(spark, {})[0] == set()
    assert found(
        spark, {("s", 1): [{"id": ids(1)[0], "v": 1}], ("s", 2): ["[1, 2]", "nonsense"]},
    )[0] == {("s", 2, "removed", "v", ""), ("s", 2, "removed", "id", "")}


def test_leaves_and_assignment():
    assert sd.leaves("0.70") == sd.leaves(0.7) == ["n0.7"] and sd.leaves(70) == sd.leaves("70.0") == ["n70"]
    assert sd.leaves("2024-04-21T23:24:04.974Z") == sd.leaves(1713741844974)
    assert set(sd.leaves({"src/a.ts": "abc"})) == set(sd.leaves([{"file": "src/a.ts", "sha": "abc"}])) == set(sd.leaves("src/a.ts@abc"))
    assert sd.assignment([[5, 4], [4, 0]]) == [(0, 1), (1, 0)]
    assert sd.assignment([[0, 0], [0, 3], [2, 0]]) == [(1, 1), (2, 0)]
    assert sd.assignment([]) == []


def test_sparse_fields_of_large_files_are_still_renamed(spark):
    i = ids(400)
    a = [{"id": x, "n": k} | ({"rare": f"w{k}"} if k % 100 == 7 else {}) | {"big": f"b{k}"} for k, x in enumerate(i)]
    b = [{"id": x, "n": k} | ({"seldom": [f"w{k}"]} if k % 100 == 7 else {}) | {"large": f"b{k}"} for k, x in enumerate(i)]
    # Only four records are in both of these files.
    c = [{"id": x, "key": k} for k, x in enumerate(i[:202])]
    d = [{"id": x, "code": k} for k, x in enumerate(i) if k >= 198]
    changes, _ = sd.drift(lines(spark, {("s", 1): a, ("s", 2): b, ("t", 1): c, ("t", 2): d}), 10)
    assert {tuple(r) for r in changes.collect()} == {
        ("s", 2, "renamed", "rare", "seldom"), ("s", 2, "retyped", "rare", "seldom"), ("s", 2, "renamed", "big", "large"), ("t", 2, "renamed", "key", "code"),
    }


def test_lines_may_end_in_any_white_space(spark):
    i = ids(3)
    files = {("s", k): [json.dumps({"id": x, "v": n}) + end for n, x in enumerate(i)] for k, end in enumerate(("", "\r", "\t", " \r\n"), 1)}
    assert found(spark, files)[0] == set()


def test_unrelated_columns_are_no_rename(spark):
    """Flags that agree by chance, and numbers that only share their digits."""
    i = ids(9)
    flags = {("s", 1): [{"id": x, "archived": False} for x in i], ("s", 2): [{"id": x, "public": False} for x in i]}
    assert found(spark, flags)[0] == {("s", 2, "removed", "archived", ""), ("s", 2, "added", "", "public")}
    numbers = {("s", 1): [{"id": x, "retries": k + 1} for k, x in enumerate(i)], ("s", 2): [{"id": x, "timeout_ms": (k + 1) * 1000} for k, x in enumerate(i)]}
    assert found(spark, numbers)[0] == {("s", 2, "removed", "retries", ""), ("s", 2, "added", "", "timeout_ms")}
    one = {("s", 1): [{"id": i[0], "w": "one"}], ("s", 2): [{"id": i[0], "fresh": "one"}]}
    assert found(spark, one)[0] == {("s", 2, "removed", "w", ""), ("s", 2, "added", "", "fresh")}


def test_constant_columns():
    same = lambda a, b, n: sd.evidence([(sd.leaves(a), sd.leaves(b))] * n)
    assert sd.believable(same("active", "active", 6), 0.1, False) and not sd.believable(same("active", "active", 3), 0.1, False)
    assert sd.believable(same("active", 1, 6), 0.1, True) and not sd.believable(same("active", 1, 6), 0.1, False)
    assert sd.believable(same(False, False, 2), 0.7, False) and not sd.believable(same(False, False, 500), 0.2, True)
    tags = [(["a"], ["a", "b", "c"])] * 9
    assert sd.evidence(tags).share == 0


def test_one_factor_for_all_records():
    share = [(sd.leaves(x), sd.leaves(round(x * 100))) for x in (0.7, 0.07, 0.5, 1.0, 0.25)]
    assert sd.agreement(share) == 1.0
    mixed = [(sd.leaves(a), sd.leaves(b)) for a, b in ((0.7, 7), (0.5, 500), (0.2, 20), (0.3, 3), (0.9, 9000))]
    assert sd.agreement(mixed) < 0.5
