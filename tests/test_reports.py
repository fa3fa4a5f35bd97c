import random
from datetime import datetime

from pyspark.sql import functions as F

from recordloom.functions import records as R
from recordloom.functions import text as X
from recordloom.operators import reports, writes

NOW_TEXT = "2024-06-01 00:00:00"


def now():
    return F.lit(NOW_TEXT).cast("timestamp_ntz")


SCHEMA = (
    "id string, kind string, type string, state string, created timestamp_ntz, last_verified timestamp_ntz, source string, source_kind string, tags array<string>, check_by string, stale boolean, pinned boolean, "
    "verified_with string, anchors array<struct<file:string,sha:string,repo:string>>, supersedes array<string>, superseded_by string, supersede_reason string, conflicts_with array<string>, title string, body string, file_path string, valid_from timestamp_ntz, valid_to timestamp_ntz, ext string"
)
NAMES = [c.split(" ")[0] for c in SCHEMA.replace("file:string,sha:string,repo:string", "x").split(", ")]


def records(spark, *rows):
    base = dict.fromkeys(NAMES) | {
        "kind": "claim", "type": "fact", "state": "active", "created": datetime(2024, 1, 1), "source": "agent-x", "title": "", "body": "",
        "check_by": "never",
    }
    return spark.createDataFrame([tuple((base | r)[n] for n in NAMES) for r in rows], SCHEMA)


def fold(sections, tokens, limit, used, skip):
    out, total = [], 0
    for i, (items, cap) in enumerate(sections):
        n, closed = 0, False
        for pos, cost in items if skip else items[: min(cap, limit)]:
            take = not closed and n < cap and total < limit and not (used + cost > tokens and total > 0)
            if take:
                n, total, used = n + 1, total + 1, used + cost
            elif not skip:
                closed = True
            out.append((i, pos, take))
    return out


def test_budget_is_the_greedy_fold(spark):
    rng = random.Random(1)
    for trial in range(6):
        sections = [([(p, rng.randint(1, 40)) for p in range(rng.randint(1, 8))], rng.randint(1, 6)) for _ in range(3)]
        skip = trial % 2 == 1
        frames = [(spark.createDataFrame([(f"i{p}", p, c) for p, c in items], "id string, pos int, cost int"), cap) for items, cap in sections]
        got = reports.budget(frames, 90, 10, 5, skip)
        assert [(r.section, r.pos, r.taken) for r in got.orderBy("section", "pos").collect()] == fold(sections, 90, 10, 5, skip)


def test_staleness_validity_and_witness(spark):
    df = records(
        spark, {"id": "a", "check_by": "2024-05-31T23:59:59.999Z"}, {"id": "b", "check_by": "2024-06-01T00:00:00.000Z"}, {"id": "c", "check_by": "soon"}, {
            "id": "d", "kind": "observation", "type": None, "check_by": "2024-01-01T00:00:00.000Z",
        },
        {"id": "e", "stale": True}, {"id": "f", "check_by": None},
    )
    assert {r.id for r in df.where(R.lazy_stale(now())).collect()} == {"a", "e"}
    at = datetime(2024, 6, 1)
    v = records(
        spark, {"id": "in", "valid_from": at, "valid_to": at}, {"id": "open"}, {"id": "late", "valid_from": datetime(2024, 6, 2)},
        {"id": "past", "valid_to": datetime(2024, 5, 1)},
    )
    assert {r.id for r in v.where(R.valid_as_of(now())).collect()} == {"in", "open"}


def test_pins_attention_and_context(spark):
    rows = [{"id": f"p{i}", "pinned": True, "last_verified": datetime(2024, 2, 1 + i)} for i in range(7)] + [
        {"id": "s1", "check_by": "2024-05-01T00:00:00.000Z"}, {"id": "s2", "check_by": "2024-03-01T00:00:00.000Z"}, {"id": "dr"},
        {"id": "s3", "stale": True},
    ]
    df = records(spark, *rows)
    assert [r.id for r in reports.pinned(df).collect()] == ["p6", "p5", "p4", "p3", "p2"]
    drifted = spark.createDataFrame([("dr", 1, "anchor drift: x")], "id string, files int, note string")
    order = [r.id for r in reports.attention(df, drifted, now()).orderBy(F.desc("is_drift"), F.desc("overdue"), "id").collect()]
    assert order == ["dr", "s2", "s1", "s3"]
    uses = spark.createDataFrame([("p0", 9)], "id string, uses long")
    boot = reports.context(df, uses, drifted, now(), 2000).collect()
    by = {s: [r.id for r in sorted(boot, key=lambda r: r.pos) if r.section == s and r.taken] for s in range(3)}
    assert by[0] == ["dr", "s2", "s1"] and by[1] == ["p6", "p5", "p4", "p3", "p2"] and by[2][0] == "p0" and "s3" in by[2]
    assert sum(r.taken for r in reports.context(df, uses, drifted, now(), 30).collect()) < len(rows)


def test_drift(spark):
    df = records(
        spark, {"id": "a", "anchors": [("x", "1", None), ("y", "2", None), ("z", "3", "far"), ("x", "1", None), (None, "1", None)]},
        {"id": "b", "anchors": []}, {"id": "c"},
    )
    files = spark.createDataFrame([("", "x", "1"), ("far", "z", "3")], "repo string, file string, current_sha string")
    repos = spark.createDataFrame([("near",)], "repo string")
    got = {r.file: r.status for r in reports.anchor_drift(reports.anchors_view(df), files, repos).collect()}
    assert got == {"x": "unchanged", "y": "missing", "z": "repo_unavailable"}
    assert reports.drift_agg(reports.anchor_drift(reports.anchors_view(df), files)).first().note == "anchor drift: y"


def test_conflicts(spark):
    df = records(
        spark, {
            "id": "a", "title": "Router cache expires early", "tags": ["x", "y"],
        }, {"id": "b", "title": "Early router expires", "tags": ["y"]}, {"id": "c", "title": "Early router expires", "tags": ["z"]},
        {"id": "d", "title": "Early router expires", "tags": ["y"], "type": "decision"}, {
            "id": "e", "title": None, "tags": None, "conflicts_with": ["a", "q", None, ""],
        },
    )
    members, classes = reports.conflict_classes(df)
    assert {(r.id_a, r.id_b, r.shared_tokens, r.shared_tags) for r in reports.conflict_pairs(classes).collect()} == {("a", "b", 3, 1)}
    assert {(r.id, r.class_id) for r in members.collect()} == {(x, x) for x in "abcde"}
    assert {(r.id_a, r.id_b, r.title_b) for r in reports.declared_conflicts(df).collect()} == {
        ("a", "e", "(not in active set)"), ("e", "q", "(not in active set)"),
    }
    assert {(r.id, r.class_id, r.members) for r in reports.title_buckets(df).collect()} == {("b", "b", 2), ("c", "b", 2)}
    # A stock title is one class, however many records have it.
    many = records(
        spark, *[{"id": f"s{i:03d}", "title": "Weekly status report", "tags": ["x", "x", None]} for i in range(200)],
        {"id": "z", "title": "Status report weekly late", "tags": ["x"]},
    )
    members, classes = reports.conflict_classes(many)
    assert {(r.id_a, r.id_b, r.shared_tokens, r.shared_tags) for r in reports.conflict_pairs(classes).collect()} == {("s000", "s000", 3, 1), ("s000", "z", 3, 1)}
    assert members.where("class_id = 's000'").count() == 200


def test_remember_refuses_and_links(spark):
    live = records(
        spark, {"id": "a", "title": "Router cache expires early", "tags": ["x"]},
        {"id": "k", "title": "Token rotation happens weekly", "tags": ["x"], "source": "human:y"},
    )
    new = spark.createDataFrame(
        [
            ("1", "fact", " router  CACHE expires early", ["x"], "agent-x", None),
            ("2", "fact", "Router cache lives long", ["x"], "agent-x", None), ("3", "fact", "Router cache lives long", [], "agent-x", None),
            ("4", "fact", "New", [], " Unknown ", None), ("5", "fact", "Token rotation slow", ["x"], "agent-x", None),
            ("6", "decision", None, None, "human:z", None),
        ],
        "id string, type string, title string, tags array<string>, source string, source_kind string",
    )
    rejected, accepted = writes.remember(new, live)
    assert {(r.id, r.reason) for r in rejected.collect()} == {("1", "duplicate"), ("3", "duplicate in batch"), ("4", "source")}
    assert {(r.id, r.conflicts_with_id) for r in accepted.collect()} == {("2", "a"), ("5", None), ("6", None)}


def test_supersede_relate_and_verify(spark):
    df = records(spark, {"id": "a", "tags": ["t"]}, {"id": "b", "source": "human:x"}, {"id": "c", "state": "retired"}, {"id": "d", "supersedes": ["z"]})
    ask = spark.createDataFrame(
        [(i, f"n{i}", "body", "why", i == "b", "agent-y") for i in "abcq"],
        "id string, new_id string, body string, reason string, override boolean, source string",
    )
    got = {r.id: r for r in writes.supersede_replace(df, ask, now()).collect()}
    assert got["a"].state == "superseded" and got["a"].superseded_by == "na" and got["na"].supersedes == ["a"] and got["na"].tags == ["t"]
    assert got["b"].supersede_reason.endswith(writes.OVERRIDE_NOTE) and got["nb"].supersede_reason == "why" and "nc" not in got and "nq" not in got
    merge = spark.createDataFrame(
        [("a", "d", "m", False), ("b", "d", "m", False), ("d", "d", "m", False), ("a", "c", "m", False)],
        "id string, into string, reason string, override boolean",
    )
    got = {r.id: r for r in writes.supersede_merge(df, merge).collect()}
    assert got["d"].supersedes == ["z", "a"] and got["a"].superseded_by == "d" and got["b"].state == "active"
    got = {r.id: r for r in writes.supersede_retract(df, ask).collect()}
    assert got["a"].state == "superseded" and got["a"].superseded_by is None
    changed, refused = writes.relate(df, spark.createDataFrame([("a", "b"), ("a", "b"), ("a", "a"), ("a", "q")], "id string, target string"), "conflicts_with")
    assert changed.first().conflicts_with == ["b"] and {(r.id, r.target) for r in refused.collect()} >= {("a", "a"), ("a", "q")}
    drift = spark.createDataFrame([("a", "changed"), ("d", "unchanged")], "id string, status string")
    asked = spark.createDataFrame([("a", None, "x"), ("b", "saw it", "human:x"), ("d", None, "x")], "id string, evidence string, source string")
    assert {r.id: (r.status, r.verified_with) for r in writes.verify(df, drift, asked, now()).collect()} == {
        "a": ("needs_review", "assertion"), "b": ("verified_inferred", "operator"), "d": ("verified", "anchor"),
    }


def test_observe_and_scalars(spark):
    df = spark.createDataFrame(
        [("  First\nsecond ", "2h", None), ("x" * 300, "never", "me"), ("  ", None, None), ("y", "bad", None), (None, None, None)],
        "text string, ttl string, source string",
    )
    got = writes.observe(df, now()).collect()
    assert [(r.title, r.expires, r.source) for r in got] == [("First", datetime(2024, 6, 1, 2), "agent"), ("x" * 120, None, "me")]
    one = spark.range(1)
    pick = lambda c: one.select(c.alias("c")).first().c
    assert pick(R.blob_sha(F.lit("hello"))) == "b6fc4c620b67d95f953a5c1c1230aaab5db5a1b0"
    assert pick(X.redact(F.lit("API  key"), F.lit("v"))) == pick(X.redact(F.lit("k"), F.lit("my Token"))) == "[REDACTED]"
    assert pick(X.parse_tags(F.lit(" a, b ,,c"))) == ["a", "b", "c"]
    assert pick(X.sanitize_tag(F.lit("--A b!C-"))) == "a-b-c"
    assert pick(X.truncate_body(F.lit("# h\n" + "word " * 60))).endswith("…")
    assert pick(R.canonical_source(F.lit("writer-2026-05-29"))) == "writer"
    assert pick(R.canonical_source(F.lit("2026-05-29"))) == "2026-05-29"


def test_empty_records(spark):
    df = records(spark, {"id": "x"}).limit(0)
    for out in (
        reports.conflict_pairs(reports.conflict_classes(df)[1]), reports.title_buckets(df), reports.declared_conflicts(df),
        reports.validate(df), writes.sweep(df, now()),
    ):
        assert out.count() == 0
