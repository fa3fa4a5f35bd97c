from datetime import datetime

from pyspark.sql import functions as F

from recordloom.operators import exports, migrate
from recordloom.sources import config, imports, layers, markdown
from recordloom.streaming import usage


def files(spark, rows):
    return spark.createDataFrame(rows, "path string, content string")


ONE = "ms_" + "1".rjust(26, "0")
NOTES = """# Memory

## Quick Facts
| Entity | Key | Value |
|---|---|---|
| Server | port | 8080 |
| Vault | api key | abc |
| Only | two |
|  |  |  |

## Decisions
| Date | Decision | Rationale |
|---|---|---|
| 2024-01-02 | Use it | because |
| soon | Do it | |

## Lessons
| What | Why |
|---|---|
| Test first | bugs |
"""


def test_tables(spark):
    df = files(spark, [("m.md", NOTES), ("e.md", ""), ("n.md", None), ("x.md", "## Quick Facts\nno table")])
    assert [(r.title, r.body, r.tags) for r in imports.facts(df).collect()] == [
        ("Server port", "8080", ["server", "port"]), ("Vault api key", "[REDACTED]", ["vault", "api-key"]),
        ("Only", "two", ["only", "fact"]),
    ]
    assert [(r.title, r.body, r.created) for r in imports.decisions(df, "2024-06-01").collect()] == [
        ("Use it", "because", datetime(2024, 1, 2)), ("Do it", "Do it", datetime(2024, 6, 1)),
    ]
    assert [r.body for r in imports.lessons(df).collect()] == ["Test first — bugs"]


def test_bullets_and_loose_files(spark):
    text = "- 🔹 09:30 Saw it <!-- dc:type=decision dc:importance=0.8 dc:date=2024-02-03 -->\n- plain\n- Ran <!-- dc:type=mood dc:importance=1 dc:date=2024-02-04 -->"
    got = imports.observations(files(spark, [("o", text), ("n", None)])).collect()
    assert [(r.type, r.title, r.importance, r.raw_type) for r in got] == [("decision", "Saw it", 0.8, "decision"), ("fact", "Ran", 1.0, "mood")]
    df = files(
        spark,
        [
            ("m/2024-01-02.md", "x"), ("m/README.md", "x"), ("m/procedures/p.md", "# How\nstep"), ("m/my-decision.md", "text"),
            ("m/f.md", "---\ntype: decision\n---\n# T\nb"), ("m/g.md", "plain"), ("m/a.txt", "x"),
        ],
    )
    assert {(r.path, r.type, r.title) for r in imports.loose_files(df).collect()} == {
        ("m/procedures/p.md", "procedure", "How"), ("m/my-decision.md", "decision", "my-decision"), ("m/f.md", "decision", "T"),
        ("m/g.md", "fact", "g"),
    }
    assert {(r.path, r.form) for r in imports.detect_sources(files(spark, [("MEMORY.md", NOTES), ("observations.md", ""), ("z.bin", "")])).collect()} == {
        ("MEMORY.md", "tables"), ("observations.md", "observations"),
    }


def test_markdown_round_trip_and_scan(spark, tmp_path):
    rows = [(
        ONE, "claim", "fact", "active", datetime(2024, 1, 2, 3, 4, 5, 678000), "a: \"b\"", ["x", "y, z"], "never", True,
        [("f.py", "12", None)], None, '{"k": {"n": 1}}', "Title", "Body\nline", "memory/facts/ms_1.md",
    )]
    schema = "id string, kind string, type string, state string, created timestamp_ntz, source string, tags array<string>, check_by string, pinned boolean, anchors array<struct<file:string,sha:string,repo:string>>, superseded_by string, ext string, title string, body string, file_path string"
    df = spark.createDataFrame(rows, schema)
    markdown.write_store(df, str(tmp_path))
    (tmp_path / "memory" / "operator" / "facts").mkdir(parents=True)
    (tmp_path / "memory" / "operator" / "facts" / "bad.md").write_text("no header")
    (tmp_path / "memory" / "facts" / "dates.md").write_text("---\nid: ms_2\ncreated: 2024-01-02\nsupersedes: ms_9\ntags: [a, null]\n---\n## Sub\n# Real title\ntext")
    (tmp_path / "memory" / "note.txt").write_text("ignored")
    got = {r.id: r for r in markdown.scan_records(spark, str(tmp_path)).collect()}
    one = got[ONE]
    assert (one.created, one.source, one.tags, one.pinned, one.title, one.body, one.error) == (
        "2024-01-02T03:04:05.678Z", 'a: "b"', ["x", "y, z"], True, "Title", "# Title\n\nBody\nline", None,
    )
    assert one.anchors[0].file == "f.py" and one.ext == '{"k": {"n": 1}}' and one.superseded_by is None and one.area == "memory"
    two = got["ms_2"]
    assert (two.created, two.supersedes, two.tags, two.title) == ("2024-01-02T00:00:00.000Z", ["ms_9"], ["a"], "Real title")
    assert got[None].error and got[None].is_operator
    assert markdown.recent_files(spark, str(tmp_path), F.lit("2000-01-01").cast("timestamp")).count() == 3
    again = markdown.parse_frontmatter(files(spark, [("p", None), ("q", "---\n: [\n---\n")])).collect()
    assert all(r.error for r in again)


def test_usage_log(spark, tmp_path):
    path = str(tmp_path / "log")
    imports.append_usage(spark.createDataFrame([("a",), ("b",)], "id string"), path, F.lit("2024-01-02 03:04:05").cast("timestamp_ntz"))
    (tmp_path / "log" / "more.json").write_text('{"id": "c", "retrieved_at": "2024-01-03T00:00:00.000Z"}\nnot json\n{"id": null}\n')
    assert {(r.id, r.retrieved_at) for r in imports.usage_log(spark, path).collect()} == {
        ("a", datetime(2024, 1, 2, 3, 4, 5)), ("b", datetime(2024, 1, 2, 3, 4, 5)), ("c", datetime(2024, 1, 3)),
    }


def test_layers(spark):
    rows = spark.createDataFrame(
        [
            ("a", "low", "memory/facts/a.md", "memory_records", datetime(2024, 1, 1)),
            ("a", "high", "memory/operator/facts/a.md", "memory_records", datetime(2024, 1, 2)),
            ("b", "none", None, "archive_records", datetime(2024, 1, 1)), (None, "low", "x", "memory_records", None),
        ],
        "id string, layer string, file_path string, ref_table string, loaded_at timestamp_ntz",
    )
    table = spark.createDataFrame(
        [("low", "/l", 0, True), ("high", "/h", 9, False), ("idle", "/i", 1, None)],
        "name string, path string, priority int, writable boolean",
    )
    assert {(r.id, r.layer) for r in layers.layered(rows, table).collect()} == {("a", "high"), ("b", "none")}
    assert {(r.id, r.file_path) for r in layers.resolve_collisions(rows).collect()} == {("a", "memory/operator/facts/a.md"), ("b", None)}
    assert {(r.name, r["items"], r["mode"]) for r in layers.listing(rows, table).collect()} == {("low", 1, "rw"), ("high", 1, "ro"), ("idle", 0, "ro")}


def test_config():
    s = config.load("decay: {fact: 30d, decision: soon}\nprofiles: {default: {ranking: {recency: 0.9}}}")
    assert s.decay_days["fact"] == 30 and s.decay_days["decision"] == 180 and s.recency == 0.9
    assert config.load("::: [") == config.load(None) == config.load("[1]")


def test_migration_is_idempotent(spark):
    from tests.test_reports import records

    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    old = records(
        spark, {"id": "a", "kind": None, "state": "captured", "check_by": None, "file_path": "memory/facts/a.md"},
        {"id": "b", "state": "corrected", "superseded_by": "a", "source": "human:x", "file_path": "memory/facts/b.md"},
    )
    old = old.withColumns({"decay_after": F.lit("2024-01-01T00:00:00.000Z"), "confidence": F.lit(0.5)}).drop("code_anchors")
    old = old.withColumns({"corrects": F.array(F.lit("b")), "refines": F.array().cast("array<string>")})
    first = {r.id: r for r in migrate.plan(old, now).collect()}
    assert first["a"].state == "active" and first["a"].stale and first["a"].supersedes == ["b"] and first["a"].check_by.startswith("2024-01-01")
    assert first["b"].supersede_reason == migrate.NO_REASON and first["b"].target_path == "archive/b.md"
    moved = migrate.plan(old, now).withColumn("file_path", F.col("target_path")).drop("was_path", "changes", "target_path")
    assert all(not r.changes for r in migrate.plan(moved, now).collect())


def test_export_forms_hold_the_same_nodes(spark):
    from tests.test_reports import records

    df = records(
        spark, {"id": "a", "title": 'q"<&>\\\n', "anchors": [("f", "1", None)]},
        {"id": "b", "anchors": [("f", "2", None)], "conflicts_with": ["a", "a", "zz"]}, {"id": "o", "kind": "observation", "type": None},
    )
    df = df.withColumns({c: F.lit(None).cast("array<string>") for c in ("refines", "supports", "depends_on")})
    chosen = exports.projected(df)
    n, e = exports.nodes(chosen), exports.edges(chosen)
    assert n.count() == 3 and e.count() == 3
    keys = [{r.key for r in f(n, e).where("kind = 'node'").collect()} for f in (exports.jsonl, exports.graphml, exports.dot)]
    assert keys[0] == keys[1] == keys[2] == {"a", "b", "file:f"}
    import xml.dom.minidom

    text = "\n".join(r.value for r in exports.document(exports.graphml(n, e), "graphml").collect())
    assert len(xml.dom.minidom.parseString(text).getElementsByTagName("edge")) == 3
    assert [r.value for r in exports.document(exports.dot(n, e), "dot").collect()][-1] == "}"


def test_streams(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame(
        [("a", datetime(2024, 1, 1, 10)), ("a", datetime(2024, 1, 1, 12)), ("b", datetime(2024, 1, 2)), (None, datetime(2024, 1, 2))],
        "id string, retrieved_at timestamp_ntz",
    ).write.parquet(str(src))
    stream = spark.readStream.schema("id string, retrieved_at timestamp_ntz").parquet(str(src))
    q = usage.sliding_counts(stream, "2 days", "1 day").writeStream.format("memory").queryName("counts").outputMode("complete").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r.id, r.uses) for r in spark.table("counts").collect()} == {("a", 2), ("b", 1)}


def test_every_record_is_written_and_scanned(spark, sf):
    from recordloom.plans import records

    got = {r.id: r for r in records.scan_records(spark, sf).collect()}
    want = {r.id: r for r in records._records(spark, sf).select("id", "ref_table", "state", "file_path", "check_by").collect()}
    assert got.keys() == want.keys() and {r.ref_table for r in want.values()} == {"memory_records", "archive_records"}
    for i, r in want.items():
        # Without a check-by date a header is not a record's.
        assert got[i].error == ("check_by: no date" if r.check_by is None else None) and got[i].state == r.state
        assert got[i].area == next((a for a in r.file_path.split("/") if a in ("memory", "observations", "archive")), "")
        assert got[i].is_operator == ("/memory/operator/" in "/" + r.file_path)
    assert len({r.area for r in got.values()}) > 1 and any(r.is_operator for r in got.values())


def head(**fields):
    base = {"id": "ms_" + "X" * 26, "type": "fact", "state": "active", "created": "2024-05-01T00:00:00Z", "source": "agent-x", "check_by": "never"} | fields
    import json

    return "---\n" + "\n".join(f"{k}: {json.dumps(v)}" for k, v in base.items() if v is not None) + "\n---\n# T\nb\n"


def test_headers_that_are_no_records_are_reported(spark):
    bad = {
        "id": ("x", "bad form"), "type": ("idea", "unknown"), "state": ("odd", "unknown"), "created": ("notadate", "missing"), "source": ("", "empty"), "tags": ("solo", "no list of texts"), "check_by": ("soon", "no date"),
        "stale": ("maybe", "no flag"), "anchors": ([{"file": "a"}], "bad form"), "expires": ("later", "no date"), "last_verified": (7, "no date"), "valid_from": ("x", "no date"), "refines": ([1], "no list of texts"),
        "superseded_by": (["a"], "no text"), "ext": ("x", "no object"), "source_kind": ("boss", "unknown"), "verified_with": ("luck", "unknown"), "kind": ("rumour", "unknown"), "pinned": ("yes please", "no flag"),
    }
    rows = [(k, head(**{k: v})) for k, (v, _) in bad.items()] + [
        ("good", head(stale=True, tags=["a"], anchors=[{"file": "a", "sha": "1"}])), ("untyped", head(type=None)),
        ("seen", head(kind="observation", type=None)), ("all", head(id="bad", type="nope", state="odd", created="notadate")),
    ]
    got = {r.path: r.error for r in markdown.parse_frontmatter(files(spark, rows)).collect()}
    assert {k: got[k] for k in bad} == {k: f"{k}: {what}" for k, (_, what) in bad.items()}
    assert got["good"] is None and got["seen"] is None and got["untyped"] == "type: required for claims"
    assert got["all"] == "id: bad form; state: unknown; created: missing; type: unknown"


OLDER = {
    "a": dict(
        state="captured", decay_after="2024-01-01T00:00:00.000Z", check_by=None,
        ext={"code_anchors": [{"file": "f.ts", "sha": "1"}], "k": 1}, confidence=0.7,
    ),
    "b": dict(state="corrected", corrected_by="ms_" + "Y" * 26, correction_reason="wrong"), "c": dict(
        corrects="ms_" + "Z" * 26, source="human:me", decay_after="never", check_by=None,
    ), "d": dict(check_by="2024-01-01T00:00:00Z"),
}


def test_older_headers_load_in_todays_shape(spark):
    got = {r.path: r for r in markdown.parse_frontmatter(files(spark, [(k, head(**v)) for k, v in OLDER.items()])).collect()}
    assert all(r.error is None and r.kind == "claim" for r in got.values())
    a, b, c = got["a"], got["b"], got["c"]
    assert (a.state, a.check_by, a.anchors[0].file) == ("active", "2024-01-01T00:00:00.000Z", "f.ts") and '"legacy_confidence": 0.7' in a.ext
    assert (b.state, b.superseded_by, b.supersede_reason, c.supersedes, c.check_by) == ("superseded", "ms_" + "Y" * 26, "wrong", ["ms_" + "Z" * 26], "never")
    raw = {r.path: r for r in markdown.parse_frontmatter(files(spark, [("a", head(**OLDER["a"]))]), legacy=True).collect()}["a"]
    assert (
        raw.state, raw.check_by, raw.decay_after, raw.confidence, raw.anchors, raw.code_anchors[0].sha, raw.kind,
    ) == ("captured", None, "2024-01-01T00:00:00.000Z", 0.7, None, "1", None)


def test_a_store_is_migrated_once(spark, tmp_path):
    (tmp_path / "memory" / "facts").mkdir(parents=True)
    for k, v in OLDER.items():
        (tmp_path / "memory" / "facts" / f"{k}.md").write_text(head(**(v | {"id": "ms_" + k.upper() * 26})))
    (tmp_path / "memory" / "facts" / "bad.md").write_text("no header")
    now = F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")
    done = {r.path: r.outcome for r in migrate.apply(spark, str(tmp_path), now).collect()}
    assert done[f"archive/ms_{'B' * 26}.md"] == "moved" and done[f"memory/operator/facts/ms_{'C' * 26}.md"] == "moved" and len(done) == 4
    assert migrate.apply(spark, str(tmp_path), now).count() == 0
    left = sorted(p.name for p in (tmp_path / "memory" / "facts").iterdir())
    assert left == ["bad.md", f"ms_{'A' * 26}.md", f"ms_{'D' * 26}.md"]
    a = (tmp_path / "memory" / "facts" / f"ms_{'A' * 26}.md").read_text()
    assert "decay_after" not in a and "code_anchors" not in a and "legacy_confidence" in a and "stale: true" in a


def test_files_of_one_id_have_one_outcome_each(spark, tmp_path):
    (tmp_path / "memory" / "facts").mkdir(parents=True)
    for name in ("one", "two"):
        (tmp_path / "memory" / "facts" / f"{name}.md").write_text(head(**OLDER["a"]))
    done = [tuple(r) for r in migrate.apply(spark, str(tmp_path), F.lit("2024-06-01 00:00:00").cast("timestamp_ntz")).collect()]
    path = f"memory/facts/ms_{'X' * 26}.md"
    assert sorted(done) == [(path, "kept"), (path, "moved")]
    assert [p.name for p in (tmp_path / "memory" / "facts").iterdir()] == [f"ms_{'X' * 26}.md"]


def test_a_move_that_was_cut_short_ends(spark, tmp_path):
    import os

    for name in ("half", "twin", "linked", "taken", "at/taken", "place"):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(f"longer text than the new one of {name}")
    os.link(tmp_path / "half", tmp_path / "at" / "half")
    os.link(tmp_path / "twin", tmp_path / "elsewhere")
    (tmp_path / "pointer").symlink_to(tmp_path / "linked")
    rows = [(f"at/{n}", "new", n) for n in ("half", "twin", "pointer", "taken", "gone")] + [("place", "new", "place"), ("deep/er", "new", None)]
    done = {tuple(r) for r in markdown.relocate(spark.createDataFrame(rows, "path string, content string, was string"), str(tmp_path)).collect()}
    assert done == {(f"at/{n}", "moved") for n in ("half", "twin", "pointer", "gone")} | {("at/taken", "kept"), ("place", "written"), ("deep/er", "written")}
    assert all((tmp_path / p).read_text() == "new" for p in ("at/half", "at/twin", "at/pointer", "at/gone", "place", "deep/er"))
    assert (tmp_path / "elsewhere").read_text().endswith("twin") and (tmp_path / "linked").read_text().endswith("linked")
    assert (tmp_path / "at" / "taken").read_text().endswith("at/taken")
    assert sorted(p.name for p in tmp_path.iterdir()) == ["at", "deep", "elsewhere", "linked", "place"]


def test_many_small_files_are_few_tasks(spark, tmp_path):
    folder = tmp_path / "memory" / "facts"
    folder.mkdir(parents=True)
    (tmp_path / "_old").mkdir()
    for name in [*(f"memory/facts/{i}.md" for i in range(600)), "memory/facts/.hidden.md", "memory/facts/x.txt", "_old/a.md", "top.md"]:
        (tmp_path / name).write_text(head())
    (folder / "bytes.md").write_bytes(b"---\nid: \xff\n---\n")
    got = markdown.scan_records(spark, f"file:{tmp_path}")
    assert got.rdd.getNumPartitions() <= 8
    rows = {r.path: r.error for r in got.collect()}
    assert rows.keys() == {f"file:{folder}/{i}.md" for i in [*range(600), "bytes"]} | {f"file:{tmp_path}/top.md"}
    assert rows.pop(f"file:{folder}/bytes.md").startswith("UnicodeDecodeError") and not any(rows.values())


def test_headers_read_without_yaml_say_the_same():
    import yaml

    read = markdown._header()
    for text in (
        'id: "a"\ntags: ["x","y: z"]\next: {"k":{"n":1.5},"m":[true,null,-1]}\nconfidence: 0.5', 'ext: {"a": 1e5}', "confidence: 1e5", 'source: "\\u00e9\\/"', "id: plain # note",
        'id: "a\u2028b"', "created: 2024-01-02", 'other: "x"\non: 1', 'id: "a"\n  b: 1', "", 'id: "a"\nid: "b"', "check_by: NaN", "stale: yes",
    ):
        try:
            want = yaml.load(text, Loader=yaml.CSafeLoader)  # noqa: S506
        except yaml.YAMLError:
            want = None
        try:
            got = read(text)
        except yaml.YAMLError:
            got = None
        assert repr(got) == repr(want), text


def test_renames_and_hashes_of_a_repository(spark, tmp_path):
    import subprocess

    from recordloom.sources import repositories

    git = lambda *a: subprocess.run(
        ["git", "-C", str(tmp_path), "-c", "user.name=x", "-c", "user.email=x@y", *a], check=True, capture_output=True, text=True,
    ).stdout
    git("init", "-q")
    (tmp_path / "old.py").write_text("some lines\n" * 20)
    git("add", ".")
    git("commit", "-qm", "one")
    git("mv", "old.py", "new.py")
    assert [tuple(r) for r in repositories.renames(spark, str(tmp_path)).collect()] == [("old.py", "new.py")]
    assert repositories.hashes(str(tmp_path), ["new.py", "gone.py"]) == [("new.py", git("hash-object", "new.py").strip())]
    lines = spark.createDataFrame([(x,) for x in ("R100\ta\tc", "R090\ta\tb", "M\tz", "R\tonly", "", None)], "value string")
    assert [tuple(r) for r in repositories.parse_renames(lines).collect()] == [("a", "b")]
    assert repositories.renames(spark, str(tmp_path / "nowhere")).count() == 0


def test_whole_configuration():
    c = config.Config.read("search: {engine: hybrid, embeddings: {provider: x}}\nprofiles: {boot: {types: [decision], ranking: {relevance: 0.9}}}\nstores: [{name: a}, 7]\nanchors: {repo_search_paths: [x, 1]}\nstabilization: {enabled: true, min_confirmations: no}")
    assert (c.engine, c.embeddings, c.stores, c.repo_search_paths) == ("hybrid", {"provider": "x"}, ({"name": "a"},), ("x",))
    assert c.profiles["boot"].types == ("decision",) and c.profiles["boot"].relevance == 0.9 and c.profiles["default"].max_tokens == 2000
    assert c.stabilization == {"enabled": True, "min_confirmations": 2, "auto_promote_confidence": 0.9} and config.Config.read("a: [") == config.Config()


def test_schema_description():
    rows = {r[0]: r for r in markdown.describe()}
    assert rows["id"][2] and rows["state"][3] == "active|superseded|retired" and not rows["tags"][2] and len(rows) == len(markdown.NAMES)
