import json

import pytest

from recordloom.__main__ import main
from recordloom.engine import Engine

def I(name):  # noqa: E743
    """An id of the form records have."""
    return "ms_" + name.rjust(26, "0")


NOW = "2024-06-01T00:00:00Z"


def write(root, id, area="memory/facts", body="# Title\n\ntext", **head):
    base = {
        "id": id, "kind": "claim", "type": "fact", "state": "active", "created": "2024-05-01T00:00:00.000Z", "source": "agent-x",
        "check_by": "never",
    } | head
    path = root / area / f"{id}.md"
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("---\n" + "\n".join(f"{k}: {json.dumps(v)}" for k, v in base.items() if v is not None) + f"\n---\n\n{body}\n")


@pytest.fixture
def store(tmp_path):
    root = tmp_path / "high"
    write(root, I("A"), body="# Cache tokens expire\n\nThe cache drops tokens.", refines=[I("B")], tags=["auth"])
    write(root, I("B"), body="# Router base\n\nplain", supersedes=[I("OLD")], valid_from="2024-05-20T00:00:00Z")
    write(root, I("OLD"), area="archive", state="superseded", superseded_by=I("B"), body="# Router old\n\ncache")
    write(root, I("S"), check_by="2024-05-01T00:00:00.000Z", body="# Cache stale\n\nx")
    write(tmp_path / "low", I("A"), body="# Shadowed\n\ncache")
    write(tmp_path / "low", I("L"), body="# Cache low\n\nx")
    (root / "memory" / "facts" / "bad.md").write_text("broken")
    return [str(root), str(tmp_path / "low")]


def test_reads(spark, store):
    e = Engine.from_store(spark, *store, now=NOW)
    assert {r.id: r.title for r in e.records.collect()} == {
        I("A"): "Cache tokens expire", I("B"): "Router base", I("OLD"): "Router old", I("S"): "Cache stale", I("L"): "Cache low",
    }
    hits = e.search("cache", expand_edges=True).collect()
    assert {r.id for r in hits if r.hops == 0} == {I("A"), I("S"), I("L")} and [(r.id, r.from_id, r.edge_type) for r in hits if r.hops] == [(I("B"), I("A"), "refines")]
    assert {r.id for r in e.search("router", as_of="2024-05-10").collect()} == set()
    assert {r.id for r in e.search("router", as_of="2024-05-20").collect()} == {I("B")}
    assert len(e.search("cache", full=12).collect()) == 1
    assert {(r.role, r.id) for r in e.lineage(I("B")).collect()} == {("ancestor", I("OLD"))}
    assert [r.section for r in e.context().collect()] == [0, 2, 2, 2]
    status = {(r.section, r.value): r.n for r in e.status().collect()}
    assert status["state", "active"] == 4 and status["total", "all"] == 5 and status["stale", "all"] == 0
    assert [r.id for r in e.sweepable().collect()] == [I("S")] and [r.id for r in e.decaying().collect()] == [I("S")]
    e.views()
    assert spark.sql("select count(*) n from edges join records on id = dst").first().n == 3
    for bad in (
        lambda: e.search("x", limit=0), lambda: e.search("x", type="idea"), lambda: e.search("x", as_of="soon"),
        lambda: e.search("x", edge_types=("likes",)), lambda: e.context(budget=0), lambda: e.export("svg"),
        lambda: Engine.from_store(spark),
    ):
        with pytest.raises(ValueError):
            bad()


def test_changes_and_save(spark, store, tmp_path):
    e = Engine.from_store(spark, *store, now=NOW)
    new = spark.createDataFrame(
        [(I("N"), "fact", "Cache tokens rotate", "text", ["auth"], "human:me", None), (I("T"), "fact", "router BASE", "x", [], "agent-x", None)],
        "id string, type string, title string, body string, tags array<string>, source string, source_kind string",
    )
    e, rejected = e.remember(new)
    assert [(r.id, r.reason) for r in rejected.collect()] == [(I("T"), "duplicate")]
    assert e.get(I("N")).first().conflicts_with == [I("A")]
    e = e.observe(spark.createDataFrame([(I("O"), "Seen\nit", "2d", None)], "id string, text string, ttl string, source string"))
    e = e.relate(spark.createDataFrame([(I("A"), I("L"))], "id string, target string"), "supports")
    e = e.supersede(spark.createDataFrame([(I("L"), "gone", False)], "id string, reason string, override boolean"), "retract").sweep()
    e.save(str(tmp_path / "out"))
    again = {r.id: r for r in Engine.from_store(spark, str(tmp_path / "out"), now=NOW).records.collect()}
    assert again[I("N")].file_path == f"memory/operator/facts/{I('N')}.md" and again[I("O")].kind == "observation" and again[I("A")].supports == [I("L")]
    assert again[I("L")].state == "superseded" and again[I("S")].state == "retired" and again[I("S")].file_path.startswith("archive/")


def test_command_line(spark, store, capsys):
    assert main([",".join(store), "--now", NOW, "search", "router"]) == 0
    assert json.loads(capsys.readouterr().out.splitlines()[-1])["id"] == I("B")
    assert main([",".join(store), "--now", NOW, "export", "dot"]) == 0
    assert capsys.readouterr().out.strip().endswith("}")


def test_commands_that_change_the_store(spark, tmp_path, capsys):
    root = str(tmp_path / "s")

    def run(*args):
        assert main([root, "--now", NOW, *args]) == 0
        return [json.loads(x) for x in capsys.readouterr().out.splitlines() if x.startswith("{")]

    assert main([root, "init"]) == 0 and (tmp_path / "s" / "observations").is_dir()
    run("remember", "fact", "Cache tokens expire", "--body", "after a day", "--tags", "auth, cache", "--source", "agent-x")
    assert [r["outcome"] for r in run("remember", "fact", "cache TOKENS expire", "--source", "agent-x")] == ["duplicate"]
    first = run("search", "tokens")[0]["id"]
    run("observe", "Seen it", "--ttl", "2d")
    run("remember", "decision", "Rotate tokens", "--body", "weekly", "--refines", first, "--source", "human:me", "--pin")
    second = run("search", "rotate")[0]["id"]
    assert run("get", second)[0]["refines"] == [first] and run("get", second)[0]["pinned"]
    run("relate", second, first, "--field", "supports")
    run("supersede", first, "wrong", "--body", "after an hour", "--source", "agent-y")
    old = run("get", first)[0]
    assert old["state"] == "superseded" and old["file_path"].startswith("archive/") and run("get", old["superseded_by"])[0]["body"].endswith("after an hour")
    (tmp_path / "code.py").write_text("x = 1\n")
    run("anchor", second, "code.py", "--repository", str(tmp_path))
    assert run("get", second)[0]["anchors"][0]["file"] == "code.py" and run("reconcile", "--repository", str(tmp_path)) == []
    (tmp_path / "code.py").write_text("x = 2\n")
    assert [(r["id"], r["status"]) for r in run("reconcile", "--repository", str(tmp_path))] == [(second, "changed")]
    run("verify", old["superseded_by"], "--evidence", "seen", "--source", "agent-z")
    assert run("get", old["superseded_by"])[0]["verified_with"] == "evidence"
    assert run("sweep", "--dry-run") == [] and run("stores")[0]["items"] == 4
    assert {r["edge_type"] for r in run("search", "rotate", "--expand-edges", "--edge-types", "supports", "--include-superseded") if r["hops"]} == {"supports"}


def test_notes_of_a_folder_are_taken_in(spark, store, tmp_path, capsys):
    notes = tmp_path / "notes"
    notes.mkdir()
    (notes / "MEMORY.md").write_text("## Quick Facts\n| Entity | Key | Value |\n|---|---|---|\n| Server | port | 8080 |\n")
    (notes / "observations.md").write_text("- Saw it <!-- dc:type=decision dc:importance=0.8 dc:date=2024-02-03 -->\n")
    assert main([",".join(store), "--now", NOW, "import", str(notes)]) == 0
    capsys.readouterr()
    e = Engine.from_store(spark, *store, now=NOW)
    assert {(r.title, r.type, r.source_kind) for r in e.records.where("source = 'notes-import'").collect()} == {
        ("Server port", "fact", "import"), ("Saw it", "decision", "import"),
    }
